"""Texts that are compressed side by side, and the decoder that reads its codes from tables."""

import zlib

import numpy as np
import pytest

from pixelweave.operators import deflate, inflate


def texts(n):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)]
    made = [" ".join(words[k] for k in rng.integers(0, 300, size)).encode() for size in rng.integers(1, 400, n)]
    return [b"", b"a", *made, b"ab" * 5000, made[0], b"", rng.integers(0, 256, 3000, np.uint8).tobytes()]


def test_one_search_for_many_texts(monkeypatch):
    calls, search = [], deflate.cheapest_steps
    monkeypatch.setattr(deflate, "cheapest_steps", lambda *a: calls.append(1) or search(*a))
    options, own = deflate.Options(deflate.BEST, 2), texts(100)
    made = deflate.compress_all(own, options)
    assert len(calls) <= 2
    assert [zlib.decompress(z, -15) for z in made] == own
    assert [inflate.trace(z, len(x)).data for z, x in zip(made, own, strict=True)] == own
    alone = [len(deflate.compress(x, options)) for x in own]
    assert sum(map(len, made)) <= 1.001 * sum(alone)


@pytest.mark.parametrize("batch", [1, 500, 20000])
def test_any_batch_gives_every_text(monkeypatch, batch):
    monkeypatch.setattr(deflate, "BATCH", batch)
    own = texts(30)
    for passes in (1, 3):
        assert [zlib.decompress(z, -15) for z in deflate.compress_all(own, deflate.Options(deflate.BEST, passes))] == own
    assert deflate.compress_all([]) == []
    stored = deflate.compress_all(own, deflate.Options(deflate.STORE))
    assert [zlib.decompress(z, -15) for z in stored] == own


def test_regions_longer_than_one(monkeypatch):
    monkeypatch.setattr(deflate, "REGION", 1000)
    own = texts(20)
    assert [zlib.decompress(z, -15) for z in deflate.compress_all(own, deflate.Options(deflate.BEST, 2))] == own


def test_streams_that_end_early():
    data = texts(10)[5]
    z = deflate.compress(data, deflate.Options(deflate.BEST, 2))
    for k in range(len(z)):
        with pytest.raises(inflate.InflateError):
            inflate.trace(z[:k], len(data))
