"""Near-duplicates of the pipeline's third stage against brute force over five-word shingles."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from pixelweave.llm import components, language, near, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[k][0] for k in map(find, range(len(rows)))}


def corpus(copies, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = ["", "  ", "one two", "One TWO"]
    for n in copies:
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 25)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("copies", "block"), [([3] * 25 + [1] * 20, 1024), ([60, 40, 12, 2, 2], 1024), ([60, 40], 16)])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, copies, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus(copies, len(copies))
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], SCHEMA).repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.keep_first_copies(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == kept_by_brute_force(rows)


def test_grid_proposes_all_near_fingerprints(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for b in base for _ in range(3)] + base[:5]
    nodes = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(fps)]
    pairs = simhash.candidates(spark.createDataFrame(nodes, "mark bigint, fp bigint"))
    roots = {r["node"]: r["root"] for r in components.components(pairs).collect()}
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                assert roots[i] == roots[j]


def test_fingerprint_is_the_majority_of_five_word_shingles():
    text = "a b c d e f g a b c d e " * 3
    known = simhash._known(pa.array([text, None, ""])).to_pylist()
    hashes = near.shingle_hashes(near.words(text)).tolist()
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert known[0]["fp"] & (1 << 64) - 1 == want and [k["fp"] for k in known[1:]] == [0, 0] and known[1]["mark"] == known[2]["mark"]


def test_declaration_after_long_attributes(spark):
    text = '<html prefix="' + "og: http://ogp.me/ns# " * 30 + '" class="a" lang="de"><p>x'
    df = spark.createDataFrame([(1, text, None, "a", 0), (2, "<html " + "x " * 300 + "<p lang='fr'>", None, "a", 0)], SCHEMA)
    assert {r["doc_id"]: r["declared"] for r in language.from_documents(df).collect()} == {1: "de", 2: None}
