"""Each pipeline stage against what its operator says in plain Python, and on awkward tables."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelweave.llm import language, pii, quality, simhash
from pixelweave.llm.common import read, staged
from tests.conftest import SF
from tests.llm.test_llm import empty, odd  # noqa: F401
from tests.llm.test_near import kept_by_brute_force


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        after = staged(f(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(steps):
    assert [n for n, *_ in steps] == ["quality", "language", "near_duplicates", "personal_data", "packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns
    assert steps[-1][2].count() > 0


def test_quality_keeps_what_scores_half(spark, steps):
    """Each document scored alone, by the model that the stage trains."""
    _, before, after = steps[0]
    model = quality.train(before, read(spark, SF, "labels"), allowed=lambda key: quality.remainder(key, 3) != 1)
    rows = [(r["doc_id"], quality.passages(r["text"] or "")) for r in before.collect()]
    want = [k for k, bag in rows if model.score(bag, np.array([0]))[0] >= 0.5]
    assert 0 < len(want) < len(rows) and sorted(want) == sorted(r["doc_id"] for r in after.select("doc_id").collect())


def test_language_drops_what_fits_no_model(spark, steps):
    """The likelihoods of each text alone decide what goes; a text that none of the evidence but its own words speaks for gets their language."""
    _, before, after = steps[1]
    model, kept, sure = language.trained(before), [], {}
    for r in before.collect():
        cells = language.trigrams(r["text"] or "")
        ll = model[:, cells].sum(1, dtype=np.float64)
        if len(cells) >= language.LEAST and ll.max() / len(cells) >= language.FLOOR:
            kept.append(r["doc_id"])
            if language.SCALE * (np.sort(ll)[-1] - np.sort(ll)[-2]) > 20:  # more than priors and declarations can say against it
                sure[r["doc_id"]] = language.LANGUAGES[int(ll.argmax())]
    got = {r["doc_id"]: r["lang"] for r in after.collect()}
    assert sorted(got) == sorted(kept) and len(sure) > len(kept) / 2 and all(got[k] == x for k, x in sure.items())


def test_near_duplicates_keep_the_first(steps):
    _, before, after = steps[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(kept_by_brute_force(rows))


def test_redaction(steps):
    _, before, after = steps[3]
    was, now = ({r["doc_id"]: r for r in df.collect()} for df in (before, after))
    assert set(was) == set(now)
    for k, r in now.items():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.base_spans(was[k]["text"]) and "token" not in was[k]["text"]:
            assert r["text"] == was[k]["text"] or "[" in r["text"]


def test_packs_all(steps):
    _, before, after = steps[4]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in after.collect()}
    sums = collections.Counter()
    for r in after.collect():
        sums[r["doc_id"]] += r["length"]
    assert sums == tokens and set(tokens) == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_awkward(spark, odd, empty):  # noqa: F811
    docs = read(spark, odd[0], "documents")
    for name, f in corpus_pipeline.STAGES:
        after = staged(f(spark, docs, odd[0]), name)
        if name != "packing":
            assert after.columns == docs.columns
            docs = after
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_first_copies(spark, read(spark, odd[0], "documents"), odd[0]).collect()]
    assert sorted(str(k) for k, _ in kept) == ["1", "2", "4", "6", "None"]
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.keep_languages(spark, read(spark, odd[0], "documents"), odd[0]).where(F.col("doc_id") == 1).count() == 2


def test_first_copies_are_op7s(spark):
    found = simhash.op7_simhash(spark, SF).where(F.col("doc_id") == F.col("component_id"))
    kept = simhash.first_of_each(read(spark, SF, "documents"))
    assert {r[0] for r in found.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}
