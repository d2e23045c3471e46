"""Seating of dishes with many customers against the full recursion of the generalised Stirling numbers."""

import numpy as np
import pytest

from pixelweave.llm import pitman_yor


def recursion(c, d):
    row, t = np.full(c + 1, -np.inf), np.arange(1, c + 1)
    row[0] = 0.0
    for n in range(1, c + 1):
        new = np.full(c + 1, -np.inf)
        with np.errstate(divide="ignore"):
            new[1 : n + 1] = np.logaddexp(row[:n], np.log(np.maximum(n - 1 - d * t[:n], 1e-300)) + row[1 : n + 1])
        row = new
    return row[1:]


@pytest.mark.parametrize("d", [0.9, 0.6])
@pytest.mark.parametrize("c", [600, 3000, 8000])
def test_many_customers(c, d):
    true, t = recursion(c, d), np.arange(1, c + 1)
    assert np.abs(pitman_yor.log_stirling(c, t, d) - true).max() < 1e-3
    for others, base in ((1000, 0.05), (1000, 0.01), (50_000, 0.05), (20, 1e-4), (200_000, 0.3)):
        w = true + np.cumsum(np.log(2.0 + d * (others + t - 1))) + t * np.log(base)
        w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        want, sd = (w * t).sum(), np.sqrt((w * t * t).sum() - (w * t).sum() ** 2)
        luck = (np.arange(50) + 0.5) / 50
        drawn = pitman_yor.seat(np.full(50, c), np.full(50, others), np.full(50, base), luck, d, 2.0)
        assert abs(drawn.mean() - want) < 0.05 * sd + 0.05, (others, base)


def test_spread_contexts_are_seated_as_any_other(spark, monkeypatch):
    """Contexts whose pairs have many tables: scores don't depend on whether they are spread over buckets."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"hub w{k}" for k in rng.integers(0, 60, 400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(pitman_yor, "BUCKETS", 2)
    dealt = {r["doc_id"]: r["score"] for r in pitman_yor.scores(df).collect()}
    monkeypatch.setattr(pitman_yor, "frequent_share", lambda parts: 2.0)
    alone = {r["doc_id"]: r["score"] for r in pitman_yor.scores(df).collect()}
    assert all(np.isclose(alone[k], dealt[k], rtol=1e-5) for k in alone)


def test_pairs_are_not_moved_as_rows(spark):
    """22,500 pairs, each seen more often, travel in packed arrays: the whole job shuffles fewer rows than there are pairs."""
    rng = np.random.default_rng(5)
    words = np.concatenate([rng.permutation(np.stack(np.meshgrid(np.arange(150), np.arange(150)), -1).reshape(-1, 2)).ravel() for _ in range(2)])
    texts = [" ".join(f"w{k}" for k in words[at : at + 500]) for at in range(0, len(words), 500)]
    ids = [k for k in range(1000) if not pitman_yor.held_out(k)][: len(texts)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    context = spark.sparkContext
    context.setJobGroup("pairs", "pairs")
    try:
        got = pitman_yor.scores(df).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {k for j in tracker.getJobIdsForGroup("pairs") for k in tracker.getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages)
    assert len(got) == len(texts) and 0 < moved < 22_500, moved


def test_messages_follow_the_data(spark):
    """30,075 tokens, twice: with 96 shuffle partitions there are no more messages than 64 buckets and groups make, and scores are those of 4 partitions."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1500, 400)) for _ in range(75)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    context, moved, scores = spark.sparkContext, [], []
    try:
        for n in (4, 96):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            context.setJobGroup(f"messages {n}", "messages")
            scores.append({r["doc_id"]: r["score"] for r in pitman_yor.scores(df).collect()})
            context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
            stages = {k for j in tracker.getJobIdsForGroup(f"messages {n}") for k in tracker.getJobInfo(j).stageIds}
            moved.append(sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(np.isclose(scores[0][k], scores[1][k], rtol=1e-6) for k in scores[0])
    assert 0 < moved[1] < 45_000, moved


def test_many_tokens_still_make_more_buckets():
    assert [pitman_yor.bucket_count(n, 10**6) for n in (4, 32, 211, 3000)] == [8, 64, 64, 64]
    assert [pitman_yor.bucket_count(n, 8 * 10**6) for n in (4, 12, 211)] == [8, 24, 80]
    assert pitman_yor.bucket_count(3000, 7 * 10**9) == 6000  # as before: a bucket has over a million tokens
    assert pitman_yor.bucket_count(4, 7 * 10**9) == 1750
    assert pitman_yor.bucket_count(4, 0) == 8
