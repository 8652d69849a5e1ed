"""Bradley-Terry quality scores: features, pairs, the optimum, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticklake.llm import quality
from ticklake.llm.textblocks import blocks


def rows_of(texts, limit=1 << 20):
    return np.concatenate([quality.features(raw, starts) for _, raw, starts in blocks(pa.array(texts, pa.string()), limit=limit)])


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 3 == 1


TEXTS = ["The cat sat. It sat!", "", None, "A", "\n\n", "UP!! DOWN!! UP!!", "x | y | z\nx | y | z\n", "über Straße 漢字", "a " * 500, "###"]


def test_features_do_not_depend_on_the_block():
    together = rows_of(TEXTS)
    assert together.shape == (len(TEXTS), quality.DIM)
    assert np.isfinite(together).all()
    for limit in (1, 30):
        assert np.array_equal(rows_of(TEXTS, limit), together)
    for i, t in enumerate(TEXTS):
        assert np.array_equal(rows_of([t])[0], together[i])
    assert np.array_equal(together[1], together[2])


def test_features_against_plain_counts():
    ratios = quality.DIM - quality._RATIOS
    text = "Dog dog DOG cat#\nold line\nold line\n a"
    words = text.split()
    got = rows_of([text])[0]
    low = [w.lower() for w in words]
    assert got[ratios] == pytest.approx(np.sqrt(sum(a == b for a, b in zip(low, low[1:])) / len(words)))
    assert got[ratios + 1] == pytest.approx(np.sqrt(sum(a == b for a, b in zip(low, low[2:])) / len(words)))
    assert got[ratios + 3] == pytest.approx(np.sqrt(3 / len(words)))
    assert got[ratios + 4] == pytest.approx(np.sqrt(1 / len(words)))  # DOG
    assert got[ratios + 7] == pytest.approx(np.sqrt(1 / len(words)))  # cat#
    assert got[ratios + 13] == pytest.approx(1 - 3 / 4)  # one of four lines is a repeat
    mark = 64 + quality.MARKS.index(ord("#"))
    assert got[mark] == pytest.approx(np.sqrt(1 / len(text)))


@pytest.mark.parametrize(("high", "low"), [(20, 3), (3, 20), (1, 1), (4, 4), (5, 0), (0, 5)])
def test_pairs_use_every_row(high, low):
    good = np.array([1] * high + [0] * low)
    a, b = quality.pairs(good)
    assert (good[a] == 1).all() and (good[b] == 0).all()
    assert len(a) == (max(high, low) * min(quality.PARTNERS, high, low) if high and low else 0)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)
    if high and low:
        assert set(a) | set(b) == set(range(high + low))


def test_the_best_level():
    assert quality.best_level(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 2
    assert quality.best_level(np.array([0, 0, 0, 1]), np.array([1, 0, 0, 0])) == 2  # cuts 1, 2 and 3 are alike
    assert quality.best_level(np.array([5, 5]), np.array([0, 0])) == 0


def test_weights_are_the_minimum_of_the_loss(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(documents, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if not held_out(r.doc_id)}
    rows = [(r.doc_id, known[r.doc_id], r.text) for r in documents.collect() if r.doc_id in known]
    x = rows_of([t for _, _, t in rows]).astype(np.float64)
    good = np.array([g for _, g, _ in rows])
    scale = x.std(axis=0)
    scale[scale < 1e-6] = 1
    # few rows are one block, in order of their ids
    order = np.argsort([d for d, _, _ in rows])
    a, b = quality.pairs(good[order])
    d = (x[order][a] - x[order][b]) / scale
    w = model.weights * scale
    gradient = -(1 / (1 + np.exp(d @ w))) @ d / len(a) + quality.PENALTY * w
    assert np.abs(gradient).max() < 1e-3
    strengths = x @ model.weights
    wrong = [int(((strengths >= t) != (good == 1)).sum()) for t in np.append(np.sort(strengths), np.inf)]
    assert int(((strengths >= model.threshold) != (good == 1)).sum()) == min(wrong)


def test_documents(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality(documents, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in documents.collect())
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    hard = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in hard) >= 0.95 * len(hard)
    # held-out labels, languages and sources have no say
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 0).otherwise(F.col("quality")))
    moved = documents.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    key = lambda r: (r.doc_id, r.score)
    assert sorted(map(key, quality.quality(moved, other).collect())) == sorted(map(key, got))


def test_a_bounded_number_of_labels_teaches(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    few = quality.labelled(labels, fit_rows=40)
    assert 20 <= few.count() <= 60
    twice = quality.labelled(labels.unionByName(labels), fit_rows=40)
    assert sorted(twice.collect()) == sorted(few.collect())


def test_every_label_teaches(spark):
    # More labels than any bound that the fit had.
    labels = spark.range(90_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert quality.labelled(labels).count() == sum(not held_out(i) for i in range(90_000))


@pytest.mark.parametrize("sent", [0, 10_000])
def test_texts_are_not_shuffled(spark, documents, sf, monkeypatch, sent):
    # With labels too many for a broadcast, texts went through the shuffle of the join.
    plans = {}

    def cut(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    write = quality.cut
    monkeypatch.setattr(quality, "cut", cut)
    monkeypatch.setattr(quality, "SENT", sent, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quality.train(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plans["features"].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    made = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    end = next((i for i in range(made + 1, len(lines)) if depth[i] <= depth[made]), len(lines))
    assert any("Exchange hashpartitioning" in line for line in lines[:made])
    assert not any("Exchange hashpartitioning" in line or "SortMergeJoin" in line for line in lines[made:end])


def test_many_labels_teach_as_few_do(spark, monkeypatch):
    texts = [("Good words, well put. " * (i % 5 + 1) if i % 2 else "BAD!! x|y|z " * (i % 7 + 1)) + str(i) for i in range(60)]
    # Ids that come twice, with other texts and as copies, no id, no text, an id without label.
    rows = [*enumerate(texts), *[(i, f"Another text {i}.") for i in range(20)], *list(enumerate(texts))[10:30], (None, "None."), (60, None), (61, "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = [*[(i, i % 2) for i in range(60)], (3, 1), (4, 1), (7, None), (None, 1), (60, 0), (70, 1)]
    known = quality.labelled(spark.createDataFrame(marks, "doc_id long, quality int"))
    good = {r.doc_id: r.good for r in known.collect()}
    want = {}
    for (i, _), x in zip(rows, rows_of([t for _, t in rows])):
        if i in good:
            want[i] = min(want.get(i, x.tobytes()), x.tobytes())
    for sent in (0, 10_000):
        monkeypatch.setattr(quality, "SENT", sent)
        got = quality.taught(docs, known).collect()
        assert sorted((r.doc_id, r.good, bytes(r.x)) for r in got) == sorted((i, good[i], x) for i, x in want.items())


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [0.5] * 40, [i * 0.37 % 1 for i in range(3000)]])
def test_percentiles_equal_those_of_spark(spark, values):
    levels = np.array([i / 1000 for i in range(1001)])
    df = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(7)
    want = df.select(F.percentile("s", F.array(*[F.lit(float(x)) for x in levels])).alias("q")).first()["q"]
    assert quality.percentiles(df, levels).tolist() == want


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    schema = "doc_id long, quality int, score double, text string"
    some = [(0, 1), (8, 1), (9, 1), (11, 0), (12, 0), (-7, 0), (2, 0), (3, None), (None, 1), (5, 1), (5, 1), (6, 7), (99, 0)]
    labels = spark.createDataFrame([(i, q, 0.1, "t") for i, q in some], schema)
    got = quality.quality(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[2] == by_id[3]  # null is empty
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality.quality(no_docs, labels).count() == 0
    none = quality.quality(odd_docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    good = quality.quality(odd_docs, labels.where("quality = 1")).collect()
    assert {(r.score, r.predicted) for r in good} == {(1.0, 1)}
    bad = quality.quality(odd_docs, labels.where("quality = 0")).collect()
    assert {(r.score, r.predicted) for r in bad} == {(0.0, 0)}
