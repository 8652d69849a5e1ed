"""Quality scores learnt from preferences: a Bradley-Terry model over features of whole texts.

Of two labelled documents, one good and one bad, the good one is preferred. The model gives every document
a strength s = w.x, and a preference the probability sigmoid(s_good - s_bad): logistic loss on the
difference of the features, without an intercept, as only differences are seen. ``w`` is the minimum of the
mean loss plus a small square penalty, found by Newton's method.

Features of a text (``features``): rates of pairs of neighbouring character classes, of each ASCII mark and
of hashed character trigrams, all as square roots, and ratios of words and lines (repeats, capitals, marks
at the end, lengths).

Fitting: every labelled document that is not held out teaches (a bound is a parameter, for trials). Up to ``SENT`` labels are
sent to all tasks, which leave out other documents; with more, the features of all documents that are not held out meet the
labels in a join. Texts are not shuffled. The features are dealt to blocks of ``BLOCK`` rows; in a block every row of the commoner label meets ``PARTNERS`` rows of the other, in turn, so
pairs grow with the rows. Each Newton step is one job over the blocks: gradients and curvatures are added
up by Spark, and the driver sees sums of a fixed number of features.

Threshold: a quantile of the scores of the fit rows, the level being the one that tells the labels apart best
(the middle one of equals); the quantiles are those of all fit rows, read off their order by ranges. A document's score is sigmoid(s - threshold), so 0.5 is the threshold.

Edge cases: a null text counts as empty and is scored like any other. Labels other than 0 and 1, null labels
and null ids teach nothing; an id labelled more than once has the rounded mean; documents that share an id teach one
text, the one with the smallest features. A null doc_id is no held-out row (its remainder is that of
the empty text). With labels of one kind only, or none, there is no preference: every score is the share of
label 1 among the labels, 0.5 without any. Repeated rows are scored alike; an empty table gives no rows;
further columns are ignored. Bytes that are no UTF-8 are letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm.langid import held_out
from ticklake.llm.textblocks import LOWERED, blocks, mix64, span_hashes, words_of_texts
from ticklake.session import cut

#: Rows of a block; partners of a row; penalty; Newton steps.
BLOCK, PARTNERS = 512, 6
PENALTY, STEPS, SETTLED = 1e-3, 12, 1e-6
#: Levels of quantiles tried as threshold.
LEVELS = 1000
#: Labels that are sent to all tasks, at most.
SENT = 10_000

GRAMS = 128
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]

# Character classes: small, capital and other letters, digits, blanks, line ends, marks of sentences, other marks.
_CLASS = np.full(256, 2, dtype=np.int64)
_CLASS[:128] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 3
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 4, 5
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 6
_MARK = np.full(256, -1, dtype=np.int64)
_MARK[MARKS] = np.arange(len(MARKS))

_RATIOS = 14
DIM = 64 + len(MARKS) + GRAMS + _RATIOS


def _per_text(of: np.ndarray, value: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(of, weights=value, minlength=n).astype(np.float64)


def _repeats(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of each text, occurrences of its commonest)."""
    order = np.lexsort((keys, of))
    k, t = keys[order], of[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, t[at], runs)
    return _per_text(t[at], None, n), most


def features(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``DIM`` features for each text of a block."""
    n = len(starts) - 1
    size = np.diff(starts).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(starts))
    some = np.maximum(size, 1)[:, None]
    kind = _CLASS[raw]

    inner = text[1:] == text[:-1]
    pair = (text[:-1] * 64 + kind[:-1] * 8 + kind[1:])[inner]
    pairs = np.bincount(pair, minlength=n * 64).reshape(n, 64) / some
    mark = _MARK[raw]
    at = np.flatnonzero(mark >= 0)
    marks = np.bincount(text[at] * len(MARKS) + mark[at], minlength=n * len(MARKS)).reshape(n, -1) / some

    low = LOWERED[raw].astype(np.uint64)
    if len(raw) >= 3:
        code = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
        whole = text[2:] == text[:-2]
        bucket = (mix64(code[whole]) % np.uint64(GRAMS)).astype(np.int64)
        grams = np.bincount(text[:-2][whole] * GRAMS + bucket, minlength=n * GRAMS).reshape(n, GRAMS) / some
    else:
        grams = np.zeros((n, GRAMS))

    begins, ends = words_of_texts(raw, starts)
    of = np.searchsorted(starts, begins, side="right") - 1
    words = np.maximum(_per_text(of, None, n), 1)
    low8 = LOWERED[raw]
    hashes = span_hashes(low8, begins, ends) if len(begins) else np.empty(0, dtype=np.uint64)
    same = np.zeros(len(begins), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(begins), dtype=bool)
    twice[2:] = (hashes[2:] == hashes[:-2]) & (of[2:] == of[:-2])
    distinct, most = _repeats(hashes, of, n)
    capitals = np.concatenate([[0], np.cumsum(kind == 1)])
    length = ends - begins
    shouted = capitals[ends] - capitals[begins] >= np.maximum(length * 0.5, 2)
    first, last = kind[begins], kind[ends - 1] if len(ends) else kind[:0]
    alone = (length == 1) & (first >= 6)

    # Lines, empty ones left out.
    is_end = kind == 5
    opens = np.ones(len(raw), dtype=bool)
    opens[1:] = is_end[:-1]
    opens[starts[:-1][size > 0]] = True
    line_at = np.flatnonzero(opens & ~is_end)
    stop = np.append(np.flatnonzero(is_end), len(raw))
    line_end = np.minimum(stop[np.searchsorted(stop, line_at)], starts[text[line_at] + 1]) if len(line_at) else line_at
    line_of = text[line_at]
    lines = np.maximum(_per_text(line_of, None, n), 1)
    line_kinds = _repeats(span_hashes(raw, line_at, line_end), line_of, n)[0] if len(line_at) else np.zeros(n)

    ratios = np.stack(
        [
            np.sqrt(_per_text(of, same, n) / words),
            np.sqrt(_per_text(of, twice, n) / words),
            np.log1p(distinct) / np.log1p(words),
            np.sqrt(most / words),
            np.sqrt(_per_text(of, shouted, n) / words),
            np.sqrt(_per_text(of, first == 1, n) / words),
            np.sqrt(_per_text(of, last == 6, n) / words),
            np.sqrt(_per_text(of, last == 7, n) / words),
            np.sqrt(_per_text(of, alone, n) / words),
            np.sqrt(_per_text(of, length > 24, n) / words),
            np.log1p(_per_text(of, length, n) / words),
            np.log1p(size) / 10,
            np.log1p(size / lines) / 10,
            1 - line_kinds / lines,
        ],
        axis=1,
    )
    out = np.concatenate([np.sqrt(pairs), np.sqrt(marks), np.sqrt(grams), ratios], axis=1)
    return out.astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Weights of the features and the threshold, or a constant score where there was nothing to learn."""

    weights: np.ndarray | None
    threshold: float = 0.0
    constant: float = 0.5
    #: The level of the quantile that the threshold is.
    level: float | None = None

    def scores(self, column: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for _, raw, starts in blocks(column):
            if self.weights is None:
                out.append(np.full(len(starts) - 1, self.constant))
            else:
                out.append(_sigmoid(features(raw, starts) @ self.weights - self.threshold))
        return pa.array(np.concatenate(out))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raw, starts in blocks(batch.column(1)):
            n = len(starts) - 1
            rows = features(raw, starts).astype("<f4")
            ids = batch.column(0).slice(first, n)
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "x"])


def pairs(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(preferred rows, the others) of a block: each row of the commoner label meets rows of the other in turn."""
    high, low = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(high) or not len(low):
        return high[:0], low[:0]
    many, few = (high, low) if len(high) >= len(low) else (low, high)
    partners = min(PARTNERS, len(few))
    i = np.repeat(np.arange(len(many)), partners)
    j = (i * partners + np.tile(np.arange(partners), len(many))) % len(few)
    return (many[i], few[j]) if many is high else (few[j], many[i])


def _step(weights: np.ndarray, scale: np.ndarray):
    """Sums of loss, gradient and curvature over the pairs of each block, at these weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, loss = None, 0, 0.0
        for batch in batches:
            for good, xs in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(b"".join(xs.as_py()), "<f4").reshape(-1, DIM) / scale
                a, b = pairs(np.array(good.as_py()))
                if not len(a):
                    continue
                d = x[a] - x[b]
                margin = d @ weights
                miss = _sigmoid(-margin)
                curve = miss * (1 - miss)
                here = np.concatenate([(-miss @ d)[None, :], (d * curve[:, None]).T @ d])
                total = here if total is None else total + here
                count += len(a)
                loss += float(np.logaddexp(0, -margin).sum())
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([count]), pa.array([loss]), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["n", "loss", "sums"]
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, loss, total = 0, 0.0, None
    for batch in batches:
        for i in range(batch.num_rows):
            here = np.frombuffer(batch.column(2)[i].as_buffer(), "<f8")
            total = here.copy() if total is None else total + here
            n, loss = n + batch.column(0)[i].as_py(), loss + batch.column(1)[i].as_py()
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["n", "loss", "sums"])


_SUMS = "n long, loss double, sums binary"


def _sums(held: DataFrame, weights: np.ndarray, scale: np.ndarray) -> tuple[int, float, np.ndarray | None]:
    """The sums of all blocks; tasks add up their own, a few tasks add those."""
    parts = held.select("good", "xs").mapInArrow(_step(weights, scale), _SUMS)
    rows = parts.repartition(4).mapInArrow(_added, _SUMS).collect()  # at most four rows
    if not rows:
        return 0, 0.0, None
    total = sum(np.frombuffer(r["sums"], "<f8") for r in rows).reshape(DIM + 1, DIM)
    return sum(r["n"] for r in rows), sum(r["loss"] for r in rows), total


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sum and sum of squares of the features."""
    n, one, two = 0, np.zeros(DIM), np.zeros(DIM)
    for batch in batches:
        if batch.num_rows:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f4").reshape(-1, DIM).astype(np.float64)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
    if n:
        both = np.concatenate([one, two]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([0.0]), pa.array([both], pa.binary())], ["n", "loss", "sums"])


def _strengths(weights: np.ndarray):
    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        rows = np.frombuffer(b"".join(x.to_pylist()), "<f4").reshape(-1, DIM)
        return pa.array(rows @ weights)

    return score


def best_level(good: np.ndarray, bad: np.ndarray) -> int:
    """Where to cut runs of rows in order of their scores (number of runs below): the cut with the fewest wrong
    labels, of equals the middle one."""
    wrong = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([[bad.sum()], bad.sum() - np.cumsum(bad)])
    best = np.flatnonzero(wrong == wrong.min())
    return int(best[len(best) // 2])


def percentiles(scored: DataFrame, levels: np.ndarray) -> np.ndarray:
    """The same as ``percentile`` of the column ``s``, which is never empty, without a task that holds all its values.

    Rows are sorted by ranges; the counts of the ranges say which of them hold the places asked for.
    """
    ranges = cut(scored.select("s").repartitionByRange("s").withColumn("part", F.spark_partition_id()), "ranges")
    counts = {r["part"]: r["count"] for r in ranges.groupBy("part").count().collect()}  # one row per range
    before, n = {}, 0
    for part in sorted(counts):
        before[part], n = n, n + counts[part]
    at = (n - 1) * levels
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")]
    place = (offset + F.row_number().over(Window.partitionBy("part").orderBy("s")) - 1).alias("place")
    wanted = F.col("place").isin(np.unique([low, high]).tolist())
    value = dict(map(tuple, ranges.select(place, "s").where(wanted).collect()))  # two rows per level
    below, above = (np.array([value[i] for i in side.tolist()]) for side in (low, high))
    between = (high - at) * below + (at - low) * above
    return np.where((low == high) | (below == above), below, between)


def _run_of(edges: np.ndarray):
    @F.arrow_udf("int")
    def run(s: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, s.to_numpy(zero_copy_only=False), side="right") - 1, pa.int32())

    return run


def _threshold(scored: DataFrame) -> tuple[float, float]:
    """(threshold, its level) from (good, s): a quantile, moved to the middle of the gap it lies in."""
    edges = np.unique(percentiles(scored, np.array([i / LEVELS for i in range(LEVELS + 1)])))
    run = _run_of(edges)(F.col("s"))
    good, bad = np.zeros(len(edges), dtype=np.int64), np.zeros(len(edges), dtype=np.int64)
    for r in scored.groupBy(run.alias("run"), "good").count().collect():  # at most two per level
        (good if r["good"] == 1 else bad)[r["run"]] = r["count"]
    at = best_level(good, bad)
    edge = float(edges[at]) if at < len(edges) else float(edges[-1]) + 1.0
    above = F.col("s") >= edge
    low, high, n, below = scored.agg(
        F.max(F.when(~above, F.col("s"))), F.min(F.when(above, F.col("s"))), F.count("*"), F.count_if(~above)
    ).first()
    low, high = (high - 1.0 if low is None else low), (low + 1.0 if high is None else high)
    return (low + high) / 2, below / n


def labelled(labels: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """(doc_id, good) of the labels that teach: all that are not held out, or about ``fit_rows`` of them at most."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("good"))
    n = 0 if fit_rows is None else one.count()
    if fit_rows is None or n <= fit_rows:
        return one
    part = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40)) < F.lit(int(fit_rows / n * (1 << 40)))
    return one.where(part)


def taught(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, good, x) of the documents whose label is among ``known`` (doc_id, good); copies of an id are one row.

    Features are made where the texts are read, so what is dealt by id has a fixed width.
    """
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    if known.count() <= SENT:
        texts = texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    made = texts.mapInArrow(_featured, "doc_id long, x binary")
    return made.groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id").select("doc_id", "good", "x")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None) -> Model:
    """Learn from (doc_id, text) and (doc_id, quality)."""
    known = cut(labelled(labels, fit_rows), "labels")
    rows = cut(taught(docs, known), "features")
    counts = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        return Model(None, constant=counts.get(1, 0) / n if n else 0.5)

    spread = rows.select("x").mapInArrow(_spread, _SUMS).repartition(4).mapInArrow(_added, _SUMS).collect()
    one, two = sum(np.frombuffer(r["sums"], "<f8") for r in spread).reshape(2, DIM)
    scale = np.sqrt(np.maximum(two / n - (one / n) ** 2, 0))
    scale[scale < 1e-6] = 1.0

    # Rows of a block are a random part of both labels, in an order that reruns keep.
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(-(-n // BLOCK)))
    dealt = rows.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "good", "x"))).alias("rows"))
    held = cut(dealt.select(F.col("rows.good").alias("good"), F.col("rows.x").alias("xs")), "blocks")

    weights, before = np.zeros(DIM), np.inf
    for _ in range(STEPS):
        count, loss, sums = _sums(held, weights, scale)
        if sums is None:  # labels so rare that no block holds both
            return Model(None, constant=counts[1] / n)
        value = loss / count + PENALTY / 2 * float(weights @ weights)
        if before - value < SETTLED:
            break
        before = value
        gradient = sums[0] / count + PENALTY * weights
        curvature = sums[1:] / count + PENALTY * np.eye(DIM)
        weights = weights - np.linalg.solve(curvature, gradient)
    weights = weights / scale

    scored = cut(rows.select("good", _strengths(weights)(F.col("x")).alias("s")), "strengths")
    threshold, level = _threshold(scored)
    return Model(weights, threshold, level=level)


def score(text: Column, model: Model) -> Column:
    """The score of each text, 0 to 1."""

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        return model.scores(texts)

    return judge(text)


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """Documents (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted."""
    model = train(docs, labels, fit_rows)
    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
