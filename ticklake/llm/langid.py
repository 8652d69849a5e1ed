"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one binary n-gram classifier per bit says on which side a text
stands. Up to seven languages use all their two-way splits, more use the best of a number of random
dense codes. Decoding is loss-weighted: a language's loss is the logistic loss of each bit's margin
against its codeword, weighted by how well that bit tells the languages apart; the smallest loss
wins. A text whose second-best codeword is nearly as close is flagged as ambiguous.

Training counts byte trigrams (ASCII and Latin-1 letters lower-cased, everything that is no letter a
space) per language over all training documents; Spark sums the counts, and only the sums (languages
times ``BUCKETS``) reach the driver, where the bits' weights are log-ratios of them. Prediction is one
pass over whole texts.

Edge cases: a null text or one without a letter is ``und`` with score 0 and not ambiguous. Documents
with a null text or lang teach nothing; with no training document everything is ``und``; with one
language everything with a letter is that language, score 1. Bytes that are no UTF-8 are no letters. A null doc_id counts as a training row
(its remainder is that of the empty text). Ties between languages go to the first by code point.
Repeated rows are judged alike; further columns stay as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.llm.textblocks import LOWERED, blocks

BUCKETS = 1 << 13
#: Letters that count at most towards the confidence of a text, and the gap of losses (as part of all
#: weights) below which two languages are too close to call.
EVIDENCE, CLOSE = 400, 0.02
SMOOTH = 0.5
RESULT = "struct<lang:string,score:double,ambiguous:boolean>"

_KEPT = np.where(
    ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128), np.arange(256), 32
).astype(np.uint8)
_KEPT[65:91] = LOWERED[65:91]


def held_out(doc_id: Column) -> Column:
    """Documents that teach nothing: crc32 of the id as text leaves remainder 1 by 3."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def grams(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the trigrams with a letter in the middle, text number of each)."""
    if len(raw) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    low = _KEPT[raw]
    # Latin-1 capitals are C3 80..9E in UTF-8, their small letters 20 (hex) higher.
    capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low[1:][capital] += 0x20
    code = (low[:-2].astype(np.uint32) << np.uint32(16)) | (low[1:-1].astype(np.uint32) << np.uint32(8)) | low[2:]
    keep = low[1:-1] != 32
    edges = starts[1:-1]  # trigrams across two texts
    for back in (1, 2):
        cut = edges - back
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    at = np.flatnonzero(keep)
    bucket = (code[at] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64), np.searchsorted(starts, at, side="right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        langs, buckets, counts = [], [], []
        for lang, row in held.items():
            used = np.flatnonzero(row)
            langs += [lang] * len(used)
            buckets.append(used)
            counts.append(row[used])
        held.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()),
                pa.array(np.concatenate(buckets).astype(np.int32)),
                pa.array(np.concatenate(counts).astype(np.int64)),
            ],
            ["lang", "bucket", "n"],
        )

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, raw, starts in blocks(batch.column(0)):
            bucket, text = grams(raw, starts)
            edges = np.searchsorted(text, np.arange(len(starts)))
            for i in range(len(starts) - 1):
                if edges[i] < edges[i + 1]:
                    row = held.setdefault(langs[first + i], np.zeros(BUCKETS, dtype=np.int64))
                    row += np.bincount(bucket[edges[i] : edges[i + 1]], minlength=BUCKETS)
            if len(held) > 256:  # many language values: sums so far go to Spark
                yield flush()
    if held:
        yield flush()


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A matrix of -1 and 1: a row per language, a column per bit."""
    if languages <= 7:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(splits, dtype=np.float64).reshape(-1, languages).T
    rng, bits = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(languages)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (languages, bits))
        nearest = ((bits - code @ code.T) / 2 + bits * np.eye(languages)).min()
        if nearest > apart and (np.abs(code.sum(axis=0)) < languages).all():
            best, apart = code, nearest
    return best


class Model:
    """Languages, codewords, and a weight per bit and bucket."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts, key=lambda x: x.encode())
        n = len(self.languages)
        if n < 2:
            return
        freq = np.array([counts[x] + SMOOTH for x in self.languages], dtype=np.float64)
        freq /= freq.sum(axis=1, keepdims=True)
        self.code = codewords(n)
        weights, worth = [], []
        for bit in self.code.T:
            w = np.log(freq[bit > 0].mean(axis=0)) - np.log(freq[bit < 0].mean(axis=0))
            margins = freq @ w  # what each language's own text gets on average
            weights.append(w.astype(np.float32))
            worth.append(max(float((margins * bit).min()), 1e-3))
        self.weights = np.array(weights)
        self.worth = np.array(worth) / np.sum(worth)

    def decide(self, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) from mean margins and numbers of trigrams."""
        scaled = margins * np.sqrt(np.minimum(n, EVIDENCE))[:, None] * 4.0
        loss = np.zeros((len(margins), len(self.languages)))
        for b, worth in enumerate(self.worth):
            loss += worth * np.logaddexp(0.0, -scaled[:, b : b + 1] * self.code[None, :, b])
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(loss))
        best, second = loss[rows, order[:, 0]], loss[rows, order[:, 1]]
        score = 1.0 / np.exp(best[:, None] - loss).sum(axis=1)
        return order[:, 0], score, second - best < CLOSE

    def predict(self, column: pa.Array) -> pa.StructArray:
        langs: list[str] = []
        scores: list[float] = []
        unsure: list[bool] = []
        for _, raw, starts in blocks(column):
            n = len(starts) - 1
            letters = _has_letter(raw, starts)
            if len(self.languages) < 2:
                names = np.where(letters, self.languages[0] if self.languages else "und", "und")
                langs += names.tolist()
                scores += (letters & bool(self.languages)).astype(float).tolist()
                unsure += [False] * n
                continue
            bucket, text = grams(raw, starts)
            counts = np.bincount(text, minlength=n)
            margins = np.zeros((n, len(self.weights)))
            for b, w in enumerate(self.weights):
                margins[:, b] = np.bincount(text, weights=w[bucket], minlength=n) / np.maximum(counts, 1)
            number, score, close = self.decide(margins, counts)
            names = np.array(self.languages, dtype=object)[number]
            langs += np.where(letters, names, "und").tolist()
            scores += np.where(letters, score, 0.0).tolist()
            unsure += (letters & close).tolist()
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
            ["lang", "score", "ambiguous"],
        )


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _has_letter(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
    out = sums[starts[1:]] > sums[starts[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in raw[starts[i] : starts[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def train(docs: DataFrame) -> Model:
    """Learn from (text, lang); callers leave out what is held out."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    summed = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for row in summed.collect():  # at most languages times buckets
        counts.setdefault(row["lang"], np.zeros(BUCKETS))[row["bucket"]] = row["n"]
    return Model(counts)


def identify(text: Column, model: Model) -> Column:
    """Struct (lang, score, ambiguous) of each text."""

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        return model.predict(texts)

    return judge(text)


def languages(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang) -> doc_id, held_out, lang_pred, score, ambiguous."""
    out = F.col("doc_id")
    model = train(docs.where(~held_out(out)))
    judged = docs.select("doc_id", held_out(out).alias("held_out"), identify(F.col("text"), model).alias("_l"))
    return judged.select(
        "doc_id",
        "held_out",
        F.col("_l.lang").alias("lang_pred"),
        F.col("_l.score").alias("score"),
        F.col("_l.ambiguous").alias("ambiguous"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is known: neither ``und`` nor ambiguous."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    judged = docs.withColumn("_l", identify(F.col("text"), model))
    return judged.where("_l.lang <> 'und' and not _l.ambiguous").drop("_l")
