"""Error-correcting output codes: codewords, decoding, held-out accuracy, odd rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ticklake.llm import langid


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 4)
    assert len({tuple(c) for c in code.T}) == code.shape[1]
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_decoding_mends_a_wrong_bit():
    counts = {k: np.eye(4)[i].repeat(langid.BUCKETS // 4) * 1000 for i, k in enumerate("abcd")}
    model = langid.Model(counts)
    for i in range(4):
        for wrong in range(model.code.shape[1]):
            margins = model.code[i : i + 1].copy()
            margins[0, wrong] *= -0.3
            assert model.decide(margins, np.array([400]))[0][0] == i
    _, score, close = model.decide(np.zeros((1, model.code.shape[1])), np.array([0]))
    assert close[0] and score[0] == pytest.approx(0.25)


def test_grams_do_not_cross_texts_or_see_case():
    def bag(texts):
        out = [[] for _ in texts]
        for first, raw, starts in langid.blocks(pa.array(texts, pa.string())):
            bucket, text = langid.grams(raw, starts)
            for b, t in zip(bucket, text):
                out[first + t].append(int(b))
        return out

    texts = ["Straße Über Élan", "", "ab", "über, ÉLAN!", None, "x"]
    together = bag(texts)
    assert together == [bag([t])[0] for t in texts]
    assert bag(["ÜBER ÉLAN É"]) == bag(["über élan é"])


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 3 == 1


def test_documents(documents):
    truth = {r.doc_id: (r.lang, r.text) for r in documents.collect()}
    got = langid.languages(documents).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    hard = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in hard) >= 0.95 * len(hard)
    assert all(0 <= r.score <= 1 for r in got)
    # what is held out has no say: another lang there changes nothing
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    key = lambda r: (r.doc_id, r.lang_pred, r.score)
    assert sorted(map(key, langid.languages(other).collect())) == sorted(map(key, got))
    assert langid.accepted(documents).count() >= 0.99 * len(truth)


def plain_grams(text):
    """Bucket of each byte trigram around a letter, in plain Python."""
    raw = list((text or "").encode())
    for i, b in enumerate(raw):
        if 65 <= b <= 90 or (i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97):
            raw[i] = b + 32
    raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
    codes = [a << 16 | b << 8 | c for a, b, c in zip(raw, raw[1:], raw[2:]) if b != 32]
    return Counter(code * 2654435761 % 2**32 * langid.BUCKETS >> 32 for code in codes)


def plain_predictions(rows):
    """(doc_id, text, lang) -> [(lang, score, ambiguous)], learnt and decided in plain Python."""
    counts = {}
    for doc, text, lang in rows:
        if not held_out(doc) and lang is not None and plain_grams(text):
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    langs = sorted(counts)
    freq = {}
    for x in langs:
        total = sum(counts[x].values()) + 0.5 * langid.BUCKETS
        freq[x] = [(counts[x][b] + 0.5) / total for b in range(langid.BUCKETS)]
    bits = []
    for signs in itertools.product((1, -1), repeat=len(langs)):
        if signs[0] == 1 and -1 in signs:
            sides = {s: [x for x, t in zip(langs, signs) if t == s] for s in (1, -1)}
            mean = {s: [sum(freq[x][b] for x in side) / len(side) for b in range(langid.BUCKETS)] for s, side in sides.items()}
            weight = [math.log(p / q) for p, q in zip(mean[1], mean[-1])]
            own = [s * sum(f * w for f, w in zip(freq[x], weight)) for x, s in zip(langs, signs)]
            bits.append((signs, weight, max(min(own), 1e-3)))
    whole = sum(worth for _, _, worth in bits)
    out = []
    for _, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0, False))
            continue
        grams = plain_grams(text)
        n = sum(grams.values())
        loss = dict.fromkeys(langs, 0.0)
        for signs, weight, worth in bits:
            margin = sum(k * weight[b] for b, k in grams.items()) / max(n, 1) * math.sqrt(min(n, 400)) * 4
            for x, s in zip(langs, signs):
                loss[x] += worth / whole * (math.log1p(math.exp(-abs(s * margin))) + max(-s * margin, 0))
        best, second = sorted(loss.values())[:2]
        out.append((min(langs, key=loss.get), 1 / sum(math.exp(best - v) for v in loss.values()), second - best < 0.02))
    return out


def test_against_plain_python(documents, odd_docs):
    for frame in (documents, odd_docs):
        rows = [(r.doc_id, r.text, r.lang) for r in frame.select("doc_id", "text", "lang").collect()]
        wanted = Counter()
        for (doc, _, _), (lang, score, close) in zip(rows, plain_predictions(rows)):
            wanted[doc, held_out(doc), lang, round(score, 3), close] += 1
        got = langid.languages(frame).collect()
        assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 3), r.ambiguous) for r in got) == wanted


def test_odd_rows(odd_docs, odd_rows):
    got = langid.languages(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    for doc in (2, 3, 4, 7):
        assert (by_id[doc].lang_pred, by_id[doc].score) == ("und", 0.0)
    assert all(r.lang_pred in {"en", "de", "fr", "und"} for r in got)
    assert langid.accepted(odd_docs).columns == odd_docs.columns


def test_few_languages(make_docs, no_docs):
    assert langid.languages(no_docs).count() == 0
    one = langid.languages(make_docs([(i, f"word {i}", "en", "a") for i in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
    none = langid.languages(make_docs([(i, f"word {i}", None, "a") for i in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
