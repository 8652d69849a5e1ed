"""The pipeline's stages against plain versions, and the registered queries."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ticklake import llm


def test_stages(spark, sf, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns, name
        rows = {(r.doc_id, r.text) for r in docs.collect()}
        kept = out.collect()
        assert {(r.doc_id, r.text) for r in kept} <= rows and len(kept) >= 0.9 * len(rows)
        docs = spark.createDataFrame(kept, documents.schema)


def test_run(spark, sf, documents):
    out = corpus_pipeline.run(spark, sf).collect()
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        assert sum(n for _, n in parts) <= 1024
    assert {r.doc_id for r in out} <= {r.doc_id for r in documents.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect())) == sorted(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out
    )


def test_run_row_by_row(spark, sf, documents):
    """All stages in plain Python, but for the language model and the plan of the mix, whose own tests are elsewhere."""
    from ticklake.llm import langid, mixing

    rows = {r.doc_id: r for r in documents.collect()}
    assert len(rows) == documents.count()
    told = langid.languages(documents).collect()
    kept = sorted(r.doc_id for r in told if r.lang_pred != "und" and not r.ambiguous)
    first = {}
    for doc in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[doc].text or ""), doc)
    kept = sorted(first.values())
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    sets = {}
    for doc in kept:
        held = split(re.sub("[A-Z]", lambda m: m[0].lower(), rows[doc].text or ""))
        sets[doc] = {tuple(held[i : i + 5]) for i in range(max(len(held) - 4, min(len(held), 1)))}
    root = {doc: doc for doc in kept}
    for doc in kept:
        for other in kept:
            if other < doc and root[doc] != root[other] and 5 * len(sets[doc] & sets[other]) >= 4 * len(sets[doc] | sets[other]) > 0:
                low, high = sorted((root[doc], root[other]))
                root = {d: low if r == high else r for d, r in root.items()}
    kept = [d for d in kept if root[d] == d]
    left = spark.createDataFrame([rows[d] for d in kept], documents.schema)
    times = {r.doc_id: r.times for r in mixing.plan(mixing.sizes(left)).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc in kept:
        ids = [*library.encode(rows[doc].text or "", add_special_tokens=False).ids, 2]
        want += [(doc, crc) for crc in pieces(ids)] * times[doc]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, (r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 1024


def pieces(ids, size=1024):
    """(piece, start, length, crc) of a document's ids; the first piece is the short one."""
    head = len(ids) % size or min(size, len(ids))
    edges = [0, *range(head, len(ids) + 1, size)]
    return [
        (i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]


def test_near_duplicates_link_five_words_from_four_fifths_on(spark, sf, documents, make_docs):
    words = [f"w{i}" for i in range(100)]
    two = ["x" if i in (30, 70) else w for i, w in enumerate(words)]  # 0.811 by five words, 0.848 by four
    three = ["y" if i in (20, 50, 80) else w for i, w in enumerate(words)]  # 0.730 by five words
    made = make_docs([(i, " ".join(w), "en", "a") for i, w in enumerate((words, two, three))])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, made, sf).collect()) == [0, 2]

    texts = sorted((r.doc_id, r.text) for r in corpus_pipeline.exact_duplicates(spark, documents, sf).collect())
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    sets = []
    for _, text in texts:
        held = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(held[i : i + 5]) for i in range(max(len(held) - 4, min(len(held), 1)))})
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]) > 0:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = [doc for k, (doc, _) in enumerate(texts) if root[k] == k]
    unique = spark.createDataFrame([r for r in documents.collect() if (r.doc_id, r.text) in set(texts)], documents.schema)
    unique = corpus_pipeline.exact_duplicates(spark, unique, sf)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, unique, sf).collect()) == want


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_rows(spark, sf, odd_docs, no_docs, stage):
    assert stage[1](spark, no_docs, sf).count() == 0
    out = stage[1](spark, odd_docs, sf)
    assert out.count() > 0
    if stage[0] != "pack":
        assert out.columns == odd_docs.columns


def test_every_operator_has_a_query():
    names = llm.load()[0]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14))
