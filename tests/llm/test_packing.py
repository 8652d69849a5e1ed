"""Tokenizing, codes and packing: exact round trips against the library and plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ticklake.llm import dac, packing
from ticklake.llm.textblocks import blocks
from ticklake.llm.tokens import Encoder
from ticklake.session import scratch

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n=1500):
    rng = random.Random(1)
    alphabet = list("ab Z'sé\n\t 9.!?\x1c\x85　́漢\U0001f600\r\x0b 're")
    alphabet += ["  ", "   ", " \n ", "<|endoftext|>", "<|startoftext|>", " 's", "Word,", "éß.", "Ä&&&", "xÀÿ"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("path", "keeps_space"), [(WORDS, False), (BYTES, True)])
def test_ids_are_the_library_s(path, keeps_space, documents):
    tool = Encoder(path, keeps_space)
    texts = odd_texts() + [r.text for r in documents.select("text").collect()]
    seen = 0
    for first, raw, starts in blocks(pa.array([*texts, None, ""])):
        ids, edges = tool.encode(raw, starts)
        for i in range(len(starts) - 1):
            text = texts[first + i] if first + i < len(texts) else ""
            assert ids[edges[i] : edges[i + 1]].tolist() == tool.library.encode(text, add_special_tokens=False).ids
            seen += 1
    assert seen == len(texts) + 2


@pytest.mark.parametrize(("path", "keeps_space"), [(WORDS, False), (BYTES, True)])
def test_ids_are_those_of_an_unchanged_library(path, keeps_space):
    library, tool = Tokenizer.from_file(path), Encoder(path, keeps_space)
    special = ["a <|endoftext|> b", "<|endoftext|>", "x  <|startoftext|>\n<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>"]
    texts = [*special, "<|endof", "text|> ends", *odd_texts(), *special]
    for limit in (40, 1 << 20):
        seen = 0
        for first, raw, starts in blocks(pa.array(texts), limit=limit):
            ids, edges = tool.encode(raw, starts)
            for i in range(len(starts) - 1):
                want = library.encode(texts[first + i], add_special_tokens=False).ids
                assert ids[edges[i] : edges[i + 1]].tolist() == want
                seen += 1
        assert seen == len(texts)
    got = tool.encode(np.frombuffer(special[0].encode(), np.uint8), np.array([0, len(special[0])]))[0].tolist()
    assert (50256 if keeps_space else 49407) in got


def twins(letters="ab", n=1024):
    """Two different words of one start whose letters at even and odd places (Thue-Morse) are exchanged."""
    word = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return "w" * 8 + word, "w" * 8 + word.translate(str.maketrans(letters, letters[::-1]))


@pytest.mark.parametrize(("path", "keeps_space"), [(WORDS, False), (BYTES, True)])
@pytest.mark.parametrize("swap", [False, True])
def test_words_that_polynomial_hashes_mix_up(path, keeps_space, swap):
    one, two = reversed(twins()) if swap else twins()
    texts = [f"x {one} {two} {one}", f"{two} {one}", "x" * 16 + " " + "x" * 17, "a\0b a a\0", "\0 x \0\0 x"]
    library, tool = Tokenizer.from_file(path), Encoder(path, keeps_space)
    for _ in range(2):
        for first, raw, starts in blocks(pa.array(texts)):
            ids, edges = tool.encode(raw, starts)
            for i in range(len(starts) - 1):
                want = library.encode(texts[first + i], add_special_tokens=False).ids
                assert ids[edges[i] : edges[i + 1]].tolist() == want


def test_words_whose_cache_number_is_the_same(monkeypatch):
    # all words share one slot number: they are told apart by their bytes
    monkeypatch.setattr(Encoder, "_mixed", staticmethod(lambda low, high, tag: low & np.uint64(3)))
    tool, library = Encoder(BYTES, True), Tokenizer.from_file(BYTES)
    text = " ".join(f"{a}{b}" for a in "aeimquy" for b in ("", "x", "xyz", "longer"))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert tool.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_utf8():
    raw = np.frombuffer(b"good \xff\xfe word", np.uint8)
    for path, keeps_space in ((WORDS, False), (BYTES, True)):
        tool, library = Encoder(path, keeps_space), Tokenizer.from_file(path)
        want = library.encode("good \ufffd\ufffd word", add_special_tokens=False).ids
        assert tool.encode(raw, np.array([0, len(raw)]))[0].tolist() == want


def test_ids_when_the_cache_is_full(monkeypatch):
    from ticklake.llm import tokens

    monkeypatch.setattr(tokens, "FILLED", 50)
    tool = Encoder(BYTES, True)
    texts = odd_texts(300) + [" ".join(f"w{i}" for i in range(200))]
    for first, raw, starts in blocks(pa.array(texts), limit=200):
        ids, edges = tool.encode(raw, starts)
        for i in range(len(starts) - 1):
            assert ids[edges[i] : edges[i + 1]].tolist() == tool.library.encode(texts[first + i]).ids


@pytest.mark.parametrize("widths", [(8, 8, 16), (16, 16), (32,)])
def test_codes_round_trip_at_any_place(widths):
    rng = random.Random(2)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = [rng.choice([rng.randint(0, 255), rng.randint(0, 49407), rng.randint(0, 2**32 - 1)]) for _ in range(n)]
        codes = dac.Codes(dac.encode(np.array(ids, dtype=np.uint32), widths))
        assert len(codes) == n and codes.slice(0, n).tolist() == ids
        for _ in range(20):
            low = rng.randint(0, n)
            high = rng.randint(low, n)
            assert codes.slice(low, high).tolist() == ids[low:high]
            if n:
                assert codes[low % n] == ids[low % n]


def plain_ids(path, text, end):
    return [*Encoder(path, True).library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_files_of_codes(spark, odd_docs, odd_rows):
    path = scratch(spark, "dac-test")
    dac.write(odd_docs, path, WORDS, keeps_space=False, end_id=1, segment_tokens=50)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in dac.documents(spark, path).collect()]
    library = Encoder(WORDS, False).library
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for doc, text, _, _ in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_any_token_is_read_by_its_number(spark, odd_docs, odd_rows, monkeypatch):
    path = scratch(spark, "dac-test")
    dac.write(odd_docs.repartition(3), path, WORDS, keeps_space=False, end_id=1, segment_tokens=50)
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 64)  # segments and ranges of ids overlap in all ways
    library = Tokenizer.from_file(WORDS)
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = [i for _, text, _, _ in ordered for i in [*library.encode(text or "", add_special_tokens=False).ids, 1]]
    assert dac.segments(spark, path).count() > 3
    rng = random.Random(4)
    for asked in (list(range(120)), rng.sample(range(len(want)), 300) + [len(want) - 1], [0, 0, -1, len(want), 10**12]):
        for named in (500, 1):
            monkeypatch.setattr(dac, "NAMED", named)
            got = dac.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
            assert sorted((r.position, r.id) for r in got) == sorted({(p, want[p]) for p in asked if 0 <= p < len(want)})


def test_files_of_an_empty_table(spark, no_docs):
    path = scratch(spark, "dac-test")
    dac.write(no_docs, path, WORDS, keeps_space=False, end_id=1)
    assert dac.documents(spark, path).count() == 0


def check_packing(rows, docs, capacity):
    packed = packing.pack(docs, BYTES, True, 2, capacity, keep_ids=True).collect()
    places, texts = defaultdict(list), defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        texts[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in packed)
    assert -(-total // capacity) <= len(places)
    want = defaultdict(list)
    for doc, text, *_ in rows:
        ids = plain_ids(BYTES, text, 2)
        short = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(short, len(ids) + 1, capacity)]
        want[doc] += [
            (k, a, b - a, np.array(ids[a:b], dtype="<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    assert {d: sorted(x) for d, x in texts.items()} == {d: sorted(x) for d, x in want.items()}
    return len(places), total


def test_packing_odd_rows(odd_docs, odd_rows):
    check_packing(odd_rows, odd_docs, 16)


def test_packing_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    used, total = check_packing(rows, documents, 1024)
    assert used <= -(-total // 1024) + 1


def test_packing_empty(no_docs):
    assert packing.pack(no_docs, BYTES, True, 2).count() == 0


def test_sequences(spark, odd_docs):
    packed = packing.pack(odd_docs, BYTES, True, 2, 64, keep_ids=True).cache()
    lengths = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()}
    for r in packing.sequences(packed).collect():
        assert len(r.tokens) == 4 * lengths[r.sequence_id] <= 4 * 64


def fewest(lengths, capacity):
    """The optimum by trying everything; small cases only."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins.index(bins[k]) == k:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_plan_against_the_optimum():
    rng, exact, cases = random.Random(4), 0, 150
    for _ in range(cases):
        capacity = rng.choice([10, 17, 30])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        plan = packing.Plan(dict(counts), capacity)
        best = fewest(lengths, capacity)
        assert best <= plan.sequences <= best + 1
        exact += plan.sequences == best
        if plan.reduced == plan.sequences:  # all fixed by dominance: then it is the optimum
            assert plan.sequences == best
    assert exact >= 0.95 * cases


def test_plan_size_does_not_follow_the_input():
    few = packing.Plan({n: 3 + n % 7 for n in range(1, 1025)})
    many = packing.Plan({n: (3 + n % 7) * 1_000_000 for n in range(1, 1025)})
    assert len(many.runs) < 3 * len(few.runs) + 3000
