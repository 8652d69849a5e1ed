"""Exact duplicates and the n-gram Jaccard join against plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticklake.llm import components, exact_dedup, ngram_join
from ticklake.llm.textblocks import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_exact(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = defaultdict(list)
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            want[(i, sha)].append((min(known) if known else None, len(ids)))
    got, kept = defaultdict(list), defaultdict(int)
    for r in exact_dedup.duplicates(docs, **options).collect():
        got[(r.doc_id, r.text_sha256)].append((r.keep_id, r.group_size))
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text_sha256] += 1
    assert got == want
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)


def test_exact_odd_rows(odd_docs):
    check_exact(odd_docs)


def test_exact_splits_buckets_and_chains_collisions(odd_docs, documents):
    check_exact(documents.limit(150).cache(), page_keys=4)
    # every text of one length has the same key: chains are told apart by their bytes
    check_exact(odd_docs, page_keys=2, key=lambda text: F.length(text).cast("long"))


def test_owners_decide(spark, documents, monkeypatch):
    # the chains come out of the range partitions of the directory's places, without another exchange
    plans, real = [], exact_dedup.cut

    def watched(df, label="cut"):
        if label == "chains":
            plans.append((df._jdf.queryExecution().executedPlan().toString(), df.withColumn("p", F.spark_partition_id()).collect()))
        return real(df, label)

    monkeypatch.setattr(exact_dedup, "cut", watched)
    exact_dedup.duplicates(documents, page_keys=8).count()
    plan, rows = plans[0]
    owners = plan[: plan.index("rangepartitioning(place")]
    assert "hashpartitioning" not in owners and owners.count("Exchange") == 1
    # an owner's keys are a range of the unsigned order that the directory's prefixes follow
    ranges = {}
    for r in rows:
        ranges.setdefault(r.p, []).append(r.key % (1 << 64))
    spans = sorted((min(k), max(k)) for k in ranges.values())
    assert len(rows) >= 10 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_exact_empty(no_docs):
    assert exact_dedup.duplicates(no_docs).count() == 0
    assert exact_dedup.unique(no_docs).count() == 0


def test_unique_keeps_columns_and_one_row_each(odd_docs):
    out = exact_dedup.unique(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [norm(r.text) for r in out.collect()]
    assert sorted(texts) == sorted({norm(r.text) for r in odd_docs.collect()})


def test_directory_pages(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    cells, bits = exact_dedup.directory(keys, page_keys=100)
    held = keys.withColumn("cell", exact_dedup.prefix(F.col("key"), bits)).join(cells, "cell")
    sizes = held.groupBy("depth", "bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) <= 100
    # buckets are disjoint prefixes: no bucket's prefix begins another's
    prefixes = [format(r.bucket, "b").zfill(r.depth) for r in sizes]
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)


def shingle_set(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def check_join(docs, similarity=85, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for members in holders.values():
        for i in members:
            for j in members:
                if i < j and find(i) != find(j):
                    both = len(sets[i] & sets[j])
                    if 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                        parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            root = find(i)
            smallest[root] = min(doc, smallest.get(root, doc))
    want = sorted(((d, len(sets[i]), smallest.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)
    got = ngram_join.join(docs, similarity=similarity, **options).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_join_odd_rows(odd_docs):
    check_join(odd_docs)


def test_join_documents(documents):
    check_join(documents)


def test_join_empty(no_docs):
    assert ngram_join.join(no_docs).count() == 0
    assert ngram_join.representatives(no_docs).count() == 0


@pytest.mark.parametrize("tile", [3, 512])
def test_join_chains_and_families(make_docs, monkeypatch, tile):
    # families in which neighbours link but far members do not, sharing common passages
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for family in range(4):
        words = [f"f{family}w{i}" for i in range(110)] + common
        for step in range(12):
            words = list(words)
            words[int(rng.integers(0, 110))] = f"n{family}s{step}"
            rows.append((family * 100 + 50 - step, " ".join(words), "en", "a"))
    rows += [(1000 + i, " ".join(common + [f"own{i}v{j}" for j in range(3)]), "en", "a") for i in range(12)]
    check_join(make_docs(rows))
    check_join(make_docs(rows), similarity=70)


def check_links(docs, similarity=85):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = [shingle_set(t) for _, t in rows]
    first, counts, pairs = {}, defaultdict(int), set()
    for (doc, _), s in zip(rows, sets):
        first[s] = min((x for x in (first.get(s), doc) if x is not None), default=None)
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= similarity * (len(x) + len(sets[j]) - both):
                counts[i] += 1
                counts[j] += 1
                if x != sets[j]:
                    pairs.add(tuple(sorted((first[x], first[sets[j]]), key=lambda d: (d is not None, d or 0))))
    want = sorted(((doc, len(sets[i]), counts[i]) for i, (doc, _) in enumerate(rows)), key=str)
    got = ngram_join.join(docs, similarity=similarity).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=str) == want
    found = [tuple(r) for r in ngram_join.links(docs, similarity=similarity).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    return len(pairs)


@pytest.mark.parametrize(("tile", "block"), [(4, 16), (512, 4096)])
def test_every_link_of_a_family(make_docs, monkeypatch, tile, block):
    # 25 near copies, nearly all linked with each other, three of them twice, and a chain
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(["x" if k == 6 * i else w for k, w in enumerate(base)]), "en", "a") for i in range(25)]
    rows += [(100 + i, rows[i][1].upper(), "en", "a") for i in range(3)] + [(None, "one two three", "en", "a")]
    rows += [(200 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 100)), "en", "a") for i in range(12)]
    assert check_links(make_docs(rows)) > 300


def test_tiles_meet_only_where_sizes_allow_links(make_docs, monkeypatch):
    # one component of ever longer texts: near ones link, the first and the last are far apart in size
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rows = [(i, " ".join(f"w{j}" for j in range(60 + 4 * i)), "en", "a") for i in range(120)]
    docs = make_docs(rows + rows[::10])
    assert check_links(docs) > 500
    assert {r.component_id for r in ngram_join.join(docs).collect()} == {0}
    held = ngram_join._linked(docs, 4, 85, None)
    met = ngram_join._meetings(*held, 85).select("low", "high", "rows.n", "rows.tile").collect()
    assert len({(m.low, m.high) for m in met}) == len(met)
    tiles = len({t for m in met for t in m.tile})
    assert tiles >= 15 and len(met) < tiles * (tiles + 1) / 4
    assert all(max(m.n) * 85 * 85 <= min(m.n) * 100.2**2 for m in met)


def test_links_of_odd_rows(odd_docs):
    check_links(odd_docs)


def test_representatives(odd_docs):
    out = ngram_join.representatives(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {0, 8, -7, 10} <= set(ids) and not {9, 11, 12} & set(ids)


def test_ngrams_are_the_same_in_any_block():
    texts = ["A b c D e f", "", "x y", None, "a b c d e f g a b c d", "\t\n", "a  b\nc d"]
    whole = {}
    for first, raw, starts in blocks(pa.array(texts)):
        grams, edges = ngram_join.ngrams(raw, starts)
        for i in range(len(starts) - 1):
            whole[first + i] = set(grams[edges[i] : edges[i + 1]].tolist())
    assert [len(whole[i]) for i in range(len(texts))] == [len(shingle_set(t)) for t in texts]
    for first, raw, starts in blocks(pa.array(texts), limit=1):
        grams, edges = ngram_join.ngrams(raw, starts)
        assert set(grams.tolist()) == whole[first]
    assert whole[0] < whole[4] and whole[6] <= whole[0]


@pytest.mark.parametrize("swap", [False, True])
def test_words_that_polynomial_hashes_mix_up(make_docs, swap):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = ["w" * 8 + word, "w" * 8 + word.translate(str.maketrans("ab", "ba"))]
    two = two[::-1] if swap else two
    for _, raw, starts in blocks(pa.array([f"{w} tail" for w in two])):
        grams, edges = ngram_join.ngrams(raw, starts)
        assert grams[edges[0]] != grams[edges[1]]
    docs = make_docs([(i, " ".join([w] * 3 + ["x"] * i), "en", "a") for i, w in enumerate(two * 2)])
    check_join(docs)


@pytest.mark.parametrize("words,similarity", [(5, 80), (4, 85), (3, 50), (4, 100)])
def test_the_first_block_follows_the_similarity(documents, words, similarity):
    part = ngram_join.first_part(similarity)
    assert 1.4 * (100 - similarity) / 100 <= part <= 1
    rows = documents.select("doc_id", "text").mapInArrow(ngram_join._rows(words), "doc_id long, n long, cls binary").cache()
    few = ngram_join._survivors(documents, rows, words, similarity, part).count()
    assert few < 0.5 * rows.select("cls").distinct().count()


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
