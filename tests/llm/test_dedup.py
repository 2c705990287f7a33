"""SimHash, near-duplicate removal and substring removal against brute force."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.llm import components as component_search, neardup, simhash, substring
from quillspark.llm.bytespans import Rolling, Words, xxh64_spans
from quillspark.llm.components import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 2**64 - 1))
def test_vectorised_hash_is_xxh64(data, seed):
    assert int(xxh64_spans(data, np.array([0]), np.array([len(data)]), seed)[0]) == xxhash.xxh64_intdigest(data, seed)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB é\t\n", max_size=30), max_size=6), st.integers(1, 5))
def test_shingles(texts, k):
    got, first = Words([t.encode() for t in texts], lower=True).shingles(k)
    for d, t in enumerate(texts):
        w = [x for x in SPLIT.findall("".join(c.lower() if c.isascii() else c for c in t))]
        want = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        assert [int(h) for h in got[first[d] : first[d + 1]]] == [xxhash.xxh64_intdigest(s.encode(), 42) for s in want]


def brute_print(text):
    w = SPLIT.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("parts", [2, 3])
def test_anchors_cover_the_threshold(parts):
    rng = random.Random(parts)
    for _ in range(40):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        sets = [{(f, int(a)) for f, _, at in simhash.anchors(np.array([v], np.uint64), parts, 4) for a in at} for v in (x, y)]
        assert sets[0] & sets[1]


def corpus():
    rng = random.Random(1)
    words = ["w%d" % i for i in range(500)]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    base = [rng.choice(words) for _ in range(80)]
    for _ in range(25):
        copy = list(base)
        copy[rng.randrange(80)] = rng.choice(words)
        docs.append(" ".join(copy))
    docs += [docs[0]] * 4 + ["", None, "  \n", "One two", "one  TWO"]
    return list(enumerate(docs))


def find_roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_simhash_components(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = corpus()
    prints = [brute_print(t) for _, t in rows]
    n = len(rows)
    roots = find_roots(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, fp string, anchor long").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == n
    for i in range(n):
        assert got[i].fp % 2**64 == prints[i] and got[i].component_id == roots[i]


def jaccard(a, b, k=5):
    def sets(t):
        w = SPLIT.findall((t or "").lower())
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = sets(a), sets(b)
    return 1.0 if x == y else len(x & y) / len(x | y)


@pytest.mark.parametrize("tile", [neardup.CHECK_TILE, 6])
def test_keep_one_of_each_group(spark, monkeypatch, tmp_path, tile):
    monkeypatch.setattr(neardup, "CHECK_TILE", tile)
    rows = corpus()
    n = len(rows)
    roots = find_roots(n, [(i, j) for i in range(n) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8])
    stored = str(tmp_path / f"docs{tile}")
    spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, root string, node long").write.parquet(stored)
    docs = spark.read.parquet(stored)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(roots)


def brute_roots(texts, least=0.8, k=5):
    """The root of each text by comparing all texts that share a shingle."""
    sets = []
    for t in texts:
        w = SPLIT.findall((t or "").lower())
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    first, where = {}, collections.defaultdict(list)
    pairs = []
    for i, x in enumerate(sets):
        if x in first:
            pairs.append((first[x], i))
            continue
        first[x] = i
        both = collections.Counter(j for g in x for j in where[g])
        pairs += [(j, i) for j, n in both.items() if n >= least * (len(x) + len(sets[j]) - n) - 1e-9]
        for g in x:
            where[g].append(i)
    return find_roots(len(texts), pairs)


def test_families_where_the_least_member_is_unlike_others(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(neardup, "CHECK_TILE", 7)
    rng = random.Random(12)
    texts = []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 300))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    roots = brute_roots(texts)
    assert len({r for r in roots}) > 15  # families fall apart, so links with one member don't decide
    assert kept_ids(spark, tmp_path / "d", texts) == set(roots)


def test_kept_documents_equal_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots = brute_roots([t for _, t in rows])
    assert {r.doc_id for r in neardup.keep_one(docs).select("doc_id").collect()} == {rows[k][0] for k in set(roots)}


def kept_ids(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path))
    return {r.doc_id for r in neardup.keep_one(spark.read.parquet(str(path))).collect()}


def test_a_hot_line_makes_no_duplicates(spark, tmp_path):
    rng = random.Random(5)
    line = " ".join(f"hot{i}" for i in range(13))
    texts = [" ".join([line] * 40 + [f"b{rng.randrange(10**6)}" for _ in range(100)]) for _ in range(20)]
    assert all(jaccard(texts[0], t) < 0.3 for t in texts[1:])
    assert kept_ids(spark, tmp_path / "d", texts) == set(range(20))


def test_repeats_inside_a_text_hide_no_copy(spark, tmp_path):
    rng = random.Random(6)
    texts = []
    for k in range(40):
        base = [f"r{rng.randrange(10**6)}" for _ in range(104)]
        texts += [" ".join(base), " ".join(base + base[:14] * 20)]
    assert min(jaccard(a, b) for a, b in zip(texts[::2], texts[1::2])) >= 0.8
    assert kept_ids(spark, tmp_path / "d", texts) == set(range(0, 80, 2))


def test_pairs_at_the_threshold(spark, tmp_path):
    rng = random.Random(7)
    texts = []
    for n in [9] * 150 + [19] * 50 + [94] * 150:
        base = [f"s{rng.randrange(10**7)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base[: n - (n - 4) // 5])]
    assert all(abs(jaccard(a, b) - 0.8) < 1e-9 for a, b in zip(texts[::2], texts[1::2]))
    assert kept_ids(spark, tmp_path / "d", texts) == set(range(0, 700, 2))


def test_near_duplicate_edge_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(r.doc_id for r in neardup.keep_one(stored).collect()) == [7, 8]
    assert simhash.near_duplicates(stored).count() == 4
    empty = stored.filter("false")
    assert simhash.near_duplicates(empty).count() == neardup.keep_one(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rounds_over_a_long_path_stay_alike(spark):
    n = 700  # some ten rounds; what plans infer from one round must not grow in the next
    edges = [(i, i + 1) for i in range(n)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert got == {i: 0 for i in range(n + 1)}


def brute_cut(texts, window):
    words = [SPLIT.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window,paths,bits", [(35, 2048, 64), (12, 2, 64), (5, 3, 64), (35, 2048, 3), (12, 2, 1)])
def test_substring_removal(spark, monkeypatch, window, paths, bits):
    monkeypatch.setattr(substring, "PATHS_A_TASK", paths)
    rng = random.Random(window)
    words = ["v%d" % i for i in range(300)]
    passage = [rng.choice(words) for _ in range(70)]
    texts = [None, "", "x", "same " * 90, " ".join(passage)]
    for _ in range(40):
        w = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        at, a = rng.randint(0, len(w)), rng.randint(0, 30)
        texts.append(" ".join(w[:at] + passage[a : a + rng.randint(window, 70)] + w[at:]))
    texts += texts[5:8]
    docs = spark.createDataFrame([(i % 40, t, i) for i, t in enumerate(texts)], "doc_id long, text string, first int").repartition(3)
    got = {r["first"]: r for r in substring.remove_repeats(docs, window, joined=True, bits=bits).collect()}
    for i, (n, removed, kept) in enumerate(brute_cut(texts, window)):
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (n, removed, kept)
    assert substring.remove_repeats(docs.filter("false"), window).count() == 0


def test_compacted_paths():
    path = lambda first, n, left, right: {"first": first, "n": n, "left": left, "right": right}
    paths = [path(9, 4, True, False), path(0, 5, False, True), path(5, 4, True, True), path(13, 2, True, True), path(20, 3, True, True)]
    assert substring.compacted(paths) == [(0, 13), (13, 2), (20, 3)]


def test_rows_in_another_order_at_each_reading(spark):
    rng = random.Random(9)
    passage = " ".join(f"q{i}" for i in range(40))
    rows = [(i, " ".join([f"z{rng.randrange(10**6)}" for _ in range(50)] + [passage] * (i % 3 == 0))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)  # dealt round robin
    shaken = docs.orderBy(F.rand())  # no seed: every evaluation of the plan deals the rows anew
    got = {r.doc_id: r for r in substring.remove_repeats(shaken, 35, joined=True).collect()}
    for (i, t), (n, removed, kept) in zip(rows, brute_cut([t for _, t in rows], 35)):
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (n, removed, kept)


def test_columns_of_any_kind_are_carried(spark):
    rows = [(1, "a b c", {"x": 1}, [1], (2, "y")), (1, "a b c", {"x": 1}, [1], (2, "y")), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, a array<int>, s struct<p:int,q:string>")
    got = substring.remove_repeats(docs, 2).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in got) == [(0, "", 0), (1, "", 3), (1, "", 3)]


def test_a_very_long_text(spark):
    rng = random.Random(4)
    words = [f"l{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[20_000:50_000])), (3, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs, 35).collect()}
    assert got == {1: (60_000, 30_000), 2: (30_000, 30_000), 3: (50_000, 50_000)}
    assert simhash.near_duplicates(docs).count() == 3 and neardup.keep_one(docs).count() == 3


def test_cut_keeps_layout(spark):
    passage = " ".join(f"p{i}" for i in range(6))
    docs = spark.createDataFrame([(1, f"a\n b  {passage}\nend  x"), (2, f"{passage}\n\nq"), (3, passage)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in substring.remove_repeats(docs, 6).collect()}
    assert got == {1: "a\n b  end  x", 2: "q", 3: ""}


def test_rolling_hashes_follow_content():
    w = np.array([5, 9, 7, 5, 9, 7], np.uint64)
    r = Rolling(w)
    a = r.windows(np.array([0, 3, 1]), np.array([3, 3, 3]))
    assert a[0] == a[1] != a[2]


@pytest.mark.parametrize("chunk", [1, 250_000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(component_search, "CHUNK", chunk)
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    roots = find_roots(60, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: roots[x] for p in pairs if p[0] != p[1] for x in p}


def test_few_links_need_no_rounds(spark, monkeypatch):
    def no_round(edges):
        raise AssertionError("a round")

    monkeypatch.setattr(component_search, "_large_star", no_round)
    assert components(spark.createDataFrame([(k, k + 1) for k in range(50)], "u long, v long")).filter("root = 0").count() == 51


def test_large_components_read_rows_a_few_times(spark, monkeypatch, tmp_path):
    """A group of near copies over many tiles: rows that are compared grow with its size, not with its square."""
    monkeypatch.setattr(neardup, "CHECK_TILE", 10)
    rng = random.Random(9)
    base = [f"g{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(200):
        w = list(base)
        w[rng.randrange(200)] = f"x{k}"
        texts.append(" ".join(w))
    met = []
    linked = neardup._linked
    monkeypatch.setattr(neardup, "_linked", lambda rows, *rest: (met.append(rows.count()), linked(rows, *rest))[1])
    assert kept_ids(spark, tmp_path / "d", texts) == set(brute_roots(texts))
    assert sum(met) <= 3 * len(texts)


def test_near_duplicates_come_through_operator_5(spark, monkeypatch, tmp_path):
    """Without MinHash keys, what SimHash links is still found and checked."""
    monkeypatch.setattr(neardup, "band_keys", lambda sets: np.arange(len(sets) * neardup.BANDS, dtype=np.uint64).reshape(-1, neardup.BANDS) + np.uint64(hash(b"".join(sets)) % 2**60))
    rng = random.Random(10)
    base = [f"o{rng.randrange(10**6)}" for _ in range(900)]
    texts = [" ".join(base), " ".join([*base, "last"]), " ".join(f"p{rng.randrange(10**6)}" for _ in range(900))]
    assert kept_ids(spark, tmp_path / "d", texts) == {0, 2}
