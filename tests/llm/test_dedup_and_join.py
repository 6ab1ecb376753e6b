"""Exact and near copies against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import components, exact_dedup, ngram_join, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, digest string, _id long, root string"


def frame(spark, texts, ids=None):
    """Documents with more columns, whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, "x", 3, "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.sampled_from("aaaabbbcdefgh"), max_size=200), st.integers(1, 6), st.integers(1, 50))
def test_misra_gries_bounds(items, counters, size):
    held = exact_dedup.misra_gries((items[i : i + size] for i in range(0, len(items), size)), counters)
    assert len(held) <= counters
    for x, n in Counter(items).items():
        assert n - len(items) / (counters + 1) <= held.get(x, 0) <= n


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("counters", [4, 16, 4096])
def test_exact_groups(spark, counters):
    random.seed(counters)
    texts = ["hot"] * 200 + ["warm "] * 40 + [random.choice(["a", "b", "A", "é", "", " ", None, "x" * 70000]) for _ in range(60)] + [f"own {i}" for i in range(30)]
    rows = list(enumerate(texts))
    df = frame(spark, texts).repartition(5)
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(df, counters=counters).collect())
    assert got == brute_exact(rows)
    kept = exact_dedup.drop_exact_copies(df, counters=counters)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [g[0] for g in got if g[3]]


def test_exact_groups_of_nothing_and_of_repeated_rows(spark):
    assert exact_dedup.exact_groups(frame(spark, ["a"]).limit(0)).collect() == []
    got = exact_dedup.exact_groups(frame(spark, ["a", "a", "a"], [1, 1, None])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in got) == [(False, 1, 3, True), (False, 1, 3, True), (True, 1, 3, False)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: words_set(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


TEXTS = st.lists(st.sampled_from(["a", "b", "A", "é", " ", "\n", "\x0b", "\x85", "ab", "  ", "ß", "\u2003"]), max_size=40).map("".join)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=8))
def test_shingle_sets(texts):
    got = list(shingles.shingle_sets(pa.array(texts, pa.string())))
    expected = [words_set(t) for t in texts]
    assert [len(g) for g in got] == [len(e) for e in expected]
    for a, x in zip(got, expected, strict=True):
        for b, y in zip(got, expected, strict=True):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_shingles_of_pieces_are_those_of_the_whole(monkeypatch):
    random.seed(4)
    texts = [" ".join(random.choice(["aa", "b" * 40, "c", "dé"]) for _ in range(n)) for n in (0, 1, 4, 5, 6, 300, 50, 2)]
    whole = [x.tolist() for x in shingles.shingle_sets(pa.array(texts))]
    monkeypatch.setattr(shingles, "PIECE", 64)
    monkeypatch.setattr(shingles, "GROUP", 200)
    assert [x.tolist() for x in shingles.shingle_sets(pa.array(texts))] == whole
    assert [x.tolist() for x in shingles.shingle_sets(pa.array(["x", *texts, "y"]).slice(1, len(texts)))] == whole


def families(seed):
    """Families of near copies with few and many changed words, some at the threshold, passages in common, short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    shared = [word() for _ in range(30)]
    texts = [None, "", "  ", "one", "One", "two words", "a b c d", "A B C D", "a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(20, 120))] + (shared if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: len(copy) - r.choice([0, 0, 0, 3, 20])]))
    texts += [" ".join(shared)] * 3
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    texts = families(seed)
    df = frame(spark, texts).repartition(3)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(df).collect())
    assert got == brute_components(list(enumerate(texts)))
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({g[2] for g in got})


def test_components_with_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SPARE", -4)  # nearly every shingle looks shared
    monkeypatch.setattr(ngram_join, "RUN", 300)
    texts = families(9)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(frame(spark, texts)).collect())
    assert got == brute_components(list(enumerate(texts)))


def test_one_large_group(spark):
    r = random.Random(0)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(80)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = sorted(tuple(x) for x in ngram_join.jaccard_components(frame(spark, texts)).collect())
    assert got == brute_components(list(enumerate(texts)))


def test_components_of_nothing_and_null_ids(spark):
    assert ngram_join.jaccard_components(frame(spark, ["a"]).limit(0)).collect() == []
    got = ngram_join.jaccard_components(frame(spark, ["a b", "a b", "a b", None], [5, 3, None, 4])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 1, 0), (3, 1, 3), (4, 0, 4), (5, 1, 3)]


def test_smallest_labels_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.smallest_labels(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


def test_smallest_labels_of_a_component_with_most_nodes(spark, monkeypatch):
    """90 of 100 nodes are in one component, as a tree and as a star: its root's key is hot in every round, and is dealt."""
    from quillon.llm import scratch

    monkeypatch.setattr(scratch, "HOT_ROWS", 8)
    dealt = []
    monkeypatch.setattr(components, "hot_keys", lambda rows, key, name: dealt.append((key, scratch.hot_keys(rows, key, name))) or dealt[-1][1])
    tree = [(k, k // 2) for k in range(1, 60)] + [(k, 3) for k in range(60, 90)]
    links = spark.createDataFrame(tree + [(k, k + 1) for k in range(90, 99)], "u long, v long")
    got = {r.node: r.root for r in components.smallest_labels(links).collect()}
    assert got == {k: 0 if k < 90 else 90 for k in range(100)}
    assert any(key == "mid" and hot is not None for key, hot in dealt)


def test_many_copies_of_a_text_are_dealt(spark, monkeypatch):
    from quillon.llm import scratch

    monkeypatch.setattr(scratch, "HOT_ROWS", 5)
    texts = ["a b c d e f", "x y"] * 20 + ["", None, "a b c d e f g"] * 7 + ["alone here"]
    ids = [None if k % 11 == 0 else k for k in range(len(texts))]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.jaccard_components(frame(spark, texts, ids)).collect())
    known = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None]
    nulls = [(-1, len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if (w := (t or "").split()) else 0, -1) for i, t in zip(ids, texts, strict=True) if i is None]
    assert got == sorted(brute_components(known) + nulls)


@pytest.mark.parametrize("order", ngram_join.ORDERS)
def test_each_order_alone_loses_no_link(order):
    """Prefixes under one order: sets that link share a shingle in them, and no more than the lesser rest."""
    sets = [one for seed in range(6) for one in shingles.shingle_sets(pa.array(families(10 * order + seed))) if len(one)]
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    classes = [np.where((n := counts[np.searchsorted(every, one)]) > 1, np.minimum(255, 8 * np.log2(n)), 0).astype(np.uint8) for one in sets]
    prefixes = [dict(zip(*(x.tolist() for x in ngram_join.prefix(one[c > 0], c[c > 0], len(one), order)), strict=True)) for one, c in zip(sets, classes, strict=True)]
    found = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if ngram_join.links(a, len(a), b, len(b)) and a.tobytes() != b.tobytes():
                found += 1
                both = prefixes[i].keys() & prefixes[j].keys()
                assert both and len(np.intersect1d(a, b)) <= max(min(prefixes[i][t], prefixes[j][t]) for t in both)
    assert found > 20


def test_filters_leave_out_pairs_before_sets_are_fetched(spark, monkeypatch):
    """Pairs of ids go on only if prefixes meet under every order; the sets of others aren't fetched."""
    rows = [(1, [1, 2], [5], b"a"), (2, [2, 3], [5], b"b"), (3, [9], [5], b"c"), (4, [2], [7], b"d")]
    nodes = spark.createDataFrame(rows, "node long, p2 array<long>, p3 array<long>, set binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4)], "u long, v long")
    assert [tuple(r) for r in ngram_join.meeting(pairs, nodes).collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in ngram_join.meeting(pairs, nodes, (2,)).collect()) == [(1, 2), (1, 4), (2, 4)]


@pytest.mark.parametrize("small", [False, True])
def test_one_shingle_in_many_unrelated_texts(spark, monkeypatch, small):
    """Passages that very many texts share are all there is in them, and few texts link: every token is hot."""
    from quillon.llm import scratch

    if small:  # everything is hot, split and dealt into blocks
        monkeypatch.setattr(scratch, "HOT_ROWS", 3)
        monkeypatch.setattr(ngram_join, "HOT_ROWS", 3)
        monkeypatch.setattr(ngram_join, "RUN", 2000)
    r = random.Random(7)
    passages = [" ".join(f"p{k}x{i}" for i in range(r.randint(8, 12))) for k in range(10)]
    texts = []
    for _ in range(300 if small else 1200):
        own = r.sample(passages, 4)
        texts += [" ".join(own)] + [" ".join([*own, "end"])] * (r.random() < 0.2)
    got = sorted(tuple(x) for x in ngram_join.jaccard_components(frame(spark, texts).repartition(4)).collect())
    assert got == brute_components(list(enumerate(texts))) and len({g[2] for g in got}) > 10


def test_keys_are_counted_over_all_runs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RUN", 400)
    texts = families(5)
    runs = ngram_join.runs_of(frame(spark, texts).select("doc_id", "text").repartition(3)).cache()
    got = {r.run: np.frombuffer(b"".join(map(ngram_join.zstandard.ZstdDecompressor().decompress, r.classes)), np.uint8) for r in ngram_join.answers(runs, 40, 5).collect()}
    held = {r.run: ngram_join.Sets(pa.array(r.texts, pa.string()), 40) for r in runs.collect()}
    within = Counter()
    for own in held.values():
        within.update((own.hashes() >> own.shift).tolist())
    assert len(held) > 10
    for run, own in held.items():
        keys = own.counted()[0].tolist()
        if keys:
            assert got[run].tolist() == [int(min(255, 8 * np.log2(within[k]))) if within[k] > 1 else 0 for k in keys]
    runs.unpersist()


def test_joined_rows_of_hot_keys_are_the_same(spark, monkeypatch):
    from quillon.llm import scratch

    monkeypatch.setattr(scratch, "HOT_ROWS", 4)
    rows = scratch.keep(spark.range(300).selectExpr("if(id % 3 = 0, 7, id % 40) as k", "id"), "rows")
    table = spark.range(40).selectExpr("id as k", "id * 10 as x")
    hot = scratch.hot_keys(rows, "k", "hot")
    assert hot.count() > 1
    assert sorted(tuple(r) for r in scratch.salted_join(rows, table, "k", "id", hot).collect()) == sorted((r.k, r.id, r.k * 10) for r in rows.collect())
