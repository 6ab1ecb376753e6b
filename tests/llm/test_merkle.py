"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(level, arity):
    """Digest of the root, and for each leaf its steps upward: (left siblings, right siblings)."""
    steps, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[k : k + arity] for k in range(0, len(level), arity)]
        for n, k in enumerate(at):
            run, place = runs[k // arity], k % arity
            steps[n].append((run[:place], run[place + 1 :]))
        at, level = [k // arity for k in at], [sha(*r) for r in runs]
    return level[0], steps


def brute(rows, arity=8):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in langs:
        members = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        own[lang] = members, *climb([leaf(r, r[4]) for r in members], arity)
    root, above = climb([own[x][1] for x in langs], arity)
    out = []
    for lang, upper in zip(langs, above):
        members, subroot, steps = own[lang]
        for r, mine in zip(members, steps):
            path = mine + upper
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            folded = leaf(r, text)
            for left, right in path:
                folded = sha(*left, folded, *right)
            out.append((r[0], leaf(r, r[4]), subroot, root, sha(*(d for left, right in path for d in left + right)), folded, folded == root))
    return out


def built(spark, rows, arity=8):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string").repartition(3)
    tampered = [F.translate("text", string.ascii_uppercase, string.ascii_lowercase) if c == "text" else F.col(c) for c in FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.digest(*tampered))
    return [tuple(r) for r in merkle.manifest(docs, FIELDS, "lang", "doc_id", changed, arity).collect()]


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


def test_odd_rows(spark):
    rows = [(1, "web", "en", 3, "A b"), (None, None, None, None, None), (1, "web", "en", 3, "A b"), (1, "web", "en", 3, "other"), (3, "", "", 0, ""), (-7, "é", "zz", None, "É x" * 50_000), (9, "web", "en", 1, None), (12, "s", "Ä", 1, "ABC")]
    assert same(built(spark, rows), brute(rows))


def test_one_row_one_tree_and_none(spark):
    assert same(built(spark, [(5, "s", "en", 1, "a")]), brute([(5, "s", "en", 1, "a")]))
    rows = [(k, "s", "en", k, f"T{k}") for k in range(9)]
    assert same(built(spark, rows), brute(rows))
    assert built(spark, []) == []


@pytest.mark.parametrize("arity", [2, 8])
def test_frontiers_of_several_rounds(spark, monkeypatch, arity):
    """Short runs and rounds of few levels, one tree with most leaves, and many trees of a few leaves."""
    for name, value in (("RUN", 5), ("FIRST", 2), ("STEP", 1)):
        monkeypatch.setattr(merkle, name, value)
    random.seed(3)
    rows = [(k, "s", "en" if k % 10 else f"l{random.randrange(40)}", k, random.choice("ABC") * 3) for k in range(777)]
    assert same(built(spark, rows, arity), brute(rows, arity))


def test_partial_nodes_meet_in_any_order():
    values = [sha(str(k)) for k in range(100)]
    root, _ = climb(values, 8)
    first, second = merkle.Climb(100, 8), merkle.Climb(100, 8)
    order = list(range(100))
    random.Random(1).shuffle(order)
    for n, k in enumerate(order):
        (first if n % 2 else second).add(0, k, values[k])
    assert first.root is None and second.root is None
    last = merkle.Climb(100, 8)
    for own in (first, second):
        for _, _, _, _, level, i, kind, value, _ in own.rows(None, None, ""):
            if kind == "open":
                last.add(level, i, value.hex())
    assert last.root[1] == root and not last.partial


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select(*FIELDS).collect()]
    assert same([tuple(r) for r in merkle.op12_merkle(spark, data).collect()], brute(rows))
