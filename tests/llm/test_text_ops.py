"""Personal data, quality, mixing, packing and vector search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import mixing, packing, pii, quality, topk_search

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = st.sampled_from(["@", ".", "+", "1", "25", "300", "-", " ", "a", "b.c", "(", ")", "@x.y", "4111 1111 1111 1111", "4111111111111111", "::", "%", "é", "..", "İ", "\n", "555", "mailto:", "://", "token = ", "iban "])


@settings(deadline=None, max_examples=600)
@given(st.lists(PARTS, max_size=16).map("".join))
def test_base_spans(text):
    assert [s for s in pii.find_spans(text, pii.automaton()) if s[1] < 4] == base_spans(text)


def test_added_spans():
    def found(text):
        return [(pii.KINDS[k], text[s:e]) for s, k, e in pii.find_spans(text, pii.automaton()) if k > 3]

    assert found("see https://user:pw@host.org/x?y now") == [("address", "https://user:pw@host.org/x?y")]
    assert found("a-1://u:p@h.org") == [("address", "a-1://u:p@h.org")] and found("1://u:p@h.org") == []
    long = "s" * 70 + "+v1.0-x://u:p@h.org"
    assert found("see " + long) == [("address", long)] and found("9" + long) == [("address", long)]
    assert found("see https://host.org/x@y") == [] and found("mailto:") == []
    assert ("address", "MAILTO:a@b.org") in found("MAILTO:a@b.org")
    assert found("IBAN DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("iban DE89 3704 0044 0532 0130 01") == []
    assert found('api_key = "24be64439e36"') == [("account", "24be64439e36")] and found("the token is here") == [] and found("tokens=123456x") == []


def test_pii_rows(spark):
    texts = [None, "", "no data", "a@b.co, 1.2.3.4 and +1 (487) 555-7209", "é a@b.co" * 20_000]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, "a@b.co", "x", 3)], "doc_id long, text string, spans string, n_ip int")
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert (rows[i].n_email, rows[i].n_ip) == (sum(k == 0 for _, k, _ in base), sum(k == 1 for _, k, _ in base))
    assert rows[3].spans == "email:0:6,ip:8:15,phone:20:37" and rows[None].n_email == 1
    assert pii.find_pii(df.limit(0)).count() == 0


# ---- mixing ---------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague_is_highest_quotients(votes, seats):
    caps = [v + 1 for v in votes]
    got = mixing.sainte_lague([float(v) for v in votes], seats, caps)
    expected = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v))):
        best = max((i for i in range(len(votes)) if expected[i] < caps[i] and votes[i]), key=lambda i: (Fraction(votes[i], 2 * expected[i] + 1), -i))
        expected[best] += 1
    assert got == expected


def test_sainte_lague_ties_and_large_numbers():
    assert mixing.sainte_lague([9.0, 28.0, 34.0, 3.0], 13, [99] * 4) == [2, 5, 6, 0]
    assert mixing.sainte_lague([5.0, 5.0, 5.0], 2, [9] * 3) == [1, 1, 0] and mixing.sainte_lague([0.0, 0.0], 4, [3, 3]) == [0, 0]
    assert mixing.sainte_lague([1.0, 3.0], 3, [9, 1]) == [2, 1]
    votes, seats = [5e12, 3e12 + 1, 7.0, 1 / 3], 10**12
    got = mixing.sainte_lague(votes, seats, [10**13] * 4)
    assert sum(got) == seats
    # No seat's quotient is below one that was not given.
    least = min(Fraction(v) / (2 * n - 1) for v, n in zip(votes, got, strict=True) if n)
    assert all(Fraction(v) / (2 * n + 1) <= least for v, n in zip(votes, got, strict=True))


def own_targets(total):
    """Targets by the rule as written: shares by weight; stopped sources leave, and their excess is shared again."""
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    stopped = set()
    while True:
        left = Fraction(3, 2) * sum(total.values()) - sum(2 * total[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * total[s]}
        if not over:
            return {s: target.get(s, Fraction(2 * total[s])) for s in order}
        stopped |= over


def test_mixing_query_by_brute_force(spark, data):
    """Every column of the query worked out from the table again, but for which documents fill a quota."""
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r.source] += size[r.doc_id]
    target, taken = own_targets(total), defaultdict(int)
    got = {r.doc_id: r for r in mixing.op8_mixing(spark, data).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x = got[r.doc_id]
        assert (x["size"], x.source_size, x.target) == (size[r.doc_id], total[r.source], pytest.approx(float(target[r.source]))) and 0 <= x.taken <= 2 * x["size"]
        taken[r.source] += x.taken
    # Seats are blocks: the quota of each source is that of the highest quotients, one by one.
    small = [s for s in target if target[s] < 16 * 64]
    for own, unit in ((small, 1), ([s for s in target if s not in small], 64)):
        seats = {s: 0 for s in own}
        for _ in range(round(sum(target[s] for s in own) / unit)):
            best = max((s for s in own if seats[s] * unit < 2 * total[s] and target[s]), key=lambda s: (target[s] / (2 * seats[s] + 1), -list(target).index(s)))
            seats[best] += 1
        assert {s: taken[s] for s in own} == {s: min(n * unit, 2 * total[s]) for s, n in seats.items()}


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 10], [5, 2]) == [0, 15] and mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0]


def documents(seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(400):
        source = r.choice(["hot"] * 5 + ["b", "é", "A", None])
        rows.append((i, r.choice([None, "", "w " * r.randint(1, 300), " ".join(["x"] * r.randint(1, 900))]), "en", source, 0))
    return rows


def test_mix_of_many_small_sources(spark):
    """Sources smaller than a block are taken near their targets, alone and beside a large one."""
    small = [(i, "one two three four five six seven eight nine ten", f"s{i:03}") for i in range(300)]
    for rows in (small, [*small, (300, "word " * 20_000, "t")]):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert len(got) == len(rows) and all(r.taken > 0 and abs(r.taken - r.target) <= (1 if r.size == 10 else mixing.BLOCK) for r in got)
        assert abs(sum(r.taken for r in got) - sum(r.target for r in got)) <= mixing.BLOCK


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5000)
    rows = documents()
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, lang string, source string, size int, _id int, _text string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    total = defaultdict(int)
    for i, _, _, s, _ in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    target = {s: float(t) for s, t in own_targets(total).items()}
    taken = defaultdict(int)
    for i, _, _, s, _ in rows:
        r = got[i]
        assert (r["size"], r.source_size, r.target) == (size[i], total[s], pytest.approx(target[s])) and 0 <= r.taken <= 2 * size[i]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in order)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7).orderBy(F.desc("doc_id"))).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = mixing.apply_mix(df)
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert mixed.columns == df.columns and {i: n for i, n in words.items() if n} == {i: r.taken for i, r in got.items() if r.taken}
    assert mixing.mix(df.limit(0)).count() == 0


# ---- packing --------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), max_size=12))
def test_plan_meets_the_histogram(histogram):
    plans = packing.plan(histogram, 32)
    made = Counter()
    for pattern, times in plans:
        assert sum(n * c for n, c in pattern.items()) <= 32 and times > 0
        for n, c in pattern.items():
            made[n] += c * times
    assert made == histogram
    sequences, volume = sum(t for _, t in plans), sum(n * c for n, c in histogram.items())
    assert sequences <= 2 * volume / 32 + 1


def test_linear_program_beats_greedy_where_it_must():
    plans = packing.plan({6: 300, 7: 300, 10: 300, 15: 300}, 38)
    assert sum(t for _, t in plans) <= (6 + 7 + 10 + 15) * 300 / 38 * 1.01 + 1


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), packing.encoder(path)
    for text in ["", " ", "a  b\n\n c", "It's été — 123 4\t", "x" * 500, "<|endoftext|> a", " \x85 é\U0001f600", "a\r\n \n"]:
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(spark):
    r = random.Random(1)
    texts = [None, "", "a", "w " * 3000, "same text"] * 2 + [" ".join(r.choice(["one", "deux", "três", "1234"]) for _ in range(r.randint(1, 900))) for _ in range(80)]
    rows = [(i if i != 3 else None, t, 5, 6) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, start int").repartition(4)
    got = packing.pack(df).collect()
    encode = packing.encoder(packing.default_tokenizer())
    parts, room = defaultdict(list), defaultdict(list)
    for p in got:
        parts[p.doc_id].append(p)
        room[p.sequence_id].append((p.offset, p.length))
    for i, t, *_ in rows:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        at = 0
        for p in sorted(parts[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for held in room.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(room) * 1024 <= 1.05 * sum(p.length for p in got) + 1024
    assert packing.pack(df.limit(0)).count() == 0


# ---- quality --------------------------------------------------------------------------------------


def test_quality_learns_and_holds_out(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "of", "and", "stone", "river", "walks", "under"]) for _ in range(r.randint(20, 200))) + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "###", "$$$", "click|", "&&&", "WIN!!"]) for _ in range(r.randint(20, 200)))
    rows = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(600)]
    docs = spark.createDataFrame([(i, t, -1.0) for i, t, _ in rows] + [(600, None, 0.0), (601, "", 0.0)], "doc_id long, text string, old double")
    # Held-out labels are wrong on purpose: nothing may be learnt from them.
    labels = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, _, q in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_labelled(docs, labels)
    got = {x.doc_id: x.score for x in quality.score(docs, model).select("doc_id", "score").collect()}
    assert sum((got[i] >= 0.7) == bool(q) for i, _, q in rows) >= 590 and all(0 <= s <= 1 for s in got.values()) and got[600] == got[601]
    held = {x.doc_id for x in docs.where(quality.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in range(602) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_learns_from_whole_texts(spark):
    """Long texts that differ in their last part only are told apart."""
    r = random.Random(4)
    words = ["the", "of", "and", "stone", "river", "walks", "under"]
    clean = lambda n: " ".join(r.choice(words) for _ in range(n)) + " "
    junk = lambda n: "".join(chr(r.randint(33, 126)) for _ in range(n))
    rows = [(i, clean(4200) + (junk(9000) if i % 2 else clean(1800)), 1 - i % 2) for i in range(80)]
    assert all(len(t.rsplit("  ")[0]) > 16384 for _, t, _ in rows)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = quality.fit_labelled(docs, labels)
    got = {x.doc_id: x.score for x in quality.score(docs, model).select("doc_id", "score").collect()}
    assert all((got[i] >= 0.7) == bool(q) for i, _, q in rows)


def test_quality_model_is_that_of_the_texts(spark):
    """Spark's fit and the fit on lists are the same, repeated rows once."""
    rows = [(i, f"{'good words' if i % 2 else 'BAD!! ###'} {i} " * (i % 40 + 1)) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    order = [x.doc_id for x in labels.where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(9), "doc_id")).select("doc_id").collect()]
    model, text = quality.fit_labelled(docs, labels), dict(rows)
    expected = quality.fit([text[i] for i in order if i % 2], [text[i] for i in order if not i % 2])
    assert (model.good, model.bad) == (expected.good, expected.bad) and model.weights == pytest.approx(expected.weights)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit_labelled(docs, labels)).first().score == 0.5
    assert quality.fit(["a"] * 3, []).constant == 1.0 and quality.fit(["good text " * 9] * 4, ["bad"] * 4).weights


# ---- search ---------------------------------------------------------------------------------------


def brute_topk(rows, every, k):
    v = {i: np.floor(256 * np.array(x, dtype=np.float64)).astype(np.int64).astype(object) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = []
    for q in (i for i in v if i % every == 0):
        scores = sorted((-int((v[q] * v[i]).sum()), i) for i in v if i != q and len(v[i]) == len(v[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("blocks", "scale"), [(8192, 1.0), (40, 1.0), (40, 1e6)])
def test_search_equals_brute_force(spark, monkeypatch, blocks, scale):
    monkeypatch.setattr(topk_search, "VECTORS", blocks)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    r = np.random.default_rng(7)
    hot = (r.normal(size=6) * scale).tolist()
    rows = [(i, hot if i % 3 == 0 else (r.normal(size=6) * scale).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, hot), (1004, [1.0, 2.0]), (1005, [1.0, 3.0]), (1010, [2.0, 2.0])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(tuple(x) for x in topk_search.top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute_topk(rows, 10, 5)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5])
def test_cluster_of_nearly_equal_vectors(spark, monkeypatch, scale):
    """Bounds can't tell a cluster's vectors apart: its blocks are read as a whole, and single pairs stay few."""
    passed = []
    kept = topk_search.keep
    monkeypatch.setattr(topk_search, "keep", lambda df, name: passed.append((name, kept(df, name))) or passed[-1][1])
    monkeypatch.setattr(topk_search, "VECTORS", 100)
    monkeypatch.setattr(topk_search, "QUERIES", 4)
    monkeypatch.setattr(topk_search, "MANY", 8)
    r = np.random.default_rng(11)
    middle = r.normal(size=8) * 1000
    rows = [(i, (middle + r.normal(size=8) * scale / 100).tolist() if i % 3 else (r.normal(size=8) * 1000).tolist()) for i in range(600)]
    got = sorted(tuple(x) for x in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect())
    assert got == brute_topk(rows, 20, 5)
    tables = dict(passed)
    assert scale != 1.0 or tables["blocks"].count() > 0
    assert tables["bounds"].groupBy("q").count().where("count > 8 * 6 + 6").count() == 0


@pytest.mark.parametrize("blocks", [8192, 20])
def test_search_with_repeated_ids(spark, monkeypatch, tmp_path, blocks):
    """Every row asks and is a candidate for itself, as in the operator's SQL: different vectors of one id, and equal rows."""
    monkeypatch.setattr(topk_search, "VECTORS", blocks)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    r = np.random.default_rng(8)
    rows = [(i % 70, r.normal(size=4).tolist()) for i in range(200)] + [(3, [5.0, 5.0, 5.0, 5.0])] * 8 + [(50, [1.0, 2.0, 3.0, 4.0])] * 3
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(x) for x in topk_search.op10_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(topk_search.OP10_SQL).fetchall()) and len(got) == 5 * sum(i % 50 == 0 for i, _ in rows)


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """The bounds leave few rows in doubt, also where a third of all vectors are equal, and none that counts is missed."""
    reads = []
    exact = topk_search.exact
    monkeypatch.setattr(topk_search, "exact", lambda pairs, *more: reads.append(pairs.count()) or exact(pairs, *more))
    monkeypatch.setattr(topk_search, "VECTORS", 500)
    r = np.random.default_rng(9)
    hot = r.normal(size=32).tolist()
    rows = [(i, hot if i % 3 == 0 else r.normal(size=32).tolist()) for i in range(3000)]
    got = sorted(tuple(x) for x in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    assert got == brute_topk(rows, 50, 5)
    assert len(reads) == 2 and sum(reads) < 60 * 20  # of 60 * 3000


def test_bounds_hold():
    """The true score lies between a code's bounds, and a code that isn't passed on can't be among the k best."""
    r = np.random.default_rng(10)
    for high in (3, 255, 256, 1000, 10**9):
        vectors, queries = r.integers(-high, high + 1, (200, 5)), r.integers(-high, high + 1, (7, 5))
        low, width = int(vectors.min()), topk_search.cells(int(vectors.min()), int(vectors.max()))
        codes = ((vectors - low) // width).astype(np.uint8)
        assert ((vectors - low) // width).max() < 256
        found = {}
        for q, row, lower, upper in topk_search.scan(queries.astype(float), -1 - np.arange(7), codes, np.arange(200), np.arange(200), low, width, 5, 200):
            for a, b, c, d in zip(q.tolist(), row.tolist(), lower.tolist(), upper.tolist(), strict=True):
                found[a, b] = (c, d)
        for n, q in enumerate(queries):
            scores = [int((q.astype(object) * v).sum()) for v in vectors]
            assert all(lo <= scores[row] <= up for (a, row), (lo, up) in found.items() if a == -1 - n)
            best = sorted(scores)[-5]
            first = sorted(range(200), key=lambda row: (-scores[row], row))[:5]
            assert all((-1 - n, row) in found for row in first) and (width == 1 or all((-1 - n, row) in found for row, s in enumerate(scores) if s >= best))


def test_query_of_zeros(spark):
    """All scores are equal: the smallest ids, and no vector is left in doubt."""
    found = list(topk_search.scan(np.zeros((1, 3)), np.array([7]), np.ones((100, 3), np.uint8), np.arange(100), np.arange(100)[::-1], -5, 4, 5))
    assert sorted(found[0][1].tolist()) == [95, 96, 97, 98, 99]
    rows = [(i, [0.0, 0.0] if i % 10 == 0 else [i / 50, -1.0]) for i in range(100)]
    got = sorted(tuple(x) for x in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect())
    assert got == brute_topk(rows, 10, 5)
