"""Operator 12, a Merkle manifest of a table: one tree for each key, and a tree over their roots.

1. Every row becomes a leaf, the SHA-256 of its fields. Leaves are range-partitioned by key and order,
   so that each knows its index among those of its tree without any group being sorted in one task.
2. Climbing is driven by events: a digest that arrives goes to its parent's partial node, which holds
   indexed child digests. The size of the tree says how many children a parent has; when it has met
   that arity, it becomes a digest itself and goes to its own parent. This happens where the leaves
   lie, in runs of ``RUN`` leaves. Partial nodes that are left at a run's end, the unresolved
   frontier, are shuffled by an ancestor some levels up, and climb on there, until the roots are met.
3. Each resolved node leaves a reverse link: its children in order. Proofs go down these links, first
   through the rounds of the frontier, the last one first, then in each run to its leaves.
4. The roots of the trees, in the order of their keys, are the leaves of one more tree.

Defined results
  null key: a tree of its own, first. Order within a tree: the order column, nulls first, then the leaf.
  repeated rows: each is a leaf. A lone leaf is its tree's root, and a lone tree's root is the root.
  null or empty fields: ``-`` and ``0:``. An empty table: an empty result.
  Other columns of the input are not read.

No task holds more than a run or a few levels of a frontier; the driver sees the root alone.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm.scratch import bound_batches, keep, sized

ARITY = 8
#: Leaves in a run, at most.
RUN = 1 << 14
#: The first round of the frontier meets at the ancestors of level FIRST, each further one STEP levels higher.
FIRST, STEP = 6, 4

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "binaries": T.ArrayType(T.BinaryType()), "strings": T.ArrayType(T.StringType())}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in fields.split(","))])


_CLIMBED = _struct("part int, block long, tree string, size long, level int, i long, kind string, digest binary, children binaries")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields)), 256)


def fold(*texts: str) -> str:
    """Lower-case hex SHA-256 of texts, one after the other."""
    return hashlib.sha256("".join(texts).encode()).hexdigest()


class Climb:
    """Partial nodes of one tree of ``size`` leaves."""

    def __init__(self, size: int, arity: int):
        self.size, self.arity = size, arity
        self.counts = [size]  # nodes of each level
        self.partial: dict[tuple[int, int], dict[int, str]] = {}
        self.links: list[tuple[int, int, list[str]]] = []
        self.root: tuple[int, str] | None = None

    def count(self, level: int) -> int:
        while len(self.counts) <= level:
            self.counts.append(-(-self.counts[-1] // self.arity))
        return self.counts[level]

    def add(self, level: int, i: int, value: str) -> None:
        """A digest has arrived; parents whose arity it completes go up at once."""
        while (n := self.count(level)) > 1:
            parent = i // self.arity
            held = self.partial.setdefault((level, parent), {})
            held[i % self.arity] = value
            if len(held) < min(self.arity, n - parent * self.arity):
                return
            children = [held[k] for k in range(len(held))]
            del self.partial[level, parent]
            level, i, value = level + 1, parent, fold(*children)
            self.links.append((level, i, children))
        self.root = level, value

    def rows(self, part: int | None, block: int | None, tree: str) -> Iterator[tuple]:
        for level, i, children in self.links:
            yield part, block, tree, self.size, level, i, "link", None, [bytes.fromhex(c) for c in children]
        if self.root:
            yield part, block, tree, self.size, self.root[0], 0, "root", bytes.fromhex(self.root[1]), None
        for (level, parent), held in self.partial.items():
            for k, value in held.items():
                yield part, block, tree, self.size, level, parent * self.arity + k, "open", bytes.fromhex(value), None


_CLIMBED_ARROW = to_arrow_schema(_CLIMBED)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` (tree, order, digest, ...), a kept table, with size and index of their tree, and the run (part, tree, block) they lie in."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "tree", order, "digest").sortWithinPartitions("tree", order, "digest")
    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType())])
    at = dealt.columns.index("tree")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nos = []
            for tree in batch.column(at).to_pylist():
                n = 0 if tree != last else n + 1
                last = tree
                nos.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nos), pa.int32()), pa.array(nos, pa.int64())], schema.names)

    held = keep(dealt.mapInArrow(number, schema), "leaves")
    counts = held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each tree and task
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("tree", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    return held.join(sized(base, "bases"), ["tree", "part"]).withColumn("i", F.col("_base") + F.col("no")).withColumn("block", F.expr(f"no div {RUN}")).drop("_base")


def climb(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """Kept tables of links, roots and open nodes (``_CLIMBED``): of the runs, then of each round of the frontier."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            out: list[tuple] = []
            for part, tree, block, size, i, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, block, tree) != key:
                    out += own.rows(*key) if own else ()
                    key, own = (part, block, tree), Climb(size, arity)
                own.add(0, i, value.hex())
            yield from _table(out, _CLIMBED_ARROW).to_batches()
        if own:
            yield from _table([*own.rows(*key)], _CLIMBED_ARROW).to_batches()

    def meet(table: pa.Table) -> pa.Table:
        own = Climb(table["size"][0].as_py(), arity)
        for level, i, value in zip(*(table[c].to_pylist() for c in ("level", "i", "digest")), strict=True):
            own.add(level, i, value.hex())
        return _table([*own.rows(table["_at"][0].as_py(), table["_meets"][0].as_py(), table["tree"][0].as_py())], _CLIMBED_ARROW)

    ordered = leaves.select("part", "tree", "block", "size", "i", "digest").sortWithinPartitions("tree", "i")
    tables, at = [keep(ordered.mapInArrow(runs, _CLIMBED), "runs")], FIRST
    while (frontier := tables[-1].where("kind = 'open'")).limit(1).count():
        # In a round's tables (part, block) is the level and the index of the ancestor that the nodes met at.
        met = frontier.withColumn("_at", F.greatest(F.lit(at), F.col("level") + 1)).withColumn("_meets", F.expr(f"i div cast(power({arity}, _at - level) as long)"))
        tables.append(keep(met.groupBy("tree", "_at", "_meets").applyInArrow(meet, _CLIMBED), "frontier"))
        at += STEP
    return tables


_DOWN = _struct("tree string, level int, i long, lefts strings, rights strings, subroot string")
_DOWN_ARROW = to_arrow_schema(_DOWN)


def _known(table: pa.Table, arity: int) -> dict[tuple[int, int], tuple]:
    """(level, i) -> lefts, rights, subroot, from the rows that have them and the links below these; nodes with links go."""
    kinds = table["kind"].to_pylist()
    known, links = {}, []
    for kind, level, i, children, lefts, rights, subroot in zip(kinds, *(table[c].to_pylist() for c in ("level", "i", "children", "lefts", "rights", "subroot")), strict=True):
        if kind == "link":
            links.append((level, i, [c.hex() for c in children]))
        elif kind == "above":
            known[level, i] = lefts, rights, subroot
    for level, i, children in sorted(links, reverse=True, key=lambda x: x[0]):
        lefts, rights, subroot = known.pop((level, i))
        for k in range(len(children)):
            known[level - 1, i * arity + k] = ["".join(children[:k]), *lefts], ["".join(children[k + 1 :]), *rights], subroot
    return known


def above(tables: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """Paths of the open nodes and roots of the runs: part, block, tree, level, i, lefts, rights, subroot.

    tops: tree and the path of its root. A path has a left and a right text for each level, from its
    node to the root: the digests of the siblings on that side.
    """

    def down(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        return _table([(tree, level, i, *path) for (level, i), path in _known(table, arity).items()], _DOWN_ARROW)

    paths = None
    for k in range(len(tables) - 1, -1, -1):
        ends = tables[k].where("kind <> 'link'").select("part", "block", "tree", "level", "i", "kind", F.lower(F.hex("digest")).alias("_digest"))
        found = ends.where("kind = 'root'").join(tops, "tree").select("part", "block", "tree", "level", "i", "lefts", "rights", F.col("_digest").alias("subroot"))
        if paths is not None:
            found = found.unionByName(ends.where("kind = 'open'").join(paths, ["tree", "level", "i"]).select("part", "block", "tree", "level", "i", "lefts", "rights", "subroot"))
        if k == 0:
            return found
        rows = tables[k].where("kind = 'link'").withColumns({"lefts": _none("array<string>"), "rights": _none("array<string>"), "subroot": _none("string")}).drop("digest", "size")
        both = rows.unionByName(found.withColumn("kind", F.lit("above")).withColumn("children", _none("array<binary>")))
        paths = keep(both.groupBy("tree", "part", "block").applyInArrow(down, _DOWN), "paths")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def proven(leaves: DataFrame, tables: list[DataFrame], tops: DataFrame, arity: int, carried: list[str], each, schema: T.StructType) -> DataFrame:
    """``each(carried values, digest, lefts, rights, subroot)`` of every leaf, as a row of ``schema``."""
    given = {c: leaves.schema[c].dataType for c in carried}
    shape = {"digest": "binary", "children": "array<binary>", "lefts": "array<string>", "rights": "array<string>", "subroot": "string", "level": "int", "kind": "string", **{c: t.simpleString() for c, t in given.items()}}
    key = ["tree", "part", "block"]

    def shaped(rows: DataFrame, **own: Column) -> DataFrame:
        return rows.select(*key, "i", *(own[c].alias(c) if c in own else F.col(c) if c in rows.columns and c not in carried else _none(t).alias(c) for c, t in shape.items()))

    rows = [
        shaped(leaves, kind=F.lit("leaf"), level=F.lit(0), **{c: F.col(c) for c in carried}), shaped(tables[0].where("kind = 'link'")),
        shaped(above(tables, tops, arity), kind=F.lit("above")),
    ]
    names = to_arrow_schema(schema)

    def prove(table: pa.Table) -> pa.Table:
        known = _known(table, arity)
        own = table.filter(pc.equal(table["kind"], "leaf"))
        values = zip(*(own[c].to_pylist() for c in carried), strict=True) if carried else [()] * len(own)
        return _table([each(v, d.hex(), *known[0, i]) for i, d, v in zip(own["i"].to_pylist(), own["digest"].to_pylist(), values, strict=True)], names)

    return reduce(DataFrame.unionByName, rows).groupBy(*key).applyInArrow(prove, schema)


def manifest(docs: DataFrame, fields: list[str], tree_col: str, order_col: str, changed: Column | None = None, arity: int = ARITY) -> DataFrame:
    """One row a row of ``docs``: order_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` is the digest that a row has now, null where it has its own: proofs are folded with it,
    and verified says whether that still gives the root.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    # A key's first character says whether it is null, which keeps the order and is never null itself.
    tree = F.coalesce(F.concat(F.lit("1"), F.col(tree_col).cast("string")), F.lit("0"))
    rows = keep(docs.select(tree.alias("tree"), F.col(order_col).alias("_id"), F.unhex(digest(*(F.col(c) for c in fields))).alias("digest"), F.unhex(changed if changed is not None else _none("string")).alias("_changed")), "rows")
    leaves = numbered(rows, "_id")
    tables = climb(leaves, arity)
    roots = keep(reduce(DataFrame.unionByName, (t.where("kind = 'root'").select(F.lit("").alias("tree"), F.col("tree").alias("_key"), "digest") for t in tables)), "roots")
    upper = numbered(roots, "_key")
    tops = climb(upper, arity)
    top = [r for t in tops for r in t.where("kind = 'root'").select("digest").collect()]  # one row, or none of an empty table
    root = bytes(top[0]["digest"]).hex() if top else None
    no_path = spark.range(1).select(F.lit("").alias("tree"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    paths = proven(upper, tops, no_path, arity, ["_key"], lambda v, d, lefts, rights, _: (v[0], lefts, rights), _struct("tree string, lefts strings, rights strings"))

    def check(values: tuple, leaf: str, lefts: list[str], rights: list[str], subroot: str) -> tuple:
        row, changed_ = values
        folded = changed_.hex() if changed_ is not None else leaf
        for left, right in zip(lefts, rights, strict=True):
            folded = fold(left, folded, right)
        proof = fold(*(x for pair in zip(lefts, rights, strict=True) for x in pair))
        return row, leaf, subroot, root, proof, folded, folded == root

    schema = T.StructType([T.StructField(order_col, docs.schema[order_col].dataType), *_struct("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
    return proven(leaves, tables, keep(paths, "tops"), arity, ["_id", "_changed"], check, schema)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by lang; every third row, by crc32 of its id, is tampered with by lower-casing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.translate("text", string.ascii_uppercase, string.ascii_lowercase) if c == "text" else F.col(c) for c in fields]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, digest(*tampered))
    return manifest(docs, fields, "lang", "doc_id", changed)


_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), CAST(4294967295 AS BIGINT)))"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
         CASE WHEN {_CRC32} % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
  FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS k FROM d
), up AS (
  SELECT lang, 0 AS level, i, n, leaf AS digest FROM l
  UNION ALL
  SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, level, i // 8, n
), sub AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, i, n, digest FROM sub
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 8, n
), root AS (SELECT digest AS root FROM top WHERE n = 1),
e AS (
  SELECT l.k, 0 AS stage, u.level, u.i, u.digest, sign(u.i - l.i // CAST(pow(8, u.level) AS BIGINT)) AS side FROM l JOIN up u ON l.lang IS NOT DISTINCT FROM u.lang AND u.n > 1 AND u.i // 8 = l.i // CAST(pow(8, u.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.k, 1, t.level, t.i, t.digest, sign(t.i - s.i // CAST(pow(8, t.level) AS BIGINT)) FROM l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top t ON t.n > 1 AND t.i // 8 = s.i // CAST(pow(8, t.level + 1) AS BIGINT)
), p AS (SELECT k, sha256(coalesce(string_agg(digest, '' ORDER BY stage, level, i) FILTER (side <> 0), '')) AS proof FROM e GROUP BY k),
s AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY stage, level) AS step, coalesce(string_agg(digest, '' ORDER BY i) FILTER (side < 0), '') AS a, coalesce(string_agg(digest, '' ORDER BY i) FILTER (side > 0), '') AS b
  FROM e GROUP BY k, stage, level
), f AS (
  SELECT k, 0 AS step, coalesce(changed, leaf) AS digest FROM l
  UNION ALL
  SELECT f.k, f.step + 1, sha256(s.a || f.digest || s.b) FROM f JOIN s ON f.k = s.k AND s.step = f.step + 1
), g AS (SELECT k, arg_max(digest, step) AS folded FROM f GROUP BY k)
SELECT l.doc_id, l.leaf, sub.digest AS subroot, root.root, coalesce(p.proof, sha256('')) AS proof_sha256, g.folded AS folded_root, g.folded = root.root AS verified
FROM l JOIN sub ON l.lang IS NOT DISTINCT FROM sub.lang CROSS JOIN root LEFT JOIN p ON p.k = l.k JOIN g ON g.k = l.k
"""
