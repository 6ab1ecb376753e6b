"""Operator 4, n-gram Jaccard join with prefix filters under several global orders.

Two texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. The
result is that of all links, as connected components. Shingles are 64-bit hashes, and equal sets are
known by 128-bit ones; a chance collision of these is the only error there can be.

1. Runs. Rows are kept in runs of some ``RUN`` bytes of text, in a table bucketed by run, so that what
   is found out about a run's shingles is joined to it without moving texts.
2. Counts. A run sends its distinct shingles, as sorted keys in one compressed piece, to each part of
   the key space. A part merges the pieces, counts in how many sets a key is, and answers each run
   with one byte for each of its keys: 0 if no other set has it, else the logarithm of the count.
   The number of parts and the bits of a key grow with the text, so that neither a part's size nor
   the share of shingles that meet in a key by chance does. Where that happens it only costs work:
   a shingle that is shared never looks unshared.
3. Texts. A text can only link if at least 0.8 of its shingles are shared with some other text, so
   all others drop out here, with only their number of shingles kept. Of the others' sets only the
   shared shingles go on, as no link needs more. Equal sets become one node.
4. Candidates. A node's prefix under an order of all shingles is its first n - ceil(0.8 n) + 1; two
   nodes that link share a shingle in their prefixes under every order. All orders here put rare
   shingles first and differ by seeded hashes among equally frequent ones. The prefixes under all
   orders are made once for each node. Nodes that meet in the first order's prefix and can share
   enough, by the shingle's place in both, are candidates; of these pairs of ids only those stay
   whose prefixes meet under each other order as well. Then the sets are fetched and compared.
5. Stars, then the rest. In each bucket (nodes with the same prefix shingle) all nodes are first
   compared with the one that has the fewest shingles of its own, and components are formed. Then
   every other pair in a bucket whose nodes are in different components, so a large group of near
   copies, which the stars join, needs no pairs within it, and no link between components is lost.

Hot shingles. Buckets of more rows than ``HOT_ROWS`` and a fixed share of all rows are so few that their
stars are broadcast, and their rows stay where they are. In the second step nodes of a bucket only
meet those of a like number of shingles, and what is still too large is dealt into blocks, each of
which meets each other one in a task of its own.

Defined results
  null or empty text, or without words: empty set, linked with nothing, its own component.
  fewer than five words: the whole sequence is the one shingle.
  equal texts: linked (if they have words). Repeated ids: rows of one node or of several, each with
  its own component. null ids: such rows link with nothing, and their component is null.
  empty table: empty result. Columns beside the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.components import smallest_labels
from quillon.llm.scratch import HOT_KEYS, HOT_ROWS, bound_batches, hot_keys, keep, keep_bucketed, named, salted_join, sized, unused
from quillon.llm.shingles import mix, shingle_sets

#: Bytes of text in a run, and in what a part of the key space counts, about.
RUN, PART = 1 << 22, 1 << 24
#: Bits of a key beyond those that number all bytes of text: about one shingle in 2 ** (SPARE + 2) shares its key by chance.
SPARE = 6
#: Seeds of the global orders.
ORDERS = (1, 2, 3)
#: Two sets link only if the larger is at most 1.25 times the smaller: less than a step of bands, or one step up.
BAND = 1.3


def least_shared(n: np.ndarray | int) -> np.ndarray | int:
    """The least whole number of at least 0.8 n."""
    return (4 * n + 4) // 5


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and their counts up to 255, compressed; a plane for each byte that is used."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    planes = np.concatenate([np.array([width], np.uint8), *(((steps >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8) for k in range(width)), np.minimum(counts, 255).astype(np.uint8)])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    planes = data[1:].reshape(int(data[0]) + 1, -1)
    steps = np.zeros(planes.shape[1], np.uint64)
    for k, plane in enumerate(planes[:-1]):
        steps |= plane.astype(np.uint64) << np.uint64(8 * k)
    return np.cumsum(steps, dtype=np.uint64), planes[-1].astype(np.int64)


def runs_of(source: DataFrame) -> DataFrame:
    """Rows (id, text) in runs: their ids and texts, and the bytes of these."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            columns = (([number], pa.int64()), ([ids], pa.list_(pa.int64())), ([texts], pa.list_(pa.string())), ([size], pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["run", "ids", "texts", "bytes"])

        for batch in batches:
            for own_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(own_id)
                texts.append(text)
                size += text.as_buffer().size if text.is_valid else 0
                if size >= RUN or len(ids) >= RUN:
                    yield row()
                    number += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return source.mapInArrow(build, "run long, ids array<long>, texts array<string>, bytes long")


class Sets:
    """The sets of a run: for each row its number of shingles, its key, and the set if it is the run's first of its key."""

    def __init__(self, texts: pa.Array, key_bits: int):
        self.sizes, self.keys, self.sets = [], [], []
        seen = set()
        for one in shingle_sets(texts):
            key = xxhash.xxh3_128_digest(one.tobytes()) if len(one) else None
            new = key is not None and key not in seen
            seen.add(key)
            self.sizes.append(len(one))
            self.keys.append(key)
            self.sets.append(one if new else one[:0])
        self.shift = np.uint64(64 - key_bits)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The run's distinct keys of shingles in ascending order, and in how many of its sets each is."""
        return np.unique(self.hashes() >> self.shift, return_counts=True)

    def places(self) -> np.ndarray:
        """For each shingle of all sets the place of its key among the distinct ones."""
        return np.unique(self.hashes() >> self.shift, return_inverse=True)[1]

    def hashes(self) -> np.ndarray:
        return np.concatenate([*self.sets, np.zeros(0, np.uint64)])


def answers(runs: DataFrame, key_bits: int, part_bits: int) -> DataFrame:
    """run, classes: for each run the class of its distinct keys in ascending order, in pieces by part."""
    in_part = np.uint64(key_bits - part_bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, counts = Sets(texts.values, key_bits).counted()
                # Work by the run's own keys, however many parts there are.
                cuts = np.flatnonzero(np.diff(keys >> in_part)) + 1
                pieces = [(int(a[0] >> in_part), _packed(a & ((np.uint64(1) << in_part) - np.uint64(1)), c)) for a, c in zip(np.split(keys, cuts), np.split(counts, cuts), strict=True) if len(a)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([run] * len(pieces), pa.int64()), pa.array([b for _, b in pieces], pa.binary())], ["part", "run", "piece"])

    def answer(table: pa.Table) -> pa.Table:
        keys, counts = zip(*(_unpacked(b) for b in table["piece"].to_pylist()), strict=True)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts))
        classes = np.where(total > 1, np.minimum(255, 8 * np.log2(total)), 0).astype(np.uint8)[where]
        blobs = [zstandard.ZstdCompressor(level=1).compress(c.tobytes()) for c in np.split(classes, ends)]
        return pa.table({"run": table["run"], "part": table["part"], "classes": pa.array(blobs, pa.binary())})

    found = runs.select("run", "texts").mapInArrow(ask, "part int, run long, piece binary").groupBy("part").applyInArrow(answer, "run long, part int, classes binary")
    return found.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("part", "classes")))["classes"].alias("classes"))


def texts_of(runs: DataFrame, classes: DataFrame, key_bits: int) -> DataFrame:
    """A row for each text: id, n, key; and, if it can link and is the run's first of its key, its shared shingles and their classes."""
    kinds = (("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("set", pa.binary()), ("classes", pa.binary()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, got in zip(*batch.columns, strict=True):
                run = Sets(texts.values, key_bits)
                answered = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b) for b in got.as_py() or []), np.uint8)
                own, at, sets, found = answered[run.places()], 0, [], []
                for one in run.sets:
                    mine = own[at : at + len(one)]
                    at += len(one)
                    shared = mine > 0
                    can = len(one) and np.count_nonzero(shared) >= least_shared(len(one))
                    sets.append(one[shared].tobytes() if can else None)
                    found.append(mine[shared].tobytes() if can else None)
                columns = (ids.values, run.sizes, run.keys, sets, found)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [c for c, _ in kinds])

    # The answers are hashed, not sorted with the runs: so no run is moved or sorted.
    joined = runs.join(classes.hint("shuffle_hash"), "run", "left").select("ids", "texts", "classes")
    return joined.mapInArrow(build, "id long, n long, key binary, set binary, classes binary")


def prefix(shared: np.ndarray, classes: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix under the order ``seed`` of a set of ``n`` shingles, of which only the shared ones are given.

    Those that no other text has come first and need not be there. With each shingle goes the number
    of shared ones from it to the end of the order: if it is the first that two sets share, they share
    no more than that.
    """
    length = max(0, len(shared) - least_shared(n) + 1)
    order = np.lexsort((mix(shared ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), classes))[:length]
    return shared[order], len(shared) - np.arange(length)


def prefixes_of(nodes: DataFrame) -> DataFrame:
    """node, n, and its prefixes: under the first order as tokens and rests, under the others as 32 bits of each token.

    These 32 bits only filter; tokens that agree in them by chance let a pair through to be verified.
    """
    others = [f"p{o}" for o in ORDERS[1:]]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, blob, kinds in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                shared, classes = np.frombuffer(blob.as_buffer(), np.uint64), np.frombuffer(kinds.as_buffer(), np.uint8)
                found = [prefix(shared, classes, n, seed) for seed in ORDERS]
                rows.append((found[0][0].view(np.int64), found[0][1], *(mix(f[0]).astype(np.uint32).view(np.int32) for f in found[1:])))
            types = (pa.int64(), pa.int64(), *(pa.int32() for _ in others))
            arrays = [pa.array(c, pa.list_(k)) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["node", "n", "token", "rest", *others])

    return nodes.select("node", "n", "set", "classes").mapInArrow(build, "node long, n long, token array<long>, rest array<long>, " + ", ".join(f"{c} array<int>" for c in others))


def links(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """Whether two sets of n_a and n_b shingles, given by their shared ones, have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(n_a, n_b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (n_a + n_b - both)


def fetched(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (u, v), a kept table, with ``columns`` of both nodes, named after them: u_<column>, v_<column>."""
    for own, other in ("uv", "vu"):
        of_node = nodes.select(F.col("node").alias(own), *(F.col(c).alias(f"{own}_{c}") for c in columns))
        pairs = salted_join(pairs, of_node, own, other, hot_keys(pairs.select("u", "v"), own, "hot"))
    return pairs


def meeting(pairs: DataFrame, prefixes: DataFrame, orders: tuple = ORDERS[1:]) -> DataFrame:
    """Those of ``pairs`` (u, v), a kept table, whose prefixes meet under each of ``orders``."""
    names = [f"p{o}" for o in orders]
    both = fetched(pairs, prefixes, names)
    for c in names:
        both = both.where(F.arrays_overlap(f"u_{c}", f"v_{c}"))
    return both.select("u", "v")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v), a kept table, that link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True)
            found = [links(np.frombuffer(a.as_buffer(), np.uint64), n, np.frombuffer(b.as_buffer(), np.uint64), m) for a, n, b, m in rows]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(found, pa.bool_())) for c in batch.columns[:2]], ["u", "v"])

    return fetched(pairs, nodes, ["set", "n"]).select("u", "v", "u_set", "u_n", "v_set", "v_n").mapInArrow(compare, "u long, v long")


def can_share(a: str, b: str) -> Column:
    """Sharing at most the least rest, two sets of a and b shingles link only if it is 4 / 9 of a + b or more."""
    return 9 * F.least(f"rest_{a}", f"rest_{b}") >= 4 * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def star_pairs(buckets: DataFrame, hot: int) -> DataFrame:
    """u, v: every node with the node of fewest own shingles in each of its buckets, if they can share enough."""
    best = F.max_by(F.struct("node", "rest", "n"), F.struct("rest", -F.col("node")))
    hubs = keep(buckets.groupBy("token").agg(best.alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1").select("token", "held", *(F.col(f"hub.{c}").alias(f"{c}_hub") for c in ("node", "rest", "n"))), "hubs")
    members = buckets.select("token", "node", F.col("rest").alias("rest_own"), F.col("n").alias("n_own"))
    often = F.broadcast(hubs.where(F.col("held") > hot))  # fewer than HOT_KEYS rows
    seldom = members.join(often.select("token"), "token", "left_anti").join(hubs.where(F.col("held") <= hot), "token")
    paired = members.join(often, "token").unionByName(seldom).where("node <> node_hub").where(can_share("own", "hub"))
    return paired.select(F.least("node", "node_hub").alias("u"), F.greatest("node", "node_hub").alias("v")).distinct()


def crossing_pairs(buckets: DataFrame, roots: DataFrame, hot: int) -> DataFrame:
    """u, v: all nodes that share a bucket, are in different components, and can share enough.

    The smaller of two nodes meets the other in its own band of sizes. Groups of a token and band with
    more rows than ``hot``, fewer than twice HOT_KEYS, are dealt into blocks: the smaller nodes by
    rows and the larger by columns of a square, in which each two meet once.
    """
    labelled = keep(buckets.join(roots, "node", "left").select("token", "node", "rest", "n", F.coalesce("root", "node").alias("root"), F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int").alias("band")), "labelled")
    mixed = keep(labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held")).where("low <> high").select("token", "held"), "mixed")
    often = F.broadcast(mixed.where(F.col("held") > hot).select("token"))
    seldom = labelled.join(often, "token", "left_anti").join(mixed.where(F.col("held") <= hot).select("token"), "token", "left_semi")
    rows = keep(labelled.join(often, "token", "left_semi").unionByName(seldom), "open")

    def side(k: str) -> DataFrame:
        return rows.select("token", "band", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "rest", "n", "root")))

    small = side("a")
    large = side("b").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    groups = large.groupBy("token", "band").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot)
    blocks = F.broadcast(groups.select("token", "band", F.ceil(F.col("rows") / hot).cast("int").alias("blocks")))
    number = lambda k: F.pmod(F.xxhash64(f"node_{k}"), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    a = small.join(blocks, ["token", "band"], "left").withColumn("row", number("a")).withColumn("column", every).drop("blocks")
    b = large.join(blocks, ["token", "band"], "left").withColumn("column", number("b")).withColumn("row", every).drop("blocks")
    ordered = F.struct("n_a", "node_a") < F.struct("n_b", "node_b")
    found = a.join(b, ["token", "band", "row", "column"]).where(ordered & (F.col("root_a") != F.col("root_b")) & can_share("a", "b"))
    return found.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id_col, n_shingles, component_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    runs, drop_runs = keep_bucketed(runs_of(source), "runs", "run")
    size = runs.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_bits = max(size // PART, 2 * tasks).bit_length()
    key_bits = min(64, max(part_bits + 8, size.bit_length() + SPARE))
    texts = keep(texts_of(runs, answers(runs, key_bits, part_bits), key_bits), "texts")
    drop_runs()

    named = keep(texts.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("node")), "named")
    held = texts.where("set is not null").groupBy("key").agg(F.first(F.struct("n", "set", "classes")).alias("own"))
    nodes = keep(held.join(named, "key").select("node", "own.*"), "nodes")

    # A bucket is a shingle of the first order's prefix, with the nodes that have it there.
    prefixes = keep(prefixes_of(nodes), "prefixes")
    buckets = keep(prefixes.select("node", "n", F.inline(F.arrays_zip("token", "rest"))).select("token", "node", "rest", "n"), "buckets")
    hot = max(HOT_ROWS, buckets.count() // HOT_KEYS)
    stars = keep(star_pairs(buckets, hot), "stars")
    first = keep(verified(keep(meeting(stars, prefixes), "meeting"), nodes), "links")
    crossing = keep(crossing_pairs(buckets, smallest_labels(first), hot).join(stars, ["u", "v"], "left_anti"), "crossing")
    second = keep(verified(keep(meeting(crossing, prefixes), "meeting"), nodes), "links")
    final = smallest_labels(first.unionByName(second))

    found = named.join(final, "node", "left").select("key", F.coalesce("root", "node").alias("component"))
    # Each key with an id is in ``found``; copies of a text that has very many are dealt to copies of its row.
    has_key = F.col("key").isNotNull() & F.col("id").isNotNull()
    linked = texts.where(has_key).select("id", "n", "key")
    joined = salted_join(linked, found, "key", "id", hot_keys(linked, "key", "hot")).select("id", "n", "component")
    alone = texts.where(~has_key).select("id", "n", F.col("id").alias("component"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component those whose id is its smallest, and all rows with null ids."""
    found = jaccard_components(docs, id_col, text_col)
    (own,) = unused(docs, "_id")
    gone = found.where(named(id_col) != F.col("component_id")).select(named(id_col).alias(own)).distinct()
    return docs.join(sized(gone, "gone"), named(id_col) == F.col(own), "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all ``documents``."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
