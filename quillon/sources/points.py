"""Point files: a table of points in SQLite files, as a data source to scan, upsert and stream.

A table is a folder. ``data`` holds its files, which are never changed once a commit names them: each
has the points of one bucket (a hash of the id) in a SQLite table with indexes on id and seq.
``_commits`` holds numbered JSON files; the highest one says which files the table consists of, so a
reader sees one commit as a whole and never part of an upsert. A writer's tasks make new files beside
the old ones (a bucket's old points and its new ones, of equal ids the last by seq) and send their
names to the driver, which makes the next commit in one step; if another writer made it meanwhile, the
write fails and nothing has changed. What killed writers leave is not part of any commit, and ``vacuum``
deletes it.

SQLite needs a file system: the folder must be one that the driver and all executors have mounted.

    register(spark)
    upsert(points, path, buckets=64)
    read(spark, path, ["seq", "point_id"]).where("seq > 1000")   # columns and filters reach the files
    stream(spark, path, checkpoint, max_points=10_000)
"""

from __future__ import annotations

import contextlib
import heapq
import itertools
import json
import math
import os
import shutil
import sqlite3
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.sources.scratch import bound_batches

FORMAT = "quillon_points"
COLUMNS = ("seq", "point_id", "query_id", "language", "payload", "vector")
SCHEMA = "seq long, point_id string, query_id string, language string, payload string, vector array<float>"
#: Points that a scan's task reads, about, and rows of an Arrow batch.
TASK_ROWS, BATCH_ROWS = 50_000, 2048

_CREATE = """
CREATE TABLE IF NOT EXISTS points (point_id TEXT PRIMARY KEY, seq INTEGER NOT NULL, query_id TEXT, language TEXT, payload TEXT, vector BLOB) WITHOUT ROWID;
"""
_INDEXES = ("CREATE INDEX IF NOT EXISTS by_seq ON points (seq)", "CREATE INDEX IF NOT EXISTS by_query ON points (query_id)")
#: Of a new file: a point of some KB fits in a page, where a smaller one would give each point a page of its own besides.
PAGE_BYTES = 32768
_UPSERT = """INSERT INTO points (seq, point_id, query_id, language, payload, vector) VALUES (?, ?, ?, ?, ?, ?) ON CONFLICT (point_id) DO UPDATE
SET seq = excluded.seq, query_id = excluded.query_id, language = excluded.language, payload = excluded.payload, vector = excluded.vector WHERE excluded.seq >= points.seq"""
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def local(path: str) -> str:
    """The folder as the file system names it."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"point files need a mounted folder, not {path}")
    return path


def bucket_of(point_id: str, buckets: int) -> int:
    return zlib.crc32(point_id.encode()) % buckets


def packed(vector: np.ndarray) -> bytes:
    """A vector's bytes, compressed if that halves them: then their number leaves 1 when divided by 4, which no plain vector's does."""
    plain = vector.astype("<f4").tobytes()
    short = zlib.compress(plain, 1)
    short += b"\0" * ((1 - len(short)) % 4)
    return short if 2 * len(short) < len(plain) else plain


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held if len(held) % 4 == 0 else zlib.decompressobj().decompress(held), "<f4")


# ---- Commits ----------------------------------------------------------------------------------------


def versions(path: str) -> list[int]:
    folder = f"{local(path)}/_commits"
    return sorted(int(f[:-5]) for f in os.listdir(folder) if f.endswith(".json")) if os.path.isdir(folder) else []


def snapshot(path: str, version: int | None = None) -> dict | None:
    """What a commit says, the last one by default: version, table (its identity), buckets, files. None if there is no table."""
    known = versions(path)
    if version is None and not known:
        return None
    with open(f"{local(path)}/_commits/{known[-1] if version is None else version:012d}.json", encoding="utf-8") as f:
        return json.load(f)


def commit(path: str, state: dict) -> None:
    """Make the commit ``state["version"]``; an error if there is one already."""
    folder = f"{local(path)}/_commits"
    os.makedirs(folder, exist_ok=True)
    ready, target = f"{folder}/{uuid.uuid4().hex}.tmp", f"{folder}/{state['version']:012d}.json"
    with open(ready, "w", encoding="utf-8") as f:
        json.dump(state, f)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(ready, target)  # whole or not at all, and never over another one
    except FileExistsError:
        raise RuntimeError(f"another writer made commit {state['version']} of {path}; nothing was written") from None
    finally:
        os.unlink(ready)


def vacuum(path: str, keep: int = 2) -> int:
    """Delete commits before the last ``keep`` and files that none of these names; returns how many files. Only when nobody writes."""
    known = versions(path)
    used = {f["file"] for v in known[-keep:] for f in snapshot(path, v)["files"]}
    for v in known[:-keep]:
        os.unlink(f"{local(path)}/_commits/{v:012d}.json")
    data = f"{local(path)}/data"
    gone = [f for f in os.listdir(data) if f not in used] if os.path.isdir(data) else []
    for f in gone:
        os.unlink(f"{data}/{f}")
    return len(gone)


# ---- Scans ------------------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    """Points of one file with low <= seq <= high."""

    file: str
    low: int
    high: int


def ranges(path: str, files: list[dict], low: int | None = None, high: int | None = None) -> list[Range]:
    """About ``TASK_ROWS`` points each, by seq; files wholly outside low to high take no part."""
    out = []
    for f in files:
        first, last = max(f["first"], low if low is not None else f["first"]), min(f["last"], high if high is not None else f["last"])
        if first > last:
            continue
        asked = last - first + 1
        parts = max(1, math.ceil(f["rows"] / TASK_ROWS * asked / (f["last"] - f["first"] + 1)))
        step = -(-asked // parts)
        out += [Range(f"{local(path)}/data/{f['file']}", a, min(a + step - 1, last)) for a in range(first, last + 1, step)]
    return out


def scan(part: Range, columns: list[str], schema: pa.Schema, where: str = "", values: tuple = ()) -> Iterator[pa.RecordBatch]:
    """The points of a range, by seq, through the file's index."""
    held = contextlib.closing(sqlite3.connect(f"file:{part.file}?mode=ro&immutable=1", uri=True))
    with held as connection:
        found = connection.execute(f"SELECT {', '.join(columns) or 'seq'} FROM points WHERE seq BETWEEN ? AND ?{where} ORDER BY seq", (part.low, part.high, *values))
        while rows := found.fetchmany(BATCH_ROWS):
            if not columns:
                yield pa.RecordBatch.from_struct_array(pa.array([{}] * len(rows), pa.struct([])))
                continue
            arrays = [pa.array([None if x is None else unpacked(x) for x in c] if name == "vector" else c, schema.field(name).type) for name, c in zip(columns, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class PointReader(DataSourceReader):
    """One snapshot; filters become SQL in the files, and files and ranges that they exclude are never opened."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.columns, self.schema = path, schema.names, to_arrow_schema(schema)
        self.state = snapshot(path)
        if self.state is None:
            raise ValueError(f"no point table at {path}")
        self.low: int | None = None
        self.high: int | None = None
        self.buckets: set[int] | None = None
        self.where, self.values = "", ()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name not in COLUMNS[:5]:
                yield f
            elif isinstance(f, IsNotNull):
                self.where += f" AND {name} IS NOT NULL"
            elif name == "seq" and type(f) in _COMPARE and isinstance(value, int):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(value + isinstance(f, GreaterThan), self.low if self.low is not None else value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(value - isinstance(f, LessThan), self.high if self.high is not None else value)
            elif isinstance(f, (EqualTo, In)) and all(isinstance(v, (int, str)) for v in (value if isinstance(f, In) else [value])) and (not isinstance(f, In) or len(value) <= 500):
                wanted = list(value) if isinstance(f, In) else [value]
                self.where += f" AND {name} IN ({', '.join('?' * len(wanted))})"
                self.values += tuple(wanted)
                if name == "point_id":
                    own = {bucket_of(v, self.state["buckets"]) for v in wanted}
                    self.buckets = own if self.buckets is None else self.buckets & own
            else:
                yield f

    def partitions(self) -> list[Range]:
        files = [f for f in self.state["files"] if self.buckets is None or f["bucket"] in self.buckets]
        return ranges(self.path, files, self.low, self.high)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return scan(partition, self.columns, self.schema, self.where, self.values) if partition else iter(())


# ---- Upserts ----------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """Files that a task made."""

    files: list[dict]


def vectors(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The lists of a column; a null number is not a number."""
    ends, values, valid = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
    return (values[ends[i] : ends[i + 1]] if valid[i] else None for i in range(len(column)))


class PointWriter(DataSourceArrowWriter):
    """Rows dealt by bucket: a task makes a new file for each bucket that it has rows of."""

    def __init__(self, path: str, overwrite: bool, buckets: int, size: int | None):
        self.path, self.overwrite, self.size = path, overwrite, size
        held = snapshot(path)
        self.state = held or {"version": -1, "table": uuid.uuid4().hex, "buckets": buckets, "files": []}
        if held and overwrite:
            self.state = {**held, "buckets": buckets, "files": []}
        self.old = {f["bucket"]: f for f in self.state["files"]}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        made: dict[int, tuple[str, sqlite3.Connection]] = {}
        try:
            for batch in iterator:
                rows: dict[int, list[tuple]] = {}
                for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS[:5]), vectors(batch.column("vector")), strict=True):
                    rows.setdefault(bucket_of(*self.checked(row), self.state["buckets"]), []).append((*row[:5], None if row[5] is None else packed(row[5])))
                for bucket, own in rows.items():
                    if bucket not in made:
                        made[bucket] = self.opened(bucket)
                    made[bucket][1].executemany(_UPSERT, own)
            files = []
            for bucket, (name, connection) in made.items():
                for index in _INDEXES:  # in one go, once the points are there
                    connection.execute(index)
                n, first, last = connection.execute("SELECT count(*), min(seq), max(seq) FROM points").fetchone()
                connection.commit()
                connection.close()
                files.append({"file": name, "bucket": bucket, "rows": n, "first": first, "last": last})
            return Written(files)
        except BaseException:
            for name, connection in made.values():
                connection.close()
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{local(self.path)}/data/{name}")
            raise

    def checked(self, row: tuple) -> tuple[str]:
        seq, point_id, *_, vector = row
        if seq is None or not point_id:
            raise ValueError("a point needs an id and a seq")
        if self.size is not None and (vector is None or len(vector) != self.size or not np.isfinite(vector).all()):
            raise ValueError(f"point {point_id}: a vector of {self.size} finite numbers is expected")
        return (point_id,)

    def opened(self, bucket: int) -> tuple[str, sqlite3.Connection]:
        folder, name = f"{local(self.path)}/data", f"{uuid.uuid4().hex}.sqlite"
        os.makedirs(folder, exist_ok=True)
        if bucket in self.old:
            shutil.copyfile(f"{folder}/{self.old[bucket]['file']}", f"{folder}/{name}")
        connection = sqlite3.connect(f"{folder}/{name}", isolation_level=None)
        connection.executescript(f"PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF; PRAGMA page_size = {PAGE_BYTES}; {_CREATE} BEGIN")  # the file counts only once committed
        return name, connection

    def commit(self, messages: list[Written | None]) -> None:
        made = [f for m in messages if m for f in m.files]
        if len({f["bucket"] for f in made}) < len(made):
            self.abort(messages)
            raise ValueError("rows of one bucket came to two tasks: deal them by bucket first, as upsert() does")
        replaced = {f["bucket"] for f in made}
        files = [f for f in self.state["files"] if f["bucket"] not in replaced] + made
        try:
            commit(self.path, {**self.state, "version": self.state["version"] + 1, "files": sorted(files, key=lambda f: f["bucket"])})
        except RuntimeError:
            self.abort(messages)
            raise

    def abort(self, messages: list[Written | None]) -> None:
        for f in (f for m in messages if m for f in m.files):
            with contextlib.suppress(FileNotFoundError):
                os.unlink(f"{local(self.path)}/data/{f['file']}")


# ---- Streams ----------------------------------------------------------------------------------------


def last_offset(checkpoint: str | None) -> dict | None:
    """The offset that a stream's checkpoint has planned to, from its offset log."""
    folder = f"{local(checkpoint)}/offsets" if checkpoint else ""
    logged = [f for f in os.listdir(folder) if f.isdigit()] if os.path.isdir(folder) else []
    if not logged:
        return None
    with open(f"{folder}/{max(logged, key=int)}", encoding="utf-8") as f:
        return json.loads(f.read().splitlines()[-1])


class PointStream(DataSourceStreamReader):
    """Points by seq. Offsets are (table, seq), so that a checkpoint of another table is refused.

    A batch has at most ``max_points`` points, or those of one seq if they are more. Points that a later commit brings with a seq at or below
    one that was read are not seen; an upsert with a higher seq is.
    """

    def __init__(self, path: str, schema: T.StructType, checkpoint: str | None, max_points: int | None):
        self.path, self.columns, self.schema, self.most = path, schema.names, to_arrow_schema(schema), max_points
        state = snapshot(path)
        if state is None:
            raise ValueError(f"no point table at {path}")
        self.table, planned = state["table"], last_offset(checkpoint)
        self.known = self.own(planned) if planned else None

    def own(self, offset: dict) -> int | None:
        if offset["table"] != self.table:
            raise ValueError(f"the checkpoint is of another table than {self.path}")
        return offset["seq"]

    def initialOffset(self) -> dict:
        return {"table": self.table, "seq": None}

    def latestOffset(self) -> dict:
        """The end of the next batch, ``max_points`` beyond what has been planned."""
        state = snapshot(self.path)
        files = [f for f in state["files"] if self.known is None or f["last"] > self.known]
        end = self.known
        if self.most is None:
            end = max([f["last"] for f in files], default=end)
        else:
            with contextlib.ExitStack() as stack:
                found = []
                for f in files:
                    connection = stack.enter_context(contextlib.closing(sqlite3.connect(f"file:{local(self.path)}/data/{f['file']}?mode=ro&immutable=1", uri=True)))
                    found.append(connection.execute("SELECT seq FROM points WHERE ? IS NULL OR seq > ? ORDER BY seq LIMIT ?", (self.known, self.known, self.most + 1)))
                n = 0
                for seq, same in itertools.groupby(heapq.merge(*found)):  # a cursor a file; points of one seq go together
                    n += len(list(same))
                    if n > self.most and end != self.known:
                        break
                    end = seq[0]
                    if n >= self.most:
                        break
        return {"table": self.table, "seq": end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = self.own(start), self.own(end)
        self.known = high
        if high is None or low == high:
            return []
        return ranges(self.path, snapshot(self.path)["files"], None if low is None else low + 1, high)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return scan(partition, self.columns, self.schema)

    def commit(self, end: dict) -> None:
        self.own(end)


class PointFiles(DataSource):
    """The format ``quillon_points``. Options: path, buckets, size (of vectors), checkpoint and max_points (of streams)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PointReader:
        return PointReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PointWriter:
        if schema.names != list(COLUMNS):
            raise ValueError(f"points have the columns {', '.join(COLUMNS)}")
        size = self.options.get("size")
        return PointWriter(self.options["path"], overwrite, int(self.options.get("buckets", "16")), int(size) if size else None)

    def streamReader(self, schema: T.StructType) -> PointStream:
        most = self.options.get("max_points")
        return PointStream(self.options["path"], schema, self.options.get("checkpoint"), int(most) if most else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _schema(columns: list[str] | None) -> str:
    kinds = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    return ", ".join(f"{c} {kinds[c]}" for c in columns or COLUMNS)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The table as its last commit has it; only ``columns`` are read from the files."""
    register(spark)
    return spark.read.format(FORMAT).schema(_schema(columns)).load(path)


def stream(spark: SparkSession, path: str, checkpoint: str, columns: list[str] | None = None, max_points: int | None = None) -> DataFrame:
    """Points by seq, ``max_points`` a batch; ``checkpoint`` is the one that the query is started with."""
    register(spark)
    reader = spark.readStream.format(FORMAT).schema(_schema(columns)).option("checkpoint", checkpoint)
    return (reader.option("max_points", str(max_points)) if max_points else reader).load(path)


def upsert(points: DataFrame, path: str, buckets: int = 16, size: int | None = None, overwrite: bool = False, finish: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Write points (the columns ``COLUMNS``) over those of equal id that are not newer; returns the table's points.

    With ``finish``, ``points`` has seq, point_id and what ``finish`` makes the columns from, row by row, once
    the rows are dealt: so vectors can be made where they are written, and aren't moved.
    """
    register(points.sparkSession)
    bound_batches(points.sparkSession)
    held = snapshot(path)
    n = held["buckets"] if held and not overwrite else buckets
    rows = points if finish else points.select(*COLUMNS)
    # In order of ids, a file grows at its end and its pages are full.
    dealt = rows.repartition(n, F.pmod(F.crc32(F.col("point_id").cast("binary")), F.lit(n))).sortWithinPartitions("point_id", "seq")
    made = finish(dealt).select(*COLUMNS) if finish else dealt
    writer = made.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("buckets", str(n))
    (writer.option("size", str(size)) if size else writer).save(path)
    return stored(path)


def stored(path: str) -> int:
    """How many points the table has; 0 if there is none."""
    return sum(f["rows"] for f in (snapshot(path) or {"files": []})["files"])


def lookup(asked: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """The points with the ids in ``asked`` (point_id): ids are dealt to their buckets and looked up in each file's own index."""
    spark = asked.sparkSession
    state = snapshot(path)
    names = columns or list(COLUMNS)
    files = {f["bucket"]: f"{local(path)}/data/{f['file']}" for f in state["files"]}
    arrow = to_arrow_schema(spark.createDataFrame([], _schema(names)).schema)
    dealt = asked.select("point_id").where("point_id is not null").repartition(state["buckets"], F.pmod(F.crc32(F.col("point_id").cast("binary")), F.lit(state["buckets"])))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, list[str]] = {}
            for point_id in batch.column(0).to_pylist():
                own.setdefault(bucket_of(point_id, state["buckets"]), []).append(point_id)
            for bucket in own.keys() & files.keys():
                part = Range(files[bucket], -(1 << 63), (1 << 63) - 1)
                for at in range(0, len(own[bucket]), 500):
                    some = own[bucket][at : at + 500]
                    yield from scan(part, names, arrow, f" AND point_id IN ({', '.join('?' * len(some))})", tuple(some))

    return dealt.mapInArrow(find, _schema(names))


def copy(spark: SparkSession, source: str, target: str, checkpoint: str, max_points: int | None = None, buckets: int = 16, size: int | None = None) -> int:
    """Copy the next ``max_points`` points (all that are there without it) into another table; returns the target's points.

    A copy that was stopped goes on from its checkpoint, and a batch that is run again is upserted
    again, which changes nothing. The checkpoint of another source is refused.
    """

    def each(batch: DataFrame, _: int) -> None:
        upsert(batch, target, buckets, size)

    stream(spark, source, checkpoint, max_points=max_points).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stored(target)
