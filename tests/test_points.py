"""Point files: what scans read, that upserts are whole or not there, and that streams go on where they were."""

import glob
import os
import random
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from quillon.sources import points

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(spark, ids, seq=0, language="en"):
    data = [(seq + i, f"p{i}", f"q{i % 7}", language, f"text {i}", [float(i), 0.5]) for i in ids]
    return spark.createDataFrame(data, points.SCHEMA)


def held(spark, path):
    return {r.point_id: (r.seq, r.language) for r in points.read(spark, path, ["point_id", "seq", "language"]).collect()}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("points") / "t")
    assert points.upsert(rows(spark, range(1000)), path, buckets=4, size=2) == 1000
    return path


def test_whole_rows(spark, stored):
    got = points.read(spark, stored).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(i, f"p{i}", f"q{i % 7}", "en", f"text {i}", [float(i), 0.5]) for i in range(1000)]
    assert points.read(spark, stored).count() == 1000  # no column


def reader(spark, stored, columns):
    return points.PointReader(stored, spark.createDataFrame([], points._schema(columns)).schema)


def test_filters_reach_the_files(spark, stored, monkeypatch):
    monkeypatch.setattr(points, "TASK_ROWS", 50)
    whole = reader(spark, stored, ["seq"])
    assert list(whole.pushFilters([])) == [] and sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == 1000 and len(whole.partitions()) >= 20
    late = reader(spark, stored, ["seq", "language"])
    assert list(late.pushFilters([GreaterThan(("seq",), 989), EqualTo(("language",), "en")])) == []
    parts = late.partitions()
    assert sum(b.num_rows for p in parts for b in late.read(p)) == 10  # rows that leave the files
    assert len(parts) <= 4 and min(p.low for p in parts) >= 990
    one = reader(spark, stored, ["point_id"])
    assert list(one.pushFilters([In(("point_id",), ("p5",))])) == [] and len({p.file for p in one.partitions()}) == 1
    left = StringContains(("payload",), "9")
    assert list(reader(spark, stored, ["payload"]).pushFilters([left])) == [left]
    nothing = reader(spark, stored, ["seq"])
    assert list(nothing.pushFilters([GreaterThan(("seq",), 5000)])) == [] and nothing.partitions() == []


def test_plan_has_no_filter_left_and_only_asked_columns(spark, stored):
    found = points.read(spark, stored, ["seq", "point_id"]).where("seq > 989 and seq <= 995")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "payload" not in plan and "vector" not in plan
    assert sorted(r.seq for r in found.collect()) == list(range(990, 996))
    assert points.read(spark, stored, ["seq", "payload"]).where("payload like '%99' and seq >= 500").count() == 5
    assert points.read(spark, stored, ["seq"]).where("seq > 5000").count() == 0


def test_lookup_opens_the_files_of_asked_ids(spark, stored):
    asked = spark.createDataFrame([("p5",), ("p999",), ("none",), (None,)], "point_id string")
    assert sorted((r.point_id, r.payload) for r in points.lookup(asked, stored, ["point_id", "payload"]).collect()) == [("p5", "text 5"), ("p999", "text 999")]


def test_upserts_equal_a_dictionary(spark, tmp_path):
    path, r, want = str(tmp_path / "t"), random.Random(4), {}
    for turn in range(4):
        batch = [(r.randrange(60), f"p{r.randrange(40)}", None, f"l{turn}", None, None) for _ in range(30)]
        batch = list({(b[0], b[1]): b for b in batch}.values())  # no two writes of one id and seq
        points.upsert(spark.createDataFrame(batch, points.SCHEMA).repartition(3), path, buckets=3)
        for seq, point_id, _, language, _, _ in batch:
            if point_id not in want or seq >= want[point_id][0]:
                want[point_id] = seq, language
        assert held(spark, path) == want
    assert points.vacuum(path) > 0 and held(spark, path) == want
    points.upsert(rows(spark, [1]), path, overwrite=True)
    assert held(spark, path) == {"p1": (1, "en")}


@pytest.mark.parametrize("bad", [(None, "p", None, None, None, [1.0, 2.0]), (1, None, None, None, None, [1.0, 2.0]), (1, "p", None, None, None, [1.0]), (1, "p", None, None, None, [1.0, float("nan")]), (1, "p", None, None, None, None)])
def test_invalid_points_change_nothing(spark, stored, bad):
    before, files = points.snapshot(stored), set(glob.glob(f"{stored}/data/*"))
    with pytest.raises(Exception, match="point"):
        points.upsert(rows(spark, range(1000, 1040)).unionByName(spark.createDataFrame([bad], points.SCHEMA)), stored, size=2)
    assert points.snapshot(stored) == before
    time.sleep(0.5)
    points.vacuum(stored)  # what cancelled tasks have left
    assert set(glob.glob(f"{stored}/data/*")) == files


def test_two_writers_of_one_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    points.upsert(rows(spark, range(10)), path, buckets=2)
    late = points.PointWriter(path, False, 2, None)
    message = late.write(iter(rows(spark, [3], 100).toArrow().to_batches()))
    points.upsert(rows(spark, [4], 50), path)
    with pytest.raises(RuntimeError, match="another writer"):
        late.commit([message, None])
    assert held(spark, path)["p3"] == (3, "en") and held(spark, path)["p4"] == (54, "en")
    twice = points.PointWriter(path, False, 2, None)
    with pytest.raises(ValueError, match="two tasks"):
        twice.commit([twice.write(iter(rows(spark, [3], 200).toArrow().to_batches())) for _ in range(2)])
    assert held(spark, path)["p3"] == (3, "en") and points.vacuum(path, keep=1) >= 0


KILLED = """
import os, sys, time
sys.path.insert(0, {root!r})
os.environ["PYTHONPATH"] = {root!r}
from pyspark.sql import SparkSession
from quillon.sources import points
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
path, marks = sys.argv[1:]
old = points.read(spark, path)

def die_once(batches):
    for batch in batches:
        yield batch
    try:
        os.close(os.open(marks + "/died", os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        return
    os._exit(1)

def wait(batches):
    for batch in batches:
        yield batch
    open(marks + "/waiting-" + str(os.getpid()), "w").close()
    time.sleep(600)

newer = old.selectExpr("seq + 10000 as seq", "point_id", "query_id", "'new' as language", "payload", "vector")
state = points.snapshot(path)
n = state["buckets"]
from pyspark.sql import functions as F
dealt = lambda df: df.repartition(n, F.pmod(F.crc32(F.col("point_id").cast("binary")), F.lit(n)))
write = lambda df, f: dealt(df).mapInArrow(f, points.SCHEMA).write.format(points.FORMAT).mode("append").option("path", path).save()
write(newer, die_once)
open(marks + "/first", "w").close()
write(newer.selectExpr("seq + 10000 as seq", "point_id", "query_id", "'never' as language", "payload", "vector"), wait)
"""


def test_killed_task_and_killed_driver(spark, tmp_path):
    """A worker that dies is replaced and leaves no point twice; a driver that dies before its commit leaves the table as it was."""
    path, marks = str(tmp_path / "t"), tmp_path / "marks"
    marks.mkdir()
    points.upsert(rows(spark, range(300)), path, buckets=4, size=2)
    script = tmp_path / "killed.py"
    script.write_text(KILLED.format(root=ROOT))
    process = subprocess.Popen([sys.executable, str(script), path, str(marks)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        began = time.time()
        while not (marks / "first").exists() or not list(marks.glob("waiting-*")):
            assert process.poll() is None and time.time() - began < 120
            time.sleep(0.2)
        assert (marks / "died").exists()
        made = held(spark, path)
        assert made == {f"p{i}": (10_000 + i, "new") for i in range(300)}
    finally:
        os.killpg(process.pid, signal.SIGKILL)
        process.wait()
    time.sleep(1)
    assert held(spark, path) == made and points.read(spark, path).count() == 300
    points.vacuum(path, keep=1)
    assert held(spark, path) == made and len(glob.glob(f"{path}/data/*")) == len(points.snapshot(path)["files"])


def test_stream_stops_and_goes_on(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("s", "t", "c"))
    points.upsert(rows(spark, range(100)), source, buckets=3)
    for done in (30, 60, 90, 100, 100):
        assert points.copy(spark, source, target, check, max_points=30, buckets=2) == done
        assert sorted(x[0] for x in held(spark, target).values()) == list(range(done))
    points.upsert(rows(spark, [5], 1000, "new"), source)
    assert points.copy(spark, source, target, check) == 100 and held(spark, target)["p5"] == (1005, "new")
    other = str(tmp_path / "o")
    points.upsert(rows(spark, range(5)), other)
    with pytest.raises(Exception, match="another table"):
        points.copy(spark, other, target, check)


def test_each_point_is_in_one_batch(spark, tmp_path):
    source, check, batches = str(tmp_path / "s"), str(tmp_path / "c"), []
    points.upsert(rows(spark, range(50)).unionByName(rows(spark, range(50, 60)).withColumn("seq", F.lit(20).cast("long"))), source, buckets=3)
    for _ in range(6):  # eleven points share a seq, and no batch can hold part of them
        points.stream(spark, source, check, ["seq", "point_id"], max_points=15).writeStream.foreachBatch(lambda df, _: batches.append([r.point_id for r in df.collect()])).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert sorted(p for b in batches for p in b) == sorted(f"p{i}" for i in range(60)) and max(map(len, batches)) <= 15


def test_paths():
    assert points.local("file:///a/b") == "/a/b" == points.local("/a/b")
    with pytest.raises(ValueError, match="mounted"):
        points.local("hdfs://n/a")


def test_sparse_vectors_are_short_in_files_and_dense_ones_plain(spark, tmp_path):
    import numpy as np

    sparse, dense = np.zeros(768, "<f4"), np.random.default_rng(1).normal(size=768).astype("<f4")
    sparse[::40] = 0.25
    assert len(points.packed(sparse)) < 400 and len(points.packed(dense)) == 4 * 768
    assert (points.unpacked(points.packed(sparse)) == sparse).all() and (points.unpacked(points.packed(dense)) == dense).all()
    rows = spark.range(2000).selectExpr("id as seq", "cast(uuid() as string) as point_id", "'q' as query_id", "'en' as language", "repeat('x', 1200) as payload", "transform(sequence(1, 768), i -> cast(i % 40 = 0 as float)) as vector")
    points.upsert(rows, str(tmp_path), 2, 768)
    size = sum(f.stat().st_size for f in (tmp_path / "data").iterdir())
    assert size < 2000 * 2500  # a point was some 8 KB with pages and vectors as they were
    assert points.read(spark, str(tmp_path)).selectExpr("sum(aggregate(vector, 0D, (a, x) -> a + x)) as s").first().s == 2000 * 19
