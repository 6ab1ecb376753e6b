"""Flows from records to points, tables with an index, and measured stages."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import dense, indexing, measure
from quillon.sources import indexed, points
from quillon.sources.scratch import keep

RECORDS = "query_id string, source_lang string, target_lang string, passages array<string>, is_selected array<int>"


def records(spark, first=0, n=12):
    """Of three passages, the second is blank and the third selected; every fifth record is malformed."""
    rows = [(f"r{k}", "x", "x", [f"Text number {k}. It has two sentences.", " ", f"Chosen {k}"], [0, 0] if k % 5 == 0 else [0, 0, 1]) for k in range(first, first + n)]
    return spark.createDataFrame(rows, RECORDS)


def held(spark, path):
    return {r.point_id: (r.query_id, r.language, r.text, [round(x, 5) for x in r.vector]) for r in points.read(spark, path).withColumn("text", F.get_json_object("payload", "$.text")).collect()}


def test_index_is_one_flow_and_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    got = indexing.index(records(spark), path, F.lit("hi"), buckets=3, size=768)
    assert got == {"records": 12, "malformed": 3, "documents": 18, "chunks": 18, "points": 18}
    first = held(spark, path)
    assert {v[2] for v in first.values()} == {t for k in range(12) if k % 5 for t in (f"Text number {k}. It has two sentences.", f"Chosen {k}")}
    projector = dense.Projector("passage:")
    for _, _, text, vector in first.values():
        own = projector.vector(text.lower())[0]
        assert np.allclose(vector, own / np.linalg.norm(own), atol=1e-4)
    assert indexing.index(records(spark, 6), path, F.lit("hi"), buckets=3, size=768)["points"] == 18 + 2 * 5  # 12 to 17 are new, 15 is malformed
    assert {k: v for k, v in held(spark, path).items() if k in first} == first


def test_nothing_is_written_if_a_model_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    indexing.index(records(spark, 0, 3), path, F.lit("hi"))
    before = points.snapshot(path)

    def failing():
        def model(texts):
            if any("Chosen 7" in t for t in texts):
                raise RuntimeError("no vector for this one")
            return np.ones((len(texts), 4))

        return model

    with pytest.raises(Exception, match="no vector for this one"):
        indexing.index(records(spark), path, F.lit("hi"), load=failing)
    assert points.snapshot(path) == before
    with pytest.raises(Exception, match="a vector of 5 finite numbers"):
        indexing.index(records(spark, 1, 1), path, F.lit("hi"), load=lambda: lambda texts: np.ones((len(texts), 4)), size=5)
    assert points.snapshot(path) == before


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert indexing.index(records(spark).limit(0), path, F.lit("hi")) == {"records": 0, "malformed": 0, "documents": 0, "chunks": 0, "points": 0}


def test_second_language_behind_the_gate(spark, tmp_path):
    source, target, called = str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "called")
    os.mkdir(called)
    indexing.index(records(spark), source, F.lit("hi"), size=768)

    def load():
        def model(texts):
            open(f"{called}/{os.getpid()}", "w").close()
            return dense.load_projection()(texts)

        return model

    other = records(spark, 3, 4)
    with pytest.raises(ValueError, match="more than the limit"):
        indexing.add_language(spark, source, target, other, "en", bytes_per_point=2**30, limit_gib=11.5, load=load)
    assert os.listdir(called) == [] and points.snapshot(target) is None  # nothing was embedded or written
    got = indexing.add_language(spark, source, target, other, "en", bytes_per_point=2**30, limit_gib=12, load=load, size=768)
    assert got == {"copied": 9, "embedded": 3, "points": 12} and os.listdir(called)
    own = {v[2]: v[3] for v in held(spark, source).values()}
    rows = held(spark, target).values()
    assert sorted((v[1], v[2]) for v in rows) == sorted([("hi", f"Chosen {k}") for k in range(12) if k % 5] + [("en", f"Chosen {k}") for k in (3, 4, 6)])
    assert all(v[3] == own[v[2]] for v in rows if v[1] == "hi")


def scanned(df):
    """Rows that leave the scans of a query that was run, before its filters."""
    df.collect()
    nodes = measure._nodes(df._jdf.queryExecution().executedPlan())
    return sum(measure._metric(n, "numOutputRows") for n in nodes if n.getClass().getSimpleName() == "FileSourceScanExec")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """20,000 points with ids in no order, half of them of one record."""
    path = str(tmp_path_factory.mktemp("indexed") / "t")
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("point_id"), F.when(F.col("id") % 3 == 0, "en").otherwise("hi").alias("language"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("q"), F.col("id") % 50)).alias("query_id"), F.col("id").alias("seq"))
    indexed.write(rows, path, files=8, row_group=1 << 17, ids_in_group=4000)
    return path


def ids(spark, numbers):
    return spark.createDataFrame([(k,) for k in numbers], "k long").select(F.sha2(F.col("k").cast("string"), 256).alias("point_id"))


def test_ids_are_found_in_few_row_groups(spark, table):
    found = indexed.find(spark, table, ids(spark, [7, 19_999, 10**9]))
    assert sorted(r.seq for r in found.collect()) == [7, 19_999]
    assert scanned(indexed.find(spark, table, ids(spark, [7]))) < 20_000 / 4
    assert scanned(indexed.find(spark, table, ids(spark, [10**9]))) < 20_000 / 4
    assert scanned(spark.read.parquet(table).where("seq >= 0")) == 20_000
    many = range(0, 20_000, 100)
    assert sorted(r.seq for r in indexed.find(spark, table, ids(spark, many)).collect()) == list(many)
    assert indexed.find(spark, table, ids(spark, [])).collect() == []


def test_records_are_found_in_their_files(spark, table):
    got = indexed.of_record(spark, table, "en", "q9")
    assert sorted(r.seq for r in got.collect()) == [k for k in range(20_000) if k % 3 == 0 and k % 2 and k % 50 == 9]
    assert scanned(indexed.of_record(spark, table, "en", "q9")) < 20_000 / 3
    assert scanned(indexed.of_record(spark, table, "en", "none")) <= 20_000 / 3


def test_written_files_follow_each_other_and_hot_records_are_cut(spark, table):
    files = indexed.check(spark, table).collect()
    assert sum(f.rows for f in files) == 20_000 and all(f.in_order for f in files)
    assert max(f.rows for f in files) < 20_000 / 4 and len(glob.glob(f"{table}/*.parquet")) == len(files) == 8
    assert sum(f.first.query_id == "hot" or f.last.query_id == "hot" for f in files) >= 4


def test_unordered_files_are_told(spark, tmp_path):
    for k in range(2):
        spark.range(100).select(F.lit("en").alias("language"), F.col("id").cast("string").alias("query_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert sorted(f.in_order for f in indexed.check(spark, str(tmp_path / "t")).collect()) == [False, True]


def test_stages_are_run_once_and_measured(spark, tmp_path):
    source = keep(spark.range(1000), "source")
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    done, report = measure.measured(spark, {"first": lambda _: source.mapInArrow(counted, "id long"), "second": lambda t: t.where("id % 10 = 0").groupBy((F.col("id") % 7).alias("k")).count()})
    rows = {r.stage: r for r in report.collect()}
    assert sorted(r.k for r in done.collect()) == list(range(7)) and runs.value == 1000
    assert (rows["first"].rows_written, rows["first"].rows_read, rows["second"].rows_written, rows["second"].rows_read) == (1000, 1000, 7, 1000)
    assert all(r.ms >= r.write_ms > 0 and r.bytes_written > 0 and r.bytes_in_files > 0 for r in rows.values())
    with pytest.raises(ZeroDivisionError), measure.Executions(spark):
        _ = 1 / 0


def test_vectors_of_selected_points_alone_are_read(spark, tmp_path, monkeypatch):
    source, target, asked, real = str(tmp_path / "s"), str(tmp_path / "t"), [], points.read
    indexing.index(records(spark, 0, 4), source, F.lit("hi"), size=768)
    monkeypatch.setattr(points, "read", lambda session, path, columns=None: asked.append(columns) or real(session, path, columns))
    got = indexing.add_language(spark, source, target, records(spark, 4, 1), "en", bytes_per_point=1, limit_gib=1, size=768)
    assert got["copied"] == 3 and asked and all(c and "vector" not in c for c in asked)
