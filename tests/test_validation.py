"""Only finals that changed are retrieved for."""

from pyspark.sql import functions as F

from quillon.operators import lexical
from quillon.streaming import validation

DOCS = [(1, "en", "red apple pie"), (2, "en", "red wine"), (3, "fr", "vin rouge"), (4, "en", "green apple")]


def built(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, lang string, text string")
    lexical.save_index(docs, str(tmp_path / "index"), ["doc_id"])
    plain, asked = validation.index_lists(str(tmp_path / "index"), docs, "doc_id", "lang"), []

    def retrieve(queries):
        asked.extend(r.query_key for r in queries.collect())
        return plain(queries)

    def trusted(rows):
        items = spark.createDataFrame(rows, "session_id string, partial string")
        lists = plain(items.select(F.col("session_id").alias("query_key"), F.col("partial").alias("query"))).select(F.col("query_key").alias("session_id"), F.col("final").alias("trusted"))
        return items.join(lists, "session_id", "left")

    return retrieve, asked, trusted


ROWS = [("same", "red apple"), ("case", " Red  APPLE "), ("longer", "red apple"), ("other", "red apple"), ("nothing", "zzz")]
FINALS = [("same", "red apple"), ("case", "red apple"), ("longer", "red apple pie"), ("other", "vin rouge"), ("new", "green"), ("nothing", "zzz"), ("blank", None)]


def test_unchanged_finals_ask_nothing(spark, tmp_path):
    retrieve, asked, trusted = built(spark, tmp_path)
    got = {r.session_id: r for r in validation.validate_finals(spark.createDataFrame(FINALS, "session_id string, transcript string"), trusted(ROWS), retrieve).collect()}
    assert sorted(asked) == ["blank", "longer", "new", "nothing", "other"]  # without a trusted list there is nothing to keep
    assert {s: (r.changed, r.trusted_reused) for s, r in got.items()} == {"same": (False, True), "case": (False, True), "longer": (True, True), "other": (True, False), "new": (True, False), "nothing": (True, False), "blank": (True, False)}
    ids = {s: [e.provenance for e in r.evidence] for s, r in got.items()}
    assert ids["same"] == ids["case"] == ids["longer"] and ids["same"][0] == "1" and ids["other"] == ["3"] and ids["new"] == ["4"] and ids["blank"] == []


def test_stream_of_finals(spark, tmp_path):
    retrieve, asked, trusted = built(spark, tmp_path)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (FINALS[:3], FINALS[3:]):
        spark.createDataFrame(part, "session_id string, transcript string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("session_id string, transcript string").parquet(folder)
        validation.validation_stream(stream, lambda: trusted(ROWS), retrieve, out, str(tmp_path / "check")).awaitTermination()
    assert len(asked) == 5 and spark.read.parquet(out).count() == len(FINALS)
