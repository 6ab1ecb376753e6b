"""Operator 9, quality by compression.

Two zstandard dictionaries are trained, from text labelled good and text labelled bad. A text is
compressed with each, in chunks of ``CHUNK`` bytes that cover all of it. The difference of the two
sizes over the text's size says which dictionary knows the text better. A logistic calibration,
fitted on other labelled rows, turns it into the probability of label 1; it is given along how far
the text can be compressed at all (with the better dictionary and with none) and how long it is,
since the same difference means more in a text of many repetitions or of a few words.

The model is fitted on a bounded sample of labelled rows: ``SAMPLE`` rows of each label, chosen by a
hash of their id. Half of them train the dictionaries, on the driver, and half the calibration,
whose features come from Spark. Both read whole texts; only where the texts of a dictionary have
more than ``PIECES`` pieces of ``PIECE`` bytes, so many of all their pieces are chosen by a hash.
All rows are scored over their whole text.

Defined results
  null or empty text: the score that the calibration gives to no text.
  labels other than 0 and 1, and rows labelled both 0 and 1, teach nothing. Repeated rows: once.
  no rows of one label to learn from: the score is the share of label 1, or 0.5 without labels.
  repeated or null ids in the scored table: each row has its own score. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.scratch import bound_batches, keep, release

SAMPLE = 4000
#: Bytes of a piece to train on; pieces for a dictionary, at most.
PIECE, PIECES = 2048, 16_000
DICTIONARY, CHUNK, LEVEL = 1 << 16, 4096, 3
#: Scores from here on count as label 1.
THRESHOLD = 0.7
#: Rows whose crc32(id as text) leaves this remainder by 4 are held out and teach nothing.
HELD_OUT = 2


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


@dataclass
class Model:
    """What a score needs: two dictionaries, the weights and the scale of the calibration; or one score for all."""

    good: bytes = b""
    bad: bytes = b""
    weights: tuple = ()
    constant: float = 0.5


def pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def train_dictionary(parts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself, its end counts most
        return b"\n".join(parts)[-DICTIONARY:]


class Sizer:
    """Features of a text from its sizes under the two dictionaries and under none."""

    def __init__(self, model: Model):
        def compressor(data: bytes | None) -> zstandard.ZstdCompressor:
            own = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **own)

        self.each = [compressor(model.good), compressor(model.bad), compressor(None)]

    def features(self, text: str | None) -> list[float]:
        data = (text or "").encode("utf-8", "replace")
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] or [b""]
        good, bad, plain = (sum(len(c.compress(x)) for x in chunks) for c in self.each)
        n = len(data) + 16
        return [1.0, (bad - good) / n, min(good, bad) / n, plain / n, math.log(n) / 8]


def calibrate(rows: np.ndarray, labels: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, on the features as they are."""
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    mean[0], spread[0] = 0, 1
    z = (rows - mean) / spread
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - labels) / len(labels) + penalty * w
        bend = (z * (p * (1 - p))[:, None]).T @ z / len(labels) + penalty * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    w = w / spread
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def constant_model(good: int, bad: int) -> Model | None:
    """The model for too few rows of a label, or None."""
    return Model(constant=good / (good + bad) if good or bad else 0.5) if min(good, bad) < 2 else None


def calibrated(model: Model, good: list[list[float]], bad: list[list[float]]) -> Model:
    model.weights = tuple(calibrate(np.array(good + bad), np.array([1.0] * len(good) + [0.0] * len(bad))))
    return model


def fit(good: list[str], bad: list[str]) -> Model:
    """A model from texts labelled 1 and 0; every second one trains the dictionaries, the others the calibration."""
    if constant := constant_model(len(good), len(bad)):
        return constant
    model = Model(*(train_dictionary([p for t in texts[::2] for p in pieces(t)]) for texts in (good, bad)))
    sizer = Sizer(model)
    return calibrated(model, *([sizer.features(t) for t in texts[1::2]] for texts in (good, bad)))


def labelled_ids(labels: DataFrame, label: int, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most ``rows`` ids with this label that are not held out, with _label and _hash, by a hash of the id."""
    own = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_high"))
    chosen = own.where((F.col("_low") == label) & (F.col("_high") == label)).select(id_col, F.lit(label).alias("_label"), F.xxhash64(F.lit(9), id_col).alias("_hash")).orderBy("_hash", id_col).limit(rows)
    return labels.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # ``rows`` rows at most


def fit_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE) -> Model:
    """``fit`` on the labelled sample, without its texts on the driver."""
    spark = docs.sparkSession
    bound_batches(spark)
    ids = labelled_ids(labels, 1, id_col, label_col, rows).unionByName(labelled_ids(labels, 0, id_col, label_col, rows))
    found = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(ids), id_col).groupBy(id_col, "_label", "_hash").agg(F.min("_text").alias("_text"))
    # The place of a row among those of its label, in the order of the hash, says what it is used for.
    place = Window.partitionBy("_label").orderBy("_hash", id_col)
    texts = keep(found, "labelled")
    places = texts.select(id_col, "_label", "_hash").withColumn("_place", F.row_number().over(place) - 1)
    counts = {r["_label"]: r["n"] for r in places.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if constant := constant_model(counts.get(1, 0), counts.get(0, 0)):
        release(texts)
        return constant
    used = texts.select(id_col, "_text").join(F.broadcast(places), id_col).select("_label", "_place", "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in zip(batch.column(1), batch.column(2), strict=True):
                parts = pieces(text.as_py())
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], ["place", "piece", "part"])

    def train(label: int) -> bytes:
        parts = used.where((F.col("_label") == label) & (F.col("_place") % 2 == 0)).mapInArrow(cut, "place int, piece int, part binary")
        some = parts.orderBy(F.xxhash64(F.lit(9), "place", "piece"), "place", "piece").limit(PIECES).collect()
        return train_dictionary([bytes(r["part"]) for r in sorted(some, key=lambda r: (r["place"], r["piece"]))])

    model = Model(train(1), train(0))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(shared.value)
        for batch in batches:
            rows_ = [sizer.features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows_, pa.list_(pa.float64()))], ["label", "place", "x"])

    features = used.where(F.col("_place") % 2 == 1).mapInArrow(measure, "label int, place int, x array<double>").collect()
    features.sort(key=lambda r: r["place"])
    release(texts)
    return calibrated(model, *([r["x"] for r in features if r["label"] == label] for label in (1, 0)))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``, from the whole text alone; a column of that name is replaced."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names that need no quoting
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizer = Sizer(own)
        for batch in batches:
            if own.weights:
                z = [sum(w * x for w, x in zip(own.weights, sizer.features(t.as_py()), strict=True)) for t in batch.column(at)]
                values = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]
            else:
                values = [own.constant] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], schema.names)

    return plain.mapInArrow(scored, schema).toDF(*docs.columns, score_col)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from the rows of ``labels`` that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
