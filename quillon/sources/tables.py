"""Datasets by name, and views of the test tables as corpus, queries, sessions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages of the engine, with their codes in a store and in speech recognition.
LANGUAGES = {"hi": ("hin_Deva", "hi-IN"), "en": ("eng_Latn", "en-IN")}

RAW_SCHEMA = (
    "query string, Eng_Query string, query_id string, query_type string, source_lang string, target_lang string, "
    "passages struct<Translated_passages: array<string>, English_passages: array<string>, is_selected: array<int>>"
)


class Catalog:
    """Parquet datasets by (language, split). The English view may name the same file as another language."""

    def __init__(self, root: str, files: dict[tuple[str, str], str]):
        self.root, self.files = root.rstrip("/"), {(a.lower(), b): f for (a, b), f in files.items()}

    def path(self, language: str, split: str) -> str:
        key = (language.strip().lower(), split)
        if key not in self.files:
            raise ValueError(f"no dataset for language {language!r} and split {split!r}")
        return f"{self.root}/{self.files[key]}"

    def read(self, spark: SparkSession, language: str = "hi", split: str = "validation", columns: list[str] | None = None) -> DataFrame:
        """A lazy scan; ``columns`` are the only ones read. Missing files are an error when the plan is made."""
        df = spark.read.parquet(self.path(language, split))
        return df.select(*columns) if columns else df

    def row_count(self, spark: SparkSession, language: str, split: str) -> int:
        """Rows, counted without reading columns."""
        return self.read(spark, language, split).count()


def target_language(language: Column) -> Column:
    """The store's code of a language; an unknown language is an error."""
    key = F.lower(F.trim(language))
    known = F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (k, v[0])))
    return F.coalesce(known[key], F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce(language, F.lit("null")))))


def application_language(target: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (v[0], k)))
    return F.coalesce(known[F.trim(target)], F.raise_error(F.concat(F.lit("unknown target language: "), F.coalesce(target, F.lit("null")))))


def schema_report(df: DataFrame, sample: int = 100) -> DataFrame:
    """One row a column: name, type, how many of the first ``sample`` rows have a value."""
    few = df.limit(sample)
    counts = few.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    types = F.create_map(*(F.lit(x) for c, t in df.dtypes for x in (c, t)))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("present")) for c in df.columns))
    return counts.select(F.inline(pairs)).select("name", types[F.col("name")].alias("type"), "present")


def value_report(df: DataFrame, columns: list[str], arrays: list[str] | None = None) -> DataFrame:
    """One row: the distinct values of each column, sorted, and the least and most entries of each array."""
    sets = [F.array_sort(F.collect_set(c)).alias(c) for c in columns]
    return df.agg(*sets, *(f(F.size(c)).alias(f"{n}_{c}") for c in arrays or [] for f, n in ((F.min, "least"), (F.max, "most"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A session's setting: into how many partitions the corpus is dealt when it is read. Unset, as its files have it.
INPUT_PARTITIONS = "quillon.input.partitions"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang of the corpus: the columns that retrieval reads."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return docs.repartition(int(parts)) if parts else docs


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested records: a passage for each line, and one label for all of them."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("quality"))
    docs = documents(spark, sf_dir).join(labels, "doc_id", "left")
    lines = F.split("text", "\n")
    # In a selected document every third line is selected.
    chosen = F.transform(lines, lambda _, i: F.when((F.coalesce(F.col("quality"), F.lit(0)) == 1) & (i % 3 == 0), 1).otherwise(0))
    return docs.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("source_lang"), F.col("lang").alias("target_lang"), lines.alias("passages"), chosen.alias("is_selected"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_key, query: the whole text of each benchmark item that isn't blank."""
    text = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_key"), F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("query"))
    return text.where("query <> ''")


def seed_passages(spark: SparkSession, passages: dict[str, list[str]]) -> DataFrame:
    """Rows of seed passages by language, ready to be united with a corpus by name."""
    rows = [(f"seed-{lang}-{k}", lang, LANGUAGES[lang][0], 0, 0, text) for lang, texts in passages.items() for k, text in enumerate(texts)]
    schema = T.StructType([T.StructField(n, t) for n, t in (("query_id", T.StringType()), ("language", T.StringType()), ("target_lang", T.StringType()), ("passage_index", T.IntegerType()), ("chunk_index", T.IntegerType()), ("text", T.StringType()))])
    return spark.createDataFrame(rows, schema)
