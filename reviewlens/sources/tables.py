"""Readers and writers of the data model. Readers take a schema and a format: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reviewlens.functions.formatting import normalize_keys, parse_month
from reviewlens.functions.matching import mark_folded
from reviewlens.functions.scoring import with_score
from reviewlens.functions.vocabulary import LOWER_LABELS
from reviewlens.sources import schema as S

#: Key columns of reviews, which are stored in upper case.
KEYS = ("Product", "Product_Family")


def _read(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, source_format: str) -> DataFrame:
    """The table under a schema. The caller names the format; names of files say nothing about it. A CSV row that does not fit is an
    error. A multi-line CSV file is one task, so convert such files once: read them and ``write_reviews``."""
    if source_format == "csv":
        return (spark.read.schema(schema)
                .options(header=True, multiLine=multi_line, quote='"', escape='"', mode="FAILFAST")
                .csv(path))
    stored = S.require_columns(spark.read.format(source_format).load(path), *schema.fieldNames())
    return stored.select(*[F.col(f.name) if stored.schema[f.name].dataType == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
                           for f in schema.fields])


def read_reviews(spark: SparkSession, path: str, schema: T.StructType = S.REVIEWS,
                 labels: tuple[str, str, str] = LOWER_LABELS, multi_line: bool = True,
                 source_format: str = "csv", folded: bool = False) -> DataFrame:
    """Reviews with folded keys and a sentiment score; ``labels`` names the vocabulary. ``folded=True`` says that the keys of the stored
    table are upper case, as ``write_reviews`` leaves them: they are then read as they are, and filters on them reach the scan."""
    raw = S.require_columns(_read(spark, path, schema, multi_line, source_format), *schema.fieldNames())
    return with_score(mark_folded(raw, *KEYS) if folded else normalize_keys(raw), labels)


def write_reviews(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store reviews as Parquet with folded keys, rows of a family side by side, so that a filter on a family skips row groups, and with
    Bloom filters of the keys, so that one for an exact name skips those that lack it. Families with very many rows become several
    files."""
    stored = normalize_keys(df.select(*[c for c in df.columns if c != "Sentiment_Score"]))
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in KEYS if c in stored.columns}
    stored.hint("rebalance", F.col("Product_Family")).sortWithinPartitions("Product_Family").write.mode(mode).options(**blooms).parquet(path)


def read_sales(spark: SparkSession, path: str, schema: T.StructType = S.SALES, source_format: str = "csv") -> DataFrame:
    """Sales with ``Month`` parsed from ``MM/dd/yyyy`` (unless the schema has it as a date) and money kept as decimal."""
    raw = S.require_columns(_read(spark, path, schema, False, source_format), *schema.fieldNames())
    if isinstance(raw.schema["Month"].dataType, T.StringType):
        raw = raw.withColumn("Month", parse_month("Month"))
    return raw


def read_mapping(spark: SparkSession, path: str, source_format: str = "csv") -> DataFrame:
    return _read(spark, path, S.MAPPING, False, source_format).dropDuplicates()


def read_aliases(spark: SparkSession, path: str, source_format: str = "csv") -> DataFrame:
    """The alias dictionary ``(domain, alias, canonical)``; it is data, not code."""
    return _read(spark, path, S.ALIASES, False, source_format).dropDuplicates()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Chat turns, one JSON object per line."""
    return spark.read.schema(S.HISTORY).json(path)


def read_answer_list(spark: SparkSession, path: str, conv_id: int = 0) -> DataFrame:
    """A file that holds one JSON array of answer strings, as rows of the history table."""
    texts = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("answers"))
    return texts.select(F.posexplode("answers").alias("turn", "text")).select(
        F.lit(conv_id).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.lit("assistant").alias("role"), "text")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return S.require_columns(spark.read.parquet(path), "vec_id", "embedding")


def write_entity_reviews(df: DataFrame, path: str, entity: str = "Product_Family",
                         review: str = "Review", mode: str = "errorifexists") -> None:
    """One folder of tab-separated reviews per entity, all entities in one job.

    The rebalance hint lets adaptive execution split an entity with very many reviews over
    several files and put small ones together, rather than one file per task and entity.
    """
    (df.select(entity, review).hint("rebalance", F.col(entity))
       .write.mode(mode).partitionBy(entity)
       .options(sep="\t", header=True, quote='"', escape='"',
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
       .csv(path))


def write_history(df: DataFrame, path: str) -> None:
    df.select(*S.HISTORY.fieldNames()).write.mode("append").json(path)


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    S.require_columns(df, "vec_id", "embedding").write.mode(mode).parquet(path)
