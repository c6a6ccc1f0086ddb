"""From raw documents to token files: toxic documents go, one document of each group of near copies stays, documents that hold
benchmark passages go, the rest is put in the order of a mixture of its sources, and written as token ids in that order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
A stage that is given no rows returns none. Rows without a doc_id are judged like others by the stages that look at one text; as
near copies they cannot be told apart by name, so they stay.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import minmax, pfair, spaced_seeds, subwords, token_files
from reviewlens.llm.common import table, unused
from reviewlens.llm.queries import END_ID, tokenizer_path
from reviewlens.sources.storage import cut_lineage, fresh_folder

#: Keys of rows that occur again, which are broadcast up to this number.
FEW_AGAIN = 65_536


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half. The model learns from the labelled ones among them."""
    return subwords.without_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. A row is known by its id and its text: rows equal in both
    become one, the smallest by its other columns, and different texts with one id stay unless they are near copies."""
    id_, hash_ = (unused(docs, name) for name in ("own_id", "own_hash"))
    found = cut_lineage(minmax.near_duplicates(docs).filter("doc_id is not null").groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(
        F.max("first").alias("first"), F.count("*").alias("rows")))
    away, again = (found.filter(c).select(id_, hash_) for c in ("not first", "first and rows > 1"))
    # Mostly few rows occur again. Sent to all tasks, they spare the documents a second shuffle.
    few = F.broadcast(again) if again.count() <= FEW_AGAIN else again
    same = (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    left = docs.join(away.union(again), same, "left_anti")
    once = docs.join(few, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.select(*docs.columns).union(once.select(*docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    key = F.xxhash64("doc_id", "text")
    found = spaced_seeds.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    own = unused(docs, "own_key")
    return docs.join(found.select(F.col("doc_id").alias(own)).distinct(), key == F.col(own), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture once they are written."""
    return pfair.laid_out(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which ``docs`` lies in its files (by doc_id if it is not read from files), and what they hold of
    each document."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_"))
        order = ("file_", "row_")
    except AnalysisException:  # no such column: these rows are not read from files
        placed, order = docs, ("doc_id",)
    return token_files.token_digests(token_files.write_tokens(placed, tokenizer_path(), END_ID, order))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: No SQL for trained scores and hashed candidates; ``tests/llm`` has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each keeps is written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
