"""Stored tables that are changed by id, a whole version at a time.

Rows lie in buckets by a hash of their id. A change writes the buckets that it touches into a folder of its own and then, as its
last step, one manifest that names the folder of every bucket. Readers take the newest manifest, so they see whole versions: a
change that breaks off leaves files that no manifest names, and the same change made again gives the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Buckets of a table, settled when it is made.
BUCKETS = 64
_MANIFEST = "version long, bucket int, folder string, schema string"


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifests")
    except AnalysisException:  # no such folder yet
        return None


def _newest(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The rows of a manifest, the newest by default: at most one a bucket. A version that two writers have made counts once, by the
    first folder of its name."""
    found = _manifests(spark, path)
    if found is None:
        return []
    chosen = found.agg(F.max("version")).scalar() if version is None else F.lit(version)
    return found.filter(F.col("version") == chosen).groupBy("version", "bucket").agg(F.min_by(F.struct("folder", "schema"), F.coalesce("folder", F.lit(""))).alias("at")).select(
        "version", "bucket", "at.*").collect()


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an earlier one."""
    rows = _newest(spark, path, version)
    if not rows:
        raise FileNotFoundError(f"no table of this version at {path}")
    schema = rows[0]["schema"]
    held = [f"{path}/data/{r['folder']}/bucket={r['bucket']}" for r in rows if r["folder"]]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def upsert(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Put rows into the table at ``path``, made if there is none: a row takes the place of one with its key. Of several new rows
    with one key the greatest counts (by the other columns, hashed); rows without a key are not stored. Only buckets that have new
    rows are written. Returns the version."""
    spark = df.sparkSession
    old = {r["bucket"]: r for r in _newest(spark, path)}
    version, buckets = (max((r["version"] for r in old.values()), default=0) + 1), (len(old) or buckets)
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    others = [c for c in df.columns if c != key]
    new = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.xxhash64(*others)).alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns, bucket.alias("bucket"))
    touched = {r[0] for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
    stored = [f"{path}/data/{old[b]['folder']}/bucket={b}" for b in touched if b in old and old[b]["folder"]]
    rows = new
    if stored:
        before = spark.read.schema(old[next(iter(old))]["schema"]).parquet(*stored)
        rows = new.unionByName(before.join(new.select(key), key, "left_anti").withColumn("bucket", bucket))
    folder = uuid.uuid4().hex
    if touched:
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    manifest = [(version, b, folder if b in touched else old[b]["folder"] if b in old else None, ddl) for b in range(buckets)]
    # The last step, and one file: until it is there, nothing has changed.
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")
    return version
