"""The shared test tables seen as the data model: reviews, sales, mapping, texts, vectors, history.

``reviews`` and ``sales`` join only the dimension tables that the asked-for columns need. The
fact table has exactly one part and one order per row, so leaving a join out changes no row, and
a query that groups by family and aspect never shuffles the orders or customer tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from reviewlens.functions.scoring import sentiment_score

_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Its schema is read from the files once per process, then reused."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _word(col: str, number: int) -> Column:
    return F.split_part(F.col(col), F.lit(" "), F.lit(number))


def _part_columns() -> dict[str, Column]:
    kind = F.col("p_type")
    system = (F.when(F.col("p_size") % 3 == 0, "Windows OS")
              .when(F.col("p_size") % 3 == 1, "Apple OS").otherwise("Google OS"))
    return {
        "Product": F.upper("p_brand"),
        "Product_Family": F.concat(F.upper("p_brand"), F.lit(" "), F.upper(_word("p_name", 2))),
        "Aspect": F.when(kind == "STANDARD", "Generic").otherwise(
            F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.expr("substr(p_type, 2)")))),
        "Keywords": F.initcap(_word("p_name", 1)),
        "Aspect_Description": F.col("p_name"),
        "Series": F.upper("p_brand"),
        "OEMGROUP": F.concat(F.lit("OEM_"), (F.expr("cast(substr(p_brand, 7) AS int)") % 5).cast("string")),
        "Specs_Combination": F.concat(F.col("p_name"), F.lit(" | "), F.col("p_size").cast("string")),
        "Chassis_Segment": kind,
        "Operating_System_Summary": system,
    }


def _order_columns() -> dict[str, Column]:
    return {"Data_Source": F.col("o_orderpriority")}


def _home_columns() -> dict[str, Column]:
    return {"Geography": F.col("n_name"), "Country": F.col("n_name")}


def _fact_columns() -> dict[str, Column]:
    label = (F.when(F.col("l_returnflag") == "A", "positive")
             .when(F.col("l_returnflag") == "R", "negative").otherwise("neutral"))
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return {
        "Review_Date": F.col("l_shipdate").cast("date"),
        "Sentiment": label,
        "Sentiment_Score": sentiment_score(label),
        "Review_Count": F.lit(1),
        "Month": month,
        "Month_Text": F.date_format(month, "MM/dd/yyyy"),
        "Sales_Units": F.col("l_quantity").cast("long"),
        "Sales_Value": F.col("l_extendedprice").cast("decimal(18,2)"),
        "ASP": F.col("l_extendedprice") / F.col("l_quantity"),
    }


_REVIEW_COLUMNS = ("Product", "Product_Family", "Aspect", "Keywords", "Aspect_Description", "Geography",
                   "Data_Source", "Review_Date", "Sentiment", "Sentiment_Score", "Review_Count")
_SALES_COLUMNS = ("Month", "Country", "OEMGROUP", "Series", "Specs_Combination", "Chassis_Segment",
                  "Operating_System_Summary", "Sales_Units", "Sales_Value", "ASP")


def _star(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns of the fact table and its dimensions.

    Columns are derived on the side they come from, once per part and not once per fact row.
    """
    def side(known: dict[str, Column]) -> list[Column]:
        return [known[c].alias(c) for c in columns if c in known]

    of_part, of_order, of_home = side(_part_columns()), side(_order_columns()), side(_home_columns())
    keys = (["l_partkey"] if of_part else []) + (["l_orderkey"] if of_order or of_home else [])
    rows = table(spark, sf_dir, "lineitem").select(*keys, *side(_fact_columns()))
    if of_part:
        parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), *of_part)
        rows = rows.join(parts, "l_partkey")
    if of_order or of_home:
        orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", *of_order)
        rows = rows.join(orders, "l_orderkey")
    if of_home:
        homes = table(spark, sf_dir, "customer").join(
            table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        rows = rows.join(homes.select(F.col("c_custkey").alias("o_custkey"), *of_home), "o_custkey")
    return rows.select(*columns)


def reviews(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The review table, or the named columns of it."""
    return _star(spark, sf_dir, columns or _REVIEW_COLUMNS)


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The sales table, or the named columns of it; ``Month_Text`` is the month as ``MM/dd/yyyy``."""
    return _star(spark, sf_dir, columns or _SALES_COLUMNS)


def name_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales name to review name, for every product that has reviews."""
    return reviews(spark, sf_dir, "Product", "Product_Family").distinct().toDF("SalesDevice", "SentimentDevice")


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews; the label table gives the sentiment, unlabelled text is neutral."""
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral"))
    return docs.join(marks, "doc_id", "left").select(
        "doc_id", F.col("text").alias("Review"), F.col("source").alias("Product_Family"),
        F.col("lang").alias("Geography"), label.alias("Sentiment"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def event_reviews(events: DataFrame) -> DataFrame:
    """Events (batch or stream) as scored reviews: good, bad and neutral kinds of event."""
    kind = F.col("event_type")
    label = (F.when(kind.isin("purchase", "signup"), "positive")
             .when(kind == "error", "negative").otherwise("neutral"))
    family = F.concat(F.lit("USER_"), F.col("user_id").cast("string"))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), family.alias("Product_Family"), label.alias("Sentiment"),
                         sentiment_score(label).alias("Sentiment_Score"))
