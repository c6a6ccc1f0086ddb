"""Explicit schemas of the input tables and a check that a table fits one."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


_TEXT = T.StringType()

REVIEWS = _fields(
    ("Review", _TEXT), ("Data_Source", _TEXT), ("Geography", _TEXT), ("Title", _TEXT),
    ("Review_Date", T.DateType()), ("Product", _TEXT), ("Product_Family", _TEXT),
    ("Sentiment", _TEXT), ("Aspect", _TEXT), ("Keywords", _TEXT),
)
TOPIC_REVIEWS = T.StructType(REVIEWS.fields + [T.StructField("Aspect_Description", _TEXT)])

SALES = _fields(
    ("Month", _TEXT), ("Country", _TEXT), ("Geography", _TEXT), ("OEMGROUP", _TEXT),
    ("SUBFORMFACTOR", _TEXT), ("GAMINGPRODUCTS", _TEXT), ("SCREEN_SIZE_INCHES", T.DoubleType()),
    ("PRICE_BRAND_USD_3", _TEXT), ("OS_VERSION", _TEXT), ("Operating_System_Summary", _TEXT),
    ("Sales_Units", T.LongType()), ("Sales_Value", T.DecimalType(18, 2)), ("ASP", T.DoubleType()),
    ("Series", _TEXT), ("Specs_Combination", _TEXT), ("Chassis_Segment", _TEXT),
)
MAPPING = _fields(("SalesDevice", _TEXT), ("SentimentDevice", _TEXT))
ALIASES = _fields(("domain", _TEXT), ("alias", _TEXT), ("canonical", _TEXT))
HISTORY = _fields(("conv_id", T.LongType()), ("turn", T.LongType()), ("role", _TEXT), ("text", _TEXT))
VECTORS = _fields(
    ("vec_id", T.LongType()), ("embedding", T.ArrayType(T.FloatType())), ("text", _TEXT),
    ("metadata", T.MapType(_TEXT, _TEXT)),
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The same table, or a ValueError naming every missing column."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}; have {', '.join(df.columns)}")
    return df
