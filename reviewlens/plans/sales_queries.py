"""Sales measures over the whole sales table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions.matching import ci_match
from reviewlens.operators import sales as s
from reviewlens.plans.registry import query
from reviewlens.sources import bindings as bind

_UNITS = "CAST(sum(Sales_Units) AS DOUBLE) / 1000"
_ASP = "CAST(sum(Sales_Value) AS DOUBLE) / sum(Sales_Units)"


def _sales(spark, d, *columns):
    return bind.sales(spark, d, *columns)


@query("sal1_units", f"SELECT {_UNITS} AS SALES_UNITS_K FROM sales WHERE Series LIKE '%BRAND#2%'", "sales")
def _(spark, d):
    return s.units_k(_sales(spark, d, "Series", "Sales_Units"), "brand#2")


@query("sal2_units_by_country", f"SELECT Country, {_UNITS} AS SALES_UNITS_K FROM sales GROUP BY Country", "sales")
def _(spark, d):
    return s.units_k(_sales(spark, d, "Country", "Sales_Units"), by="Country")


@query("sal3_asp", f"SELECT Series, {_ASP} AS ASP FROM sales GROUP BY Series", "sales")
def _(spark, d):
    return s.asp(_sales(spark, d, "Series", "Sales_Units", "Sales_Value"), by="Series")


@query("sal4_price_range", """SELECT Series, min(ASP) AS LOWEST_VALUE, max(ASP) AS HIGHEST_VALUE FROM sales
WHERE Sales_Units <> 0 AND ASP >= 0 GROUP BY Series""", "sales")
def _(spark, d):
    return s.price_range(_sales(spark, d, "Series", "Sales_Units", "ASP"), by="Series")


@query("sal5_top_specs", f"""SELECT Series, Specs_Combination, SALES_UNITS_K FROM (
  SELECT *, row_number() OVER (PARTITION BY Series ORDER BY SALES_UNITS_K DESC, Specs_Combination) AS r
  FROM (SELECT Series, Specs_Combination, {_UNITS} AS SALES_UNITS_K FROM sales WHERE Sales_Units <> 0 GROUP BY 1, 2)) WHERE r = 1""", "sales")
def _(spark, d):
    return s.top_specs(_sales(spark, d, "Series", "Specs_Combination", "Sales_Units"), by="Series")


@query("sal5_top_specs_of_series", f"""SELECT Specs_Combination, {_UNITS} AS SALES_UNITS_K FROM sales
WHERE Sales_Units <> 0 AND Series = 'BRAND#2' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""", "sales")
def _(spark, d):
    return s.top_specs(_sales(spark, d, "Series", "Specs_Combination", "Sales_Units"), "brand#2", k=3, match="equals")


@query("sal6_monthly_asp", "SELECT Month, round(avg(ASP), 6) AS AVERAGE_ASP FROM sales GROUP BY Month", "sales")
def _(spark, d):
    return s.monthly_asp(_sales(spark, d, "Month", "ASP")).withColumn("AVERAGE_ASP", F.round("AVERAGE_ASP", 6))


def _band_sql(hit: str, band: int) -> str:
    return f"""SELECT * FROM (SELECT c.Series, c.ASP AS COMPETITOR_ASP, c.Chassis_Segment, CAST(c.u AS BIGINT) AS Sales_Units,
    row_number() OVER (PARTITION BY c.Chassis_Segment ORDER BY c.u DESC, c.Series) AS RANK
  FROM (SELECT Series, Chassis_Segment, {_ASP} AS ASP, sum(Sales_Units) AS u FROM sales
        WHERE NOT ({hit}) AND Operating_System_Summary IN ('Apple OS', 'Google OS', 'Windows OS') GROUP BY 1, 2) c
  JOIN (SELECT Chassis_Segment, {_ASP} AS ASP FROM sales WHERE {hit} GROUP BY 1) f
    ON c.Chassis_Segment = f.Chassis_Segment AND abs(c.ASP - f.ASP) <= {band}) WHERE RANK <= 3"""


def _band_rows(spark, d):
    return _sales(spark, d, "Series", "Chassis_Segment", "Operating_System_Summary", "Sales_Units", "Sales_Value")


@query("sal7_competitors_in_band", _band_sql("Series = 'BRAND#2'", 25), "sales")
def _(spark, d):
    return s.competitors_band(_band_rows(spark, d), "brand#2", band=25, match="equals")


@query("sal7_competitors_default_band", _band_sql("Series LIKE '%BRAND#2%'", 400), "sales")
def _(spark, d):
    return s.competitors_band(_band_rows(spark, d), "brand#2")


@query("jn3_price_band_join", f"""SELECT c.Series, c.Chassis_Segment, c.ASP, f.ASP AS FOCAL_ASP
FROM (SELECT Series, Chassis_Segment, {_ASP} AS ASP FROM sales GROUP BY 1, 2) c
JOIN (SELECT Chassis_Segment, {_ASP} AS ASP FROM sales WHERE Series = 'BRAND#2' GROUP BY 1) f
  ON c.Chassis_Segment = f.Chassis_Segment AND abs(c.ASP - f.ASP) <= 25""", "sales")
def _(spark, d):
    rows = _sales(spark, d, "Series", "Chassis_Segment", "Sales_Units", "Sales_Value")
    focal = rows.filter(ci_match("Series", "brand#2", "equals")).groupBy("Chassis_Segment").agg(s.price_of().alias("ASP"))
    return s.price_band_join(focal, rows.groupBy("Series", "Chassis_Segment").agg(s.price_of().alias("ASP")), 25)


@query("jn5_other_series", f"SELECT Series, {_UNITS} AS SALES_UNITS_K FROM sales WHERE Series NOT LIKE '%BRAND#2%' GROUP BY 1", "sales")
def _(spark, d):
    return s.units_k(s.without_series(_sales(spark, d, "Series", "Sales_Units"), "brand#2"), by="Series")


_NEAREST = ("Series", "Chassis_Segment", "Sales_Units", "Sales_Value")


@query("sal8_competitors_nearest", "SELECT * FROM nearest WHERE RANK <= 3", "nearest")
def _(spark, d):
    return s.competitors_nearest(_sales(spark, d, *_NEAREST))


@query("jn15_nearest_price_of_series", "SELECT * FROM nearest WHERE RANK <= 5 AND FOCAL_SERIES = 'BRAND#2'", "nearest")
def _(spark, d):
    return s.competitors_nearest(_sales(spark, d, *_NEAREST), "BRAND#2", k=5)


@query("sal9_date_range", "SELECT Series, min(Month) AS FIRST_MONTH, max(Month) AS LAST_MONTH FROM sales GROUP BY Series", "sales")
def _(spark, d):
    return s.date_range(_sales(spark, d, "Series", "Month"))


@query("sal10_sales_by", f"""SELECT Month, OEMGROUP, Operating_System_Summary, CAST(sum(Sales_Units) AS BIGINT) AS SALES_UNITS,
  CAST(sum(Sales_Value) AS DOUBLE) AS SALES_VALUE, {_ASP} AS ASP FROM sales GROUP BY 1, 2, 3""", "sales")
def _(spark, d):
    rows = _sales(spark, d, "Month", "OEMGROUP", "Operating_System_Summary", "Sales_Units", "Sales_Value")
    return s.sales_by(rows, ["Month", "OEMGROUP", "Operating_System_Summary"])
