import random
from decimal import Decimal

import pytest

from reviewlens.operators import profile, sales as s

SCHEMA = "Series string, Chassis_Segment string, Specs_Combination string, OEMGROUP string, Operating_System_Summary string, Sales_Units long, Sales_Value decimal(18,2), Month date, ASP double"


def sale(series, chassis, units, value, spec="spec", oem="oem", system="Windows OS"):
    import datetime
    return (series, chassis, spec, oem, system, units, Decimal(value), datetime.date(2023, 1, 1), float(value) / units if units else -1.0)


@pytest.fixture
def market(spark):
    rnd = random.Random(5)
    rows = [sale(f"S{i:02d}", rnd.choice("ABCD"), rnd.randint(1, 9), rnd.choice([100, 200, 300, 350, 900]))
            for i in range(24) for _ in range(rnd.randint(1, 3))]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute_nearest(rows, k):
    out = {}
    segments = {}
    for r in rows:
        segments.setdefault(r[0], set()).add(r[1])
    for focal, own in segments.items():
        price = float(sum(r[6] for r in rows if r[0] == focal)) / sum(r[5] for r in rows if r[0] == focal)
        ranked = []
        for other in segments:
            shared = [r for r in rows if r[0] == other and r[1] in own]
            if other != focal and sum(r[5] for r in shared):  # without units there is no price
                asp = float(sum(r[6] for r in shared)) / sum(r[5] for r in shared)
                ranked.append((abs(asp - price), other))
        out[focal] = [o for _, o in sorted(ranked)[:k]]
    return out


@pytest.mark.parametrize("k", [1, 3, 30])
def test_nearest_competitors_match_brute_force(market, k):
    df, rows = market
    got = {}
    for r in s.competitors_nearest(df, k=k).orderBy("FOCAL_SERIES", "RANK").collect():
        got.setdefault(r["FOCAL_SERIES"], []).append(r["Series"])
    assert got == {f: o for f, o in brute_nearest(rows, k).items() if o}


@pytest.mark.parametrize("range_rows", [2, 5, 128])
def test_ranges_of_any_size_find_the_nearest(spark, range_rows):
    """As many sets of segments as series, prices that differ by segment, and series without units somewhere."""
    rnd = random.Random(11)
    rows = [sale(f"S{i:03d}", seg, rnd.randint(1, 9), rnd.randint(50, 5000)) for i in range(90) for seg in rnd.sample("ABCDEFGH", rnd.randint(1, 5))]
    rows += [sale("S005", "Z", 0, 70), sale("S007", "A", 0, 40), sale("NONE", "A", 0, 40)] + [sale(f"T{i}", "A", 2, 500) for i in range(40)]
    got = {}
    for r in s.competitors_nearest(spark.createDataFrame(rows, SCHEMA), k=3, range_rows=range_rows).orderBy("FOCAL_SERIES", "RANK").collect():
        got.setdefault(r["FOCAL_SERIES"], []).append(r["Series"])
    sold = [r for r in rows if r[0] != "NONE"]
    assert got == {f: o for f, o in brute_nearest(sold, 3).items() if o}


def test_pairs_do_not_grow_with_the_square(spark):
    """Of series spread over prices in one segment, each meets those near it."""
    rows = [sale(f"S{i:04d}", "A", 1, 10 * i + 10) for i in range(900)]
    base = spark.createDataFrame(rows, SCHEMA).selectExpr("Series", "Chassis_Segment", "Sales_Value as value", "Sales_Units as units")
    focal = s._priced(base, base.selectExpr("Series as FOCAL", "Series"))
    assert s._near_pairs(base, focal, 3, 16).count() < 900 * 100


def test_a_group_does_not_compete_with_itself(spark):
    rows = [sale("A1", "A", 1, 100), sale("A2", "A", 1, 110), sale("B", "A", 1, 104), sale("C", "A", 1, 300), sale("D", "B", 1, 105)]
    groups = spark.createDataFrame([("ALL A", "A1"), ("ALL A", "A2"), ("ALL A", "A2"), ("B", "B"), ("NO", "UNKNOWN")], "FOCAL string, Series string")
    got = s.competitors_nearest(spark.createDataFrame(rows, SCHEMA), groups=groups).orderBy("FOCAL_SERIES", "RANK").collect()
    assert [(r["FOCAL_SERIES"], r["Series"], r["PRICE_DIFFERENCE"]) for r in got] == [
        ("ALL A", "B", 1.0), ("ALL A", "C", 195.0), ("B", "A1", 4.0), ("B", "A2", 6.0), ("B", "C", 196.0)]


def test_nearest_of_one_series(market):
    df, rows = market
    got = [r["Series"] for r in s.competitors_nearest(df, "S03").orderBy("RANK").collect()]
    assert got == brute_nearest(rows, 3)["S03"]


def test_nearest_with_many_equal_prices(spark):
    df = spark.createDataFrame([sale(f"S{i}", "A", 1, 100) for i in range(9)], SCHEMA)
    got = [r["Series"] for r in s.competitors_nearest(df, "S1").orderBy("RANK").collect()]
    assert got == ["S0", "S2", "S3"]


def test_band_competitors(spark):
    df = spark.createDataFrame([
        sale("FOCAL", "A", 10, 1000), sale("NEAR", "A", 5, 600), sale("FAR", "A", 50, 50000),
        sale("OTHER", "B", 5, 500), sale("LINUX", "A", 5, 500, system="Linux"), sale("FOCAL 2", "A", 9, 900)], SCHEMA)
    assert [r["Series"] for r in s.competitors_band(df, "focal").collect()] == ["NEAR"]
    assert [r["Series"] for r in s.competitors_band(df, "focal", match="equals").orderBy("RANK").collect()] == ["FOCAL 2", "NEAR"]


def test_no_units_no_price(spark):
    df = spark.createDataFrame([sale("Z", "A", 0, 100)], SCHEMA)
    assert s.asp(df, "Z").first()["ASP"] is None
    assert s.price_range(df).first()["LOWEST_VALUE"] is None


def test_units_stay_fractional(spark):
    df = spark.createDataFrame([sale("Z", "A", 1500, 100)], SCHEMA)
    assert s.units_k(df, "z").first()["SALES_UNITS_K"] == 1.5


def test_profile_and_cards(spark, reviews):
    sales = spark.createDataFrame([sale("S1", "A", 10, 1000, "big"), sale("S1", "A", 10, 1000, "alt"), sale("S2", "A", 3, 330)], SCHEMA)
    mapping = spark.createDataFrame([("S1", "P ONE"), ("S1", "P TWO"), ("S2", "Q 100%_A"), ("S3", "NOBODY")], "SalesDevice string, SentimentDevice string")
    got = {r["DEVICE"]: r for r in profile.device_profile(reviews, sales, mapping).collect()}
    assert got["S1"]["REVIEW_COUNT"] == 6 and got["S1"]["NET_SENTIMENT"] == 0.0 and tuple(got["S1"]["STARS"]) == (2, 1, 2)
    assert got["S1"]["TOP_SPECS"] == "alt" and got["S1"]["ASP"] == 100.0 and got["S1"]["RATING_BATTERY"] == 0.0
    assert got["S3"]["NET_SENTIMENT"] is None
    card = profile.competitor_cards(reviews, sales, mapping).filter("FOCAL_SERIES = 'S1'").first()
    assert (card["Series"], card["DISPLAY_NAME"], card["COMPETITOR_ASP"]) == ("S2", "OEM S2", 110.0)
    beside = {r["MEASURE"]: (r["FIRST"], r["SECOND"]) for r in profile.side_by_side(profile.device_profile(reviews, sales, mapping), "S1", "S2").collect()}
    assert beside["REVIEW_COUNT"] == ("6", "2")


def test_a_device_that_is_a_review_name_has_its_own_reviews(spark):
    from reviewlens.operators.profile import _device_sums
    mapping = spark.createDataFrame([("T", "T"), ("T", "T2"), ("S", "T"), ("S", "T2")], "SalesDevice string, SentimentDevice string")
    reviews = spark.createDataFrame([("T", 1), ("T2", -1)], "Product_Family string, Sentiment_Score int")
    assert {r["DEVICE"]: r["row_count"] for r in _device_sums(reviews, mapping).collect()} == {"T": 1, "S": 2}


def test_sets_of_names(spark, reviews):
    """Two review names and two series as one device: every fact once, however many ways lead to it."""
    from reviewlens.operators import names as nm
    sales = spark.createDataFrame([sale("S1", "A", 10, 1000, "big"), sale("S1", "A", 10, 1000, "alt"), sale("S2", "A", 11, 330, "alt"), sale("S3", "A", 5, 60)], SCHEMA)
    mapping = spark.createDataFrame([("S1", "P ONE"), ("S1", "P TWO"), ("S2", "P TWO"), ("S3", "Q 100%_A"), (None, "X"), ("Y", None)], "SalesDevice string, SentimentDevice string")
    groups = nm.name_groups(mapping)
    assert sorted(map(tuple, groups.collect())) == [
        ("S1", "review", "P ONE"), ("S1", "review", "P TWO"), ("S1", "sales", "S1"), ("S1", "sales", "S2"), ("S3", "review", "Q 100%_A"), ("S3", "sales", "S3")]
    got = {r["DEVICE"]: r for r in profile.set_profile(reviews, sales, groups.union(groups)).collect()}
    assert got["S1"]["REVIEW_COUNT"] == 6 and got["S1"]["SALES_UNITS_K"] == 0.031 and got["S1"]["TOP_SPECS"] == "alt" and got["S1"]["TOP_SPECS_UNITS_K"] == 0.021
    card = profile.set_competitors(reviews, sales, groups, mapping).filter("FOCAL_SERIES = 'S1'").collect()
    assert [c["Series"] for c in card] == ["S3"]
    stated = spark.createDataFrame([("MINE", "P ONE"), ("MINE", "P TWO"), ("MINE", "NOBODY"), ("MINE", None)], "DEVICE string, NAME string")
    assert sorted(map(tuple, nm.sets_of_names(stated, mapping).collect())) == [
        ("MINE", "review", "NOBODY"), ("MINE", "review", "P ONE"), ("MINE", "review", "P TWO"), ("MINE", "sales", "S1")]
    beside = {r["MEASURE"]: (r["FIRST"], r["SECOND"]) for r in profile.side_by_side(profile.set_profile(reviews, sales, groups), "S1", "S3").collect()}
    assert beside["REVIEW_COUNT"] == ("6", "2")


def test_names_linked_over_several_rows(spark):
    from reviewlens.operators import names as nm
    chain = [(f"S{i:02d}", f"R{i + j:02d}") for i in range(30) for j in (0, 1)]
    got = nm.name_groups(spark.createDataFrame(chain, "SalesDevice string, SentimentDevice string")).collect()
    assert {r["DEVICE"] for r in got} == {"S00"} and len(got) == 61
    assert nm.name_groups(spark.createDataFrame([], "SalesDevice string, SentimentDevice string")).collect() == []
