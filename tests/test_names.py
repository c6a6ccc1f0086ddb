import random

import pytest

from reviewlens.functions.similarity import Letters, Name, common_subsequence, token_set_ratio
from reviewlens.functions.vocabulary import UNAVAILABLE
from reviewlens.operators import names as nm


def slow_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[len(a)][len(b)]


def slow_ratio(x, y):
    return 100.0 * 2 * slow_subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0


def slow_token_set(a, b):
    a, b = set(a.split()), set(b.split())
    if not a or not b:
        return 0.0
    common = " ".join(sorted(a & b))
    left = " ".join([common] * bool(common) + sorted(a - b))
    right = " ".join([common] * bool(common) + sorted(b - a))
    if common and (not a - b or not b - a):
        return 100.0
    pairs = [(left, right)] + ([(common, left), (common, right)] if common else [])
    return max(slow_ratio(*p) for p in pairs)


def words(rnd, n):
    return " ".join("".join(rnd.choice("ABC1") for _ in range(rnd.randint(1, 5))) for _ in range(n))


@pytest.mark.parametrize("seed", range(5))
def test_similarity_matches_plain_dynamic_programming(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        a, b = words(rnd, rnd.randint(0, 4)), words(rnd, rnd.randint(0, 4))
        assert common_subsequence(a, b) == slow_subsequence(a, b)
        assert token_set_ratio(Name(a), Name(b)) == pytest.approx(slow_token_set(a, b))
        assert token_set_ratio(Name(a), Name(b)) == pytest.approx(token_set_ratio(Name(b), Name(a)))
        assert 0 <= token_set_ratio(Name(a), Name(b)) <= 100


def test_equal_word_sets_score_full():
    assert token_set_ratio(Name("B A"), Name("A B A")) == 100.0


@pytest.mark.parametrize("seed", range(3))
def test_letters_skip_nothing(seed):
    rnd = random.Random(seed)
    names = sorted({words(rnd, rnd.randint(1, 3)) for _ in range(40)} | {"A" * 70 + " B", "ÀÉ 日本"})
    letters = Letters(names)
    for _ in range(60):
        m = rnd.choice([words(rnd, rnd.randint(1, 4)), "B" + "A" * 66, "日本 A"])
        for least in (0, 50, 80, 99):
            at, score = letters.alike(m, least)
            got = {names[i]: s for i, s in zip(at, score) if s >= least}
            # Scores from common words alone are the business of the join on words.
            full = {n: max(slow_token_set(m, n), 0) for n in names}
            assert all(got[n] == pytest.approx(full[n]) for n in got)
            for n in names:
                x, y = Name(m).sorted, Name(n).sorted
                if not set(m.split()) & set(n.split()) and slow_ratio(x, y) >= least + 1e-6:
                    assert n in got


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([("ORBIT GO",), ("ORBIT GO 3",), ("QUASAR 55",), ("UNDEFINED",), ("PAD",)], "name string")


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, "is the orbit go 3 better than quasar 55 or pad"), (2, "nothing here"), (3, None),
                                  (4, "x" * 30_000 + " pad"), (5, "padpad")], "text_id int, text string")


def test_mentions_longest_first(texts, catalog):
    got = sorted(tuple(r) for r in nm.detect_mentions(texts, catalog).collect())
    assert got == [(1, "ORBIT GO 3", 1), (1, "QUASAR 55", 2), (4, "PAD", 1), (5, "PAD", 1)]
    everything = nm.detect_mentions(texts, catalog, None).filter("text_id = 1").count()
    assert everything == 4


def contained(texts, names, k):
    out = []
    for i, t in texts:
        hits = sorted({n.upper() for n in names if n and n.upper() in (t or "").upper()}, key=lambda n: (-len(n), n))
        out += [(i, n, r + 1) for r, n in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, None])
def test_mentions_against_a_plain_search(spark, k):
    rnd = random.Random(5)
    names = {words(rnd, rnd.randint(1, 3)).lower() for _ in range(80)} | {"é", "日本 x", "a", "ab c", ""}
    rows = [(i, " ".join(words(rnd, 4) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "É", " 日本 X ", "straße"])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "Ab c" * 5000)]
    texts = spark.createDataFrame([(*r, 1) for r in rows], "text_id long, text string, NAME int").repartition(3)
    got = nm.detect_mentions(texts, spark.createDataFrame([(n,) for n in names], "name string"), k)
    assert sorted(map(tuple, got.collect())) == contained(rows, names, k)
    assert nm.detect_mentions(texts.limit(0), spark.createDataFrame([("a",)], "name string")).collect() == []
    assert nm.detect_mentions(texts, spark.createDataFrame([], "name string")).collect() == []


def test_texts_are_read_once_whatever_the_catalog(spark, tmp_path):
    spark.range(3000).selectExpr("id as text_id", "concat('about n', id % 700, 'x') as text").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    catalog = spark.range(20000).selectExpr("concat('n', id, 'x') as name")
    found = nm.detect_mentions(texts, catalog, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert found.count() == 3000


@pytest.mark.parametrize("mode, low", [("best", 60), ("all", 50), ("all", 80), ("all", 0), ("best", 95)])
def test_fuzzy_against_all_pairs(spark, mode, low):
    rnd = random.Random(9)
    names = sorted({words(rnd, rnd.randint(1, 4)) for _ in range(90)} | {"", " ", "C" * 80})
    asked = sorted({words(rnd, rnd.randint(1, 4)).lower() for _ in range(70)} | {"", "c" * 79, "a " * 50})
    rows = [(m.upper(), n, slow_token_set(m.upper(), n)) for m in asked for n in names if m.split() and n.split()]
    if mode == "all":
        want = [r for r in rows if r[2] > low]
    else:
        want = [min((r for r in rows if r[0] == m), key=lambda r: (-round(r[2], 9), r[1])) for m in sorted({r[0] for r in rows})]
        want = [r for r in want if r[2] >= low]
    got = nm.fuzzy_match(spark.createDataFrame([(m, 1.0) for m in asked] + [(None, 1.0)], "mention string, SCORE double"),
                         spark.createDataFrame([(n, 1) for n in names] + [(None, 1)], "name string, size int"), low, mode)
    assert [(m, n, round(s, 6)) for m, n, s in sorted(map(tuple, got.collect()))] == sorted((m, n, round(s, 6)) for m, n, s in want)


def test_candidates_grow_with_the_data(spark):
    """Four times the mentions and names, of words as rare as before, make about four times the pairs."""
    def pairs(n):
        names = spark.range(n).selectExpr("concat('MODEL K', id % (%d), ' L', id, ' EDITION') as text".replace("%d", str(n // 4)))
        asked = spark.range(n).selectExpr("concat('MODEL K', id % (%d), ' L', id) as text".replace("%d", str(n // 4)))
        return nm.word_candidates(nm._described(asked, "text"), nm._described(names, "text"), 0.9).count()
    small, large = pairs(200), pairs(800)
    assert small and large <= 4.5 * small


def test_mode_is_checked(spark, catalog):
    with pytest.raises(ValueError):
        nm.fuzzy_match(catalog, catalog, mode="some", mention="name")


def test_cascade(spark, catalog):
    reviewed = spark.createDataFrame([("ACME QUASAR 55 15",), ("TERN LODGE 15",)], "name string")
    asked = spark.createDataFrame([("about the tern lodge 15",), ("quasar acme 55",), ("my pad",), ("orbit 3 go",), ("undefined",), ("zzz",), (None,)],
                                  "mention string")
    got = {r["mention"]: (r["DEVICE"], r["STAGE"]) for r in nm.resolve_device(asked, reviewed, catalog).collect()}
    assert got == {
        "ABOUT THE TERN LODGE 15": ("TERN LODGE 15", 1), "QUASAR ACME 55": ("ACME QUASAR 55 15", 2), "MY PAD": ("PAD", 3),
        "ORBIT 3 GO": ("ORBIT GO", 4), "UNDEFINED": ("UNDEFINED", 4), "ZZZ": (UNAVAILABLE, 5)}


@pytest.fixture
def mapping(spark):
    return spark.createDataFrame([("S", "R1"), ("S", "R2"), ("T", "T"), ("U", "R1")], "SalesDevice string, SentimentDevice string")


def test_name_look_ups(spark, mapping, rows_of):
    asked = spark.createDataFrame([("S",), ("R1",), ("T",), ("?",), (None,)], "n string")
    assert rows_of(nm.to_sales_name(asked, mapping, "n")) == sorted([("S", "S"), ("R1", "S"), ("T", "T"), ("?", None), (None, None)], key=str)
    assert rows_of(nm.to_sentiment_name(asked, mapping, "n")) == sorted([("S", "R1"), ("R1", "R1"), ("T", "T"), ("?", None), (None, None)], key=str)
    assert rows_of(nm.to_sentiment_names(asked, mapping, "n")) == sorted(
        [("S", "R1"), ("S", "R2"), ("R1", "R1"), ("T", "T"), ("?", None), (None, None)], key=str)


def test_mapped_and_unmapped(spark, mapping):
    rows = spark.createDataFrame([("R1",), ("X",), ("R1",)], "f string")
    assert nm.restrict_to_mapped(rows, mapping, "f", "SentimentDevice").count() == 2
    assert nm.exclude_names(rows, mapping, "f", "SentimentDevice").count() == 1


def test_aliases(spark, rows_of):
    aliases = spark.createDataFrame([("geo", "USA", "US"), ("geo", " us ", "US"), ("product", "all", "A"), ("product", "ALL", "B")],
                                    "domain string, alias string, canonical string")
    df = spark.createDataFrame([(" usa",), ("Peru",), (None,)], "g string")
    assert rows_of(nm.canonicalize(df, "g", aliases, "geo")) == sorted([("US",), ("Peru",), (None,)], key=str)
    many = spark.createDataFrame([("all",)], "g string")
    assert rows_of(nm.canonicalize(many, "g", aliases, "product")) == [("A",), ("B",)]


def test_case_insensitive_join_is_an_equi_join(spark):
    a = spark.createDataFrame([("Ab%",)], "k string")
    b = spark.createDataFrame([("aB%", 1), ("abc", 2)], "j string, n int")
    joined = nm.ci_join(a, b, "k", "j")
    assert [r["n"] for r in joined.collect()] == [1]
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_names_meet_written_sides(spark, monkeypatch):
    """Blocks use a side several times; its bands are no part of that plan."""
    sides, real = [], nm.match_blocks
    monkeypatch.setattr(nm, "match_blocks", lambda left, right, *a: sides.extend([left, right]) or real(left, right, *a))
    names = spark.createDataFrame([("ORBIT GO",), ("QUASAR 55",)], "name string")
    nm.fuzzy_match(spark.createDataFrame([("orbit g",)], "mention string"), names)
    assert len(sides) == 2 and not any("Join" in s._jdf.queryExecution().optimizedPlan().toString() for s in sides)


def test_lists_made_from_names_are_not_broadcast(spark, monkeypatch):
    """A row for each word of a long mention, or for each name found in a text, is far more than Spark's estimate of it."""
    plans, real = [], nm.cut_lineage

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(nm, "cut_lineage", lambda df: real(plan(df)))
    names = spark.range(20).selectExpr("concat('MODEL L', id) as name")
    texts = spark.range(50).selectExpr("id as text_id", "concat(repeat('some words ', 40), 'MODEL L', id % 20) as text")
    pairs = plan(nm.word_candidates(nm._described(texts, "text"), nm._described(names, "name"), 0.6))
    found = plan(nm.detect_mentions(texts, names, 1))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("BroadcastHashJoin" in p or "NestedLoop" in p for p in plans)
    assert pairs.filter("endswith(mention, NAME)").select("mention").distinct().count() == 20 and found.count() == 50


def test_bands_of_long_mentions(spark):
    """A mention too long for every name is left out before bands are listed for it, and only the bounds of cells are broadcast."""
    names = nm._described(spark.createDataFrame([("ORBIT GO",), ("QUASAR 55",)], "name string"), "name")
    asked = nm._described(spark.createDataFrame([("ORBIT G",), ("X" * 3000,)], "name string"), "name").selectExpr("*", "60D as least")
    left, right = nm._bands(asked, names)
    assert {r["mention"] for r in left.collect()} == {"ORBIT G"} and right.count() == 2
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "Filter (FLOOR(" in plan
