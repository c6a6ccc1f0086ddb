"""Quality rules whose cutoffs are held to a risk by labelled documents, with SQL functions only.

A rule rejects documents whose measure passes a cutoff. For every stratum, rule and cutoff of a ladder, the documents labelled good
that would be rejected are counted; a cutoff may be used when the exact binomial test rules out that more than the rule's share of
the allowed rate of good documents falls to it. The level of the tests is divided by their number over all strata, rules and
cutoffs, and the allowed rate by the number of rules, so with the stated confidence no stratum loses more than ``RATE`` of its
good documents to all rules together. The strictest cutoff that may be used is; where none may, the rule rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.sources.storage import cut_lineage

#: Good documents of a stratum that may be lost, and the chance that more are.
RATE, LEVEL = 0.05, 0.05
#: Rule, measure, and ladder of cutoffs from strict to lenient; a measure above its cutoff is rejected.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3)),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    "long_words": ("word_chars / greatest(n_words, 1)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-5.0, -4.5, -4.0, -3.5, -3.0, -2.0)),
}
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def window_hashes(words: Column) -> Column:
    """The hash of the window of three words that begins at each word but the last two."""
    return F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def sorted_windows(words: Column, hashes: Column) -> Column:
    """All windows by a hash, a second hash, and place, so that equal ones become neighbours: n log n steps whatever repeats."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.crc32(F.concat_ws(" ", *_window(words, i)).cast("binary")).alias("g"), i.alias("i"))))


def _covered(words: Column, keys: Column) -> Column:
    """Words that lie in a window found twice or more. Neighbours count as equal where their words are."""
    def same(k, j):
        other = F.get(keys, j)
        equal = (k["h"] == other["h"]) & (k["g"] == other["g"])
        for mine, its in zip(_window(words, k["i"]), _window(words, other["i"])):
            equal = equal & (mine == its)
        return F.coalesce(equal, F.lit(False))
    twice = F.filter(keys, lambda k, j: same(k, j - 1) | same(k, j + 1))
    places = F.sort_array(F.transform(twice, lambda k: k["i"].cast("long")))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(places, start, lambda s, p: F.struct((s["sum"] + p + 3 - F.greatest(p, s["end"])).alias("sum"), (p + 3).alias("end")), lambda s: s["sum"])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed of every row of ``docs``
    (doc_id, text, lang). A null text has no words; a null language is a stratum by the name ''. No row moves."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "stratum", F.array_remove(F.split("text", _SPACE, -1), "").alias("words"), lines.alias("lines"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"))
    rows = rows.withColumn("n", F.size("words")).withColumn("hashes", F.when(F.col("n") > 3, window_hashes(F.col("words"))))
    # Most texts repeat no window; a hash set tells so, and spares them the sort.
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    rows = rows.withColumn("found", F.when(repeats, sorted_windows(F.col("words"), F.col("hashes"))))
    rows = rows.select(
        "doc_id", "stratum", F.col("n").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("words"), F.col("found")), F.lit(0)).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"))
    return rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series, moved up by ten."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    product = x
    for k in range(1, 10):
        product = product * (x + k)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """The chance of at most k of n at this rate, for k below the mean; at and above it 1 is given. The terms are added from k
    downwards, of which those beyond the first 100,000 weigh nothing at any n below 10^9."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    terms = F.when(k >= 1, F.sequence(k.cast("long"), F.greatest(F.lit(1), k.cast("long") - 100_000), F.lit(-1).cast("long"))).otherwise(
        F.expr("cast(array() as array<bigint>)"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * i / (n - i + 1) * ((1 - rate) / rate)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))
    return F.when((n > 0) & (k < n * rate), F.exp(top) * F.aggregate(terms, start, add, lambda s: s["sum"])).otherwise(1.0)


def cutoffs(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, rule, cutoff): the strictest cutoffs that the labelled rows allow. Rows that fail the base anyway do not count. A
    doc_id with several labels is good only if all say so."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = measured.filter("not base_failed").join(good, "doc_id")
    tried = sum(len(ladder) for _, ladder in RULES.values())
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *(
        F.count_if(F.expr(measure) > cutoff).alias(f"{rule}_{k}") for rule, (measure, ladder) in RULES.items() for k, cutoff in enumerate(ladder)))
    listed = F.explode(F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.lit(cutoff).alias("cutoff"), F.col(f"{rule}_{k}").alias("lost"))
        for rule, (_, ladder) in RULES.items() for k, cutoff in enumerate(ladder))))
    strata = F.count("*").over(Window.partitionBy(F.lit(0))).alias("strata")  # a row a stratum
    tests = counts.withColumn("strata", strata).select("stratum", "n", "strata", listed.alias("test")).select("stratum", "n", "strata", "test.*")
    allowed = tests.filter(binomial_tail(F.col("lost"), F.col("n"), RATE / len(RULES)) <= LEVEL / (F.col("strata") * tried))
    return allowed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measure every row and say whether it is kept: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (fewer than 50 words, or more than half of them repeated) and kept (not failed, and no rule with a cutoff for its stratum
    rejects it). Strata without labels have no cutoffs. Equal rows stay as many as they are."""
    measured = cut_lineage(measures(docs))
    chosen = cutoffs(measured, labels).groupBy(F.col("stratum").alias("of")).agg(
        *(F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"limit_{rule}") for rule in RULES))
    rejected = F.lit(False)
    for rule, (measure, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(measure) > F.col(f"limit_{rule}"), F.lit(False))
    return measured.join(chosen, F.col("stratum") == F.col("of"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
