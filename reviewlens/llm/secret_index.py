"""Secrets found through a trigram index, with SQL functions only.

Every rule is a regular expression. From its structure follows a Boolean query of trigrams that any match must hold; the postings of
the trigrams that the rules ask for are intersected row by row, and only candidates of a rule are searched with its expression. A
rule whose expression demands no trigram searches every text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of spans in the order in which they are named, and their expressions, which Java and Python read alike.
BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
MORE = {
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "web_token": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "url_login": r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@",
}
#: Group whose length a match must reach, for expressions that say so outside of themselves: a match that is too short still takes
#: its characters.
LEAST_GROUP = {"assign": (2, 6)}
#: Strings that are followed at once while an expression is read.
_MOST = 64

Clause = frozenset[frozenset[str]]


def _strings(kind, value) -> set[str] | None:
    """All strings that a node stands for, in lower case, if they are few."""
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 5:
        return {chr(v).lower() for _, v in value}
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 1:
        part = _sequence(value[2])
        return None if part is None else part | ({""} if value[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for kind, value in nodes:
        part = _strings(kind, value)
        if part is None or len(out) * len(part) > _MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def _clause(strings: set[str]) -> set[Clause]:
    """One of the strings must be there, so all trigrams of one of them must; nothing if one is too short to say anything."""
    if any(len(s) < 3 for s in strings):
        return set()
    ways = {frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings}
    return {frozenset(w for w in ways if not any(other < w for other in ways))}


def trigram_query(pattern: str) -> set[Clause]:
    """Clauses that must all hold; a clause holds if all trigrams of one of its alternatives are in the lower-case text. No clauses:
    the expression demands nothing."""
    def read(nodes) -> set[Clause]:
        clauses, current = set(), {""}
        for kind, value in nodes:
            part = _strings(kind, value)
            if part is not None and len(current) * len(part) <= _MOST:
                current = {a + b for a in current for b in part}
                continue
            clauses |= _clause(current)
            current = {""} if part is None else part
            if part is None and kind is op.SUBPATTERN:
                clauses |= read(value[3])
            elif part is None and kind is op.MAX_REPEAT and value[0] > 0:
                clauses |= read(value[2])
            elif part is None and kind is op.BRANCH:
                each = [read(branch) for branch in value[1]]
                if all(each):
                    clauses.add(frozenset().union(*(min(c, key=len) for c in each)))
        return clauses | _clause(current)
    return read(parser.parse(pattern))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of these trigrams over lower-case texts: (trigram, row_key). Each row is read once."""
    lowered = docs.select("row_key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    return lowered.select("row_key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """(row_key, rules): the rules with a trigram query that a text (row_key, text) meets. Postings move once, to the rows they are
    of, where alternatives, clauses and rules are counted one after the other; the query table is as small as the rules."""
    queries = {rule: trigram_query(pattern) for rule, pattern in rules.items()}
    asked = [(rule, c, a, trigram, len(way), len(query)) for rule, query in queries.items() for c, clause in enumerate(sorted(query, key=str))
             for a, way in enumerate(sorted(clause, key=str)) for trigram in sorted(way)]
    wanted = docs.sparkSession.createDataFrame(asked, "rule string, clause int, way int, trigram string, needed int, clauses int")
    index = postings(docs, sorted({row[3] for row in asked})).distinct().repartition("row_key")
    ways = (index.join(F.broadcast(wanted), "trigram").groupBy("row_key", "rule", "clauses", "clause", "way", "needed").count()  # the rules
            .filter("count = needed"))
    met = ways.groupBy("row_key", "rule", "clauses").agg(F.countDistinct("clause").alias("n")).filter("n = clauses")
    return met.groupBy("row_key").agg(F.collect_set("rule").alias("rules"))


def spans(kind: str, pattern: str) -> Column:
    """Matches in the column text as (start, rank, kind, end) in code points: the pieces between matches give the places."""
    expression = F.lit(pattern)
    pieces, matches = F.split("text", pattern, -1), F.regexp_extract_all("text", expression, F.lit(0))
    group, least = LEAST_GROUP.get(kind, (0, 1))
    told = F.regexp_extract_all("text", expression, F.lit(group)) if group else matches
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("before"), matches.alias("match"), told.alias("told"))
    rank = list(BASE | MORE).index(kind)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)").alias("out"))

    def add(state: Column, row: Column) -> Column:
        begin = state["at"] + F.char_length(row["before"])
        end = begin + F.char_length(row["match"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        fits = F.char_length(row["told"]) >= least
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))
    return F.aggregate(rows, start, add, lambda s: s["out"])


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, more: Mapping[str, str] = MORE) -> DataFrame:
    """Find the spans of all rules in every text of ``docs`` (doc_id, text); a null text is empty. Returns doc_id, n_assign, n_access,
    n_hex, base_sha256 (of the base spans as kind:start:end, by start and then kind, comma-joined), spans (all of them, alike) and
    n_more. Equal rows each have a row. Spans of different rules may overlap; those of one do not.

    Rows are named by a hash of id and text; should two share one, they share candidates and each is searched for both.
    """
    rules = BASE | dict(more)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = rows.join(candidates(rows.select("row_key", "text"), rules).withColumnRenamed("row_key", "of"), F.col("row_key") == F.col("of"), "left")
    nothing = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    searched = found.select("doc_id", *(
        (F.when(F.array_contains("rules", kind), spans(kind, pattern)).otherwise(nothing) if trigram_query(pattern) else spans(kind, pattern))
        .alias(kind) for kind, pattern in rules.items()))
    base = reduce(F.concat, (F.col(kind) for kind in BASE))
    extra = reduce(F.concat, (F.col(kind) for kind in more), nothing)
    named = searched.select("doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE), _joined(base).alias("base"),
                            _joined(F.concat(base, extra)).alias("spans"), F.size(extra).cast("long").alias("n_more"))
    return named.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_more")
