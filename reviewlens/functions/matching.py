"""Text predicates. Search text is always literal: ``%``, ``_`` and regex signs match themselves."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reviewlens.functions.scoring import as_column
from reviewlens.functions.vocabulary import NOISE_ASPECTS, TOTAL, UNKNOWN


def mark_folded(df: DataFrame, *cols: str) -> DataFrame:
    """The same rows, whose columns say that they hold upper-case text. Operators then compare them as they are, so that Parquet scans
    take the filters. The mark is part of the schema: it is stored with Parquet and lasts until the column is made anew."""
    return df.withColumns({c: F.col(c).alias(c, metadata={**df.schema[c].metadata, "folded": True}) for c in cols if c in df.columns})


def is_folded(df: DataFrame, col: str) -> bool:
    """Whether a column is known to hold upper-case text."""
    return col in df.columns and bool(df.schema[col].metadata.get("folded"))


def ci_contains(col: str | Column, text: str, folded: bool = False) -> Column:
    """Case-insensitive contains.

    With ``folded=True`` the column is known to hold upper-case text already, so the predicate
    stays a bare ``contains`` that Parquet scans accept as a pushed filter.
    """
    subject = as_column(col)
    return (subject if folded else F.upper(subject)).contains(text.upper())


def ci_equals(col: str | Column, text: str, folded: bool = False) -> Column:
    subject = as_column(col)
    return (subject if folded else F.upper(subject)) == text.upper()


def ci_match(col: str | Column, text: str, match: str = "contains", folded: bool = False) -> Column:
    if match == "contains":
        return ci_contains(col, text, folded)
    if match == "equals":
        return ci_equals(col, text, folded)
    raise ValueError(f"match must be 'contains' or 'equals', not {match!r}")


def any_contains(col: str | Column, texts: Sequence[str], folded: bool = False) -> Column:
    if not texts:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [ci_contains(col, t, folded) for t in texts])


def apply_filters(df: DataFrame, filters: Iterable[tuple], folded: bool = False) -> DataFrame:
    """Conjunction of filters ``(column, text)`` or ``(column, kind, value)``: ``contains`` (the kind of a pair), ``equals`` and ``not``
    take a text, ``in`` a list of texts. Case does not count. A null counts as the text ``Unknown``. Columns that are marked as
    folded, or all with ``folded``, are compared as they are."""
    known = {f.name for f in df.schema.fields if folded or is_folded(df, f.name)}
    for col, *rest in filters:
        folded = col in known
        kind, value = rest if len(rest) == 2 else ("contains", rest[0])
        if kind not in ("contains", "equals", "not", "in"):
            raise ValueError(f"unknown kind of filter: {kind!r}")
        texts = list(value) if kind == "in" else [value]
        subject = F.col(col) if folded else F.upper(F.col(col))
        if kind == "contains":
            hit, null = ci_contains(col, value, folded), value.upper() in UNKNOWN.upper()
        else:
            hit, null = subject.isin(*[t.upper() for t in texts]), UNKNOWN.upper() in [t.upper() for t in texts]
        if kind == "not":
            hit, null = ~hit, not null
        df = df.filter(hit | F.col(col).isNull() if null else hit)
    return df


def drop_noise_aspects(df: DataFrame, aspect: str = "ASPECT", result: str | None = "ASPECT_SENTIMENT",
                       noise: Sequence[str] = NOISE_ASPECTS) -> DataFrame:
    """Rows with a result whose aspect is about the product. A null aspect is kept."""
    kept = df.dropna(subset=[result]) if result else df
    return kept.filter(~F.coalesce(F.col(aspect).isin(*noise), F.lit(False)))


def drop_total_rows(df: DataFrame, label: str = TOTAL) -> DataFrame:
    """Drop rows in which any text column equals the total label."""
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            df = df.filter(~F.coalesce(F.col(f"`{field.name}`") == label, F.lit(False)))
    return df


def valid_sales(units: str = "Sales_Units", price: str = "ASP") -> Column:
    return (F.col(units) != 0) & (F.col(price) >= 0)
