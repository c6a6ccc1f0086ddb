"""Names: mapping tables, aliases, mentions in text, fuzzy matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.functions.arrow import bloom, steps
from reviewlens.functions.similarity import Letters, Name, token_set_ratio
from reviewlens.functions.vocabulary import UNAVAILABLE
from reviewlens.functions.windows import find, name_keys
from reviewlens.operators.blocks import FEW_CELLS, match_blocks
from reviewlens.operators.graphs import components
from reviewlens.operators.grouping import first_rows, spread
from reviewlens.sources.storage import cut_lineage

# Copies of a name that a found window may meet, so that a name in a third of all texts is no single key.
SALTS = 16
# Letters by which names are laid into bands of length and of two kinds of letters.
BAND = 6


def restrict_to_mapped(df: DataFrame, mapping: DataFrame, col: str, mapping_col: str) -> DataFrame:
    """Rows whose name appears in the mapping."""
    names = mapping.select(F.col(mapping_col).alias(col)).distinct()
    return df.join(names, col, "left_semi")


def exclude_names(df: DataFrame, names: DataFrame, col: str, names_col: str) -> DataFrame:
    """Rows whose name does not appear in another table."""
    return df.join(names.select(F.col(names_col).alias(col)).distinct(), col, "left_anti")


def ci_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Case-insensitive key join as an equi-join on folded keys."""
    return left.join(right, F.upper(left[left_key]) == F.upper(right[right_key]), how)


def _first_value(mapping: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """One value per name: from the first column pair, else from the second."""
    def pairs(key: str, value: str) -> DataFrame:
        return mapping.groupBy(F.col(key).alias("_name")).agg(F.min(value).alias("_value"))

    main, other = pairs(*first), pairs(*second)
    return main.unionByName(other.join(main, "_name", "left_anti"))


def _look_up(df: DataFrame, lookup: DataFrame, col: str, out: str) -> DataFrame:
    return df.join(lookup, F.col(col) == F.col("_name"), "left").drop("_name").withColumnRenamed("_value", out)


def to_sales_name(df: DataFrame, mapping: DataFrame, col: str, out: str = "SALES_NAME") -> DataFrame:
    """Sales name of a review name or of a sales name; null when unknown. Smallest name of several."""
    lookup = _first_value(mapping, ("SentimentDevice", "SalesDevice"), ("SalesDevice", "SalesDevice"))
    return _look_up(df, lookup, col, out)


def to_sentiment_name(df: DataFrame, mapping: DataFrame, col: str, out: str = "SENTIMENT_NAME") -> DataFrame:
    lookup = _first_value(mapping, ("SentimentDevice", "SentimentDevice"), ("SalesDevice", "SentimentDevice"))
    return _look_up(df, lookup, col, out)


def to_sentiment_names(df: DataFrame, mapping: DataFrame, col: str, out: str = "SENTIMENT_NAME") -> DataFrame:
    """All review names of a name, one row each; a review name stands for itself."""
    own = mapping.select(F.col("SentimentDevice").alias("_name"), F.col("SentimentDevice").alias("_value")).distinct()
    sold = mapping.select(F.col("SalesDevice").alias("_name"), F.col("SentimentDevice").alias("_value")).distinct()
    lookup = own.unionByName(sold.join(own.select("_name"), "_name", "left_anti"))
    return _look_up(df, lookup, col, out)


def name_groups(mapping: DataFrame) -> DataFrame:
    """The sales and review names that belong together: ``DEVICE, KIND, NAME``, one row for each name of a group.

    Names that a row of the mapping (SalesDevice, SentimentDevice) puts beside each other are of one group, and so are all that can
    be reached over several rows. A group goes by its first sales name; KIND is ``sales`` or ``review``. A text that is both a sales
    and a review name is two names, which belong together only if the mapping says so. Rows without either name say nothing.
    """
    pairs = mapping.select("SalesDevice", "SentimentDevice").filter("SalesDevice IS NOT NULL AND SentimentDevice IS NOT NULL").distinct()
    # Sales names sort before review names, so the smallest node of a group is its first sales name.
    edges = pairs.select(F.concat(F.lit("0"), "SalesDevice").alias("a"), F.concat(F.lit("1"), "SentimentDevice").alias("b"))
    found = components(edges, cut_lineage)
    nodes = found.union(found.select(F.col("component").alias("node"), "component")).distinct()
    return nodes.select(F.expr("substring(component, 2)").alias("DEVICE"),
                        F.when(F.col("node").startswith("0"), "sales").otherwise("review").alias("KIND"), F.expr("substring(node, 2)").alias("NAME"))


def sets_of_names(sets: DataFrame, mapping: DataFrame, device: str = "DEVICE", name: str = "NAME") -> DataFrame:
    """Stated sets of review names (DEVICE, NAME), as fuzzy matching gives them, with the sales names that they are sold by:
    ``DEVICE, KIND, NAME``, each once. A review name without a sales name stays a review name."""
    named = sets.select(F.col(device).alias("DEVICE"), F.col(name).alias("NAME")).filter("NAME IS NOT NULL").distinct()
    sold = to_sales_name(named, mapping, "NAME").filter("SALES_NAME IS NOT NULL").select("DEVICE", F.lit("sales").alias("KIND"), F.col("SALES_NAME").alias("NAME"))
    return named.select("DEVICE", F.lit("review").alias("KIND"), "NAME").union(sold).distinct()


def canonicalize(df: DataFrame, col: str, aliases: DataFrame, domain: str | None = None) -> DataFrame:
    """Replace aliases by canonical names. An alias with several canonical names gives a row for each."""
    known = aliases if domain is None else aliases.filter(F.col("domain") == domain)
    known = known.select(F.lower(F.trim("alias")).alias("_alias"), F.col("canonical").alias("_canonical")).distinct()
    joined = df.join(known, F.lower(F.trim(F.col(col))) == F.col("_alias"), "left")
    return joined.withColumn(col, F.coalesce("_canonical", col)).drop("_alias", "_canonical")


def detect_mentions(texts: DataFrame, catalog: DataFrame, k: int | None = 2, text_id: str = "text_id",
                    text: str = "text", name: str = "name") -> DataFrame:
    """Catalog names contained in each text, longest first, equally long ones by name.

    Returns ``text_id, NAME, MENTION_RANK`` with at most ``k`` rows per text. Texts are read once, whatever the size of the
    catalog: a text hands on its windows that pass two Bloom filters of a fixed size, of the first bytes of the names and of whole
    names, and these meet the names in an equi-join. Rows with one id are one text; a null text mentions nothing.
    """
    names = cut_lineage(catalog.select(F.upper(name).alias("NAME")).filter(F.length("NAME") > 0).distinct())
    upper = texts.select(F.col(text_id).alias("text_id"), F.upper(text).alias("text")).filter(F.length("text") > 0)
    kind = upper.schema["text_id"].dataType.simpleString()
    # One number for each length that names have.
    sizes = sorted(r[0] for r in names.select(F.octet_length("NAME")).distinct().collect())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "NAME"):
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)) for k in name_keys(batch.column("NAME").cast(pa.binary()).to_pylist())], ["head", "whole"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            body = batch.column("text").cast(pa.large_binary()).to_pylist()
            data, ends = np.frombuffer(b"".join(body), np.uint8), np.cumsum([len(b) for b in body])
            owner, at, size = find(data, ends, sizes, heads, wholes)
            hits = [data[b:b + n].tobytes() for b, n in zip(at, size)]
            yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(owner)), pa.array(hits, pa.binary()).cast(pa.string())], ["text_id", "NAME"])

    keyed = cut_lineage(names.mapInArrow(keys, "head long, whole long"))
    heads, wholes = (bloom(keyed.select(F.col(c).alias("key")).distinct()) for c in ("head", "whole"))
    found = upper.mapInArrow(search, f"text_id {kind}, NAME string").withColumn("salt", F.pmod(F.xxhash64("text_id"), F.lit(SALTS)))
    copies = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    kept = _merged(found, copies, "NAME", "salt").select("text_id", "NAME").distinct()
    order = [F.desc(F.length("NAME")), F.asc("NAME")]
    # Without k a text still has at most as many rows as the catalog has names.
    return first_rows(kept, ["text_id"], order, 2**31 - 1 if k is None else k, "MENTION_RANK").select(
        F.col("text_id").alias(text_id), "NAME", F.col("MENTION_RANK").cast("int").alias("MENTION_RANK"))


def _merged(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """An inner join that sends neither side through the driver. Spark takes what is made from names, such as a row for each word, to
    be no larger than the files behind it, and would broadcast lists that are hundreds of times that."""
    return left.join(right.hint("merge"), list(keys))


def _described(names: DataFrame, col: str) -> DataFrame:
    """Distinct names with their words, their length as sorted words, how many of the letters are of two kinds (by code point), and a
    number, by which steps refer to a name that may be a long text."""
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [Name(t) for t in batch["text"]]
            yield pd.DataFrame({
                "text": batch["text"], "words": [sorted(n.words) for n in own], "size": [len(n.sorted) for n in own],
                "kind_a": [sum(ord(c) % 3 == 0 for c in n.sorted) for n in own], "kind_b": [sum(ord(c) % 3 == 1 for c in n.sorted) for n in own]})
    distinct = names.select(F.col(col).alias("text")).filter("text is not null").distinct()
    described = spread(distinct, "text").mapInPandas(describe, "text string, words array<string>, size int, kind_a int, kind_b int").filter("size > 0")
    return cut_lineage(described.withColumn("id", F.monotonically_increasing_id()))


def word_candidates(asked: DataFrame, known: DataFrame, share: Column | float) -> DataFrame:
    """Pairs (mention, NAME) of described names whose common words can make up the score ``share`` (0 to 1) by themselves.

    Words in common, laid in a row, score against a whole name of n letters by 2 i / (i + n), so they need i >= s n / (2 - s)
    letters. A name therefore need not look for its most frequent words as long as these together are shorter than that: whatever
    else reaches the score has one of the others. Either side looks with its rare words among all words of the other.
    """
    def listed(side: DataFrame) -> DataFrame:
        return side.select("id", "size", F.explode("words").alias("word"))

    def shared(side: DataFrame, other: DataFrame) -> DataFrame:
        """The words of a side that the other has too, with how often that has them."""
        return cut_lineage(_merged(listed(side), other.groupBy("word").agg(F.count(F.lit(1)).alias("often")), "word"))

    def rare(side: DataFrame) -> DataFrame:
        own = Window.partitionBy("id").orderBy(F.desc("often"), "word")  # the words of one name
        row = F.sum(F.length("word") + 1).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
        least = F.col("size") * share / (2 - share) - 1e-9
        return side.withColumn("row", row).filter(F.col("row") >= least)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        # Few bytes of words may make many pairs.
        return _merged(spread(left.select(F.col("id").alias("asked"), "word"), "word"), right.select(F.col("id").alias("known"), "word"), "word").select("asked", "known")

    left = shared(asked, listed(known))
    right = shared(known, left)
    pairs = met(rare(left), right).union(met(left, rare(right))).distinct()
    named = _merged(pairs, known.select(F.col("id").alias("known"), F.col("text").alias("NAME")), "known")
    return _merged(named, asked.select(F.col("id").alias("asked"), F.col("text").alias("mention")), "asked").select("mention", "NAME")


def _scored(pairs: DataFrame) -> DataFrame:
    """The token-set ratio of each pair."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = {t: Name(t) for c in ("mention", "NAME") for t in batch[c].unique()}
            yield batch.assign(SCORE=[token_set_ratio(own[m], own[n]) for m, n in zip(batch["mention"], batch["NAME"])])
    return spread(pairs, "mention", "NAME").mapInPandas(score, "mention string, NAME string, SCORE double")


def _bands(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions (with ``least``, the score wanted) and names by the bands of names that they must look into.

    Turning one name into another takes at least as many insertions and deletions as their numbers of letters of any kind differ
    by, and a score s allows (1 - s) (n + m) of them; a band is left out where its bounds alone need more. Bands follow from
    lengths, not from rows: their number does not grow with the catalog.
    """
    banded = known.select("text", "size", "kind_a", "kind_b", *(F.floor(F.col(c) / BAND).alias(f"band_{c}") for c in ("size", "kind_a", "kind_b")))
    cells = banded.groupBy("band_size", "band_kind_a", "band_kind_b").agg(
        *(f(c).alias(f"{f.__name__}_{c}") for c in ("size", "kind_a", "kind_b") for f in (F.min, F.max)),
        *(f(F.col("size") - F.col("kind_a") - F.col("kind_b")).alias(f"{f.__name__}_rest") for f in (F.min, F.max)))
    cells = cut_lineage(cells)
    cells = F.broadcast(cells) if cells.count() <= FEW_CELLS else cells.hint("merge")
    share = F.col("least") / 100
    longest = known.agg(F.max("size"))
    first = F.floor(F.col("size") * share / (2 - share) / BAND)
    last = F.floor(F.least(F.coalesce(F.try_divide(F.col("size") * (2 - share), share), longest.scalar()), longest.scalar()) / BAND)
    # A mention that is too long for every name looks nowhere; a sequence would count downwards for it.
    spans = (asked.select("text", "size", "kind_a", "kind_b", "least", (F.col("size") - F.col("kind_a") - F.col("kind_b")).alias("rest"), first.alias("first"), last.alias("last"))
             .filter("first <= last").withColumn("band_size", F.explode(F.sequence("first", "last"))))
    apart = sum((F.greatest(F.lit(0), F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}")) for c in ("kind_a", "kind_b", "rest")), F.lit(0))
    allowed = (1 - share) * (F.col("size") + F.col("max_size")) + 1e-9
    cell = F.concat_ws(",", "band_size", "band_kind_a", "band_kind_b").alias("cell")
    left = spans.join(cells, "band_size").filter(apart <= allowed).select(F.col("text").alias("mention"), "least", cell)
    return left, banded.select(F.col("text").alias("NAME"), cell)


def _alike(mode: str):
    """Names of a block that score as high as the mentions of another want."""
    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            letters = Letters(sorted(right["NAME"]))
            for mention, least in zip(left["mention"], left["least"]):
                at, score = letters.alike(mention, least)
                keep = score > least if mode == "all" else score >= least
                at, score = at[keep], score[keep]
                if mode == "best" and len(at):
                    at, score = at[[score.argmax()]], score[[score.argmax()]]  # names come in order
                rows += [(mention, letters.names[i].text, s) for i, s in zip(at, score)]
        return pd.DataFrame(rows, columns=["mention", "NAME", "SCORE"], dtype=object)
    return match


def fuzzy_match(mentions: DataFrame, catalog: DataFrame, min_score: float = 60, mode: str = "best",
                mention: str = "mention", name: str = "name") -> DataFrame:
    """Catalog names alike a mention by token-set ratio: ``mention, NAME, SCORE``.

    ``mode='best'`` keeps the best name when it scores at least ``min_score``, the first by name of several; ``mode='all'`` keeps
    every name that scores above it. Mentions are folded to upper case; a mention or a name without words matches nothing.

    Pairs are not tried out. A score comes either from words in common, which an equi-join on rare words finds (see
    ``word_candidates``), or from letters in common, for which names lie in bands of length and of letter counts (see ``_bands``);
    ``best`` looks there only for more than the words have given, and not at all beside a full score.
    """
    if mode not in ("best", "all"):
        raise ValueError(f"mode must be 'best' or 'all', not {mode!r}")
    asked = _described(mentions.select(F.upper(mention).alias("text")), "text")
    known = _described(catalog, name)
    enough = F.col("SCORE") > min_score if mode == "all" else F.col("SCORE") >= min_score
    by_words = cut_lineage(_scored(word_candidates(asked, known, min_score / 100)).filter(enough))
    wanted = asked.withColumn("least", F.lit(float(min_score)))
    if mode == "best":
        top = by_words.groupBy(F.col("mention").alias("text")).agg(F.max("SCORE").alias("top"))
        wanted = asked.join(top, "text", "left").withColumn("least", F.greatest(F.lit(float(min_score)), "top")).filter("least < 100").drop("top")
    # Blocks use both sides several times; written, they are no part of that plan, which the driver holds whole.
    left, right = map(cut_lineage, _bands(wanted, known))
    by_letters = match_blocks(left, right, ["cell"], "mention", "NAME", _alike(mode), "mention string, NAME string, SCORE double", 2048, 8192)
    found = by_words.unionByName(by_letters).groupBy("mention", "NAME").agg(F.max("SCORE").alias("SCORE"))
    if mode == "all":
        return found
    return first_rows(found, ["mention"], [F.desc("SCORE"), F.asc("NAME")], 1).drop("_rank")


def resolve_device(mentions: DataFrame, review_names: DataFrame, sales_names: DataFrame, min_score: float = 60,
                   mention: str = "mention", name: str = "name") -> DataFrame:
    """One device per mention: ``mention, DEVICE, STAGE``.

    A contained review name wins (1), then a review name alike (2), then a contained sales name (3),
    then a sales name alike (4), else the device is not available (5). ``UNDEFINED`` is no sales
    name to be contained. Each stage takes what the one before it has left over.
    """
    left = cut_lineage(mentions.select(F.upper(mention).alias("mention")).filter("mention IS NOT NULL").distinct())
    # Each list is used by two stages, several times over.
    reviewed, sold = (cut_lineage(names.select(F.col(name).alias("name")).distinct()) for names in (review_names, sales_names))
    contained = lambda rows, names: detect_mentions(rows, names, 1, "mention", "mention")
    alike = lambda rows, names: fuzzy_match(rows, names, min_score)
    stages = ((contained, reviewed), (alike, reviewed), (contained, sold.filter(F.upper("name") != "UNDEFINED")), (alike, sold))
    answers = None
    for number, (stage, names) in enumerate(stages, 1):
        found = cut_lineage(stage(left, names).select("mention", F.col("NAME").alias("DEVICE"), F.lit(number).alias("STAGE")))
        answers = found if answers is None else answers.unionByName(found)
        left = cut_lineage(left.join(found, "mention", "left_anti"))
    return answers.unionByName(left.select("mention", F.lit(UNAVAILABLE).alias("DEVICE"), F.lit(5).alias("STAGE")))
