"""Mixing sources to target weights by Pfair scheduling, with SQL functions only.

Time is counted in slots that take a block each. Block j of a source of weight w (the weights of all add up to 1) may not start
before floor(j / w) and has to be done by ceil((j + 1) / w); of the blocks that may start, the one with the earliest deadline goes
first. Then at every slot each source has had less than one block more or less than its weight times the slots, from the first
slot of the run to the slot at which a source has no blocks left: windows follow from the weights for each block of the whole
run, so nothing is rounded from one stretch to the next. From then on time passes faster, by the weights of the sources that are
left, which so go on in the ratio of their weights.

Weights are taken as multiples of 2^-30 of the largest, and all arithmetic is on whole numbers. The run has at most ``SLOTS`` slots
(and one a source): blocks have ``BLOCK_BYTES``, or more where the texts would be cut into more blocks than that. So the schedule
fits one value whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import partitions, unused
from reviewlens.sources.storage import cut_lineage

#: Slots that are scheduled in one step of the run, and counted together where documents are numbered.
PERIOD = 1000
#: UTF-8 bytes of a block, on average, and the most slots of a run.
BLOCK_BYTES, SLOTS = 1 << 18, 1 << 16
#: The largest weight as a whole number.
UNITS = 1 << 30


def hash60(column: str | Column) -> Column:
    """60 bits of the md5 of a value as text; a null counts as empty."""
    text = F.coalesce(column.cast("string") if isinstance(column, Column) else F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def schedule(sources: DataFrame, period: int = PERIOD) -> DataFrame:
    """(place, turn, slot): the slot of each block of each source, from a row (place, units, n_blocks) a source.

    One step per slot: of the sources that have blocks left and whose next one is released before the slot ends, the one with the
    earliest deadline takes it, then the first place; if none is released, the earliest deadline of all. A slot lasts as long as the
    weights of the sources left, of all, are short of 1: one unit of time while all have blocks."""
    listed = sources.filter("n_blocks > 0").groupBy().agg(  # at most SLOTS blocks, and a block a source
        F.sort_array(F.collect_list(F.struct("place", "units", "n_blocks"))).alias("sources"), F.sum("units").alias("all"), F.sum("n_blocks").alias("slots"))
    everything, rows = F.col("all"), F.col("sources")
    whole = lambda a, b: F.call_function("div", a, b)

    def step(state: Column, slot: Column) -> Column:
        def chosen(end: Column) -> Column:
            def asked(source: Column, k: Column) -> Column:
                done = F.element_at(state["done"], k + 1)
                late = (whole(done * everything, source["units"]) >= end).cast("int")
                deadline = whole((done + 1) * everything + source["units"] - 1, source["units"])
                return F.when(done < source["n_blocks"], F.struct(late.alias("late"), deadline.alias("deadline"), k.alias("k"), done.alias("turn")))

            def taken(first: Column) -> Column:
                source = F.element_at(rows, first["k"] + 1)
                out = source["n_blocks"] == first["turn"] + 1
                row = F.struct(source["place"].alias("place"), first["turn"].alias("turn"), slot.alias("slot"))
                return F.struct(
                    F.transform(state["done"], lambda d, k: d + (k == first["k"]).cast("long")).alias("done"), end.alias("time"),
                    (state["left"] - F.when(out, source["units"]).otherwise(F.lit(0).cast("long"))).alias("left"), F.concat(state["taken"], F.array(row)).alias("taken"))
            return _once(F.array_min(F.transform(rows, asked)), taken)  # nulls come to nothing
        return _once(state["time"] + everything / state["left"], chosen)

    none = F.expr("cast(array() as array<struct<place:int,turn:bigint,slot:bigint>>)")
    start = F.struct(F.transform(rows, lambda s: F.lit(0).cast("long")).alias("done"), F.lit(0.0).alias("time"), everything.alias("left"), none.alias("taken"),
                     F.expr("cast(array() as array<array<struct<place:int,turn:bigint,slot:bigint>>>)").alias("all"))

    def stretch(state: Column, number: Column) -> Column:
        """Some slots, gathered by themselves so that what has been gathered before is not copied at every slot."""
        slots = F.sequence(number * period, F.least((number + 1) * period, F.col("slots")) - 1)
        own = F.struct(state["done"].alias("done"), state["time"].alias("time"), state["left"].alias("left"), none.alias("taken"))
        return F.aggregate(slots, own, step, lambda s: F.struct(
            s["done"].alias("done"), s["time"].alias("time"), s["left"].alias("left"), none.alias("taken"), F.concat(state["all"], F.array(s["taken"])).alias("all")))

    run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / period)), start, stretch, lambda s: F.flatten(s["all"]))
    return listed.filter("slots > 0").select(F.inline(run))


def target_weights(docs: DataFrame, weights: Mapping[str, float] | None, power: float) -> DataFrame:
    """(source, weight, bytes): the given weights; for sources without one, or for all if none are given, the bytes of the source
    to the given power."""
    sized = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("bytes"))
    own = F.pow(F.col("bytes").cast("double"), F.lit(power))
    if weights:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        sized = sized.join(given, "source", "left")
        own = F.coalesce("weight", F.lit(0.0))
    return sized.select("source", own.alias("weight"), "bytes")


def plan(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(source, n_blocks, slots): one row a source with a weight above zero, and the slots of the run that its blocks take in turn."""
    every = Window.partitionBy(F.lit(0))  # a row a source
    sources = target_weights(docs, weights, power).filter("weight > 0").select(
        "source", F.row_number().over(every.orderBy(F.col("source").asc_nulls_first())).alias("place"),
        F.greatest(F.lit(1).cast("long"), F.round(F.col("weight") / F.max("weight").over(every) * UNITS).cast("long")).alias("units"),
        F.ceil(F.col("bytes") / F.greatest(F.lit(block_bytes).cast("long"), F.ceil(F.sum("bytes").over(every) / SLOTS))).cast("long").alias("n_blocks"))
    sources = cut_lineage(sources)
    slots = schedule(sources).groupBy("place").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return cut_lineage(sources.join(slots, "place").select("source", "n_blocks", "slots"))


def _placed(docs: DataFrame, block: str, slot: str, **options) -> DataFrame:
    """All columns of ``docs``, with the block and the slot of each. A document goes to a block of its source by a hash of its id, so
    no source has to be put in order to be cut, and no text moves. A source without a weight above zero is left out; with no
    weights given, nothing is. A null source is a source."""
    own, n_blocks, slots = (unused(docs, name) for name in ("own_source", "n_blocks", "slots"))
    sources = F.broadcast(plan(docs.select("source", "text"), **options).toDF(own, n_blocks, slots))  # at most SLOTS slots, and one a source
    placed = docs.join(sources, F.col("source").eqNullSafe(F.col(own))).withColumn(block, F.pmod(hash60("doc_id"), n_blocks))
    return placed.withColumn(slot, F.element_at(slots, (F.col(block) + 1).cast("int"))).drop(own, n_blocks, slots)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The order in which the documents (doc_id, text, source) are to be read: doc_id, source, block, slot and position, gapless
    from 0: by slot, and in a block by the hash of the id, the id and the text. Equal rows each have a position. For the options see
    ``plan``. A block is numbered by itself and moved up by what the slots before hold; these are summed by period first."""
    docs = docs.select("doc_id", "source", "text")
    rows = cut_lineage(_placed(docs, "block", "slot", **options).select(
        "doc_id", "source", "block", "slot", hash60("doc_id").alias("h"), F.xxhash64("text").alias("t")))
    sizes = rows.groupBy("slot").agg(F.count("*").alias("n")).withColumn("cycle", F.floor(F.col("slot") / PERIOD))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cycles = (sizes.groupBy("cycle").agg(F.sum("n").alias("n"))
              .select("cycle", F.coalesce(F.sum("n").over(before(Window.orderBy("cycle"))), F.lit(0)).alias("base")))
    starts = (sizes.select("slot", "cycle", F.coalesce(F.sum("n").over(before(Window.partitionBy("cycle").orderBy("slot"))), F.lit(0)).alias("n"))
              .join(cycles, "cycle").select("slot", (F.col("base") + F.col("n")).alias("start")))
    inside = F.row_number().over(Window.partitionBy("slot").orderBy("h", F.col("doc_id").asc_nulls_first(), "t"))
    return (rows.withColumn("place", inside).join(starts, "slot")
            .select("doc_id", "source", "block", "slot", (F.col("start") + F.col("place") - 1).alias("position")))


def laid_out(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, as ranges of slots: written out, file after file holds slot after slot."""
    block, slot, order_hash = (unused(docs, name) for name in ("block_", "slot_", "hash_"))
    order = [slot, order_hash, F.col("doc_id").asc_nulls_first()]
    found = _placed(docs, block, slot, **options).withColumn(order_hash, hash60("doc_id"))
    return found.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(*docs.columns)
