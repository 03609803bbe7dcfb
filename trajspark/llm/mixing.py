"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash of their id and queued, pass after pass. A packet's virtual finish
time is the words that its source has queued up to its end, divided by the source's target; a document is one packet, or
several if it has more than 2**-PACKETS of the budget. The mix is the global order of all packets by finish time, cut
where its running total of words reaches the total budget; the packet at the cut gives the words that still fit. So the
mix has exactly as many words as the budget, and each source ends within a few packets of its target.

The cut is found from totals of RANGES ranges of the finish time: those before the range in which the running total
reaches the budget are in, those behind it are out, and this one is divided again until few packets are left in it, which
are put in order. Only totals of ranges and of sources are shuffled; the documents' places in their own source's queue
take one shuffle, over hash ranges of each source with the totals of the ranges before, so one source may hold any share
of the rows.

Targets share the budget by weight. No source is used more than `max_repeats` times: a target above that stops there,
and the excess goes to the others by weight, until none is above (a water level, found from one sort of the sources).

All steps are DataFrame expressions. Defined results: a null text has no words and takes nothing; a null source is a
source of its own, last in order. Rows that repeat an id are queued one by one. An empty table gives an empty result.
Columns that clash with the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, unused

RANGES = 4096
FEW = 50_000  # packets that are put in order in one task
PACKETS = 18
SEED = 20240607


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null: 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sized: DataFrame, source_col: str, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """(source, source_size, target) of sized (source, size): one row for each source.

    Sources in code-point order, null last, take the weights in turn.
    """
    one = Window.partitionBy(F.lit(0))  # sources, not documents
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % F.lit(len(weights)) + 1
    )
    ranked = sources.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    by_level = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # level if every source before this one is capped and this one and all after it are not
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))) / (
        F.sum("w").over(one) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0))
    )
    # these levels rise while the next source is below its cap's level and fall after: the water level is the largest
    found = ranked.withColumn("level", level)
    target = F.least(F.col("w") * F.max("level").over(one), F.col("cap"))
    return found.select("source", "source_size", target.alias("target"))


def queue(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], max_repeats: int, seed: int
) -> DataFrame:
    """(id, digest, source, size, source_size, target, before): a row for each row of docs, with its text's digest.

    before: words of the source queued ahead in each pass.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("digest"),
            F.xxhash64(F.col(id_col), F.lit(seed)).alias("place"),
        ),
        "sizes",
    )
    sized = sized.withColumn("range", F.shiftright("place", 52).cast("int"))  # RANGES of equal width, in order
    per_range = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset")
    )
    targets = source_targets(sized, "source", weights, max_repeats)
    inside = (
        Window.partitionBy("source", "range").orderBy("place", "id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = offsets.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    starts = starts.withColumnsRenamed({"source": "of", "range": "at"})
    queued = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at"))
    )
    before = (F.col("offset") + F.col("inner")).alias("before")
    return materialize(queued.select("id", "digest", "source", "size", "source_size", "target", before), "queue")


def served(queued: DataFrame, max_repeats: int) -> DataFrame:
    """(source, served): the words that each source gives to the mix, from the cut through the global order of packets."""
    budget = queued.select(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    packet = max(1, budget >> PACKETS)
    laps = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("lap")
    parts = F.explode(F.expr(f"sequence(0L, (size - 1) div {packet})")).alias("part")
    packets = (
        queued.where("size > 0 and target > 0")
        .select("source", "size", "source_size", "target", "before", laps)
        .select("*", parts)
        .select("source", "target", F.expr(f"least(size - part * {packet}, {packet}L)").alias("words"),
                F.expr(f"lap * source_size + before + part * {packet}").alias("begin"))
        .select("source", "words", "begin", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"))
    )
    # packets that finish in [low, high] hold the cut; those below low are in, with `ahead` words
    ahead = 0
    low, high, n = packets.agg(F.min("finish"), F.max("finish"), F.count("*")).first()
    if not n:
        return queued.select("source", F.lit(0).cast("long").alias("served")).distinct()
    while n > FEW and low < high:
        width = (high - low) / RANGES
        at = F.least(F.floor((F.col("finish") - low) / width), F.lit(RANGES - 1)).alias("range")
        ranges = packets.where(F.col("finish").between(low, high)).groupBy(at).agg(
            F.sum("words").alias("words"), F.min("finish").alias("low"), F.max("finish").alias("high"), F.count("*").alias("n")
        )
        through = F.sum("words").over(Window.orderBy("range"))  # RANGES rows at most
        cut = ranges.withColumn("through", through).where(F.col("through") >= budget - ahead).orderBy("range").first()
        if cut is None or (cut.low, cut.high) == (low, high):
            break
        ahead, low, high, n = ahead + cut.through - cut.words, cut.low, cut.high, cut.n
    in_order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "begin")  # FEW packets, or of one finish time
    last = packets.where(F.col("finish").between(low, high)).withColumn("through", F.sum("words").over(in_order))
    given = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.lit(budget - ahead) - (F.col("through") - F.col("words"))))
    parts = packets.where(F.col("finish") < low).select("source", "words").unionByName(last.select("source", given.alias("words")))
    return parts.groupBy("source").agg(F.sum("words").alias("served"))


def _taken(queued: DataFrame, max_repeats: int) -> DataFrame:
    """The queue with the words taken of each row over all passes."""
    cuts = served(queued, max_repeats).withColumnRenamed("source", "of")
    taken = F.lit(0).cast("long")
    for lap in range(max_repeats):
        begin = F.col("before") + F.lit(lap) * F.col("source_size")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("served") - begin))
    joined = queued.join(small(materialize(cuts, "served")), F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.withColumn("served", F.coalesce("served", F.lit(0))).withColumn("taken", taken)


def fair_queue(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_repeats: int = 3,
    seed: int = SEED,
) -> DataFrame:
    """(id, source, size, source_size, target, before, taken, finish_time) in mix order: a row for each row of docs.

    before: words of the source queued ahead in each pass. finish_time: virtual finish in the first pass. taken: words
    over all passes.
    """
    queued = queue(docs, id_col, text_col, source_col, weights, max_repeats, seed)
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return (
        _taken(queued, max_repeats)
        .select("id", "source", "size", "source_size", "target", "before", "taken", finish.alias("finish_time"))
        .orderBy(F.col("finish_time").asc_nulls_last(), "id")
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_repeats: int = 3,
    seed: int = SEED,
) -> DataFrame:
    """The mixed corpus: each row of docs as many times as its taken words make whole texts, rounded to the nearest.

    Rows that repeat an id, source and text are mixed alike, each as often as the one that is taken most.
    """
    plan = _taken(queue(docs, id_col, text_col, source_col, weights, max_repeats, seed), max_repeats).where("taken > 0")
    key = {k: unused(docs, f"_{k}") for k in ("id", "source", "digest", "times", "lap")}
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    plan = plan.groupBy(*[F.col(k).alias(key[k]) for k in ("id", "source", "digest")]).agg(F.max(times).alias(key["times"]))
    kept = docs.join(
        plan.where(F.col(key["times"]) > 0),
        docs[id_col].eqNullSafe(F.col(key["id"]))
        & docs[source_col].eqNullSafe(F.col(key["source"]))
        & (F.xxhash64(docs[text_col]) == F.col(key["digest"])),
    )
    return kept.withColumn(key["lap"], F.explode(F.sequence(F.lit(1), F.col(key["times"])))).select(*docs.columns)
