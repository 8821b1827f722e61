"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by hash and queued; a document's virtual finish time is the
source's cumulative words up to and with it divided by the source's target. All queues are
ordered by finish time and cut at the total budget, so every source gets its share at any point
of the mix. A source whose target exceeds its words is queued again, up to three passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import stage, text_key
from ledgerlens.operators.joins import broadcast_if_small

#: Passes over a source at most; hash ranges a source's queue is cut into for its running sum;
#: finish-time ranges per unit of time.
PASSES, RANGES, TIMES = 3, 1024, 4096
WEIGHTS = (5, 2, 1)
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> rank, target. Sources in code point order (null last) weigh
    ``weights`` in turn and share all words; a target stops at PASSES times the source's words
    and the excess is shared among the others by weight. Closed form: with sources in order of
    cap / weight, a source is capped when the share left for it and its followers reaches its
    cap. One row per source, so the unpartitioned windows run over sources, never documents."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = (F.col("rank") - 1) % len(weights)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * PASSES)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("left", (F.sum("source_size").over(every) - (F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))).cast("double"))
        .withColumn("still", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("cap") * F.col("still") <= F.col("left") * F.col("weight"))
    )
    over = lambda c: F.sum(F.when(~F.col("capped"), c)).over(every)
    budget = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    share = F.col("weight") * budget / over(F.col("weight"))
    return ranked.select("source", "source_size", "rank", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """One row per input row: doc_id, source, text_hash, size (words), source_size, target, passes
    (times the mix takes the document, 0 to 3). Needs doc_id, text and source; other columns are
    ignored. Sources are read from the data, and the budget is the sum of all sizes.

    Defined cases: a null or wordless text has size 0 and is never taken; a null source is one
    source, the last; a source of empty texts has target 0; equal hashes are ordered by doc_id
    and size, and rows equal in all of these are interchangeable; no words at all: nothing is
    taken; an empty table gives an empty result. Reruns give equal results."""
    base = docs.select("doc_id", "source", text_key().alias("th"), n_words().alias("size"))
    base = base.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "th"))
    base = stage(base, "mix-rows")
    targets = stage(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-sources")
    sources = broadcast_if_small(targets.withColumnRenamed("source", "_source"))
    rows = base.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("part", F.shiftrightunsigned("h", 54))

    parts = rows.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    ahead = parts.withColumn("ahead", F.sum("words").over(Window.partitionBy("rank").orderBy("part")) - F.col("words")).drop("words")
    queue = Window.partitionBy("rank", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("inside", F.sum("size").over(queue)).join(ahead, ["rank", "part"])
    queued = stage(queued.select("doc_id", "source", "th", "size", "source_size", "target", "rank", (F.col("ahead") + F.col("inside")).alias("cum")), "mix-queue")

    def finish(e):
        return (e * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")

    def slice_of(f):
        return F.least(F.floor(f * TIMES), F.lit(4 * TIMES)).cast("int")

    live = queued.where("size > 0 and target > 0")
    copies = live.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))).withColumn("f", finish(F.col("e"))).withColumn("slice", slice_of(F.col("f")))
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    slices = copies.groupBy("slice").agg(F.sum("size").alias("words"))  # at most 4 x TIMES + 1 rows
    upto = slices.withColumn("upto", F.sum("words").over(Window.orderBy("slice")))
    cut = upto.where(F.col("upto") > budget).orderBy("slice").select("slice", (F.col("upto") - F.col("words")).alias("before")).first()
    taken = F.lit(0)
    if cut is None:  # every copy fits (or there is none)
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.lit(PASSES)).otherwise(0)
    else:
        edge = copies.where(F.col("slice") == cut["slice"])
        run = Window.orderBy("f", "rank").rowsBetween(Window.unboundedPreceding, 0)
        last = edge.withColumn("run", F.sum("size").over(run)).where(F.col("run") <= budget - cut["before"]).agg(F.max(F.struct("f", "rank")).alias("last")).first()["last"]
        for e in range(PASSES):
            f = finish(F.lit(e))
            inside = slice_of(f) < cut["slice"]
            if last is not None:
                inside = inside | ((slice_of(f) == cut["slice"]) & ((f < last["f"]) | ((f == F.lit(last["f"])) & (F.col("rank") <= last["rank"]))))
            taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & inside, 1).otherwise(0)
    return queued.select("doc_id", "source", F.col("th").alias("text_hash"), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.cast("long").alias("passes"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each 0 to 3 times, columns unchanged."""
    spots = mix_sources(docs, weights, seed).groupBy("doc_id", "source", "text_hash").agg(F.sum("passes").alias("__mix_passes"), F.count("*").alias("__mix_rows")).where("__mix_passes > 0")
    spots = spots.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("text_hash").alias("__mix_th"), "__mix_passes", "__mix_rows")
    names = docs.columns
    got = docs.join(spots, docs["doc_id"].eqNullSafe(F.col("__mix_id")) & docs["source"].eqNullSafe(F.col("__mix_source")) & (text_key() == F.col("__mix_th")))
    whole = got.where("__mix_passes % __mix_rows = 0").withColumn("__mix_n", F.expr("__mix_passes div __mix_rows"))
    odd = got.where("__mix_passes % __mix_rows <> 0").withColumn("__mix_i", F.row_number().over(Window.partitionBy("__mix_id", "__mix_source", "__mix_th").orderBy(F.lit(0))))
    odd = odd.withColumn("__mix_n", F.expr("__mix_passes div __mix_rows + if(__mix_i <= __mix_passes % __mix_rows, 1, 0)")).drop("__mix_i")
    return whole.unionByName(odd).where("__mix_n > 0").withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_n").cast("int")))).select(*names)
