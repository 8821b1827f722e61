"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring of 63-bit hashes; a row belongs to the arc that ends at
the first point at or after its hash. A shard takes at most its bound; rows beyond it continue
clockwise to the next point whose shard has room. With bounds of n/shards rows (rounded down,
or up for the n mod shards busiest shards) the counts differ by one at most, whatever the keys.

Within an arc rows are ranked by hash. An arc's overflow is a range of ranks, so the walk round
the ring needs only the row count of each arc: it runs over the shards x points counts, and the
rows get their shard and their slot (gapless within the shard) from a table of rank ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import small_table, stage, text_key

#: Ring points of each shard, look-up cells of the ring, copies unpacked at a time.
POINTS, CELL_BITS, CHUNK = 64, 11, 1 << 16
_RANGES = "arc int, lo long, hi long, shard int, slot_lo long"


def _position(*cols):
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))


def ring(spark: SparkSession, shards: int, points: int = POINTS) -> DataFrame:
    """The ring's points in order: arc (0, 1, ...), pos, shard."""
    ids = spark.range(0, shards * points, 1, 1)
    at = ids.select(F.expr(f"cast(id div {points} as int)").alias("shard"), _position(F.lit("ring"), F.expr(f"id div {points}"), F.col("id") % points).alias("pos"))
    return at.select((F.row_number().over(Window.orderBy("pos", "shard")) - 1).alias("arc"), "pos", "shard")


def walk(owners: list[int], counts: list[int], bounds: list[int]) -> list[dict]:
    """Rank ranges of every arc and the shard that takes them. All rows ask their arc's shard;
    a shard takes askers in order of arc until its bound, the others go on clockwise."""
    free, taken, size = list(bounds), [0] * len(bounds), len(owners)
    out, asking = [], [(arc, arc, 0, n) for arc, n in enumerate(counts) if n]
    while asking:
        rest = []
        for arc, at, lo, hi in asking:
            shard = owners[at]
            n = min(free[shard], hi - lo)
            if n:
                out.append({"arc": arc, "lo": lo, "hi": lo + n, "shard": shard, "slot_lo": taken[shard]})
                free[shard] -= n
                taken[shard] += n
            if lo + n < hi:
                rest.append((arc, at, lo + n, hi))
        asking = []
        for arc, at, lo, hi in rest:
            while not free[owners[at]]:
                at = (at + 1) % size
            asking.append((arc, at, lo, hi))
    return out


def shard_rows(docs: DataFrame, shards: int = 24, points: int = POINTS) -> DataFrame:
    """Put every row into a shard 0 .. shards - 1. Needs doc_id and text; other columns are
    ignored. Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot.

    The hash covers doc_id and text. Defined cases: a null text has size 8 and the checksum 0 of
    no bytes; null ids are keys like others; repeated rows are counted once with their number
    and unpacked at the end, so one row repeated endlessly is no hot key; equal hashes are
    ordered by id; with fewer rows than shards some shards stay empty; an empty table gives an
    empty result."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), text_key().alias("th"))
    keyed = rows.groupBy("doc_id", "size", "text_crc32", "th").agg(F.count("*").alias("n"))
    keyed = keyed.withColumn("pos", _position("doc_id", "th", "text_crc32"))

    points_of = ring(spark, shards, points).collect()  # shards x points rows
    shift = 63 - CELL_BITS
    cells = [{"cell": c, "base": 0, "inside": []} for c in range(1 << CELL_BITS)]
    for p in points_of:
        cells[p["pos"] >> shift]["inside"].append(p["pos"])
    for c, before in zip(cells[1:], cells, strict=False):
        c["base"] = before["base"] + len(before["inside"])
    lookup = F.broadcast(small_table(spark, cells, "cell int, base int, inside array<bigint>"))
    found = keyed.withColumn("cell", F.shiftrightunsigned("pos", shift).cast("int")).join(lookup, "cell")
    arc = (F.col("base") + F.size(F.filter("inside", lambda p: p < F.col("pos")))) % len(points_of)
    found = stage(found.select("doc_id", "size", "text_crc32", "th", "n", "pos", arc.cast("int").alias("arc")), "ring-rows")

    per_arc = {r["arc"]: r["n"] for r in found.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one row per arc
    owners, counts = [p["shard"] for p in points_of], [per_arc.get(i, 0) for i in range(len(points_of))]
    home = [0] * shards
    for owner, n in zip(owners, counts, strict=True):
        home[owner] += n
    base, more = divmod(sum(counts), shards)
    busiest = sorted(range(shards), key=lambda s: (-home[s], s))[:more]
    bounds = [base + (s in busiest) for s in range(shards)]
    ranges = F.broadcast(small_table(spark, walk(owners, counts, bounds), _RANGES))

    before = Window.partitionBy("arc").orderBy("pos", "doc_id", "th", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    chunks = ranked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    low = F.col("chunk") * CHUNK
    one = chunks.withColumn("copy", F.explode(F.sequence(low, F.least(low + CHUNK, F.col("n")) - 1))).withColumn("rank", F.col("first") + F.col("copy"))
    placed = one.join(ranges, (one["arc"] == ranges["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot_lo") + F.col("rank") - F.col("lo")).alias("slot"))
