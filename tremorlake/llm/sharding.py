"""Shards of near equal bytes from sampled splitters, in DataFrame functions only.

Records are ordered by a hash of their text, so equal texts are neighbours.  A size-weighted sample of keys gives
quantile boundaries, records are range-partitioned by them, and ranges that turn out overfull are sampled again and
subdivided.  Exact running bytes inside the ranges and over the ranges then give each record its shard.

Equal texts form a group and stay in one shard, unless the group is larger than a shard: then its rows are dealt
one by one.  Groups (or such rows) of at least 1 / ``FINE`` of a shard are placed first, the largest on the emptiest
shard; there are at most shards * FINE of them, whatever the table's size.  All others fill what is left
in key order, so a shard misses the mean by about 1 / FINE.  What the driver holds is bounded: those placements,
the sampled keys and one row per range.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tremorlake.llm.text import checkpointed, table

SHARDS = 40
FINE = 100
OVERHEAD = 16
RANGE_ROWS = 200_000  # rows that a range should have
RANGES = (160, 20_000)  # fewest and most ranges
OVERSAMPLE = 16
OVERFULL = 3.0
SEED = 7
PIECES = 64


def _literal(rows: list, kind: str) -> Column:
    """A small driver-side list as a constant array column."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def _text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def text_size(text: str = "text") -> Column:
    return (F.octet_length(_text(text)) + OVERHEAD).cast("long")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(_text(text))


@dataclass
class Splitters:
    """The decisions of a sharding: whole groups or rows placed apart, shard boundaries for the rest."""

    spark: SparkSession
    placed: list[dict]  # {h, whole, doc_id, to}
    large: list[int]  # keys of groups that are larger than a shard
    ranges: list[tuple[int, int]]  # lower bounds of the ranges, from the second on
    stops: list[float]  # bytes of the rest at which each shard but the last ends
    before: list[int]  # bytes of the rest before each range

    def tie(self, h: str = "h", doc_id: str = "doc_id") -> Column:
        """Tells the rows of an overlarge group apart."""
        return F.when(F.col(h).isin(self.large), F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1)), F.lit(SEED))).otherwise(F.lit(0).cast("long"))

    def placements(self) -> DataFrame:
        rows = _literal(self.placed, "struct<h:bigint,whole:boolean,doc_id:bigint,to:int>")
        return self.spark.range(1).select(F.explode(rows).alias("p")).select("p.*")


def range_of(bounds: list[tuple[int, int]], h: Column, tie: Column) -> Column:
    """The number of bounds that are not above the key; two short scans over constant arrays."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    as_rows = lambda part: [{"h": b[0], "t": b[1]} for b in part]
    below = lambda b: (b["h"] < h) | ((b["h"] == h) & (b["t"] <= tie))
    heads = _literal(as_rows([g[0] for g in groups]), "struct<h:bigint,t:bigint>")
    fine = _literal([as_rows(g) for g in groups], "array<struct<h:bigint,t:bigint>>")
    coarse = F.size(F.filter(heads, below))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), below))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + inside)


def _sampled(rest: DataFrame, rate: Column) -> list[tuple[int, int]]:
    """Keys drawn with a probability in proportion to their row's size; the draw is a hash of the row."""
    draw = F.pmod(F.xxhash64("h", "doc_id", F.lit(SEED)), F.lit(1 << 31)) / float(1 << 31)
    return sorted((r[0], r[1]) for r in rest.where(draw < F.col("size") * rate).select("h", "tie").collect())


def _quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def splitters(base: DataFrame, shards: int = SHARDS, fine: int = FINE) -> Splitters:
    """Decide from (doc_id, h, size) rows; ``base`` is read several times, so give a checkpointed table."""
    spark = base.sparkSession
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    mean = total / shards
    groups = base.groupBy("h").agg(F.sum("size").alias("bytes"), F.max("size").alias("one")).where(F.col("bytes") >= max(mean / fine, 1)).collect()
    large = sorted(g["h"] for g in groups if g["bytes"] > mean)
    atoms = [(g["bytes"], g["h"], True, None) for g in groups if g["bytes"] <= mean]
    if any(g["one"] >= mean / fine for g in groups if g["bytes"] > mean):
        single = base.where(F.col("h").isin(large) & (F.col("size") >= mean / fine)).groupBy("h", "doc_id").agg(F.sum("size").alias("size"))
        atoms += [(r["size"], r["h"], False, r["doc_id"]) for r in single.collect()]
    load = [(0, s) for s in range(shards)]
    placed = []
    for size, h, whole, doc_id in sorted(atoms, key=lambda a: (-a[0], a[1], a[3] if a[3] is not None else -1)):
        least, s = heapq.heappop(load)
        placed.append({"h": h, "whole": whole, "doc_id": doc_id, "to": s})
        heapq.heappush(load, (least + size, s))
    plan = Splitters(spark, placed, large, [], [], [0])
    rest = unplaced(base, plan)
    left = total - sum(a[0] for a in atoms)
    parts = min(max(RANGES[0], -(-rows // RANGE_ROWS)), RANGES[1])
    keys = _sampled(rest, F.lit(OVERSAMPLE * parts / max(left, 1)))
    bounds = sorted(set(_quantiles(keys, parts)))
    while True:
        sized = rest.groupBy(range_of(bounds, F.col("h"), F.col("tie")).alias("r")).agg(F.sum("size").alias("bytes"))
        have = dict(sized.collect())
        full = {r: b for r, b in have.items() if b > OVERFULL * left / parts and b > mean / fine}
        if not full:
            break
        inside = rest.where(range_of(bounds, F.col("h"), F.col("tie")).isin(sorted(full)))
        keys = _sampled(inside, F.lit(OVERSAMPLE * parts / max(left, 1)) * 4)
        more = set(bounds)
        for r, b in full.items():
            lo, hi = bounds[r - 1] if r else (-(1 << 63), -(1 << 63)), bounds[r] if r < len(bounds) else (1 << 63, 0)
            own = keys[bisect_left(keys, lo) : bisect_left(keys, hi)]
            more.update(_quantiles(own, 2 + int(b * parts / max(left, 1))))
        if len(more) == len(bounds):
            break
        bounds = sorted(more)
    plan.ranges = bounds
    run = 0
    plan.before = []
    for r in range(len(bounds) + 1):
        plan.before.append(run)
        run += have.get(r, 0)
    room = [0.0] * shards
    for used, s in load:
        room[s] = max(0.0, mean - used)
    scale, stop = left / (sum(room) or 1), 0.0
    for s in range(shards - 1):
        stop += room[s] * scale
        plan.stops.append(stop)
    return plan


def _match(plan: Splitters) -> Column:
    return (F.col("b.h") == F.col("p.h")) & (F.col("p.whole") | F.col("b.doc_id").eqNullSafe(F.col("p.doc_id")))


def unplaced(base: DataFrame, plan: Splitters) -> DataFrame:
    tied = base.withColumn("tie", plan.tie())
    if not plan.placed:
        return tied
    return tied.alias("b").join(F.broadcast(plan.placements()).alias("p"), _match(plan), "left_anti")


def assigned(base: DataFrame, plan: Splitters) -> DataFrame:
    """Add shard and piece (a part of a shard of bounded size) to the rows of ``base``."""
    tied = base.withColumn("tie", plan.tie())
    if plan.placed:
        tied = tied.alias("b").join(F.broadcast(plan.placements()).alias("p"), _match(plan), "left").select("b.*", "to")
    else:
        tied = tied.withColumn("to", F.lit(None).cast("int"))
    spread = -1 - F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(PIECES)).cast("int")
    tied = tied.withColumn("range", F.when(F.col("to").isNull(), range_of(plan.ranges, F.col("h"), F.col("tie"))).otherwise(spread))
    upto = W.partitionBy("range").orderBy("h", "tie").rangeBetween(W.unboundedPreceding, W.currentRow)
    small = F.col("to").isNull()
    # rows of one group have the same order key, so a group ends at one place
    end = F.sum("size").over(upto) + F.element_at(_literal(plan.before, "bigint"), F.greatest(F.col("range"), F.lit(0)) + 1)
    stops = _literal(plan.stops, "double")
    shard = F.when(small, F.size(F.filter(stops, lambda s: s < end))).otherwise(F.col("to"))
    return tied.withColumn("shard", shard.cast("int"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, h, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text).

    A row's size is its text's UTF-8 bytes plus 16 (a null text has none and counts as empty).  Slots run from 0 without a gap
    in each shard.  Rows that are equal in doc_id and text cannot be told apart and may be kept together.  Fewer rows than
    shards leave some shards empty; an empty table gives an empty result.  Other columns are not read.
    """
    crc = F.crc32(_text().cast("binary")).alias("text_crc32")
    base = checkpointed(docs.select("doc_id", text_key().alias("h"), text_size().alias("size"), crc))
    rows = assigned(base, splitters(base, shards))
    place = F.row_number().over(W.partitionBy("shard", "range").orderBy("h", "tie", "doc_id"))
    rows = rows.withColumn("place", place)
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    out = rows.join(starts, ["shard", "range"])
    return out.select("doc_id", "h", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))


def with_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with all their columns and a shard; rows equal in doc_id and text share one."""
    where = shard_documents(docs, shards).groupBy("doc_id", "h").agg(F.min("shard").alias("shard")).alias("s")
    keyed = docs.drop("shard").withColumn("__h", text_key()).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.__h") == F.col("s.h"))
    return keyed.join(where, same).select("d.*", "s.shard").drop("__h")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op1_sharding": op1_sharding}
ORACLE: dict[str, str] = {}
