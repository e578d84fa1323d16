"""Mixing sources to target weights with a splitting tree of exact block quotas.

Each source's share of the mix is its weight's share of ``SHARE`` times all words, at most ``CAP`` times its own
words; what is cut off goes to the other sources by weight until none is above.  A source's documents are dealt into blocks
by a hash.  The mix takes whole passes over a source's blocks and, in a seeded order of blocks and of the documents inside
them, as much of a further pass as the target needs; the last document is taken in part.

The block draws are divided among output shards by a tree: at each node the draws of all sources are split between
the two halves by a multivariate hypergeometric draw, so the leaves hold exact quotas whose mix varies as if all draws
had been dealt at random, without listing them.  The leaves' quotas cut each source's permuted draws into disjoint runs;
a hash orders the documents inside a shard.

The driver holds one row per source (metadata) and the tree of sources x shards.  Blocks of a source number
``BLOCKS`` at most and grow with the source, so neither the order of blocks nor that inside one meets a whole
source in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tremorlake.llm.text import checkpointed, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SHARDS = 16
BLOCK_ROWS = 64
BLOCKS = 4096
SEED = 23
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words that the mix wants of each source; no source above cap times its size."""
    out = [0.0] * len(sizes)
    left = share * sum(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        want = {i: left * weights[i] / total for i in open_}
        over = [i for i in open_ if want[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = want[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_quotas(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources, shards): exact quotas of block draws, split node by node."""
    if shards == 1:
        return draws[:, None]
    left = shards // 2
    total = int(draws.sum())
    mine = rng.multivariate_hypergeometric(draws, total * left // shards, method="marginals") if total else draws
    return np.concatenate([split_quotas(mine, left, rng), split_quotas(draws - mine, shards - left, rng)], axis=1)


def mixture(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): what the mix takes of it and where it goes.

    doc_id, text_hash, source, size, source_size, target, taken (words, repeats counted), first_shard and
    second_shard (of a first and a second copy, null where there is none) and place (order inside a shard).
    Sources go by code point, null last, and take the weights in turn.  A null or blank text has
    size 0 and nothing is taken of it; a source without words has target 0.  Repeated rows each get a row.  An empty table gives
    an empty result.  Reruns agree.  Other columns are not read.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    base = checkpointed(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("text_hash")))
    sums = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([r["size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], share, cap)
    rows = []
    for i, (r, t) in enumerate(zip(sums, want)):
        whole = round(t)
        passes = whole // r["size"] if r["size"] else 0
        blocks = min(max(1, -(-r["n"] // BLOCK_ROWS)), BLOCKS)
        rows.append((i, r["source"], r["size"], float(t), int(passes), int(whole - passes * r["size"]), blocks))
    plan = spark.createDataFrame(rows, "sid int, source string, source_size long, target double, passes int, part long, n_blocks int")
    plan = F.broadcast(plan)  # one row per source
    dealt = base.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "sid", "source_size", "target", "passes", "part", "n_blocks")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("text_hash", F.lit(seed)), F.col("n_blocks")).cast("int"))
    blocks = dealt.groupBy("sid", "block", "passes", "part").agg(F.sum("size").alias("words"))
    order = W.partitionBy("sid").orderBy(F.xxhash64("sid", "block", F.lit(seed)), "block")  # BLOCKS rows at most
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = checkpointed(blocks.select("sid", "block", "passes", "part", (F.row_number().over(order) - 1).alias("nth"), before.alias("before")))
    draws = blocks.groupBy("sid").agg(F.count("*").alias("n"), F.sum((F.col("before") < F.col("part")).cast("int")).alias("extra"), F.max("passes").alias("passes")).collect()
    per_source = np.zeros(max(len(rows), 1), np.int64)
    for d in draws:
        per_source[d["sid"]] = d["n"] * d["passes"] + d["extra"]
    quota = split_quotas(per_source, shards, np.random.default_rng(seed))
    stops = np.cumsum(quota, axis=1)
    ends = spark.createDataFrame([(i, [int(x) for x in stops[i]]) for i in range(len(rows))], "sid int, stops array<long>")
    count = blocks.groupBy("sid").agg(F.count("*").alias("n_full"))
    placed = blocks.join(F.broadcast(ends), "sid").join(F.broadcast(count), "sid")
    shard = lambda draw: F.size(F.filter("stops", lambda s: s <= draw)).cast("int")
    placed = placed.select("sid", "block", "before", shard(F.col("nth")).alias("first_at"), shard(F.col("n_full") + F.col("nth")).alias("second_at"))
    inside = W.partitionBy("sid", "block").orderBy("text_hash", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows_ = dealt.withColumn("earlier", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(placed, ["sid", "block"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("before") - F.col("earlier")))
    rows_ = rows_.withColumn("taken", (F.col("passes") * F.col("size") + extra).cast("long"))
    return rows_.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, F.col("first_at")).alias("first_shard"),
        F.when(F.col("taken") > F.col("size"), F.col("second_at")).alias("second_shard"),
        F.xxhash64("text_hash", F.lit(seed + 1)).alias("place"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with their columns as they are: a document comes as often as it is taken, up to
    halves (a part of at least half of a document counts as a copy)."""
    taken = mixture(docs, **options)
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = taken.where(F.col("taken") > 0).groupBy("doc_id", "text_hash").agg(F.max(copies).alias("copies")).where(F.col("copies") > 0).alias("t")
    keyed = docs.withColumn("__hash", F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.__hash") == F.col("t.text_hash"))
    out = keyed.join(taken, same).select("d.*", F.explode(F.sequence(F.lit(1), "t.copies")).alias("__copy"))
    return out.drop("__hash", "__copy")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard", "second_shard")


QUERIES = {"op3_mixing": op3_mixing}
ORACLE: dict[str, str] = {}
