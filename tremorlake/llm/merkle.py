"""Merkle manifest of a corpus as a rollup of nested structs.

A leaf is the hash of a document's fields.  Leaves are numbered inside their source, and the base-16 digits of the number are
grouped away one after the other: each grouping nests the structs of up to 16 children and hashes them.  Three digits make a
block of at most 4,096 leaves, all of whose groupings use one partitioning.  The roots of the blocks are the leaves of the next
round, until each source has one node; the sources' nodes then go the same way to the root.

On the way back the part of a proof above a block meets the block's nested row in one grouping (the two kinds of rows are
put under each other), then the levels are unnested one by one.  So no proof is joined to its leaf, and no row is
larger than a block.  Numbers come from range partitions of bounded size, so a source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tremorlake.llm.text import ascii_lower, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
BLOCK_DIGITS = 3
RANGE_ROWS = 500_000  # rows of a range partition that gets its numbers in one task
TAMPERED_OF = 5

_PATH = "array<struct<left:string,right:string>>"


def leaf_hash(values: dict[str, Column]) -> Column:
    """Hash of the fields: ``-`` for null, else byte count, colon, value."""
    parts = []
    for name in FIELDS:
        value = values.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def is_tampered() -> Column:
    """A fixed fifth of the documents; those without id are left alone."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED_OF)) == 0, F.lit(False))


def ranked(rows: DataFrame, keys: list[str], order: list[str], what: str) -> DataFrame:
    """Add ``rank`` (from 0 inside ``keys``, by ``order``) and ``n`` (rows of the key).

    Rows are sorted into ranges by key and order first, so a key of any size is numbered in parts; rows equal in all of
    this are told apart by their place in the input, as they may stand in any order.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    tied = rows.withColumn("at", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(parts, *keys, *order, "at").withColumn("part", F.spark_partition_id())
    ranges = written(ranges, what)  # the ranges must not be drawn again
    counts = ranges.groupBy("part", *keys).agg(F.count("*").alias("have"))
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = by_key.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col("part").alias("p"), *[F.col(k).alias(f"of_{k}") for k in keys],
        F.coalesce(F.sum("have").over(earlier), F.lit(0)).alias("start"), F.sum("have").over(by_key).alias("n"),
    )
    inside = W.partitionBy("part", *keys).orderBy(*order, "at")
    same = F.col("part") == F.col("p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    out = ranges.withColumn("nth", F.row_number().over(inside) - 1).join(starts, same)
    return out.select(*rows.columns, (F.col("start") + F.col("nth")).cast("long").alias("rank"), F.col("n").cast("long"))


def levels_of(n: str) -> Column:
    """Groupings until one node is left of ``n``."""
    steps = [F.when(F.col(n) > FAN**i, 1).otherwise(0) for i in range(15)]
    return sum(steps[1:], steps[0])


def rolled(nodes: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Nest ``nodes`` (keys, rank, levels, hash, payload) into blocks: keys, levels, block, hash, kids.

    A level above ``levels`` has one child only, whose hash goes up as it is.
    """
    digit = lambda i: F.shiftright("rank", 4 * i).bitwiseAND(FAN - 1)
    digits = [f"d{i}" for i in range(BLOCK_DIGITS)]
    rows = nodes.select(
        *keys, "levels", F.shiftright("rank", 4 * BLOCK_DIGITS).alias("block"),
        *[digit(i).alias(d) for i, d in enumerate(digits)], "hash",
        F.struct(*(payload or [F.lit(True).alias("inner")])).alias("kids"),  # a struct must have a field
    )
    rows = rows.repartition(*keys, "block")
    for i, d in enumerate(digits):
        left = digits[i + 1 :]
        rows = rows.groupBy(*keys, "levels", "block", *left).agg(F.sort_array(F.collect_list(F.struct(d, "hash", "kids"))).alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["hash"]), ""), 256)
        rows = rows.withColumn("hash", F.when(F.col("levels") > i, joined).otherwise(F.col("kids")[0]["hash"]))
    return rows


def unrolled(blocks: DataFrame, keys: list[str], upper: list[str]) -> DataFrame:
    """The nodes of nested ``blocks`` that carry ``path`` (siblings above the block) and the columns ``upper``.

    Gives keys, rank, hash, payload, path (from the node up) and ``upper``.
    """
    side = lambda kids: F.array_join(F.transform(kids, lambda k: k["hash"]), "")
    rows = blocks.withColumn("rank", F.col("block"))
    for i in reversed(range(BLOCK_DIGITS)):
        rows = rows.select(*keys, "levels", *upper, "rank", "path", F.col("kids").alias("all"), F.posexplode("kids").alias("at", "kid"))
        beside = F.struct(
            side(F.slice("all", F.lit(1), F.col("at"))).alias("left"),
            side(F.slice("all", F.col("at") + 2, F.lit(FAN))).alias("right"),
        )
        path = F.when(F.col("levels") > i, F.concat(F.array(beside), "path")).otherwise(F.col("path"))
        rows = rows.select(
            *keys, "levels", *upper, (F.col("rank") * FAN + F.col(f"kid.d{i}")).alias("rank"), path.alias("path"),
            F.col("kid.hash").alias("hash"), F.col("kid.kids").alias("kids"),
        )
    return rows.select(*keys, *upper, "rank", "hash", "path", "kids.*")


def meet(blocks: DataFrame, above: DataFrame, keys: list[str], upper: list[str]) -> DataFrame:
    """Put the rows from above (keys, rank of the block, path, upper) and the nested blocks together by grouping."""
    both = [*keys, "block"]
    nested = blocks.select(*both, "levels", "kids", *[F.lit(None).cast(above.schema[c].dataType).alias(c) for c in ("path", *upper)])
    tops = above.select(
        *keys, F.col("rank").alias("block"),
        *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("levels", "kids")], "path", *upper,
    )
    pick = [F.first(c, ignorenulls=True).alias(c) for c in ("levels", "kids", "path", *upper)]
    return nested.unionByName(tops).groupBy(*both).agg(*pick)


def tree(nodes: DataFrame, keys: list[str], payload: list[str], what: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of nested blocks, lowest first, and the one node of each key (keys, hash)."""
    rounds = []
    most = nodes.agg(F.max("levels")).first()[0] or 0
    while True:
        blocks = written(rolled(nodes, keys, payload), f"{what}-{len(rounds)}")
        rounds.append(blocks)
        most -= BLOCK_DIGITS
        if most <= 0:
            return rounds, blocks.select(*keys, "hash")
        nodes = blocks.select(*keys, F.col("block").alias("rank"), F.greatest(F.col("levels") - BLOCK_DIGITS, F.lit(0)).alias("levels"), "hash")
        payload = []


def descend(rounds: list[DataFrame], above: DataFrame, keys: list[str], upper: list[str]) -> DataFrame:
    """Carry ``above`` (keys, rank 0, path, upper) down through the rounds to the lowest nodes."""
    for blocks in reversed(rounds):
        above = unrolled(meet(blocks, above, keys, upper), keys, upper)
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text) with its proof.

    doc_id, source, leaf, tampered (the leaf after tampering, null where nothing is tampered with), path (siblings to the left
    and right, from the leaf's run up to the root), subroot and root.  Leaves go by doc_id (null first, equal ids by hash), sources
    by bytes (null first, a source of its own).  Repeated rows are leaves of their own.  Any field may be null or empty.  An
    empty table has no rows.  Other columns are not read.
    """
    lowered = F.when(is_tampered(), leaf_hash({"text": ascii_lower(F.col("text"))}))
    leaves = written(docs.select("doc_id", "source", leaf_hash({}).alias("hash"), lowered.alias("tampered")), "merkle-leaves")
    nodes = written(ranked(leaves, ["source"], ["doc_id", "hash"], "merkle-ranges"), "merkle-ranked").withColumn("levels", levels_of("n"))
    rounds, subroots = tree(nodes, ["source"], ["doc_id", "tampered"], "merkle")
    tops = ranked(subroots.withColumn("key", F.lit(0)), ["key"], ["source"], "merkle-sources").withColumn("levels", levels_of("n"))
    upper_rounds, root = tree(tops, ["key"], ["source"], "merkle-tops")
    top = root.select("key", F.lit(0).cast("long").alias("rank"), F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    sources = descend(upper_rounds, top, ["key"], ["root"]).withColumnRenamed("hash", "subroot")
    start = sources.select("source", F.lit(0).cast("long").alias("rank"), "path", "subroot", "root")
    out = descend(rounds, start, ["source"], ["subroot", "root"])
    return out.select("doc_id", "source", F.col("hash").alias("leaf"), "tampered", "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    rows = manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", proof_hash(path).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), path).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:-1]) + " || {text})"
_CRC = """xor(list_reduce([4294967295] || list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: nodes of a tree by level; {0} is the tree's key, {1} its leaves
_TREE = """
  SELECT {0} AS k, 0 AS level, r, h, count(*) OVER (PARTITION BY {0}) AS n FROM {1}
  UNION ALL
  SELECT k, level + 1, r // 16, sha256(string_agg(h, '' ORDER BY r)), (n + 15) // 16 FROM {2} WHERE n > 1 GROUP BY k, level, r // 16, n
"""
#: siblings of every node that has a level above it
_SIDES = """
  SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY k, level, r // 16 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lt,
    coalesce(string_agg(h, '') OVER (PARTITION BY k, level, r // 16 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt
  FROM {0} WHERE n > 1
"""

ORACLE = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, {_LEAF.format(text=_FIELD.format("text"))} AS h,
    CASE WHEN {_CRC} % {TAMPERED_OF} = 0 THEN {_LEAF.format(text=_FIELD.format(_LOWER))} END AS t FROM documents),
low AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS r FROM l),
t AS ({_TREE.format("source", "low", "t")}),
high AS (SELECT 0 AS k, k AS source, h, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS r FROM t WHERE n = 1),
u AS ({_TREE.format("k", "high", "u")}),
s AS ({_SIDES.format("t")}),
v AS ({_SIDES.format("u")}),
f AS (
  SELECT doc_id, low.source, low.h AS leaf, low.r, high.h AS subroot, high.r AS top, coalesce(t, low.h) AS cur, '' AS proof, 0 AS level
  FROM low JOIN high ON low.source IS NOT DISTINCT FROM high.source
  UNION ALL
  SELECT doc_id, source, leaf, f.r // 16, subroot, top, sha256(lt || cur || rt), proof || lt || rt, f.level + 1
  FROM f JOIN s ON s.k IS NOT DISTINCT FROM f.source AND s.level = f.level AND s.r = f.r),
g AS (
  SELECT doc_id, leaf, subroot, top, cur, proof, 0 AS level FROM f
  WHERE level = (SELECT max(level) FROM t WHERE t.k IS NOT DISTINCT FROM f.source)
  UNION ALL
  SELECT doc_id, leaf, subroot, top // 16, sha256(lt || cur || rt), proof || lt || rt, g.level + 1
  FROM g JOIN v ON v.level = g.level AND v.r = g.top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM g, (SELECT h AS root FROM u WHERE n = 1) WHERE level = (SELECT max(level) FROM u)
""",
}

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
