"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ``WINDOW`` words (a shorter item is one window).
The words of a window are ordered by how often the corpus has them.  A document contains a
window only if it contains all its words, so for containment the necessary prefix is the
rarest word alone: all document words are joined with those.  The place of the
prefix word inside the window fixes where the window would start; a start before the
document or an end after it is dropped (positional and length bound), and the rest is
verified word by word against the document.

The windows are broadcast only when their measured size is below ``BROADCAST_BYTES``.
Beyond it both joins are shuffled, and candidates fetch their document by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tremorlake.llm.text import NOT_ALNUM, checkpointed, table, words

WINDOW = 13
SHARE = 20  # contaminated when 1 in SHARE words is hit
BROADCAST_BYTES = 16 << 20
KEY = ("doc_id", "text_hash")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, length) for each window; items without words have none."""
    items = benchmark.select("item_id", words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1))))
    return items.select("item_id", "all", starts.alias("at")).select(
        "item_id", F.slice("all", F.col("at"), F.least(F.size("all"), F.lit(window))).alias("words")
    )


def _bytes(df: DataFrame, column: str) -> int:
    size = F.sum(F.octet_length(F.concat_ws(" ", column)) + 64)
    return df.agg(F.coalesce(size, F.lit(0))).first()[0]


def _small(df: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(df) if size <= most else df.hint("merge")


def prefixes(docs: DataFrame, windows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Each different window once, with its rarest word and that word's place.

    Windows with a word that the corpus lacks cannot occur and are left out.
    """
    distinct = windows.select("words").distinct()
    vocabulary = checkpointed(distinct.select(F.explode("words").alias("token")).distinct())
    size = _bytes(vocabulary, "token")
    counts = (
        docs.select(F.explode("words").alias("token"))
        .join(_small(vocabulary, size, most), "token")
        .groupBy("token")
        .agg(F.count("*").alias("seen"))
    )
    places = distinct.select("words", F.posexplode("words").alias("place", "token")).join(counts, "token")
    rarest = F.min(F.struct("seen", "token", "place"))
    return (
        places.groupBy("words")
        .agg(rarest.alias("r"), F.count("*").alias("found"))
        .where(F.col("found") == F.size("words"))
        .select("words", F.col("r.token").alias("token"), F.col("r.place").alias("place"))
    )


def occurrences(docs: DataFrame, pre: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """(key, start, words) for every place of a document that holds a window."""
    size = _bytes(pre, "words")
    pre = pre.withColumnRenamed("words", "window")
    start, length = F.col("pos") - F.col("place"), F.size("window")
    inside = (start >= 0) & (start + length <= F.col("n_words"))
    verified = F.slice("words", F.col("start") + 1, length) == F.col("window")
    if size <= most:
        found = docs.select(*KEY, "words", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "token"))
        found = found.join(F.broadcast(pre), "token").where(inside).select(*KEY, "words", start.alias("start"), "window")
        return found.where(verified).select(*KEY, "start", F.col("window").alias("words"))
    found = docs.select(*KEY, F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "token"))
    found = found.join(pre.hint("merge"), "token").where(inside).select(*KEY, start.alias("start"), "window")
    found = found.dropDuplicates([*KEY, "start", "window"]).alias("c")
    texts = docs.dropDuplicates(list(KEY)).alias("d")
    same = F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.text_hash") == F.col("d.text_hash"))
    return found.join(texts, same).where(verified).select("c.doc_id", "c.text_hash", "start", F.col("window").alias("words"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, most: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items
    with an occurring window.  A null or empty document has no words and is clean.  Repeated rows each
    get a row; rows are told apart by doc_id (null too) and text.  Items with a null id mark
    words but are not counted or listed.  An empty benchmark leaves every document clean.  Other columns
    of either table are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("words"))
    windows = checkpointed(item_windows(benchmark, window))
    pre = checkpointed(prefixes(base, windows, most))
    found = checkpointed(occurrences(base, pre, most).distinct())
    size = F.size("words")
    spans = found.select(*KEY, "start", (F.col("start") + size).alias("end")).distinct()
    before = W.partitionBy(*KEY).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = spans.select(*KEY, covered.alias("more")).groupBy(*KEY).agg(F.sum("more").alias("n_hit"))
    owned = windows.where(F.col("item_id").isNotNull()).distinct()
    items = (
        found.select(*KEY, "words")
        .distinct()
        .join(owned, "words")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    marks = hits.alias("h").join(items.alias("i"), _same("h", "i"), "left").select("h.*", "i.items")
    all_docs = base.select(*KEY, size.cast("long").alias("n_words"))
    out = all_docs.alias("d").join(marks.alias("m"), _same("d", "m"), "left")
    n_hit = F.coalesce("m.n_hit", F.lit(0)).cast("long")
    return out.select(
        "d.doc_id",
        "d.text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    bad = decontaminate(docs, benchmark).where("contaminated").select(*KEY).distinct().alias("b")
    keyed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).alias("k")
    same = F.col("k.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("k.__hash") == F.col("b.text_hash"))
    return keyed.join(bad, same, "left_anti").drop("__hash")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES = {"op8_decontaminate": op8_decontaminate}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')".format(
    NOT_ALNUM.replace("[", "[^", 1)
)
ORACLE = {
    "op8_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), {WINDOW}) AS k, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS p0 FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p0, p0 + k - 1), ' ') AS gram FROM g),
p AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p0 FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k),
f AS (SELECT rid, p0, k, item_id FROM (SELECT rid, p0, k, array_to_string(list_slice(w, p0, p0 + k - 1), ' ') AS gram FROM p) JOIN v USING (k, gram)),
h AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(p0, p0 + k)) AS pos FROM f) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM f) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND {SHARE} * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
}
