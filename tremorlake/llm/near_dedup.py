"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (a shorter text is one shingle).  A shingle weighs
(1 + ln tf) * idf, where idf runs from 1 down to ``FLOOR`` as its share of the documents rises from
1 / ``RARE`` to 1: boilerplate counts less, and the weights stay near enough to one that copies of a large
group are not lost because the group itself made their shingles common.  Only shingles over that
share need an entry; there are at most RARE x (mean shingles of a text) of them, so the
table has a bound that does not grow with the corpus, and it covers all documents.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per text; texts that agree in all
samples of a band are candidates.  Every member of a band's bucket is linked to the bucket's smallest
member (a star, never all pairs), links are verified by weighted Jaccard similarity on the whole texts, and
connected components follow.  Where a bucket still holds several components, the members outside its largest one
are compared with all others on their whole texts, in blocks of bounded bytes, so no link between different components
is lost and no cap is set on partners.

Exact copies are one node throughout and are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorlake.llm.text import ALNUM, checkpointed, column_bytes, hashes, mix, slices, spans, table, written

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
RARE = 1000
FLOOR = 0.7
COUNTED = 3_000_000  # shingles counted together
GROUP = 2048  # members of a block of a bucket; a task compares two blocks
BLOCK_BYTES = 8 << 20  # bytes of text of a block
SLICE = 2 << 20
SEED = 17

_rng = np.random.default_rng(SEED)
_ODD = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: quantiles of Gamma(2, 1): the scale r and the logarithm of c of the sampling scheme
_GAMMA = np.sort(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order of the text, row offsets)."""
    data, offsets = column_bytes(texts)
    lower, first, last, rows = spans(data, offsets, ALNUM)
    h = hashes(lower, first, last)
    n = np.diff(rows)
    total = np.concatenate([[np.uint64(0)], h])
    window = np.zeros(len(h), np.uint64)
    for i in range(SHINGLE):
        if len(h) > i:
            window[: len(h) - i] = mix(window[: len(h) - i] * np.uint64(3) + total[1 + i :])
    place = np.arange(len(h)) - np.repeat(rows[:-1], n)
    keep = place <= np.repeat(n, n) - SHINGLE
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    for r in short:
        w = np.full(1, n[r], np.uint64)
        for x in h[rows[r] : rows[r + 1]]:
            w = mix(w * np.uint64(3) + x)
        window[rows[r]], keep[rows[r]] = w[0], True
    return window[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def _distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each row, sorted: (shingle, times, row)."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    return h[at], np.diff(np.append(at, len(h))), row[at]


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text, worked out slice by slice: (shingle, times, row)."""
    out, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), most=SLICE):
        h, times, row = _distinct(*shingles(part.column("text")))
        out.append((h, times, row + at))
        at += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*out))


class Weights:
    """Shingle weights from the table of common shingles."""

    def __init__(self, common: np.ndarray, share: np.ndarray):
        order = np.argsort(common)
        self.common = common[order]
        self.idf = np.maximum(FLOOR, FLOOR - (1 - FLOOR) * np.log(share[order]) / np.log(RARE)).clip(FLOOR, 1.0)

    def of(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = 1 + np.log(times)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            w = np.where(self.common[at] == h, w * self.idf[at], w)
        return w


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples (rows x SAMPLES, 32 bits) of rows that start at ``starts``."""
    out = np.empty((len(starts), SAMPLES), np.uint32)
    log_w = np.log(weight).astype(np.float32)
    base = h ^ (h >> np.uint64(32))
    place = np.arange(len(h), dtype=np.int64)
    for k in range(SAMPLES):
        x = base * _ODD[k]
        x ^= x >> np.uint64(29)
        r = _GAMMA[x >> np.uint64(48)]
        beta = (x & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + beta)
        value = _LOG_GAMMA[(x >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta) - r
        bits = value.view(np.int32)
        ordered = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64)
        best = np.minimum.reduceat((ordered << 32) | place, starts) & 0xFFFFFFFF
        out[:, k] = (mix(h[best] + t[best].astype(np.int64).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return out


def _hot_buckets(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """Packed flags of the hash buckets (by the upper ``bits``) in which shingles occur ``least`` times or more."""
    block = 1 << min(12, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << bits, np.int64), [], 0
        for batch in batches:
            for part in slices(batch, most=SLICE):
                held.append((shingles(part.column("text"))[0] >> np.uint64(64 - bits)).astype(np.int64))
                size += len(held[-1])
                if size > COUNTED:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        for i, part in enumerate(np.minimum(total, least).reshape(-1, block)):  # more than least is as good as least
            if part.any():
                data = part.astype(np.min_scalar_type(int(part.max()))).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data])], names=["block", "counts"])

    def flags(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.uint64)
        for x in group["counts"]:
            total += np.frombuffer(x, f"u{len(x) // block}")
        return pd.DataFrame({"block": group["block"].iloc[:1], "hot": [np.packbits(total >= least).tobytes()]})

    sent = docs.select("text").mapInArrow(count, "block long, counts binary")
    hot = np.zeros((1 << bits) // block * block // 8, np.uint8).reshape(-1, block // 8)
    for r in sent.groupBy("block").applyInPandas(flags, "block long, hot binary").collect():
        hot[r["block"]] = np.frombuffer(r["hot"], np.uint8)
    return hot.ravel()


def common_shingles(docs: DataFrame) -> Weights:
    """Share of the documents of every shingle that at least 1 in RARE, and two at least, have.

    Shares are exact and do not depend on how the rows are dealt.  A first pass adds up occurrences in a table of hash
    buckets; a shingle whose bucket has too few cannot be common.  A second pass counts the documents of all others,
    so most unique shingles are never shuffled.  Fuller buckets only let more shingles into the second pass.
    """
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = max(2, -(-total // RARE))
    bits = int(np.clip(np.ceil(np.log2(1 + size / max(total, 1) * RARE / 2)), 16, 24))
    packed = _hot_buckets(docs, bits, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held, size = np.unpackbits(packed).astype(bool), [], 0

        def send():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["shingle", "n"])

        for batch in batches:
            for part in slices(batch, most=SLICE):
                h, rows = shingles(part.column("text"))
                keep = hot[(h >> np.uint64(64 - bits)).astype(np.int64)]
                h = _distinct(h[keep], np.concatenate([[0], np.cumsum(keep)])[rows])[0]
                held.append(h)
                size += len(h)
                if size > COUNTED:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).toPandas()
    return Weights(rows["shingle"].to_numpy(np.int64).view(np.uint64), np.minimum(1.0, rows["n"].to_numpy(float) / max(total, 1)))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, node, bands): the node is the text's digest; texts without words have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                h, times, row = _distinct(*shingles(part.column("text")))
                bands = [[]] * part.num_rows
                if len(h):
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    s = samples(h, weights.of(h, times), starts)
                    keys = np.empty((len(s), BANDS), np.uint64)
                    for b in range(BANDS):
                        k = np.full(len(s), b, np.uint64)
                        for i in range(ROWS):
                            k = mix(k * np.uint64(3) + s[:, b * ROWS + i])
                        keys[:, b] = k
                    for i, r in enumerate(row[starts]):
                        bands[r] = keys[i].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("node"), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"]
                )

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node binary, bands array<long>")


def _similar(weights: Weights, a: tuple, b: tuple) -> float:
    """The larger of weighted and plain Jaccard similarity."""
    (ha, na), (hb, nb) = a, b
    both = np.concatenate([ha, hb])
    every, at = np.unique(both, return_inverse=True)
    wa, wb = np.zeros(len(every)), np.zeros(len(every))
    wa[at[: len(ha)]] = weights.of(ha, na)
    wb[at[len(ha) :]] = weights.of(hb, nb)
    return max(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), ((wa > 0) & (wb > 0)).sum() / len(every))


def verified(pairs: DataFrame, docs: DataFrame, weights: Weights, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are similar, with the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.select("node", "text").join(nodes, "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "candidates")
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column):
            h, times, row = _distinct(*shingles(column))
            edge = np.searchsorted(row, np.arange(len(column) + 1))
            return [(h[i:j], times[i:j]) for i, j in zip(edge[:-1], edge[1:])]

        for batch in batches:
            for half in slices(batch, "text_a", SLICE):
                for part in slices(half, "text_b", SLICE):
                    got = np.array([_similar(weights, x, y) for x, y in zip(sets(part.column("text_a")), sets(part.column("text_b")))])
                    keep = pa.array(got >= similar)
                    yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(got[got >= similar])], names=["a", "b", "similarity"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(check, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components: smallest neighbour, then pointer jumping."""
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("at"))
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("top"))
        moved = checkpointed(step.join(up, "at").select("node", "was", F.least("at", "top").alias("root")))
        if moved.where(F.col("root") != F.col("was")).isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")


def _bucket_links(weights: Weights, similar: float):
    """Links of one bucket (or of two blocks of a large one) that join different components.

    A member's overlap with all others is one count over the postings of its shingles, so every pair of different
    components is compared exactly; a pair whose components are already joined is passed over.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        h, times, row = _sets(pa.array(group["text"], pa.string()))
        w, n = weights.of(h, times), len(group)
        label = pd.factorize(group["root"])[0]
        node = group["node"].to_numpy()
        which = np.unique(h, return_inverse=True)[1]
        order = np.argsort(which, kind="stable")
        size = np.bincount(which)
        start = np.cumsum(size) - size
        total, number = np.bincount(row, w, n), np.bincount(row, minlength=n)
        edge = np.searchsorted(row, np.arange(n + 1))
        out = []
        largest = np.bincount(label).argmax()
        for i in np.flatnonzero(label != largest):
            own = slice(edge[i], edge[i + 1])
            s, c = start[which[own]], size[which[own]]
            at = order[np.repeat(s - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
            shared = np.bincount(row[at], np.minimum(np.repeat(w[own], c), w[at]), n)
            count = np.bincount(row[at], minlength=n)
            like = np.maximum(shared / (total[i] + total - shared), count / (number[i] + number - count))
            for j in np.flatnonzero((like >= similar) & (label != label[i])):
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((min(node[i], node[j]), max(node[i], node[j]), like[j]))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return run


def across_components(buckets: DataFrame, roots: DataFrame, docs: DataFrame, weights: Weights, similar: float) -> DataFrame:
    """Verified links inside the buckets that hold several components.

    A bucket's largest component (by bytes) and its other members are each dealt into blocks of about ``BLOCK_BYTES``
    and ``GROUP`` members at the most.  Every block of others meets every block in one task; blocks of the largest
    component do not meet, as its members are joined already.
    """
    rooted = buckets.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    members = rooted.join(mixed.where(F.col("lo") != F.col("hi")).select("band"), "band")
    texts = docs.select("node", "text").join(members.select("node").distinct(), "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "members")
    sizes = texts.select("node", F.octet_length("text").cast("long").alias("bytes"))
    members = written(members.join(sizes, "node"), "mixed")
    parts = members.groupBy("band", "root").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    whole = parts.groupBy("band").agg(F.max(F.struct("bytes", "n", "root")).alias("main"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    blocks = lambda size, n: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES), F.ceil(n / GROUP)).cast("int")
    whole = whole.select(
        "band", F.col("main.root").alias("main"), blocks(F.col("main.bytes"), F.col("main.n")).alias("mains"),
        blocks(F.col("bytes") - F.col("main.bytes"), F.col("n") - F.col("main.n")).alias("others"),
    )
    every = lambda n, cell: F.transform(F.sequence(F.lit(0), F.col(n) - 1), cell)
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    main, own = F.col("root") == F.col("main"), F.col("own")
    # cell (i, j): others i and j if j is not negative, else others i and the largest component's block -1 - j
    of_main = every("others", lambda o: cell(o, -1 - own))
    of_other = F.concat(every("others", lambda o: cell(F.least(o, own), F.greatest(o, own))), every("mains", lambda o: cell(own, -1 - o)))
    dealt = members.join(whole, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    dealt = dealt.select("node", "band", "root", F.explode(F.when(main, of_main).otherwise(of_other)).alias("cell")).join(texts, "node")
    return dealt.groupBy("band", "cell").applyInPandas(_bucket_links(weights, similar), "a binary, b binary, similarity double")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, node, class_key, class_id, n_copies, n_links.

    ``class_key`` names the class, ``class_id`` is its smallest doc_id (null if all are null), ``n_copies`` the rows with the very same text,
    ``n_links`` the verified links of that text to other texts.  Texts without words (empty, blank) are only
    alike when equal; a null text counts as empty.  Repeated rows each get a row.  An empty table gives an empty
    result.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("node"))
    weights = common_shingles(docs)
    sigs = written(signatures(docs, weights), "signatures")
    banded = sigs.select("node", F.explode("bands").alias("band")).distinct()
    star = banded.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where(F.col("n") > 1)
    buckets = written(banded.join(star.select("band", "b"), "band"), "buckets")
    pairs = buckets.where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    pairs = checkpointed(pairs)
    links = checkpointed(verified(pairs, docs, weights, similar))
    roots = components(links)
    more = checkpointed(across_components(buckets, roots, docs, weights, similar).dropDuplicates(["a", "b"]))
    if not more.isEmpty():
        links = checkpointed(links.union(more))
        roots = components(links)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = sigs.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    nodes = nodes.join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = nodes.groupBy("root").agg(F.min("first").alias("class_id"))
    nodes = nodes.join(classes, "root").select("node", F.col("root").alias("class_key"), "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return sigs.select("doc_id", "node").join(nodes, "node").select("doc_id", "node", "class_key", "class_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with its columns as they are."""
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    # several rows can share a class's smallest doc_id: the smallest text digest, then any equal row
    kept = near_duplicates(docs, similar).where(first).groupBy("class_key").agg(F.first("class_id").alias("class_id"), F.min("node").alias("node"))
    node = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    keyed = docs.withColumn("__node", node).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.class_id")) & (F.col("d.__node") == F.col("k.node"))
    return keyed.join(kept.alias("k"), same, "left_semi").dropDuplicates(["doc_id", "__node"]).drop("__node")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_copies", "n_links")


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLE: dict[str, str] = {}
