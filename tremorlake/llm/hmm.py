"""Language-model scores from a hidden Markov model.

A latent state emits a word class, the class emits the token:

    P(text) = sum over state paths of  prod P(state | state before) P(class | state) P(token | class)

The last factor needs no state, so it is a plain sum of logarithms per text.  Classes
are the ``TOP`` commonest training tokens, one each, and ``TAILS`` classes of the rest by their
last two bytes.  P(token | class) is add-one smoothed over the class with one place for
tokens never seen, so a class's probabilities sum to one, as those of the base do.

Counts: texts are dealt into chunks of bounded size by a hash; each chunk sends one row for
each different token and gets that token's corpus count back, so the shuffled rows are far
fewer than the tokens and a hot token is one row a chunk.  Tokens are told apart by 64-bit hashes.
Training: each Baum-Welch round runs over the class sequences of all training texts; every task
sends its expected counts (states x classes numbers), Spark adds them up, and the driver
normalises a model of that fixed size.  Scoring: scaled forward recursion over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorlake.llm.text import SPACED, column_bytes, hashes, slices, spans, table, written

STATES = 8
TOP = 1024
TAILS = 512
CLASSES = TOP + TAILS
ROUNDS = 4
SEGMENT = 64  # training cuts class sequences into segments; scoring does not
CHUNK_BYTES = 8 << 20
SLICE = 1 << 20  # text that is taken apart at once; a slice needs some 45 times its bytes
END = int(np.int64(0x5EEDE0D5EEDE0D5))
SEED = 11


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes as signed 64-bit, class by the last two bytes, row offsets); each row ends with END."""
    data, offsets = column_bytes(texts)
    lower, first, last, rows = spans(data, offsets, SPACED)
    h = hashes(lower, first, last).view(np.int64)
    before = np.where(last - first > 1, lower[np.maximum(last - 2, 0)], 0).astype(np.int64)
    tail = (lower[last - 1].astype(np.int64) * 131 + before) % TAILS if len(last) else np.zeros(0, np.int64)
    h, tail = np.insert(h, rows[1:], END), np.insert(tail, rows[1:], 0)
    return h, tail, rows + np.arange(len(rows))


def _dealt(docs: DataFrame) -> DataFrame:
    """(row columns, chunk): chunks of about CHUNK_BYTES; a text belongs to one chunk."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    chunks = max(1, -(-total // CHUNK_BYTES))
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text")
    return docs.withColumn("chunk", F.pmod(key, F.lit(chunks)))


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different token of a chunk; a chunk's rows come one after the other."""
    schema = pa.schema([("chunk", pa.int64()), ("token", pa.int64()), ("tail", pa.int32()), ("n", pa.int64())])
    held: dict[int, list] = {}

    def flush(chunk: int) -> pa.RecordBatch:
        h, tail, n = (np.concatenate(x) for x in zip(*held.pop(chunk)))
        token, at, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=n, minlength=len(token)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(token), chunk)), pa.array(token), pa.array(tail[at].astype(np.int32)), pa.array(total)], schema=schema)

    for batch in batches:
        for part in slices(batch, most=SLICE):
            h, tail, offsets = tokens_of(part.column("text"))
            learns = ~part.column("held_out").to_numpy(zero_copy_only=False)
            chunk = part.column("chunk").to_numpy()
            row = np.repeat(np.arange(len(chunk)), np.diff(offsets))
            for c in np.unique(chunk):
                mine = chunk[row] == c
                token, at, back = np.unique(h[mine], return_index=True, return_inverse=True)
                n = np.bincount(back, weights=learns[row[mine]], minlength=len(token)).astype(np.int64)
                held.setdefault(int(c), []).append((token, tail[mine][at], n))
                for done in [x for x in held if x != c]:
                    yield flush(done)
    for c in list(held):
        yield flush(c)


def _encode(total: int, kinds: int, per_class: dict[int, tuple[int, int]]):
    """Join a chunk's texts with its tokens' counts: base score, class sequence, class part of the score."""
    # a class without training tokens has its one place for the unseen
    seen = np.array([per_class.get(c, (0, 0)) for c in range(CLASSES)], float)
    room = np.log10(seen[:, 0] + seen[:, 1] + 1)
    base_room = np.log10(total + kinds + 1)

    def run(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.drop_duplicates("token").sort_values("token")
        known, n, rank = (counts[c].to_numpy() for c in ("token", "count", "rank"))
        out = []
        for part in slices(pa.RecordBatch.from_pandas(texts[["text"]], schema=pa.schema([("text", pa.string())]), preserve_index=False), most=SLICE):
            h, tail, offsets = tokens_of(part.column("text"))
            at = np.searchsorted(known, h)
            c, r = n[at], rank[at]
            cls = np.where(r >= 0, r, TOP + tail).astype(np.int16)
            sums = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: B023, E731  every row has its END
            log_c = np.log10(c + 1.0)
            out.append(pd.DataFrame({
                "n_tokens": np.diff(offsets), "n_known": sums((c > 0).astype(np.int64)), "base_score": sums(log_c - base_room),
                "class_score": sums(log_c - room[cls]), "classes": [cls[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])],
            }))
        return pd.concat([texts[["doc_id", "held_out"]].reset_index(drop=True), pd.concat(out, ignore_index=True) if out else pd.DataFrame()], axis=1)

    return run


class Model:
    """Start, transition and class probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, weight: np.ndarray) -> Model:
        """Sticky states around the overall class shares, told apart by seeded noise."""
        rng = np.random.default_rng(SEED)
        emit = weight * rng.gamma(2.0, 0.5, (STATES, len(weight)))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, counts: np.ndarray, weight: np.ndarray) -> Model:
        """Normalise expected counts; every class keeps a part of the overall shares."""
        start = counts[:STATES] + 0.1
        move = counts[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1
        emit = counts[STATES + STATES**2 :].reshape(STATES, -1) + 10.0 * weight
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def expected(self, seqs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts over padded segments, all in step."""
        n, width = seqs.shape
        alpha, scale = np.empty((width, n, STATES)), np.empty((width, n))
        like = self.emit.T[seqs.T]  # (width, n, STATES)
        like[np.arange(width)[:, None] >= lengths] = 1.0
        a = self.start * like[0]
        for t in range(width):
            if t:
                a = (alpha[t - 1] @ self.move) * like[t]
            scale[t] = a.sum(1)
            alpha[t] = a / scale[t][:, None]
        start, move = np.zeros(STATES), np.zeros((STATES, STATES))
        weight = np.empty((width, n, STATES))
        beta = np.ones((n, STATES))
        for t in range(width - 1, -1, -1):
            real = lengths > t
            if t < width - 1:
                ahead = beta * like[t + 1] / scale[t + 1][:, None]
                later = (lengths > t + 1)[:, None]
                move += (alpha[t] * later).T @ (ahead * later)
                beta = np.where(later, ahead @ self.move.T, 1.0)
            gamma = alpha[t] * beta
            weight[t] = gamma / gamma.sum(1, keepdims=True) * real[:, None]
        start += weight[0].sum(0)
        flat, w = seqs.T.ravel(), weight.reshape(-1, STATES)
        emit = np.stack([np.bincount(flat, w[:, k], minlength=CLASSES) for k in range(STATES)])
        return np.concatenate([start, (move * self.move).ravel(), emit.ravel()])

    def score(self, classes: list[np.ndarray]) -> np.ndarray:
        """log10 probability of whole class sequences, by scaled forward recursion."""
        order = np.argsort([-len(c) for c in classes], kind="stable")
        length = np.array([len(classes[i]) for i in order])
        flat = np.concatenate([classes[i] for i in order]).astype(np.int64)
        at = np.cumsum(length) - length
        out = np.zeros(len(order))
        a = None
        log = np.zeros(len(order))
        alive = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for t, n in enumerate(alive):
            like = self.emit.T[flat[at[:n] + t]]
            a = self.start * like if t == 0 else (a[:n] @ self.move) * like
            s = a.sum(1, keepdims=True)
            a = a / s
            log[:n] += np.log10(s[:, 0])
        out[order] = log
        return out


def _segments(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cuts = [c[i : i + SEGMENT] for c in classes for i in range(0, len(c), SEGMENT)]
    lengths = np.array([len(c) for c in cuts])
    seqs = np.zeros((len(cuts), SEGMENT), np.int64)
    seqs[np.arange(SEGMENT) < lengths[:, None]] = np.concatenate(cuts)
    return seqs, lengths


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in batch.column("classes").to_pylist()]


def _round(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                seqs, lengths = _segments(_sequences(batch.slice(i, 64)))
                for j in range(0, len(seqs), 512):
                    more = model.expected(seqs[j : j + 512], lengths[j : j + 512])
                    total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    return run


def train(coded: DataFrame, weight: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows with ``classes``; no rows give the first model."""
    model = Model.first(weight)
    for _ in range(rounds):
        sums = coded.mapInArrow(_round(model), "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        got = sums.toPandas()  # as many rows as the model has numbers
        if got.empty:
            break
        counts = np.zeros(STATES + STATES**2 + STATES * CLASSES)
        counts[got["at"]] = got["value"]
        model = Model.of_counts(counts, weight)
    return model


def hmm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, held_out boolean): token counts, base and model score.

    Training uses the rows that are not held out.  A null text is empty, and an empty text is the end
    token alone.  Repeated rows each get a row and, when they train, count each time.  An
    empty table gives an empty result; without training rows every token is unseen.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    # ids travel as text: pandas would turn a column with a null into floating point
    dealt = _dealt(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    parts = dealt.repartition("chunk").sortWithinPartitions("chunk")
    local = written(parts.mapInArrow(_chunk_counts, "chunk long, token long, tail int, n long"), "chunk-tokens")
    tokens = written(local.groupBy("token").agg(F.sum("n").alias("count"), F.first("tail").alias("tail")), "tokens")
    top = tokens.where(F.col("count") > 0).orderBy(F.desc("count"), "token").limit(TOP).select("token").collect()
    rank = spark.createDataFrame([(r[0], i) for i, r in enumerate(top)], "token long, rank int")
    ranked = tokens.join(F.broadcast(rank), "token", "left").fillna(-1, "rank")
    cls = F.when(F.col("rank") >= 0, F.col("rank")).otherwise(F.col("tail") + TOP)
    sizes = ranked.where(F.col("count") > 0).groupBy(cls.alias("cls")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()
    per_class = {r["cls"]: (r["n"], r["v"]) for r in sizes}
    total, kinds = sum(n for n, _ in per_class.values()), sum(v for _, v in per_class.values())
    weight = np.array([sum(per_class.get(c, (0, 0))) + 1.0 for c in range(CLASSES)])
    weight /= weight.sum()
    back = local.select("chunk", "token").join(ranked.select("token", "count", "rank"), "token")
    coded = parts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(
        _encode(total, kinds, per_class),
        "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, class_score double, classes binary",
    )
    coded = written(coded.withColumn("doc_id", F.col("doc_id").cast("long")), "classes")
    model = train(coded.where(~F.col("held_out")).select("classes"), weight, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                value = part.column("class_score").to_numpy() + model.score(_sequences(part))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(value)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    out = coded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bucket = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return hmm_scores(docs.withColumn("held_out", bucket == 2)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {"op4_hmm_scores": op4_hmm_scores}
ORACLE: dict[str, str] = {}
