"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of three hashed ones: of the word, of its first 4 and of its first 6
bytes, so that inflected and compounded forms share what was learned of their stem.  Filters of widths 1, 2 and 3 run over the
word sequence, each keeps its largest response over the whole text, and a logistic unit
joins them.  All labelled rows are learned from, dealt into shares that tasks train on:
one half of the texts gives each bucket's first embedding number (its shrunken log odds, counted over all
shares), the other trains all parameters by Adam, so that those odds are not fitted to the texts that
train the filters.  Every share starts from the same parameters, and what the shares add is averaged.
Three folds are each scored by a model of the other two; those scores calibrate the final model,
so that 0.5 means even odds and a model without skill gives the share of toxic texts, and choose thresholds by language.

Scoring is one pass over all whole texts.  A filter's response is a sum of one number per word,
so the trained filters are multiplied into the embedding table once and scoring only gathers and adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tremorlake.llm.text import ALNUM, column_bytes, hashes, release_memory, slices, spans, table, written

BUCKETS = 1 << 15
STEMS = (4, 6)
ROWS = BUCKETS * (1 + len(STEMS))
DIMS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
SHARE = 8000  # texts that are trained on at once, and their bytes
SHARE_BYTES = 16 << 20
BITS = 1 << 24
PIECES = 64
STEP = 0.01
LOGIT = 60.0
EPOCHS = 6
BATCH = 48
RATE = 0.01
FOLDS = 3
RIDGE = 4.0  # pull of the calibration's slope towards none, in texts
CALIBRATE = 50  # toxic texts that a threshold of its own needs
SEED = 5
SLICE = 2 << 20


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word (word, two stems) and the row offsets."""
    data, offsets = column_bytes(texts)
    lower, first, last, rows = spans(data, offsets, ALNUM)
    parts = [(hashes(lower, first, np.minimum(last, first + n)) >> np.uint64(20)) & np.uint64(BUCKETS - 1) for n in (len(data), *STEMS)]
    return np.stack([p.astype(np.int32) + i * BUCKETS for i, p in enumerate(parts)], axis=1), rows


def sliced_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_buckets`` of many texts, worked out slice by slice."""
    parts, sizes = [np.zeros((0, 1 + len(STEMS)), np.int32)], [np.zeros(1, np.int64)]  # whole slices, not all texts at once
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), most=SLICE):
        buckets, rows = word_buckets(part.column(0))
        parts.append(buckets)
        sizes.append(np.diff(rows))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


@dataclass
class TextCnn:
    """Embeddings, filters (one matrix per width: width*DIMS x FILTERS), their biases, the logistic unit."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def first(cls, odds: np.ndarray, prior: float) -> TextCnn:
        rng = np.random.default_rng(SEED)
        embed = rng.normal(0, 0.05, (ROWS, DIMS))
        embed[:, 0] = odds
        filters = []
        for w in WIDTHS:
            f = rng.normal(0, 0.05, (w * DIMS, FILTERS))
            f[::DIMS] += rng.uniform(0.2, 1.0, (w, FILTERS)) / w
            filters.append(f)
        return cls(embed, filters, [np.zeros(FILTERS) for _ in WIDTHS], rng.uniform(0.2, 0.6, len(WIDTHS) * FILTERS), prior)

    def _responses(self, x: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        """Responses at each word; words beyond a text's end count as zeros."""
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            r = x @ f[:DIMS] + b
            for j in range(1, w):
                inside = row[j:] == row[:-j]
                r[:-j] += (x[j:] @ f[j * DIMS : (j + 1) * DIMS]) * inside[:, None]
            out.append(r)
        return out

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out]

    def gradients(self, buckets: np.ndarray, rows: np.ndarray, label: np.ndarray):
        """Loss gradients of one batch; embeddings as (bucket, gradient) pairs."""
        n = len(rows) - 1
        row = np.repeat(np.arange(n), np.diff(rows))
        x = _gathered(self.embed, buckets)
        pooled, places = [], []
        for r in self._responses(x, row):
            best = np.zeros((n, FILTERS), np.int64)
            for i in range(n):
                if rows[i + 1] > rows[i]:
                    best[i] = rows[i] + r[rows[i] : rows[i + 1]].argmax(0)
            full = (np.diff(rows) > 0)[:, None]
            pooled.append(np.where(full, np.take_along_axis(r, best, 0) if len(r) else 0.0, 0.0))
            places.append(best)
        p = np.concatenate(pooled, 1)
        active = np.maximum(p, 0)
        error = (1 / (1 + np.exp(-(active @ self.out + self.offset))) - label) / n
        back = (error[:, None] * self.out) * (p > 0)
        grads, biases, at, value = [], [], [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(f)
            for j in range(w):
                place = np.minimum(places[k] + j, len(x) - 1)
                inside = ((places[k] + j < rows[1:, None]) * g)[:, :, None]
                grad[j * DIMS : (j + 1) * DIMS] = (x[place] * inside).sum(0).T
                at.append(buckets[place].reshape(-1, buckets.shape[1]))
                value.append((inside * f[j * DIMS : (j + 1) * DIMS].T[None]).reshape(-1, DIMS))
            grads.append(grad)
            biases.append(g.sum(0))
        return [*grads, *biases, active.T @ error], error.sum(), np.concatenate(at), np.concatenate(value)

    def compiled(self) -> Scorer:
        tables = [
            [(self.embed @ f[j * DIMS : (j + 1) * DIMS]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, self.filters)
        ]
        return Scorer(tables, [b.astype(np.float32) for b in self.bias], self.out, self.offset)


@dataclass
class Scorer:
    """A trained model with its filters multiplied into per-word tables."""

    tables: list[list[np.ndarray]]
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.of_buckets(*word_buckets(texts))

    def of_buckets(self, buckets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(buckets, rows)))

    def logits(self, buckets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(np.diff(rows))
        pooled = np.zeros((len(rows) - 1, len(self.out)))
        if len(full):
            last = np.zeros(len(buckets), bool)
            last[rows[full + 1] - 1] = True
            for k, tables in enumerate(self.tables):
                r = _gathered(tables[0], buckets)
                inside = np.ones(len(buckets), bool)
                for j in range(1, len(tables)):
                    inside = inside[: len(buckets) - j] & ~last[j - 1 : len(buckets) - 1]
                    r[:-j] += _gathered(tables[j], buckets[j:]) * inside[:, None]
                pooled[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(r, rows[full]) + self.bias[k]
        return np.maximum(pooled, 0) @ self.out + self.offset


def _gathered(rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    out = rows[buckets[:, 0]]
    for i in range(1, buckets.shape[1]):
        out += rows[buckets[:, i]]
    return out


def _best_threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1; 0.5 where nothing is better or too few are toxic to tell."""
    if weight[label].sum() < CALIBRATE:
        return 0.5
    grid = np.round(np.arange(0.4, 0.71, 0.05), 2)

    def f1(t: float) -> float:
        hit = score >= t
        return 2 * weight[hit & label].sum() / max(1, weight[hit].sum() + weight[label].sum())

    return float(max(sorted(grid, key=lambda t: abs(t - 0.5)), key=f1))


def _dealt(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fold and half of each text of a share, dealt label by label."""
    order = np.random.default_rng(SEED).permutation(len(label))
    fold, half = np.zeros(len(label), int), np.zeros(len(label), int)
    for y in (0, 1):
        mine = order[label[order] == y]
        fold[mine] = np.arange(len(mine)) % FOLDS
        half[mine] = np.arange(len(mine)) // FOLDS % 2
    return fold, half


def _counted(buckets: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Per fold: the texts of half 0 that hold each bucket, by label; texts of half 0 and all texts, by label."""
    fold, half = _dealt(label)
    out = np.zeros((FOLDS, 2 * ROWS + 4))
    for i, y in enumerate(label.astype(int)):
        mine = out[fold[i]]
        mine[2 * ROWS + 2 + y] += 1
        if half[i] == 0:
            mine[2 * ROWS + y] += 1
            mine[y * ROWS + np.unique(buckets[rows[i] : rows[i + 1]])] += 1
    return out


def _counts_of(counts: np.ndarray, model: int) -> np.ndarray:
    """What model ``model`` counts: all folds but its own; the last model has all."""
    return counts.sum(0) if model == FOLDS else counts.sum(0) - counts[model]


def _start(counts: np.ndarray) -> tuple[TextCnn, bool]:
    """The model before training, and whether there is anything to learn (both labels)."""
    df, size, have = counts[: 2 * ROWS].reshape(2, ROWS), counts[2 * ROWS : 2 * ROWS + 2], counts[2 * ROWS + 2 :]
    share = have[1] / have.sum() if have.sum() else 0.0
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not 0 < share < 1:
        model = TextCnn.first(np.zeros(ROWS), prior)
        model.out[:] = 0
        return model, False
    both = df.sum(0)
    odds = np.log((df[1] + 0.5) / (size[1] + 1)) - np.log((df[0] + 0.5) / (size[0] + 1))
    return TextCnn.first(np.clip(odds, -3, 3) * both / (both + 8), prior - 1), True


def _learn(model: TextCnn, buckets: np.ndarray, rows: np.ndarray, label: np.ndarray, learn: np.ndarray) -> None:
    """Train by Adam on the texts ``learn``."""
    rng = np.random.default_rng(SEED)
    params = model.parameters()
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            words = np.concatenate([np.zeros((0, 1 + len(STEMS)), np.int32), *[buckets[rows[i] : rows[i + 1]] for i in batch]])
            if not len(words):
                continue
            edges = np.concatenate([[0], np.cumsum(np.diff(rows)[batch])])
            grads, offset, at, value = model.gradients(words, edges, label[batch])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for p, g, (m, v) in zip(params, grads, moment):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.offset -= rate * 10 * offset
            for i in range(at.shape[1]):
                np.add.at(model.embed, at[:, i], -rate * 20 * value)


def _flat(model: TextCnn) -> np.ndarray:
    return np.concatenate([model.embed.ravel(), *[p.ravel() for p in model.parameters()], [model.offset]])


def _moved(counts: np.ndarray, model: int, delta: np.ndarray) -> TextCnn:
    """A model from its counts and what training added to its parameters."""
    out, _ = _start(_counts_of(counts, model))
    at = 0
    for p in (out.embed, *out.parameters()):
        p += delta[at : at + p.size].reshape(p.shape)
        at += p.size
    out.offset += float(delta[at])
    return out


def _trained(counts: np.ndarray, buckets: np.ndarray, rows: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(model, texts learned from, added to the parameters) of a share; model ``FOLDS`` learns from all folds."""
    fold, half = _dealt(label)
    for f in range(FOLDS + 1):
        model, able = _start(_counts_of(counts, f))
        learn = np.flatnonzero((fold != f) & (half == 1))
        if not able or not len(learn):
            continue
        before = _flat(model)
        _learn(model, buckets, rows, label, learn)
        yield f, len(learn), _flat(model) - before


def _crossed(models: list[Scorer], buckets: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Each text's logit by the model that did not learn from its fold."""
    fold, _ = _dealt(label)
    logit = np.zeros(len(label))
    for f in range(FOLDS):
        mine = np.flatnonzero(fold == f)
        for part in np.array_split(mine, -(-len(mine) // BATCH) or 1):
            words = np.concatenate([np.zeros((0, 1 + len(STEMS)), np.int32), *[buckets[rows[i] : rows[i + 1]] for i in part]])
            logit[part] = models[f].logits(words, np.concatenate([[0], np.cumsum(np.diff(rows)[part])]))
    return logit


def _calibration(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the log odds on logits of texts that were not learned from.

    A ridge on the slope keeps it small where few texts speak for it; it is never negative. Without skill the score is the share.
    """
    n = weight.sum()
    centre = (weight * logit).sum() / n
    spread = np.sqrt((weight * (logit - centre) ** 2).sum() / n) or 1.0
    u = (logit - centre) / spread
    share = ((weight * label).sum() + 0.5) / (n + 1)
    a, b = 0.0, float(np.log(share / (1 - share)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * u + b)))
        w = weight * (p * (1 - p) + 1e-9)
        e = weight * (p - label)
        g = np.array([(e * u).sum() + RIDGE * a, e.sum()])
        h = np.array([[(w * u * u).sum() + RIDGE, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    if a < 0:
        a, b = 0.0, float(np.log(share / (1 - share)))
    return a / spread, b - a * centre / spread


def _calibrated(model: TextCnn, logit: np.ndarray, label: np.ndarray, langs: np.ndarray, weight: np.ndarray) -> TextCnn:
    """The model with calibrated scores and thresholds; the logits come from models of other folds."""
    slope, offset = _calibration(logit, label, weight)
    score = 1 / (1 + np.exp(-(slope * logit + offset)))
    model.out, model.offset = model.out * slope, model.offset * slope + offset
    truth = label == 1
    model.threshold = _best_threshold(score, truth, weight)
    for x in set(langs) - {""}:
        if weight[truth & (langs == x)].sum() >= CALIBRATE:
            model.thresholds[x] = _best_threshold(score[langs == x], truth[langs == x], weight[langs == x])
    return model


def train_cnn(texts: pa.Array, toxic: np.ndarray, langs: list[str | None]) -> TextCnn:
    """Fit on one share of texts with 0/1 labels. Without both labels, scores are the label's share (0 with no rows).

    The texts are dealt into ``FOLDS``, label by label; each fold gets its scores from a model of the others, and
    those scores calibrate the final model, which learns from all, and choose the thresholds.
    """
    label = np.asarray(toxic, float)
    buckets, rows = sliced_buckets(texts)
    counts = _counted(buckets, rows, label)
    if not 0 < label.sum() < len(label):
        return _start(_counts_of(counts, FOLDS))[0]
    deltas = np.zeros((FOLDS + 1, len(_flat(_start(counts[0])[0]))))
    for f, _, delta in _trained(counts, buckets, rows, label):
        deltas[f] = delta
    models = [_moved(counts, f, deltas[f]) for f in range(FOLDS + 1)]
    logit = _crossed([m.compiled() for m in models[:FOLDS]], buckets, rows, label)
    return _calibrated(models[FOLDS], logit, label, np.array(["" if x is None else x for x in langs], object), np.ones(len(label)))


def _maybe_labelled(docs: DataFrame, one: DataFrame) -> DataFrame:
    """Drops most rows whose doc_id is not in ``one`` by a bitmap of hashed ids, so that their texts are not shuffled."""
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(BITS)) + 1
    bits = one.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    rows = docs.withColumn("_at", at).withColumn("_bucket", F.bitmap_bucket_number("_at")).withColumn("_bit", F.bitmap_bit_position("_at"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.join(F.broadcast(bits), "_bucket")
    return near.where(F.getbit(byte, F.pmod(F.col("_bit"), F.lit(8)).cast("int")) == 1).select(*docs.columns)


def labelled(docs: DataFrame, labels: DataFrame, learns=None) -> DataFrame:
    """All labelled texts, dealt by a hash of doc_id into shares of about ``SHARE`` texts or ``SHARE_BYTES``.

    Written once, a share in one run of sorted rows of one file. A document with several labels is toxic if one is.
    Labels are dealt as rows beside the texts: a join of both would deal them anew where there are more shuffle partitions than shares.
    """
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    one = one if learns is None else one.where(learns)
    near = _maybe_labelled(docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull()), one)
    have, size = near.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-have // SHARE), -(-size // SHARE_BYTES))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(n)).alias("share")
    key = F.col("doc_id").cast("long").alias("doc_id")
    texts = near.select(share, key, "text", "lang", F.lit(None).cast("int").alias("toxic"), F.lit(True).alias("_is_text"))
    marks = one.select(share, key, F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "toxic", F.lit(False).alias("_is_text"))
    dealt = texts.union(marks).repartition(n, "share").withColumn("toxic", F.max("toxic").over(Window.partitionBy("share", "doc_id")))
    dealt = dealt.where(F.col("_is_text") & F.col("toxic").isNotNull()).drop("_is_text")
    return written(dealt.sortWithinPartitions("share", "doc_id", "text", "lang"), "labelled")


def _by_share(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The shares of a task, one after the other."""
    have, parts = None, []
    for batch in batches:
        share = batch.column("share").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(share)) + 1), len(share)]
        for start, stop in zip(edges, edges[1:]):
            if stop == start:
                continue
            if parts and share[start] != have:
                yield have, pa.Table.from_batches(parts)
                parts = []
            have = int(share[start])
            parts.append(batch.slice(start, stop - start))
    if parts:
        yield have, pa.Table.from_batches(parts)


def _prepared(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return *sliced_buckets(rows["text"].combine_chunks()), rows["toxic"].to_numpy().astype(float)


def _pieces(share: int, model: int, weight: float, values: np.ndarray, kind: type) -> pa.RecordBatch:
    parts = [x.astype(kind).tobytes() for x in np.array_split(values, PIECES)]
    names = ("share", "model", "piece", "weight", "value")
    columns = [[share] * PIECES, [model] * PIECES, list(range(PIECES)), [float(weight)] * PIECES, parts]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


PIECED = "share long, model int, piece int, weight double, value binary"


def _combined(pieces: DataFrame, models: int, mean: bool) -> np.ndarray:
    """Sum or weighted mean of the shares' vectors, piece by piece on the executors; the driver gets one vector a model."""

    def combine(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("share")  # the same sum whatever order the shares come in
        weight = rows["weight"].to_numpy()
        total = 0.0
        for w, v in zip(weight, rows["value"]):
            total = total + w * np.frombuffer(v.as_buffer(), np.float16 if mean else np.float32).astype(float)
        total = total / weight.sum() if mean else total
        return pa.table({"model": rows["model"][:1], "piece": rows["piece"][:1], "value": pa.array([total.astype(np.float32 if mean else float).tobytes()], pa.binary())})

    got = pieces.groupBy("model", "piece").applyInArrow(combine, "model int, piece int, value binary").collect()
    found = {(r["model"], r["piece"]): np.frombuffer(r["value"], np.float32 if mean else float) for r in got}
    whole = [np.concatenate([found[m, i] for i in range(PIECES)]) if (m, 0) in found else None for m in range(models)]
    size = next((len(x) for x in whole if x is not None), 0)
    return np.stack([np.zeros(size, np.float32 if mean else float) if x is None else x for x in whole])


def train(docs: DataFrame, labels: DataFrame, learns=None) -> TextCnn:
    """Fit on all labelled rows in three passes over their shares; the driver gets sums, mean parameters and a histogram.

    The first pass counts, for the odds over all shares.  In the second each share trains from the start that
    those odds give, and the parameters are averaged by texts learned from.  The third scores each text by the
    model of the other folds; those logits are counted in steps of ``STEP`` by label and language, and calibrate.
    """
    shares = labelled(docs, labels, learns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, rows in _by_share(batches):
            for f, values in enumerate(_counted(*_prepared(rows))):
                yield _pieces(share, f, 1.0, values, np.float32)
        release_memory()  # the worker lives on

    counts = _combined(shares.mapInArrow(count, PIECED), FOLDS, mean=False)
    have = counts[:, 2 * ROWS + 2 :].sum(0) if counts.size else np.zeros(2)
    if not have.all():
        return _start(_counts_of(counts, FOLDS))[0] if counts.size else train_cnn(pa.array([], pa.string()), np.zeros(0), [])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, rows in _by_share(batches):
            for f, n, delta in _trained(counts, *_prepared(rows)):
                yield _pieces(share, f, n, delta, np.float16)  # steps of a thousandth, averaged
        release_memory()

    deltas = _combined(shares.mapInArrow(learn, PIECED), FOLDS + 1, mean=True)
    if not deltas.size:
        deltas = np.zeros((FOLDS + 1, len(_flat(_start(counts[0])[0]))), np.float32)
    crossing = deltas[:FOLDS]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [_moved(counts, f, crossing[f]).compiled() for f in range(FOLDS)]
        for _, rows in _by_share(batches):
            logit = _crossed(models, *_prepared(rows))
            step = np.rint(np.clip(logit, -LOGIT, LOGIT) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), rows["toxic"].combine_chunks(), rows["lang"].combine_chunks()], names=["step", "toxic", "lang"])
        del models
        release_memory()

    steps = shares.mapInArrow(cross, "step long, toxic int, lang string").groupBy("step", "toxic", "lang").count().collect()
    steps.sort(key=lambda r: (r["step"], r["toxic"], r["lang"] or ""))
    column = lambda c: np.array([r[c] for r in steps], float)
    langs = np.array([r["lang"] or "" for r in steps], object)
    return _calibrated(_moved(counts, FOLDS, deltas[FOLDS]), column("step") * STEP, column("toxic"), langs, column("count"))


def score_toxicity(docs: DataFrame, model: TextCnn) -> DataFrame:
    """Add ``score`` (0 to 1) to every row, for its whole text.

    Words alone decide the score.  A text without words (null, empty) gets the score of no response.
    Other columns pass unchanged; a column named score is replaced.  Rows are neither shuffled nor gathered.
    """
    docs = docs.drop("score")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    scorer = model.compiled()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                score = scorer.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def threshold_of(model: TextCnn, lang="lang"):
    """The calibrated threshold of a row's language; other languages take the overall one."""
    pick = F.lit(model.threshold)
    for x, t in sorted(model.thresholds.items()):
        pick = F.when(F.col(lang) == x, F.lit(t)).otherwise(pick)
    return pick


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below their language's threshold, with their columns as they are."""
    model = train(docs, labels)
    scored = score_toxicity(docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs, model)
    out = scored.where(F.col("score") < threshold_of(model)).drop("score")
    return out.withColumnRenamed("__score", "score") if "__score" in out.columns else out


def held_out(doc_id="doc_id", folds: int = 5):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, table(spark, sf_dir, "labels"), learns=~held_out())
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold_of(model).alias("threshold"),
    )


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
