"""Ordered building blocks, in a bounded and in a hot form.

Series tables hold one row per key and epoch: sources combine raw rows into
epochs with a map-side aggregate first (``epoch_series``), so a window partition
holds at most record length / epoch rows, however skewed the raw data is.  On
such tables the helpers use plain windows, and every ordered operator of a job
reuses one hash partitioning by key.

Tables without that bound (raw rows, very dense series) take the hot form:
pass ``hot=True`` or set ``tremorlake.series.hot`` to ``true`` on the session.
It never puts a key into one task:

* ``running``          two-level scan: windows inside (key, time chunk), carries
                       over one summary row per chunk;
* ``halo``             each row goes to its own block and to the neighbours whose
                       frame reaches it;
* ``key_stats``        statistics joined back through a salted key;
* ``exact_quantiles``  exact percentiles by bracketing.

The hot form reads its input more than once, so it first cuts the lineage with a
reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from tremorlake.session import cut

DAY_US = 86_400_000_000
CHUNK_DAYS = 180.0
ROW_BLOCK = 8192
SALTS = 64
HOT_CONF = "tremorlake.series.hot"


def is_hot(df: DataFrame, hot: bool | None) -> bool:
    if hot is not None:
        return hot
    return df.sparkSession.conf.get(HOT_CONF, "false").lower() == "true"


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def chunk_of(ts: Column | str, days: float = CHUNK_DAYS) -> Column:
    return F.floor(micros(ts) / F.lit(float(days * DAY_US))).cast("long")


def epoch_series(
    df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], *, epoch: str = "day", ts: str = "ts"
) -> DataFrame:
    """One row per key and epoch; partial sums are combined before the shuffle."""
    return df.groupBy(*keys, F.date_trunc(epoch, F.col(ts)).alias(ts)).agg(
        *[e.alias(n) for n, e in aggs.items()]
    )


def _boxed(value: Column) -> Column:
    """Struct wrapper so that a NULL value is still a value."""
    return F.struct(value.alias("v"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    *,
    chunk: Column | None = None,
    reverse: bool = False,
    hot: bool | None = None,
) -> DataFrame:
    """Add running aggregates over the whole key, ordered by ``order``.

    ``specs`` maps an output name to ``(kind, expression)`` with kind one of
    ``sum`` / ``count`` (inclusive), ``last`` (latest non-null, inclusive),
    ``lag`` (value of the previous row).  ``reverse`` scans from the end, so
    ``last`` becomes "next non-null" and ``lag`` becomes "lead".
    In the hot form ``order[0]`` must be the timestamp unless ``chunk`` is given.
    """
    keys = list(keys)

    def direction(c: str) -> Column:
        return F.col(c).desc() if reverse else F.col(c).asc()

    ordering = [direction(c) for c in order]
    if not is_hot(df, hot):
        w = W.partitionBy(*keys).orderBy(*ordering)
        upto = w.rowsBetween(W.unboundedPreceding, 0)
        plain = {
            "sum": lambda e: F.coalesce(F.sum(e).over(upto), F.lit(0.0)),
            "count": lambda e: F.count(e).over(upto),
            "last": lambda e: F.last(e, ignorenulls=True).over(upto),
            "lag": lambda e: F.lag(e).over(w),
        }
        return df.select(
            *[c for c in df.columns if c not in specs],
            *[plain[kind](e).alias(n) for n, (kind, e) in specs.items()],
        )

    src = df.withColumn("_chunk", chunk_of(order[0]) if chunk is None else chunk)
    for name, (_, expr) in specs.items():
        src = src.withColumn(f"_in_{name}", expr)
    src = cut(src)
    local = W.partitionBy(*keys, "_chunk").orderBy(*ordering)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    before = (
        W.partitionBy(*keys).orderBy(direction("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    )
    rank = F.struct(*[F.col(c) for c in order])
    edge = F.min_by if reverse else F.max_by
    totals, carries, combine = [], [], []
    for name, (kind, _) in specs.items():
        value, carry = F.col(f"_in_{name}"), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            fn, zero = (F.sum, F.lit(0.0)) if kind == "sum" else (F.count, F.lit(0))
            totals.append(fn(value).alias(f"_t_{name}"))
            carries.append(F.sum(f"_t_{name}").over(before).alias(f"_c_{name}"))
            combine.append((name, F.coalesce(fn(value).over(upto), zero) + F.coalesce(carry, zero)))
            continue
        boxed = F.when(value.isNotNull(), _boxed(value)) if kind == "last" else _boxed(value)
        totals.append(edge(boxed, F.when(boxed.isNotNull(), rank)).alias(f"_t_{name}"))
        carries.append(F.last(f"_t_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
        here = (
            F.last(boxed, ignorenulls=True).over(upto) if kind == "last" else F.lag(boxed).over(local)
        )
        combine.append((name, F.coalesce(here, carry)["v"]))
    carry_rows = src.groupBy(*keys, "_chunk").agg(*totals).select(*keys, "_chunk", *carries)
    out = src.join(carry_rows, [*keys, "_chunk"], "left").withColumns(dict(combine))
    return out.select(*df.columns, *[n for n in specs if n not in df.columns])


def with_row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx", **kw
) -> DataFrame:
    """0-based position of each row inside its key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, **kw).withColumn(
        name, F.col(name) - 1
    )


def halo(
    df: DataFrame,
    keys: Sequence[str],
    x: Column,
    before: float,
    after: float,
    outputs: dict[str, Callable],
    *,
    block: float | None = None,
    rows: bool = True,
    hot: bool | None = None,
) -> DataFrame:
    """Evaluate bounded frames ``[-before, +after]`` over the numeric order ``x``.

    ``outputs`` maps a name to a function of a window already ordered and framed
    (rows when ``rows`` else range); it may also use ``window.rowsBetween``.  In
    the hot form ``x`` must be the row index (or the time for range frames).
    """
    def framed(base):
        return (
            base.rowsBetween(-int(before), int(after))
            if rows
            else base.rangeBetween(-int(before), int(after))
        )

    if not is_hot(df, hot):
        frame = framed(W.partitionBy(*keys).orderBy("_x"))
        out = df.withColumn("_x", x)
        return out.select("*", *[fn(frame).alias(n) for n, fn in outputs.items()]).drop("_x")
    if block is None:
        block = max(ROW_BLOCK, 4 * (before + after)) if rows else 8 * (before + after)
    step = F.lit(float(block))
    spread = (
        df.withColumn("_x", x)
        .withColumn("_home", F.floor(F.col("_x") / step).cast("long"))
        .withColumn(
            "_block",
            F.explode(
                F.sequence(
                    F.floor((F.col("_x") - F.lit(after)) / step).cast("long"),
                    F.floor((F.col("_x") + F.lit(before)) / step).cast("long"),
                )
            ),
        )
    )
    frame = framed(W.partitionBy(*keys, "_block").orderBy("_x"))
    out = spread.select("*", *[fn(frame).alias(n) for n, fn in outputs.items()])
    return out.where(F.col("_block") == F.col("_home")).drop("_x", "_home", "_block")


def attach(
    big: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str],
    *,
    how: str = "inner",
    hot: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join one-row-per-key ``stats`` to ``big``.

    Spark broadcasts ``stats`` by itself when it measures them small.  In the hot
    form the key is salted, so a hot key spreads over ``salts`` tasks.
    """
    if not is_hot(big, hot):
        return big.join(stats, list(keys), how)
    salted = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    return left.join(salted, [*keys, "_salt"], how).drop("_salt")


def key_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: dict[str, Column],
    *,
    salt_on: Sequence[str] = ("ts",),
    hot: bool | None = None,
) -> DataFrame:
    """Add whole-key aggregates as columns."""
    if not is_hot(df, hot):
        w = W.partitionBy(*keys)
        return df.select("*", *[e.over(w).alias(n) for n, e in aggs.items()])
    df = cut(df)
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return attach(df, stats, keys, salt_on, hot=True)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: dict[str, float],
    *,
    hot: bool | None = None,
    margin: float = 5e-4,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linearly interpolated percentiles, one row per key.

    Hot form: a mergeable sketch proposes narrow value brackets around each
    percentile, bracket counts locate the wanted ranks exactly, and only the
    rows inside the chosen brackets are sorted.  A poor sketch costs time, never
    exactness.
    """
    keys = list(keys)
    v = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not is_hot(df, hot):
        return v.groupBy(*keys).agg(
            *[F.percentile("_v", F.lit(float(p))).alias(n) for n, p in probs.items()]
        )
    v = cut(v)
    edges = sorted(
        {min(max(p + d, 0.0), 1.0) for p in probs.values() for d in (-margin, margin)}
    )
    cuts = v.groupBy(*keys).agg(
        F.percentile_approx("_v", [float(e) for e in edges], accuracy).alias("_cuts"),
        F.count("*").alias("_n"),
    )
    below = sum(
        (F.when(F.col("_v") > F.col("_cuts")[i], 1).otherwise(0) for i in range(len(edges))),
        start=F.lit(0),
    )
    # identical values are merged early, so ties never make a bracket large
    binned = cut(
        attach(v, cuts, keys, ["_v"], hot=True)
        .groupBy(*keys, "_n", below.alias("_bin"), "_v")
        .agg(F.count("*").alias("_m"))
    )
    per_bin = binned.groupBy(*keys, "_n", "_bin").agg(F.sum("_m").alias("_size"))
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    start = per_bin.withColumn("_start", F.coalesce(F.sum("_size").over(upto), F.lit(0)))
    ends = F.array(
        *[
            F.struct(F.floor(pos).alias("lo"), F.ceil(pos).alias("hi"))
            for pos in (F.lit(float(p)) * (F.col("_n") - 1) for p in probs.values())
        ]
    )
    wanted = F.exists(
        ends,
        lambda t: (t["hi"] >= F.col("_start")) & (t["lo"] < F.col("_start") + F.col("_size")),
    )
    chosen = binned.join(start.where(wanted).select(*keys, "_bin", "_start"), [*keys, "_bin"])
    inside = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = chosen.withColumn("_end", F.col("_start") + F.sum("_m").over(inside)).withColumn(
        "_first", F.col("_end") - F.col("_m")
    )
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(r: Column) -> Column:
            return F.max(F.when((r >= F.col("_first")) & (r < F.col("_end")), F.col("_v")))

        frac = F.max(pos - lo)
        aggs.append((at(lo) * (1 - frac) + at(hi) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
