"""Gap and run alerts on a stream of samples, keyed by site."""

from __future__ import annotations

from collections.abc import Iterator
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERT = "kind string, start_ts long, end_ts long, n_samples long, peak double"


def stream_alerts(
    samples: DataFrame, *, key: str = "site_id", value: str = "z", expected_days: float = 1.0, factor: float = 3.0,
    threshold: float = 3.0, min_length: int = 7, lateness: str = "2 days",
) -> DataFrame:
    """Alerts of a stream (key, ts, value): key, kind, start_ts, end_ts, n_samples, peak.

    ``gap``: neighbouring samples more than ``factor`` times the expected spacing apart (as in ``gap_detect``), when the sample that
    ends it is in. ``silent``: no sample for that long, once a gap, when event time says so and without waiting for one. ``run``:
    at least ``min_length`` samples in a row with |value| of ``threshold`` or more, when the first sample below it (or null) is in.
    Samples wait in the state until the watermark passes them, so those up to ``lateness`` late are put in
    order; later ones are dropped. A key's state is its waiting samples, its last one and the open run.
    """
    limit_us = int(expected_days * factor * 86_400e6)
    kind = {f.name: f.dataType.simpleString() for f in samples.schema}[key]
    names = [key, "kind", "start_ts", "end_ts", "n_samples", "peak"]

    def step(ids: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"wait": [], "last": None, "told": False, "run": None}
        for pdf in frames:
            s["wait"] += [[int(t), None if pd.isna(v) else float(v)] for t, v in zip(pdf["t_us"], pdf[value])]
        mark_us, out = state.getCurrentWatermarkMs() * 1000, []
        ready = sorted((w for w in s["wait"] if w[0] <= mark_us), key=lambda w: w[0])
        s["wait"] = [w for w in s["wait"] if w[0] > mark_us]
        for t, v in ready:
            if s["last"] is not None and t - s["last"] > limit_us:
                out.append(("gap", s["last"], t, 2, None))
            s["last"], s["told"] = t, False
            if v is not None and abs(v) >= threshold:
                r = s["run"] or [t, t, 0, 0.0]
                s["run"] = [r[0], t, r[2] + 1, v if abs(v) > abs(r[3]) else r[3]]
            elif s["run"]:
                if s["run"][2] >= min_length:
                    out.append(("run", *s["run"]))
                s["run"] = None
        if s["last"] is not None and not s["told"] and mark_us - s["last"] > limit_us:
            out.append(("silent", s["last"], None, 1, None))
            s["told"] = True
        state.update((json.dumps(s),))
        due = [w[0] for w in s["wait"]] + ([s["last"] + limit_us] if s["last"] is not None and not s["told"] else [])
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            rows = pd.DataFrame(out, columns=names[1:]).astype({"start_ts": "Int64", "end_ts": "Int64", "peak": "float64"})
            rows[key] = ids[0]
            yield rows[names]

    marked = samples.select(key, "ts", F.unix_micros("ts").alias("t_us"), F.col(value).cast("double").alias(value)).withWatermark("ts", lateness)
    alerts = marked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ALERT}", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return alerts.withColumns({c: F.timestamp_micros(c) for c in ("start_ts", "end_ts")})
