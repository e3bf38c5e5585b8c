"""Detections over streams, with state for each key.

Rows of a micro-batch are ordered by time and id within a key; across batches
the order is that of arrival, as in the batch forms only if the input is in
order. State that rests for its time to live is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftnet.functions.net import is_private

WINDOW, LEAST, CV = 32, 6, 0.15
Step = Callable[[tuple, pd.DataFrame, tuple | None], tuple[list[tuple], tuple]]


def score_cv(cv: float) -> float:
    if cv < 0.05:
        return 1.0
    if cv < CV:
        return 0.5 + 0.5 * (CV - cv) / (CV - 0.05)
    return 0.1 + 0.4 * (0.30 - cv) / (0.30 - CV) if cv < 0.30 else 0.0


def beacon_step(key: tuple, df: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
    """State: the last 32 times of a source and name. Every event gets the score as of it; events with a full window are reckoned together."""
    held = np.array(state[0] if state else [], dtype=np.int64)
    xs = np.r_[held, df["t_us"].to_numpy(dtype=np.int64)]
    gap = np.diff(xs) / 1e6
    at = np.arange(len(held), len(xs))  # where the new events are
    mean, sd = np.zeros(len(at)), np.zeros(len(at))
    for k in np.flatnonzero(at < WINDOW - 1):
        own = gap[: at[k]]
        mean[k], sd[k] = (own.mean(), own.std()) if len(own) else (0.0, 0.0)
    full = np.flatnonzero(at >= WINDOW - 1)
    if len(full):
        w = np.lib.stride_tricks.sliding_window_view(gap, WINDOW - 1)[at[full] - (WINDOW - 1)]
        mean[full], sd[full] = w.mean(axis=1), w.std(axis=1)
    samples = np.minimum(at + 1, WINDOW)
    known = (samples >= LEAST) & (mean >= 1.0)
    cv = [round(float(s / m), 9) if k else None for s, m, k in zip(sd, mean, known)]
    out = [(i, int(n), c, 0.0 if c is None else score_cv(c)) for i, n, c in zip(df["event_id"], samples, cv)]
    return out, (xs[-WINDOW:].tolist(),)


def rebinding_step(key: tuple, df: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
    """State: a name's last public answer, and whether it had a private one. The first private answer after a public one is reported once."""
    public, private = state or ("", False)
    out = []
    for i, ip, p in zip(df["event_id"], df["ip"], df["private"]):
        if not p:
            public = ip
        else:
            if public and not private:
                out.append((key[0], i, ip, public))
            private = True
    return out, (public, bool(private))


def cooldown_step(cooldown_us: int) -> Step:
    """State: the last time that passed. A row passes if that is at least ``cooldown_us`` before it."""

    def step(key: tuple, df: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
        last = state[0] if state else None
        out = []
        for t, i in zip(df["t_us"], df["event_id"]):
            if last is None or t - last >= cooldown_us:
                last = int(t)
                out.append((key[0], i, last))
        return out, (last,)

    return step


def every_step(every: int) -> Step:
    """State: how many events a key had. Every ``every``-th is reported."""

    def step(key: tuple, df: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
        n = state[0] if state else 0
        first = every - 1 - n % every  # the first that is reported
        return [(key[0], i, n + first + 1 + every * k) for k, i in enumerate(df["event_id"].iloc[first::every])], (n + len(df),)

    return step


def _stateful(ev: DataFrame, keys: list[str], step: Step, out: str, state: str, ttl_ms: int | None) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]

    def work(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        df = pd.concat(list(frames)).sort_values(["t_us", "event_id"])
        rows, new = step(key, df, held.get if held.exists else None)
        held.update(new)
        if ttl_ms:
            held.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(rows, columns=names)

    wait: Any = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return ev.groupBy(*keys).applyInPandasWithState(work, out, state, "append", wait)


def stream_beacons(ev: DataFrame, ttl_ms: int | None = 7_200_000) -> DataFrame:
    """``event_id``, ``samples``, ``cv``, ``score`` of a stream with ``source_hash``, ``domain``, ``t_us``, ``event_id``."""
    e = ev.where("source_hash is not null and domain is not null").select("source_hash", "domain", "t_us", "event_id")
    return _stateful(e, ["source_hash", "domain"], beacon_step, "event_id string, samples bigint, cv double, score double", "xs array<bigint>", ttl_ms)


def stream_rebindings(ev: DataFrame, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """``domain``, ``event_id``, ``private_ip``, ``public_ip`` of the answers that went from public to private."""
    e = ev.where("domain is not null and resolved_ip is not null").select("domain", "t_us", "event_id", F.col("resolved_ip").alias("ip"), is_private("resolved_ip").alias("private"))
    return _stateful(e, ["domain"], rebinding_step, "domain string, event_id string, private_ip string, public_ip string", "public_ip string, private boolean", ttl_ms)


def stream_cooldown(ev: DataFrame, key: str, cooldown_us: int = 3_600_000_000) -> DataFrame:
    """At most one row of a key within a time: ``k``, ``event_id``, ``t_us``."""
    e = ev.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), "t_us", "event_id")
    return _stateful(e, ["k"], cooldown_step(cooldown_us), "k string, event_id string, t_us bigint", "t bigint", None)


def stream_every(ev: DataFrame, key: str, every: int = 10) -> DataFrame:
    """Every tenth row of a key: ``k``, ``event_id``, ``n``."""
    e = ev.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), "t_us", "event_id")
    return _stateful(e, ["k"], every_step(every), "k string, event_id string, n bigint", "n bigint", None)


def stream_discoveries(hosts: DataFrame, within_us: int = 30_000_000) -> DataFrame:
    """Discovered devices of a stream with ``mac``, ``ip``, ``t_us``, ``event_id``, each at most once within a time: by hardware address, or else by address."""
    return stream_cooldown(hosts.withColumn("__device", F.coalesce("mac", "ip")), "__device", within_us)
