"""Live stations: each function takes a batch or a stream of samples (station_id, seq, observed_at, wind_avg_mps) alike.

Late data: a watermark on observed_at bounds the state of windows, sessions and deduplication. The rolling window of a station
instead follows its newest sample: a late sample inside the window is merged, the newest payload of an instant wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridgelift.sources import live_frames

WINDOW_SECONDS = 600
#: Silence after which a stream of frames counts as dead, and after which a station's state ends.
IDLE_SECONDS, FORGET_SECONDS = 75, 86_400
#: Setting and value that `snapshot_updates` needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Setting and value with which it ends once its input does (availableNow): timers then wait for the next batch that has data.
NO_IDLE_BATCHES = ("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def timed(samples: DataFrame, lateness: str | None = None) -> DataFrame:
    """samples with a zoned timestamp, and a watermark if they are a stream."""
    t = samples.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return t.withWatermark("observed_at", lateness) if lateness and samples.isStreaming else t


def digests(samples: DataFrame, minutes: int, lateness: str = "72 hours") -> DataFrame:
    """Mean, peak and count of each station's steps of so many minutes; a step without samples is absent."""
    w = F.window("observed_at", f"{minutes} minutes")
    out = timed(samples, lateness).groupBy("station_id", w.alias("w")).agg(F.count("*").alias("n"), F.avg("wind_avg_mps").alias("mean_mps"), F.max("wind_avg_mps").alias("peak_mps"))
    return out.select("station_id", F.col("w.start").alias("start_at"), "n", "mean_mps", "peak_mps")


def sessions(samples: DataFrame, gap_minutes: int, lateness: str = "72 hours") -> DataFrame:
    """Runs of samples no further apart than the gap."""
    out = timed(samples, lateness).groupBy("station_id", F.session_window("observed_at", f"{gap_minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.max("wind_avg_mps").alias("peak_mps"), F.max("observed_at").alias("ended_at"))
    return out.select("station_id", F.col("w.start").alias("started_at"), "ended_at", "n", "peak_mps")


def first_arrivals(observations: DataFrame, lateness: str = "72 hours") -> DataFrame:
    """Each (station_id, observed_at) once, the first to arrive, within the watermark."""
    t = timed(observations, lateness)
    return t.dropDuplicatesWithinWatermark(["station_id", "observed_at"]) if observations.isStreaming else t.dropDuplicates(["station_id", "observed_at"])


def rolling_window(samples: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Batch: each station's samples of the last seconds before its newest, the highest seq of an instant."""
    per = timed(samples).groupBy("station_id", "observed_at").agg(F.max_by("wind_avg_mps", "seq").alias("wind_avg_mps"))
    last = per.groupBy("station_id").agg(F.max("observed_at").alias("_last"))
    return per.join(last, "station_id").where(F.unix_micros("observed_at") >= F.unix_micros("_last") - seconds * 1_000_000).drop("_last")


def merged_samples(seconds: int, *parts: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """parts: (micros, mps, deg), oldest payload first. The newest payload of each instant, in order, no older than the window before the newest instant."""
    at, mps, deg = (np.concatenate([np.asarray(p[i], t) for p in parts]) for i, t in enumerate((np.int64, float, float)))
    instants, place = np.unique(at[::-1], return_index=True)
    place = len(at) - 1 - place[instants >= instants[-1] - seconds * 1_000_000] if len(at) else place
    return at[place], mps[place], deg[place]


def rolling_updates(samples: DataFrame, seconds: int = WINDOW_SECONDS, idle_seconds: int | None = None) -> DataFrame:
    """Stream: after each trigger a station's window (count, mean, newest). State: its instants and values, no older than the window. With idle_seconds, a silent station's state ends after them (processing time; such a stream never runs dry, but with `NO_IDLE_BATCHES`); without, it is kept."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fresh = pd.concat(list(batches)).sort_values("seq")
        at = fresh["observed_at"].astype("datetime64[us]").astype("int64").to_numpy()
        held = state.get if state.exists else ([], [])
        at, mps, _ = merged_samples(seconds, (*held, held[1]), (at, fresh["wind_avg_mps"], fresh["wind_avg_mps"]))
        state.update((at.tolist(), mps.tolist()))
        if idle_seconds is not None:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame({"station_id": [key[0]], "n": [len(at)], "mean_mps": [mps.mean()], "newest_at": [pd.Timestamp(int(at[-1]), unit="us")]})

    return timed(samples).groupBy("station_id").applyInPandasWithState(fold, "station_id long, n long, mean_mps double, newest_at timestamp", "at array<long>, v array<double>", "update", GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout)


_TEXTS = ("reading", "summaries", "place")
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_HELD = "seq long, late long, known boolean, status string, error string, served_us long, reading string, summaries string, place string, at array<long>, mps array<double>, deg array<double>"


class FrameFold(StatefulProcessor):
    """Folds a station's frames (see `ridgelift.sources.live_frames`) into what a reader holds, in the order of seq. An init resets the station; samples join the rolling window; readings and summaries change
    a station that is known; a ping only shows that the stream lives; a broken frame leaves the last station, with an error. Frames that come after a later one was folded are dropped and counted.

    A station that is silent for idle_seconds is given out once with the error `timeout`; after forget_seconds more its state ends. Both are processing time.
    """

    def __init__(self, seconds: int, idle_seconds: int, forget_seconds: int):
        self.seconds, self.idle_ms, self.forget_ms = seconds, idle_seconds * 1000, forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", _HELD)

    def wait(self, now_ms: int, more_ms: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now_ms + more_ms)

    def given(self, key: tuple, held: dict) -> pd.DataFrame:
        return pd.DataFrame({"station_id": [key[0]], **{c: [v] for c, v in held.items()}})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = pd.concat(list(rows)).sort_values(["seq", "part"], kind="stable")
        names = [f.split()[0] for f in _HELD.split(", ")]
        held = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict(zip(names, (-(1 << 63), 0, False, "connecting", None, None, None, None, None, [], [], []), strict=True))
        timely = frames[frames["seq"] > held["seq"]]
        held["late"] += len(frames) - len(timely)
        told = timely[timely["kind"] != "ping"]
        for frame in told[~told["kind"].isin(["samples"])].itertuples(index=False):  # a handful: each changes the station as a whole
            if frame.kind == "init":
                held |= {"known": True, **{c: getattr(frame, c) for c in _TEXTS}}
            elif held["known"] and frame.kind in _TEXTS:
                held[frame.kind] = getattr(frame, frame.kind)
            if frame.kind in ("init", "reading", "summaries"):
                held["served_us"] = int(frame.served_us)
        if len(told):
            broken = told["kind"].isin(["broken", "unavailable"])
            held["error"] = "network" if broken.iloc[-1] else None
            held["status"] = "open" if not broken.all() else held["status"]
            sampled = told[told["at"].notna()]
            at, mps, deg = merged_samples(self.seconds, (held["at"], held["mps"], held["deg"]), *zip(sampled["at"], sampled["mps"], sampled["deg"], strict=True))
            held |= {"at": at.tolist(), "mps": mps.tolist(), "deg": [None if math.isnan(d) else d for d in deg.tolist()]}
        if len(timely):
            held["seq"] = int(timely["seq"].iloc[-1])
            if held["error"] == "timeout":
                held["error"] = None
        self.state.update(tuple(held.values()))
        self.wait(timerValues.getCurrentProcessingTimeInMs(), self.idle_ms)
        yield self.given(key, held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = dict(zip([f.split()[0] for f in _HELD.split(", ")], self.state.get(), strict=True))
        if held["error"] == "timeout":
            self.state.clear()
            return
        held["error"] = "timeout"
        self.state.update(tuple(held.values()))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield self.given(key, held)

    def close(self) -> None:
        pass


def _typed(held: DataFrame) -> DataFrame:
    points = F.transform(F.arrays_zip("at", "mps", "deg"), lambda x: F.struct(F.timestamp_micros(x["at"]).alias("observed_at"), x["mps"].alias("wind_mps"), x["deg"].alias("wind_direction_deg")))
    return held.select(
        "station_id",
        "seq",
        "status",
        "error",
        "late",
        F.timestamp_micros("served_us").alias("served_at"),
        F.from_json("reading", live_frames.READING, _MICROS).alias("reading"),
        F.from_json("summaries", live_frames.SUMMARIES, _MICROS).alias("summaries"),
        F.from_json("place", live_frames.PLACE, _MICROS).alias("place"),
        points.alias("samples"),
    )


def snapshot_updates(frames: DataFrame, seconds: int = WINDOW_SECONDS, idle_seconds: int = IDLE_SECONDS, forget_seconds: int = FORGET_SECONDS) -> DataFrame:
    """Stream of frames: after each trigger the snapshot of each station that changed. Needs the RocksDB state store (`STATE_STORE`), and to end by itself `NO_IDLE_BATCHES`."""
    part = lambda f: F.transform("samples", f)
    plain = frames.select(
        "station_id", "seq", "part", "kind", F.unix_micros("served_at").alias("served_us"), *[F.to_json(c, _MICROS).alias(c) for c in _TEXTS],
        part(lambda x: F.unix_micros(x["observed_at"])).alias("at"), part(lambda x: x["wind_mps"]).alias("mps"), part(lambda x: x["wind_direction_deg"]).alias("deg"),
    )
    fold = FrameFold(seconds, idle_seconds, forget_seconds)
    return _typed(plain.groupBy("station_id").transformWithStateInPandas(fold, f"station_id long, {_HELD}", "Update", "processingTime"))


def frame_snapshots(frames: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Batch twin of `snapshot_updates`: what a reader holds after all frames of each station, as aggregates and one join.

    Frames are read twice, for what is carried and for the samples. The newest of an init and of what follows it needs no look at the init first: whatever is older than the init loses to it.
    """
    order = F.struct("seq", "part")
    known = F.count_if(F.col("kind") == "init") > 0
    carried = lambda c: F.when(known, F.max_by(F.when(F.col("kind").isin("init", c), F.struct(F.col(c).alias("v"))), F.when(F.col("kind").isin("init", c), order))["v"]).alias(c)
    told = F.when(F.col("kind") != "ping", order)
    served = F.col("kind").isin("init", "reading", "summaries")
    lively = F.col("kind").isin("init", "samples", "reading", "summaries")
    out = frames.groupBy("station_id").agg(
        F.max("seq").alias("seq"),
        F.when(F.count_if(lively) > 0, "open").otherwise("connecting").alias("status"),
        F.when(F.max_by("kind", told).isin("broken", "unavailable"), "network").alias("error"),
        F.max_by(F.when(served, F.col("served_at")), F.when(served, order)).alias("served_at"),
        *[carried(c) for c in _TEXTS],
    )
    points = frames.select("station_id", "seq", F.posexplode("samples").alias("place", "p")).select("station_id", "seq", "place", "p.*").repartition("station_id")
    per = points.groupBy("station_id", "observed_at").agg(F.max_by(F.struct("observed_at", "wind_mps", "wind_direction_deg"), F.struct("seq", "place")).alias("p"))
    per = per.withColumn("_last", F.max("observed_at").over(Window.partitionBy("station_id")))
    window = per.where(F.unix_micros("observed_at") >= F.unix_micros("_last") - seconds * 1_000_000)
    window = window.groupBy("station_id").agg(F.array_sort(F.collect_list("p")).alias("samples"))  # as long as the window
    out = out.join(window, "station_id", "left")
    return out.select("station_id", "seq", "status", "error", "served_at", *_TEXTS, F.coalesce("samples", F.array().cast(live_frames.SAMPLES)).alias("samples"))


def append_batch(path: str):
    """For foreachBatch: appends a batch once; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def snapshots(frames: DataFrame) -> DataFrame:
    """Batch: what a reader holds after each station's frames (station_id, seq, kind, status, served_at, reading, summaries): init, samples, reading, summaries, ping, unavailable.

    An init gives the station; readings and summaries after it change a station that is ok, and are passed over before it or if it is not. Pings change nothing, and after an
    `unavailable` frame the last station stays, with an error.
    """
    init = frames.where("kind = 'init'").groupBy("station_id").agg(F.max_by(F.struct("seq", "status", "reading", "summaries"), "seq").alias("i"))
    x = frames.where("kind != 'ping'").join(init, "station_id", "left")
    later = (F.col("seq") > F.col("i.seq")) & (F.col("i.status") == "ok")
    last = lambda kind, value: F.max_by(F.when((F.col("kind") == kind) & later, F.struct(F.col(value).alias("v"))), F.when((F.col("kind") == kind) & later, F.col("seq")))
    served = F.col("kind").isin("init", "reading", "summaries")
    g = x.groupBy("station_id").agg(
        F.first("i").alias("i"),
        last("reading", "reading").alias("r"),
        last("summaries", "summaries").alias("s"),
        F.max_by(F.when(served, F.col("served_at")), F.when(served, F.col("seq"))).alias("served_at"),
        F.max_by("kind", "seq").alias("_last"),
        F.count_if(F.col("kind") != "unavailable").alias("_n"),
    )
    new = lambda c, old: F.when(F.col(c).isNotNull(), F.col(f"{c}.v")).otherwise(F.col(f"i.{old}"))
    return g.select("station_id", F.col("i.status").alias("station_status"), new("r", "reading").alias("reading"), new("s", "summaries").alias("summaries"), "served_at", F.when(F.col("_n") > 0, "open").otherwise("connecting").alias("status"), F.when(F.col("_last") == "unavailable", "network").alias("error"))
