"""One model's runs through time, day by day: whether a window exists, when and how strong, newest run first; and wind across members.

runs: site, member, reference_time, one row a run. votes come from windows and quiet days as in `compare`: windows has one row a window and touched day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import times, wind
from ridgelift.functions.numbers import nudge_round

from .compare import nearest_to, spread, widest_separation
from .findings import DEFAULTS, Thresholds
from .sequences import micros

DAY = ["site", "day"]
RUN = [*DAY, "member"]
NOON = 12


def lead_to_day(day: Column, reference: Column, zone: str, anchor_hour: int = NOON) -> Column:
    """Hours from a run to a local wall clock hour of a day, whatever the change of clocks."""
    return nudge_round((micros(times.local_instant(day, anchor_hour, zone)) - micros(reference)) / 3.6e9, 1)


def existence(covered: DataFrame, windows: DataFrame, quiet: DataFrame, runs: DataFrame, zone: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """One rung for each run and day that some run covers: its vote (window, quiet or abstained), why, and the values nearest the floors."""
    rungs = covered.select(*DAY).distinct().join(runs.select("site", "member", "reference_time"), "site")
    w = windows.groupBy(*RUN).agg(nearest_to(F.col("peak_wstar_mps"), t.wstar_min_mps).alias("_ww"), nearest_to(F.col("peak_above_launch_m"), t.depth_min_m).alias("_wd"), F.lit(True).alias("_w"))
    q = quiet.select(*RUN, "truncated", "failed", F.col("peak_wstar_mps").alias("_qw"), F.col("peak_depth_m").alias("_qd"), F.lit(True).alias("_q"))
    x = rungs.join(w, RUN, "left").join(q, RUN, "left")
    is_quiet = F.col("_w").isNull() & F.col("_q") & ~F.col("truncated")
    vote = F.when(F.col("_w"), "window").when(is_quiet, "quiet").otherwise("abstained")
    reason = F.when(F.col("_w").isNull(), F.when(F.col("_q") & F.col("truncated"), "truncatedDay").when(F.col("_q").isNull(), "outOfHorizon"))
    pick = lambda a, b: F.when(F.col("_w"), F.col(a)).when(is_quiet, F.col(b))
    return x.select(*RUN, "reference_time", lead_to_day(F.col("day"), F.col("reference_time"), zone).alias("lead_h"), vote.alias("vote"), F.when(is_quiet, F.col("failed")).alias("failed"), reason.alias("abstained"), pick("_ww", "_qw").alias("wstar_flip_at_mps"), pick("_wd", "_qd").alias("depth_flip_at_m"))


def edges(windows: DataFrame, runs: DataFrame, zone: str, first_of_equal_ends: bool = False) -> DataFrame:
    """Unclipped first starts and last ends that fall on the day, one row a run, day and edge, with the spread of the day's edges in hours.

    windows: start_at, end_at, clipped_start, clipped_end, step_h, window_id too. Of equal first starts the earliest window counts, of equal last ends the latest, or the earliest with first_of_equal_ends.
    """
    s, e = F.struct("start_at", "clipped_start", "step_h"), F.struct("end_at", "clipped_end", "step_h")
    late = -F.col("window_id") if first_of_equal_ends else F.col("window_id")
    per = windows.groupBy(*RUN).agg(F.min_by(s, F.struct("start_at", "window_id")).alias("s"), F.max_by(e, F.struct("end_at", late)).alias("e"))
    both = F.array(
        F.struct(F.lit("start").alias("edge"), F.col("s.start_at").alias("at"), F.col("s.clipped_start").alias("clipped"), F.col("s.step_h").alias("step_h")),
        F.struct(F.lit("end").alias("edge"), F.col("e.end_at").alias("at"), F.col("e.clipped_end").alias("clipped"), F.col("e.step_h").alias("step_h")),
    )
    x = per.select(*RUN, F.explode(both).alias("v")).select(*RUN, "v.*").where(~F.col("clipped") & (times.local_day(F.col("at"), zone) == F.col("day"))).drop("clipped")
    day = x.groupBy(*DAY, "edge").agg(nudge_round(spread(micros("at") / 3.6e9), 1).alias("spread_h"), F.max("step_h").alias("step_h_max"))
    x = x.join(day, [*DAY, "edge"]).join(runs.select("site", "member", "reference_time"), ["site", "member"])
    return x.select(*RUN, "edge", "at", "step_h", "spread_h", "step_h_max", "reference_time", lead_to_day(F.col("day"), F.col("reference_time"), zone).alias("lead_h"))


def magnitude(windows: DataFrame, quiet: DataFrame, runs: DataFrame, zone: str) -> DataFrame:
    """How strong the day is in each run that votes. A window that came over from the day before (own_day differs) adds no velocity and no duration, and its peak only if it falls on the day."""
    own = F.col("own_day") == F.col("day")
    here = times.local_day(F.col("peak_at"), zone) == F.col("day")
    w = windows.groupBy(*RUN).agg(F.max(F.when(own, F.col("peak_wstar_mps"))).alias("peak_wstar_mps"), F.max(F.when(here, F.col("peak_above_launch_m"))).alias("peak_above_launch_m"), nudge_round(F.sum(F.when(own, F.col("duration_h"))), 1).alias("duration_h"))
    q = quiet.where(~F.col("truncated")).join(windows.select(*RUN).distinct(), RUN, "left_anti")
    q = q.select(*RUN, F.lit("quiet").alias("vote"), "peak_wstar_mps", F.col("peak_depth_m").alias("peak_above_launch_m"), F.lit(None).cast("double").alias("duration_h"))
    x = w.withColumn("vote", F.lit("window")).unionByName(q).join(runs.select("site", "member", "reference_time"), ["site", "member"])
    return x.withColumn("lead_h", lead_to_day(F.col("day"), F.col("reference_time"), zone))


def wind_divergence(window_members: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per day how far members with a window disagree on wind in the band and on gusts. Gusts of different kinds are never pooled.

    window_members: site, day, member. summaries: site, member, day, gust_kind (hourMax, instant or null), and what `wind_findings.wind_summaries` gives: a day with
    windows speaks for its windows, other days for the whole day.
    """
    scoped = lambda c: F.when(F.col("in_window"), F.col(f"window_{c}")).otherwise(F.col(c))
    x = window_members.select(*RUN).distinct().join(summaries, RUN).withColumn("_band", scoped("band_mps")).withColumn("_gust", scoped("gust_mps"))
    of = lambda kind: F.when(F.col("gust_kind") == kind, F.col("_gust"))
    apart = lambda c: nudge_round(F.round(spread(c), 6), 2)
    g = x.groupBy(*DAY).agg(F.count("_band").alias("band_members"), apart(F.col("_band")).alias("band_spread_mps"), *[c for k, n in (("hourMax", "hour_max"), ("instant", "instant")) for c in (F.count(of(k)).alias(f"{n}_members"), apart(of(k)).alias(f"{n}_spread_mps"))], F.count(F.when(F.col("gust_kind").isNull(), F.col("_gust"))).alias("undeclared_members"))
    return g.where("band_members >= 2 or hour_max_members >= 2 or instant_members >= 2")


def direction_spread(directions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Per day the two members whose mean surface winds are furthest apart. directions: site, member, day, surface_mps, surface_deg, samples of each window: a member's windows of a day are
    recombined, weighed by their samples; weak sums have no direction."""
    s, d, n = F.col("surface_mps"), F.col("surface_deg"), F.col("samples")
    known = directions.where("surface_deg is not null")
    g = known.groupBy(*RUN).agg((F.sum(wind.u_of(s, d) * n) / F.sum(n)).alias("u"), (F.sum(wind.v_of(s, d) * n) / F.sum(n)).alias("v"))
    speed = wind.speed_of(F.col("u"), F.col("v"))
    entries = g.where(F.round(speed, 9) >= t.direction_floor_mps).select(F.struct(*DAY).alias("k"), F.col("member").alias("ord"), nudge_round(F.round(wind.direction_of(F.col("u"), F.col("v")), 6)).alias("deg"))
    members = entries.groupBy("k").agg(F.count("*").alias("members"))
    return widest_separation(entries, "k").join(members, "k").select("k.site", "k.day", "members", "separation_deg", F.col("first").alias("first_member"), F.col("second").alias("second_member"))
