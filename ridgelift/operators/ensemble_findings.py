"""Findings that only ensembles have: which percentiles cross the floors of a thermal window, and how full and how wide the ensemble is.

hours: as `findings.prepared` gives them, with reference_time and, for w (thermal velocity) and top (usable lift top), the columns
w_members, w_p10 to w_p90 and top_members, top_p10 to top_p90, top_ceiled (members at the model's top, null if unknown). All are null where the hour has no such value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelift.functions.numbers import nudge_round

from .ensemble import POINTS
from .findings import DEFAULTS, Thresholds, lead_hours
from .sequences import first_wins_max
from .series import at_place

DAY = ["profile_id", "day"]


def percentile_crossings(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Days on which not all percentiles say the same: one row a day, with each percentile's passing hours.

    minimal is the lowest percentile that passes, lead_h counts to its highest lift top. hours_pNN are the passing instants in order, at most a day's.
    """
    passes = {p: F.coalesce((F.col(f"w_p{p}") >= t.wstar_min_mps) & (F.col(f"top_p{p}") - F.col("launch_m") >= t.depth_min_m), F.lit(False)) for p in POINTS}
    some = F.lit(False)
    for p in POINTS:
        some = some | passes[p]
    per: list[Column] = []
    for p, ok in passes.items():
        per += [
            F.count_if(ok).alias(f"steps_p{p}"),
            F.array_sort(F.collect_list(F.when(ok, F.col("valid_at")))).alias(f"hours_p{p}"),
            F.min(F.when(ok, F.least("w_members", "top_members"))).alias(f"members_min_p{p}"),
            F.max(F.when(ok, F.col("top_ceiled"))).alias(f"ceiled_max_p{p}"),
            first_wins_max(F.when(ok, F.col(f"top_p{p}")), F.col("hour_index"), F.col("valid_at")).alias(f"_at_p{p}"),
        ]
    g = h.groupBy(*DAY).agg(*per, F.max(F.when(some, F.col("after_h"))).alias("step_h"), F.first("reference_time").alias("_ref"))
    differs = F.lit(False)
    for p in POINTS:
        differs = differs | ((F.col(f"steps_p{p}") > 0) != (F.col("steps_p50") > 0))
    first = lambda of: F.coalesce(*[F.when(F.col(f"steps_p{p}") > 0, of(p)) for p in POINTS])
    out = g.where(differs).withColumn("minimal", first(lambda p: F.lit(f"p{p}"))).withColumn("lead_h", lead_hours(F.col("_ref"), first(lambda p: F.col(f"_at_p{p}"))))
    return out.select(*DAY, "lead_h", "minimal", "step_h", *[f"{c}_p{p}" for p in POINTS for c in ("steps", "members_min", "ceiled_max", "hours")])


def membership(h: DataFrame, quantities: dict[str, str], declared: str | None = None) -> DataFrame:
    """Quantities that some hour states with fewer members than the run declares (or, undeclared, than the most seen): one row a quantity.

    quantities: name to its column of members. examples: the first four such hours in order.
    """
    pairs = F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(c).cast("int").alias("members")) for q, c in quantities.items()])
    stated = F.col(declared) if declared else F.lit(None).cast("int")
    rows = h.select("profile_id", "hour_index", "valid_at", stated.alias("_declared"), F.explode(pairs).alias("q")).select("profile_id", "hour_index", "valid_at", "_declared", "q.*").where("members is not null")
    full = rows.groupBy("profile_id").agg(F.coalesce(F.max("_declared"), F.max("members")).alias("declared_members"))
    rows = rows.join(full, "profile_id").withColumn("_below", F.col("members") < F.col("declared_members"))
    place = F.row_number().over(Window.partitionBy("profile_id", "quantity", "_below").orderBy("hour_index"))
    rows = rows.withColumn("_example", F.when(F.col("_below") & (place <= 4), F.struct("hour_index", "valid_at", "members")))
    g = rows.groupBy("profile_id", "quantity", "declared_members").agg(
        F.min(F.when(F.col("_below"), F.col("members"))).alias("min_members"),
        F.count_if("_below").alias("hours_below_full"),
        F.count("*").alias("of_hours"),
        F.transform(F.array_sort(F.collect_list("_example")), lambda x: F.struct(x["valid_at"].alias("valid_at"), x["members"].alias("members"))).alias("examples"),
    )
    return g.where("hours_below_full > 0")


def band_widths(h: DataFrame) -> DataFrame:
    """Per profile and series: hours with a band, and the upper median of p90 - p10 over them."""
    width = lambda c: F.when(F.col(f"{c}_p50").isNotNull(), F.col(f"{c}_p90") - F.col(f"{c}_p10"))
    pairs = F.array(F.struct(F.lit("usableLiftTopM").alias("series"), width("top").alias("width")), F.struct(F.lit("thermalVelocityMps").alias("series"), width("w").alias("width")))
    rows = h.select("profile_id", F.explode(pairs).alias("x")).select(F.struct("profile_id", "x.series").alias("k"), "x.width").where("width is not null")
    n = rows.groupBy("k").agg(F.count("*").alias("hours_with_signal"))
    median = at_place(rows, "k", "width", lambda n: F.floor(n / 2) + 1)
    digits = F.when(F.col("k.series") == "thermalVelocityMps", nudge_round(F.col("width"), 2)).otherwise(nudge_round(F.col("width"), 1))
    return n.join(median, "k").select("k.profile_id", "k.series", "hours_with_signal", digits.alias("median_width"))


def day_bands(h: DataFrame) -> DataFrame:
    """Per day the hour whose median thermal velocity peaks, the width of both bands there, and whether the run's horizon cuts the day."""
    width = lambda c: F.col(f"{c}_p90") - F.col(f"{c}_p10")
    peak = first_wins_max(F.col("w_p50"), F.col("hour_index"), F.struct("valid_at", width("w").alias("w"), width("top").alias("top")))
    edge = F.struct("local_hour", "before_h", "after_h")
    g = h.groupBy(*DAY).agg(peak.alias("p"), F.min_by(edge, "hour_index").alias("a"), F.max_by(edge, "hour_index").alias("b"), F.first("reference_time").alias("_ref")).where("p is not null")
    whole = (F.col("a.local_hour") < F.col("a.before_h")) & (F.col("b.local_hour") >= 24 - F.col("b.after_h"))
    return g.select(*DAY, F.col("p.valid_at").alias("peak_at"), lead_hours(F.col("_ref"), F.col("p.valid_at")).alias("lead_h"), nudge_round(F.col("p.w"), 2).alias("wstar_width_mps"), nudge_round(F.col("p.top"), 1).alias("top_width_m"), (~whole).alias("truncated"))
