"""Sequences of rows: runs, neighbours, first-wins picks and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970; instants without a zone are UTC, as the session is."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def islands(df: DataFrame, keys: list[str], order: list[str], is_break: Column, name: str = "run_id") -> DataFrame:
    """Numbers runs within keys: a new one starts at each row where is_break holds (a null is no break)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(is_break, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def seconds_since_previous(ts: str, keys: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order)
    return micros(ts) / 1e6 - micros(F.lag(ts).over(w)) / 1e6


def first_wins_max(value: Column, order: Column, payload: Column, smallest: bool = False) -> Column:
    """Aggregate: payload of the largest (or smallest) finite value; the earliest row in `order` wins ties."""
    v = F.when(value.isNotNull() & ~F.isnan(value), value)
    picked = F.when(v.isNotNull(), payload)
    return F.min_by(picked, F.when(v.isNotNull(), F.struct(v if smallest else -v, order)))


def nearest_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_seq: str, tolerance_s: int) -> DataFrame:
    """left with the right row nearest in time within the tolerance, both ways; the row with the smaller right_seq wins ties.

    No pairs are formed. Time is cut into buckets as long as the tolerance; each bucket sorts its left and right rows together, with the last right
    row of the bucket before and the first of the bucket after, and a left row takes the nearest on either side. So rows grow with the input, and a
    busy key is as many groups as it has buckets.
    """
    width = tolerance_s * 1_000_000
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    row = F.struct(*[F.col(c) for c in r.columns])
    at = micros(f"r_{right_ts}")
    r = r.where(F.col(f"r_{right_ts}").isNotNull()).groupBy(F.col(f"r_{key}").alias("_key"), at.alias("_at")).agg(F.min_by(row, f"r_{right_seq}").alias("_r")).withColumn("_bucket", F.floor(F.col("_at") / width))
    own = F.struct("_at", "_r")
    ends = r.groupBy("_key", "_bucket").agg(F.max_by(own, "_at").alias("last"), F.min_by(own, "_at").alias("first"))
    beside = ends.select("_key", F.explode(F.array(F.struct((F.col("_bucket") + 1).alias("b"), F.col("last").alias("x")), F.struct((F.col("_bucket") - 1).alias("b"), F.col("first").alias("x")))).alias("e"))
    rights = r.unionByName(beside.select("_key", F.col("e.b").alias("_bucket"), F.col("e.x._at").alias("_at"), F.col("e.x._r").alias("_r")))
    lefts = left.select(F.col(key).alias("_key"), micros(left_ts).alias("_at"), F.floor(micros(left_ts) / width).alias("_bucket"), F.struct(*left.columns).alias("_l"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    by, until_here = Window.partitionBy("_key", "_bucket"), (Window.unboundedPreceding, Window.currentRow)
    right_row = F.when(F.col("_l").isNull(), F.struct("_at", "_r"))
    before = F.last(right_row, ignorenulls=True).over(by.orderBy("_at", F.col("_l").isNotNull()).rowsBetween(*until_here))
    after = F.last(right_row, ignorenulls=True).over(by.orderBy(F.col("_at").desc(), F.col("_l").isNotNull()).rowsBetween(*until_here))
    found = both.select("_l", "_at", before.alias("_b"), after.alias("_a")).where("_l is not null")
    far = lambda c: F.abs(F.col("_at") - F.col(f"{c}._at"))
    near = [F.when(far(c) <= width, F.struct(far(c).alias("far"), F.col(f"{c}._r.r_{right_seq}").alias("seq"), F.col(f"{c}._r").alias("r"))) for c in ("_b", "_a")]
    best = F.array_min(F.filter(F.array(*[F.struct(n["far"].alias("far"), n["seq"].alias("seq"), F.lit(i).alias("i")) for i, n in enumerate(near)]), lambda x: x["far"].isNotNull()))
    out = found.withColumn("_best", best).withColumn("_r", F.when(F.col("_best.i") == 0, F.col("_b._r")).when(F.col("_best.i") == 1, F.col("_a._r")))
    return out.select("_l.*", "_r.*", (F.col("_best.far") / 6e7).alias("offset_minutes"))
