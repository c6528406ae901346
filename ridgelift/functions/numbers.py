"""Rounding and arithmetic where Spark's own functions differ from what the documents ask for."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nudge_round(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: ties go up, also below zero."""
    p = float(10**digits)
    return F.floor(x * p + 0.5).cast("double") / p


def exact_half_even(digits: int):
    """A function of a column: doubles rounded as their exact binary values, ties to even. Whole batches at once; only values so near a tie that scaling could decide it go through decimals."""

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        scaled = v * 10.0**digits
        whole = np.rint(scaled)
        out = whole / 10.0**digits
        with np.errstate(invalid="ignore"):
            odd = np.isfinite(v) & ((np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-4) | (np.abs(scaled) > 1e10))
        for i in np.flatnonzero(odd):
            out[i] = float(Decimal(v[i]).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))
        out[np.isnan(v)] = np.nan
        return pd.Series(out, index=x.index).where(x.notna(), None)

    return rounded


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """Null stays null (least and greatest would skip it)."""
    lo, hi = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.when(x.isNotNull(), F.least(hi, F.greatest(lo, x)))


def masked(x: Column, sentinel: float, tolerance: float = 0.5) -> Column:
    """Null where the value is the sentinel, give or take."""
    return F.when(~(F.abs(x - sentinel) <= tolerance), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def iterated_power(base: int, exponent: Column) -> Column:
    """base^exponent by repeated multiplication or division, as decoders of packed fields do."""
    up = F.aggregate(F.when(exponent > 0, F.sequence(F.lit(1), exponent)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, _: a * float(base))
    down = F.aggregate(F.when(exponent < 0, F.sequence(F.lit(1), -exponent)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, _: a / float(base))
    return F.when(exponent >= 0, up).otherwise(down)


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted values."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def nice_step(span: Column, ticks: int) -> Column:
    """The smallest of 1, 2 and 5 times a power of ten that spans `span` in about `ticks` steps."""
    raw = span / float(ticks)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    ratio = raw / power
    return F.when(ratio <= 1, power).when(ratio <= 2, power * 2).when(ratio <= 5, power * 5).otherwise(power * 10)
