"""Column expressions: cyclic time, domain scores and stateless value transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the risk score.
HIGH_AMOUNT = 1000.0
DEVICE_WEIGHT = 0.6
VELOCITY_WEIGHT = 0.4
VELOCITY_SCALE = 10.0
HIGH_AMOUNT_WEIGHT = 0.2


def hour_angle(time: Column) -> Column:
    return F.hour(time) * (2 * F.pi() / 24)


def weekday_angle(time: Column) -> Column:
    """Monday is 0."""
    return F.weekday(time) * (2 * F.pi() / 7)


def cyclic_time(time: str) -> dict[str, Column]:
    moment = F.col(time)
    return {
        "hour_sin": F.sin(hour_angle(moment)),
        "hour_cos": F.cos(hour_angle(moment)),
        "dow_sin": F.sin(weekday_angle(moment)),
        "dow_cos": F.cos(weekday_angle(moment)),
    }


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; null stays null (``least`` and ``greatest`` would skip it)."""
    out = value
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def high_amount_flag(amount: Column) -> Column:
    return F.coalesce(amount > HIGH_AMOUNT, F.lit(False)).cast("double")


def risk_score(amount: Column, tx_count: Column, device_risk: Column) -> Column:
    raw = (
        DEVICE_WEIGHT * device_risk
        + VELOCITY_WEIGHT * (tx_count / VELOCITY_SCALE)
        + HIGH_AMOUNT_WEIGHT * high_amount_flag(amount)
    )
    return clip(raw, 0.0, 1.0)


def checked_log(value: Column, offset: float = 0.0, name: str = "value") -> Column:
    """Natural logarithm of ``value + offset``; a value that is not positive fails the job."""
    shifted = value.cast("double") + F.lit(float(offset))
    failure = F.raise_error(F.lit(f"log of a value that is not positive in column '{name}'"))
    return F.when(shifted <= 0, failure.cast("double")).otherwise(F.log(shifted))


def binary(value: Column, threshold: float = 0.0) -> Column:
    """1 above the threshold, else 0; null gives 0."""
    return F.coalesce(value > F.lit(threshold), F.lit(False)).cast("int")


def exponential(value: Column, scale: float = 1.0) -> Column:
    return F.exp(F.lit(float(scale)) * value)


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and infinities become 0; the result is a 32-bit float."""
    number = value.cast("float")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0).cast("float")).otherwise(number)
