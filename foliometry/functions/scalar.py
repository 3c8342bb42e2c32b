"""Column expressions of single rows: transforms, losses, classes and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths in pt and mm.
PT = {"pt": 1.0, "mm": 72.27 / 25.4, "cm": 72.27 / 2.54, "in": 72.27, "em": 10.0, "ex": 4.3, "mu": 0.5}
MM = {"mm": 1.0, "cm": 10.0, "in": 25.4, "pt": 25.4 / 72.27}
#: Paper sizes in pt.
PAPERS = {"letter": (612.0, 792.0), "a4": (595.28, 841.89)}
STANDARD_SIZES = (7.0, 8.0, 9.0, 10.0, 11.0, 12.0)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def nearest6(c: Column | str) -> Column:
    """A double to six places by the nearest whole number of millionths, as SQL engines round; F.round reads the decimal digits."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def judge_transform(dim: Column, value: Column, heavy: tuple[str, ...]) -> Column:
    """log1p for heavy-tailed measures above -1, else the value."""
    return F.when(dim.isin(*heavy) & (value > -1), F.log1p(value)).otherwise(value)


def robust_z(value: Column, center: Column, scale: Column, clip: float = 4.0) -> Column:
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), (value - center) / scale))


def confidence_tier(n: Column, high: int = 36, medium: int = 16) -> Column:
    return F.when(n >= high, "high").when(n >= medium, "medium").otherwise("low")


def soft_loss(
    x: Column, target: Column, low: Column, high: Column, weight: Column, cap: float = 3.0, log_space: bool = False, clip: tuple[float, float] | None = None
) -> Column:
    """w * (1 - exp(-d^2 / 2)) and at most cap, d the distance from the target in units of the side's scale.

    The value is clipped first; in log space value and target are at least 1e-6. A side without a scale costs nothing; a null
    value has no loss.
    """
    x = F.least(F.greatest(x, F.lit(clip[0])), F.lit(clip[1])) if clip else x
    a, b = (F.log(F.greatest(c, F.lit(1e-6))) if log_space else c for c in (x, target))
    scale = F.when(a < b, low).otherwise(high)
    d = F.abs(a - b) / F.greatest(scale, F.lit(1e-6))
    loss = F.least(F.lit(cap), weight * (1 - F.exp(-0.5 * d * d)))
    return F.when(x.isNull(), None).when(scale.isNull() | (scale == 0), 0.0).otherwise(loss)


def pixel_centroid(ratio: Column) -> Column:
    """Vertical centre from the top to bottom ink ratio; null where it is negative."""
    return F.when(ratio >= 0, F.round(1 - (0.25 * ratio + 0.75) / (ratio + 1), 4))


def length_in(text: Column, table: dict[str, float], bare: str = "pt") -> Column:
    """A length such as 12.5mm as a number in the table's unit, a bare number in the unit that bare names; null where it is no length."""
    pattern = r"^\s*(-?[0-9]*\.?[0-9]+)\s*([a-z]*)\s*$"
    number = F.regexp_extract(text, pattern, 1)
    unit = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit(bare))
    factor = F.lit(None).cast("double")
    for name, value in table.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return F.when(number != "", number.cast("double")) * factor


def snap_size(v: Column, sizes: tuple[float, ...] = STANDARD_SIZES, within: float = 0.6) -> Column:
    """The first standard size within reach, else one decimal."""
    near = F.filter(F.array(*map(F.lit, sizes)), lambda s: F.abs(v - s) <= within)
    return F.coalesce(F.get(near, F.lit(0)), F.round(v, 1))


def paper_size_class(width: Column, height: Column, within: float = 6.0) -> Column:
    out = F.lit("custom")
    for name, (w, h) in reversed(list(PAPERS.items())):
        out = F.when((F.abs(width - w) <= within) & (F.abs(height - h) <= within), name).otherwise(out)
    return out


def band_loss(value: Column, low: Column, high: Column, scale: Column, low_only_above: Column | None = None, below: float = 1.2, above: float = 1.0) -> Column:
    """Distance out of a band in units of the scale; below it costs more, and nothing where only high values are bad."""
    under = F.when(value < low, below * (low - value) / scale).otherwise(0.0)
    if low_only_above is not None:
        under = F.when(low_only_above, 0.0).otherwise(under)
    return F.when(value > high, above * (value - high) / scale).otherwise(under)
