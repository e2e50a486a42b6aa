"""Scalar rules as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylattice import constants as K


def half_even(value: Column, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, ties to the even neighbour; never yields -0.0."""
    if digits == 0:
        return F.rint(value) + F.lit(0.0)
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale + F.lit(0.0)


def settled(value: Column) -> Column:
    """Strip float noise before a threshold or tie decision."""
    return half_even(value, 9)


def half_steps(hours: Column) -> Column:
    """Nearest half hour, ties to even."""
    return F.rint(settled(hours * 2.0)) / 2.0


def half_step_ceil(value: Column) -> Column:
    """Smallest multiple of one half that is not below ``value``."""
    return F.ceil(value * 2.0).cast("double") / 2.0


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` limited to [low, high]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def score_percent(score: str = "score", total: str = "total") -> Column:
    return F.try_divide(F.col(score).cast("double"), F.col(total).cast("double")) * 100.0


def lookup(column: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    """Value of a small fixed table; ``default`` (or NULL) for keys it lacks."""
    result = None
    for key, value in table.items():
        step = (column == key, F.lit(value))
        result = F.when(*step) if result is None else result.when(*step)
    return result if default is None else result.otherwise(F.lit(default))


def banded(value: Column, bands, floor) -> Column:
    """First band whose lower bound ``value`` reaches, else ``floor``; NULL stays NULL."""
    result = F.when(value.isNull(), F.lit(None))
    for bound, outcome in bands:
        result = result.when(value >= bound, F.lit(outcome))
    return result.otherwise(F.lit(floor))


def ideal_interval(percent: Column) -> Column:
    return banded(percent, K.REVISION_BANDS, K.REVISION_FLOOR_DAYS)


def performance_label(percent: Column) -> Column:
    return banded(percent, K.PERFORMANCE_BANDS, K.PERFORMANCE_FLOOR)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, so ``x-ray`` becomes ``X-Ray``."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    split = F.array_join(F.transform(words, F.initcap), "")
    # Letters and spaces only, the usual case, is what the compiled ``initcap`` does.
    return F.when(text.rlike(r"[^\p{L} ]"), split).otherwise(F.initcap(text))


def passed(score: str = "score", total: str = "total") -> Column:
    """Whether an attempt reaches the pass ratio; an attempt without questions does not."""
    ratio = F.try_divide(F.col(score).cast("double"), F.col(total).cast("double"))
    return F.coalesce((F.col(total) > 0) & (ratio >= K.PASS_RATIO), F.lit(False))


def slope_from_sums(n: Column, total: Column, index_total: Column) -> Column:
    """Least-squares slope of y on 0..n-1 from n, sum(y) and sum(index*y); 0 for one point."""
    count = n.cast("double")
    return F.when(
        n > 1,
        12.0 * (index_total - (count - 1.0) / 2.0 * total) / (count * (count * count - 1.0)),
    ).otherwise(F.lit(0.0))
