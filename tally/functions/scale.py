"""Raw-to-scaled score curve and proficiency bands."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally import fixed


def level_floor(level: Column) -> Column:
    """Lowest scaled score of a year level."""
    return F.lit(fixed.SCALE_BASE) + (level - fixed.SCALE_BASE_LEVEL) * fixed.SCALE_STEP


def domain_offset(domain: Column) -> Column:
    """Points a domain adds to its level's floor."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(fixed.DOMAIN_OFFSETS.items())])
    return F.try_element_at(table, domain)


def curve(share: Column, steepness: float = fixed.SCALE_STEEPNESS) -> Column:
    """S-curve on [0, 1] that maps 0 to 0 and 1 to 1."""
    low = 1.0 / (1.0 + math.exp(steepness / 2))
    high = 1.0 / (1.0 + math.exp(-steepness / 2))
    logistic = 1.0 / (1.0 + F.exp(-steepness * (share - 0.5)))
    return (logistic - low) / (high - low)


def scaled_score(raw: Column, max_raw: Column, floor: Column, span: float = fixed.SCALE_SPAN) -> Column:
    """Scaled score of a raw score, one decimal."""
    return F.round(floor + curve(raw / max_raw) * span, 1)


def band(scaled: Column, floor: Column, bands: dict = fixed.BANDS) -> Column:
    """Band of a scaled score relative to its level's floor; null stays null."""
    points = scaled - floor
    labels = list(bands.items())
    out = F.when(scaled.isNull(), F.lit(None).cast("string"))
    for label, cut in reversed(labels[1:]):
        out = out.when(points >= cut, F.lit(label))
    return out.otherwise(F.lit(labels[0][0]))
