"""Relevance, freshness, source quality and their weighted sum."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from resultloom.functions.text import tokens

# Ranking constants.
BAND_WIDTH = 0.05
SOURCE_QUALITY = {"The Guardian": 0.90, "Wikipedia": 0.80, "Global Wire": 0.85}
REFERENCE_QUALITY = 0.80
OTHER_QUALITY = 0.50
TYPE_ORDER = {"news": 0, "social": 1, "reference": 2}
WIDE_TYPE_ORDER = {"news": 0, "social": 1, "reference": 2, "video": 3}

# Fixed values: (relevance, freshness, quality) weights by source type.
WEIGHT_SETS = {
    "relevance_only": {"news": (1.0, 0.0, 0.0), "social": (1.0, 0.0, 0.0), "reference": (1.0, 0.0, 0.0)},
    "design": {"news": (0.55, 0.30, 0.15), "social": (0.55, 0.30, 0.15), "reference": (0.65, 0.10, 0.25)},
    "balanced": {"news": (0.50, 0.30, 0.20), "social": (0.50, 0.30, 0.20), "reference": (0.60, 0.15, 0.25)},
    "relevance_heavy": {"news": (0.70, 0.20, 0.10), "social": (0.70, 0.20, 0.10), "reference": (0.75, 0.10, 0.15)},
}
DESIGN_WEIGHTS = WEIGHT_SETS["design"]


def lexical_overlap(query_terms: Column, title: Column, description: Column) -> Column:
    """3 for each distinct query term in the title, 1 for each in the description."""
    in_title = F.size(F.array_intersect(query_terms, tokens(title)))
    in_text = F.size(F.array_intersect(query_terms, tokens(description)))
    return 3 * in_title + in_text


def share_of_max(raw: Column, top: Column) -> Column:
    return F.coalesce(raw / F.nullif(top, F.lit(0)), F.lit(0.0))


def type_order(source_type: Column, order: dict[str, int] = TYPE_ORDER) -> Column:
    chain = F
    for name, place in order.items():
        chain = chain.when(source_type == name, place)
    return chain.otherwise(9)


def source_quality(source_type: Column, source_name: Column) -> Column:
    chain = F
    for name, value in SOURCE_QUALITY.items():
        chain = chain.when(source_name == name, value)
    return chain.when(source_type == "reference", REFERENCE_QUALITY).otherwise(OTHER_QUALITY)


@dataclass(frozen=True)
class Decay:
    """A freshness curve: shape, half-lives, floor and the two constant levels."""

    shape: str = "exp"
    news_half_life: float = 24.0
    social_half_life: float = 12.0
    floor: float = 0.05
    reference: float = 0.5
    missing: float = 0.25

    def __post_init__(self) -> None:
        if self.shape not in ("exp", "linear30d", "step", "constant"):
            raise ValueError(f"unknown shape {self.shape!r}")


PRODUCTION_DECAY = Decay()

# The curves compared with the production one.
DECAY_CANDIDATES = {
    "control_none": replace(PRODUCTION_DECAY, shape="constant"),
    "design": PRODUCTION_DECAY,
    "shape_linear30d": replace(PRODUCTION_DECAY, shape="linear30d"),
    "shape_step": replace(PRODUCTION_DECAY, shape="step"),
    "hl_06h": replace(PRODUCTION_DECAY, news_half_life=6.0, social_half_life=3.0),
    "hl_12h": replace(PRODUCTION_DECAY, news_half_life=12.0, social_half_life=6.0),
    "hl_48h": replace(PRODUCTION_DECAY, news_half_life=48.0, social_half_life=24.0),
    "hl_168h": replace(PRODUCTION_DECAY, news_half_life=168.0, social_half_life=84.0),
    "floor_00": replace(PRODUCTION_DECAY, floor=0.0),
    "floor_25": replace(PRODUCTION_DECAY, floor=0.25),
    "ref_09": replace(PRODUCTION_DECAY, reference=0.9),
    "miss_00": replace(PRODUCTION_DECAY, missing=0.0),
    "miss_05": replace(PRODUCTION_DECAY, missing=0.5),
    "social_24": replace(PRODUCTION_DECAY, social_half_life=24.0),
}


def age_hours(published_at: Column, now: Column) -> Column:
    """Hours between publication and ``now``; the future counts as age 0."""
    micros = F.unix_micros(now) - F.unix_micros(published_at)
    return F.greatest(F.lit(0.0), micros / 1e6 / 3600.0)


def instant(now: datetime | str) -> Column:
    return F.to_timestamp(F.lit(str(now)))


def freshness(
    published_at: Column,
    source_type: Column,
    now: Column,
    decay: Decay = PRODUCTION_DECAY,
    *,
    strict: bool = True,
) -> Column:
    """Freshness in [0, 1]. A source type the curve does not cover is an error when strict."""
    age = age_hours(published_at, now)
    floor, span = decay.floor, 1.0 - decay.floor
    if decay.shape == "exp":
        half_life = F.when(source_type == "news", decay.news_half_life).otherwise(
            decay.social_half_life
        )
        value = floor + span * F.pow(F.lit(2.0), -age / half_life)
    elif decay.shape == "linear30d":
        value = F.greatest(F.lit(floor), 1.0 - (age / 720.0) * span)
    elif decay.shape == "step":
        value = F.when(age < 24.0, 1.0).when(age < 168.0, 0.7).when(age < 720.0, 0.4).otherwise(0.2)
    else:
        value = F.lit(1.0)
    scored = (
        F.when(source_type == "reference", decay.reference)
        .when(published_at.isNull(), decay.missing)
        .otherwise(value)
    )
    if not strict:
        return scored
    known = source_type.isin(*TYPE_ORDER)
    message = F.concat(F.lit("freshness is not defined for source type "), source_type)
    return F.when(known, scored).otherwise(F.raise_error(message).cast("double"))


def freshness_by(published_at: Column, source_type: Column, now: Column, curve: Column) -> Column:
    """Freshness by a curve that is data: a struct of the fields of ``Decay``. An unknown shape is constant."""
    age, span = age_hours(published_at, now), 1.0 - curve["floor"]
    half_life = F.when(source_type == "news", curve["news_half_life"]).otherwise(curve["social_half_life"])
    value = (
        F.when(curve["shape"] == "exp", curve["floor"] + span * F.pow(F.lit(2.0), -age / half_life))
        .when(curve["shape"] == "linear30d", F.greatest(curve["floor"], 1.0 - (age / 720.0) * span))
        .when(curve["shape"] == "step", F.when(age < 24.0, 1.0).when(age < 168.0, 0.7).when(age < 720.0, 0.4).otherwise(0.2))
        .otherwise(1.0)
    )
    return F.when(source_type == "reference", curve["reference"]).when(published_at.isNull(), curve["missing"]).otherwise(value)


def age_for(target: Column, half_life: float, decay: Decay = PRODUCTION_DECAY) -> Column:
    """Age in hours at which an exponential curve falls to ``target``."""
    return -half_life * F.log2((target - decay.floor) / (1.0 - decay.floor))


def weighted(
    relevance: Column, fresh: Column, quality: Column, source_type: Column, weights: dict
) -> Column:
    """Weighted sum with the weights of the source type (news weights when unknown)."""
    def total(w: tuple[float, float, float]) -> Column:
        return w[0] * relevance + w[1] * fresh + w[2] * quality

    chain = F
    for name, w in weights.items():
        if name != "news":
            chain = chain.when(source_type == name, total(w))
    return chain.otherwise(total(weights["news"]))
