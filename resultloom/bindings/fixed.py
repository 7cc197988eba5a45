"""Values that the reference SQL holds the code to, written out apart from it."""

from __future__ import annotations

from typing import NamedTuple

# Source quality and (relevance, freshness, quality) weights by source type.
SOURCE_QUALITY = {"The Guardian": 0.9, "Wikipedia": 0.8, "Global Wire": 0.85}
WEIGHT_SETS = {
    "relevance_only": {"news": (1.0, 0.0, 0.0), "social": (1.0, 0.0, 0.0), "reference": (1.0, 0.0, 0.0)},
    "design": {"news": (0.55, 0.3, 0.15), "social": (0.55, 0.3, 0.15), "reference": (0.65, 0.1, 0.25)},
    "balanced": {"news": (0.5, 0.3, 0.2), "social": (0.5, 0.3, 0.2), "reference": (0.6, 0.15, 0.25)},
    "relevance_heavy": {"news": (0.7, 0.2, 0.1), "social": (0.7, 0.2, 0.1), "reference": (0.75, 0.1, 0.15)},
}

# Words left out of titles and queries, publisher names, tracking parameters.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of",
    "on", "or", "that", "the", "to", "was", "with",
)
PUBLISHERS = (
    "the guardian", "guardian", "bbc", "bbc news", "reuters", "cnn", "the new york times",
    "washington post", "bloomberg", "the verge", "arstechnica", "global wire", "ap news",
    "associated press",
)
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid",
    "gclsrc", "dclid", "ref", "referrer", "source", "spm", "mtm_source", "mtm_medium",
    "mtm_campaign", "mtm_content", "igshid", "mc_cid", "mc_eid", "yclid", "_ga", "gbraid",
    "wbraid",
)


class Curve(NamedTuple):
    """A freshness curve."""

    shape: str = "exp"
    news_half_life: float = 24.0
    social_half_life: float = 12.0
    floor: float = 0.05
    reference: float = 0.5
    missing: float = 0.25


# The curves compared with the production one.
CURVES = {
    "control_none": Curve(shape="constant"),
    "design": Curve(),
    "shape_linear30d": Curve(shape="linear30d"),
    "shape_step": Curve(shape="step"),
    "hl_06h": Curve(news_half_life=6.0, social_half_life=3.0),
    "hl_12h": Curve(news_half_life=12.0, social_half_life=6.0),
    "hl_48h": Curve(news_half_life=48.0, social_half_life=24.0),
    "hl_168h": Curve(news_half_life=168.0, social_half_life=84.0),
    "floor_00": Curve(floor=0.0),
    "floor_25": Curve(floor=0.25),
    "ref_09": Curve(reference=0.9),
    "miss_00": Curve(missing=0.0),
    "miss_05": Curve(missing=0.5),
    "social_24": Curve(social_half_life=24.0),
}
