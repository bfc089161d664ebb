"""Thresholds, weights, dictionaries and labels.

Everything in this file is a constant whose value decides results.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- sources -------------------------------------------------------------
SOURCES = ["reddit", "bluesky", "hn", "rss", "gdelt", "github", "x"]
SOCIAL = ["x", "reddit", "bluesky"]
MEDIA = ["rss", "gdelt"]
TECHNICAL = ["github", "hn"]

# Trust of a source, per scoring profile.
TRUST_STRICT = {"hn": 0.9, "gdelt": 0.85, "rss": 0.8, "reddit": 0.7, "github": 0.75, "bluesky": 0.65, "x": 0.55}
TRUST_RELAXED = {"x": 0.90, "reddit": 0.85, "bluesky": 0.75, "hn": 0.80, "gdelt": 0.70, "rss": 0.65, "github": 0.45}
TRUST_DEFAULT = 0.5

# Presentation of a source.
TONE_BY_SOURCE = {"reddit": "hot", "bluesky": "cool", "hn": "cool", "rss": "muted", "gdelt": "mint",
                  "github": "mint", "x": "hot"}


# ---- trailing windows ------------------------------------------------------
@dataclass(frozen=True)
class Trailing:
    """Trailing windows of the early score. ``scale`` stretches all of them."""

    scale: float = 1.0

    @property
    def short(self) -> float:
        return 15 * 60 * self.scale

    @property
    def mid(self) -> float:
        return 30 * 60 * self.scale

    @property
    def long(self) -> float:
        return 60 * 60 * self.scale

    @property
    def day(self) -> float:
        return 24 * 3600 * self.scale

    @property
    def hour(self) -> float:
        return 3600 * self.scale


@dataclass(frozen=True)
class ScoreWindow:
    """A scoring window: length, number of buckets, smoothing factor, label."""

    hours: int
    buckets: int
    alpha: float
    label: str

    @property
    def seconds(self) -> int:
        return self.hours * 3600

    @property
    def bucket_hours(self) -> float:
        return self.hours / self.buckets


SCORE_WINDOWS = {
    "1H": ScoreWindow(1, 12, 0.30, "1h"),
    "6H": ScoreWindow(6, 12, 0.25, "6h"),
    "24H": ScoreWindow(24, 24, 0.20, "24h"),
    "7D": ScoreWindow(168, 28, 0.15, "7d"),
}

# Weights of the window score and of the early score.
CONFIDENCE_WEIGHTS = {"velocity": 0.22, "breadth": 0.20, "origin": 0.18, "crosssrc": 0.15, "baseline": 0.10,
                      "volume": 0.10, "temporal": 0.05}
EARLY_WEIGHTS = {"velocity": 0.30, "acceleration": 0.25, "spread": 0.15, "entropy": 0.08, "authors": 0.10,
                 "freshness": 0.07, "trust": 0.05}
HALF_LIFE_HOURS = 6.0

# Evidence window in hours, by shape.
EVIDENCE_HOURS = {"accel": 2, "rise": 6, "flat": 24, "decay": 24, "wobble": 6}

# ---- de-duplication --------------------------------------------------------
NUM_PERM = 128
BANDS = 32
ROWS = 4
JACCARD_MIN = 0.85
COSINE_LIVE = 0.55
SEMANTIC_DUP_COSINE = 0.92
EMBED_DIM = 384

# ---- entities --------------------------------------------------------------
# Dictionaries of whole-word, case-sensitive entity names.
BRANDS = [
    "Apple", "Google", "Microsoft", "OpenAI", "Anthropic", "Nvidia", "AMD", "Intel", "Tesla", "SpaceX", "Bitcoin",
    "Ethereum", "Meta", "Amazon", "Netflix", "Samsung", "Sony", "IBM", "Oracle", "Cisco", "Qualcomm", "Broadcom",
    "TSMC", "ASML", "Huawei", "Tencent", "Alibaba", "Baidu", "DeepMind", "Mistral",
]
ORGS = ["FBI", "EU", "NASA", "FDA", "MIT", "CIA", "NSA", "UN", "NATO", "WHO", "CDC", "SEC", "CFTC", "DOJ", "DOD",
        "ESA", "IEEE", "ACM", "WTO", "OECD"]
LOCATIONS = [
    "USA", "UK", "China", "Russia", "India", "Japan", "Germany", "France", "Spain", "Mexico", "Brazil", "Canada",
    "Australia", "Korea", "Taiwan", "Israel", "Ukraine", "California", "Texas", "New York", "London", "Paris",
    "Berlin", "Tokyo", "Beijing", "Shanghai", "Madrid", "Barcelona", "San Francisco", "Seattle",
]
RIGID_TYPES = ["brand", "product", "model", "cve", "cashtag"]

# Words that keep a profile post relevant.
DOMAIN_KEYWORDS = [
    "ai", "artificial intelligence", "gpt", "llm", "openai", "anthropic", "claude", "gemini", "mistral", "deepseek",
    "agent", "rag", "crypto", "bitcoin", "ethereum", "solana", "defi", "blockchain", "gpu", "nvidia", "chip",
    "semiconductor", "tsmc", "regulation", "eu ", "europe", "policy", "law", "fusion", "energy", "nuclear",
    "startup", "funding", "series a", "series b", "vc", "github", "open source", "repository", "twitter", "x.com",
    "bluesky", "reddit", "cybersecurity", "cve", "vulnerability", "breach", "quantum", "biotech", "crispr",
]

# Handles that never name a person.
BLOCKED_HANDLES = ["reddit", "bluesky", "github", "hacker", "news", "twitter", "support", "help", "admin", "example",
                   "test", "user", "username", "none", "null", "undefined", "deleted", "removed", "unknown"]

# ---- tables ----------------------------------------------------------------
REVIEW_DAYS = [1, 2, 4, 7, 15]
SERIES_POINTS = {"1H": 26, "6H": 34, "24H": 42, "7D": 48}
