"""Settings of the linkage operators; the defaults are the production values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    token_cap: int = 5000  # tokens in more records than this don't block
    rarest: int = 4  # query tokens kept per record
    top_k: int = 40  # candidates per record and source
    negatives: int = 8  # hard negatives per record
    rerank: int = 300  # candidates that get the second ranking stage
    country_policy: str = "wildcard"  # strict, left_wildcard or wildcard
    profile: str = "serve"  # serve or train


DEFAULTS = Settings()
