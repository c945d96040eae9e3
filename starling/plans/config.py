"""Run configuration: a JSON file or keyword arguments; every part has defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass
class GraphConfig:
    to_execute: bool = False
    source: str = ""
    fmt: str = "json"
    start: str | None = None  # dd/mm/yyyy
    end: str | None = None
    method: str = "full"
    zone: str = "UTC"
    retweet: bool = True
    tweet_retweet: bool = False
    user_hashtag: bool = True
    hashtag_cooccurrences: bool = True
    response: bool = True
    mention: bool = False
    output: str = ""


@dataclass
class HierarchicalConfig:
    community_col_name: str = "0.1"
    top_k: int = 500
    collapse_nodes: bool = True
    min_size: int = 30


@dataclass
class CommunityConfig:
    to_execute: bool = False
    edges: str = ""
    algorithm: str = "leiden"  # leiden, combo, hierarchical
    temporal: bool = False
    low: float = 0.1
    high: float = 1.0
    number_of_resolutions: int = 10
    n_iterations: int = 10
    lambda_temporal: float = 0.1
    cap_bonus: float = 1.0
    hierarchical: HierarchicalConfig = field(default_factory=HierarchicalConfig)
    output: str = ""


@dataclass
class TextConfig:
    to_execute: bool = False
    indexes: list[int] = field(default_factory=list)
    community_col_name: str = "0.1"
    source: str = ""
    output: str = ""


@dataclass
class FunnelConfig:
    to_execute: bool = False
    min_comm_size: int = 11
    jaccard_threshold: float = 0.4
    entropy_quantile: float = 0.25
    top_n: int = 500
    keywords: list[str] = field(default_factory=list)
    keyword_threshold: int = 5000


@dataclass
class Config:
    graph: GraphConfig = field(default_factory=GraphConfig)
    community: CommunityConfig = field(default_factory=CommunityConfig)
    text: TextConfig = field(default_factory=TextConfig)
    funnel: FunnelConfig = field(default_factory=FunnelConfig)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    @classmethod
    def of(cls, tree: dict) -> Config:
        return _fill(cls(), tree)


def _fill(target, tree: dict):
    known = {f.name for f in fields(target)}
    for name, value in tree.items():
        if name not in known:
            raise ValueError(f"unknown setting {name!r}")
        own = getattr(target, name)
        setattr(target, name, _fill(own, value) if hasattr(own, "__dataclass_fields__") else value)
    return target
