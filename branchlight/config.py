"""Settings of trees. Same names and defaults as the public API that this engine offers; unknown names are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


@dataclass
class RebalanceConfig:
    enabled: bool = True
    every_n_inserts: int | None = 10_000
    on_demand: bool = True  # kept for compatibility; a rebalance on demand is always allowed


@dataclass
class LLMConfig:
    provider: str = "none"
    model: str = "gpt-4o-mini"
    api_key: str | None = None
    base_url: str | None = None
    max_samples: int = 15
    max_label_words: int = 6

    def __post_init__(self):
        if self.provider not in ("none", "openai", "local"):
            raise ValueError(f"provider must be none, openai or local, not {self.provider!r}")


@dataclass
class TreeConfig:
    max_branches: int = 5
    leaf_target: int = 10
    split_algo: str = "kmeans"
    split_mode: str = "fixed"
    log_split_decisions: bool = False
    min_cluster_size: int = 2
    min_parent_dispersion: float = 0.08
    parent_dispersion_decay: float = 1.0
    min_split_gain: float = 0.05
    min_split_gain_ratio: float | None = None
    separation_weight: float = 0.05
    imbalance_weight: float = 0.05
    pca_dims: int | None = None
    pca_mode: str = "freeze"
    pca_warmup: int = 1000
    pca_batch_size: int = 256
    rebalance: RebalanceConfig = field(default_factory=RebalanceConfig)
    llm: LLMConfig = field(default_factory=LLMConfig)
    model_args: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, **given: Any) -> TreeConfig:
        """With the aliases leaf_capacity and min_samples_to_split for leaf_target, and nested settings as dicts."""
        adaptive = given.get("split_mode") == "adaptive"
        names = ["min_samples_to_split", "leaf_capacity"] if adaptive else ["leaf_capacity", "min_samples_to_split"]
        for alias in names:
            if alias in given:
                given.setdefault("leaf_target", given[alias])
        for name, kind in (("rebalance", RebalanceConfig), ("llm", LLMConfig)):
            if isinstance(given.get(name), dict):
                own = {f.name for f in fields(kind)}
                given[name] = kind(**{k: v for k, v in given[name].items() if k in own})
        own = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in own})

    @property
    def leaf_capacity(self) -> int:
        return self.leaf_target

    @property
    def min_samples_to_split(self) -> int:
        return self.leaf_target

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.max_branches >= 2, "max_branches must be at least 2")
        need(self.leaf_target >= 1, "leaf_target must be at least 1")
        if self.split_algo != "kmeans":
            raise NotImplementedError(f"split_algo {self.split_algo!r}")
        need(self.split_mode in ("fixed", "adaptive"), "split_mode must be fixed or adaptive")
        need(self.min_cluster_size >= 1, "min_cluster_size must be at least 1")
        need(0 <= self.parent_dispersion_decay <= 1, "parent_dispersion_decay must lie in 0..1")
        for name in ("min_parent_dispersion", "min_split_gain", "separation_weight", "imbalance_weight"):
            need(getattr(self, name) >= 0, f"{name} must not be negative")
        need(self.min_split_gain_ratio is None or self.min_split_gain_ratio >= 0, "min_split_gain_ratio must not be negative")
        need(self.pca_mode in ("freeze", "incremental"), "pca_mode must be freeze or incremental")
        if self.pca_dims is not None:
            need(self.pca_dims >= 2, "pca_dims must be at least 2")
            need(self.pca_warmup >= self.pca_dims, "pca_warmup must be at least pca_dims")
            need(self.pca_batch_size >= self.pca_dims, "pca_batch_size must be at least pca_dims")
