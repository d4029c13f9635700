"""Reducers and projectors on arrays: the small side of PCAState, for callers that have vectors at hand."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any, Protocol, runtime_checkable

import numpy as np

from ..config import TreeConfig
from .pca import PCAState


class Reducer:
    """Passes vectors on as they are; always fitted."""

    kind = "identity"

    @property
    def is_fitted(self) -> bool:
        return True

    def fit(self, x: np.ndarray) -> None:
        pass

    def partial_fit(self, x: np.ndarray) -> None:
        pass

    def transform(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, float)

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind}

    @staticmethod
    def from_config(config: TreeConfig) -> Reducer:
        if config.pca_dims is None:
            return IdentityReducer()
        return {"freeze": FreezePCAReducer, "incremental": IncrementalPCAReducer}[config.pca_mode](config.pca_dims)

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Reducer:
        made = {k.kind: k for k in (IdentityReducer, FreezePCAReducer, IncrementalPCAReducer)}.get(d["kind"])
        if made is None:
            raise ValueError(f"unknown reducer kind: {d['kind']!r}")
        if made is IdentityReducer:
            return made()
        out = made(d["n_components"])
        out.state = PCAState.from_dict(d["state"])
        return out


class IdentityReducer(Reducer):
    pass


class FreezePCAReducer(Reducer):
    """Each fit is a whole one."""

    kind = "pca_freeze"

    def __init__(self, n_components: int):
        self.n_components, self.state = n_components, PCAState()

    @property
    def is_fitted(self) -> bool:
        return self.state.is_fitted

    def fit(self, x: np.ndarray) -> None:
        self.state = PCAState().add_rows(x).solve(self.n_components)

    def partial_fit(self, x: np.ndarray) -> None:
        self.fit(x)

    def transform(self, x: np.ndarray) -> np.ndarray:
        return self.state.transform(x)

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "n_components": self.n_components, "state": self.state.to_dict()}


class IncrementalPCAReducer(FreezePCAReducer):
    """A partial fit adds its rows' moments to those before, so the axes are those of all rows, exactly."""

    kind = "pca_incremental"

    def partial_fit(self, x: np.ndarray) -> None:
        self.state.add_rows(x).solve(self.n_components)


@dataclass
class PCAConfig:
    """R7. Checked as a tree's settings are."""

    dims: int | None = None
    mode: str = "freeze"
    warmup: int = 1000
    batch_size: int = 256

    def tree(self) -> TreeConfig:
        return TreeConfig(pca_dims=self.dims, pca_mode=self.mode, pca_warmup=self.warmup, pca_batch_size=self.batch_size)


@runtime_checkable
class VectorProjector(Protocol):
    @property
    def is_fitted(self) -> bool: ...

    def fit(self, vectors: np.ndarray) -> None: ...

    def transform(self, vectors: np.ndarray) -> np.ndarray: ...

    def __call__(self, vectors: np.ndarray) -> np.ndarray: ...


class PCAProjector:
    """A reducer that can be called."""

    def __init__(self, config: PCAConfig | None = None, *, reducer: Reducer | None = None):
        self.config = config or PCAConfig()
        self.reducer = reducer or Reducer.from_config(self.config.tree())

    @property
    def is_fitted(self) -> bool:
        return self.reducer.is_fitted

    def fit(self, vectors: np.ndarray) -> None:
        self.reducer.fit(vectors)

    def partial_fit(self, vectors: np.ndarray) -> None:
        self.reducer.partial_fit(vectors)

    def transform(self, vectors: np.ndarray) -> np.ndarray:
        return self.reducer.transform(vectors)

    __call__ = transform

    def to_dict(self) -> dict[str, Any]:
        return {"config": asdict(self.config), "reducer": self.reducer.to_dict()}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> PCAProjector:
        return cls(PCAConfig(**d["config"]), reducer=Reducer.from_dict(d["reducer"]))
