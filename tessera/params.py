"""Parameters of the embeddings, with their defaults and limits."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EmbedderParams:
    """Entropy embedding: dimension, kernel (scale_rho, beta), curve b, and the optimiser's effort."""

    asked_dim: int = 2
    dmap_init: bool = True
    beta: float = 1.0
    b: float = 1.0
    scale_rho: float = 1.0
    grad_step: float = 2.0
    nb_sampling_by_edge: int = 10
    nb_grad_batch: int = 20
    grad_factor: int = 4
    hierarchy_layer: int = 0
    hubness_weighting: bool = False
    seed: int = 4664397

    def with_(self, **changes) -> EmbedderParams:
        return replace(self, **changes)


@dataclass(frozen=True)
class DiffusionParams:
    """Diffusion map: alfa is held within [-2, 1], beta must be within [-1.01, 0], epsil is held within [0.5, 4]."""

    asked_dim: int = 2
    alfa: float = 1.0
    beta: float = 0.0
    epsil: float = 2.0
    t: float | None = 5.0
    gnbn: int | None = 12
    h_layer: int = 0
    exact_rw: bool = False

    def __post_init__(self):
        object.__setattr__(self, "alfa", min(1.0, max(-2.0, self.alfa)))
        object.__setattr__(self, "epsil", min(4.0, max(0.5, self.epsil)))
        if not -1.01 <= self.beta <= 0:
            raise ValueError("beta must be between -1.01 and 0")

    @classmethod
    def variable_bandwidth(cls, **changes) -> DiffusionParams:
        return cls(**{"alfa": 0.5, "beta": -0.1, "epsil": 1.5, "t": 5.0, "gnbn": 12} | changes)

    @classmethod
    def fixed_bandwidth(cls, **changes) -> DiffusionParams:
        return cls(**{"alfa": 1.0, "beta": 0.0, "epsil": 2.0, "t": 5.0, "gnbn": 16} | changes)


@dataclass(frozen=True)
class Rank:
    """Range of a fixed rank, by ``nbiter`` subspace iterations."""

    rank: int = 20
    nbiter: int = 5


@dataclass(frozen=True)
class Epsil:
    """Range to a precision, in blocks of ``step`` vectors (2 at least), up to ``max_rank``."""

    epsil: float = 0.02
    step: int = 5
    max_rank: int = 100

    def __post_init__(self):
        object.__setattr__(self, "step", max(2, self.step))


@dataclass(frozen=True)
class QualityParams:
    nbng: int = 100
    sampling_fraction: float = 1.0
