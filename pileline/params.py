"""Parameters of a call."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class CallParams:
    """Qualities are characters less ``q_min``. Priors and the two dependency factors are probabilities."""

    q_min: int = 64
    q_max: int = 104
    read_length: int = 45
    het_novel: float = 0.0010
    althom_novel: float = 0.0005
    het_val: float = 0.10
    althom_val: float = 0.05
    het_unval: float = 0.02
    althom_unval: float = 0.01
    global_dependency: float = 0.9
    pcr_dependency: float = 0.5
    depth_cap: int = 255
    transition_dominant: bool = False
    monoploid: bool = False
    refine: bool = False
    rank_sum: bool = False
    exact_rank: bool = False

    def __post_init__(self):
        if not 0 <= self.q_max - self.q_min < 64:
            raise ValueError("q_max must be from q_min to q_min + 63")
        if not 0 < self.read_length <= 256:
            raise ValueError("read_length must be from 1 to 256")

    @property
    def log_global(self) -> float:
        return math.log10(self.global_dependency)

    @property
    def log_pcr(self) -> float:
        return math.log10(self.pcr_dependency)
