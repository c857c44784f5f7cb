"""Parameters of a clustering run, validated on construction."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ClusterConfig:
    """model: "SD" (grid codes, few dimensions), "MIN" (signatures, many) or
    "auto" (SD below four dimensions), or "by_rows" (SD for more than 3^d rows).  end_scale 0: the largest scale that the
    data allow.  scales: if given, these, whatever range the data suggest.  grid: "per_dim"
    (each dimension has its own cell width) or "isotropic" (the widest one's for
    all).  growth: the factor of a scale less one, for MIN thresholds."""

    model: str = "SD"
    start_scale: int = 1
    end_scale: int = 0
    scales: tuple[int, ...] | None = None
    standardise: bool = True
    growth: float = 0.1
    hash_functions: int = 125
    bands: int = 25
    hub_limit: int | None = 5
    keep_unmatched: bool = True
    grid: str = "per_dim"
    radius: int = 1
    seed: int = 100
    max_sd_dimensions: int = 6
    local_edges: int = 1_000_000

    def __post_init__(self):
        if self.model not in ("SD", "MIN", "auto", "by_rows"):
            raise ValueError(f"model must be SD, MIN, auto or by_rows, not {self.model!r}")
        if self.start_scale < 1 or self.end_scale < 0 or 0 < self.end_scale < self.start_scale:
            raise ValueError("scales must satisfy 1 <= start_scale <= end_scale, or end_scale 0")
        if self.hash_functions < 1 or self.bands < 1 or self.hash_functions % self.bands:
            raise ValueError("bands must divide hash_functions")
        if self.scales is not None and (not self.scales or min(self.scales) < 1):
            raise ValueError("scales must be positive")
        if self.growth <= 0:
            raise ValueError("growth must be positive")
        if self.grid not in ("per_dim", "isotropic"):
            raise ValueError(f"grid must be per_dim or isotropic, not {self.grid!r}")
        if self.hub_limit is not None and self.hub_limit < 1:
            raise ValueError("hub_limit must be positive, or None")
        if not 1 <= self.radius <= 20:
            raise ValueError("radius must be from 1 to 20")

    @classmethod
    def from_environment(cls, env: dict[str, str]) -> ClusterConfig:
        """From the variables of a job script: CODE_MODEL, START_SCALE,
        END_SCALE, LAMBDA, DATA_STANDARDIZATION, NUMBER_OF_HASHTABLES, NUMBER_OF_BUCKETS."""
        kinds = {
            "CODE_MODEL": ("model", str), "START_SCALE": ("start_scale", int), "END_SCALE": ("end_scale", int), "LAMBDA": ("growth", float),
            "DATA_STANDARDIZATION": ("standardise", _flag), "NUMBER_OF_HASHTABLES": ("hash_functions", int), "NUMBER_OF_BUCKETS": ("bands", int),
        }
        return cls(**{name: read(env[k]) for k, (name, read) in kinds.items() if k in env})


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise ValueError(f"a flag must be true or false, not {text!r}")
    return text.lower() == "true"
