"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RunConfig:
    sheet: str = "sample_ids.txt"
    out: str = "output"
    prior: str | None = None
    contaminants: str | None = None
    fdr: float = 0.1
    contaminant_threshold: float = 0.5
    points: int = 72
    min_support: int = 2
    correlation: float = 0.4
    peak_height: float = 0.1
    peak_width: float = 2.0
    peak_prominence: float = 0.1
    window: int = 10
    probability_floor: float = 0.5
    merge_scope: str = "last"  # of conditions: "last" or "all"
    combine_mode: str = "max"  # of replicates: "max", "mean" or "product"
    null_iterations: int = 10_000
    null_quantile: float = 0.9
    probability_one: str = "null"  # information of p = 1: "null" or "clamp"
    split_peaks: bool = False
    smooth: float | None = None
    full_triangle: bool = False
    legacy_tabs: bool = False
    clusters: bool = False
    inflations: tuple[float, float, int] = (1.1, 10.0, 500)  # the first, the last, and how many are tried
    seed: int = 0
    scorer: str = "logistic"  # or "mean", or "stored"
    model: str | None = None  # path of a stored network
    resume: bool = False
