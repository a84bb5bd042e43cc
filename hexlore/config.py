"""Settings of the whole analysis; passed to the run, never global."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """cell_edge is in metres; fewer restarts, trees or settings make quick runs, the defaults are the whole analysis."""

    cell_edge: float = 174.0
    neighbours: int = 6
    k_range: tuple[int, int] = (2, 10)
    least_k: int = 4
    restarts: int = 25
    final_restarts: int = 50
    most_iterations: int = 100
    folds: int = 5
    seed: int = 42
    train_share: float = 0.7
    missing_limit: float = 50.0
    trees: int = 500
    depth: int = 15
    grids: dict[str, dict] = field(default_factory=dict)
    risk_weights: dict[str, float] = field(default_factory=lambda: {"mean_rent_change_total": 0.4, "mean_demo_density": 0.3, "mean_vulnerability_index": 0.3})
    category_edges: tuple[float, float, float] = (25.0, 50.0, 75.0)
    factor_percentile: float = 0.75
    factor_features: int = 10
    factors: int = 3
