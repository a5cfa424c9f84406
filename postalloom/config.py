"""Settings of the engine in one immutable object."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are the tuned ones; ``mode='faithful'`` also reproduces known quirks that ``'clean'`` mends."""

    mode: str = "clean"
    text_weight: float = 0.4
    spatial_weight: float = 0.4
    admin_weight: float = 0.2
    minhash_permutations: int = 256
    ngram: int = 3
    lsh_threshold: float = 0.3
    similar_from: float = 0.7
    similarity_threshold: float = 0.85
    min_cluster_size: int = 2
    max_radius_km: float = 3.0
    use_spatial_constraints: bool = True
    missing_coords: str = "drop"  # or "text_only": pairs without coordinates stay linked
    spatial_decay_km: float = 10.0
    max_search_radius_km: float = 50.0
    grid_degrees: float = 0.1
    grid_slack: float = 1.5
    skip_unparsed_block: bool = False
    dbscan_eps: float = 0.5
    dbscan_min_samples: int = 2
    linkage: str = "average"
    optimize_from: float = 0.5
    validate_from: float = 0.6
    sampling_size: int = 5
    jaro_boost_threshold: float = 0.7
    jaro_prefix_scale: float = 0.1
    watermark: str = "1 day"

    def __post_init__(self) -> None:
        if self.mode not in ("clean", "faithful"):
            raise ValueError("mode is 'clean' or 'faithful'")
        if self.missing_coords not in ("drop", "text_only"):
            raise ValueError("missing_coords is 'drop' or 'text_only'")

    def updated(self, **changes) -> EngineConfig:
        """A copy with some fields changed; unknown names are an error."""
        return dataclasses.replace(self, **changes)

    @property
    def faithful(self) -> bool:
        return self.mode == "faithful"

    @property
    def weights(self) -> dict[str, float]:
        return {"text": self.text_weight, "spatial": self.spatial_weight, "administrative": self.admin_weight}
