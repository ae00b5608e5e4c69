"""Settings of the raster and label pipeline, without side effects."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Fixed values that results depend on; the names say what each governs."""

    tile_degrees: float = 0.05
    scale_metres: int = 10
    epsg: int = 32627
    seasons: tuple[tuple[str, str], ...] = (("2019-01-01", "2019-04-30"), ("2019-05-01", "2019-08-31"), ("2019-09-01", "2019-12-31"))
    bands: tuple[str, ...] = ("B2", "B3", "B4", "B8", "B11", "B12")
    indices: tuple[str, ...] = ("NDVI", "EVI", "EVI2", "NBR", "NDMI")
    cloud_percent_below: float = 100.0
    opaque_bit: int = 10
    cirrus_bit: int = 11
    min_positives: int = 10
    ratio_range: tuple[float, float] = (0.20, 0.30)
    legacy_balance_ratio: float = 0.25
    legacy_min_positives: int = 100
    duplicate_degrees: float = 0.0001
    margin: tuple[float, float] = (0.4, 0.6)
    positive_probability: float = 0.5
    candidates_per_round: int = 5
    random_per_tile: int = 5
    sieve_pixels: int = 50
    crowd: int = 10_000  # rows of a cell of the plane beyond which it is divided among tasks
    block: int = 1024  # cells of a side of the blocks that tiles are labelled in
    forest: dict = field(default_factory=lambda: {"numTrees": 100, "maxDepth": 8})
    svm_c: float = 1.0
    fit_rows: int = 5000  # labelled rows of a worker of a network's fit, and of a search over settings
    epochs: int = 10
    learning_rate: float = 0.001
    batch: int = 32
    patch: int = 64
    inference_patch: int = 256
    seed: str = "42"


SETTINGS = Settings()
POSITIVE, NEGATIVE = "Agricultural", "Non-Agricultural"
