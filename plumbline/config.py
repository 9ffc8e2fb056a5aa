"""Parameters of the analysis, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # The defaults that results are compared at.
    num_bins: int = 200
    prominence_ratio: float = 0.1
    min_peak_width: float = 2
    width_multiplier: float = 2.5
    band_width: float | None = None
    fallback_z_ratio: float = 0.2
    tilt_fwhm_threshold: float = 2.0
    tilt_width_multiplier: float = 1.0
    intensity_percentile: float = 25.0
    color_tolerance: float = 0.6
    color_std_threshold: float = 0.01
    flatness_grid: int = 150
    height_grid: int = 100
    min_points: int = 3
    strip_ratio: float = 0.5
    roi_min_points: int = 100
    seed: int = 42
    max_points: int = 5_000_000
    chunk_size: int = 1_000_000
    sweep_points: int = 500_000
    roi_points: int = 500_000
    surface_points: int = 500_000
    surface_resolution: int = 200
    z_exaggeration: float = 1.0
    width_sweep: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0)
    tolerance_sweep: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)
    percentile_sweep: tuple[float, ...] = (10.0, 20.0, 25.0, 30.0, 40.0, 50.0, 75.0)
    highlight: tuple[float, float, float] = (1.0, 0.2, 0.2)
    grey: float = 0.7
