"""Tunable settings, grouped, immutable and clamped to their legal range.

The defaults and ranges below are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


def _num(default, low, high):
    return field(default=default, metadata={"range": (low, high)})


class _Clamped:
    """Settings group whose numeric fields are pulled back into their range."""

    def clamped(self):
        changes = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if "range" in f.metadata:
                low, high = f.metadata["range"]
                changes[f.name] = min(max(value, low), high)
            elif isinstance(value, tuple) and not value:
                changes[f.name] = f.default
        return replace(self, **changes)


@dataclass(frozen=True)
class FrameSettings(_Clamped):
    frame_width: int = _num(320, 64, 1920)
    frame_height: int = _num(240, 64, 1080)
    mse_threshold: float = _num(100.0, 0.0, 10000.0)
    mse_min_threshold: float = _num(0.05, 0.0, 10000.0)
    ssim_threshold: float = _num(0.55, 0.0, 1.0)
    ssim_max_threshold: float = _num(0.999, 0.0, 1.0)
    num_check_points: int = _num(9, 1, 1000)
    min_valid_points: int = _num(5, 1, 1000)
    scene_cut_threshold: float = _num(50.0, 0.0, 10000.0)
    cut_half_window: int = _num(5, 1, 1000)
    cut_signature_length: int = _num(10, 2, 1000)
    fingerprint_correlation: float = _num(0.80, 0.0, 1.0)
    min_scene_cuts: int = _num(3, 1, 10000)
    min_cut_spacing: int = _num(24, 1, 10000)
    verify_source_sec: int = _num(10, 1, 3600)
    verify_lang_sec: int = _num(15, 1, 3600)
    retry_source_sec: int = _num(20, 1, 3600)
    retry_lang_sec: int = _num(30, 1, 3600)


@dataclass(frozen=True)
class SpeedSettings(_Clamped):
    source_start_sec: int = _num(1, 0, 3600)
    source_duration_sec: int = _num(120, 1, 3600)
    lang_duration_sec: int = _num(180, 1, 3600)
    min_ratio_diff: float = _num(0.001, 0.0001, 1.0)
    max_duration_diff_telecine: float = _num(0.005, 0.0001, 1.0)


@dataclass(frozen=True)
class ConstantOffsetSettings(_Clamped):
    min_duration_ms: int = _num(10000, 1000, 600000)
    source_start_sec: int = _num(1, 0, 3600)
    source_duration_sec: int = _num(120, 1, 3600)
    lang_duration_sec: int = _num(180, 1, 3600)
    min_valid_points: int = _num(5, 1, 1000)
    grouping_tolerance_frames: int = _num(1, 1, 10)


@dataclass(frozen=True)
class PiecewiseSettings(_Clamped):
    coarse_fps: float = _num(2.0, 0.1, 30.0)
    dense_scan_fps: float = _num(1.0, 0.1, 30.0)
    dense_scan_ssim: float = _num(0.5, 0.0, 1.0)
    dense_scan_min_dip: int = _num(2, 1, 1000)
    linear_scan_window_sec: float = _num(3.0, 0.1, 60.0)
    linear_scan_confirm: int = _num(5, 1, 1000)
    dip_ssim: float = _num(0.2, 0.0, 1.0)
    probe_margins_sec: tuple = (5.0, 15.0, 25.0)
    probe_min_points: int = _num(2, 1, 1000)
    probe_duration_sec: float = _num(3.0, 0.1, 60.0)
    probe_deltas_ms: tuple = (1000, 2000, 3000, 4000, 5000, -1000, -2000, -3000, -4000, -5000)
    probe_min_ssim: float = _num(0.7, 0.0, 1.0)
    min_offset_change_ms: int = _num(500, 1, 60000)
    min_consecutive: int = _num(5, 1, 1000)
    scene_threshold: float = _num(0.3, 0.0, 1.0)
    match_tolerance_ms: int = _num(250, 1, 60000)
    wide_probe_sec: float = _num(15.0, 0.1, 120.0)
    scene_timeout_ms: int = _num(600000, 1000, 3600000)
    verify_points: int = _num(30, 1, 1000)
    verify_min_ratio: float = _num(0.80, 0.0, 1.0)
    verify_mse_multiplier: float = _num(3.0, 0.1, 100.0)
    initial_range_sec: int = _num(30, 1, 3600)
    initial_step_sec: float = _num(0.5, 0.01, 60.0)
    initial_cuts: int = _num(50, 1, 10000)
    min_region_sec: float = 20.0


@dataclass(frozen=True)
class SpliceSettings(_Clamped):
    timeout_ms: int = _num(300000, 1000, 3600000)


@dataclass(frozen=True)
class Settings:
    frames: FrameSettings = FrameSettings()
    speed: SpeedSettings = SpeedSettings()
    constant: ConstantOffsetSettings = ConstantOffsetSettings()
    piecewise: PiecewiseSettings = PiecewiseSettings()
    splice: SpliceSettings = SpliceSettings()

    def clamped(self) -> "Settings":
        return Settings(*(getattr(self, f.name).clamped() for f in fields(self)))


DEFAULTS = Settings()
# 64-element test vectors change scene at a larger step and more often than video does.
VECTOR_FRAMES = FrameSettings(scene_cut_threshold=600.0, min_cut_spacing=6)
