"""Windows, thresholds and dataset definitions, with the checks that keep them consistent."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Window:
    seconds: int
    bucket_seconds: int


# Windows, and the thresholds that count an event as notable.
WINDOWS = {"5m": Window(300, 60), "1h": Window(3600, 60), "24h": Window(86400, 900)}
THRESHOLDS = {
    "engine_temp_high_c": 105.0,
    "engine_load_high_pct": 80.0,
    "motor_temp_high_c": 90.0,
    "power_high_kw": 60.0,
    "battery_temp_high_c": 40.0,
    "deep_discharge_soc_pct": 10.0,
    "charging_current_a": -1.0,
    "fast_charge_current_a": -100.0,
    "harsh_speed_kmh": 80.0,
    "braking_accel_ms2": -1.0,
    "moving_speed_kmh": 1.0,
}


@dataclass(frozen=True)
class FeatureConfig:
    windows: dict[str, Window] = field(default_factory=lambda: dict(WINDOWS))
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    snapshot_seconds: int = 3600
    retention_extra_seconds: int = 3600

    def __post_init__(self):
        for name, w in self.windows.items():
            if w.seconds % w.bucket_seconds or self.snapshot_seconds % w.bucket_seconds:
                raise ValueError(f"window {name}: its length and the snapshot interval must be whole numbers of buckets")

    @property
    def lateness_seconds(self) -> int:
        """How far an event may lie behind its vehicle's latest one: the longest window and the extra."""
        return max(w.seconds for w in self.windows.values()) + self.retention_extra_seconds

    def retention_seconds(self, bucket_seconds: int) -> int:
        """How long buckets of a width are kept: the longest window that uses them, and the extra."""
        return max(w.seconds for w in self.windows.values() if w.bucket_seconds == bucket_seconds) + self.retention_extra_seconds

    @staticmethod
    def load(path: str) -> FeatureConfig:
        import yaml

        raw = yaml.safe_load(Path(path).read_text())
        windows = {k: Window(int(w["seconds"]), int(w["bucket_seconds"])) for k, w in raw["windows"].items()}
        return FeatureConfig(windows, {**THRESHOLDS, **raw.get("thresholds", {})}, int(raw.get("snapshot_interval_seconds", 3600)), int(raw.get("retention_extra_seconds", 3600)))


@dataclass(frozen=True)
class DatasetConfig:
    """Splits are day ranges from the data's start, counted from 1, both ends included."""

    splits: dict[str, tuple[int, int]] = field(default_factory=lambda: {"train": (1, 52), "calibration": (60, 64), "threshold": (65, 68), "test": (76, 83)})
    seed: int = 42
    holdout_fraction: float = 0.20
    horizon_days: int = 7
    min_calibration_positives: int = 50
    min_calibration_events: int = 5

    def __post_init__(self):
        ordered = sorted(self.splits.items(), key=lambda x: x[1])
        for (a, (_, end)), (b, (start, _)) in zip(ordered, ordered[1:], strict=False):
            if end >= start:
                raise ValueError(f"splits {a} and {b} overlap")

    def ranges_ms(self, start_ms: int) -> dict[str, tuple[int, int]]:
        """Half-open ranges of prediction times in epoch milliseconds."""
        return {k: (start_ms + (a - 1) * DAY_MS, start_ms + b * DAY_MS) for k, (a, b) in self.splits.items()}
