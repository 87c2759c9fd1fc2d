"""Feature formulas over merged window statistics: the one definition for batch and stream.

Statistics are columns named ``<window>_<stat>`` (``5m_n_events``); an absent value is null, counts are never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.config import DAY_MS
from tarmac.functions.scalars import ratio, std_from_sums

WINDOWS = ["5m", "1h", "24h"]
VEHICLE_TYPES = ["ICE", "EV", "HYBRID"]
COMPONENTS = ["BRAKE", "POWERTRAIN", "BATTERY"]
# The vehicle types that have a signal (others: all types).
HAS_SIGNAL = {
    "engine_temp": ["ICE", "HYBRID"],
    "engine_load": ["ICE", "HYBRID"],
    "rpm": ["ICE", "HYBRID"],
    "motor_temp": ["EV", "HYBRID"],
    "power": ["EV", "HYBRID"],
}


class Block:
    """The features of one window."""

    def __init__(self, window: str):
        self.window = window

    def stat(self, name: str) -> Column:
        return F.col(f"`{self.window}_{name}`")

    def count(self, name: str) -> Column:
        return F.coalesce(self.stat(name), F.lit(0)).cast("double")

    def signal(self, name: str, kind: str) -> Column:
        """mean, std, max, min or a count of a signal; null where the type lacks it or the window is without values."""
        n = self.stat(f"{name}_n")
        there = n > 0
        if name in HAS_SIGNAL:
            there = there & F.col("vehicle_type").isin(HAS_SIGNAL[name])
        if kind == "mean":
            value = ratio(self.stat(f"{name}_sum"), n)
        elif kind == "std":
            value = std_from_sums(self.stat(f"{name}_sum"), self.stat(f"{name}_sumsq"), n)
        elif kind in ("max", "min"):
            value = self.stat(f"{name}_{kind}")
        else:
            value = self.count(kind)
        return F.when(there, value)

    def common(self, component: str) -> dict[str, Column]:
        moving = self.stat("n_moving")
        return {
            "events": self.count("n_events"),
            "moving_events": self.count("n_moving"),
            "avg_speed_moving": ratio(self.stat("speed_sum"), moving),
            "speed_std_moving": std_from_sums(self.stat("speed_sum"), self.stat("speed_sumsq"), moving),
            "distance_km": self.stat("odo_max") - self.stat("odo_min"),
            "dtc_events": self.count("dtc_event_count"),
            "component_dtc_events": self.count(f"dtc_{component.lower()}_count"),
        }

    def brake(self) -> dict[str, Column]:
        return {
            "harsh_brakes": self.count("harsh_count"),
            "harsh_high_speed": self.count("harsh_high_speed_count"),
            "min_accel": self.stat("accel_min"),
            "mean_harsh_decel": -ratio(self.stat("harsh_accel_sum"), self.stat("harsh_accel_n")),
            "mean_braking_decel": -ratio(self.stat("brake_accel_sum"), self.stat("brake_n")),
        }

    def powertrain(self) -> dict[str, Column]:
        s = self.signal
        out = {f"engine_temp_{k}": s("engine_temp", k) for k in ("mean", "max", "std")}
        out["high_engine_temp_events"] = s("engine_temp", "engine_temp_high_count")
        out["engine_load_mean"], out["high_load_events"] = s("engine_load", "mean"), s("engine_load", "engine_load_high_count")
        out["rpm_mean"], out["rpm_std"] = s("rpm", "mean"), s("rpm", "std")
        out |= {f"motor_temp_{k}": s("motor_temp", k) for k in ("mean", "max", "std")}
        out["high_motor_temp_events"] = s("motor_temp", "motor_temp_high_count")
        out["power_mean"], out["power_max"], out["high_power_events"] = s("power", "mean"), s("power", "max"), s("power", "power_high_count")
        return out

    def battery(self) -> dict[str, Column]:
        s, with_current, with_soc = self.signal, self.stat("current_n") > 0, self.stat("soc_min").isNotNull()
        out = {
            "soc_min": self.stat("soc_min"), "soc_max": self.stat("soc_max"),
            "soc_delta": self.stat("soc_last")["value"] - self.stat("soc_first")["value"],
        }
        out |= {f"battery_temp_{k}": s("battery_temp", k) for k in ("mean", "max", "std")}
        out["high_temp_events"] = s("battery_temp", "battery_temp_high_count")
        out |= {f"voltage_{k}": s("voltage", k) for k in ("mean", "std", "min")}
        out |= {f"current_{k}": s("current", k) for k in ("mean", "std")}
        out["current_max_abs"] = F.when(with_current, self.stat("current_absmax"))
        out["charging_events"] = F.when(with_current, self.count("charging_count"))
        out["fast_charge_events"] = F.when(with_current, self.count("fast_charge_count"))
        out["deep_discharge_events"] = F.when(with_soc, self.count("deep_discharge_count"))
        return out


def static() -> dict[str, Column]:
    """Features of the vehicle's context: feature_ts_ms, manufacture_date_ms, last_service_ts_ms, last_service_odometer_km."""
    t, service, odometer = F.col("feature_ts_ms"), F.col("last_service_ts_ms"), F.col("`24h_odo_max`")
    out = {
        "days_since_service": (t - service) / F.lit(float(DAY_MS)),
        "has_service_history": F.when(service.isNotNull(), 1.0).otherwise(0.0),
        "distance_since_service_km": F.when(service.isNotNull(), odometer - F.col("last_service_odometer_km")),
        "vehicle_age_days": (t - F.col("manufacture_date_ms")) / F.lit(float(DAY_MS)),
        "odometer_km": odometer,
    }
    return out | {f"vt_{v.lower()}": F.when(F.col("vehicle_type") == v, 1.0).otherwise(0.0) for v in VEHICLE_TYPES}


def features(component: str) -> dict[str, Column]:
    """All features of a component by name, in a stable order that doesn't depend on the vehicle's type."""
    if component not in COMPONENTS:
        raise ValueError(f"unknown component {component}")
    out: dict[str, Column] = {}
    for w in WINDOWS:
        block = Block(w)
        own = {"BRAKE": block.brake, "POWERTRAIN": block.powertrain, "BATTERY": block.battery}[component]()
        out |= {f"w{w}_{k}": c for k, c in (block.common(component) | own).items()}
    return out | static()


def feature_names(component: str) -> list[str]:
    return list(features(component))


def window_complete() -> Column:
    """Whether the vehicle's first event is at least a day before the snapshot."""
    return F.col("first_event_ts_ms") <= F.col("feature_ts_ms") - DAY_MS
