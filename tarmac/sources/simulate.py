"""A synthetic fleet for fixtures: each vehicle is simulated on its own, seeded by its id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tarmac.session import ship

TELEMETRY = (
    "vehicle_id long, vehicle_type string, ts_ms long, seq long, speed_kmh double, odometer_km double, acceleration_ms2 double, harsh_brake boolean,"
    " dtc_codes array<string>, soc_pct double, temperature_c double, engine_temp_c double, motor_temp_c double, voltage_v double, current_a double,"
    " power_kw double, engine_load_pct double, rpm double"
)
TRUTH = "vehicle_id long, component string, event_type string, ts_ms long, wear double"
COMPONENTS = ["BRAKE", "POWERTRAIN", "BATTERY"]
CODES = {"BRAKE": "BRAKE_WEAR_HIGH", "POWERTRAIN": "P0301", "BATTERY": "BATT_TEMP_HIGH"}


def drive(vehicle_id: int, start_ms: int, days: int, seed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Telemetry and ground truth of one vehicle: trips by day, heartbeats when parked, wear that grows with stress.

    Hidden wear shows in the truth only, never in the telemetry's columns.
    """
    rng = np.random.default_rng([seed, vehicle_id])
    kind = ["ICE", "EV", "HYBRID"][int(rng.integers(3))]
    step = np.arange(0, days * 86_400, 300)
    hour = step / 3600 % 24
    trip = (rng.random(len(step)) < np.where((hour > 6) & (hour < 20), 0.35, 0.02)).astype(float)
    speed = np.round(trip * rng.gamma(6, 9, len(step)), 2)
    accel = np.round(rng.normal(0, 1.2, len(step)) * trip, 3)
    odometer = np.round(rng.uniform(1000, 90_000) + np.cumsum(speed / 12), 3)
    ambient = 15 + 8 * np.sin((hour - 9) / 24 * 2 * np.pi)
    fuel, electric = kind != "EV", kind != "ICE"
    blank = np.full(len(step), np.nan)
    frame = pd.DataFrame({
        "vehicle_id": vehicle_id, "vehicle_type": kind, "ts_ms": start_ms + step * 1000, "seq": np.arange(len(step)), "speed_kmh": speed, "odometer_km": odometer,
        "acceleration_ms2": accel, "harsh_brake": accel < -3, "soc_pct": np.clip(80 + np.cumsum(np.where(trip > 0, -0.4, 0.15)) % 70 - 35, 1, 100) if electric else blank,
        "temperature_c": ambient + 6 * trip + rng.normal(0, 1, len(step)), "engine_temp_c": ambient + trip * 75 + rng.normal(0, 2, len(step)) if fuel else blank,
        "motor_temp_c": ambient + trip * 45 if electric else blank, "voltage_v": 390 + rng.normal(0, 2, len(step)) if electric else 12.6 + rng.normal(0, 0.1, len(step)),
        "current_a": np.where(trip > 0, 40.0, -20.0), "power_kw": speed * 0.4 if electric else blank, "engine_load_pct": np.clip(speed * 0.8, 0, 100) if fuel else blank, "rpm": speed * 35 if fuel else blank,
    })
    codes: list[list[str]] = [[] for _ in step]
    truth = []
    for component in COMPONENTS:
        if component == "BATTERY" and kind == "ICE":
            continue
        wear, waiting = rng.uniform(0, 0.6), 0
        for i in range(0, len(step), 12):
            if waiting:
                waiting -= 1
                if waiting == 0:
                    wear *= rng.uniform(0.15, 0.25)
                    truth.append((vehicle_id, component, "SERVICE_COMPLETED", int(frame["ts_ms"][i]), wear))
                continue
            wear += 0.0012 * (1 + trip[i : i + 12].sum() / 6)
            if wear > 0.75 and rng.random() < 0.05:
                codes[i].append(CODES[component])
            if wear > 0.9 and rng.random() < 0.02 * (wear / 0.9):
                truth.append((vehicle_id, component, "FAILURE" if rng.random() < 0.3 else "MAINTENANCE_REQUIRED", int(frame["ts_ms"][i]), wear))
                waiting = 24
    frame["dtc_codes"] = codes
    return frame[[c.strip().split()[0] for c in TELEMETRY.split(",")]], pd.DataFrame(truth, columns=[c.strip().split()[0] for c in TRUTH.split(",")])


def fleet(spark: SparkSession, vehicles: int, days: int, start_ms: int = 1_704_067_200_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(telemetry, ground truth) of a fleet, one vehicle a task's row; the same seed gives the same fleet."""
    ship(spark)
    ids = spark.range(vehicles).withColumnRenamed("id", "vehicle_id").repartition(min(vehicles, 200))

    def run(which: int):
        def each(batches):
            for pdf in batches:
                for v in pdf["vehicle_id"].tolist():
                    yield drive(v, start_ms, days, seed)[which]

        return each

    return ids.mapInPandas(run(0), TELEMETRY), ids.mapInPandas(run(1), TRUTH)
