import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tarmac.config import DatasetConfig, FeatureConfig, Window
from tarmac.functions import scalars as S
from tarmac.functions.features import COMPONENTS, feature_names, features
from tarmac.functions.stats import all_stats, merge

RECORD = (
    "vehicle_id string, ts_ms long, seq long, speed_kmh double, odometer_km double, acceleration_ms2 double, harsh_brake boolean, dtc_codes array<string>, soc_pct double,"
    " voltage_v double, current_a double, temperature_c double, motor_temp_c double, engine_temp_c double, power_kw double, engine_load_pct double, rpm double"
)


def record(ts, seq, **values):
    names = [x.split()[0] for x in RECORD.split(", ")]
    return tuple({"vehicle_id": "v", "ts_ms": ts, "seq": seq, **values}.get(n) for n in names)


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize("vin, valid", [("1HGCM82633A004352", True), ("1HGCM82633A004353", True), ("1HGCM82643A004352", False), ("1HGCM8263IA004352", False), ("1HGCM82633A00435", False), ("", False)])
def test_vin(spark, vin, valid):
    letters = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", (1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))
    if len(vin) == 17 and not set(vin) & set("IOQ"):
        rest = sum((int(c) if c.isdigit() else letters[c]) * w for c, w in zip(vin, S.VIN_WEIGHTS, strict=True)) % 11
        valid = vin[8] == ("X" if rest == 10 else str(rest))
    assert one(spark, S.is_valid_vin(F.col("vin")), vin=vin) is valid


def test_vin_without_lambda_functions(spark):
    """Spark interprets lambda functions, at 0.4 ms a VIN; null is no VIN."""
    df = spark.createDataFrame([("1HGCM82633A004352",), ("11111111111111111",), (None,)], "vin string")
    found = df.select(S.is_valid_vin(F.col("vin")).alias("valid"), S.vin_check_digit(F.col("vin")).alias("digit"))
    assert [tuple(r) for r in found.collect()] == [(True, "3"), (True, "1"), (False, None)]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_and_ids_match_python(spark):
    for text in ("42:abc", "", "éß", "x" * 200):
        assert one(spark, S.hash_percent(F.col("t")), t=text) == int(hashlib.sha256(text.encode()).hexdigest(), 16) % 100
        assert one(spark, S.uuid5(uuid.NAMESPACE_DNS, F.col("t")), t=text) == str(uuid.uuid5(uuid.NAMESPACE_DNS, text))


def test_single_precision_times_and_cursor(spark):
    assert one(spark, S.f32(F.col("x")), x=92.3) == 92.30000305175781
    assert one(spark, S.parse_ts_ms(F.col("t")), t="2024-01-01T00:00:01.5Z") == 1_704_067_201_500
    assert one(spark, S.parse_ts_ms(F.col("t")), t="1704067201500") == 1_704_067_201_500
    assert one(spark, S.parse_ts_ms(F.col("t")), t="soon") is None
    key = {"a": 1.5, "b": "x"}
    assert S.decode_cursor(S.encode_cursor(key), ["a", "b"]) == key
    for bad in ("?", "e30=", S.encode_cursor({"a": 1})):
        with pytest.raises(ValueError):
            S.decode_cursor(bad, ["a", "b"])


def test_std_never_negative(spark):
    df = spark.createDataFrame([(10.0, 100.0 - 1e-12, 1), (0.0, 0.0, 0)], "s double, q double, n long")
    assert [r[0] for r in df.select(S.std_from_sums(F.col("s"), F.col("q"), F.col("n"))).collect()] == [0.0, None]


def test_statistics_count_and_names(spark):
    assert len(all_stats()) == 70
    assert [len(feature_names(c)) for c in COMPONENTS] == [44, 74, 77]
    with pytest.raises(ValueError):
        features("WHEEL")


def test_merge_does_not_depend_on_grouping(spark):
    rnd = random.Random(1)
    maybe = lambda x: None if rnd.random() < 0.3 else x
    data = [record(rnd.randrange(10_000), i, speed_kmh=maybe(rnd.uniform(0, 120)), odometer_km=maybe(rnd.uniform(0, 9)), acceleration_ms2=maybe(rnd.uniform(-5, 5)), harsh_brake=maybe(rnd.random() < 0.2), soc_pct=maybe(rnd.uniform(0, 100)), current_a=maybe(rnd.uniform(-200, 50)), dtc_codes=maybe(["P0301", "X"])) for i in range(200)]
    df, stats = spark.createDataFrame(data, RECORD), all_stats()
    whole = df.agg(*[s.aggregate() for s in stats.values()]).first()
    parts = df.groupBy(F.col("seq") % 7).agg(*[s.aggregate() for s in stats.values()])
    again = parts.agg(*[merge(s.op, F.col(n)).alias(n) for n, s in stats.items()]).first()
    for n in stats:
        assert whole[n] == pytest.approx(again[n]) if isinstance(whole[n], float) else whole[n] == again[n], n


def window(spark, component, vehicle_type="ICE", feature_ts=10 * 86_400_000, **values):
    """Features of a one-hour window given as merged statistics."""
    stats = all_stats()
    def value(w, n):
        if w == "1h" and n in values:
            v = values[n]
            return F.struct(F.lit(v[0]).alias("ts"), F.lit(v[1]).alias("seq"), F.lit(float(v[2])).alias("value")) if isinstance(v, tuple) else F.lit(v)
        if w == "24h" and n == "odo_max" and "day_odo" in values:
            return F.lit(values["day_odo"])
        kind = stats[n].op.zero
        if kind is not None:
            return kind
        empty = "struct<ts:bigint,seq:bigint,value:double>" if stats[n].op.ends else "double"
        return F.lit(None).cast(empty)
    row = spark.range(1).select(*[value(w, n).alias(f"{w}_{n}") for w in ("5m", "1h", "24h") for n in stats])
    context = {"vehicle_type": F.lit(vehicle_type), "feature_ts_ms": F.lit(feature_ts), "manufacture_date_ms": F.lit(0).cast("long"), "last_service_ts_ms": F.lit(values.get("service")).cast("long"), "last_service_odometer_km": F.lit(values.get("service_odo")).cast("double")}
    return row.withColumns(context).select(*[c.alias(n) for n, c in features(component).items()]).first()


def test_formulas(spark):
    b = window(spark, "BRAKE", n_moving=2, speed_sum=100.0, speed_sumsq=5200.0, odo_min=1000.0, odo_max=1012.5, harsh_accel_n=1, harsh_accel_sum=-3.0, brake_n=2, brake_accel_sum=-5.0)
    assert (b["w1h_avg_speed_moving"], b["w1h_speed_std_moving"], b["w1h_distance_km"], b["w1h_mean_harsh_decel"], b["w1h_mean_braking_decel"]) == (50.0, 10.0, 12.5, 3.0, 2.5)
    assert (b["w5m_events"], b["w5m_avg_speed_moving"], b["vt_ice"], b["vt_ev"]) == (0.0, None, 1.0, 0.0)
    temps = {"engine_temp_n": 2, "engine_temp_sum": 200.0, "engine_temp_sumsq": 90.0**2 + 110.0**2, "engine_temp_max": 110.0, "motor_temp_n": 2, "motor_temp_sum": 150.0, "motor_temp_sumsq": 70.0**2 + 80.0**2, "power_n": 2, "power_sum": 90.0}
    p = window(spark, "POWERTRAIN", "HYBRID", **temps)
    assert (p["w1h_engine_temp_mean"], p["w1h_engine_temp_std"], p["w1h_engine_temp_max"], p["w1h_motor_temp_mean"], p["w1h_motor_temp_std"]) == (100.0, 10.0, 110.0, 75.0, 5.0)
    assert window(spark, "POWERTRAIN", "EV", **temps)["w1h_engine_temp_mean"] is None
    ice = window(spark, "POWERTRAIN", "ICE", **temps)
    assert (ice["w1h_motor_temp_mean"], ice["w1h_power_mean"], p["w1h_power_mean"]) == (None, None, 45.0)
    s = window(spark, "BATTERY", soc_first=(1, 1, 60), soc_last=(9, 9, 40), day_odo=1500.0, service=7 * 86_400_000, service_odo=1000.0)
    assert (s["w1h_soc_delta"], s["days_since_service"], s["distance_since_service_km"], s["has_service_history"], s["w1h_charging_events"]) == (-20.0, 3.0, 500.0, 1.0, None)
    assert (s["odometer_km"], s["vehicle_age_days"]) == (1500.0, 10.0)


def test_configuration_checks():
    with pytest.raises(ValueError):
        FeatureConfig(windows={"7m": Window(420, 60 * 11)})
    with pytest.raises(ValueError):
        DatasetConfig(splits={"a": (1, 5), "b": (5, 9)})
    assert FeatureConfig().lateness_seconds == 90_000
    assert FeatureConfig().retention_seconds(60) == 7200
