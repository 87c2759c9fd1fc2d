"""From raw envelopes to canonical events: identity, adapters, validation, flattening, deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.scalars import is_valid_vin, iso_millis, parse_ts_ms, py_round, vin_of_payload

EVENT_TYPES = ["TELEMETRY", "DTC", "MAINTENANCE_REQUIRED", "FAILURE", "SERVICE_COMPLETED"]
# The canonical event's fields and types.
CANONICAL = {
    "event_id": "string", "vehicle_id": "string", "vin": "string", "oem_id": "string", "schema_version": "string", "event_ts": "string", "ingested_at": "string", "seq": "long",
    "event_type": "string", "vehicle_type": "string", "location": "struct<lat:double,lon:double>", "speed_kmh": "double", "odometer_km": "double", "acceleration_ms2": "double",
    "battery": "struct<soc_pct:double,voltage_v:double,current_a:double,temperature_c:double,charging:boolean>",
    "powertrain": "struct<rpm:double,engine_temp_c:double,motor_temp_c:double,power_kw:double,engine_load_pct:double>",
    "brakes": "struct<harsh_brake:boolean>", "dtc_codes": "array<string>", "trip_id": "string",
}
OEM_A = "vin string, ts string, lat double, lng double, vehicleSpeed double, mileageKm double, batteryLevel double, batteryVoltage double, batteryCurrent double, batteryTemp double, engineRpm double, motorTemperature double, faultCodes array<string>, longitudinalAccel double, event string, sequence long, engineTemp double, engineLoadPct double, powerKw double, charging boolean, tripRef string"
OEM_B = "vehicle struct<vin:string>, timestamp_epoch_ms long, sequence_no long, position struct<latitude:double,longitude:double>, motion struct<speed_mph:double,odometer_miles:double,accel_g:double>, energy struct<soc_percent:double,pack_voltage:double,pack_current:double,pack_temp_f:double,charging:boolean>, engine struct<rpm:double,coolant_temp_f:double,load_percent:double>, motor struct<temp_f:double,power_kw:double>, diagnostics struct<dtcs:array<string>>, events array<string>, trip_id string"
# Units.
MILE_KM, G_MS2 = 1.609344, 9.80665


def once(x: Column) -> Column:
    """A dear value as a generated column of one row each: conditions on it stay above, where plain columns would be put into them again and again."""
    return F.explode(F.array(x))


def resolve(envelopes: DataFrame, vehicles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved envelopes, dead letters).

    ``envelopes``: received_at, oem_id, schema_version, payload (JSON text). ``vehicles``: vin, vehicle_id, vehicle_type;
    Spark broadcasts it where it is small. Dead letters carry MISSING_VIN, INVALID_VIN or UNKNOWN_VIN.
    """
    named = envelopes.withColumn("vin", once(vin_of_payload(F.col("payload"))))
    found = named.join(vehicles.select("vin", "vehicle_id", "vehicle_type"), "vin", "left")
    reason = F.when(F.col("vin").isNull() | (F.col("vin") == ""), "MISSING_VIN").when(~is_valid_vin(F.col("vin")), "INVALID_VIN").when(F.col("vehicle_id").isNull(), "UNKNOWN_VIN")
    tagged = found.withColumn("reason", reason)
    envelope = F.to_json(F.struct(*[c for c in envelopes.columns]))
    dead = tagged.where("reason is not null").select("reason", F.lit("oem.inbound").alias("source_topic"), envelope.alias("envelope"), F.current_timestamp().alias("failed_at"))
    return tagged.where("reason is null").drop("reason"), dead


def fahrenheit(x: Column) -> Column:
    return py_round((x - 32) * 5 / 9, 2)


def adapt_oem_a(df: DataFrame) -> DataFrame:
    """Flat metric payloads."""
    p = lambda c: F.col(f"p.{c}")
    parsed = df.withColumn("p", once(F.from_json("payload", OEM_A))).where("p is not null")
    power = F.coalesce(p("powerKw"), py_round(p("batteryVoltage") * p("batteryCurrent") / 1000, 2))
    charging = F.coalesce(p("charging"), F.when(F.col("vehicle_type") == "ICE", F.lit(None).cast("boolean")).otherwise(F.lit(False)))
    return parsed.select(
        *_head(df), iso_millis(parse_ts_ms(p("ts"))).alias("event_ts"), p("sequence").alias("seq"),
        F.when(p("event") == "DTC", "DTC").otherwise("TELEMETRY").alias("event_type"), F.struct(p("lat").alias("lat"), p("lng").alias("lon")).alias("location"),
        p("vehicleSpeed").alias("speed_kmh"), p("mileageKm").alias("odometer_km"), F.coalesce(p("longitudinalAccel"), F.lit(0.0)).alias("acceleration_ms2"),
        F.struct(p("batteryLevel").alias("soc_pct"), p("batteryVoltage").alias("voltage_v"), p("batteryCurrent").alias("current_a"), p("batteryTemp").alias("temperature_c"), charging.alias("charging")).alias("battery"),
        F.struct(p("engineRpm").alias("rpm"), p("engineTemp").alias("engine_temp_c"), p("motorTemperature").alias("motor_temp_c"), power.alias("power_kw"), p("engineLoadPct").alias("engine_load_pct")).alias("powertrain"),
        F.struct((F.coalesce(p("event"), F.lit("")) == "HARSH_BRAKE").alias("harsh_brake")).alias("brakes"),
        F.coalesce(p("faultCodes"), F.array().cast("array<string>")).alias("dtc_codes"), p("tripRef").alias("trip_id"),
    )


def adapt_oem_b(df: DataFrame) -> DataFrame:
    """Nested payloads in US units."""
    p = lambda c: F.col(f"p.{c}")
    parsed = df.withColumn("p", once(F.from_json("payload", OEM_B))).where("p is not null")
    has = lambda e: F.coalesce(F.array_contains(p("events"), e), F.lit(False))
    return parsed.select(
        *_head(df), iso_millis(p("timestamp_epoch_ms")).alias("event_ts"), p("sequence_no").alias("seq"),
        F.when(has("DTC_RAISED"), "DTC").otherwise("TELEMETRY").alias("event_type"), F.struct(p("position.latitude").alias("lat"), p("position.longitude").alias("lon")).alias("location"),
        py_round(p("motion.speed_mph") * MILE_KM, 2).alias("speed_kmh"), py_round(p("motion.odometer_miles") * MILE_KM, 3).alias("odometer_km"), py_round(p("motion.accel_g") * G_MS2, 2).alias("acceleration_ms2"),
        F.struct(p("energy.soc_percent").alias("soc_pct"), p("energy.pack_voltage").alias("voltage_v"), p("energy.pack_current").alias("current_a"), fahrenheit(p("energy.pack_temp_f")).alias("temperature_c"), p("energy.charging").alias("charging")).alias("battery"),
        F.struct(p("engine.rpm").alias("rpm"), fahrenheit(p("engine.coolant_temp_f")).alias("engine_temp_c"), fahrenheit(p("motor.temp_f")).alias("motor_temp_c"), p("motor.power_kw").alias("power_kw"), p("engine.load_percent").alias("engine_load_pct")).alias("powertrain"),
        F.struct(has("HARSH_BRAKING").alias("harsh_brake")).alias("brakes"), F.coalesce(p("diagnostics.dtcs"), F.array().cast("array<string>")).alias("dtc_codes"), p("trip_id").alias("trip_id"),
    )


def _head(df: DataFrame) -> list[Column]:
    return [F.uuid().alias("event_id"), F.col("vehicle_id"), F.col("vin"), F.col("oem_id"), F.col("schema_version"), F.col("received_at").cast("string").alias("ingested_at"), F.col("vehicle_type")]


#: The adapters by manufacturer and schema version: what a new manufacturer is added to.
ADAPTERS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {("OEM_A", "1.0"): adapt_oem_a, ("OEM_B", "2.0"): adapt_oem_b}


def normalise(resolved: DataFrame, adapters: dict | None = None) -> DataFrame:
    """Canonical events of all known manufacturers; others, and rows without vehicle, manufacturer or version, are dropped."""
    out = None
    for (oem, version), adapt in (adapters or ADAPTERS).items():
        part = adapt(resolved.where(F.col("vehicle_id").isNotNull() & (F.col("oem_id") == oem) & (F.col("schema_version") == version)))
        part = part.select(*[F.col(n).cast(kind).alias(n) for n, kind in CANONICAL.items()])
        out = part if out is None else out.unionByName(part)
    return out


def violations(df: DataFrame) -> DataFrame:
    """Adds ``violations``: the names of the canonical rules that a row breaks (empty for valid rows)."""
    c = F.col
    between = lambda x, a, b: c(x).between(a, b)
    required = [n for n in CANONICAL if n != "trip_id"]
    rules: list[tuple[str, Column]] = [(f"required:{n}", c(n).isNotNull()) for n in required]
    rules += [
        ("vin:length", F.length("vin") == 17), ("seq:minimum", c("seq") >= 0), ("event_type:enum", c("event_type").isin(EVENT_TYPES)), ("vehicle_type:enum", c("vehicle_type").isin("ICE", "EV", "HYBRID")),
        ("lat:range", between("location.lat", -90, 90)), ("lon:range", between("location.lon", -180, 180)), ("speed_kmh:minimum", c("speed_kmh") >= 0), ("odometer_km:minimum", c("odometer_km") >= 0),
        ("soc_pct:range", c("battery.soc_pct").isNull() | between("battery.soc_pct", 0, 100)), ("rpm:minimum", c("powertrain.rpm").isNull() | (c("powertrain.rpm") >= 0)),
        ("engine_load_pct:range", c("powertrain.engine_load_pct").isNull() | between("powertrain.engine_load_pct", 0, 100)),
    ]
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def flatten(canonical: DataFrame) -> DataFrame:
    """The telemetry record of a canonical event; charging, trip, VIN and schema version have no column there."""
    c = F.col
    return canonical.select(
        "event_id", "vehicle_id", "oem_id", "vehicle_type", parse_ts_ms(c("event_ts")).alias("ts_ms"), "seq", c("location.lat").alias("latitude"), c("location.lon").alias("longitude"),
        "speed_kmh", "odometer_km", "acceleration_ms2", c("battery.soc_pct").alias("soc_pct"), c("battery.voltage_v").alias("voltage_v"), c("battery.current_a").alias("current_a"),
        c("battery.temperature_c").alias("temperature_c"), c("powertrain.motor_temp_c").alias("motor_temp_c"), c("powertrain.engine_temp_c").alias("engine_temp_c"), c("powertrain.power_kw").alias("power_kw"),
        c("powertrain.engine_load_pct").alias("engine_load_pct"), c("powertrain.rpm").alias("rpm"), c("brakes.harsh_brake").alias("harsh_brake"), "dtc_codes", "event_type", "ingested_at",
    )


def first_delivery(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row of each identity (vehicle_id, seq): the earliest delivery. A grouped minimum, with partial ones before the shuffle."""
    keys, order = keys or ["vehicle_id", "seq"], order or ["ts_ms"]
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("top"))
    return top.select(*keys, *[F.col(f"top.{c}").alias(c) for c in rest])
