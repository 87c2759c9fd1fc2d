import pytest
from pyspark.sql import functions as F

from tarmac.config import DAY_MS
from tarmac.operators import ml
from tarmac.operators.checks import forbidden_columns
from tarmac.sources.simulate import fleet


def rows(spark, n=1200):
    df = spark.range(n).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).withColumn("noise", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0)
    hit = F.col("x") + 0.3 * F.col("noise") > 0.9
    split = F.element_at(F.array(*[F.lit(s) for s in ("train", "train", "calibration", "threshold", "test")]), (F.col("id") % 5 + 1).cast("int"))
    return df.select("id", F.when(hit, 1).otherwise(0).alias("label_7d"), split.alias("meta_split"), F.when(F.col("id") % 11 != 0, F.col("x")).alias("f_x"), F.col("noise").alias("f_noise"), F.lit(1.0).alias("f_constant"))


def test_train_calibrate_and_score(spark):
    data = rows(spark).cache()
    model = ml.train(data)
    assert set(model.names) == {"f_x", "f_noise"} and 0 < model.threshold < 1
    scored = model.score(data.where("meta_split = 'test'")).cache()
    gap = scored.agg(F.abs(F.avg("p7d") - F.avg(F.col("label_7d").cast("double")))).first()[0]
    assert gap < 0.12
    rated = ml.average_precision(scored.select(F.col("label_7d").alias("y"), F.col("p7d").alias("p"))).first()[0]
    assert rated > 0.7


def test_platt_calibrates(spark):
    s = spark.range(4000).select(F.when(F.pmod(F.xxhash64("id"), F.lit(100)) < 20, 1).otherwise(0).alias("label_7d"), (0.5 + F.pmod(F.xxhash64("id"), F.lit(100)) / -400.0).alias("p"))
    slope, offset = ml.platt(s)
    from tarmac.functions.scalars import logit, sigmoid

    got = s.select(F.avg(sigmoid(F.lit(slope) * logit(F.col("p")) + F.lit(offset))), F.avg(F.col("label_7d").cast("double"))).first()
    assert got[0] == pytest.approx(got[1], abs=0.03)


def test_fleet_is_repeatable_and_hides_its_state(spark):
    a, truth = fleet(spark, 3, 4)
    b, _ = fleet(spark, 3, 4)
    assert a.exceptAll(b).isEmpty() and a.count() == 3 * 4 * 288
    assert forbidden_columns(a) == [] and forbidden_columns(truth) == ["wear"]
    assert a.where("vehicle_type = 'ICE' and motor_temp_c is not null and not isnan(motor_temp_c)").isEmpty()
    assert a.agg(F.max("ts_ms") - F.min("ts_ms")).first()[0] < 4 * DAY_MS
