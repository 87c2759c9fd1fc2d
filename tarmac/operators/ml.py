"""Models of seven-day risk: imputation with indicators, two classifiers, calibration, selection and scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.scalars import logit, sigmoid
from tarmac.operators.labels import usable_features
from tarmac.operators.metrics import average_precision, best_f1
from tarmac.operators.windows import latest_per_key

LABEL = "label_7d"


def with_indicators(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds <feature>_missing; the imputer fills the features themselves."""
    return df.withColumns({f"{n}_missing": F.col(n).isNull().cast("double") for n in names})


def with_weights(df: DataFrame) -> DataFrame:
    """Balanced weights: each class weighs as much as the other."""
    found = {r[LABEL]: r["count"] for r in df.groupBy(LABEL).count().collect()}
    n = sum(found.values())
    weight = F.lit(1.0)
    for label, count in found.items():
        weight = F.when(F.col(LABEL) == label, n / (2.0 * count)).otherwise(weight)
    return df.withColumn("weight", weight)


def logistic_pipeline(names: list[str], rows: int) -> Pipeline:
    filled = [f"{n}_filled" for n in names]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled + [f"{n}_missing" for n in names], outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=LABEL, weightCol="weight", regParam=1.0 / (0.5 * max(rows, 1)), maxIter=100),
    ])


def boosted_pipeline(names: list[str]) -> Pipeline:
    """Boosted trees of limited depth that stop early, by the rows marked ``held``; missing values are filled and flagged, as
    these trees need values."""
    filled = [f"{n}_filled" for n in names]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled + [f"{n}_missing" for n in names], outputCol="features", handleInvalid="keep"),
        GBTClassifier(labelCol=LABEL, weightCol="weight", maxIter=100, maxDepth=5, stepSize=0.06, minInstancesPerNode=50, seed=42, validationIndicatorCol="held", validationTol=0.001),
    ])


def probability(df: DataFrame) -> Column:
    return vector_to_array("probability")[1]


@dataclass
class RiskModel:
    """A fitted pipeline, its Platt calibration (slope and offset on the logit) and its threshold."""

    kind: str
    names: list[str]
    pipeline: PipelineModel
    slope: float
    offset: float
    threshold: float = 0.5

    def score(self, df: DataFrame) -> DataFrame:
        """Adds p7d, the calibrated probability."""
        raw = self.pipeline.transform(with_indicators(df, self.names)).withColumn("__p", probability(df))
        return raw.withColumn("p7d", sigmoid(F.lit(self.slope) * logit(F.col("__p")) + F.lit(self.offset))).select(*df.columns, "p7d")


def platt(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset that calibrate column p against the label, by a one-feature logistic regression."""
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(scored.select(LABEL, logit(F.col("p")).alias("x")))
    model = LogisticRegression(labelCol=LABEL, regParam=0.0, maxIter=100).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


def train(rows: DataFrame) -> RiskModel:
    """Fit both classifiers on the training split, calibrate each, keep the better by average precision on the threshold
    split, and choose its threshold there by the largest F1."""
    part = {s: rows.where(F.col("meta_split") == s) for s in ("train", "calibration", "threshold")}
    names = usable_features(part["train"])
    # A tenth of the rows, by a hash, tells the boosted trees when to stop; the logistic model uses all.
    held_back = F.pmod(F.xxhash64(*part["train"].columns), F.lit(10)) == 0
    data = with_weights(with_indicators(part["train"], names)).withColumn("held", held_back).cache()
    best: tuple[float, RiskModel] | None = None
    for kind, pipeline in (("logistic", logistic_pipeline(names, data.count())), ("boosted", boosted_pipeline(names))):
        fitted = pipeline.fit(data)
        raw = fitted.transform(with_indicators(part["calibration"], names)).withColumn("p", probability(data)).select(LABEL, "p")
        model = RiskModel(kind, names, fitted, *platt(raw))
        held = model.score(part["threshold"]).select(F.col(LABEL).alias("y"), F.col("p7d").alias("p")).cache()
        rated = average_precision(held).first()[0] or 0.0
        model.threshold = float(best_f1(held).first()["threshold"])
        if best is None or rated > best[0]:
            best = rated, model
    data.unpersist()
    return best[1]


def permutation_importance(model: RiskModel, rows: DataFrame, top: int = 8, seed: int = 42, sample: int = 20_000) -> list[tuple[str, float]]:
    """The features whose shuffled values cost most average precision over about ``sample`` of ``rows``, which a hash chooses.

    The sample is kept, so that features are computed once however many models are rated on them.

    Values are exchanged within groups of a few thousand rows (a hash deals them out), so that no task orders all rows; a
    row gets the value of its follower in a fixed random order, the last one that of the first.
    """
    from pyspark.sql import Window

    def rated(df: DataFrame) -> float:
        return average_precision(model.score(df).select(F.col(LABEL).alias("y"), F.col("p7d").alias("p"))).first()[0] or 0.0

    mark, n = F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]), rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed + 2), mark), F.lit(n)) < sample)
    rows = rows.persist()
    base, out = rated(rows), []
    groups = max(1, min(n, sample) // 5000)
    dealt = rows.withColumns({"__group": F.pmod(mark, F.lit(groups)), "__order": F.xxhash64(F.lit(seed + 1), mark)})
    for n in model.names:
        window = Window.partitionBy("__group").orderBy("__order")
        first = F.first(F.struct(n)).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        mixed = dealt.withColumn(n, F.coalesce(F.lead(F.struct(n)).over(window), first)[n]).select(*rows.columns)
        out.append((n, base - rated(mixed)))
    rows.unpersist()
    return sorted(out, key=lambda x: (-x[1], x[0]))[:top]


def report(evaluated: dict, versions: dict | None = None, top: int = 5) -> dict:
    """The served part of a training report. ``evaluated``: by component, the selected kind, the test metrics of both kinds,
    the holdout's metrics, the features used, the rows and the features by importance."""
    names = {"logistic": "Logistic regression", "boosted": "Gradient boosting"}
    shown = ("pr_auc", "roc_auc", "brier", "precision", "recall", "precision_at_top_1%")
    out = []
    for component, c in sorted(evaluated.items()):
        test = c["test"][c["selected"]]
        out.append({
            "component": component, "served_model": names[c["selected"]], "prevalence": test.get("prevalence"), "served": {k: test.get(k) for k in shown},
            **{f"pr_auc_{k}": m.get("pr_auc") for k, m in c["test"].items()}, "holdout_pr_auc": c.get("holdout", {}).get("pr_auc"),
            "features_used": c.get("features_used"), "rows": c.get("rows"), "top_features": c.get("top_features", [])[:top],
        })
    return {**(versions or {}), "components": out}


def score_latest(model: RiskModel, features: DataFrame, components: DataFrame) -> DataFrame:
    """Risk rows of the latest snapshot of every ACTIVE component."""
    latest = latest_per_key(features, ["vehicle_id", "component"], ["feature_ts_ms"])
    active = components.where("status = 'ACTIVE'").select("vehicle_id", "component", "vehicle_component_id")
    scored = model.score(latest.join(active, ["vehicle_id", "component"]))
    return scored.select("vehicle_component_id", "component", F.lit(model.kind).alias("model_kind"), "feature_ts_ms", "p7d", F.lit(model.threshold).alias("threshold"))
