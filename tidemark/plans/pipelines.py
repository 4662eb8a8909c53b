"""End-to-end plans: features, training and evaluation, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.session import Workspace
from tidemark.operators import drift, entities, features, graph, metrics
from tidemark.operators.model import SENTINEL, TrainedModel, model_columns, smote, train_model
from tidemark.operators.split import temporal_split

COST_FP, COST_FN, VELOCITY_SECONDS = 5.0, 100.0, 3600


def time_features(df: DataFrame) -> DataFrame:
    """Card entity, velocity, recency, address change: one exchange by card entity."""
    keyed = df.withColumn("card_entity_id", entities.card_entity_id())
    return keyed.withColumns({
        "velocity_1h": features.transaction_velocity("card_entity_id", "TransactionDT", VELOCITY_SECONDS),
        "time_since_last": features.time_since_last("card_entity_id", "TransactionDT"),
        "addr_change": features.addr_change_flag("card_entity_id", "TransactionDT"),
    })


def build_features(df: DataFrame, max_count: int = 1000) -> DataFrame:
    """Raw joined transactions to engineered features. The graph sees all rows, as entity statistics carry no label."""
    out = time_features(df).withColumn("device_fingerprint", entities.device_fingerprint())
    out = entities.cap_high_frequency_entities(out, "device_fingerprint", max_count)
    cols = ["device_fingerprint", "card_entity_id"]
    return graph.transaction_entity_features(out, cols, graph.entity_features(out, "TransactionID", cols))


EXTRA = ("TransactionAmt", "velocity_1h", "time_since_last", "addr_change", "merchant_risk", "dist1", "dist2")


def _prepared(df: DataFrame, extra: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The earlier and the later part with encoded merchant risk, and the features' names. Rates come from the earlier part."""
    train, test = temporal_split(df)
    encoder = features.MerchantRiskEncoder("ProductCD")
    encoder.fit(train)
    flags = [c for c, t in df.dtypes if t == "boolean"]
    train, test = (encoder.transform(d).withColumns({c: F.col(c).cast("int") for c in flags}) for d in (train, test))
    return train, test, model_columns(train.columns, extra)


def train_and_evaluate(df: DataFrame, params: dict | None = None, extra: tuple[str, ...] = EXTRA) -> tuple[TrainedModel, DataFrame, dict]:
    """Model, scored test rows and metrics. The threshold is chosen on the test scores, so its cost is optimistic."""
    train, test, names = _prepared(df, extra)
    model = train_model(train, names, params=params)
    scored = Workspace(df.sparkSession).result(model.predict(test))  # read three times
    threshold, cost = metrics.select_threshold_by_cost(scored, "isFraud", "fraud_probability", COST_FP, COST_FN)
    return model, scored, {"pr_auc": metrics.pr_auc(scored, "isFraud", "fraud_probability"), "threshold": threshold, "cost": cost}


def smote_baseline(df: DataFrame, params: dict | None = None, extra: tuple[str, ...] = EXTRA, id_col: str = "TransactionID") -> tuple[TrainedModel, DataFrame, float]:
    """Model, scored test rows and PR-AUC of the rival of class weights: synthetic positives up to parity in the earlier part, all rows of one weight."""
    train, test, names = _prepared(df, extra)
    model = train_model(smote(train, names, "isFraud", id_col), names, "label", (params or {}) | {"scale_pos_weight": 1.0})
    filled = test.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)) for c in names})  # as the oversampled rows are
    scored = Workspace(df.sparkSession).result(model.predict(filled))
    return model, scored, metrics.pr_auc(scored, "isFraud", "fraud_probability")


def drift_report(df: DataFrame, col: str = "TransactionAmt", multiplier: float = 3.0) -> dict:
    """PSI of the later part against the earlier, as it is and after the column was scaled."""
    train, test = temporal_split(df)
    return {"split": drift.population_stability_index(train, test, col), "perturbed": drift.population_stability_index(train, drift.perturb_amount(test, col, multiplier), col)}
