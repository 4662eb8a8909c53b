"""Serving: entity lookups with a fallback, a flag for new entities, and the probability."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.model import TrainedModel

#: The statistics of an entity that is not known.
DEFAULT_ENTITY_FEATURE_FALLBACK = {"degree": 0, "component_size": 1, "community_id": -1, "clustering_coeff": 0.0}


@dataclass(frozen=True)
class ScoredTransaction:
    transaction_id: int | None  # None if the record has none
    fraud_probability: float
    is_new_entity: bool


SCORED = T.StructType([T.StructField("transaction_id", T.LongType()), T.StructField("fraud_probability", T.DoubleType()), T.StructField("is_new_entity", T.BooleanType())])


def serving_features(df: DataFrame, features: DataFrame, keys: dict[str, Column], entity_cols: dict[str, str] | None = None) -> DataFrame:
    """For each prefix the statistics of its key as ``<prefix>_<statistic>``. A key that is not found gets the fallback; a
    statistic that is null for a known key stays null. ``is_new_entity``: any key was not found.
    A table's ``last_updated`` is carried like a statistic (null for unknown keys). Works on a stream too."""
    stats = [c for c in features.columns if c not in ("entity_col", "entity_value")]
    out, missed = df, F.lit(False)
    for prefix, key in keys.items():
        named = (entity_cols or {}).get(prefix, prefix)
        side = features.where(F.col("entity_col") == named).select(F.col("entity_value").alias("__key"), F.lit(True).alias("__hit"), *[F.col(s).alias(f"__s_{s}") for s in stats])
        out = out.withColumn("__wanted", key.cast("string")).join(side, F.col("__wanted") == F.col("__key"), "left")
        hit = F.col("__hit").isNotNull()
        out = out.withColumns({f"{prefix}_{s}": F.when(hit, F.col(f"__s_{s}")).otherwise(F.lit(DEFAULT_ENTITY_FEATURE_FALLBACK.get(s))) for s in stats})
        out = out.withColumn(f"__missed_{prefix}", ~hit).drop("__wanted", "__key", "__hit", *[f"__s_{s}" for s in stats])
        missed = missed | F.col(f"__missed_{prefix}")
    return out.withColumn("is_new_entity", missed).drop(*[f"__missed_{p}" for p in keys])


def score_batch(df: DataFrame, model: TrainedModel, features: DataFrame, keys: dict[str, Column], id_col: str = "TransactionID", entity_cols: dict[str, str] | None = None) -> DataFrame:
    """(transaction_id, fraud_probability, is_new_entity). Features that are absent are missing."""
    ready = serving_features(df, features, keys, entity_cols).withColumn("is_new_entity", F.col("is_new_entity").cast("int"))
    absent = [c for c in model.features if c not in ready.columns]
    ready = ready.withColumns({c: F.lit(None).cast("double") for c in absent})
    scored = model.predict(ready)
    return scored.select(F.col(id_col).cast("bigint").alias("transaction_id"), "fraud_probability", F.col("is_new_entity").cast("boolean").alias("is_new_entity"))


def score_transaction(spark: SparkSession, transaction: dict, predict: Callable[[list], float] | TrainedModel, feature_columns: list[str], entity_lookup: Callable, entity_key_builders: dict[str, Callable]) -> ScoredTransaction:
    """One record, as an online service would score it. The lookups' answers (a dict, or None for an unknown key) become the entity table
    of this one record, so what follows are the rules of ``serving_features`` without a plan."""
    answers = {prefix: entity_lookup(build(transaction)) for prefix, build in entity_key_builders.items()}
    unknown = [prefix for prefix, stats in answers.items() if stats is None]
    looked_up = {f"{prefix}_{name}": value for prefix, stats in answers.items() for name, value in (stats or DEFAULT_ENTITY_FEATURE_FALLBACK).items()}
    known = transaction | looked_up | {"is_new_entity": int(bool(unknown))}
    return ScoredTransaction(transaction.get("TransactionID"), float(_chance(spark, predict, feature_columns, known)), bool(unknown))


def _chance(spark: SparkSession, predict: Callable[[list], float] | TrainedModel, feature_columns: list[str], known: dict) -> float:
    """Features that are absent are missing."""
    if not isinstance(predict, TrainedModel):
        return predict(list(map(known.get, feature_columns)))
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in feature_columns])
    one = [None if (v := known.get(c)) is None else float(v) for c in feature_columns]
    return predict.predict(spark.createDataFrame([one], schema)).first()["fraud_probability"]
