"""Boosted-tree learners; independent fits share the binned rows and grow at the same time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from kerbside.plans.boosting import grow

# Fits that grow at the same time. A level of all their trees is one job, so more of them mean fewer jobs and wider blocks.
AT_ONCE = 6


@dataclass(frozen=True)
class BoostSettings:
    """Rounds, learning rate and tree size. Depth 5 stands for 31 leaves; the smallest
    leaf has 20 rows."""

    rounds: int = 300
    learning_rate: float = 0.05
    depth: int = 5
    min_leaf_rows: int = 20
    bins: int = 64
    seed: int = 42


GBT = BoostSettings(rounds=300)
HIST_GBT = BoostSettings(rounds=200)
# Regularisation of the second learner: share of the features per split, least gain of a split.
HALF, LEAST_GAIN = "0.5", 0.01


@dataclass(frozen=True)
class Fit:
    """One model to train."""

    features: Sequence[str]
    target: str = "target_k_1h"
    settings: BoostSettings = GBT
    prediction: str = "predicted_k"
    per_split: str = "all"
    least_gain: float = 0.0


def gbt_fit(
    features: Sequence[str], target: str = "target_k_1h", settings: BoostSettings = GBT, prediction: str = "predicted_k",
) -> Fit:
    return Fit(tuple(features), target, settings, prediction)


def hist_gbt_fit(
    features: Sequence[str], target: str = "target_k_1h", settings: BoostSettings = HIST_GBT, prediction: str = "predicted_k",
) -> Fit:
    """The second, regularised learner. In place of a penalty on leaf values each split
    sees half of the features and must lower the variance by LEAST_GAIN."""
    return Fit(tuple(features), target, settings, prediction, HALF, LEAST_GAIN)


def fit_all(train: DataFrame, fits: Sequence[Fit], at_once: int = AT_ONCE) -> list[PipelineModel]:
    """The models of all fits, each on the rows that have its target; missing features are allowed.

    So many fits grow together: they share one scan and the blocks of binned rows, and a level of all their trees is one job.
    They don't see each other, so the models are those of one fit after the other.
    """
    return [PipelineModel([model]) for i in range(0, len(fits), at_once) for model in grow(train, fits[i:i + at_once])]


def train_gbt(
    train: DataFrame, features: Sequence[str], target: str = "target_k_1h",
    settings: BoostSettings = GBT, prediction: str = "predicted_k",
) -> PipelineModel:
    return fit_all(train, [gbt_fit(features, target, settings, prediction)])[0]


def train_hist_gbt(
    train: DataFrame, features: Sequence[str], target: str = "target_k_1h",
    settings: BoostSettings = HIST_GBT, prediction: str = "predicted_k",
) -> PipelineModel:
    return fit_all(train, [hist_gbt_fit(features, target, settings, prediction)])[0]


def score(model: PipelineModel, df: DataFrame, prediction: str = "predicted_k") -> DataFrame:
    """The input columns with the prediction."""
    return model.transform(df).select(*df.columns, prediction)
