"""Fitted preprocessing (T1–T11) as a Spark ML ``PipelineModel``.

Fitting computes exact scalars with distributed aggregates (medians, means, population stds,
modes, category frequencies); the fitted model is a persistable pipeline of stock stages:
``SQLTransformer`` (impute + scale with literal constants) → ``StringIndexer`` (alphabetical,
unknown kept) → ``OneHotEncoder`` (dropLast: the unknown slot is the dropped one, so an unknown
category encodes as zeros) → ``VectorAssembler`` → optional ``ElementwiseProduct`` (one-hot
columns divided by their population std, no centring). Vectors stay sparse. Modes, slots and frequencies
come from a dictionary table (``categories``); a dictionary too large for constants is joined instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.expressions import safe_double
from ..session import cut_lineage
from . import categories as D
from .comoments import comoments
from .prefix import exact_quantiles
from .profile import long_values, value_counts


def _q(name: str) -> str:
    return f"`{name}`"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v)) + "D"


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of the coerced numbers, all columns in one distributed job."""
    if not cols:
        return {}
    lv = long_values(df, cols).select("column", F.col("nval").alias("v")).filter(F.col("v").isNotNull())
    got = {r["column"]: r["median"] for r in
           exact_quantiles(lv, "v", [0.5], by=["column"], names=["median"]).collect()}
    return {c: got.get(c) for c in cols}


def fit_modes(df: DataFrame, cols: Sequence[str], counts: DataFrame | None = None) -> dict[str, str | None]:
    """Most frequent value, ties → smallest, from value counts (one row a column reaches the driver)."""
    if not cols:
        return {}
    got = {r["column"]: r["mode"] for r in D.modes(value_counts(df, cols) if counts is None else counts).collect()}
    return {c: got.get(c) for c in cols}


def fit_preprocessor(train: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str],
                     scale_onehot: bool = True, output_col: str = "features", dictionary_folder: str | None = None) -> PipelineModel:
    """Fit on ``train`` only; the returned model transforms train, test and live data. With more than
    ``categories.COMPILED`` categories, the dictionary is written to ``dictionary_folder`` (a fresh one in the
    shared folder by default), which the model then needs; ``ChurnModel.save`` copies it."""
    num_cols, cat_cols = list(num_cols), list(cat_cols)
    meds = fit_medians(train, num_cols)
    counts = cut_lineage(value_counts(train, cat_cols)) if cat_cols else None
    modes = fit_modes(train, cat_cols, counts)
    filled_num = {c: F.coalesce(safe_double(c, train.schema[c].dataType), F.lit(meds[c]).cast("double"))
                  for c in num_cols}
    # Population mean / std of the imputed numbers, one aggregate.
    mom = train.select(*[v.alias(c) for c, v in filled_num.items()]).agg(
        *[F.avg(c).alias(f"m_{c}") for c in num_cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in num_cols]
    ).first() if num_cols else None
    exprs = []
    spec = {"num": [], "cat": [], "scale_onehot": bool(scale_onehot and cat_cols)}
    for c in num_cols:
        mean = mom[f"m_{c}"] if mom[f"m_{c}"] is not None else 0.0
        std = mom[f"s_{c}"]
        std = 1.0 if (std is None or std == 0 or math.isnan(std)) else std
        med = meds[c]
        is_num = isinstance(train.schema[c].dataType, NumericType)
        raw = f"CAST({_q(c)} AS DOUBLE)" if is_num else f"try_cast({_q(c)} AS DOUBLE)"
        exprs.append(f"(coalesce(CASE WHEN isnan({raw}) THEN NULL ELSE {raw} END, {_lit(med)}) - {_lit(mean)}) "
                     f"/ {_lit(std)} AS {_q('__num_' + c)}")
        spec["num"].append([c, is_num, med, mean, std])
    for c in cat_cols:
        exprs.append(f"coalesce(CAST({_q(c)} AS STRING), {_lit(modes[c])}) AS {_q('__cat_' + c)}")
    prepared = SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__")
    cat_in = [f"__cat_{c}" for c in cat_cols]
    idx = [f"__idx_{c}" for c in cat_cols]
    ohe = [f"__ohe_{c}" for c in cat_cols]
    numbers = [f"__num_{c}" for c in num_cols]
    if not cat_cols:
        model = PipelineModel(stages=[prepared, VectorAssembler(inputCols=numbers, outputCol=output_col)])
        model._retainlens_spec = spec
        return model
    dictionary = cut_lineage(D.fit_dictionary(train, cat_cols, counts))
    widths = D.sizes(dictionary, cat_cols)
    if sum(widths) > D.COMPILED:
        return PipelineModel(stages=[prepared, D.DictionaryEncoder(
            numeric=numbers, categories=cat_in, columns=cat_cols, widths=widths, scaled=scale_onehot,
            table=D.written(dictionary, dictionary_folder), output=output_col)])
    words = {c: {} for c in cat_cols}
    for r in dictionary.select("column", "category", "scale").collect():  # at most COMPILED rows
        words[r["column"]][r["category"]] = r["scale"] if scale_onehot else 1.0
    # The indexer is fitted on the categories, not on the rows.
    known = train.sparkSession.createDataFrame(list(zip_longest(*words.values())), ", ".join(f"{_q(c)} string" for c in cat_in))
    indexer = StringIndexer(inputCols=cat_in, outputCols=idx, stringOrderType="alphabetAsc", handleInvalid="keep").fit(known)
    for c, labels in zip(cat_cols, indexer.labelsArray):
        spec["cat"].append([c, modes[c], list(labels), [words[c][w] for w in labels]])
    # The number of categories comes with the columns' attributes: no pass over the rows.
    encoder = OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True).fit(indexer.transform(prepared.transform(train)))
    stages = [prepared, indexer, encoder, VectorAssembler(inputCols=numbers + ohe, outputCol="__raw_features" if scale_onehot else output_col)]
    if scale_onehot:
        # T5: one-hot columns divided by their population std sqrt(p(1-p)) (0 → 1).
        scale = [1.0] * len(num_cols) + [x for e in spec["cat"] for x in e[3]]
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="__raw_features", outputCol=output_col))
    model = PipelineModel(stages=stages)
    model._retainlens_spec = spec
    return model


def feature_names(model: PipelineModel, num_cols: Sequence[str], cat_cols: Sequence[str]) -> list[str]:
    """Names of the assembled vector slots (numeric block ++ one-hot block, categories sorted)."""
    if any(isinstance(s, D.DictionaryEncoder) for s in model.stages):
        raise ValueError("the slots of this model are named by its dictionary table")
    names = list(num_cols)
    indexers = [s for s in model.stages if hasattr(s, "labelsArray")]
    if indexers and cat_cols:
        for c, labels in zip(cat_cols, indexers[0].labelsArray):
            names += [f"{c}_{lab}" for lab in labels]
    return names


def transform(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Apply a fitted preprocessor; keep only ``keep`` + features."""
    out = model.transform(df)
    return out.select(*keep, "features")


@dataclass(frozen=True)
class PCAFit:
    """Centred PCA: column means, components (one a row, by falling variance; the entry of largest size
    is positive) and each component's share of the variance."""

    means: np.ndarray
    components: np.ndarray
    ratios: list[float]

    def width(self, share: float) -> int:
        """The fewest components that reach ``share`` of the variance (all, if none do)."""
        reached = np.flatnonzero(np.cumsum(self.ratios) >= share)
        return int(reached[0]) + 1 if len(reached) else len(self.ratios)


def pca_fit(features: DataFrame, max_components: int = 50, col: str = "features") -> PCAFit:
    """One pass of co-moments; the d×d covariance is decomposed at the driver."""
    got = comoments(features, vector_to_array(col))
    values, vectors = np.linalg.eigh(np.nan_to_num(got.covariance()))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    k = min(max_components, len(values))
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]) if len(vectors) else np.zeros(0)
    total = values.sum()
    return PCAFit(got.means(), (vectors * sign[:, None])[:k], [float(v / total) if total else 0.0 for v in values[:k]])


def pca_variance(features: DataFrame, max_components: int = 50, col: str = "features"
                 ) -> tuple[list[float], int, int, int]:
    """T9 + T10: explained-variance ratios, k90, k95 and the input width."""
    fit = pca_fit(features, max_components, col)
    return fit.ratios, fit.width(0.90), fit.width(0.95), len(fit.means)


def pca_project(features: DataFrame, k: int, col: str = "features", keep: Sequence[str] = (),
                fit: PCAFit | None = None) -> DataFrame:
    """Project the centred features onto the first k components (of ``fit``, else fitted here): one
    matrix product an Arrow batch."""
    fit = fit or pca_fit(features, max(k, 50), col)
    means, basis = fit.means, fit.components[:k].T

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.vstack(x.to_list()) - means) @ basis), dtype=object)

    return features.select(*keep, array_to_vector(project(vector_to_array(col))).alias("pca"))
