"""Scoring (P1–P3) and model persistence.

A ``ChurnModel`` is the fitted scoring pipeline (preprocessor stages + classifier, one Spark ML
``PipelineModel``) plus the two medians fitted on the training data. Scoring is one
``transform`` over a table or a stream — no per-row loop, no row cap.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.expressions import RISK_LABELS, RISK_THRESHOLDS, risk_band
from .categories import DictionaryEncoder
from .cleaning import clean_total_charges, total_charges_expr
from .features import add_features, feature_exprs


@dataclass
class ChurnModel:
    pipeline: PipelineModel
    total_charges_median: float | None
    monthly_median: float | None
    num_cols: list[str] = field(default_factory=list)
    cat_cols: list[str] = field(default_factory=list)
    model_name: str = ""
    model_version: str = "v1"
    spec: dict | None = None  # fitted preprocessing constants (enables the compiled fast path)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Clean + engineer with the *stored* training medians (leak-free)."""
        df = clean_total_charges(df, self.total_charges_median, fit=False)
        return add_features(df, self.monthly_median, fit=False)

    def save(self, path: str) -> None:
        """``PipelineModel`` persistence + a one-row JSON metadata table (+ the category dictionary)."""
        spark = SparkSession.getActiveSession()
        stages = [s.kept_in(spark, f"{path}/dictionary") if isinstance(s, DictionaryEncoder) else s for s in self.pipeline.stages]
        PipelineModel(stages=stages).write().overwrite().save(f"{path}/pipeline")
        meta = spark.createDataFrame([(self.total_charges_median, self.monthly_median, ",".join(self.num_cols),
                                       ",".join(self.cat_cols), self.model_name, self.model_version,
                                       json.dumps(self.spec) if self.spec else None)],
                                     "total_charges_median double, monthly_median double, num_cols string, "
                                     "cat_cols string, model_name string, model_version string, spec string")
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ChurnModel:
        """Load; a missing artifact raises an error naming the path."""
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(f"model artifact not found: {path}")
        pipe = PipelineModel.load(f"{path}/pipeline")
        m = spark.read.json(f"{path}/meta").first()
        spec = json.loads(m["spec"]) if "spec" in m.asDict() and m["spec"] else None
        return cls(pipe, m["total_charges_median"], m["monthly_median"],
                   [c for c in (m["num_cols"] or "").split(",") if c],
                   [c for c in (m["cat_cols"] or "").split(",") if c], m["model_name"], m["model_version"], spec)


class CompiledScorer:
    """Scoring plan pieces built once per (model, input schema): the cleaning / feature Column
    expressions and the JVM-side pipeline. A request batch then costs three ``select`` calls and
    one JVM ``transform`` instead of rebuilding hundreds of expressions and stage wrappers."""

    def __init__(self, model: ChurnModel, schema, id_col: str, keep: Sequence[str], thresholds, labels,
                 digits: int, fast: bool = True):
        names = schema.fieldNames()
        dtypes = {f.name: f.dataType for f in schema.fields}
        if "TotalCharges" in dtypes:
            tc = total_charges_expr(dtypes, model.total_charges_median)
            self.step1 = [tc.alias(c) if c == "TotalCharges" else F.col(c) for c in names]
            dtypes = {**dtypes, "TotalCharges": DoubleType()}
        else:
            self.step1 = [F.col(c) for c in names]
        coerce, new = feature_exprs(dtypes, model.monthly_median)
        self.step2 = [coerce[c].alias(c) if c in coerce else F.col(c) for c in names]
        self.step3 = [F.col(c) for c in names] + [v.alias(k) for k, v in new.items()]
        # Stages in Python (tree ensembles) can't become a JVM pipeline: they transform frames themselves.
        stage = model.pipeline.stages[-1]
        python = any(not hasattr(s, "_to_java") for s in model.pipeline.stages)
        on_jvm = lambda java: lambda frame: DataFrame(java.transform(frame._jdf), frame.sparkSession)
        self.pipeline = model.pipeline.transform if python else on_jvm(model.pipeline._to_java())
        self.fast = None
        if model.spec and fast:
            # Fast path: the feature vector from pre-built expressions (imputed + scaled numerics,
            # one-hot slots with their scaling; unknown category → zeros), then only the classifier.
            slots = []
            for c, is_num, med, mean, std in model.spec["num"]:
                raw = F.col(c).cast("double") if is_num else F.col(c).try_cast("double")
                slots.append((F.coalesce(F.when(~F.isnan(raw), raw), F.lit(med).cast("double"))
                              - F.lit(mean).cast("double")) / F.lit(std).cast("double"))
            for c, mode, categories, scales in model.spec["cat"]:
                v = F.coalesce(F.col(c).cast("string"), F.lit(mode))
                slots += [F.when(v == F.lit(cat), F.lit(1.0) * F.lit(s)).otherwise(F.lit(0.0))
                          for cat, s in zip(categories, scales)]
            self.fast = (array_to_vector(F.array(*slots)).alias("features"), stage.transform if python else on_jvm(stage._to_java()))
        prob = F.round(vector_to_array("probability")[1], digits)
        ident = F.col(id_col) if id_col in names else F.lit("unknown")
        self.out = [ident.alias(id_col), *[F.col(k) for k in keep],
                    F.col("prediction").cast("int").alias("prediction"), prob.alias("churn_probability"),
                    risk_band(prob, thresholds, labels).alias("risk_level")]

    def __call__(self, df: DataFrame) -> DataFrame:
        prepared = df.select(*self.step1).select(*self.step2).select(*self.step3)
        if self.fast is not None:
            out = self.fast[1](prepared.select("*", self.fast[0]))
        else:
            out = self.pipeline(prepared)
        return out.select(*self.out)


def score(model: ChurnModel, df: DataFrame, id_col: str = "customerID", keep: Sequence[str] = (),
          thresholds=RISK_THRESHOLDS, labels=RISK_LABELS, digits: int = 4) -> DataFrame:
    """Clean → features → transform → prediction, P(class 1) (4 dp), risk band, id."""
    key = (df.schema.json(), id_col, tuple(keep), tuple(thresholds), tuple(labels), digits)
    cache = model.__dict__.setdefault("_scorers", {})
    if key not in cache:
        cache[key] = CompiledScorer(model, df.schema, id_col, keep, thresholds, labels, digits)
    return cache[key](df)
