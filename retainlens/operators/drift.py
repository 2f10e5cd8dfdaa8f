"""Drift detection (H5–H10): two-sample KS, numeric / categorical PSI, drift report, stored reference.

Everything is computed from counts of values: (feature, value, n) for numbers and (feature, category, n)
for categories, optionally within groups ``by``. A raw table is scanned once into them (partial
aggregation before the shuffle); a stored reference *is* such a table, so KS and PSI need no raw
reference data, and increments merge by adding counts. The ordered KS scan uses the range-partitioned
prefix sums over (by, feature), so that one hot group is spread over tasks and many tiny groups share one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DriftConfig
from ..functions.expressions import safe_double
from ..functions.pvalues import EXACT_KS_ROWS, kolmogorov_sf, ks_exact_udf
from .prefix import global_prefix_sum
from .profile import categorical_profile, numeric_profile
from .rows import null_safe_join

EPS = 1e-6


# --- counts -----------------------------------------------------------------------------------------

def _long(df: DataFrame, cells: list[Column], by: Sequence[str]) -> DataFrame:
    return df.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")


def number_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, n) of the coerced numbers; nulls, NaN and text that is no number are left out."""
    cells = [F.struct(F.lit(c).alias("feature"), safe_double(c, df.schema[c].dataType).alias("value")) for c in cols]
    if not cells:
        return df.sparkSession.createDataFrame([], _empty(df, by, "feature string, value double, n long"))
    return _long(df, cells, by).filter(F.col("value").isNotNull()).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, category, n); nulls are left out."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in cols]
    if not cells:
        return df.sparkSession.createDataFrame([], _empty(df, by, "feature string, category string, n long"))
    return _long(df, cells, by).filter(F.col("category").isNotNull()).groupBy(*by, "feature", "category").agg(F.count(F.lit(1)).alias("n"))


def _empty(df: DataFrame, by: Sequence[str], rest: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), rest])


@dataclass
class Profile:
    """Counts of the numbers and of the categories of a window; what a stored reference holds."""
    numbers: DataFrame
    categories: DataFrame

    def merge(self, other: Profile) -> Profile:
        """Both windows together: equal values add up."""
        def add(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.unionByName(b).groupBy(*[c for c in a.columns if c != "n"]).agg(F.sum("n").alias("n"))
        return Profile(add(self.numbers, other.numbers), add(self.categories, other.categories))


def profile(df: DataFrame, cfg: DriftConfig = DriftConfig(), by: Sequence[str] = ()) -> Profile:
    """The counts of a table's drift features (those that it has)."""
    return Profile(number_counts(df, [c for c in cfg.numeric_features if c in df.columns], by),
                   category_counts(df, [c for c in cfg.categorical_features if c in df.columns], by))


def save_profile(p: Profile, path: str, increment: bool = False) -> None:
    """Store a reference. An ``increment`` is added to what is there, as a part of its own."""
    for name, table in (("numbers", p.numbers), ("categories", p.categories)):
        part = uuid.uuid4().hex if increment else "base"
        if increment:
            table.write.mode("errorifexists").parquet(f"{path}/{name}/part={part}")
        else:
            table.withColumn("part", F.lit(part)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")


def load_profile(spark: SparkSession, path: str) -> Profile:
    """A stored reference with all its increments; a missing one raises FileNotFoundError."""
    def load(name: str, value: str) -> DataFrame:
        got = spark.read.schema(f"feature string, {value}, n long, part string").parquet(f"{path}/{name}")
        got = got.drop("part")
        return got.groupBy(*got.columns[:-1]).agg(F.sum("n").alias("n"))
    try:
        return Profile(load("numbers", "value double"), load("categories", "category string"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"reference profile not found: {path}") from e


# --- statistics -------------------------------------------------------------------------------------

def _both(ref: DataFrame, cur: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each value of either side, with its counts r and c."""
    sides = ref.select(*keys, F.col("n").alias("r"), F.lit(0).cast("long").alias("c")).unionByName(
        cur.select(*keys, F.lit(0).cast("long").alias("r"), F.col("n").alias("c")))
    return sides.groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """P(D >= d) for samples of n and m values: exact where both have at most ``EXACT_KS_ROWS`` values, beyond that
    the Kolmogorov limit; null where a side has none."""
    en = n * m / (n + m)
    p = F.when(F.greatest(n, m) <= EXACT_KS_ROWS, ks_exact_udf(d, n.cast("long"), m.cast("long"))).otherwise(kolmogorov_sf(F.sqrt(en) * d))
    return F.when((n > 0) & (m > 0), p)


def ks_from_counts(ref: DataFrame, cur: DataFrame, by: Sequence[str] = (), p_threshold: float = 0.05) -> DataFrame:
    """H5 from counts: D = max |F_ref − F_cur| over the union of values, p, drift flag, and ref mean / sample
    std, cur mean / population std, for each (by, feature)."""
    keys = [*by, "feature"]
    cum = global_prefix_sum(_both(ref, cur, [*keys, "value"]), "value", ["r", "c"], by=keys)
    gap = F.abs(F.try_divide(F.col("cum_r"), F.col("tot_r")) - F.try_divide(F.col("cum_c"), F.col("tot_c")))
    mean = lambda x: F.try_divide(F.sum(F.col(x) * F.col("value")), F.sum(x))
    d = cum.groupBy(*keys).agg(F.max(gap).alias("ks_statistic"), F.first("tot_r").alias("n_ref"), F.first("tot_c").alias("n_cur"),
                               mean("r").alias("ref_mean"), mean("c").alias("cur_mean"))
    # Deviations from the known means, not differences of large squares.
    spread = lambda x, m: F.sum(F.col(x) * F.pow(F.col("value") - F.col(m), 2))
    s = null_safe_join(cum.select(*keys, "value", "r", "c"), d.select(*keys, "ref_mean", "cur_mean"), keys).groupBy(*keys).agg(
        spread("r", "ref_mean").alias("_sr"), spread("c", "cur_mean").alias("_sc"))
    p = ks_p_value(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"))
    stats = null_safe_join(d, s, keys)
    if by:
        # One small row a group, but an exact p costs up to half a second: a set number of tasks, which adaptive execution
        # doesn't merge by bytes. By a hash of the keys, as rows dealt by the keys themselves would stay where they are.
        stats = stats.repartition(int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))
    return stats.withColumn("p_value", p).select(
        *keys, "ks_statistic", "p_value", (F.col("p_value") < p_threshold).alias("drift_detected"), "ref_mean", "cur_mean",
        F.sqrt(F.try_divide(F.col("_sr"), F.col("n_ref") - 1)).alias("ref_std"), F.sqrt(F.try_divide(F.col("_sc"), F.col("n_cur"))).alias("cur_std"),
        "n_ref", "n_cur")


def ks_test(ref: DataFrame, cur: DataFrame, cols: Sequence[str], p_threshold: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """H5 on raw tables: see :func:`ks_from_counts`."""
    return ks_from_counts(number_counts(ref, cols, by), number_counts(cur, cols, by), by, p_threshold)


def psi_numeric_from_counts(ref: DataFrame, cur: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """H6: equal-width bins over the joint [min, max], last bin right-closed, Laplace-smoothed
    shares (h + 1) / (N + bins), PSI = Σ (c − r) ln(c / r), rounded to 6."""
    keys = [*by, "feature"]
    both = ref.select(*keys, "value", F.col("n").alias("r"), F.lit(0).cast("long").alias("c")).unionByName(
        cur.select(*keys, "value", F.lit(0).cast("long").alias("r"), F.col("n").alias("c")))
    rng = both.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1))).cast("int")
    hist = null_safe_join(both, rng.select(*keys, "lo", "hi"), keys).groupBy(*keys, b.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    grid = rng.select(*keys, "nr", "nc", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = null_safe_join(grid, hist, [*keys, "bin"], "left").fillna(0, ["r", "c"])
    rp = (F.col("r") + 1) / (F.col("nr") + bins)
    cp = (F.col("c") + 1) / (F.col("nc") + bins)
    return full.groupBy(*keys).agg(F.round(F.sum((cp - rp) * F.log(cp / rp)), 6).alias("psi"))


def psi_numeric(ref: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """H6 on raw tables."""
    return psi_numeric_from_counts(number_counts(ref, cols, by), number_counts(cur, cols, by), bins, by)


def category_frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, category, freq) over non-null values."""
    p = categorical_profile(df, cols)
    return p.filter(F.col("category").isNotNull()).select("feature", "category", "freq")


def category_shares(ref: DataFrame, cur: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """H8's distributions, in long form: (by, feature, category, ref_freq, cur_freq) over the categories of either side."""
    keys = [*by, "feature"]
    both = _both(ref, cur, [*keys, "category"])
    tot = both.groupBy(*keys).agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    share = lambda x, n: F.coalesce(F.try_divide(F.col(x), F.col(n)), F.lit(0.0))
    return null_safe_join(both, tot, keys).select(*keys, "category", share("r", "nr").alias("ref_freq"), share("c", "nc").alias("cur_freq"))


def psi_from_shares(shares: DataFrame, threshold: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """H7: |Σ (c − r) ln(c / r)| with shares floored at 1e-6, rounded to 6; drift flag when PSI > threshold."""
    r, c = (F.greatest(F.col(x), F.lit(EPS)) for x in ("ref_freq", "cur_freq"))
    out = shares.groupBy(*by, "feature").agg(F.round(F.abs(F.sum((c - r) * F.log(c / r))), 6).alias("psi"))
    return out.select(*by, "feature", "psi", (F.col("psi") > threshold).alias("drift_detected"), F.lit(threshold).alias("threshold"))


def psi_categorical(ref: DataFrame | None, cur: DataFrame, cols: Sequence[str],
                    ref_freq: DataFrame | None = None, threshold: float = 0.2) -> DataFrame:
    """H7 + H8 on raw tables, or against stored frequencies (feature, category, freq)."""
    if ref_freq is None:
        return psi_from_shares(category_shares(category_counts(ref, cols), category_counts(cur, cols)), threshold)
    cf = category_frequencies(cur, cols)
    j = ref_freq.withColumnRenamed("freq", "ref_freq").join(cf.withColumnRenamed("freq", "cur_freq"), ["feature", "category"], "full_outer")
    return psi_from_shares(j.fillna(0.0, ["ref_freq", "cur_freq"]), threshold)


# --- reports ----------------------------------------------------------------------------------------

def features_from_profiles(ref: Profile, cur: Profile, cfg: DriftConfig = DriftConfig(), by: Sequence[str] = ()) -> DataFrame:
    """H5 + H8 rows in one long table: (by, feature, kind, statistic, p_value, threshold, drift_detected, ref_mean, cur_mean,
    ref_std, cur_std); distributions are in :func:`category_shares`. Features absent on either side are ignored."""
    keys = [*by, "feature"]
    k = ks_from_counts(ref.numbers, cur.numbers, by, cfg.ks_pvalue).filter("n_ref > 0 AND n_cur > 0")
    shares = category_shares(ref.categories, cur.categories, by)
    there = shares.groupBy(*keys).agg(F.sum("ref_freq").alias("_r"), F.sum("cur_freq").alias("_c")).filter("_r > 0 AND _c > 0")
    p = null_safe_join(psi_from_shares(shares, cfg.psi_threshold, by), there.select(*keys), keys)
    none = F.lit(None).cast("double")
    return k.select(*keys, F.lit("ks").alias("kind"), F.col("ks_statistic").alias("statistic"), "p_value", F.lit(cfg.ks_pvalue).alias("threshold"),
                    "drift_detected", "ref_mean", "cur_mean", "ref_std", "cur_std").unionByName(
        p.select(*keys, F.lit("psi").alias("kind"), F.col("psi").alias("statistic"), none.alias("p_value"), "threshold", "drift_detected",
                 *[none.alias(c) for c in ("ref_mean", "cur_mean", "ref_std", "cur_std")]))


def drift_features(ref: DataFrame, cur: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Per-feature drift rows of two raw tables."""
    return features_from_profiles(profile(ref, cfg), profile(cur, cfg), cfg)


def _verdict(features: DataFrame, cfg: DriftConfig, by: Sequence[str] = ()) -> DataFrame:
    """H9's decision over the feature rows of each group (without ``by``: one row, also if nothing was checked)."""
    ratio = F.when(F.col("total") > 0, F.col("n_drifted") / F.col("total")).otherwise(F.lit(0.0))
    grouped = features.groupBy(*by) if by else features
    agg = grouped.agg(F.count_if("drift_detected").alias("n_drifted"), F.count(F.lit(1)).alias("total"),
                      F.array_join(F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature")))), ",").alias("drifted_features"))
    return agg.select(
        *by, (ratio >= cfg.drift_ratio).alias("drift_detected"), F.col("n_drifted").cast("long").alias("n_drifted"),
        F.col("total").cast("long").alias("total_features_checked"), F.round(ratio, 4).alias("drift_ratio"),
        F.when(ratio == 0, F.lit("none")).when(ratio < cfg.drift_ratio, F.lit("warning")).otherwise(F.lit("critical")).alias("alert_level"),
        "drifted_features")


_COLUMNS = ("drift_detected", "n_drifted", "total_features_checked", "drift_ratio", "alert_level", "sample_size", "status", "drifted_features")
_UNCHECKED = ("false", "0L", "0L", "0.0D", "'none'")  # SQL literals


def report_from_profiles(ref: Profile, cur: Profile, sizes: DataFrame, cfg: DriftConfig = DriftConfig(), by: Sequence[str] = ()) -> DataFrame:
    """H9 for every group of ``sizes`` (by, sample_size): groups below ``min_samples`` are 'insufficient_data'."""
    status = F.when(F.lit(not cfg.enabled), F.lit("disabled")).when(F.col("sample_size") < cfg.min_samples, F.lit("insufficient_data")).otherwise(F.lit("ok"))
    verdict = _verdict(features_from_profiles(ref, cur, cfg, by), cfg, by)
    rows = null_safe_join(sizes.withColumn("status", status), verdict, list(by), "left")
    ok = F.col("status") == "ok"
    kept = [F.coalesce(F.when(ok, F.col(c)), F.expr(none)).alias(c) for c, none in zip(_COLUMNS[:5], _UNCHECKED)]
    return rows.select(*by, *kept, F.col("sample_size").cast("long").alias("sample_size"), "status",
                       F.when(ok, F.coalesce("drifted_features", F.lit(""))).otherwise(F.lit("")).alias("drifted_features"))


def for_groups(ref: Profile, cur: Profile, by: Sequence[str]) -> Profile:
    """The reference once for every group and feature of ``cur``."""
    copy = lambda r, c: c.select(*by, "feature").distinct().join(r, "feature").select(*by, *r.columns)
    return Profile(copy(ref.numbers, cur.numbers), copy(ref.categories, cur.categories))


def drift_report(ref: DataFrame, cur: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """H9: one row — drift_detected, n drifted / checked, ratio (4 dp), alert level, sample size.

    Disabled → status 'disabled'; fewer than ``min_samples`` current rows → 'insufficient_data'.
    """
    return _one_report(lambda: drift_features(ref, cur, cfg), cur, cfg)


def drift_report_from_profile(ref: Profile, cur: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """H9 against a stored reference."""
    return _one_report(lambda: features_from_profiles(ref, profile(cur, cfg), cfg), cur, cfg)


def _one_report(features, cur: DataFrame, cfg: DriftConfig) -> DataFrame:
    n_cur = cur.count()
    size, status = F.lit(n_cur).cast("long").alias("sample_size"), "ok"
    if not cfg.enabled or n_cur < cfg.min_samples:
        status = "disabled" if not cfg.enabled else "insufficient_data"
        return cur.sparkSession.range(1).select(*[F.expr(v).alias(c) for c, v in zip(_COLUMNS[:5], _UNCHECKED)], size, F.lit(status).alias("status"),
                                                F.lit("").alias("drifted_features"))
    return _verdict(features(), cfg).select(*_COLUMNS[:5], size, F.lit(status).alias("status"), "drifted_features")


# --- summaries of the reference ---------------------------------------------------------------------

def save_reference_profile(numeric: DataFrame, categorical: DataFrame, path: str) -> None:
    """Persist the reference's summary as two Parquet tables."""
    numeric.coalesce(1).write.mode("overwrite").parquet(f"{path}/numeric")
    categorical.coalesce(1).write.mode("overwrite").parquet(f"{path}/categorical")


def load_reference_profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Load the summary; a missing one raises FileNotFoundError."""
    try:
        return spark.read.parquet(f"{path}/numeric"), spark.read.parquet(f"{path}/categorical")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"reference profile not found: {path}") from e


def reference_profile(df: DataFrame, cfg: DriftConfig = DriftConfig()) -> tuple[DataFrame, DataFrame]:
    """Summary of the reference data — numeric profile and categorical frequencies. The numbers are coerced
    first (a raw ' ' TotalCharges becomes null). The values themselves are kept by :func:`profile`."""
    num = [c for c in cfg.numeric_features if c in df.columns]
    cat = [c for c in cfg.categorical_features if c in df.columns]
    return numeric_profile(df, num), category_frequencies(df, cat)
