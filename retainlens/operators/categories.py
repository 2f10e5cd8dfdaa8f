"""Category dictionaries (T2, T4, T5) as tables.

A dictionary has one row per (column, category): ``count``, ``slot`` (the category's alphabetical place in
its column), ``n`` (categories of the column) and ``scale`` (1 / population std of the one-hot slot).
It comes from one partial aggregate over the unpivoted cells and one running sum over range partitions,
so a column may have any number of categories. Few of them become constants of a compiled encoder; beyond
``COMPILED`` rows of the dictionary, :class:`DictionaryEncoder` encodes by joins.

Nulls count as the column's mode. A column of nulls alone has no row, and encodes as no slot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ensure_checkpoint_dir
from .prefix import global_prefix_sum
from .profile import value_counts

#: Categories of all columns together that may become constants of a plan (and pass through the driver).
COMPILED = 10_000


def modes(counts: DataFrame) -> DataFrame:
    """(column, mode) of (column, value, count): most frequent value, ties → smallest."""
    best = F.min(F.struct((-F.col("count")).alias("c"), "value"))
    return counts.filter("value IS NOT NULL").groupBy("column").agg(best.alias("b")).select("column", F.col("b.value").alias("mode"))


def fit_dictionary(df: DataFrame, cols: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """(column, category, count, slot, n, scale) of ``cols``; ``counts``: their value counts, where known."""
    counts = cut_lineage(value_counts(df, cols)) if counts is None else counts
    # One row a column: a broadcast bounded by the width of the table.
    filled = (counts.join(F.broadcast(modes(counts)), "column").select("column", F.coalesce("value", "mode").alias("category"), "count")
              .groupBy("column", "category").agg(F.sum("count").alias("count")))
    ranked = global_prefix_sum(filled.withColumn("one", F.lit(1).cast("long")), "category", ["one", "count"], by=["column"])
    p = F.col("count") / F.col("tot_count")
    std = F.sqrt(p * (1 - p))
    return ranked.select("column", "category", "count", (F.col("cum_one") - 1).alias("slot"), F.col("tot_one").alias("n"),
                         F.when(std > 0, 1 / std).otherwise(1.0).alias("scale"))


def sizes(dictionary: DataFrame, cols: Sequence[str]) -> list[int]:
    """Categories of each column (one row a column reaches the driver)."""
    got = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.max("n").alias("n")).collect()}
    return [got.get(c, 0) for c in cols]


class DictionaryEncoder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse feature vectors: numeric columns, then the one-hot slots of each category column, found by a
    left join with the dictionary written at ``table``. Columns of up to ``COMPILED`` categories are
    broadcast, larger ones meet their rows in a shuffled join, which adaptive execution splits at hot
    categories. Unknown categories have no slot."""

    numeric = Param(Params._dummy(), "numeric", "numeric input columns, in order", TypeConverters.toListString)
    categories = Param(Params._dummy(), "categories", "category input columns, in order", TypeConverters.toListString)
    columns = Param(Params._dummy(), "columns", "names of the category columns in the dictionary", TypeConverters.toListString)
    widths = Param(Params._dummy(), "widths", "categories of each column", TypeConverters.toListInt)
    scaled = Param(Params._dummy(), "scaled", "slots divided by their population std", TypeConverters.toBoolean)
    table = Param(Params._dummy(), "table", "folder of the dictionary", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "output column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numeric=None, categories=None, columns=None, widths=None, scaled=None, table=None, output=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        words = df.sparkSession.read.parquet(get("table"))
        place, size = len(get("numeric")), len(get("numeric")) + sum(get("widths"))
        out, cells = df, []
        for i, (own, name, width) in enumerate(zip(get("categories"), get("columns"), get("widths"))):
            value = F.col("scale") if get("scaled") else F.lit(1.0)
            side = words.filter(F.col("column") == name).select(
                F.col("category").alias(f"__k{i}"), F.struct((F.col("slot") + place).cast("int").alias("at"), value.alias("v")).alias(f"__c{i}"))
            out = out.join(F.broadcast(side) if width <= COMPILED else side, F.col(f"`{own}`") == F.col(f"__k{i}"), "left").drop(f"__k{i}")
            cells.append(f"__c{i}")
            place += width
        numbers = [F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(get("numeric"))]
        out = out.withColumn("__hits", F.filter(F.array(*numbers, *cells), lambda x: x.isNotNull())).drop(*cells)
        names = [f.name for f in df.schema.fields if f.name != get("output")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = b.column(b.schema.get_field_index("__hits"))
                flat = hits.flatten()
                offsets = pa.array(np.concatenate([[0], np.cumsum(hits.value_lengths().to_numpy())]), pa.int32())
                fields = [pa.array(np.zeros(b.num_rows, np.int8)), pa.array(np.full(b.num_rows, size, np.int32)),
                          pa.ListArray.from_arrays(offsets, flat.field("at")), pa.ListArray.from_arrays(offsets, flat.field("v"))]
                vector = pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), vector], names=[*names, get("output")])

        schema = T.StructType([*(f for f in df.schema.fields if f.name in names), T.StructField(get("output"), VectorUDT())])
        return out.select(*(f"`{n}`" for n in names), "__hits").mapInArrow(run, schema)

    def kept_in(self, df_session, folder: str) -> DictionaryEncoder:
        """The same encoder with its dictionary copied to ``folder``."""
        df_session.read.parquet(self.getOrDefault("table")).write.mode("overwrite").parquet(folder)
        return self.copy({self.table: folder})


def written(dictionary: DataFrame, folder: str | None = None) -> str:
    """Folder of the dictionary, a fresh one in the shared folder unless named."""
    folder = folder or f"{ensure_checkpoint_dir(dictionary.sparkSession).rstrip('/')}/dictionary-{uuid.uuid4().hex}"
    dictionary.write.mode("errorifexists").parquet(folder)
    return folder
