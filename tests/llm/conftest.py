import os
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shuffle_files(spark):
    """Size of each shuffle data file on this machine's disk."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: os.path.getsize(f) for f in found if f.endswith(".data") and os.path.basename(f).startswith("shuffle_") and os.path.exists(f)}


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text and clashing column names."""
    long_ = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", None), (4, " \n\t", None, "s"),
            (None, "lost id here", "en", "s"), (5, long_, "de", "s"), (6, long_, "de", "t"), (7, "é" * 500, "fr", "t"), (None, None, None, None)]
    return spark.createDataFrame([(*r, 0, "x", 1, True, "y", 2.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _k string, n long, kept boolean, spans string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
