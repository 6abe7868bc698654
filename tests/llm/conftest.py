import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(__file__))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from corpus_rows import EDGES, SCHEMA, SF, row  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def edge_pairs():
    return [(r[0], r[1]) for r in EDGES]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_ids(spark):
    """Null ids and repeated rows."""
    rows = [row(None, "p q r"), row(None, "p q r"), row(5, "p q r"), row(5, "p q r"), row(7, "only here"), row(None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def small_pairs():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return list(zip(d.doc_id.tolist(), d.text.tolist(), strict=True))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
