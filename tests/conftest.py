"""One session for all tests, and small fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from annmatrix.sources.dataset import from_frames

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


# seven rows and four features by rules: about half the entries are zero, sites alternate, kinds go round
X = np.array([[(5 * i + 3 * j) % 9 * ((i + 2 * j) % 3 > 0) for j in range(4)] for i in range(7)], dtype=np.int32)
SITES = {"north": [0, 2, 4, 6], "south": [1, 3, 5]}
KINDS = {"T": [0, 3, 6], "B": [1, 4], "<NA>": [2, 5]}


def golden_frames():
    site = [next(s for s, rows in SITES.items() if i in rows) for i in range(7)]
    kind = [next((k for k, rows in KINDS.items() if i in rows and k != "<NA>"), None) for i in range(7)]
    obs = pd.DataFrame({"site": site, "kind": pd.Categorical(kind, categories=["T", "B", "unused"], ordered=True)}, index=[f"cell_{i}" for i in range(7)])
    return obs, pd.DataFrame({"symbol": list("abcd")}, index=[f"f{i}" for i in range(4)])


@pytest.fixture(scope="session", params=["dense", "sparse"])
def golden(spark, request):
    from annmatrix.sources.matrix import from_array

    obs, var = golden_frames()
    return from_frames(spark, obs, var, from_array(spark, X, request.param == "sparse"), layers={"counts": 3 * X})
