import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from larkspur.session import local_session
    s = local_session(4, app="larkspur-tests", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


@pytest.fixture(scope="session")
def sample_df(spark):
    """100-row housing frame in the shape of the reference's unit-test fixture."""
    import numpy as np
    rng = np.random.default_rng(42)
    n = 100
    rows = []
    zon = ["RL", "RM", "FV", "RH", "C"]
    neigh = ["NAmes", "CollgCr", "OldTown", "Edwards", "Somerst"]
    for i in range(n):
        rows.append((
            i, int(rng.integers(5000, 20000)), int(rng.integers(1950, 2020)), int(rng.integers(1950, 2020)),
            float(rng.integers(0, 2000)), float(rng.integers(800, 3000)), int(rng.integers(1, 4)),
            int(rng.integers(0, 2)), int(rng.integers(1, 5)), int(rng.integers(4, 10)), float(rng.integers(0, 800)),
            0.0, int(rng.integers(1, 11)), int(rng.integers(1, 11)),
            zon[int(rng.integers(0, 5))], "Pave", neigh[int(rng.integers(0, 5))], "1Fam", "1Story",
            ["TA", "Gd", "Ex", "Fa"][int(rng.integers(0, 4))], ["TA", "Gd", "Ex"][int(rng.integers(0, 3))],
            ["Attchd", "Detchd"][int(rng.integers(0, 2))], "Normal", int(rng.integers(100000, 500000))))
    schema = ("id long, LotArea long, YearBuilt long, YearRemodAdd long, TotalBsmtSF double, GrLivArea double, "
              "FullBath long, HalfBath long, BedroomAbvGr long, TotRmsAbvGrd long, GarageArea double, "
              "PoolArea double, OverallQual long, OverallCond long, MSZoning string, Street string, "
              "Neighborhood string, BldgType string, HouseStyle string, ExterQual string, KitchenQual string, "
              "GarageType string, SaleCondition string, SalePrice long")
    return spark.createDataFrame(rows, schema).cache()
