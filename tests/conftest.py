import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gapwise.session import local_session  # noqa: E402
from tests.helpers import SF  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", "gapwise-tests", "8g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def orders(spark):
    """Order key, customer and price of the smallest test tables."""
    return spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice").cache()


@pytest.fixture(scope="session")
def lines(spark):
    """Line items with a key of their own; net follows price closely, charge follows net."""
    return spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr(
        "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS line", "l_quantity AS qty", "l_extendedprice AS price",
        "l_extendedprice * (1 - l_discount) AS net", "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge").dropDuplicates(["line"]).cache()
