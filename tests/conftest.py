import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rolefit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column function on literal arguments."""
    from pyspark.sql import functions as F

    def evaluate(fn, *args):
        # A real column, so that nothing is folded away on the driver.
        row = spark.range(1).select(fn(*[a if hasattr(a, "alias") else F.lit(a) for a in args]).alias("v"))
        return row.first()["v"]

    return evaluate


SF = "/root/testdata/sf0.001"
