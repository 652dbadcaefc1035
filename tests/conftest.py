import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assetlens.session import local_session  # noqa: E402


# started at import, as test modules build columns at their top level
SESSION = local_session(8, app="assetlens-tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def values(spark):
    """Evaluate expressions over one text column ``x``, one result per row."""

    def run(expr, inputs, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
        return [r[1] for r in sorted(df.select("i", expr).collect(), key=lambda r: r[0])]

    return run
