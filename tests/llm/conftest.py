import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from edge_cases import EDGES, table  # noqa: E402


@pytest.fixture
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture
def nothing(spark):
    return table(spark, [])


@pytest.fixture
def make(spark):
    return lambda rows: table(spark, rows)
