import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from llm_rows import EDGE, frame  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
