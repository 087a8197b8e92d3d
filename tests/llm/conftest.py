import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def scratch(spark):
    from wayforge.llm.common import Scratch

    s = Scratch(spark, "test")
    yield s
    s.close()
