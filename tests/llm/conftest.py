import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    """Workers get the package as they do from the registered queries."""
    from loomset.runtime import ship

    ship(spark)
