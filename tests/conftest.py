import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark

    return get_spark("tests", cpus=4, shuffle_partitions=4, memory="4g")


def rows(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()) if order else (tuple(r) for r in df.collect()), key=str)
