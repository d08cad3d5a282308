import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from keyloom.session import get_session

    return get_session("tests", 4)


@pytest.fixture
def rows():
    """Rows of a frame or DataFrame as sorted tuples."""

    def get(x, *columns):
        df = x.df if hasattr(x, "df") else x
        df = df.select(*columns) if columns else df
        key = lambda r: tuple((v is None, str(type(v)) if isinstance(v, (dict, list)) else "", v if not isinstance(v, (dict, list)) else str(v)) for v in r)
        return sorted([tuple(r) for r in df.collect()], key=key)

    return get
