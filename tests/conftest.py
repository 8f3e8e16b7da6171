from __future__ import annotations

import pytest

from rebuy.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", partitions=4)
