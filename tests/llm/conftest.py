from __future__ import annotations

import pytest

from tallyweir.llm.links import stored
from tallyweir.session import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def kept():
    return stored
