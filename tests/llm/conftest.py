import pytest

from emberline.llm.common import ready


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)
