import pytest


@pytest.fixture(scope="session", autouse=True)
def cleared(spark):
    yield
    from tessera.llm.storage import clear

    clear(spark)
