import pytest
from compare import session
from pyspark.sql import SparkSession

from letterloom.session import tune


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return tune(session())
