import pytest

from brindle.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__sql__caseSensitive="false")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
