from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession


@pytest.fixture
def texts(spark: SparkSession) -> Callable[..., DataFrame]:
    """A table of id and text; more columns by name."""

    def make(rows: list[tuple], ddl: str = "id bigint, text string") -> DataFrame:
        return spark.createDataFrame(rows, ddl)

    return make
