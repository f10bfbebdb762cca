import pytest

from worksight.llm.common import ship_code


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    ship_code(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
