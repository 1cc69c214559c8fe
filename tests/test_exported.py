"""The data source over exported pages: what is pushed down, and that results don't depend on it."""

import pytest
from pyspark.sql import functions as F

from quirekit.sources import exported


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("exported") / "pages")
    df = spark.createDataFrame([(d, n, f"{d}-{n}") for d in range(20) for n in range(1, 41)] + [(5, None, "lost")], "doc_id long, page_no int, markdown string")
    df.repartitionByRange(8, "page_no").write.parquet(path)
    exported.register(spark)
    return f"file://{path}"


def read(spark, source, **options):
    return spark.read.format("exported_pages").options(path=source, **options).load()


def test_all_pages(spark, source):
    df = read(spark, source)
    assert df.count() == 800 and df.rdd.getNumPartitions() == 8


def test_the_range_prunes_partitions(spark, source):
    some = read(spark, source, pages="2-3,40")
    assert {r[0] for r in some.select("page_no").distinct().collect()} == {2, 3, 40} and some.count() == 60 and some.rdd.getNumPartitions() <= 3
    for condition, pages in (("page_no = 7", {7}), ("page_no > 38", {39, 40}), ("page_no >= 39 and page_no < 40", {39}), ("page_no in (1, 2)", {1, 2}), ("page_no <= 1 and doc_id < 3", {1})):
        df = read(spark, source).where(condition)
        assert {r[0] for r in df.select("page_no").distinct().collect()} == pages
        assert df.rdd.getNumPartitions() <= 3, condition
    assert read(spark, source).where("page_no = 99").count() == 0


def test_other_filters_still_hold(spark, source):
    df = read(spark, source).where(F.col("markdown").startswith("3-") & (F.col("page_no") != 5))
    assert df.count() == 39
