"""The interleaved layout: same rows, and ranges of one column read a part of the row groups."""

from __future__ import annotations

import datetime as dt
import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyloom.plans import catalogue
from tallyloom.sources.layout import interleaved, read_interleaved, write_interleaved

SCHEMA = "id bigint, title string, price decimal(18,2), created_at timestamp_ntz"
DAY = "2024-03-11"


def rows_read(frame):
    """Rows that the file scan of a collected frame handed on."""

    def scans(node):
        if node.metrics().contains("numFiles"):
            yield node.metrics().apply("numOutputRows").value()
        children = node.children()
        for place in range(children.size()):
            yield from scans(children.apply(place))

    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    return sum(scans(plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.nodeName() else plan))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    n = 60_000
    table = spark.range(n).select(
        "id",
        F.concat(F.lit("t"), "id").alias("title"),
        (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100).cast("decimal(18,2)").alias("price"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(pmod(xxhash64(id, 1), 100), 0, 0, id % 86400)").alias("created_at"),
    )
    path = str(tmp_path_factory.mktemp("layout") / "products")
    write_interleaved(table, catalogue.LAYOUT, path, files=64)
    return table.checkpoint(), read_interleaved(spark, path, SCHEMA, catalogue.LAYOUT), path


@pytest.mark.parametrize(
    "params",
    [
        {"min_price": 500, "max_price": "520.50"},
        {"start": DAY, "end": DAY},
        {"min_price": 990},
        {"end": "2024-01-03"},
        {"start": DAY, "end": "2024-03-15", "min_price": 300, "max_price": 340},
    ],
)
def test_each_range_reads_under_a_third(stored, params):
    table, laid_out, _ = stored
    wanted = catalogue.search({}, table, params)
    found = catalogue.search({}, laid_out, params)
    columns = table.columns
    assert sorted(found.select(*columns).collect()) == sorted(wanted.collect())
    assert 0 < rows_read(found.select(*columns)) < 60_000 / 3


def test_row_groups_by_statistics(stored):
    """By the files alone: groups whose statistics meet a price range or a day."""
    _, _, path = stored
    groups = []
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for number in range(meta.num_row_groups):
            group = meta.row_group(number)
            groups.append({c: group.column(names.index(c)).statistics for c in ("price", "created_at__micros")})
    assert len(groups) >= 32
    day = dt.datetime(2024, 3, 11, tzinfo=dt.timezone.utc).timestamp() * 1_000_000
    prices = [g for g in groups if g["price"].min <= 520 and g["price"].max >= 500]
    days = [g for g in groups if g["created_at__micros"].min < day + 86_400_000_000 and g["created_at__micros"].max >= day]
    assert 0 < len(prices) < len(groups) / 3 and 0 < len(days) < len(groups) / 3


def test_nulls_ties_and_nothing(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None, rng.choice([None, 1, 1, 1, 2]), rng.choice([None, start, start + dt.timedelta(days=i)])) for i in range(200)]
    rows += rows[:20]
    table = spark.createDataFrame([(a, b, None if c is None else f"{c}.00", d) for a, b, c, d in rows], "id bigint, title string, price string, created_at timestamp_ntz")
    table = table.withColumn("price", F.col("price").cast("decimal(18,2)"))
    for name, given in (("some", table), ("nothing", table.filter("false")), ("nulls", table.filter("price IS NULL AND created_at IS NULL"))):
        write_interleaved(given, catalogue.LAYOUT, str(tmp_path / name))
        back = read_interleaved(spark, str(tmp_path / name), SCHEMA, catalogue.LAYOUT)
        assert sorted(map(str, back.select(*given.columns).collect())) == sorted(map(str, given.collect()))


def test_the_order_is_that_of_the_bits(spark):
    values = [(i, float(a), float(b)) for i, (a, b) in enumerate((a, b) for a in range(4) for b in range(4))]
    table = spark.createDataFrame(values * 20, "id bigint, a double, b double")
    found = {r.id: r.z for r in table.select("id", interleaved(table, ("a", "b"), 2).alias("z")).collect()}

    def bits(a, b):
        return sum((a >> k & 1) << 2 * k | (b >> k & 1) << 2 * k + 1 for k in range(2))

    by_rank = sorted((bits(int(a), int(b)), i) for i, a, b in values)
    assert [i for _, i in by_rank] == sorted(found, key=lambda i: found[i])


def test_text_has_no_rank(spark):
    with pytest.raises(ValueError, match="no rank"):
        interleaved(spark.createDataFrame([("x",)], "a string"), ("a",))
