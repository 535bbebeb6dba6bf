from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries, sharding
from tallyloom.llm.sharding import shard_rows

SCHEMA = "key bigint, minor bigint, size bigint, other string"


def expected(rows, shards, tolerance):
    """Each unit goes where the middle of its bytes falls; a unit is a small group or one minor key."""
    total = sum(r[2] for r in rows)
    groups = {}
    for key, minor, size, _ in rows:
        groups.setdefault(key, {}).setdefault(minor, 0)
        groups[key][minor] += size
    out, before = {}, 0
    for key in sorted(groups):
        amount = sum(groups[key].values())
        if amount * shards <= tolerance * total:
            shard = min(shards - 1, (2 * before + amount) * shards // (2 * total))
            out |= {(key, minor): shard for minor in groups[key]}
            before += amount
        else:
            for minor in sorted(groups[key]):
                size = groups[key][minor]
                out[key, minor] = min(shards - 1, (2 * before + size) * shards // (2 * total))
                before += size
    return out


@pytest.mark.parametrize(
    "number, keys, shards, tolerance, leaf",
    [(400, 400, 7, 0.02, 3), (300, 5, 6, 0.02, 2), (500, 60, 4, 0.5, 1), (1, 1, 3, 0.1, 10), (50, 1, 24, 0.02, 4)],
)
def test_shards_equal_brute_force(spark, number, keys, shards, tolerance, leaf):
    rnd = random.Random(number)
    names = [rnd.randrange(1 << 62) for _ in range(keys)]
    rows = [(rnd.choice(names), rnd.randrange(1 << 62), rnd.randint(1, 50), "a") for _ in range(number)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = shard_rows(frame, shards, "key", "minor", "size", tolerance, 4, leaf, 10).collect()
    assert len(got) == number
    wanted = expected(rows, shards, tolerance)
    assert {(r.key, r.minor): r.shard for r in got} == wanted
    for shard in range(shards):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_repeated_rows_stay_together_and_empty_table(spark):
    rows = [(5, 7, 10, "a")] * 6 + [(6, 1, 10, None)]
    got = shard_rows(spark.createDataFrame(rows, SCHEMA), 3, "key", "minor", "size").collect()
    assert len(got) == 7
    assert len({r.shard for r in got if r.key == 5}) == 1
    assert shard_rows(spark.createDataFrame([], SCHEMA), 3, "key", "minor", "size").count() == 0


def test_rows_without_an_id_are_spread(spark, tmp_path):
    """All rows lack an id, a third of them hold one text: shards stay even, slots gapless."""
    rows = [(None, "same text" if i % 3 == 0 else f"text {i}", "x", "clash") for i in range(3_000)]
    schema = "doc_id bigint, text string, row string, minor string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op1_sharding(spark, str(tmp_path)).collect()
    sizes = {}
    for row in found:
        sizes.setdefault(row.shard, []).append(row)
    assert sorted(sizes) == list(range(24)) and len(found) == 3_000
    total = [sum(r.size for r in rows) for rows in sizes.values()]
    assert max(total) - min(total) <= 0.06 * sum(total) / 24
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in sizes.values())


def test_rows_of_one_key_fill_many_cells(spark):
    rows = [(5, 7, 1, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "key bigint, minor bigint, size bigint, row bigint")
    dealt = frame.withColumn("shard", F.lit(0))
    plan = sharding._with_slots(dealt, "key", "minor", 10, "row")
    assert sorted(r.slot for r in plan.collect()) == list(range(500))
    cells = frame.select(F.pmod(F.xxhash64("minor", "row"), F.lit(50)).alias("cell")).groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] < 40
