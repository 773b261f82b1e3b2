"""Rolling means where one node holds most of the samples."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from mooring.operators.candidates import rolling_mean


@pytest.mark.parametrize("block", [16, 50, 4096])
def test_rolling_mean_of_a_hot_node(spark, block):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, 0 if rng.random() < 0.8 else rng.randrange(9),
             start + datetime.timedelta(seconds=rng.randrange(400)), rng.random()) for i in range(600)]
    frame = spark.createDataFrame(rows, "sample_id long, node_id long, ts timestamp, v double")
    got = {r.sample_id: r.m for r in rolling_mean(frame, {"m": F.col("v")}, block=block).collect()}
    assert len(got) == len(rows)
    for node in range(9):
        mine = sorted((r for r in rows if r[1] == node), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(mine):
            last = [x[3] for x in mine[max(0, i - 11):i + 1]]
            assert got[r[0]] == pytest.approx(sum(last) / len(last))


def test_samples_without_a_node_stay(spark):
    start = datetime.datetime(2024, 1, 1)
    frame = spark.createDataFrame(
        [(i, None if i % 2 else 0, start, float(i)) for i in range(6)],
        "sample_id long, node_id long, ts timestamp, v double")
    got = {r.sample_id: (r.node_id, r.m) for r in rolling_mean(frame, {"m": F.col("v")}).collect()}
    assert got == {0: (0, 0.0), 2: (0, 1.0), 4: (0, 2.0), 1: (None, 1.0), 3: (None, 2.0), 5: (None, 3.0)}
