import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonalis.operators import movement
from zonalis.sources import matrix
from zonalis.streaming import visits as stream


def simulated(spark, target, hours=24, people=200):
    folk = spark.range(people).select(F.lit("z").alias("zone"), F.concat(F.lit("p"), "id").alias("person_id"), F.floor(F.col("id") / 4).cast("string").alias("home"))
    wanted = spark.range(hours).select(F.lit("z").alias("zone"), F.col("id").alias("hour"), F.lit("7").alias("placekey"), F.lit(3).alias("dwell"), F.lit(target).alias("target"))
    return movement.simulate(folk, wanted, hours)


def test_everyone_is_somewhere_once_an_hour(spark):
    s = simulated(spark, 60).toPandas()
    assert len(s) == 24 * 200 and not s.duplicated(["minute", "person_id"]).any()
    away = s[~s.is_home].groupby("minute").size()
    assert (away <= 60).all() and away.iloc[-1] == 60


def test_demand_is_scaled_to_those_at_home(spark):
    s = simulated(spark, 1000).toPandas()
    assert (~s.is_home).groupby(s.minute).sum().max() <= 200


def test_runs_repeat(spark):
    a, b = (simulated(spark, 50).orderBy("minute", "person_id").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(a, b)


def test_no_people_is_an_error(spark):
    with pytest.raises(Exception, match="no people"):
        simulated(spark, 5, people=0).collect()


def test_matrix_round_trip_with_colliding_ids(spark):
    rows = [("z", m, p, h, x) for m, a in ((60, ((("p1"), True, "1"), ("p2", True, "2"), ("p3", False, "1"))), (120, (("p1", False, "1"), ("p2", True, "2"), ("p3", True, "1")))) for p, h, x in a]
    df = spark.createDataFrame(rows, "zone string, minute int, person_id string, is_home boolean, location_id string")
    buffers = matrix.encode(df)
    assert {tuple(r) for r in matrix.decode(buffers).collect()} == set(rows)
    head = buffers.first().buffer
    assert head[:8] == matrix.MAGIC and len(head) > 28


def test_a_person_in_two_places_is_an_error(spark):
    df = spark.createDataFrame([("z", 60, "p", True, "1"), ("z", 60, "p", True, "2")], "zone string, minute int, person_id string, is_home boolean, location_id string")
    with pytest.raises(Exception, match="2 rows"):
        matrix.encode(df).collect()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 5), st.integers(0, 6), st.integers(1, 9), st.randoms())
def test_buffers_hold_any_matrix(t, n, k, rng):
    m = np.array([[rng.randrange(k) for _ in range(n)] for _ in range(t)], np.int64).reshape(t, n)
    people, locations = [f"p{i}" for i in range(n)], [f"é{i}" for i in range(k)]
    back = matrix.unpack(matrix.pack(m, list(range(t)), people, locations, 0))
    assert (back[0] == m).all() and back[1:] == (list(range(t)), people, locations, 0)


def test_broken_buffers_are_errors():
    whole = matrix.pack(np.zeros((1, 1), int), [60], ["p"], ["x"], 1)
    for bad in (b"", whole[:-1], b"x" + whole[1:], whole[:8] + b"\x09" + whole[9:]):
        with pytest.raises(ValueError):
            matrix.unpack(bad)


def test_stream_counts_and_occupancy(spark, tmp_path):
    rows = [("a", "p1", "2024-01-01 00:05:00", 90), ("a", "p2", "2024-01-01 00:20:00", 5), ("a", "p3", "2024-01-01 01:10:00", 30)]
    df = spark.createDataFrame(rows, "place string, person_id string, ts string, stay_minutes int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("c", stream.counts(source), "complete"), ("o", stream.occupancy(source), "update")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.visits for r in spark.table("c").collect()) == [1, 2]
    assert [(r.arrived, r.present) for r in spark.table("o").collect()] == [(3, 2)]
