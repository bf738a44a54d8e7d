from pyspark.sql import functions as F

from zonalis.functions import calendar, geometry, ids, measures, parsers
from zonalis.operators import flows, places
from zonalis.sources import visits


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_area_ids(spark):
    raw = ["240010001001.0", "40010001001", " 240010001001 ", "2.40010001001e11", "12345678901", "bad", "123", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    got = [r.a for r in df.select("i", ids.area_id(F.col("x")).alias("a")).orderBy("i").collect()]
    assert got == ["240010001001", "040010001001", "240010001001", "240010001001", "012345678901", None, None, None, None]


def test_zip_slug_and_units(spark):
    r = one(spark, ids.zip_code(F.lit("12 345")), ids.zip_code(F.lit("74")), ids.slug(F.lit("  Saint-Mary's City ")), ids.city_unit(F.lit("New Town"), F.lit("ok"), F.lit("74002")), ids.city_unit(F.lit(" "), F.lit("ok"), F.lit("74002")))
    assert list(r) == ["12345", None, "saint-mary-s-city", "city:OK:new-town", "zip:74002"]


def test_ordered_distinct_keeps_first(spark):
    assert one(spark, ids.ordered_distinct(F.array(*map(F.lit, ("b", "a", "b")))).alias("x")).x == ["b", "a"]


def test_flow_graph_from_messy_maps(spark):
    """A bad place, a bad key, a row that is no JSON: the rest is summed."""
    rows = [("240010001001", '{"240010001001": 2, "240010002002": 3, "bad": 4}'), ("240010001001", '"{\\"240010002002\\": 7}"'), ("x", '{"240010002002": 1}'), ("240010001001", "garbage"), ("240010001001", None)]
    rec = flows.records(spark.createDataFrame(rows, "poi_cbg string, visitor_daytime_cbgs string"))
    assert [(r.cbg, r.self_weight) for r in flows.nodes(rec).orderBy("cbg").collect()] == [("240010001001", 2.0), ("240010002002", 0.0)]
    assert [tuple(r) for r in flows.edges(rec).collect()] == [("240010001001", "240010002002", 10.0)]
    assert {tuple(r) for r in flows.directed(rec).collect()} == {("240010001001", "240010001001", 2.0), ("240010002002", "240010001001", 10.0)}


def test_open_gate(spark):
    text, naics = F.lit('{"Mon":[["8:00","17:00"]]}'), F.lit("445110")
    mon, tue, none = one(spark, parsers.open_gate(text, naics, "Monday"), parsers.open_gate(text, naics, "Tuesday"), parsers.open_gate(F.lit(None).cast("string"), naics, "Monday"))
    assert (mon[10], mon[3]) == (1.0, 0.0)
    assert tue[10] == 1.0 and tue[3] > 0
    assert 0 < none[3] < 0.01


def test_hours_and_weekdays(spark):
    full, short, odd, days = one(spark, parsers.hours(F.lit(str(list(range(24))))), parsers.hours(F.lit("[1, 2]")), parsers.hours(F.lit(None).cast("string")), parsers.weekdays(F.lit("{'Monday': 3, 'Nosuch': 4}")))
    assert full == list(range(24)) and short == [0] * 24 and odd == [0] * 24
    assert days == [3.0, 0, 0, 0, 0, 0, 0]


def test_month_keys(spark):
    df = spark.createDataFrame([("2021-05-17",), ("2021-05-17T10:00:00Z",), (None,), ("soon",)], "x string")
    assert [r.m for r in df.select(calendar.month_key(F.col("x")).alias("m")).collect()] == ["2021-05", "2021-05", None, None]


def test_month_resolution(spark):
    import pytest

    files = spark.createDataFrame([("OK", m, f"p/{m}") for m in ("2021-03", "2021-05", "2021-08")], "state string, month string, path string")
    assert visits.resolve(files, ["OK"], "2021-05-02") == ["p/2021-05"]
    assert visits.resolve(files, ["OK"], None) == ["p/2021-08"]
    with pytest.raises(FileNotFoundError, match="2021-03, 2021-05, 2021-08"):
        visits.resolve(files, ["OK"], "2021-04-01")


def test_discovery_prefers_extensions(spark, tmp_path):
    (tmp_path / "OK").mkdir()
    for name in ("OK/2021-05-OK.csv", "OK/2021-05-OK.csv.gz", "2021-06-TX.csv", "notes.txt"):
        (tmp_path / name).write_text("poi_cbg\n240010001001.0\nx\n")
    got = {(r.state, r.month): r.path for r in visits.discover(spark, str(tmp_path)).collect()}
    assert set(got) == {("OK", "2021-05"), ("TX", "2021-06")} and got["OK", "2021-05"].endswith(".csv.gz")
    assert [r.poi_cbg for r in visits.read(spark, [got["TX", "2021-06"]]).collect()] == ["240010001001"]


def test_coverage(spark):
    df = spark.createDataFrame([("a", "[]"), ("b", "x"), ("", "{}"), (None, "nan"), ("c", "None")], "n string, t string")
    assert {r.field: r.percent for r in visits.coverage(df, ["n", "t", "absent"]).collect()} == {"n": 60.0, "t": 20.0, "absent": 0.0}
    assert {r.percent for r in visits.coverage(df.limit(0), ["n", "t"]).collect()} == {0.0}


def test_catchment(spark):
    homes = spark.createDataFrame([("p", "in", 30.0), ("p", "out", 70.0), ("q", "out", 100.0), ("z", "in", 0.0)], "placekey string, cbg string, weight double")
    got = {r.placekey: r.inside_share for r in places.catchment(homes, spark.createDataFrame([("in",)], "cbg string")).collect()}
    assert got == {"p": 0.3, "q": 0.0, "z": None}


def test_share_floor_and_median(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0001), ("c", 0.4), ("d", 0.6), ("e", None)], "placekey string, inside_share double")
    got = {r.placekey: r.inside_share for r in places.filled_share(df.where("placekey NOT IN ('a', 'b')")).collect()}
    assert got == {"c": 0.4, "d": 0.6, "e": 0.5}
    assert {r.inside_share for r in places.filled_share(df.where("placekey IN ('a', 'b')")).collect()} == {0.02}


def test_relative_weights_and_pick(spark):
    w = measures.relative_weights(*(F.lit(float(x)) for x in (10, 5, 30, 20, 35)))
    df = spark.range(40_000).select(measures.pick(ids.uniform("t", F.col("id")), w).alias("k"))
    got = {r.k: r.n / 40_000 for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}
    for k, share in zip((1, 2, 3, 4), (0.15, 0.30, 0.20, 0.35), strict=True):
        assert abs(got[k] - share) < 0.02


def test_polygons(spark):
    df = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), (2, "POINT (1 1)")], "id bigint, wkt string").select("id", geometry.rings(F.col("wkt")).alias("rings"))
    points = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (9.0, 9.0)], "x double, y double")
    assert {(r.x, r.polygon) for r in geometry.locate(points, df.where("rings IS NOT NULL"), 1.0).collect()} == {(0.5, 1), (1.5, None), (9.0, None)}
    assert df.where("rings IS NULL").count() == 1
