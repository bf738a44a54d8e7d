"""Queries by name, with the SQL that checks them. Names begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import buildings, calendar, geometry, ids, measures, parsers
from .operators import archive, destinations, flows, growth, movement, places, population, zones
from .plans import service
from .plans.views import SQL, Views
from .sources import matrix, visits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a function of ``Views`` under its name; ``sql`` may use the views' names."""

    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql is not None:
            recursive = sql.startswith("RECURSIVE ")
            body = sql.removeprefix("RECURSIVE ")
            head = "WITH RECURSIVE " if recursive else "WITH "
            between = "" if body.upper().startswith("SELECT") else ","  # more views, or the query
            ORACLE_SQL[name] = f"{head}{SQL.strip()}{between}\n{body}" if views else body
        return f

    return add


# Sources ------------------------------------------------------------------------------------


@query("SELECT 'poi-' || s_suppkey AS placekey, cbg AS poi_cbg, s_name AS location_name FROM supplier JOIN area ON s_nationkey = k WHERE r = 0")
def s1_scan_areas(v: Views) -> DataFrame:
    """Names lowered, ids normalised, rows of a set of areas."""
    return visits.normalise(v.patterns, v.cluster).select("placekey", "poi_cbg", "location_name")


@query("SELECT 'poi-' || s_suppkey AS placekey, cbg AS poi_cbg FROM supplier JOIN area ON s_nationkey = k WHERE r IN (1, 3)")
def s1_scan_zips(v: Views) -> DataFrame:
    return visits.normalise(v.patterns, zips=["10001", "10003"]).select("placekey", "poi_cbg")


@query("SELECT 'poi-' || s_suppkey AS placekey, CASE WHEN s_suppkey % 3 = 0 THEN cbg END AS poi_cbg FROM supplier JOIN area ON s_nationkey = k")
def s2_csv_ids(v: Views) -> DataFrame:
    """Rows of CSV text, of which only the float-formatted ids are numbers."""
    rows = v.patterns.select(F.concat_ws(",", "PLACEKEY", F.when(F.col("POI_CBG").endswith(".0"), F.col("POI_CBG")).otherwise("none")).alias("line"))
    return rows.select(F.from_csv("line", F.lit("PLACEKEY string, POI_CBG string")).alias("r")).select("r.*").select(F.col("PLACEKEY").alias("placekey"), ids.area_id(F.col("POI_CBG")).alias("poi_cbg"))


def _files(v: Views) -> DataFrame:
    return v.visits.select(F.substring("src", 4, 2).alias("state"), "month").distinct().withColumn("path", F.concat_ws("/", F.lit("visits"), "state", "month"))


@query("SELECT DISTINCT substr(src, 4, 2) AS state, month FROM visit")
def s4_months(v: Views) -> DataFrame:
    return visits.available_months(_files(v))


@query("SELECT state, max(month) AS month FROM (SELECT DISTINCT substr(src, 4, 2) AS state, month FROM visit) GROUP BY 1")
def s5_latest_month(v: Views) -> DataFrame:
    return _files(v).groupBy("state").agg(F.max("month").alias("month"))


@query("SELECT DISTINCT substr(src, 4, 2) AS state, month, 'visits/' || substr(src, 4, 2) || '/' || month AS path FROM visit WHERE month BETWEEN '1995-01' AND '1995-06'")
def f19_month_slice(v: Views) -> DataFrame:
    return visits.month_slice(_files(v), "1995-01", "1995-06")


@query("SELECT s.state, m.month FROM (SELECT DISTINCT substr(src, 4, 2) AS state FROM visit) s, (SELECT strftime(unnest(range(DATE '1991-10-01', DATE '1992-06-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) m EXCEPT SELECT DISTINCT substr(src, 4, 2), month FROM visit")
def u5_missing_months(v: Views) -> DataFrame:
    need = _files(v).select("state").distinct().withColumn("month", F.explode(calendar.month_range(F.lit("1991-10-01").cast("date"), F.lit("1992-05-01").cast("date"))))
    return visits.missing_months(need, _files(v))


_ZIPS = "zips AS (SELECT (10000 + z)::VARCHAR AS zip, cbg FROM (SELECT r AS z, cbg FROM area UNION ALL SELECT (r + 1) % 5, cbg FROM area WHERE k % 3 = 0)),\nfirst_zip AS (SELECT cbg, min(zip) AS zip FROM zips GROUP BY 1)"


@query(f"{_ZIPS} SELECT zip, row_number() OVER (PARTITION BY zip ORDER BY cbg) - 1 AS pos, cbg FROM zips")
def s16_zip_areas(v: Views) -> DataFrame:
    return visits.zip_areas(v.spark, v.zips).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"{_ZIPS} SELECT cbg, zip FROM first_zip")
def s17_area_zip(v: Views) -> DataFrame:
    return visits.area_zip(visits.zip_areas(v.spark, v.zips))


@query("SELECT DISTINCT (r + d) % 5 AS region FROM area, (VALUES (1), (2)) t(d) WHERE r IN (0, 3)")
def s20_neighbours(v: Views) -> DataFrame:
    table = v.area.select(F.col("r").cast("string").alias("code"), F.array((F.col("r") + 1) % 5, (F.col("r") + 2) % 5).alias("neighbours")).distinct()
    return visits.neighbours(table, ["0", "3"]).select(F.col("state").cast("int").alias("region"))


# Filters and identifiers ----------------------------------------------------------------------

_DIRTY = "dirty AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (240000000000 + o_orderkey)::VARCHAR || '.0' WHEN 1 THEN (40000000000 + o_orderkey)::VARCHAR WHEN 2 THEN ' ' || (240000000000 + o_orderkey) || ' ' WHEN 3 THEN 'bad' WHEN 4 THEN (24000 + o_orderkey)::VARCHAR END AS raw FROM orders)"


def _dirty(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda n: (F.lit(n).cast("bigint") + k).cast("string")
    raw = F.when(k % 6 == 0, F.concat(s(240000000000), F.lit(".0"))).when(k % 6 == 1, s(40000000000)).when(k % 6 == 2, F.concat(F.lit(" "), s(240000000000), F.lit(" "))).when(k % 6 == 3, "bad").when(k % 6 == 4, s(24000))
    return v.table("orders").select("o_orderkey", raw.alias("raw"))


@query(f"{_DIRTY} SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (240000000000 + o_orderkey)::VARCHAR WHEN 1 THEN '0' || (40000000000 + o_orderkey) WHEN 2 THEN (240000000000 + o_orderkey)::VARCHAR END AS cbg FROM dirty")
def f6_area_id(v: Views) -> DataFrame:
    return _dirty(v).select("o_orderkey", ids.area_id(F.col("raw")).alias("cbg"))


@query(f"{_DIRTY} SELECT o_orderkey, CASE WHEN d <> '' AND length(d) <= 12 THEN lpad(d, 12, '0') END AS cbg FROM (SELECT o_orderkey, regexp_replace(regexp_replace(trim(raw), '\\.0$', ''), '[^0-9]', '', 'g') AS d FROM dirty)")
def f7_digits_id(v: Views) -> DataFrame:
    return _dirty(v).select("o_orderkey", ids.digits_id(F.col("raw")).alias("cbg"))


@query(f"{_DIRTY} SELECT o_orderkey, CASE WHEN length(d) = 5 THEN d END AS zip FROM (SELECT o_orderkey, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM dirty)")
def f9_zip(v: Views) -> DataFrame:
    return _dirty(v).select("o_orderkey", ids.zip_code(F.col("raw")).alias("zip"))


@query("SELECT cbg, 'MD' AS state, substr(cbg, 3, 3) AS county FROM area")
def f14_state(v: Views) -> DataFrame:
    return v.area.select("cbg", ids.state_abbr(F.col("cbg")).alias("state"), ids.county_fips(F.col("cbg")).alias("county"))


@query("SELECT 'location_name' AS field, 100.0::DOUBLE AS percent UNION ALL SELECT 'top_category', round(100.0 * avg(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END), 1) FROM supplier UNION ALL SELECT 'open_hours', round(100.0 * avg(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END), 1) FROM supplier UNION ALL SELECT 'polygon_wkt', 0.0")
def f5_coverage(v: Views) -> DataFrame:
    return visits.coverage(v.patterns, ["location_name", "top_category", "open_hours", "polygon_wkt"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'P')", views=False)
def f11_where(v: Views) -> DataFrame:
    return visits.where(v.table("orders"), o_totalprice=(">", 100000), o_orderstatus=("in", ["F", "P"])).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1", views=False)
def f2_first_row(v: Views) -> DataFrame:
    return visits.first_row(v.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1", views=False)
def f3_last_row(v: Views) -> DataFrame:
    return visits.first_row(v.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", last=True)


# Flow graphs ---------------------------------------------------------------------------------

_READ = "readable AS (SELECT * FROM visit WHERE month = '1995-06' AND s_suppkey % 7 <> 0)"


@query(f"{_READ} SELECT src, dst, sum(weight) AS weight, count(DISTINCT s_suppkey) AS n FROM readable GROUP BY 1, 2")
def j1_flow_records(v: Views) -> DataFrame:
    """Visitor maps from JSON text, encoded once or twice; garbage gives no rows."""
    rows = flows.records(visits.normalise(v.patterns))
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


@query("SELECT * FROM edge")
def a1_edges(v: Views) -> DataFrame:
    return flows.edges(v.rec)


@query("SELECT * FROM flow")
def a2_directed(v: Views) -> DataFrame:
    return flows.directed(v.rec)


@query("SELECT * FROM node")
def a1_nodes(v: Views) -> DataFrame:
    return flows.nodes(v.rec)


_METRICS = """m AS (SELECT coalesce(sum(CASE WHEN u IN (FROM cluster) AND v IN (FROM cluster) THEN weight END), 0) AS i, coalesce(sum(CASE WHEN (u IN (FROM cluster)) <> (v IN (FROM cluster)) THEN weight END), 0) AS b FROM edge),
s AS (SELECT coalesce(sum(self_weight), 0) AS s FROM node WHERE cbg IN (FROM cluster)),
zone AS (SELECT i + s AS movement_inside, b AS movement_boundary FROM m, s)"""


@query(f"{_METRICS} SELECT movement_inside, movement_boundary, movement_inside / (movement_inside + movement_boundary) AS czi, 5::BIGINT AS cbg_count, (SELECT sum(population)::BIGINT FROM population WHERE cbg IN (FROM cluster)) AS population FROM zone")
def a3_zone_metrics(v: Views) -> DataFrame:
    return zones.metrics(flows.edges(v.rec), flows.nodes(v.rec), v.cluster, v.population)


@query("""n AS (SELECT c.cbg, coalesce(sum(CASE WHEN b IN (FROM cluster) THEN weight END), 0) / 2 AS i, coalesce(sum(CASE WHEN b NOT IN (FROM cluster) THEN weight END), 0) AS o FROM cluster c LEFT JOIN adj ON a = c.cbg GROUP BY 1),
t AS (SELECT cbg, i AS movement_in, o AS movement_out, CASE WHEN i + o > 0 THEN i / (i + o) ELSE 0 END AS ratio FROM n)
SELECT t.*, population, CASE WHEN ratio >= 0.8 THEN 'blue' WHEN ratio >= 0.6 THEN 'green' WHEN ratio >= 0.4 THEN 'yellow' WHEN ratio >= 0.2 THEN 'orange' ELSE 'red' END AS color FROM t JOIN population USING (cbg)""")
def a4_node_ratios(v: Views) -> DataFrame:
    return zones.node_ratios(flows.edges(v.rec), v.cluster, v.population)


_CAND = "cand AS (SELECT a AS cbg, coalesce(sum(CASE WHEN b IN (FROM cluster) THEN weight END), 0) AS inside, coalesce(sum(CASE WHEN b NOT IN (FROM cluster) THEN weight END), 0) AS outside, count(CASE WHEN b IN (FROM cluster) THEN 1 END) AS n FROM adj WHERE a NOT IN (FROM cluster) GROUP BY 1 HAVING n > 0)"


@query(f"{_CAND} SELECT cbg, inside, outside FROM cand")
def a5_candidates(v: Views) -> DataFrame:
    return zones.candidates(flows.edges(v.rec), v.cluster)


def _rank_sql(score: str, more: str = "", where: str = "TRUE") -> str:
    return f"{_CAND}{more} SELECT cbg, score, inside AS movement_inside, outside AS movement_outside, population, row_number() OVER (ORDER BY score DESC, cbg DESC)::INTEGER AS rank FROM (SELECT cand.*, population, {score} AS score FROM cand JOIN population USING (cbg) {'LEFT JOIN node USING (cbg) LEFT JOIN area USING (cbg)' if more else ''} WHERE {where})"


@query(_rank_sql("inside"))
def g9_frontier_weight(v: Views) -> DataFrame:
    return zones.frontier(flows.edges(v.rec), flows.nodes(v.rec), v.population, v.cluster, "weight")


@query(_rank_sql("inside / (inside + outside)"))
def g9_frontier_ratio(v: Views) -> DataFrame:
    return zones.frontier(flows.edges(v.rec), flows.nodes(v.rec), v.population, v.cluster, "ratio")


_KM = measures.haversine_sql("30.0", "-100.0", "lat", "lon")


@query(_rank_sql(f"round(((SELECT movement_inside FROM zone) + self_weight + inside) / ((SELECT movement_inside + movement_boundary FROM zone) + self_weight + outside) - 0.02 * {_KM} / ({_KM} + 20), 9)", f", {_METRICS}", "population > 0"))
def g9_frontier_czi(v: Views) -> DataFrame:
    seed = "240000000000"
    out = zones.frontier(flows.edges(v.rec), flows.nodes(v.rec), v.population, v.cluster, "czi", seed, v.centers)
    return out.withColumn("score", F.round("score", 9))


@query(f"flow2 AS (SELECT coalesce(sum(CASE WHEN s AND d THEN weight END), 0) AS internal, coalesce(sum(CASE WHEN s AND NOT d THEN weight END), 0) AS out_origin, coalesce(sum(CASE WHEN d AND NOT s THEN weight END), 0) AS out_dest FROM (SELECT weight, src IN (FROM cluster) AS s, dst IN (FROM cluster) AS d FROM flow)) SELECT *, internal / (internal + out_origin) AS origin_containment, internal / (internal + out_dest) AS destination_containment, least(internal / (internal + out_origin), internal / (internal + out_dest)) AS zone_containment FROM flow2")
def a6_containment(v: Views) -> DataFrame:
    return zones.containment(flows.directed(v.rec), v.cluster)


@query("SELECT cbg, sum(weight) AS total FROM (SELECT src AS cbg, weight FROM flow UNION ALL SELECT dst, weight FROM flow WHERE src <> dst) GROUP BY 1")
def a7_total_flow(v: Views) -> DataFrame:
    return zones.total_flow(flows.directed(v.rec))


@query("""RECURSIVE reach AS (SELECT min(cbg) AS cbg FROM cluster UNION SELECT b FROM reach JOIN adj ON a = cbg WHERE b IN (FROM cluster)) SELECT cbg FROM reach""")
def g14_reachable(v: Views) -> DataFrame:
    """Members that the first of them reaches within the zone."""
    from .operators.checkpoints import ensure

    ensure(v.spark)
    return zones.reachable(flows.edges(v.rec), v.cluster, v.cluster.orderBy("cbg").limit(1))


@query("SELECT iteration, cbg, score, selected, rank FROM (SELECT month AS iteration, src AS cbg, sum(weight) AS score, src LIKE '%5' AS selected, row_number() OVER (PARTITION BY month ORDER BY sum(weight) DESC, src DESC)::INTEGER AS rank FROM visit WHERE month < '1995-04' GROUP BY 1, 2) WHERE rank <= 3 OR selected")
def w9_trace_rank(v: Views) -> DataFrame:
    rows = v.visits.where("month < '1995-04'").groupBy(F.col("month").alias("iteration"), F.col("src").alias("cbg")).agg(F.sum("weight").alias("score")).withColumn("selected", F.col("cbg").endswith("5"))
    return zones.trace_rank(rows, keep=3).select("iteration", "cbg", "score", "selected", "rank")


@query("SELECT label, coalesce(sum(CASE WHEN same THEN weight END), 0) AS intra, coalesce(sum(CASE WHEN NOT same THEN weight END), 0) AS inter FROM (SELECT x.r AS label, weight, x.r = y.r AS same FROM edge JOIN area x ON u = x.cbg JOIN area y ON v = y.cbg UNION ALL SELECT y.r, weight, FALSE FROM edge JOIN area x ON u = x.cbg JOIN area y ON v = y.cbg WHERE x.r <> y.r) GROUP BY 1")
def a21_inertia(v: Views) -> DataFrame:
    return zones.inertia(flows.edges(v.rec), v.area.select("cbg", F.col("r").alias("label")))


_WALK = "walk AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS p FROM adj), start AS (SELECT DISTINCT a AS cbg, CASE WHEN a = (SELECT min(a) FROM adj) THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM adj), r0 AS (SELECT cbg, s AS r FROM start)" + "".join(f", r{i + 1} AS (SELECT start.cbg, coalesce(m, 0) * 0.85 + s * (1 - 0.85) AS r FROM start LEFT JOIN (SELECT b AS cbg, sum(r * p) AS m FROM walk JOIN r{i} ON a = r{i}.cbg GROUP BY 1) USING (cbg))" for i in range(10))


@query(f"{_WALK} SELECT cbg, round(r, 9) AS rank FROM r10")
def g15_page_rank(v: Views) -> DataFrame:
    from .operators.checkpoints import ensure

    ensure(v.spark)
    edge = flows.edges(v.rec).cache()
    seed = edge.agg(F.min(F.least("u", "v"))).first()[0]
    return zones.page_rank(edge, seed, rounds=10).withColumn("rank", F.round("rank", 9))


_SWEEP = "ord AS (SELECT cbg, row_number() OVER (ORDER BY population DESC, cbg) AS pos FROM population WHERE population >= 1 AND cbg IN (SELECT a FROM adj))"


@query(f"{_SWEEP}, step AS (SELECT x.cbg, x.pos, sum(weight) AS vol, sum(CASE WHEN y.pos < x.pos THEN -weight ELSE weight END) AS cut FROM adj JOIN ord x ON a = x.cbg LEFT JOIN ord y ON b = y.cbg GROUP BY 1, 2), run AS (SELECT cbg, pos, sum(cut) OVER (ORDER BY pos) AS cut, sum(vol) OVER (ORDER BY pos) AS volume FROM step) SELECT cbg, pos::INTEGER AS pos, cut, volume, CASE WHEN least(volume, (SELECT sum(weight) FROM adj) - volume) <> 0 THEN cut / least(volume, (SELECT sum(weight) FROM adj) - volume) END AS conductance FROM run")
def w13_sweep(v: Views) -> DataFrame:
    edge = flows.edges(v.rec)
    rank = v.population.join(flows.adjacency(edge).select(F.col("a").alias("cbg")).distinct(), "cbg", "left_semi").select("cbg", F.col("population").alias("rank"))
    return zones.sweep(edge, rank, 1)


#: Every area: nation k of the driver's tables lies in region k modulo 5.
_AREAS = [f"24{k % 5:03d}{k:07d}" for k in range(25)]


@query("SELECT a AS cbg, " + ", ".join(f"coalesce(sum(CASE WHEN b = '{x}' THEN weight END), 0)::DOUBLE AS \"{x}\"" for x in _AREAS) + " FROM adj GROUP BY 1")
def k9_matrix(v: Views) -> DataFrame:
    return flows.adjacency_matrix(flows.edges(v.rec), _AREAS)


_DWELL = "dw AS (SELECT 'poi-' || s_suppkey AS place, src AS cbg, floor(sum(weight) * (s_suppkey % 200)) AS weight FROM visit WHERE month = '1995-06' GROUP BY s_suppkey, src HAVING floor(sum(weight) * (s_suppkey % 200)) > 0)"


@query(f"{_DWELL} SELECT * FROM dw")
def g17_dwell_graph(v: Views) -> DataFrame:
    return flows.dwell_records(visits.normalise(v.patterns))


@query(f"{_DWELL} SELECT place, cbg, CASE WHEN km > 0 THEN floor(weight / km) ELSE weight END AS weight FROM dw JOIN (SELECT 'poi-' || s_suppkey AS place, (s_suppkey % 12)::DOUBLE AS km FROM supplier) USING (place)")
def g18_distance_graph(v: Views) -> DataFrame:
    km = v.table("supplier").select(F.concat(F.lit("poi-"), "s_suppkey").alias("place"), (F.col("s_suppkey") % 12 + 0.5).alias("km"))
    return flows.distance_weighted(flows.dwell_records(visits.normalise(v.patterns)), km)


@query(f"{_DWELL} SELECT DISTINCT place AS id, 'place' AS kind FROM dw UNION SELECT DISTINCT cbg, 'area' FROM dw")
def g19_bipartite(v: Views) -> DataFrame:
    return flows.bipartite_nodes(flows.dwell_records(visits.normalise(v.patterns)))


# Zones ---------------------------------------------------------------------------------------


def _run(v: Views, name: str, people: int, **given: float) -> DataFrame:
    p = F.create_map(*(F.lit(str(x)) for kv in given.items() for x in kv)) if given else F.lit(None).cast("map<string,string>")
    run = v.cluster.orderBy("cbg").limit(1).select(F.lit(name).alias("run_id"), F.lit(name).alias("algorithm"), F.col("cbg").alias("seed"), F.lit(people).alias("min_pop"), p.alias("parameters"))
    return growth.build(run, flows.directed(v.rec), v.population, v.centers)


def _grow_sql(score: str, where: str = "TRUE", having: str = "TRUE") -> str:
    return f"""RECURSIVE grow AS (
  SELECT 0 AS it, [(SELECT min(cbg) FROM cluster)] AS members, (SELECT population FROM population WHERE cbg = (SELECT min(cbg) FROM cluster)) AS people
  UNION ALL
  SELECT it + 1, list_append(members, c.cbg), people + c.population FROM grow, LATERAL (
    SELECT a AS cbg, coalesce(population, 0) AS population, {score} AS score FROM adj LEFT JOIN population p ON p.cbg = a
    WHERE NOT list_contains(members, a) AND {where} GROUP BY a, population
    HAVING count(CASE WHEN list_contains(members, b) THEN 1 END) > 0 AND {having} ORDER BY score DESC, a LIMIT 1) c
  WHERE people < 400)
SELECT i::INTEGER AS position, members[i] AS cbg, people AS zone_population FROM (SELECT members, people, unnest(range(1, len(members) + 1)) AS i FROM grow WHERE it = (SELECT max(it) FROM grow))"""


_IN = "sum(CASE WHEN list_contains(members, b) THEN weight ELSE 0 END)"


@query(_grow_sql(_IN, "population <> 0", f"{_IN} > 0"))
def g1_greedy_fast(v: Views) -> DataFrame:
    return _run(v, "greedy_fast", 400).select("position", "cbg", "zone_population")


@query(_grow_sql(_IN))
def g2_greedy_weight(v: Views) -> DataFrame:
    return _run(v, "greedy_weight", 400).select("position", "cbg", "zone_population")


@query()
def g3_seed_guard(v: Views) -> DataFrame:
    return _run(v, "greedy_weight_seed_guard", 400, seed_guard_distance_km=600.0).select("position", "cbg", "zone_population")


@query(_grow_sql(f"{_IN} / sum(weight)"))
def g4_greedy_ratio(v: Views) -> DataFrame:
    return _run(v, "greedy_ratio", 400).select("position", "cbg", "zone_population")


@query()
def g5_czi_balanced(v: Views) -> DataFrame:
    return _run(v, "czi_balanced", 400).select("position", "cbg", "zone_population")


@query()
def g6_ttwa(v: Views) -> DataFrame:
    return _run(v, "greedy_ttwa", 400).select("position", "cbg", "zone_population", "info")


@query()
def g7_mobility_prune(v: Views) -> DataFrame:
    return _run(v, "mobility_prune", 400, mobility_prune_min_seed_capture=0.7, floor=500.0).select("position", "cbg", "zone_population", "info")


@query()
def g8_optimal_cap(v: Views) -> DataFrame:
    return _run(v, "czi_optimal_cap", 300).select("position", "cbg", "zone_population", "info")


@query()
def g16_ratio_whole(v: Views) -> DataFrame:
    return _run(v, "greedy_ratio_whole", 300).select("position", "cbg", "zone_population")


# Places --------------------------------------------------------------------------------------


@query(f"""{_READ}, top AS (SELECT 'poi-' || s_suppkey AS place, s_name AS location_name, sum(CASE WHEN src IN (FROM cluster) THEN weight END) AS flow, count(*)::DOUBLE AS visits, count(DISTINCT src)::DOUBLE AS visitors
  FROM readable JOIN supplier USING (s_suppkey) WHERE dst = (SELECT max(cbg) FROM cluster) GROUP BY 1, 2 HAVING flow IS NOT NULL ORDER BY flow DESC, visits DESC, location_name DESC LIMIT 8)
SELECT place, location_name, round(flow, 2) AS cluster_flow, round(visits, 2) AS raw_visit_counts, round(visitors, 2) AS raw_visitor_counts, 1::BIGINT AS n_rows, round(flow / sum(flow) OVER (), 4) AS flow_share FROM top""")
def g12_candidate_places(v: Views) -> DataFrame:
    area = v.cluster.agg(F.max("cbg")).first()[0]
    return places.candidates(visits.normalise(v.patterns), area, v.cluster)


_NORM = "norm AS (SELECT s_suppkey, count(*)::DOUBLE AS n FROM visit WHERE month = '1995-06' GROUP BY 1)"


@query(f"{_NORM} SELECT coalesce(median((n * (s_suppkey % 9 + 1)) / n) / 30, 19.7) AS factor FROM norm")
def a11_panel_factor(v: Views) -> DataFrame:
    return places.panel_factor(visits.normalise(v.patterns))


_SHARE = "sh AS (SELECT 'poi-' || s_suppkey AS placekey, coalesce(sum(CASE WHEN src IN (FROM cluster) THEN weight END), 0) / sum(weight) AS inside_share FROM visit WHERE month = '1995-06' GROUP BY 1), allsh AS (SELECT 'poi-' || s_suppkey AS placekey, inside_share FROM supplier LEFT JOIN sh ON placekey = 'poi-' || s_suppkey)"


def _shares(v: Views) -> DataFrame:
    p = visits.normalise(v.patterns)
    homes = p.select("placekey", F.explode(parsers.home_map(F.col("visitor_home_cbgs"))).alias("e")).select("placekey", F.col("e.area").alias("cbg"), F.col("e.weight").alias("weight"))
    return p.select("placekey").join(places.catchment(homes, v.cluster), "placekey", "left")


@query(f"{_SHARE} SELECT * FROM allsh")
def a13_catchment(v: Views) -> DataFrame:
    return _shares(v)


_FILLED = f"{_SHARE}, filled AS (SELECT placekey, greatest(coalesce(inside_share, (SELECT coalesce(median(inside_share), 1.0) FROM allsh)), 0.02) AS inside_share FROM allsh)"


@query(f"{_FILLED} SELECT * FROM filled")
def a12_filled_share(v: Views) -> DataFrame:
    return places.filled_share(_shares(v))


@query("""pl AS (SELECT 'poi-' || s_suppkey AS placekey, CASE WHEN s_suppkey % 4 <> 0 THEN 'cat' || (s_suppkey % 4) END AS cat, CASE WHEN s_suppkey % 6 <> 0 AND s_suppkey % 11 <> 0 THEN s_suppkey::DOUBLE END AS good FROM supplier),
med AS (SELECT cat, median(good) AS own FROM pl GROUP BY 1)
SELECT placekey, coalesce(good, own, (SELECT median(good) FROM pl), 650.0) AS area FROM pl JOIN med ON pl.cat IS NOT DISTINCT FROM med.cat""")
def j7_filled_area(v: Views) -> DataFrame:
    return places.filled_area(visits.normalise(v.patterns)).select("placekey", F.col("wkt_area_sq_meters").alias("area"))


_STATS = """st AS (SELECT s_suppkey AS k, 'poi-' || s_suppkey AS placekey, greatest(1, ceil((s_suppkey % 200) / 60.0))::INTEGER AS dwell, s_suppkey % 10 AS mon, s_suppkey % 13 AS fri FROM supplier),
gate AS (SELECT k, h, CASE WHEN k % 2 = 0 THEN CASE WHEN h BETWEEN 8 AND 16 THEN 1.0 ELSE 0.0 END
  ELSE CASE k % 4 WHEN 0 THEN CASE WHEN h BETWEEN 8 AND 20 THEN 1.0 ELSE 0.001 END WHEN 1 THEN CASE WHEN h BETWEEN 6 AND 22 THEN 1.0 ELSE 0.001 END WHEN 2 THEN 1.0 ELSE CASE WHEN h BETWEEN 7 AND 17 THEN 1.0 ELSE 0.001 END END END AS g FROM st, range(24) t(h))"""


@query(f"{_STATS} SELECT placekey, dwell, h::INTEGER AS hour, ((h * 7 + st.k) % 50)::BIGINT AS hour_count, CASE WHEN mon + fri > 0 THEN mon * 7.0::DOUBLE / (mon + fri) ELSE 1.0 END AS monday, g::DOUBLE AS gate FROM st JOIN gate USING (k)")
def m6_place_stats(v: Views) -> DataFrame:
    """Dwell, hourly counts, Monday's factor and gate of every place."""
    s = places.stats(visits.normalise(v.patterns))
    return s.select("placekey", "dwell", F.posexplode("hours").alias("hour", "hour_count"), F.col("days")[0].alias("monday"), F.col("gates")[0].alias("gates")).select("placekey", "dwell", "hour", "hour_count", "monday", F.col("gates")[F.col("hour")].alias("gate"))


@query(f"{_FILLED}, {_STATS} SELECT placekey, h::INTEGER AS hour, floor((((h * 7 + st.k) % 50) * CASE WHEN mon + fri > 0 THEN mon * 7.0::DOUBLE / (mon + fri) ELSE 1.0 END * g::DOUBLE * inside_share * 3.0) + 0.5)::BIGINT AS target FROM st JOIN gate USING (k) JOIN filled USING (placekey)")
def m7_targets(v: Views) -> DataFrame:
    return places.targets(places.stats(visits.normalise(v.patterns)), places.filled_share(_shares(v)), 3.0, 0)


@query("g AS (SELECT p_size AS group_id, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', ' ', 'g')) AS norm, count(*) AS n, min(p_type) AS s FROM part GROUP BY 1, 2) SELECT group_id, norm, s AS display, n FROM g QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, norm) = 1")
def a20_common_names(v: Views) -> DataFrame:
    return places.common_names(v.table("part").select(F.col("p_size").alias("group_id"), F.col("p_type").alias("location_name")))


@query("SELECT p_size AS group_id, count(*) AS members FROM part GROUP BY 1 HAVING count(*) >= 30 AND bool_or(contains(lower(p_type), 'a')) AND bool_or(p_brand IN ('Brand#11', 'Brand#12', 'Brand#21'))", views=False)
def f13_filter_groups(v: Views) -> DataFrame:
    rows = v.table("part").select(F.col("p_size").alias("group_id"), F.col("p_type").alias("location_name"), F.col("p_brand").alias("region"))
    return places.filter_groups(rows, 30, contains="A", regions=["Brand#11", "Brand#12", "Brand#21"])


@query("SELECT 'poi-' || s_suppkey AS placekey, s_name AS location_name FROM supplier JOIN area ON s_nationkey = k WHERE r IN (0, 1) AND (contains(s_name, '7') OR contains(lower(s_name), '3'))")
def f12_select_places(v: Views) -> DataFrame:
    areas = [r.cbg for r in v.area.where("r IN (0, 1)").select("cbg").collect()]
    return places.select_places(visits.normalise(v.patterns), areas, contains=["7", "3"]).select("placekey", "location_name")


@query("n AS (SELECT s_suppkey, count(*) AS n, count(DISTINCT src) AS m FROM visit WHERE month = '1995-06' GROUP BY 1) SELECT cbg AS poi_cbg, 'poi-' || s_suppkey AS placekey, rank FROM (SELECT *, row_number() OVER (PARTITION BY cbg ORDER BY n DESC NULLS LAST, m DESC NULLS LAST, s_name DESC)::INTEGER AS rank FROM supplier JOIN area ON s_nationkey = k LEFT JOIN n USING (s_suppkey)) WHERE rank <= 2")
def w10_top_by_area(v: Views) -> DataFrame:
    return places.top_by_area(visits.normalise(v.patterns), 2).select("poi_cbg", "placekey", "rank")


_TAGS = "tag AS (SELECT p_partkey, ['house', 'yes', 'church', 'terrace', 'building', 'ruin'][p_partkey % 6 + 1] AS b, CASE WHEN p_partkey % 5 = 0 THEN 'shop' END AS shop, CASE WHEN p_partkey % 7 = 0 THEN 'residential' WHEN p_partkey % 11 = 0 THEN 'farm' END AS land, p_retailprice AS area FROM part)"


def _tagged(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("house", "yes", "church", "terrace", "building", "ruin"))), (k % 6 + 1).cast("int"))
    land = F.when(k % 7 == 0, "residential").when(k % 11 == 0, "farm")
    tags = F.map_filter(F.create_map(F.lit("building"), kind, F.lit("shop"), F.when(k % 5 == 0, "shop"), F.lit("landuse"), land), lambda _, x: x.isNotNull())
    return v.table("part").select("p_partkey", tags.alias("tags"), F.col("p_retailprice").alias("area"))


@query(f"{_TAGS} SELECT p_partkey, CASE WHEN b IN ('church', 'ruin') THEN FALSE WHEN b IN ('house', 'terrace') THEN TRUE ELSE shop IS NULL AND coalesce(land, 'residential') = 'residential' END AS home, coalesce(land = 'residential', FALSE) AS land, least(greatest(area, 25.0), 2500.0) * CASE b WHEN 'terrace' THEN 1.6 WHEN 'house' THEN 1.0 WHEN 'yes' THEN 0.35 WHEN 'building' THEN 0.35 ELSE 0.2 END::DOUBLE AS weight FROM tag")
def f16_buildings(v: Views) -> DataFrame:
    t = F.col("tags")
    return _tagged(v).select("p_partkey", buildings.is_home(t).alias("home"), buildings.is_home_land(t).alias("land"), buildings.building_weight(t, F.col("area")).alias("weight"))


# Destinations ----------------------------------------------------------------------------------

_DEST = f"""{_ZIPS},
units AS (SELECT cbg, zip, CASE WHEN zip <> '10002' THEN 'city:MD:town-' || zip ELSE 'zip:' || zip END AS unit FROM first_zip),
fa AS (SELECT cbg, sum(o) AS outbound, sum(i) AS inbound FROM (SELECT dst AS cbg, weight AS o, 0 AS i FROM flow WHERE src IN (FROM cluster) AND dst NOT IN (FROM cluster) UNION ALL SELECT src, 0, weight FROM flow WHERE dst IN (FROM cluster) AND src NOT IN (FROM cluster)) GROUP BY 1),
du AS (SELECT unit, sum(outbound) AS outbound, sum(inbound) AS inbound, sum(outbound + inbound) AS bidirectional, sum(population)::BIGINT AS population FROM fa JOIN units USING (cbg) JOIN population USING (cbg) WHERE unit NOT IN (SELECT unit FROM units WHERE cbg IN (FROM cluster)) GROUP BY 1)"""


def _units(v: Views) -> DataFrame:
    zips = visits.area_zip(visits.zip_areas(v.spark, v.zips))
    cities = zips.select("zip").distinct().select("zip", F.when(F.col("zip") != "10002", F.concat(F.lit("Town "), "zip")).alias("city"), F.lit("md").alias("state"))
    return destinations.units(zips, cities)


def _by_unit(v: Views) -> DataFrame:
    flow = flows.directed(v.rec)
    return destinations.by_unit(destinations.flows_by_area(flow, v.cluster), _units(v), v.cluster, v.population)


@query(f"{_DEST} SELECT * FROM fa")
def g11_flows_by_area(v: Views) -> DataFrame:
    return destinations.flows_by_area(flows.directed(v.rec), v.cluster)


@query("SELECT coalesce(sum(CASE WHEN src IN (FROM cluster) THEN weight END), 0) AS movement, coalesce(sum(CASE WHEN src IN (FROM cluster) AND dst NOT IN (FROM cluster) THEN weight END), 0) AS external_outbound, coalesce(sum(CASE WHEN dst IN (FROM cluster) AND src NOT IN (FROM cluster) THEN weight END), 0) AS external_inbound FROM flow")
def g11_seed_movement(v: Views) -> DataFrame:
    return destinations.seed_movement(flows.directed(v.rec), v.cluster)


@query(f"""{_DEST}, sh2 AS (SELECT *, outbound / sum(outbound) OVER () AS share, bidirectional / sum(bidirectional) OVER () AS flow_share, row_number() OVER (ORDER BY outbound DESC, bidirectional DESC, population, unit) AS rank FROM du)
SELECT unit, outbound, inbound, bidirectional, population, rank::INTEGER AS rank, round(share, 9) AS share, round(least(1.0, sum(share) OVER (ORDER BY rank)), 9) AS captured_share, round(least(1.0, sum(flow_share) OVER (ORDER BY rank)), 9) AS captured_flow_share FROM sh2""")
def g11_destinations(v: Views) -> DataFrame:
    r = destinations.ranked(_by_unit(v))
    return r.select("unit", "outbound", "inbound", "bidirectional", "population", "rank", *(F.round(c, 9).alias(c) for c in ("share", "captured_share", "captured_flow_share")))


@query()
def g11_gateways(v: Views) -> DataFrame:
    return destinations.gateways(_by_unit(v)).select("unit", F.explode("gateways").alias("cbg"))


@query()
def g11_recommended(v: Views) -> DataFrame:
    return destinations.recommend(destinations.ranked(_by_unit(v)), 100).select("unit", "rank", "recommended")


@query(f"{_DEST} SELECT unit AS label, list_sort(list(DISTINCT cbg)) AS cbgs FROM units WHERE unit IN (SELECT unit FROM units WHERE zip = '10001') GROUP BY 1")
def g13_seed_region(v: Views) -> DataFrame:
    zips = visits.area_zip(visits.zip_areas(v.spark, v.zips))
    cities = zips.select("zip").distinct().select("zip", F.when(F.col("zip") != "10002", F.concat(F.lit("Town "), "zip")).alias("city"), F.lit("md").alias("state"))
    return destinations.seed_region(zips, cities, "10001")


# Functions -------------------------------------------------------------------------------------


@query(f"SELECT x.cbg AS a, y.cbg AS b, round({measures.haversine_sql('x.lat', 'x.lon', 'y.lat', 'y.lon')}, 6) AS km FROM area x JOIN area y ON x.r = y.r WHERE x.cbg < y.cbg")
def p11_haversine(v: Views) -> DataFrame:
    a, b = v.area.select("r", F.col("cbg").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa")), v.area.select("r", F.col("cbg").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    return a.join(b, "r").where("a < b").select("a", "b", F.round(measures.haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")), 6).alias("km"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders", views=False)
def p14_month_key(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return v.table("orders").select("o_orderkey", calendar.month_key(text).alias("month"))


@query("SELECT o_orderkey, (date_diff('second', greatest(o_orderdate, date_trunc('month', o_orderdate)), least(o_orderdate + INTERVAL 40 DAY, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 SECOND)) // 60 + 1)::BIGINT AS minutes FROM orders", views=False)
def p14_minutes(v: Views) -> DataFrame:
    end = F.col("o_orderdate") + F.expr("interval 40 days")
    return v.table("orders").select("o_orderkey", calendar.minutes_in_month(F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderdate").cast("timestamp"), end.cast("timestamp")).alias("minutes"))


@query("SELECT h::INTEGER AS hour, h BETWEEN 8 AND 16 AS mon, h >= 22 OR h <= 2 AS sat, TRUE AS sun FROM range(24) t(h)", views=False)
def p6_open_hours(v: Views) -> DataFrame:
    text = v.patterns.where("open_hours IS NOT NULL").select("open_hours")
    days = text.select(*(parsers.open_hours(F.col("open_hours"), d).alias(n) for d, n in (("Monday", "mon"), ("Saturday", "sat"), ("Sunday", "sun")))).distinct()
    days = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return days.select("hour", *(F.array_contains(n, F.col("hour")).alias(n) for n in ("mon", "sat", "sun")))


# Geometry ----------------------------------------------------------------------------------------


def _polygons(v: Views) -> DataFrame:
    return v.squares.select("id", geometry.rings(F.col("wkt")).alias("rings"))


@query("SELECT x.n_nationkey::BIGINT AS a, y.n_nationkey::BIGINT AS b FROM nation x, nation y WHERE x.n_nationkey <> y.n_nationkey AND abs(x.n_nationkey % 5 - y.n_nationkey % 5) <= 1 AND abs(x.n_nationkey // 5 - y.n_nationkey // 5) <= 1", views=False)
def j8_touching(v: Views) -> DataFrame:
    return geometry.touching(_polygons(v))


@query("SELECT c_custkey, (c_custkey * 37 % 600) / 100.0::DOUBLE + 0.005 AS x, (c_custkey * 53 % 500) / 100.0::DOUBLE + 0.005 AS y, CASE WHEN c_custkey * 37 % 600 < 500 THEN (c_custkey * 53 % 500) // 100 * 5 + (c_custkey * 37 % 600) // 100 END::BIGINT AS polygon FROM customer", views=False)
def j9_locate(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    points = v.table("customer").select("c_custkey", ((k * 37 % 600) / 100 + F.lit(0.005)).alias("x"), ((k * 53 % 500) / 100 + F.lit(0.005)).alias("y"))
    return geometry.locate(points, _polygons(v), 0.75)


@query("SELECT 0.0::DOUBLE AS min_x, 0.0::DOUBLE AS min_y, 5.0::DOUBLE AS max_x, 5.0::DOUBLE AS max_y, 2.5::DOUBLE AS center_x, 2.5::DOUBLE AS center_y", views=False)
def a19_bounds(v: Views) -> DataFrame:
    return geometry.bounds(_polygons(v))


@query("bord AS (SELECT x.k AS a, y.k AS b FROM area x, area y WHERE x.k <> y.k AND abs(x.k % 5 - y.k % 5) <= 1 AND abs(x.k // 5 - y.k // 5) <= 1) SELECT a::BIGINT AS cbg, count(DISTINCT b) AS n FROM bord JOIN area z ON b = z.k AND z.r = 0 JOIN area w ON a = w.k AND w.r <> 0 GROUP BY 1 HAVING count(DISTINCT b) >= 2")
def g21_holes(v: Views) -> DataFrame:
    return zones.holes(geometry.touching(_polygons(v)), v.area.where("r = 0").select(F.col("k").cast("bigint").alias("cbg")))


@query()
def k11_geojson(v: Views) -> DataFrame:
    return geometry.feature_collection(_polygons(v), ["id"])


# Population --------------------------------------------------------------------------------------

_COUNTY = "county AS (SELECT substr(cbg, 3, 3) AS county, sum(population)::BIGINT AS total_population, floor(sum(population) / 2) AS total_households FROM area JOIN population USING (cbg) GROUP BY 1)"


@query(f"{_COUNTY} SELECT cbg, county, floor(total_households * population / total_population)::BIGINT AS households FROM population JOIN county ON county = substr(cbg, 3, 3) WHERE county <> '000'")
def m1_household_counts(v: Views) -> DataFrame:
    return population.household_counts(v.population, v.counties)


def _households(v: Views) -> DataFrame:
    return population.households(population.household_counts(v.population, v.counties), v.counties)


def _persons(v: Views) -> DataFrame:
    return population.persons(_households(v), v.counties)


@query(f"{_COUNTY}, hc AS (SELECT cbg, county, floor(total_households * population / total_population)::BIGINT AS n, total_households FROM population JOIN county ON county = substr(cbg, 3, 3) WHERE county <> '000'), hh AS (SELECT cbg, cbg || '-' || i AS household_id, total_households AS h FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM hc)) SELECT household_id, cbg, CASE WHEN {ids.uniform_sql(chr(39) + '42' + chr(39), 'household_id', chr(39) + 'gender' + chr(39))} < floor(h / 2) / h THEN 'M' ELSE 'F' END AS head_gender, {ids.uniform_sql(chr(39) + '42' + chr(39), 'household_id', chr(39) + 'partner' + chr(39))} < CASE WHEN {ids.uniform_sql(chr(39) + '42' + chr(39), 'household_id', chr(39) + 'family' + chr(39))} < floor(h * 2 / 3) / h THEN (floor(h / 3) + floor(h / 50)) / floor(h * 2 / 3) ELSE (floor(h / 20) + floor(h / 90)) / (h - floor(h * 2 / 3)) END AS partner FROM hh")
def m2_households(v: Views) -> DataFrame:
    return _households(v).select("household_id", "cbg", "head_gender", "partner")


@query()
def m3_persons(v: Views) -> DataFrame:
    return _persons(v)


@query()
def m4_homes(v: Views) -> DataFrame:
    b = v.table("customer").join(v.area, F.col("c_nationkey") == F.col("k")).select("cbg", (F.col("lat") + F.col("c_custkey") % 10 * 0.01).alias("lat"), (F.col("lon") + F.col("c_custkey") % 7 * 0.01).alias("lon"), buildings.building_weight(F.create_map(F.lit("building"), F.lit("house")), F.col("c_acctbal")).alias("weight"))
    return population.homes(_households(v), v.centers, b)


@query()
def a15_validation(v: Views) -> DataFrame:
    return population.validation(_persons(v))


@query("c AS (SELECT r, count(*) AS people, sum(CASE WHEN r <> 2 THEN 1 ELSE 0 END) AS n FROM customer JOIN area ON c_nationkey = k GROUP BY 1) SELECT r, c.people, CASE WHEN r <> 2 THEN c.n ELSE round_even(t.n * (c.people / t.people), 0) END::BIGINT AS n FROM c, (SELECT sum(n)::DOUBLE AS n, sum(people)::DOUBLE AS people FROM c) t")
def a18_impute(v: Views) -> DataFrame:
    c = v.table("customer").join(v.area, F.col("c_nationkey") == F.col("k")).groupBy("r").agg(F.count("*").alias("people")).withColumn("n", F.when(F.col("r") != 2, F.col("people")))
    state = c.agg(F.sum("people").alias("people"), F.sum("n").alias("n"))
    return population.impute(c, state, ["n"], "people")


@query("SELECT c_custkey // 3 AS home, min(c_nationkey) AS nation, count(*) AS members FROM customer GROUP BY 1", views=False)
def a16_households(v: Views) -> DataFrame:
    return v.table("customer").groupBy(F.floor(F.col("c_custkey") / 3).alias("home")).agg(F.min("c_nationkey").alias("nation"), F.count("*").alias("members"))


# Movement ------------------------------------------------------------------------------------------

_PEOPLE = "people AS (SELECT r::VARCHAR AS zone, lpad(c_custkey::VARCHAR, 9, '0') AS person_id, (c_custkey // 3)::VARCHAR AS home FROM customer JOIN area ON c_nationkey = k)"
_NEED = f"{_PEOPLE}, tgt AS (SELECT r::VARCHAR AS zone, lpad(s_suppkey::VARCHAR, 9, '0') AS placekey, (s_suppkey % 40)::BIGINT AS target, (s_suppkey % 7)::BIGINT AS occ FROM supplier JOIN area ON s_nationkey = k), nd AS (SELECT zone, placekey, greatest(0, target - occ) AS need FROM tgt), alln AS (SELECT zone, sum(need) AS alln FROM nd GROUP BY 1), home AS (SELECT zone, count(*) AS n FROM people GROUP BY 1), need AS (SELECT zone, placekey, CASE WHEN alln > n THEN floor(need * n / alln) ELSE need END::BIGINT AS need FROM nd JOIN alln USING (zone) JOIN home USING (zone))"


def _folk(v: Views) -> DataFrame:
    return v.table("customer").join(v.area, F.col("c_nationkey") == F.col("k")).select(F.col("r").cast("string").alias("zone"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("person_id"), F.floor(F.col("c_custkey") / 3).cast("string").alias("home"))


def _need(v: Views) -> DataFrame:
    s = v.table("supplier").join(v.area, F.col("s_nationkey") == F.col("k")).select(F.col("r").cast("string").alias("zone"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("placekey"), "s_suppkey")
    return movement.scaled_need(s.select("zone", "placekey", (F.col("s_suppkey") % 40).alias("target")), s.select("zone", "placekey", (F.col("s_suppkey") % 7).alias("occupancy")), _folk(v).groupBy("zone").agg(F.count("*").alias("people")))


@query(f"{_NEED} SELECT * FROM need")
def m8_need(v: Views) -> DataFrame:
    return _need(v)


@query(f"{_NEED}, line AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {ids.uniform_sql(chr(39) + '42' + chr(39), chr(39) + '5' + chr(39), 'person_id')}, person_id) AS pos FROM people), span AS (SELECT *, sum(need) OVER (PARTITION BY zone ORDER BY placekey) AS upto FROM need) SELECT zone, person_id, placekey FROM line JOIN span USING (zone) WHERE pos > upto - need AND pos <= upto")
def m8_chosen(v: Views) -> DataFrame:
    return movement.chosen(_need(v), _folk(v), 5)


def _schedule(v: Views, hours: int = 12) -> DataFrame:
    s = v.table("supplier").join(v.area, F.col("s_nationkey") == F.col("k"))
    t = s.select(F.col("r").cast("string").alias("zone"), F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("placekey"), (F.col("s_suppkey") % 3 + 1).alias("dwell"), F.col("s_suppkey").alias("k2"))
    return movement.simulate(_folk(v), t.select("zone", "hour", "placekey", "dwell", ((F.col("k2") + F.col("hour") * 5) % 17).alias("target")), hours)


@query()
def m8_simulate(v: Views) -> DataFrame:
    return _schedule(v)


@query()
def a17_occupancy(v: Views) -> DataFrame:
    return movement.occupancy(_schedule(v))


@query(f"{_PEOPLE} SELECT (h * 60)::INTEGER AS minute, 0::BIGINT + count(CASE WHEN (h + length(home)) % 2 = 0 THEN 1 END) AS home, count(CASE WHEN (h + length(home)) % 2 <> 0 THEN 1 END) AS away FROM people, range(1, 5) t(h) GROUP BY 1")
def a25_at_home(v: Views) -> DataFrame:
    return movement.at_home_counts(_fixed(v))


def _fixed(v: Views) -> DataFrame:
    """A schedule by rule, without a simulation."""
    p = _folk(v).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(4))))
    home = (F.col("h") + F.length("home")) % 2 == 0
    return p.select("zone", (F.col("h") * 60).cast("int").alias("minute"), "person_id", home.alias("is_home"), F.when(home, F.col("home")).otherwise((F.length("person_id") + F.col("h")).cast("string")).alias("location_id"))


_FIXED = f"{_PEOPLE}, fixed AS (SELECT zone, (h * 60)::INTEGER AS minute, person_id, (h + length(home)) % 2 = 0 AS is_home, CASE WHEN (h + length(home)) % 2 = 0 THEN home ELSE (9 + h)::VARCHAR END AS location_id FROM people, range(1, 5) t(h))"


@query(f"{_FIXED} SELECT * FROM fixed")
def k2_matrix_round_trip(v: Views) -> DataFrame:
    """Encoded to the binary matrix and decoded."""
    return matrix.decode(matrix.encode(_fixed(v)))


@query(f"{_FIXED} SELECT minute, is_home, location_id, list_sort(list(person_id)) AS people FROM fixed GROUP BY 1, 2, 3")
def k4_document(v: Views) -> DataFrame:
    return movement.document(_fixed(v))


@query("v2 AS (SELECT DISTINCT user_id AS person_id, hour(ts)::INTEGER AS hour FROM events) SELECT person_id, hour, gap FROM (SELECT *, lead(hour) OVER (PARTITION BY person_id ORDER BY hour) - hour - 1 AS gap FROM v2) WHERE gap IS NOT NULL")
def a23_gaps(v: Views) -> DataFrame:
    return movement.gaps(v.table("events").select(F.col("user_id").alias("person_id"), F.hour("ts").alias("hour")).distinct())


@query()
def m11_mixing(v: Views) -> DataFrame:
    return movement.mixing(_persons(v), 3, 0.3)


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS lat FROM customer GROUP BY 1", views=False)
def a22_geocode(v: Views) -> DataFrame:
    return v.table("customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("lat"))


@query("SELECT sha256(string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey)) AS hash FROM nation", views=False)
def k10_stable_hash(v: Views) -> DataFrame:
    rows = v.table("nation").select(F.struct("n_nationkey", F.concat_ws(":", "n_nationkey", "n_name").alias("t")).alias("s"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]), ";"), 256).alias("hash"))


# Earlier generations -----------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN r = 1 THEN 'low' WHEN r IN (0, 3) THEN 'high' ELSE 'medium' END AS social_tendency FROM customer JOIN area ON c_nationkey = k")
def j14_social_tendency(v: Views) -> DataFrame:
    house = v.table("customer").join(v.area, F.col("c_nationkey") == F.col("k")).select("c_custkey", "cbg")
    ratio = v.area.select("cbg", F.when(F.col("r") == 1, 0.7).when(F.col("r").isin(0, 3), 0.2).when(F.col("r") == 2, 0.5).alias("ratio"))
    return archive.social_tendency(house, ratio).select("c_custkey", "social_tendency")


@query(f"{_FIXED} SELECT minute, is_home, location_id, list_sort(list(person_id)) AS people FROM fixed GROUP BY 1, 2, 3")
def m13_merge_snapshots(v: Views) -> DataFrame:
    d = movement.document(_fixed(v))
    empty = d.limit(3).withColumn("people", F.array().cast("array<string>")).drop("is_home")
    return archive.merge_snapshots(d.where("is_home").drop("is_home"), d.where("NOT is_home").drop("is_home").unionByName(empty))


@query("""p AS (SELECT 'b' || s_suppkey AS place, s_suppkey AS k FROM supplier), e AS (SELECT place, 'b' || (k + d) AS target, (k % 5 + d)::DOUBLE AS weight FROM p, (VALUES (1), (2), (1000000)) t(d)),
s AS (SELECT place, coalesce(avg(CASE WHEN target NOT IN (SELECT place FROM p) THEN weight END), 1.0) AS away, coalesce(sum(CASE WHEN target IN (SELECT place FROM p) THEN weight END), 0) AS s, count(CASE WHEN target IN (SELECT place FROM p) THEN 1 END) AS n FROM e GROUP BY 1)
SELECT place, target, weight FROM e WHERE target IN (SELECT place FROM p) UNION ALL SELECT place, 'out of state', away FROM s UNION ALL SELECT place, 'home', (s + away) / (n + 1) / 2 FROM s""")
def p25_next_places(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    name = lambda d: F.concat(F.lit("b"), k + d)
    weight = lambda d: (k % 5 + d).cast("double")
    rows = v.table("supplier").select(name(0).alias("place"), F.create_map(*(f(F.lit(d)) for d in (1, 2, 1000000) for f in (name, weight))).alias("brands"))
    return archive.next_places(rows)


@query(f"d AS (SELECT s_suppkey, {ids.uniform_sql('s_suppkey', chr(39) + 'a' + chr(39))} AS a, {ids.uniform_sql('s_suppkey', chr(39) + 'b' + chr(39))} AS b FROM supplier) SELECT s_suppkey, CASE WHEN a * 25 < 3 THEN 1 + floor(b * 4) WHEN a * 25 < 4 THEN 5 + floor(b * 6) WHEN a * 25 < 8 THEN 11 + floor(b * 10) WHEN a * 25 < 9 THEN 21 + floor(b * 40) WHEN a * 25 < 14 THEN 61 + floor(b * 60) WHEN a * 25 < 23 THEN 121 + floor(b * 120) ELSE 241 + floor(b * 260) END::BIGINT AS minutes FROM d")
def p24_dwell_minutes(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    return v.table("supplier").select(k, archive.dwell_minutes(ids.uniform(k, "a"), ids.uniform(k, "b"), F.array(*(F.lit(x) for x in (3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0)))).alias("minutes"))


@query()
def m12_quota_households(v: Views) -> DataFrame:
    q = population.household_counts(v.population, v.counties).where("households > 0").select("cbg", "households", F.array(*(F.lit(x) for x in (50.0, 8.0, 2.0, 20.0, 12.0, 8.0))).alias("percents"))
    return archive.quota_households(q)


@query()
def m10_queue_simulation(v: Views) -> DataFrame:
    p = v.table("supplier").join(v.area, F.col("s_nationkey") == F.col("k")).select(F.col("r").cast("string").alias("zone"), F.concat(F.lit("b"), "s_suppkey").alias("place"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("weight"), F.array(*(F.lit(x) for x in (3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0))).alias("dwell"))
    return archive.queue_simulation(_folk(v), p, 120)


@query()
def g20_spatial_growth(v: Views) -> DataFrame:
    people = v.area.join(v.population, "cbg").select(F.col("k").cast("string").alias("cbg"), "population")
    border = geometry.touching(_polygons(v)).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    runs = v.spark.createDataFrame([("r0", "0", 400), ("r12", "12", 600)], "run_id string, seed string, min_pop int")
    return archive.spatial_growth(border, people, runs)


# Service --------------------------------------------------------------------------------------------


@query("SELECT state, month, available FROM (SELECT s.state, m.month, v.month IS NOT NULL AS available FROM (SELECT DISTINCT substr(src, 4, 2) AS state FROM visit) s CROSS JOIN (SELECT strftime(unnest(range(DATE '1991-10-01', DATE '1992-06-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) m LEFT JOIN (SELECT DISTINCT substr(src, 4, 2) AS state, month FROM visit) v ON v.state = s.state AND v.month = m.month)")
def r_pattern_availability(v: Views) -> DataFrame:
    need = _files(v).select("state").distinct().withColumn("month", F.explode(calendar.month_range(F.lit("1991-10-01").cast("date"), F.lit("1992-05-01").cast("date"))))
    return service.pattern_availability(_files(v), need)


@query()
def r_cluster_cbgs(v: Views) -> DataFrame:
    seed = v.cluster.agg(F.min("cbg")).first()[0]
    return service.cluster_cbgs(v.rec, v.population, seed, 300, "balanced", v.centers).select("position", "cbg", "zone_population")


@query()
def r_second_order_destinations(v: Views) -> DataFrame:
    zips = visits.area_zip(visits.zip_areas(v.spark, v.zips))
    cities = zips.select("zip").distinct().select("zip", F.concat(F.lit("Town "), "zip").alias("city"), F.lit("md").alias("state"))
    return service.second_order_destinations(v.rec, v.cluster, zips, cities, v.population, v.centers).select("unit", "rank", "outbound", "inbound", "coupling", "captured_share", "gateways", "recommended")


@query()
def r_cbg_geojson(v: Views) -> DataFrame:
    polygons = _polygons(v).withColumn("id", F.col("id").cast("string"))
    return service.cbg_geojson(polygons, v.area.where("r = 0").select(F.col("k").cast("string").alias("cbg")), neighbours=True)
