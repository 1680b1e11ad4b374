"""Queries of contiguity, Moran statistics, local clusters and geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import spatial, stats
from odweave.operators.permutations import permuted_sql
from odweave.plans import views as V
from odweave.plans.flow_queries import _with
from odweave.plans.registry import query
from odweave.storage import stored

R = 999
BASE = (V.OD, V.AREAS, V.EDGES, V.INFLOW, V.ZINFLOW)
LAG = "lagged AS (SELECT z.area, z.inflow, z.z, coalesce(sum(w.w * n.z), 0) AS lag_z FROM z LEFT JOIN weights w ON w.i = z.area LEFT JOIN z n ON n.area = w.j GROUP BY ALL)"


def _inflow(spark, sf):
    """Areas with their inflow, a stored table, and the weights of their lattice."""
    v = stored(V.inflow(spark, sf), "inflow")
    return v, spatial.row_standardised(spatial.lattice_edges(v))


@query(_with(V.AREAS, V.EDGES) + "SELECT i, j, round(w, 6) AS w FROM weights")
def queen_edges(spark, sf):
    return V.rounded(V.weights(spark, sf))


_CELLS = "cells AS (SELECT n_nationkey AS area, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation)"
_NEDGES = "nedges AS (SELECT a.area AS i, b.area AS j FROM cells a, cells b WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.area <> b.area)"


def _squares(spark, sf):
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("area"), (F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"))
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    return n.select("area", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


@query(_with(_CELLS, _NEDGES) + "SELECT i, j FROM nedges")
def polygon_queen_edges(spark, sf):
    return spatial.polygon_edges(_squares(spark, sf))


@query(_with(_CELLS) + "SELECT area, 1.0 AS size, x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy FROM cells")
def polygon_measures(spark, sf):
    x, y = spatial.ring_centroid(F.col("ring"))
    return V.rounded(_squares(spark, sf).select("area", spatial.ring_area(F.col("ring")).alias("size"), x.alias("cx"), y.alias("cy")))


@query(_with(_CELLS) + """, p AS (SELECT c_custkey, (c_custkey * 37 % 601) / 100.0 AS px, (c_custkey * 53 % 577) / 100.0 AS py FROM customer)
SELECT px, py, area FROM (SELECT px, py FROM p UNION ALL SELECT px, py FROM p WHERE c_custkey % 3 = 0) LEFT JOIN cells ON px > x AND px < x + 1 AND py > y AND py < y + 1""")
def point_in_polygon(spark, sf):
    p = V.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 601 / 100.0).alias("x"), (F.col("c_custkey") * 53 % 577 / 100.0).alias("y"))
    p = p.select("x", "y").unionAll(p.where("c_custkey % 3 = 0").select("x", "y"))  # repeated points stay repeated
    return spatial.points_in_polygons(p, _squares(spark, sf), 1.0).select(F.col("x").alias("px"), F.col("y").alias("py"), "area")


@query(_with(V.AREAS, V.EDGES).replace("WITH ", "WITH RECURSIVE ", 1) + """, reached AS (SELECT area, area AS seen FROM areas UNION SELECT r.area, e.j FROM reached r JOIN edges e ON e.i = r.seen), d AS (SELECT area, count(j) AS degree FROM areas LEFT JOIN edges ON i = area GROUP BY area)
SELECT count(*) AS n, count(*) FILTER (degree = 0) AS islands, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS mean_degree, median(degree)::DOUBLE AS median_degree, (SELECT count(DISTINCT component) FROM (SELECT area, min(seen) AS component FROM reached GROUP BY area)) AS components FROM d""")
def weights_diagnostics(spark, sf):
    a = V.areas(spark, sf)
    return V.rounded(spatial.weights_diagnostics(a, spatial.lattice_edges(a)))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, s_suppkey + 7 AS b FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey + 7 <= (SELECT max(s_suppkey) FROM supplier)), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT s_suppkey AS area, s_suppkey AS seen FROM supplier UNION SELECT r.area, two.b FROM r JOIN two ON two.a = r.seen) SELECT area, min(seen) AS component FROM r GROUP BY area""")
def connected_components(spark, sf):
    a = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("area"))
    top = a.agg(F.max("area")).first()[0]
    e = a.where((F.col("area") % 3 == 0) & (F.col("area") + 7 <= top)).select(F.col("area").alias("i"), (F.col("area") + 7).alias("j"))
    return spatial.component_labels(a, e)


@query(_with(*BASE, LAG) + "SELECT area, round(z, 6) AS z, round(lag_z, 6) AS lag_z FROM lagged")
def spatial_lag(spark, sf):
    v, w = _inflow(spark, sf)
    return V.rounded(spatial.lag(spatial.standardised(v, "inflow").select("area", "z"), w, "area", ["z"]))


_MORAN = """, s AS (SELECT (SELECT count(*) FROM z)::DOUBLE AS n, (SELECT sum(w) FROM weights) AS s0,
(SELECT sum(t * t) / 2 FROM (SELECT i, j, sum(w) AS t FROM (SELECT i, j, w FROM weights UNION ALL SELECT j, i, w FROM weights) GROUP BY 1, 2)) AS s1,
(SELECT sum(t * t) FROM (SELECT k, sum(w) AS t FROM (SELECT i AS k, w FROM weights UNION ALL SELECT j, w FROM weights) GROUP BY 1)) AS s2, (SELECT sum(z * lag_z) / sum(z * z) FROM lagged) AS c),
m AS (SELECT n::BIGINT AS n, n / s0 * c AS moran_i, -1 / (n - 1) AS expected_i, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS variance FROM s)"""


@query(_with(*BASE, LAG) + _MORAN + "SELECT n, round(moran_i, 6) AS moran_i, round(expected_i, 6) AS expected_i, round(variance, 8) AS variance, round((moran_i - expected_i) / sqrt(variance), 4) AS z_norm FROM m")
def moran_global(spark, sf):
    v, w = _inflow(spark, sf)
    m = spatial.moran(v, w, "area", "inflow")
    return m.select("n", F.round("moran_i", 6).alias("moran_i"), F.round("expected_i", 6).alias("expected_i"), F.round("variance", 8).alias("variance"), F.round("z_norm", 4).alias("z_norm"))


@query(_with(*BASE, LAG) + "SELECT round(regr_slope(lag_z, z), 6) AS slope, count(*) AS n FROM lagged")
def moran_scatter(spark, sf):
    v, w = _inflow(spark, sf)
    t = spatial.lag(spatial.standardised(v, "inflow").select("area", "z"), w, "area", ["z"])
    return t.agg(F.round(F.regr_slope("lag_z", "z"), 6).alias("slope"), F.count("*").alias("n"))


def permuted_ctes(r: int) -> str:
    """CTEs of Moran's I of z under r permutations; z (area, z) and weights (i, j, w) come before."""
    return f"""byk AS (SELECT area, z AS pz, row_number() OVER (ORDER BY area) - 1 AS k, count(*) OVER () AS n FROM z), reps AS (SELECT area, k, n, r FROM byk, unnest(range(1, {r + 1})) AS t(r)),
mixed AS MATERIALIZED (SELECT m.r, m.area AS i, b.pz FROM {permuted_sql("reps", "area", "k", "n")} m JOIN byk b USING (k) UNION ALL SELECT 0, area, z FROM z),
st AS (SELECT a.r, (SELECT count(*) FROM z) / (SELECT sum(w) FROM weights) * sum(w.w * a.pz * b.pz) / (SELECT sum(z * z) FROM z) AS i FROM mixed a JOIN weights w ON w.i = a.i JOIN mixed b ON b.i = w.j AND b.r = a.r GROUP BY a.r),
o AS (SELECT i FROM st WHERE r = 0), tt AS (SELECT max(o.i) AS moran_i, count(*) FILTER (st.i >= o.i - 1e-12) AS larger, count(*) AS permutations, avg(st.i) AS mean_simulated, stddev_pop(st.i) AS sd_simulated FROM st, o WHERE r > 0)"""


PERMUTED_ROW = """SELECT round(moran_i, 6) AS moran_i, larger, permutations, round(mean_simulated, 6) AS mean_simulated, round(sd_simulated, 6) AS sd_simulated,
round((least(larger, permutations - larger) + 1) / (permutations + 1), 6) AS p_sim, round((moran_i - mean_simulated) / sd_simulated, 4) AS z_sim FROM tt"""


@query(_with(*BASE) + f", {permuted_ctes(R)} " + PERMUTED_ROW)
def moran_permutation(spark, sf):
    v, w = _inflow(spark, sf)
    m = V.rounded(spatial.moran_permutation(v, w, "area", "inflow", R).withColumn("z_sim", F.round("z_sim", 4)))
    return m


LOCAL = """local AS (SELECT l.area, inflow AS value, z, lag_z, z * lag_z / (SELECT sum(z * z) / (count(*) - 1) FROM z) AS local_i, CASE WHEN z > 0 AND lag_z > 0 THEN 1 WHEN z <= 0 AND lag_z > 0 THEN 2 WHEN z <= 0 AND lag_z <= 0 THEN 3 ELSE 4 END AS quadrant,
(SELECT count(*) FROM edges WHERE i = l.area) AS neighbours FROM lagged l)"""


@query(_with(*BASE, LAG, LOCAL) + "SELECT area, round(value, 6) AS value, round(z, 6) AS z, round(lag_z, 6) AS lag_z, round(local_i, 6) AS local_i, quadrant, neighbours FROM local")
def moran_local(spark, sf):
    v, w = _inflow(spark, sf)
    return V.rounded(spatial.local_moran(v, w, "area", "inflow"))


LISA = f"""byk AS (SELECT area, z, row_number() OVER (ORDER BY area) - 1 AS k, count(*) OVER () AS n FROM z), places AS (SELECT k AS place, k, n, r FROM (SELECT k, n FROM byk WHERE k < 9), unnest(range(1, {R + 1})) AS t(r)),
heads AS MATERIALIZED (SELECT p.r, p.place AS k, b.area, b.z FROM {permuted_sql("places", "place", "k", "n")} p JOIN byk b USING (k)), cand AS (SELECT l.area, l.z AS zi, l.lag_z, l.neighbours, h.r, h.z, row_number() OVER (PARTITION BY l.area, h.r ORDER BY h.k) AS q FROM local l JOIN heads h ON h.area <> l.area),
sims AS (SELECT area, r, sum(z) / max(neighbours) * max(zi) AS sim, max(zi * lag_z) AS obs FROM cand WHERE q <= neighbours GROUP BY area, r),
pv AS (SELECT area, (least(count(*) FILTER (sim >= obs - 1e-12), {R} - count(*) FILTER (sim >= obs - 1e-12)) + 1) / {R + 1}.0::DOUBLE AS p_sim FROM sims GROUP BY area),
lisa AS (SELECT local.*, p_sim, p_sim < 0.05 AS significant, CASE WHEN NOT p_sim < 0.05 THEN 'Not Significant' WHEN quadrant = 1 THEN 'High-High' WHEN quadrant = 2 THEN 'Low-High' WHEN quadrant = 3 THEN 'Low-Low' ELSE 'High-Low' END AS cluster,
CASE WHEN p_sim <= 0.001 THEN 'p < 0.001' WHEN p_sim < 0.01 THEN 'p < 0.01' WHEN p_sim < 0.05 THEN 'p < 0.05' ELSE 'Not Significant' END AS p_bin FROM local JOIN pv USING (area))"""


def _lisa(spark, sf):
    v, w = _inflow(spark, sf)
    return spatial.lisa(v, w, "area", "inflow", R)


@query(_with(*BASE, LAG, LOCAL, LISA) + "SELECT area, round(local_i, 6) AS local_i, quadrant, round(p_sim, 6) AS p_sim, significant, cluster, p_bin FROM lisa")
def lisa_clusters(spark, sf):
    return V.rounded(_lisa(spark, sf).select("area", "local_i", "quadrant", "p_sim", "significant", "cluster", "p_bin"))


@query(_with(*BASE, LAG, LOCAL, LISA) + """, dim AS (SELECT * FROM (VALUES ('High-High', 0), ('Low-Low', 1), ('High-Low', 2), ('Low-High', 3), ('Not Significant', 4)) AS t(cluster, category_rank)), g AS (SELECT cluster, count(*) AS areas, avg(value) AS mv, median(value) AS md, avg(local_i) AS mi, median(p_sim) AS mp FROM lisa GROUP BY 1)
SELECT dim.cluster, category_rank, coalesce(areas, 0) AS areas, round(coalesce(areas, 0) / (SELECT count(*) FROM lisa) * 100, 6) AS pct_all, round(CASE WHEN dim.cluster <> 'Not Significant' THEN coalesce(coalesce(areas, 0) * 100.0 / nullif((SELECT count(*) FILTER (significant) FROM lisa), 0), 0) END, 6) AS pct_significant,
round(mv, 6) AS mean_value, round(md, 6) AS median_value, round(mi, 6) AS mean_local_i, round(mp, 6) AS median_p FROM dim LEFT JOIN g USING (cluster)""")
def lisa_summary(spark, sf):
    return V.rounded(spatial.lisa_summary(_lisa(spark, sf)))


@query(_with(*BASE, LAG, LOCAL, LISA) + "SELECT cluster, rank, area, round(p_sim, 6) AS p_sim, round(local_i, 6) AS local_i FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p_sim, abs(local_i) DESC, value DESC, area) AS rank FROM lisa WHERE significant) WHERE rank <= 20")
def lisa_topk(spark, sf):
    return V.rounded(spatial.lisa_top(_lisa(spark, sf), "area").select("cluster", "rank", "area", "p_sim", "local_i"))


_BH = "bh AS (SELECT area, p_sim, least(min(raw) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS p_adjusted, quadrant FROM (SELECT *, p_sim * count(*) OVER () / row_number() OVER (ORDER BY p_sim, area) AS raw, row_number() OVER (ORDER BY p_sim, area) AS rk FROM lisa))"


@query(_with(*BASE, LAG, LOCAL, LISA, _BH) + "SELECT area, round(p_sim, 6) AS p_sim, round(p_adjusted, 6) AS p_adjusted FROM bh")
def bh_adjust(spark, sf):
    return V.rounded(stats.bh_adjust(_lisa(spark, sf), "p_sim", "area").select("area", "p_sim", "p_adjusted"))


@query(_with(*BASE, LAG, LOCAL, LISA, _BH) + "SELECT count(*) FILTER (p_sim < 0.05) AS raw_significant, count(*) FILTER (p_adjusted < 0.05) AS adjusted_significant, count(*) FILTER (p_sim < 0.05 AND NOT p_adjusted < 0.05) AS lost FROM bh")
def fdr_sensitivity(spark, sf):
    t = stats.bh_adjust(_lisa(spark, sf), "p_sim", "area")
    raw, adj = F.col("p_sim") < 0.05, F.col("p_adjusted") < 0.05
    return t.agg(F.count_if(raw).alias("raw_significant"), F.count_if(adj).alias("adjusted_significant"), F.count_if(raw & ~adj).alias("lost"))


_TWO = """pairs AS (SELECT area, CASE WHEN z > 0.5 THEN 'High-High' WHEN z < -0.5 THEN 'Low-Low' ELSE 'Not Significant' END AS first, CASE WHEN lag_z > 0.1 THEN 'High-High' WHEN lag_z < -0.1 THEN 'Low-Low' ELSE 'Not Significant' END AS second FROM lagged)"""


def _two(spark, sf):
    v, w = _inflow(spark, sf)
    t = spatial.lag(spatial.standardised(v, "inflow").select("area", "z"), w, "area", ["z"])
    label = lambda c, b: F.when(F.col(c) > b, "High-High").when(F.col(c) < -b, "Low-Low").otherwise("Not Significant")
    return spatial.overlap(t.select("area", label("z", 0.5).alias("cluster")), t.select("area", label("lag_z", 0.1).alias("cluster")), "area")


@query(_with(*BASE, LAG, _TWO) + """, c AS (SELECT count(*) AS areas, count(*) FILTER (first = 'High-High' AND second = 'High-High') AS both_high_high, count(*) FILTER (first = 'Low-Low' AND second = 'Low-Low') AS both_low_low, count(*) FILTER (first = 'High-High' AND second <> 'High-High') AS first_hot_only,
count(*) FILTER (first <> 'High-High' AND second = 'High-High') AS second_hot_only, count(*) FILTER ((first = 'High-High') <> (second = 'High-High')) AS differing_hot, count(*) FILTER (first = second) AS same_cluster FROM pairs)
SELECT metric, value::DOUBLE AS value, round(value * 100.0 / areas, 6) AS pct FROM (UNPIVOT c ON both_high_high, both_low_low, first_hot_only, second_hot_only, differing_hot, same_cluster INTO NAME metric VALUE value)""")
def lisa_overlap(spark, sf):
    return V.rounded(spatial.overlap_metrics(_two(spark, sf)))


@query(_with(*BASE, LAG, _TWO) + "SELECT area, CASE WHEN first = 'High-High' AND second = 'High-High' THEN 'Both HH' WHEN first = 'High-High' THEN 'First HH only' WHEN second = 'High-High' THEN 'Second HH only' ELSE 'Non-significant' END AS hotspot FROM pairs")
def hotspot_class(spark, sf):
    return _two(spark, sf).select("area", "hotspot")


_EDGES5 = "q AS (SELECT quantile_cont(inflow, 0.2) AS a, quantile_cont(inflow, 0.4) AS b, quantile_cont(inflow, 0.6) AS c, quantile_cont(inflow, 0.8) AS d FROM inflow)"


@query(_with(V.OD, V.AREAS, V.INFLOW, _EDGES5) + "SELECT area, CASE WHEN inflow <= a THEN 1 WHEN inflow <= b THEN 2 WHEN inflow <= c THEN 3 WHEN inflow <= d THEN 4 ELSE 5 END AS class FROM inflow, q")
def quantile_classes(spark, sf):
    v = stored(V.inflow(spark, sf).select("area", "inflow"), "inflow")  # edges and classes are of the same sums
    return v.select("area", stats.quantile_class(F.col("inflow"), stats.quantile_edges(v, "inflow", 5)).alias("class"))


@query(_with(V.AREAS) + "SELECT area, least((x - (SELECT min(x) FROM areas)) * 5 // ((SELECT max(x) - min(x) + 1 FROM areas)), 4)::INT AS fold FROM areas")
def spatial_folds_lattice(spark, sf):
    from odweave.operators import learning

    return learning.strip_folds(V.areas(spark, sf)).select("area", "fold")


@query(None)
def spatial_folds_kmeans(spark, sf):
    from odweave.operators import learning

    return learning.kmeans_folds(stored(V.areas(spark, sf), "areas")).select("area", "fold")


_SIDES = """sides AS (SELECT r_name AS borough, unnest([[x, y, x + 1, y], [x + 1, y, x + 1, y + 1], [x, y + 1, x + 1, y + 1], [x, y, x, y + 1]]) AS s FROM cells JOIN nation ON area = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(_with(_CELLS, _SIDES) + """SELECT borough, areas, areas::DOUBLE AS size, min_x, min_y, max_x, max_y, (SELECT count(*) FROM (SELECT s FROM sides t WHERE t.borough = g.borough GROUP BY s HAVING count(*) = 1))::DOUBLE AS perimeter
FROM (SELECT r_name AS borough, count(*) AS areas, min(x)::DOUBLE AS min_x, min(y)::DOUBLE AS min_y, max(x + 1)::DOUBLE AS max_x, max(y + 1)::DOUBLE AS max_y FROM cells JOIN nation ON area = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) g""")
def dissolve(spark, sf):
    """Areas dissolved by borough: their area, box, and the length of the sides that remain."""
    t = _squares(spark, sf).join(V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("area"), F.col("r_name").alias("borough")), "area")
    return V.rounded(spatial.dissolve(t, ["borough"]))


@query(_with(_CELLS) + "SELECT area, least(x, x + 1)::DOUBLE AS min_x, y::DOUBLE AS min_y, x + 1::DOUBLE AS max_x, y + 1::DOUBLE AS max_y, area % 4 <> 3 AS valid, area % 4 = 3 AS empty FROM cells")
def geometry_checks(spark, sf):
    """Boxes, validity and emptiness of rings: every fourth is without vertices."""
    t = _squares(spark, sf)
    ring = F.when(F.col("area") % 4 == 3, F.slice("ring", 1, 0)).otherwise(F.col("ring"))
    return t.select("area", spatial.ring_bounds(F.col("ring")).alias("b"), spatial.ring_is_valid(ring).alias("valid"), spatial.ring_is_empty(ring).alias("empty")).select("area", "b.*", "valid", "empty")


@query("SELECT s_suppkey, CASE WHEN s_acctbal <= 0.001 THEN 'p < 0.001' WHEN s_acctbal < 0.01 THEN 'p < 0.01' WHEN s_acctbal < 0.05 THEN 'p < 0.05' ELSE 'Not Significant' END AS bin, CASE WHEN s_acctbal >= 10 THEN 'high' WHEN s_acctbal >= 5 THEN 'moderate' ELSE 'low' END AS vif, greatest(least(s_acctbal / 1000, 3), -3) AS clipped FROM supplier")
def classifiers(spark, sf):
    c = F.col("s_acctbal")
    return V.table(spark, sf, "supplier").select("s_suppkey", S.significance_bin(c).alias("bin"), S.vif_status(c).alias("vif"), S.clip(c / 1000, -3.0, 3.0).alias("clipped"))
