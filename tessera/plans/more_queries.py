"""Further queries: outputs as rows, survey arithmetic, meshes, lattices and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import catalogue as C
from tessera.operators import geometry as G
from tessera.operators import mesh as M
from tessera.operators import pyramid as P
from tessera.operators import raster as R
from tessera.operators import survey as V
from tessera.plans.queries import _BLOCK, INDEX, LEAF, OTHER, PYRAMID, blocks, index, leaf, other, tiles
from tessera.plans.registry import query
from tessera.sources import tables as T

GRID = f"{_BLOCK}, v AS (SELECT px, py, z FROM cell WHERE z IS NOT NULL)"


@query("a13_page_read", f"WITH {PYRAMID} SELECT lod, x, y, min_z, max_z FROM pyramid WHERE lod = 7 AND x BETWEEN 32 AND 63 AND y BETWEEN 64 AND 95")
def page_read(spark, d):
    return tiles(spark, d).where("lod = 7 AND x BETWEEN 32 AND 63 AND y BETWEEN 64 AND 95").select(*P.TILE, "min_z", "max_z")


@query("a14_class_definitions", "SELECT p_partkey % 256 AS id, min(p_name) AS name, min(p_size) % 2 = 0 AS is_flat, CAST(min(p_size) % 16 AS INT) AS reflectivity FROM part GROUP BY 1")
def classes(spark, d):
    p = T.table(spark, d, "part").groupBy((F.col("p_partkey") % 256).alias("id")).agg(F.min("p_name").alias("name"), F.min("p_size").alias("s"))
    text = F.to_json(F.struct("id", "name", (F.col("s") % 2 == 0).alias("isFlat"), (F.col("s") % 16).alias("reflectivity")))
    return p.select(F.from_json(text, "id long, name string, isFlat boolean, reflectivity int").alias("c")).select("c.id", "c.name", F.col("c.isFlat").alias("is_flat"), "c.reflectivity")


@query("a18_band_view", "SELECT l_orderkey, CAST(l_partkey % 1024 AS INT) AS px, l_extendedprice AS band FROM lineitem WHERE l_partkey % 1024 BETWEEN 100 AND 163")
def band_view(spark, d):
    px = (F.col("l_partkey") % 1024).cast("int")
    return T.table(spark, d, "lineitem").where(px.between(100, 163)).select("l_orderkey", px.alias("px"), F.col("l_extendedprice").alias("band"))


_GEO = "p AS (SELECT c_custkey, c_name, radians(CAST(c_nationkey * 10 - 120 AS DOUBLE)) AS lo, radians(CAST(c_custkey % 160 - 80 AS DOUBLE)) AS la, CAST(c_acctbal AS DOUBLE) AS h, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e FROM customer), q AS (SELECT *, 6378137.0 / sqrt(1 - e * sin(la) * sin(la)) AS n FROM p), g AS (SELECT c_custkey, c_name, (n + h) * cos(la) * cos(lo) AS gx, (n + h) * cos(la) * sin(lo) AS gy, (n * (1 - e) + h) * sin(la) AS gz FROM q)"


@query("b11_quantised_features", f"WITH {_GEO} SELECT c_custkey, '{{\"id\":' || c_custkey || ',\"at\":[' || CAST(round((gx + 6400000) / 8) AS BIGINT) || ',' || CAST(round((gy + 6400000) / 8) AS BIGINT) || ',' || CAST(round((gz + 6400000) / 8) AS BIGINT) || '],\"n\":\"' || c_name || '\"}}' AS json FROM g")
def quantised(spark, d):
    """Features in the physical system, as whole steps of eight metres from a corner of its cube."""
    at = S.geocentric((F.col("c_nationkey") * 10 - 120).cast("double"), (F.col("c_custkey") % 160 - 80).cast("double"), F.col("c_acctbal").cast("double"))
    steps = F.array(*G.quantised(list(at), [-6.4e6] * 3, 8.0))
    return T.table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), steps.alias("at"), F.col("c_name").alias("n"))).alias("json"))


@query("b16_layer_json", f"WITH {PYRAMID}, r AS (SELECT lod, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pyramid GROUP BY 1) SELECT '[' || string_agg('[{{\"x0\":' || x0 || ',\"y0\":' || y0 || ',\"x1\":' || x1 || ',\"y1\":' || y1 || '}}]', ',' ORDER BY lod) || ']' AS available FROM r")
def layer_json(spark, d):
    return C.layer_json(tiles(spark, d).groupBy("lod").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")))


@query("b22_credit_tiles", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS credits FROM nation GROUP BY 1")
def credit_tiles(spark, d):
    return T.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("credits"))


@query("b24_debug_nodes", f"WITH {INDEX} SELECT lod, x, y, '{{\"id\":\"' || lod || '-' || x || '-' || y || '\",\"flags\":' || (flags | 4) || '}}' AS json FROM idx")
def debug_nodes(spark, d):
    return index(spark, d).select(*P.TILE, F.to_json(F.struct(F.concat_ws("-", *P.TILE).alias("id"), F.col("flags").bitwiseOR(P.ATLAS).alias("flags"))).alias("json"))


_BOX = (100.0, 40.0, 700.0, 500.0)
_CLIPPED = "c_nationkey > 20 OR c_mktsegment IN ('BUILDING')"
#: Liang and Barsky's bounds of the parameter of a line from x0, y0 to x1, y1.
_ENTER = "greatest(0, CASE WHEN dx > 0 THEN (100 - x0) / dx WHEN dx < 0 THEN (700 - x0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (40 - y0) / dy WHEN dy < 0 THEN (500 - y0) / dy ELSE 0 END)"
_LEAVE = "least(1, CASE WHEN dx > 0 THEN (700 - x0) / dx WHEN dx < 0 THEN (100 - x0) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (500 - y0) / dy WHEN dy < 0 THEN (40 - y0) / dy ELSE 1 END)"


def _lines(spark, d):
    k = F.col("c_custkey")
    ends = {"x0": k * 37 % 1000, "y0": F.col("c_nationkey") * 29, "x1": k * 91 % 1000, "y1": k * 53 % 700}
    return T.table(spark, d, "customer").select(k, "c_nationkey", "c_mktsegment", *[v.cast("double").alias(c) for c, v in ends.items()])


@query("c10_clip_policy", f"""
WITH l AS (SELECT c_custkey, {_CLIPPED} AS clipped, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x0, CAST(c_nationkey * 29 AS DOUBLE) AS y0, CAST(c_custkey * 91 % 1000 AS DOUBLE) AS x1, CAST(c_custkey * 53 % 700 AS DOUBLE) AS y1 FROM customer),
t AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM l), u AS (SELECT *, {_ENTER} AS a, {_LEAVE} AS b FROM t),
v AS (SELECT * FROM u WHERE NOT clipped OR a <= b AND NOT (dx = 0 AND x0 NOT BETWEEN 100 AND 700) AND NOT (dy = 0 AND y0 NOT BETWEEN 40 AND 500))
SELECT c_custkey, round(CASE WHEN clipped THEN x0 + a * dx ELSE x0 END, 6) AS x0, round(CASE WHEN clipped THEN y0 + a * dy ELSE y0 END, 6) AS y0, round(CASE WHEN clipped THEN x0 + b * dx ELSE x1 END, 6) AS x1, round(CASE WHEN clipped THEN y0 + b * dy ELSE y1 END, 6) AS y1 FROM v""")
def clip(spark, d):
    """Lines of features, clipped to the node's extents where the policy says so; those without a part inside are gone."""
    ends = ["x0", "y0", "x1", "y1"]
    clipped = G.clipped_layers(F.col("c_mktsegment"), F.col("c_nationkey") > 20, ["BUILDING"])
    part = F.when(clipped, G.clip_segment(*[F.col(c) for c in ends], _BOX)).otherwise(F.struct(*ends))
    return _lines(spark, d).select("c_custkey", part.alias("l")).where("l IS NOT NULL").select("c_custkey", *[F.round(f"l.{c}", 6).alias(c) for c in ends])


@query("c10_clipped_rings", "WITH r AS (SELECT c_custkey, c_custkey * 37 % 1000 AS x, c_nationkey * 29 AS y, 20 + c_custkey % 200 AS s FROM customer) SELECT c_custkey, CAST(greatest(0, least(x + s, 700) - greatest(x, 100)) * greatest(0, least(y + s, 500) - greatest(y, 40)) AS DOUBLE) AS area FROM r WHERE least(x + s, 700) > greatest(x, 100) AND least(y + s, 500) > greatest(y, 40)")
def clipped_rings(spark, d):
    """Areas of squares after their rings are clipped."""
    k = F.col("c_custkey")
    x, y, s = (c.cast("double") for c in (k * 37 % 1000, F.col("c_nationkey") * 29, 20 + k % 200))
    ring = F.array(*[F.struct((x + i * s).alias("x"), (y + j * s).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return T.table(spark, d, "customer").select(k, F.round(G.ring_area(G.clip_ring(ring, _BOX)), 6).alias("area")).where("area > 0")


@query("c13_constant_blocks", f"WITH {T.PIXEL_SQL} SELECT px >> 2 AS tx, py >> 2 AS ty, count(z) = 0 AS empty, coalesce(min(z) = max(z) AND count(z) = count(*), false) AS constant FROM pixel GROUP BY 1, 2")
def constant_blocks(spark, d):
    g = T.pixels(spark, d).groupBy(F.shiftright("px", 2).alias("tx"), F.shiftright("py", 2).alias("ty"))
    return g.agg((F.count("z") == 0).alias("empty"), F.coalesce((F.min("z") == F.max("z")) & (F.count("z") == F.count(F.lit(1))), F.lit(False)).alias("constant"))


@query("c17_store_domain", f"WITH {INDEX} SELECT lod, x, y, CASE WHEN lod < 2 THEN 'structural' WHEN (x >> (lod - 2)) % 2 = 1 THEN 'structural' ELSE 'payload' END AS kind FROM idx")
def store_domain(spark, d):
    manual = F.expr("shiftright(x, greatest(lod - 2, 0)) % 2 = 1")
    return index(spark, d).select(*P.TILE, F.when((F.col("lod") < 2) | manual, "structural").otherwise("payload").alias("kind"))


@query("c19_valid_samples", "SELECT event_id, value FROM events WHERE value * 2e5 - 1.2e6 >= -1e6")
def valid_samples(spark, d):
    return T.table(spark, d, "events").where(F.col("value") * 2e5 - 1.2e6 >= P.VALID_Z).select("event_id", "value")


@query("c20_masked_values", f"WITH {T.PIXEL_SQL} SELECT px, py, max(CASE WHEN mask > 0 THEN z END) AS z FROM pixel GROUP BY 1, 2")
def masked(spark, d):
    return T.pixels(spark, d).groupBy("px", "py").agg(F.max(F.when(F.col("mask") > 0, F.col("z"))).alias("z"))


@query("d15_block_split", """
WITH r AS (SELECT c_custkey AS k, CAST(c_custkey % 28 AS INT) AS x0, CAST(c_custkey % 28 + c_nationkey % 9 AS INT) AS x1, CAST(c_custkey % 23 AS INT) AS y0, CAST(c_custkey % 23 + c_nationkey % 7 AS INT) AS y1 FROM customer),
d AS (SELECT n_nationkey AS node, CAST(n_nationkey % 5 * 6 AS INT) AS xa, CAST(n_nationkey % 5 * 6 + 5 AS INT) AS xb, CAST(n_nationkey // 5 * 5 AS INT) AS ya, CAST(n_nationkey // 5 * 5 + 4 AS INT) AS yb FROM nation)
SELECT r.k, d.node, greatest(r.x0, d.xa) AS x0, greatest(r.y0, d.ya) AS y0, least(r.x1, d.xb) AS x1, least(r.y1, d.yb) AS y1, CAST(row_number() OVER (PARTITION BY r.k ORDER BY abs(d.xa // 6 - r.x0 // 6) + abs(d.ya // 5 - r.y0 // 5), d.ya, d.xa) - 1 AS INT) AS place FROM r JOIN d ON r.x0 <= d.xb AND r.x1 >= d.xa AND r.y0 <= d.yb AND r.y1 >= d.ya""")
def block_split(spark, d):
    """Ranges of tiles cut at the nodes that they meet, numbered as a flood from the first corner reaches them."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    c = T.table(spark, d, "customer").select(k.alias("k"), *[v.cast("int").alias(a) for a, v in (("x0", k % 28), ("x1", k % 28 + F.col("c_nationkey") % 9), ("y0", k % 23), ("y1", k % 23 + F.col("c_nationkey") % 7))])
    nodes = T.table(spark, d, "nation").select(n.alias("node"), *[v.cast("int").alias(a) for a, v in (("xa", n % 5 * 6), ("xb", n % 5 * 6 + 5), ("ya", F.expr("n_nationkey div 5 * 5")), ("yb", F.expr("n_nationkey div 5 * 5 + 4")))])
    return P.split_blocks(c, nodes, 6, 5)


@query("d16_atlas_flags", f"WITH {INDEX} SELECT lod, x, y, CASE WHEN flags & 1 <> 0 THEN flags | 4 ELSE flags END AS flags FROM idx")
def atlas(spark, d):
    f = F.col("flags")
    return index(spark, d).select(*P.TILE, F.when(f.bitwiseAND(P.MESH) != 0, f.bitwiseOR(P.ATLAS)).otherwise(f).alias("flags"))


@query("d17_dependencies", "SELECT p_partkey, 'earth/' || p_brand || '/' || i AS needs FROM part, (SELECT unnest([1, 2]) AS i) WHERE i <= p_size % 3")
def dependencies(spark, d):
    p = T.table(spark, d, "part").withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))).where("i <= p_size % 3")
    return p.select("p_partkey", F.concat_ws("/", F.lit("earth"), "p_brand", F.col("i").cast("string")).alias("needs"))


_TRI = lambda a, b: f"coalesce(0.5 * sqrt({a} ** 2 + {b} ** 2 + 1), 0)"


@query("e5_node_aggregates", f"""
WITH {INDEX}, cell AS (SELECT px >> 3 AS px, py >> 3 AS py, max(z) AS z FROM pixel GROUP BY 1, 2), v AS (SELECT px, py, z FROM cell WHERE z IS NOT NULL),
i AS (SELECT x, y, flags | CASE WHEN (x + y) % 2 = 0 THEN 8 ELSE 0 END AS flags FROM idx WHERE lod = 4),
s AS (SELECT i.x, i.y, px, py, z FROM i JOIN v ON px BETWEEN i.x * 8 AND i.x * 8 + 8 AND py BETWEEN i.y * 8 AND i.y * 8 + 8),
h AS (SELECT x, y, min(z) AS z0, max(z) AS z1, round(CAST(sum(CAST(z AS DECIMAL(20,4))) AS DOUBLE) / count(*) + 1e-7, 3) AS surrogate FROM s GROUP BY 1, 2),
p AS (SELECT i.x, i.y, i.x * 8 + a AS px, i.y * 8 + b AS py FROM i, (SELECT unnest(range(0, 8)) AS a), (SELECT unnest(range(0, 8)) AS b)),
q AS (SELECT p.x, p.y, c0.z AS c0, c1.z AS c1, c2.z AS c2, c3.z AS c3, (c0.z IS NOT NULL)::INT + (c1.z IS NOT NULL)::INT + (c2.z IS NOT NULL)::INT + (c3.z IS NOT NULL)::INT AS n
  FROM p LEFT JOIN v c0 ON c0.px = p.px AND c0.py = p.py LEFT JOIN v c1 ON c1.px = p.px + 1 AND c1.py = p.py LEFT JOIN v c2 ON c2.px = p.px AND c2.py = p.py + 1 LEFT JOIN v c3 ON c3.px = p.px + 1 AND c3.py = p.py + 1),
t AS (SELECT x, y, greatest(n - 2, 0) AS t, CASE WHEN n < 3 THEN 0 ELSE round(CASE WHEN c0 IS NOT NULL AND c3 IS NOT NULL THEN {_TRI("(c1 - c0)", "(c3 - c1)")} + {_TRI("(c3 - c2)", "(c2 - c0)")} ELSE {_TRI("(c1 - c0)", "(c2 - c0)")} + {_TRI("(c2 - c3)", "(c3 - c1)")} END, 3) END AS area FROM q),
g AS (SELECT x, y, sum(t) AS triangles, CAST(sum(CAST(area AS DECIMAL(20,3))) AS DOUBLE) AS area FROM t GROUP BY 1, 2),
r AS (SELECT i.x, i.y, i.flags, h.*EXCLUDE (x, y), g.triangles, g.area, coalesce(g.triangles, 0) > 0 AND i.flags & 1 <> 0 AS has FROM i LEFT JOIN h USING (x, y) LEFT JOIN g USING (x, y))
SELECT x, y, CASE WHEN has THEN 1 + CASE WHEN flags & 8 <> 0 THEN 2 ELSE 0 END ELSE 0 END + CASE WHEN flags & 2 <> 0 THEN 16 ELSE 0 END AS meta_flags, CASE WHEN has THEN z0 END AS z0, CASE WHEN has THEN z1 END AS z1, CASE WHEN has THEN area END AS area,
  CASE WHEN has THEN CAST(triangles AS BIGINT) END AS triangles, CASE WHEN has THEN surrogate END AS surrogate, CASE WHEN has THEN round(sqrt(area / (triangles * 512)), 6) END AS texel,
  CASE WHEN has AND flags & 8 <> 0 THEN CAST(floor(z0) AS BIGINT) END AS nav0, CASE WHEN has AND flags & 8 <> 0 THEN CAST(ceil(z1) AS BIGINT) END AS nav1 FROM r""")
def node_aggregates(spark, d):
    even = F.when((F.col("x") + F.col("y")) % 2 == 0, P.NAVTILE).otherwise(0)
    i = index(spark, d).where("lod = 4").withColumn("flags", F.col("flags").bitwiseOR(even))
    return M.node_aggregates(blocks(spark, d), i, 3)


@query("e9_mesh_area", f"""
WITH {GRID}, q AS (SELECT a.px, a.py, a.z AS z00, b.z AS z10, c.z AS z01, e.z AS z11 FROM v a JOIN v b ON b.px = a.px + 1 AND b.py = a.py JOIN v c ON c.px = a.px AND c.py = a.py + 1 JOIN v e ON e.px = a.px + 1 AND e.py = a.py + 1)
SELECT px >> 5 AS nx, py >> 5 AS ny, count(*) * 2 AS faces, CAST(sum(CAST(round(0.5 * sqrt((z10 - z00) ** 2 + (z11 - z10) ** 2 + 1) + 0.5 * sqrt((z11 - z01) ** 2 + (z01 - z00) ** 2 + 1), 3) AS DECIMAL(20,3))) AS DOUBLE) AS area, CAST(count(*) AS DOUBLE) AS flat_area FROM q GROUP BY 1, 2""")
def mesh_area(spark, d):
    return M.areas(M.triangulate(blocks(spark, d)), 5)


@query("e10_mesh_coverage", "SELECT DISTINCT CAST(x AS INT) AS px, CAST(y AS INT) AS py FROM (SELECT n_nationkey AS k, 2 + n_nationkey % 5 AS s FROM nation) t, (SELECT unnest(range(0, 8)) AS i) a, (SELECT unnest(range(0, 8)) AS j) b, LATERAL (SELECT k * 3 + i AS x, k * 2 + j AS y) WHERE i + j <= s")
def mesh_coverage(spark, d):
    n = T.table(spark, d, "nation").select((F.col("n_nationkey") * 3).alias("x"), (F.col("n_nationkey") * 2).alias("y"), (2 + F.col("n_nationkey") % 5).alias("s"))
    tri = n.select(F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("s")).alias("bx"), F.col("y").alias("by"), F.col("x").alias("cx"), (F.col("y") + F.col("s")).alias("cy"))
    return M.covered(tri)


#: A lattice of 4 x 4 cells from nations, some of its nodes without a value, and its value at points by four corners.
LATTICE = "l AS (SELECT CAST(n_nationkey % 5 AS INT) AS i, CAST(n_nationkey // 5 AS INT) AS j, CASE WHEN n_nationkey % 11 <> 3 THEN n_regionkey * CAST(1.5 AS DOUBLE) - n_nationkey END AS v FROM nation)"
AT_POINTS = """h AS (SELECT *, least(greatest(fx, 0), 4) AS gx, least(greatest(fy, 0), 4) AS gy FROM p),
k AS (SELECT *, CAST(least(floor(gx), 3) AS INT) AS ci, CAST(least(floor(gy), 3) AS INT) AS cj FROM h),
f AS (SELECT k.*, a.v * (1 - (gx - ci)) * (1 - (gy - cj)) + b.v * (gx - ci) * (1 - (gy - cj)) + c.v * (1 - (gx - ci)) * (gy - cj) + e.v * (gx - ci) * (gy - cj) AS inner_
  FROM k LEFT JOIN l a ON a.i = ci AND a.j = cj LEFT JOIN l b ON b.i = ci + 1 AND b.j = cj LEFT JOIN l c ON c.i = ci AND c.j = cj + 1 LEFT JOIN l e ON e.i = ci + 1 AND e.j = cj + 1),
n AS (SELECT k, corner, arg_min(l.v, ((l.i - gx) ** 2 + (l.j - gy) ** 2, l.j, l.i)) AS near FROM f, l WHERE l.v IS NOT NULL AND inner_ IS NULL GROUP BY 1, 2),
at_ AS (SELECT f.k, f.corner, coalesce(inner_, near) AS v FROM f LEFT JOIN n ON n.k = f.k AND n.corner = f.corner)"""


def lattice_nodes(spark, d):
    n = F.col("n_nationkey")
    return T.table(spark, d, "nation").select((n % 5).alias("i"), F.expr("CAST(n_nationkey div 5 AS INT)").alias("j"), F.when(n % 11 != 3, F.col("n_regionkey") * 1.5 - n).alias("v"))


@query("e17_lattice_range", f"""
WITH {LATTICE}, c AS (SELECT c_custkey AS k, (c_custkey % 37) / CAST(10 AS DOUBLE) AS x0, (c_custkey % 23) / CAST(8 AS DOUBLE) AS y0, (c_custkey % 37) / CAST(10 AS DOUBLE) + (c_custkey % 5) / CAST(4 AS DOUBLE) AS x1, (c_custkey % 23) / CAST(8 AS DOUBLE) + (c_custkey % 7) / CAST(4 AS DOUBLE) AS y1 FROM customer),
p AS (SELECT k, 0 AS corner, x0 AS fx, y0 AS fy FROM c UNION ALL SELECT k, 1, x1, y0 FROM c UNION ALL SELECT k, 2, x0, y1 FROM c UNION ALL SELECT k, 3, x1, y1 FROM c),
{AT_POINTS}, u AS (SELECT k, v FROM at_ UNION ALL SELECT c.k, l.v FROM c JOIN l ON l.i BETWEEN c.x0 AND c.x1 AND l.j BETWEEN c.y0 AND c.y1)
SELECT k, round(min(v), 6) + 0.0 AS lo, round(max(v), 6) + 0.0 AS hi FROM u GROUP BY k""")
def lattice_range(spark, d):
    k = F.col("c_custkey")
    x0, y0 = (k % 37) / 10.0, (k % 23) / 8.0
    boxes = T.table(spark, d, "customer").select(k.alias("k"), x0.alias("x0"), y0.alias("y0"), (x0 + (k % 5) / 4.0).alias("x1"), (y0 + (k % 7) / 4.0).alias("y1"))
    return R.lattice_range(boxes, lattice_nodes(spark, d), (4, 4)).select("k", *[(F.round(c, 6) + 0.0).alias(c) for c in ("lo", "hi")])


@query("e19_availability_class", f"WITH {T.PIXEL_SQL}, a AS (SELECT px >> 2 AS tx, py >> 2 AS ty, CAST(floor(avg(mask)) AS INT) AS m FROM pixel GROUP BY 1, 2) SELECT tx, ty, CASE WHEN m = 0 THEN 0 WHEN m >= 255 THEN 192 ELSE 128 END AS value FROM a")
def availability_class(spark, d):
    a = T.pixels(spark, d).groupBy(F.shiftright("px", 2).alias("tx"), F.shiftright("py", 2).alias("ty")).agg(F.floor(F.avg("mask")).alias("m"))
    return a.select("tx", "ty", F.when(F.col("m") == 0, 0).when(F.col("m") >= 255, 0xC0).otherwise(0x80).alias("value"))


@query("e22_split_by_material", "SELECT p_brand AS material, count(*) AS faces, count(DISTINCT p_size) AS vertices FROM part GROUP BY 1")
def by_material(spark, d):
    faces = T.table(spark, d, "part").select(F.col("p_partkey").alias("fid"), F.array("p_size").alias("corners"), F.col("p_brand").alias("material"))
    return M.split(faces).groupBy("material").agg(F.count_distinct("fid").alias("faces"), F.max("local").cast("long").alias("vertices"))


_LON, _LAT = "(px * CAST(2.8125 AS DOUBLE) - 180)", "(80 - py * CAST(1.25 AS DOUBLE))"
_CLON, _CLAT = "(((px >> 4) * 16 + 8) * CAST(2.8125 AS DOUBLE) - 180)", "(80 - ((py >> 4) * 16 + 8) * CAST(1.25 AS DOUBLE))"


@query("f5_grey_normals", f"""
WITH {_BLOCK}, g AS (SELECT px, py, mask FROM cell),
w AS (SELECT a.px + 1 AS px, a.py, (b.mask - a.mask) AS gx FROM g a JOIN g b ON b.px = a.px + 2 AND b.py = a.py), u AS (SELECT a.px, a.py + 1 AS py, (b.mask - a.mask) AS gy FROM g a JOIN g b ON b.px = a.px AND b.py = a.py + 2),
s AS (SELECT px, py, gx * (CAST(-0.427 AS DOUBLE) / 255) AS gx, gy * (CAST(-0.427 AS DOUBLE) / 255) AS gy FROM w JOIN u USING (px, py)),
n AS (SELECT px, py, round(-gx / sqrt(gx * gx + gy * gy + 1), 6) AS nx, round(-gy / sqrt(gx * gx + gy * gy + 1), 6) AS ny, round(1 / sqrt(gx * gx + gy * gy + 1), 6) AS nz, radians({_LON}) AS lo, radians({_LAT}) AS la, radians({_CLON}) AS clo, radians({_CLAT}) AS cla FROM s),
x AS (SELECT *, -sin(lo) * nx - sin(la) * cos(lo) * ny + cos(la) * cos(lo) * nz AS gx, cos(lo) * nx - sin(la) * sin(lo) * ny + cos(la) * sin(lo) * nz AS gy, cos(la) * ny + sin(la) * nz AS gz FROM n),
t AS (SELECT px, py, round(-sin(clo) * gx + cos(clo) * gy, 5) + 0.0 AS nx, round(-sin(cla) * cos(clo) * gx - sin(cla) * sin(clo) * gy + cos(cla) * gz, 5) + 0.0 AS ny, round(cos(cla) * cos(clo) * gx + cos(cla) * sin(clo) * gy + sin(cla) * gz, 5) + 0.0 AS nz FROM x),
o AS (SELECT *, nx / (abs(nx) + abs(ny) + abs(nz)) AS ox, ny / (abs(nx) + abs(ny) + abs(nz)) AS oy FROM t)
SELECT px, py, nx, ny, nz, CAST(floor((CASE WHEN nz >= 0 THEN ox ELSE (1 - abs(oy)) * CASE WHEN ox >= 0 THEN 1 ELSE -1 END END * 0.5 + 0.5) * 255 + 0.5) AS INT) AS u, CAST(floor((CASE WHEN nz >= 0 THEN oy ELSE (1 - abs(ox)) * CASE WHEN oy >= 0 THEN 1 ELSE -1 END END * 0.5 + 0.5) * 255 + 0.5) AS INT) AS v FROM o""")
def grey_normals(spark, d):
    n = R.gradients(blocks(spark, d), scale=0.5, z_factor=-0.427 / 255, value="mask")
    lon, lat = (lambda c: c * 2.8125 - 180), (lambda c: 80 - c * 1.25)
    mid = lambda c: F.shiftright(c, 4) * 16 + 8
    flat = V.on_plane([F.col(c) for c in ("nx", "ny", "nz")], lon(F.col("px")), lat(F.col("py")), lon(mid("px")), lat(mid("py")))
    flat = n.select(*R.PIX, *[(F.round(c, 5) + 0.0).alias(a) for c, a in zip(flat, ("nx", "ny", "nz"), strict=True)])
    u, v = R.octahedral([F.col(c) for c in ("nx", "ny", "nz")])
    return flat.withColumn("u", u).withColumn("v", v)


@query("f8_lattice_interpolation", f"WITH {LATTICE}, p AS (SELECT c_custkey AS k, 0 AS corner, (c_custkey % 37) / CAST(37 AS DOUBLE) * CAST(4.5 AS DOUBLE) - 0.2 AS fx, (c_custkey % 23) / CAST(23 AS DOUBLE) * CAST(3.9 AS DOUBLE) AS fy FROM customer), {AT_POINTS} SELECT k AS c_custkey, round(v, 6) + 0.0 AS v FROM at_")
def lattice(spark, d):
    points = T.table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") % 37) / 37.0 * 4.5 - 0.2).alias("fx"), ((F.col("c_custkey") % 23) / 23.0 * 3.9).alias("fy"))
    return R.bilinear(points, lattice_nodes(spark, d), (4, 4)).select("c_custkey", (F.round("v", 6) + 0.0).alias("v"))


@query("f11_margins", f"WITH {LEAF} SELECT x, y, x * 8 - 0.5 AS xa, (x + 1) * 8 + 0.5 AS xb, y * 8 - 1.0 AS ya, (y + 1) * 8 + 1.0 AS yb FROM leaf".replace("- 0.5 AS", "- CAST(0.5 AS DOUBLE) AS").replace("+ 0.5 AS", "+ CAST(0.5 AS DOUBLE) AS").replace("- 1.0 AS", "- CAST(1 AS DOUBLE) AS").replace("+ 1.0 AS", "+ CAST(1 AS DOUBLE) AS"))
def margins(spark, d):
    x, y = F.col("x"), F.col("y")
    return leaf(spark, d).select("x", "y", (x * 8 - 0.5).alias("xa"), ((x + 1) * 8 + 0.5).alias("xb"), (y * 8 - 1.0).alias("ya"), ((y + 1) * 8 + 1.0).alias("yb"))


@query("g7_level_bounds", f"WITH {PYRAMID} SELECT lod, least(max(x) >> 5, CAST(pow(2, lod) AS INT) - 1) AS bx, least(greatest(lod, 2), 6) AS clamped FROM pyramid GROUP BY lod")
def clamped(spark, d):
    return tiles(spark, d).groupBy("lod").agg(F.max("x").alias("m")).select("lod", F.least(F.shiftright("m", 5), F.pow(F.lit(2.0), "lod").cast("int") - 1).alias("bx"), F.least(F.greatest("lod", F.lit(2)), F.lit(6)).alias("clamped"))


@query("h4_mask_subtraction", f"WITH {INDEX}, {OTHER} SELECT lod, x, y, flags FROM idx i WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.lod = i.lod AND o.x = i.x AND o.y = i.y)")
def subtraction(spark, d):
    return index(spark, d).join(other(spark, d), P.TILE, "left_anti")


@query("h6_credit_merge", "SELECT a.n_nationkey, CASE WHEN a.n_nationkey % 4 = 0 THEN b.n_name WHEN a.n_name < b.n_name THEN a.n_name || ',' || b.n_name WHEN a.n_name = b.n_name THEN a.n_name ELSE b.n_name || ',' || a.n_name END AS credits FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey")
def credit_merge(spark, d):
    n = T.table(spark, d, "nation")
    b = n.select(F.col("n_nationkey").alias("k"), F.array("n_name").alias("b"))
    j = n.join(b, F.col("n_regionkey") == F.col("k"))
    return j.select("n_nationkey", F.array_join(C.merged_credits(F.array("n_name"), F.col("b"), F.col("n_nationkey") % 4 == 0), ",").alias("credits"))


@query("h8_ordered_distinct", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def ordered_distinct(spark, d):
    return T.first_per_key(T.table(spark, d, "orders"), "o_custkey", ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("h9_quad_union", f"WITH {INDEX}, {OTHER} SELECT lod, x, y FROM idx UNION SELECT lod, x, y FROM other")
def quad_union(spark, d):
    return index(spark, d).select(*P.TILE).unionByName(other(spark, d).select(*P.TILE)).distinct()


@query("i2_rooted_ids", f"WITH {PYRAMID} SELECT lod, x, y, greatest(lod - 2, 0) AS tl, CASE WHEN lod < 2 THEN 0 ELSE x - CAST(pow(2, lod - 2) AS INT) END AS tx, CASE WHEN lod < 2 THEN 0 ELSE y - 2 * CAST(pow(2, lod - 2) AS INT) END AS ty FROM pyramid")
def rooted(spark, d):
    k, tx, ty = S.below_root(F.col("lod"), F.col("x"), F.col("y"), (2, 1, 2))
    return tiles(spark, d).select(*P.TILE, k.alias("tl"), tx.alias("tx"), ty.alias("ty"))


@query("i8_survey_scalars", "SELECT o_orderkey, CASE WHEN CAST(round(o_totalprice / 100 - 360 / 0.25) AS INT) > 0 THEN CAST(round(o_totalprice / 100 - 360 / 0.25) AS INT) END AS overlap, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE sqrt((o_custkey % 4) / CAST(2 AS DOUBLE)) END AS scale, o_custkey % 4 = 1 AS navtile FROM orders")
def survey_scalars(spark, d):
    k = (F.col("o_custkey") % 4).cast("double")
    scale = S.true_scale(k / 2, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return T.table(spark, d, "orders").select("o_orderkey", S.x_overlap(F.col("o_totalprice") / 100, 360.0, 0.25).alias("overlap"), scale.alias("scale"), (scale < 1).alias("navtile"))


@query("i13_progression", f"WITH {PYRAMID} SELECT DISTINCT lod, round(2.5 * pow(1.25, 5 - lod), 9) AS z, round(40 * pow(0.5, 5 - lod), 9) AS azimuth FROM pyramid")
def progressions(spark, d):
    go = lambda v, f: F.round(S.progression(F.lit(v), F.lit(f), 5, F.col("lod")), 9)
    return tiles(spark, d).select("lod").distinct().select("lod", go(2.5, 1.25).alias("z"), go(40.0, 0.5).alias("azimuth"))


@query("i22_geocentric", "WITH p AS (SELECT c_custkey, radians(c_nationkey * 10 - 120) AS lo, radians(c_custkey % 160 - 80) AS la, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e FROM customer), q AS (SELECT *, 6378137.0 / sqrt(1 - e * sin(la) * sin(la)) AS n FROM p) SELECT c_custkey, round(n * cos(la) * cos(lo), 3) + 0.0 AS gx, round(n * cos(la) * sin(lo), 3) + 0.0 AS gy, round(n * (1 - e) * sin(la), 3) + 0.0 AS gz FROM q")
def geocentric(spark, d):
    g = S.geocentric((F.col("c_nationkey") * 10 - 120).cast("double"), (F.col("c_custkey") % 160 - 80).cast("double"), F.lit(0.0))
    return T.table(spark, d, "customer").select("c_custkey", *[(F.round(c, 3) + 0.0).alias(n) for c, n in zip(g, ["gx", "gy", "gz"], strict=True)])


@query("i22_geoid", f"WITH {LATTICE}, p AS (SELECT c_custkey AS k, 0 AS corner, (c_nationkey * 10 + 5) / CAST(62.5 AS DOUBLE) AS fx, (c_custkey % 160 + 10) / CAST(45 AS DOUBLE) AS fy FROM customer), {AT_POINTS}, c AS (SELECT c_custkey, v AS u, radians(CAST(c_nationkey * 10 - 120 AS DOUBLE)) AS lo, radians(CAST(c_custkey % 160 - 80 AS DOUBLE)) AS la, CAST(c_acctbal AS DOUBLE) AS h, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e FROM customer JOIN at_ ON k = c_custkey), q AS (SELECT *, 6378137.0 / sqrt(1 - e * sin(la) * sin(la)) AS n FROM c) SELECT c_custkey, round((n + h + u) * cos(la) * cos(lo), 3) + 0.0 AS gx, round((n + h + u) * cos(la) * sin(lo), 3) + 0.0 AS gy, round((n * (1 - e) + h + u) * sin(la), 3) + 0.0 AS gz, round(h - u, 6) + 0.0 AS nav FROM q")
def geoid(spark, d):
    """Heights above the geoid in geocentric axes, and heights above the ellipsoid as navigation heights."""
    c = T.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 10 - 120).cast("double").alias("lon"), (F.col("c_custkey") % 160 - 80).cast("double").alias("lat"), F.col("c_acctbal").cast("double").alias("h"), ((F.col("c_nationkey") * 10 + 5) / 62.5).alias("fx"), ((F.col("c_custkey") % 160 + 10) / 45.0).alias("fy"))
    at = R.bilinear(c, lattice_nodes(spark, d), (4, 4))
    g = S.geocentric(F.col("lon"), F.col("lat"), F.col("h") + F.col("v"))
    return at.select("c_custkey", *[(F.round(c, 3) + 0.0).alias(n) for c, n in zip(g, ["gx", "gy", "gz"], strict=True)], (F.round(F.col("h") - F.col("v"), 6) + 0.0).alias("nav"))


@query("i31_acronyms", r"""
WITH t AS (SELECT p_partkey, regexp_extract_all('The U.S.A. of ' || p_name || ' by J. R. and A B C, s.r.o', '(?:[A-Za-z] ?[. ])+|[A-Za-z0-9]+|[^A-Za-z0-9]+') AS parts FROM part)
SELECT p_partkey, array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_full_match(x, '(?:[A-Za-z] ?[. ])+') THEN translate(x, '. ', '') || ' ' ELSE x END), '') AS name FROM t""")
def acronyms(spark, d):
    text = F.concat(F.lit("The U.S.A. of "), F.col("p_name"), F.lit(" by J. R. and A B C, s.r.o"))
    return T.table(spark, d, "part").select("p_partkey", S.contract_acronyms(text).alias("name"))


@query("i38_tile_matrices", f"WITH {PYRAMID} SELECT lod, CAST(pow(2, lod) AS BIGINT) AS width, 40075016.68557849 / pow(2, lod) / 256 / 0.00028 AS denominator, min(x) AS col0, max(x) AS col1 FROM pyramid GROUP BY lod")
def tile_matrices(spark, d):
    n = F.pow(F.lit(2.0), F.col("lod"))
    return tiles(spark, d).groupBy("lod").agg(F.min("x").alias("col0"), F.max("x").alias("col1")).select("lod", n.cast("long").alias("width"), (40075016.68557849 / n / 256 / 0.00028).alias("denominator"), "col0", "col1")


@query("l8_point_lookup", f"WITH {INDEX} SELECT lod, x, y, flags FROM idx WHERE lod = 3 AND x = 2 AND y = 5")
def point_lookup(spark, d):
    return index(spark, d).where("lod = 3 AND x = 2 AND y = 5")
