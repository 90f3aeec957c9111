"""The engine's queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import catalogue as C
from tessera.operators import mesh as M
from tessera.operators import pyramid as P
from tessera.operators import raster as R
from tessera.plans.registry import query
from tessera.sources import store
from tessera.sources import tables as T

LOD, SHIFT = T.LEAF_LOD, T.TILE_SHIFT
LEAF = f"""{T.PIXEL_SQL},
leaf AS (
  SELECT px >> 3 AS x, py >> 3 AS y, min(mask) = 255 AS watertight, min(z) AS min_z, max(z) AS max_z
  FROM pixel GROUP BY 1, 2 HAVING max(mask) > 0 AND min(z) IS NOT NULL)"""
PYRAMID = f"""{LEAF},
pyramid AS (
  SELECT CAST(7 - s AS INT) AS lod, CAST(x >> s AS INT) AS x, CAST(y >> s AS INT) AS y, bool_and(watertight) AND count(*) = CAST(pow(4, s) AS BIGINT) AS watertight, count(*) AS n_leaves, min(min_z) AS min_z, max(max_z) AS max_z
  FROM leaf, (SELECT unnest(range(0, 8)) AS s) GROUP BY s, 1, 2, 3)"""
INDEX = f"{PYRAMID}, idx AS (SELECT lod, x, y, CASE WHEN watertight THEN 3 ELSE 1 END AS flags FROM pyramid)"
CELL = f"{T.PIXEL_SQL}, cell AS (SELECT px, py, max(z) AS z, max(mask) AS mask FROM pixel GROUP BY 1, 2)"
OTHER = """
other AS (
  SELECT DISTINCT CAST(s AS INT) AS lod, CAST((o_custkey % 128) >> (7 - s) AS INT) AS x, CAST((o_orderkey % 128) >> (7 - s) AS INT) AS y, 1 AS flags
  FROM orders, (SELECT unnest(range(0, 8)) AS s) WHERE o_orderstatus <> 'P')"""


def leaf(spark: SparkSession, d: str) -> DataFrame:
    return P.leaves(T.pixels(spark, d), LOD, SHIFT)


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return P.pyramid(leaf(spark, d), LOD)


def index(spark: SparkSession, d: str) -> DataFrame:
    return P.flags(tiles(spark, d))


def other(spark: SparkSession, d: str) -> DataFrame:
    """An index of a second raster, from orders."""
    o = T.table(spark, d, "orders").where("o_orderstatus <> 'P'")
    o = o.select((F.col("o_custkey") % 128).cast("int").alias("x"), (F.col("o_orderkey") % 128).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("lod"))
    return o.select("lod", F.expr("shiftright(x, 7 - lod)").alias("x"), F.expr("shiftright(y, 7 - lod)").alias("y"), F.lit(1).alias("flags")).distinct()


def cells(spark: SparkSession, d: str) -> DataFrame:
    return R.cells(T.pixels(spark, d))


@query("a2_dataset_probe", f"WITH {T.PIXEL_SQL} SELECT min(px) AS xmin, max(px) AS xmax, min(py) AS ymin, max(py) AS ymax, count(*) AS n, count(*) FILTER (z IS NULL) AS n_nodata, min(z) AS vmin, max(z) AS vmax, bool_or(mask = 0) AS has_mask FROM pixel")
def probe(spark, d):
    return T.probe(T.pixels(spark, d))


@query("a4_tile_paths", f"WITH {LEAF} SELECT x, y, 'mvt:https://tiles.example/7/' || x || '/' || y || '.pbf' AS path FROM leaf")
def tile_paths(spark, d):
    return leaf(spark, d).select("x", "y", T.tile_path("https://tiles.example/{lod}/{locx}/{y}.pbf").alias("path"))


@query("a5_first_row_lookup", "SELECT nation AS n_nationkey, s_name, s_acctbal FROM (SELECT s_nationkey AS nation, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r = 1")
def first_row(spark, d):
    return T.first_per_key(T.table(spark, d, "supplier"), "s_nationkey", ["s_suppkey"]).select(F.col("s_nationkey").alias("n_nationkey"), "s_name", "s_acctbal")


@query("a6_spatial_query", f"WITH {CELL} SELECT px, py, z FROM cell WHERE px BETWEEN 100 AND 300 AND py BETWEEN 50 AND 250")
def spatial(spark, d):
    return T.bbox(cells(spark, d), 100, 50, 300, 250, "px", "py").select("px", "py", "z")


@query("a9_resources_per_frame", """
SELECT f.rf AS rf, 'g' || (p_size % 5) AS "group", 'r' || p_partkey AS id, 'tms' AS type, p_brand AS driver, CAST(p_size AS INT) AS revision, CASE WHEN p_size % 2 = 0 THEN 'c1' ELSE '' END AS credits, CAST(1 AS INT) AS lod_min, CAST(5 + p_size % 10 AS INT) AS lod_max, CAST(-1 AS INT) AS max_age
FROM part, (VALUES ('earth'), ('mars')) AS f(rf) WHERE f.rf = 'earth' OR p_size % 3 = 0""")
def resources(spark, d):
    p = T.table(spark, d, "part")
    text = F.format_string('{"group":"g%d","id":"r%d","type":"tms","driver":"%s","revision":%d,%s"referenceFrames":{"earth":{"lodRange":[1,%d]}%s}}', F.col("p_size") % 5, "p_partkey", "p_brand", "p_size", F.when(F.col("p_size") % 2 == 0, '"credits":["c1"],').otherwise(""), 5 + F.col("p_size") % 10, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(',"mars":{"lodRange":[1,'), (5 + F.col("p_size") % 10).cast("string"), F.lit("]}"))).otherwise(""))
    return T.resources_from_json(p.select(text.alias("j")), "j").withColumn("credits", F.array_join("credits", ","))


@query("b2_sentinels", f"WITH {T.PIXEL_SQL} SELECT px >> 3 AS x, py >> 3 AS y, CASE WHEN max(mask) = 0 THEN 'EMPTY' WHEN min(mask) = 255 THEN 'FULL' ELSE 'DATA' END AS status FROM pixel GROUP BY 1, 2")
def sentinels(spark, d):
    g = T.pixels(spark, d).groupBy(F.shiftright("px", 3).alias("x"), F.shiftright("py", 3).alias("y"))
    return g.agg(F.when(F.max("mask") == 0, "EMPTY").when(F.min("mask") == 255, "FULL").otherwise("DATA").alias("status"))


@query("b3_cache_age", "SELECT event_id, CAST(CASE WHEN value < 5 THEN 0 WHEN event_type = 'click' THEN 60 WHEN event_type = 'view' THEN 3600 ELSE -1 END AS INT) AS max_age FROM events")
def cache_age(spark, d):
    return T.table(spark, d, "events").select("event_id", C.cache_age(F.when(F.col("value") < 5, 0), F.col("event_type"), {"click": 60, "view": 3600}).alias("max_age"))


@query("b12_bound_layer", """
SELECT p_partkey, '{"id":"rf/g/' || p_brand || '","type":"raster","url":"{lod}-{x}-{y}.jpg?gr=2&r=' || p_size || '","maskUrl":"{lod}-{x}-{y}.mask?gr=2&r=' || p_size || '","metaUrl":"{lod}-{x}-{y}.meta?gr=2&r=' || p_size || '"}' AS json FROM part""")
def bound_layer(spark, d):
    return T.table(spark, d, "part").select("p_partkey", C.bound_layer(F.lit("rf"), F.lit("g"), F.col("p_brand"), F.lit("jpg"), 2, F.col("p_size")).alias("json"))


_LONLAT = "radians({0} * (360 / pow(2, lod)) - 180) * 6378137.0", "ln(tan(pi() / 4 + radians(least(greatest(90 - {0} * (180 / pow(2, lod)), -85), 85)) / 2)) * 6378137.0"


@query("b17_level_bounds", f"""
WITH {PYRAMID}, r AS (SELECT lod, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pyramid WHERE lod >= 3 GROUP BY lod),
a AS (SELECT * FROM r UNION ALL SELECT 0, 1, 0, 0, 0, 0)
SELECT l.lod, coalesce(a.n, 0) AS n, x0, x1, y0, y1, round({_LONLAT[0].format("x0")}, 3) + 0.0 AS xmin, round({_LONLAT[0].format("(x1 + 1)")}, 3) + 0.0 AS xmax, round({_LONLAT[1].format("(y1 + 1)")}, 3) + 0.0 AS ymin, round({_LONLAT[1].format("y0")}, 3) + 0.0 AS ymax
FROM (SELECT CAST(unnest(range(0, 9)) AS INT) AS lod) l LEFT JOIN a USING (lod)""")
def level_bounds(spark, d):
    from tessera.operators.survey import level_bounds as bounds

    r = tiles(spark, d).where("lod >= 3").groupBy("lod").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return bounds(r, 0, 8)


@query("b19_listings", "SELECT DISTINCT p_brand AS rf, p_type AS type FROM part")
def listings(spark, d):
    return T.table(spark, d, "part").select(F.col("p_brand").alias("rf"), F.col("p_type").alias("type")).distinct()


@query("c1_resource_ranges", f"WITH {PYRAMID} SELECT lod, x, y FROM pyramid WHERE lod BETWEEN 3 AND 6 AND (x >> greatest(lod - 3, 0)) BETWEEN 1 AND 4 AND (y >> greatest(lod - 3, 0)) BETWEEN 2 AND 6")
def ranges(spark, d):
    return tiles(spark, d).where(P.in_ranges(F.col("lod"), F.col("x"), F.col("y"), (3, 6), (1, 2, 4, 6))).select(*P.TILE)


@query("c2_world_membership", f"WITH {PYRAMID} SELECT lod, x, y FROM pyramid WHERE (lod = 7 AND x BETWEEN 3 AND 50 AND y BETWEEN 9 AND 80) OR (lod = 7 AND x BETWEEN 40 AND 90 AND y BETWEEN 60 AND 127) OR (lod = 5 AND x BETWEEN 0 AND 9 AND y BETWEEN 0 AND 9)")
def world(spark, d):
    boxes = [(7, 3, 9, 50, 80), (7, 40, 60, 90, 127), (5, 0, 0, 9, 9)]
    inside = reduce(lambda a, b: a | b, [(F.col("lod") == q) & F.col("x").between(a, c) & F.col("y").between(b, e) for q, a, b, c, e in boxes])
    return tiles(spark, d).where(inside).select(*P.TILE)


@query("c3_existence_gate", f"WITH {INDEX}, {OTHER} SELECT lod, x, y FROM other WHERE EXISTS (SELECT 1 FROM idx i WHERE i.lod = other.lod AND i.x = other.x AND i.y = other.y AND i.flags & 1 = 1)")
def gate(spark, d):
    return other(spark, d).join(index(spark, d).where(F.col("flags").bitwiseAND(1) == 1), P.TILE, "left_semi").select(*P.TILE)


@query("c4_path_classifier", r"""
WITH r AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS path FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda c: c <> '') AS p, path LIKE '%/' AS slash FROM r)
SELECT page_id, CASE WHEN len(p) = 0 THEN 'frames' WHEN len(p) <= 4 AND NOT slash THEN 'redirect' WHEN len(p) = 1 THEN 'types' WHEN len(p) = 2 THEN 'groups' WHEN len(p) = 3 THEN 'ids' WHEN len(p) = 4 THEN 'resource' ELSE 'not found' END AS kind FROM s""")
def paths(spark, d):
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "")
    return T.table(spark, d, "pages").select("page_id", S.classify_path(path).alias("kind"))


@query("c5_tile_names", f"WITH {PYRAMID} SELECT DISTINCT lod, x, y, lod || '-' || x || '-' || y || '.jpg' AS name, 'jpg' AS ext, 'image/jpeg' AS content FROM pyramid")
def tile_names(spark, d):
    names = tiles(spark, d).select(F.concat(F.concat_ws("-", *P.TILE), F.lit(".jpg")).alias("name"))
    lod, x, y, ext = S.tile_of(F.col("name"))
    return names.select(lod.alias("lod"), x.alias("x"), y.alias("y"), "name", ext.alias("ext"), S.content_type(ext).alias("content"))


@query("c9_layer_selection", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def layers(spark, d):
    return T.table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("c11_feature_filter", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^PRO|RG')")
def feature_filter(spark, d):
    p = T.table(spark, d, "part").withColumn("props", F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand")))
    return p.where(C.feature_filter("props", "type", "^PRO|RG")).select("p_partkey")


@query("c14_skip_partial", f"WITH {PYRAMID} SELECT DISTINCT p.lod, p.x, p.y, p.watertight AS served FROM pyramid p JOIN pyramid q ON q.watertight AND q.lod >= p.lod AND q.x >> (q.lod - p.lod) = p.x AND q.y >> (q.lod - p.lod) = p.y")
def skip_partial(spark, d):
    served, kept = P.skip_partial(tiles(spark, d))
    return kept.select(*P.TILE, F.col("watertight").alias("served"))


@query("c15_spatial_prune", f"""
WITH {PYRAMID}, floor_ AS (SELECT lod, x, y, 4 + (x * 7 + y * 3) % 5 // 2 AS f FROM (SELECT DISTINCT lod, (x >> 1) * 2 + i % 2 AS x, (y >> 1) * 2 + i // 2 AS y FROM pyramid, (SELECT unnest(range(0, 4)) AS i) WHERE lod > 0)),
gone AS (SELECT lod, x >> 1 AS px, y >> 1 AS py FROM floor_ GROUP BY 1, 2, 3 HAVING bool_and(lod > f))
SELECT lod, x, y FROM pyramid p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lod = p.lod AND g.px = p.x >> 1 AND g.py = p.y >> 1)""")
def prune(spark, d):
    return P.prune(tiles(spark, d), F.expr("4 + ((x * 7 + y * 3) % 5) div 2")).select(*P.TILE)


@query("c16_mask_tree", f"""
WITH {INDEX}, m AS (SELECT lod, x, y, CASE (x + y) % 3 WHEN 0 THEN 'black' WHEN 1 THEN 'gray' ELSE 'white' END AS state FROM idx WHERE x % 2 = 0)
SELECT i.lod, i.x, i.y, CASE WHEN m.state = 'gray' THEN i.flags & ~2 ELSE i.flags END AS flags FROM idx i LEFT JOIN m USING (lod, x, y) WHERE m.state IS NULL OR m.state <> 'black'""")
def mask_tree(spark, d):
    i = index(spark, d)
    k = (F.col("x") + F.col("y")) % 3
    return P.mask_tree(i, i.where("x % 2 = 0").select(*P.TILE, F.when(k == 0, "black").when(k == 1, "gray").otherwise("white").alias("state")))


@query("c18_dataset_kind", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 6 BETWEEN 1 AND 4 THEN 'ophoto' WHEN p_size % 6 = 1 AND p_size % 3 <> 0 THEN 'dem' WHEN p_size % 6 = 0 THEN 'vector' ELSE 'error' END AS kind FROM part")
def kinds(spark, d):
    return T.table(spark, d, "part").select("p_partkey", C.dataset_kind(F.col("p_size") % 6, F.col("p_size") % 3 == 0).alias("kind"))


@query("c21_change_kind", "SELECT a.p_partkey, CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'yes' WHEN a.p_type IS DISTINCT FROM b.p_type THEN 'withRevisionBump' WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'safely' ELSE 'no' END AS change, CAST(greatest(a.p_size, b.p_size) + CASE WHEN a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_type IS DISTINCT FROM b.p_type THEN 1 ELSE 0 END AS INT) AS revision FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def changes(spark, d):
    p = T.table(spark, d, "part")
    a, b = p.select("p_partkey", F.struct("*").alias("old")), p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.struct("*").alias("new"))
    kind = C.change_kind([("p_brand", "yes"), ("p_type", "withRevisionBump"), ("p_size", "safely")])
    return a.join(b, "p_partkey").select("p_partkey", kind.alias("change"), C.revision(F.col("old.p_size"), F.col("new.p_size"), kind).alias("revision"))


@query("d1_enhance", "SELECT c.c_custkey, c.c_name AS name, CASE WHEN f.s_suppkey IS NULL THEN NULL ELSE f.s_name END AS s_name, CASE WHEN f.s_suppkey IS NOT NULL THEN CAST(f.s_suppkey AS VARCHAR) END AS s_suppkey FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) f ON f.s_nationkey = c.c_nationkey AND f.r = 1")
def enhance(spark, d):
    c = T.table(spark, d, "customer").withColumn("props", F.create_map(F.lit("name"), F.col("c_name")))
    s = T.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.lit("lost").alias("name"), F.col("s_suppkey").alias("_order"))
    p = C.enhance(c, s, "c_nationkey", "s_nationkey")
    return p.select("c_custkey", F.col("props")["name"].alias("name"), F.try_element_at("props", F.lit("s_name")).alias("s_name"), F.try_element_at("props", F.lit("s_suppkey")).alias("s_suppkey"))


@query("d2_combine", f"WITH {INDEX}, {OTHER} SELECT i.lod, i.x, i.y, i.flags | o.flags AS flags FROM idx i JOIN other o USING (lod, x, y) WHERE lod BETWEEN 4 AND 7 UNION ALL SELECT lod, x, y, flags FROM idx WHERE lod NOT BETWEEN 4 AND 7")
def combine(spark, d):
    return P.combine(index(spark, d), other(spark, d), (4, 7))


@query("d3_serve", f"WITH {PYRAMID} SELECT lod, x, y, CASE WHEN lod >= 3 THEN CASE WHEN watertight THEN 3 ELSE 1 END ELSE 0 END AS flags, min_z, max_z FROM pyramid")
def serve(spark, d):
    return P.serve(index(spark, d).where("lod >= 3"), tiles(spark, d).select(*P.TILE, "min_z", "max_z"))


_WRONG = """SELECT 'unreachable payload' AS kind, lod, x, y FROM bad b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lod >= b.lod AND i.x >> (i.lod - b.lod) = b.x AND i.y >> (i.lod - b.lod) = b.y)
UNION ALL SELECT 'payload without parent', lod, x, y FROM bad b WHERE lod > 0 AND NOT EXISTS (SELECT 1 FROM bad p WHERE p.lod = b.lod - 1 AND p.x = b.x >> 1 AND p.y = b.y >> 1)
UNION ALL SELECT 'parent does not contain child', b.lod, b.x, b.y FROM bad b JOIN bad p ON p.lod = b.lod - 1 AND p.x = b.x >> 1 AND p.y = b.y >> 1 WHERE b.min_z < p.min_z OR b.max_z > p.max_z
UNION ALL SELECT 'tile without payload', lod, x, y FROM i WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.lod = i.lod AND b.x = i.x AND b.y = i.y)
UNION ALL SELECT 'watertight with some children', i.lod, i.x, i.y FROM i JOIN (SELECT lod - 1 AS lod, x >> 1 AS x, y >> 1 AS y, count(*) AS n FROM i WHERE lod > 0 GROUP BY 1, 2, 3) k USING (lod, x, y) WHERE i.flags & 2 <> 0 AND k.n BETWEEN 1 AND 3"""


@query("d4_pair_check", f"""
WITH {PYRAMID}, bad AS (SELECT lod, x, y, CASE WHEN lod = 5 AND x % 16 = 3 THEN min_z + 1e6 ELSE min_z END AS min_z, max_z + CASE WHEN lod = 5 AND x % 16 = 3 THEN 1e6 ELSE 0 END AS max_z FROM pyramid WHERE NOT (lod = 6 AND x % 8 = 1)),
i AS (SELECT lod, x, y, CASE WHEN watertight THEN 3 ELSE 1 END AS flags FROM pyramid WHERE NOT (lod = 7 AND y % 16 = 5))
{_WRONG}""")
def pair_check(spark, d):
    t = tiles(spark, d)
    off = F.when(F.expr("lod = 5 AND x % 16 = 3"), 1e6).otherwise(0.0)
    bad = t.where("NOT (lod = 6 AND x % 8 = 1)").select(*P.TILE, (F.col("min_z") + off).alias("min_z"), (F.col("max_z") + off).alias("max_z"))
    return P.check_pair(index(spark, d).where("NOT (lod = 7 AND y % 16 = 5)"), bad)


_KINDS = ", ".join(f"('{k}')" for k in P.VIOLATIONS)


@query("d4_pair_sound", f"""
WITH {PYRAMID}, bad AS (SELECT lod, x, y, min_z, max_z FROM pyramid), i AS (SELECT lod, x, y, CASE WHEN watertight THEN 3 ELSE 1 END AS flags FROM pyramid),
w AS ({_WRONG})
SELECT k.kind, count(w.kind) AS violations, (SELECT count(*) FROM i) AS tiles FROM (VALUES {_KINDS}) k(kind) LEFT JOIN w ON w.kind = k.kind GROUP BY k.kind""")
def pair_sound(spark, d):
    """How often each rule is broken by a pair as it is made, of how many tiles. The pyramid is written once, as a pair is,
    for five kinds of rows are made of it."""
    made = tiles(spark, d)
    made.write.parquet(path := store.scratch(spark, "pyramid"))
    t = spark.read.schema(made.schema).parquet(path)
    i = P.flags(t)
    found = P.check_pair(i, t.select(*P.TILE, "min_z", "max_z")).groupBy("kind").agg(F.count(F.lit(1)).alias("violations"))
    kinds = spark.createDataFrame([(k,) for k in P.VIOLATIONS], "kind string").join(found, "kind", "left")
    n = i.agg(F.count(F.lit(1)).alias("tiles"))
    return kinds.select("kind", F.coalesce("violations", F.lit(0)).alias("violations")).join(F.broadcast(n), F.lit(True))


@query("d6_index_diff", f"WITH {INDEX}, {OTHER} SELECT lod, x, y, coalesce(i.flags, 0) AS from_flags, coalesce(o.flags, 0) AS to_flags FROM idx i FULL JOIN other o USING (lod, x, y) WHERE coalesce(i.flags, 0) <> coalesce(o.flags, 0)")
def index_diff(spark, d):
    return P.diff(index(spark, d), other(spark, d))


@query("e14_transitions", f"WITH {INDEX}, {OTHER} SELECT lod, coalesce(i.flags, 0) AS from_flags, coalesce(o.flags, 0) AS to_flags, count(*) AS n FROM idx i FULL JOIN other o USING (lod, x, y) WHERE coalesce(i.flags, 0) <> coalesce(o.flags, 0) GROUP BY 1, 2, 3")
def transitions(spark, d):
    return P.transitions(index(spark, d), other(spark, d))


@query("g5_diff_examples", f"WITH {INDEX}, {OTHER}, x AS (SELECT lod, x, y, coalesce(i.flags, 0) AS from_flags, coalesce(o.flags, 0) AS to_flags FROM idx i FULL JOIN other o USING (lod, x, y) WHERE coalesce(i.flags, 0) <> coalesce(o.flags, 0)) SELECT *, CAST(row_number() OVER (PARTITION BY lod ORDER BY y, x) AS INT) AS rank FROM x QUALIFY rank <= 10")
def diff_examples(spark, d):
    return P.examples(P.diff(index(spark, d), other(spark, d)))


@query("d7_reconcile", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'add' WHEN a.id IS NULL AND b.system THEN 'keep' WHEN a.id IS NULL THEN 'remove' WHEN a.bal = b.bal THEN 'keep' ELSE 'replace' END AS action FROM (SELECT c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, c_nationkey = 7 AS system FROM customer WHERE c_custkey % 4 <> 0) b ON a.id = b.id")
def reconcile(spark, d):
    c = T.table(spark, d, "customer")
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    b = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("bal"), (F.col("c_nationkey") == 7).alias("system"))
    return C.reconcile(a, b, ["id"], ["bal"])


@query("d8_view_datasets", """
WITH r AS (SELECT event_id AS request, [user_id % 40, event_id % 40, user_id % 40] AS ids FROM events),
e AS (SELECT request, unnest(ids) AS id, unnest(range(0, 3)) AS pos FROM r),
k AS (SELECT e.*, n_name AS dataset FROM e LEFT JOIN nation ON n_nationkey = id),
f AS (SELECT request, dataset, min(pos) AS pos FROM k WHERE dataset IS NOT NULL GROUP BY 1, 2)
SELECT c.request, coalesce(l.names || ',', '') || 'base' AS datasets, c.complete FROM (SELECT request, bool_and(dataset IS NOT NULL) AS complete FROM k GROUP BY 1) c LEFT JOIN (SELECT request, string_agg(dataset, ',' ORDER BY pos) AS names FROM f GROUP BY 1) l USING (request)""")
def views(spark, d):
    e = T.table(spark, d, "events").select(F.col("event_id").alias("request"), F.array(F.col("user_id") % 40, F.col("event_id") % 40, F.col("user_id") % 40).alias("ids"))
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("dataset"))
    return C.view_datasets(e, n, "base").withColumn("datasets", F.array_join("datasets", ","))


_STACK = "(SELECT px, py, z FROM cell WHERE px % 3 <> 0) a", "(SELECT px >> 2 AS px, py >> 2 AS py, max(z) AS z FROM cell GROUP BY 1, 2) b", "(SELECT px >> 4 AS px, py >> 4 AS py, max(z) AS z FROM cell GROUP BY 1, 2) e"


@query("d9_height_coding", f"""
WITH {CELL}, p AS (SELECT c_custkey, c_custkey % 3 AS mode, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS DOUBLE) END AS z, (c_custkey * 7) % 1100 AS x, c_nationkey * 41 + 5 AS y FROM customer)
SELECT c_custkey, CASE mode WHEN 0 THEN 'always' WHEN 1 THEN 'auto' ELSE 'never' END AS mode, CASE WHEN mode = 2 OR mode = 1 AND p.z IS NOT NULL THEN p.z ELSE coalesce(a.z, b.z, e.z, p.z) END AS z
FROM p LEFT JOIN {_STACK[0]} ON a.px = p.x AND a.py = p.y AND a.z IS NOT NULL LEFT JOIN {_STACK[1]} ON b.px = p.x >> 2 AND b.py = p.y >> 2 LEFT JOIN {_STACK[2]} ON e.px = p.x >> 4 AND e.py = p.y >> 4""")
def height_coding(spark, d):
    g = cells(spark, d).select("px", "py", "z")
    coarse = lambda s: g.groupBy(F.shiftright("px", s).alias("px"), F.shiftright("py", s).alias("py")).agg(F.max("z").alias("z"))
    k = F.col("c_custkey")
    p = T.table(spark, d, "customer").select(k, F.when(k % 3 == 0, "always").when(k % 3 == 1, "auto").otherwise("never").alias("mode"), F.when(k % 2 == 0, F.col("c_acctbal").cast("double")).alias("z"), (k * 7 % 1100).cast("double").alias("x"), (F.col("c_nationkey") * 41 + 5).cast("double").alias("y"))
    stack = [C.Raster(g.where("px % 3 <> 0"), 0.0, 0.0, 1.0), C.Raster(coarse(2), 0.0, 0.0, 4.0), C.Raster(coarse(4), 0.0, 0.0, 16.0)]
    return C.height_code(p, stack, F.col("mode")).select("c_custkey", "mode", "z")


@query("d10_landcover", f"WITH {T.PIXEL_SQL} SELECT p_size AS class, count(*) AS n, max(p_retailprice) AS top FROM pixel JOIN part ON p_partkey = l_suppkey GROUP BY 1")
def landcover(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("l_suppkey"), F.col("p_size").alias("class"), "p_retailprice")
    return T.pixels(spark, d).join(p, "l_suppkey").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("top"))


@query("d11_value_ranges", f"WITH {T.PIXEL_SQL}, r AS (SELECT px, py, min(z) AS lo, max(z) AS hi FROM pixel WHERE z IS NOT NULL GROUP BY 1, 2), v AS (SELECT o_custkey % 1024 AS px, o_orderkey % 1024 AS py, max(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT px, py, greatest(lo, least(hi, coalesce(v, (lo + hi) / 2))) AS v, lo, hi FROM r LEFT JOIN v USING (px, py)")
def value_ranges(spark, d):
    r = T.pixels(spark, d).where("z IS NOT NULL").groupBy(*R.PIX).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    v = T.table(spark, d, "orders").groupBy((F.col("o_custkey") % 1024).cast("int").alias("px"), (F.col("o_orderkey") % 1024).cast("int").alias("py")).agg(F.max("o_totalprice").alias("v"))
    return R.zip_ranges(r, v)


@query("d12_compose", "SELECT n_nationkey AS k, greatest(n_regionkey, r_regionkey) AS revision, CASE WHEN n_name < r_name THEN n_name || ',' || r_name WHEN n_name > r_name THEN r_name || ',' || n_name ELSE n_name END AS credits FROM nation JOIN region ON r_regionkey = n_nationkey")
def compose(spark, d):
    n = T.table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("revision"), F.array("n_name").alias("credits"))
    r = T.table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").alias("revision"), F.array("r_name").alias("credits"))
    return C.compose(n, r, ["k"]).withColumn("credits", F.array_join("credits", ","))


@query("d13_credits", "SELECT c.c_custkey, coalesce(n.n_nationkey, r.r_regionkey + 100) AS num FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_custkey % 60 LEFT JOIN region r ON r.r_regionkey = c.c_custkey % 60 - 25 WHERE n.n_nationkey IS NOT NULL OR r.r_regionkey IS NOT NULL")
def credit_numbers(spark, d):
    want = T.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 60).cast("int").alias("credit"))
    own = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("credit"), F.col("n_nationkey").alias("num"))
    system = T.table(spark, d, "region").select((F.col("r_regionkey") + 25).alias("credit"), (F.col("r_regionkey") + 100).alias("num"))
    return C.credits(want, own, system).drop("credit")


@query("d14_subtree_exists", f"WITH {OTHER}, {INDEX} SELECT DISTINCT i.lod, i.x, i.y FROM idx i JOIN other o ON o.lod = 7 AND i.x = o.x >> (7 - i.lod) AND i.y = o.y >> (7 - i.lod)")
def subtree(spark, d):
    return index(spark, d).join(P.ancestors(other(spark, d).where("lod = 7")), P.TILE, "left_semi").select(*P.TILE)


@query("e1_filter_pass", f"WITH {T.PIXEL_SQL} SELECT px >> 3 AS x, py >> 3 AS y, min(z) AS min_z, max(z) AS max_z, min(mask) AS mask_min, max(mask) AS mask_max FROM pixel GROUP BY 1, 2")
def filter_pass(spark, d):
    return T.pixels(spark, d).groupBy(F.shiftright("px", 3).alias("x"), F.shiftright("py", 3).alias("y")).agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.min("mask").alias("mask_min"), F.max("mask").alias("mask_max"))


@query("e3_leaf_assembly", f"WITH {LEAF} SELECT 7 AS lod, x, y, watertight, min_z, max_z FROM leaf")
def leaf_assembly(spark, d):
    return leaf(spark, d)


@query("e4_mip_pyramid", f"WITH {PYRAMID} SELECT * FROM pyramid")
def mip_pyramid(spark, d):
    return tiles(spark, d)


@query("e4_mip_steps", f"WITH {PYRAMID} SELECT * FROM pyramid WHERE lod >= 4")
def mip_steps(spark, d):
    return P.mip_steps(leaf(spark, d), LOD, lod_min=4, root=2)


#: An area of leaves that a resource is constrained to; missing leaves beyond it don't keep a tile from being watertight.
AREA = (5, 3, 99, 117)
CONSTRAINED = f"""{LEAF},
inside AS (SELECT * REPLACE ((x * 3 + y) % 31 <> 0 AS watertight) FROM leaf WHERE x BETWEEN {AREA[0]} AND {AREA[2]} AND y BETWEEN {AREA[1]} AND {AREA[3]}),
up AS (SELECT s, CAST(7 - s AS INT) AS lod, CAST(x >> s AS INT) AS x, CAST(y >> s AS INT) AS y, bool_and(watertight) AS w, count(*) AS n_leaves, min(min_z) AS min_z, max(max_z) AS max_z FROM inside, (SELECT CAST(unnest(range(0, 8)) AS INT) AS s) GROUP BY 1, 2, 3, 4),
valid AS (SELECT s, a.x >> s AS x, b.y >> s AS y, count(*) AS n FROM (SELECT CAST(unnest(range({AREA[0]}, {AREA[2] + 1})) AS INT) AS x) a, (SELECT CAST(unnest(range({AREA[1]}, {AREA[3] + 1})) AS INT) AS y) b, (SELECT CAST(unnest(range(0, 8)) AS INT) AS s) GROUP BY 1, 2, 3)"""


def _constrained(spark, d) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return leaf(spark, d).where(x.between(AREA[0], AREA[2]) & y.between(AREA[1], AREA[3])).withColumn("watertight", (x * 3 + y) % 31 != 0)


@query("e4_constrained_pyramid", f"WITH {CONSTRAINED} SELECT lod, u.x, u.y, w AND n_leaves = v.n AS watertight, n_leaves, min_z, max_z FROM up u JOIN valid v ON v.s = u.s AND v.x = u.x AND v.y = u.y")
def constrained_pyramid(spark, d):
    return P.pyramid(_constrained(spark, d), LOD, area=AREA)


@query("e4_constrained_steps", f"WITH {CONSTRAINED} SELECT lod, u.x, u.y, w AND n_leaves = v.n AS watertight, n_leaves, min_z, max_z FROM up u JOIN valid v ON v.s = u.s AND v.x = u.x AND v.y = u.y WHERE lod >= 3")
def constrained_steps(spark, d):
    return P.mip_steps(_constrained(spark, d), LOD, lod_min=3, area=AREA)


@query("e6_detail_mask", f"WITH {T.PIXEL_SQL}, a AS (SELECT px >> 3 AS x, py >> 3 AS y, avg(mask) AS m FROM pixel GROUP BY 1, 2) SELECT x, y, CAST(CASE WHEN m = 0 THEN 0 WHEN m >= 255 THEN 192 ELSE 128 END AS INT) AS value FROM a")
def detail_mask(spark, d):
    a = T.pixels(spark, d).groupBy(F.shiftright("px", 3).alias("x"), F.shiftright("py", 3).alias("y")).agg(F.avg("mask").alias("m"))
    return a.select("x", "y", F.when(F.col("m") == 0, 0).when(F.col("m") >= 255, 0xC0).otherwise(0x80).alias("value"))


@query("e7_resampling", f"""
WITH {T.PIXEL_SQL}, p AS (SELECT *, px >> 4 AS tx, py >> 4 AS ty, ((px & 15) - 7.5) ** 2 + ((py & 15) - 7.5) ** 2 AS d FROM pixel WHERE z IS NOT NULL),
m AS (SELECT tx, ty, l_suppkey AS mode FROM (SELECT tx, ty, l_suppkey, count(*) AS n FROM p GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY n DESC, l_suppkey) = 1)
SELECT tx, ty, round(CAST(avg(CAST(z AS DECIMAL(20,4))) AS DOUBLE), 3) AS average, any_value(m.mode) AS mode, min(z) AS minimum, max(z) AS maximum, round(quantile_cont(z, 0.5), 4) AS median, round(quantile_cont(z, 0.25), 4) AS q1, round(quantile_cont(z, 0.75), 4) AS q3, arg_min(z, (d, py, px, z)) AS nearest
FROM p JOIN m USING (tx, ty) GROUP BY 1, 2""")
def resampling(spark, d):
    return R.resample(T.pixels(spark, d), 4)


@query("e8_overview", f"WITH {CELL} SELECT px >> 1 AS px, py >> 1 AS py, round(CAST(avg(CAST(z AS DECIMAL(20,4))) AS DOUBLE), 3) AS z FROM cell WHERE z IS NOT NULL GROUP BY 1, 2")
def overview(spark, d):
    return R.overview_step(cells(spark, d))


@query("e11_range_union", f"WITH {PYRAMID}, r AS (SELECT lod, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pyramid GROUP BY 1) SELECT min(lod) AS lod_min, max(lod) AS lod_max, min(x0 >> greatest(lod - 3, 0)) AS x0, min(y0 >> greatest(lod - 3, 0)) AS y0, max(x1 >> greatest(lod - 3, 0)) AS x1, max(y1 >> greatest(lod - 3, 0)) AS y1 FROM r WHERE lod >= 3")
def range_union(spark, d):
    r = tiles(spark, d).where("lod >= 3").groupBy("lod").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    up = lambda f, c: f(F.expr(f"shiftright({c}, lod - 3)")).alias(c)
    return r.agg(F.min("lod").alias("lod_min"), F.max("lod").alias("lod_max"), up(F.min, "x0"), up(F.min, "y0"), up(F.max, "x1"), up(F.max, "y1"))


@query("e16_next_id", "SELECT max(n_nationkey) + 1 AS next_id FROM nation")
def next_id(spark, d):
    return C.next_id(T.table(spark, d, "nation"), "n_nationkey", 1000)


@query("e18_availability", f"WITH {INDEX} SELECT lod, x >> 8 AS gx, y >> 8 AS gy, (y & 255) * 256 + (x & 255) AS cell, CASE WHEN flags & 2 <> 0 THEN 192 ELSE 128 END AS value FROM idx")
def availability(spark, d):
    return P.availability(index(spark, d))


@query("e20_metatiles", f"WITH {INDEX} SELECT lod, x & ~31 AS bx, y & ~31 AS by, count(*) AS n, string_agg(y || ':' || x || ':' || flags, ' ' ORDER BY y, x) AS nodes FROM idx GROUP BY 1, 2, 3")
def metatiles(spark, d):
    text = F.array_join(F.transform("nodes", lambda e: F.concat_ws(":", e["y"].cast("string"), e["x"].cast("string"), e["flags"].cast("string"))), " ")
    return P.metatiles(index(spark, d)).withColumn("nodes", text)


_RING = "(SELECT a.dx, b.dy FROM (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b)"


@query("f1_hole_fill", f"WITH {CELL}, n AS (SELECT px - dx AS px, py - dy AS py, round(CAST(avg(CAST(z AS DECIMAL(20,4))) AS DOUBLE), 3) AS z FROM cell, {_RING} WHERE z IS NOT NULL AND NOT (dx = 0 AND dy = 0) GROUP BY 1, 2) SELECT c.px, c.py, n.z FROM cell c LEFT JOIN n USING (px, py) WHERE c.z IS NULL AND c.mask > 0")
def hole_fill(spark, d):
    return R.fill_holes(cells(spark, d))


RANGES = f"{T.PIXEL_SQL}, cell AS (SELECT px, py, (min(z) + max(z)) / 2 AS v, min(z) AS lo, max(z) AS hi, max(mask) AS mask FROM pixel GROUP BY 1, 2)"


@query("f2_range_fill", f"WITH {RANGES}, n AS (SELECT px - dx AS px, py - dy AS py, round(CAST(avg(CAST(v AS DECIMAL(20,4))) AS DOUBLE), 3) AS v, min(lo) AS lo, max(hi) AS hi FROM cell, {_RING} WHERE v IS NOT NULL AND NOT (dx = 0 AND dy = 0) GROUP BY 1, 2) SELECT c.px, c.py, n.v, n.lo, n.hi FROM cell c LEFT JOIN n USING (px, py) WHERE c.v IS NULL AND c.mask > 0")
def range_fill(spark, d):
    low, high = F.min("z"), F.max("z")
    return R.fill_ranges(T.pixels(spark, d).groupBy(*R.PIX).agg(((low + high) / 2).alias("v"), low.alias("lo"), high.alias("hi"), F.max("mask").alias("mask")))


_BLOCK = f"{T.PIXEL_SQL}, cell AS (SELECT px >> 3 AS px, py >> 3 AS py, max(z) AS z, max(mask) AS mask FROM pixel GROUP BY 1, 2)"


def blocks(spark, d):
    p = T.pixels(spark, d)
    return R.cells(p.withColumn("px", F.shiftright("px", 3)).withColumn("py", F.shiftright("py", 3)))


@query("f3_relief", f"""
WITH {_BLOCK}, w AS (
  SELECT c.px, c.py, {", ".join(f"max(n.z) FILTER (n.px - c.px = {i % 3 - 1} AND n.py - c.py = {i // 3 - 1}) AS v{i}" for i in range(9))}, count(*) AS n, min(n.z) AS lo, max(n.z) AS hi
  FROM cell c, {_RING} r JOIN cell n ON n.px = c.px + r.dx AND n.py = c.py + r.dy WHERE n.z IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 9),
g AS (SELECT *, ((v2 + 2 * v5 + v8) - (v0 + 2 * v3 + v6)) / 8 AS gx, ((v6 + 2 * v7 + v8) - (v0 + 2 * v1 + v2)) / 8 AS gy FROM w)
SELECT px, py, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope, round(degrees(atan2(gy, -gx)), 6) AS aspect,
  round(CASE WHEN sin(radians(45)) - cos(radians(45)) * sqrt(gx * gx + gy * gy) * sin(atan2(gy, -gx) - radians(315)) <= 0 THEN 1 ELSE 1 + 254 * (sin(radians(45)) - cos(radians(45)) * sqrt(gx * gx + gy * gy) * sin(atan2(gy, -gx) - radians(315))) / sqrt(1 + gx * gx + gy * gy) END, 4) AS hillshade, round(hi - lo, 6) AS roughness, round(v4 - (v0 + v1 + v2 + v3 + v5 + v6 + v7 + v8) / 8, 6) AS tpi,
  round((abs(v0 - v4) + abs(v1 - v4) + abs(v2 - v4) + abs(v3 - v4) + abs(v5 - v4) + abs(v6 - v4) + abs(v7 - v4) + abs(v8 - v4)) / 8, 6) AS tri FROM g""")
def relief(spark, d):
    return R.relief(blocks(spark, d))


RAMP = [(1000.0, (0, 64, 128)), (20000.0, (40, 160, 60)), (60000.0, (200, 180, 120)), (90000.0, (255, 255, 255))]


def _ramp_sql(c: int) -> str:
    """A channel of RAMP by its two neighbours of an elevation."""
    steps = " ".join(f"WHEN z < {b} THEN {low[c]} + (z - {a}) / ({b} - {a}) * ({high[c]} - {low[c]})" for (a, low), (b, high) in zip(RAMP[:-1], RAMP[1:], strict=True))
    return f"CAST(floor(CASE WHEN z < {RAMP[0][0]} THEN {RAMP[0][1][c]} {steps} ELSE {RAMP[-1][1][c]} END + 0.5) AS INT)"


@query("f3_color_relief", f"WITH {_BLOCK} SELECT px, py, {_ramp_sql(0)} AS r, {_ramp_sql(1)} AS g, {_ramp_sql(2)} AS b FROM (SELECT px, py, CAST(z AS DOUBLE) AS z FROM cell WHERE z IS NOT NULL)")
def color_relief(spark, d):
    return blocks(spark, d).where("z IS NOT NULL").select(*R.PIX, *[c.alias(n) for c, n in zip(R.color_relief(F.col("z"), RAMP), "rgb", strict=True)])


@query("f4_normals", f"""
WITH {_BLOCK}, w AS (SELECT c.px, c.py, f.px IS NOT NULL AS flat, (r.z - l.z) / 2 AS gx, (b.z - t.z) / 2 AS gy FROM (SELECT DISTINCT px + dx AS px, py + dy AS py FROM cell, {_RING}) c JOIN cell l ON l.px = c.px - 1 AND l.py = c.py JOIN cell r ON r.px = c.px + 1 AND r.py = c.py JOIN cell t ON t.px = c.px AND t.py = c.py - 1 JOIN cell b ON b.px = c.px AND b.py = c.py + 1
  LEFT JOIN cell f ON f.px = c.px AND f.py = c.py AND f.z IS NOT NULL AND (f.px // 4 + f.py // 4) % 5 = 0 WHERE l.z IS NOT NULL AND r.z IS NOT NULL AND t.z IS NOT NULL AND b.z IS NOT NULL)
SELECT px, py, CASE WHEN flat THEN 0 ELSE round(-gx / sqrt(gx * gx + gy * gy + 1), 6) + 0.0 END AS nx, CASE WHEN flat THEN 0 ELSE round(-gy / sqrt(gx * gx + gy * gy + 1), 6) + 0.0 END AS ny, CASE WHEN flat THEN 1 ELSE round(1 / sqrt(gx * gx + gy * gy + 1), 6) END AS nz FROM w""")
def normals(spark, d):
    return R.gradients(blocks(spark, d).withColumn("flat", F.expr("(px div 4 + py div 4) % 5 = 0")), flat="flat")


@query("f6_erode", f"WITH {_BLOCK}, n AS (SELECT px - dx AS px, py - dy AS py, min(mask) AS low FROM cell, {_RING} GROUP BY 1, 2) SELECT c.px, c.py, n.low AS mask FROM cell c JOIN n USING (px, py) WHERE c.mask > 0")
def erode(spark, d):
    return R.erode(blocks(spark, d))


@query("f10_coverage", f"WITH {_BLOCK} SELECT px - dx AS px, py - dy AS py FROM cell, {_RING} GROUP BY 1, 2 HAVING min(mask) > 0 AND count(*) = 9")
def coverage(spark, d):
    return R.coverage(blocks(spark, d))


@query("g3_kill_until", "WITH w AS (SELECT user_id % 10 AS host, event_id AS worker, value FROM events), r AS (SELECT *, sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY host) - coalesce(sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY host ORDER BY CAST(value * 100 AS BIGINT) DESC, worker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM w) SELECT host, worker, CAST(left_ AS BIGINT) AS remaining FROM r WHERE left_ >= 20000")
def kill_until(spark, d):
    w = T.table(spark, d, "events").select((F.col("user_id") % 10).alias("host"), F.col("event_id").alias("worker"), F.round(F.col("value") * 100).cast("long").alias("memory"))
    return C.kill_until(w, "memory", 20000).select("host", "worker", F.col("left").alias("remaining"))


@query("g6_nearest_valid", f"WITH {CELL}, t AS (SELECT DISTINCT px >> 5 AS tx, py >> 5 AS ty FROM cell) SELECT tx, ty, arg_min(z, ((px - (tx * 32 + 16)) ** 2 + (py - (ty * 32 + 16)) ** 2, py, px)) AS z FROM t JOIN cell ON px >> 5 = tx AND py >> 5 = ty WHERE z IS NOT NULL GROUP BY 1, 2")
def nearest_valid(spark, d):
    dx, dy = F.expr("(px - (shiftright(px, 5) * 32 + 16))"), F.expr("(py - (shiftright(py, 5) * 32 + 16))")
    return cells(spark, d).where("z IS NOT NULL").groupBy(F.shiftright("px", 5).alias("tx"), F.shiftright("py", 5).alias("ty")).agg(F.min_by("z", F.struct(dx * dx + dy * dy, F.col("py"), F.col("px"))).alias("z"))


@query("h1_stamp", "SELECT DISTINCT lod, CAST(x AS INT) AS x, CAST(y AS INT) AS y, 1 AS flags FROM (SELECT 4 AS lod, unnest(range(2, 8)) AS x UNION ALL SELECT 4, unnest(range(5, 12))) a, (SELECT unnest(range(3, 9)) AS y) b")
def stamp(spark, d):
    return P.stamp(spark, [(4, 2, 3, 7, 8), (4, 5, 3, 11, 8)], 1)


@query("h3_broaden", f"WITH {INDEX}, b AS (SELECT * FROM idx WHERE lod <= 5) SELECT * FROM b UNION ALL SELECT CAST(5 + k AS INT), CAST((x << k) + i AS INT), CAST((y << k) + j AS INT), flags & ~2 FROM b, (SELECT unnest([1, 2]) AS k) a, (SELECT unnest(range(0, 4)) AS i) c, (SELECT unnest(range(0, 4)) AS j) e WHERE lod = 5 AND i < (1 << k) AND j < (1 << k)")
def broaden(spark, d):
    return P.broaden(index(spark, d).where("lod <= 5"), 7)


@query("h5_range_clip", f"WITH {PYRAMID} SELECT lod, greatest(min(x), 2) AS x0, greatest(min(y), 1) AS y0, least(max(x), 40) AS x1, least(max(y), 50) AS y1 FROM pyramid GROUP BY lod")
def range_clip(spark, d):
    return tiles(spark, d).groupBy("lod").agg(F.greatest(F.min("x"), F.lit(2)).alias("x0"), F.greatest(F.min("y"), F.lit(1)).alias("y0"), F.least(F.max("x"), F.lit(40)).alias("x1"), F.least(F.max("y"), F.lit(50)).alias("y1"))


@query("h7_crop", f"WITH {INDEX} SELECT lod - 2 AS lod, x - (1 << (lod - 2)) AS x, y - (2 << (lod - 2)) AS y, flags FROM idx WHERE lod >= 2 AND x >> (lod - 2) = 1 AND y >> (lod - 2) = 2")
def crop(spark, d):
    return P.crop(index(spark, d), 2, 1, 2)


@query("i1_tile_family", f"WITH {PYRAMID} SELECT lod, x, y, x >> 1 AS parent_x, y >> 1 AS parent_y, (x & 1) + 2 * (y & 1) AS child, CAST(pow(2, lod) AS BIGINT) - 1 - y AS tms_y FROM pyramid")
def tile_family(spark, d):
    return tiles(spark, d).select(*P.TILE, F.shiftright("x", 1).alias("parent_x"), F.shiftright("y", 1).alias("parent_y"), (F.col("x").bitwiseAND(1) + 2 * F.col("y").bitwiseAND(1)).alias("child"), S.tms_y(F.col("lod"), F.col("y")).cast("long").alias("tms_y"))


@query("i3_extents", f"WITH {PYRAMID} SELECT lod, x, y, round(-180 + x * (360 / pow(2, lod)), 9) AS xmin, round(90 - (y + 1) * (180 / pow(2, lod)), 9) AS ymin, round(-180 + (x + 1) * (360 / pow(2, lod)), 9) AS xmax, round(90 - y * (180 / pow(2, lod)), 9) AS ymax FROM pyramid")
def extents(spark, d):
    e = S.range_extents(F.col("lod"), F.col("x"), F.col("y"), (-180.0, -90.0, 180.0, 90.0))
    return tiles(spark, d).select(*P.TILE, *[F.round(c, 9).alias(n) for c, n in zip(e, ["xmin", "ymin", "xmax", "ymax"], strict=True)])


@query("i4_depths", "SELECT o_orderkey, CASE WHEN ceil(0.5 * log2(o_totalprice * 1e6 / 65536.0)) >= 0 THEN CAST(ceil(0.5 * log2(o_totalprice * 1e6 / 65536.0)) AS INT) END AS depth, CAST(greatest(0, ceil(3.5 - 0.5 * (o_custkey % 9))) AS INT) AS floor_depth, CAST(least(12, greatest(0, floor(0.5 * log2(1e6 / o_totalprice)))) AS INT) AS min_lod FROM orders")
def depths(spark, d):
    o = T.table(spark, d, "orders")
    return o.select("o_orderkey", S.depth(F.col("o_totalprice") * 1e6, 1.0, F.lit(1.0)).alias("depth"), S.floor_depth(3.5, F.col("o_custkey") % 9).alias("floor_depth"), S.min_lod(F.lit(12), F.lit(1e6), F.col("o_totalprice")).alias("min_lod"))


@query("i12_superelevation", "SELECT l_orderkey, l_linenumber, l_extendedprice, round(least(greatest(l_extendedprice, 2000.0), 50000.0) * ((least(greatest(l_extendedprice, 2000.0), 50000.0) - 2000) * ((3.0 - 1.5) / 48000) + 1.5), 4) AS h FROM lineitem")
def superelevation(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(S.superelevation(F.col("l_extendedprice"), 2000.0, 50000.0, 1.5, 3.0), 4).alias("h"))


@query("i15_tile_metrics", f"WITH {PYRAMID} SELECT lod, x, y, round(sqrt(1e6 / pow(4, lod) / 65536) * sqrt(1 + 0.5 * least((max_z - min_z) / 1e4, 2) ** 2), 9) AS texel, CAST(round(1000 * least(greatest((pow(2.0 / 3, lod) - 1) / (2.0 / 3 - 1), 0), 3)) AS INT) AS faces, CAST(greatest(2, least(64, round(3.0 * (x + y)))) AS INT) AS samples, 1 + CASE WHEN watertight THEN 16 ELSE 0 END + CASE WHEN (x + y) % 2 = 0 THEN 2 ELSE 0 END AS meta_flags FROM pyramid")
def tile_metrics(spark, d):
    t = tiles(spark, d)
    f = P.flags(t, (F.col("x") + F.col("y")) % 2 == 0).select(*P.TILE, "flags")
    t, f = t.join(f, P.TILE), F.col("flags")
    return t.select(
        *P.TILE, F.round(S.texel_size(1e6 / F.pow(F.lit(4.0), F.col("lod")), F.col("max_z") - F.col("min_z"), F.lit(1e4)), 9).alias("texel"), S.face_budget(F.col("lod")).alias("faces"),
        S.sample_count((F.col("x") + F.col("y")).cast("double"), 64).alias("samples"), S.meta_flags(f).alias("meta_flags"),
    )


@query("i16_quad_area", f"WITH {_BLOCK} SELECT c.px, c.py, round(0.5 * (sqrt((b.z - c.z) ** 2 + (e.z - b.z) ** 2 + 1) + sqrt((e.z - a.z) ** 2 + (a.z - c.z) ** 2 + 1)), 6) AS area FROM cell c JOIN cell b ON b.px = c.px + 1 AND b.py = c.py JOIN cell a ON a.px = c.px AND a.py = c.py + 1 JOIN cell e ON e.px = c.px + 1 AND e.py = c.py + 1 WHERE c.z IS NOT NULL AND b.z IS NOT NULL AND a.z IS NOT NULL AND e.z IS NOT NULL")
def quad_area(spark, d):
    return M.triangulate(blocks(spark, d)).select(*R.PIX, F.round(S.quad_area([F.col(f"c{i}") for i in range(4)]), 6).alias("area"))


@query("i22_projections", "SELECT c_custkey, round(radians(c_nationkey * 10 - 120) * 6378137.0, 3) AS mx, round(ln(tan(pi() / 4 + radians(c_custkey % 160 - 80) / 2)) * 6378137.0, 3) + 0.0 AS my FROM customer")
def projections(spark, d):
    x, y = S.mercator((F.col("c_nationkey") * 10 - 120).cast("double"), (F.col("c_custkey") % 160 - 80).cast("double"))
    return T.table(spark, d, "customer").select("c_custkey", F.round(x, 3).alias("mx"), (F.round(y, 3) + 0.0).alias("my"))


@query("i24_patchwork", f"WITH {PYRAMID}, q AS (SELECT *, CAST(1 + ((y << lod) + x) % 254 AS INT) AS colour FROM pyramid) SELECT lod, x, y, colour, CASE WHEN ((x >> 3) + (y >> 3)) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS shade, CASE WHEN (colour / 255 + 0.05) / 0.05 >= 1.05 / (colour / 255 + 0.05) THEN 'black' ELSE 'white' END AS label FROM q")
def patchwork(spark, d):
    t = tiles(spark, d).withColumn("colour", F.expr("CAST(1 + (shiftleft(y, lod) + x) % 254 AS INT)"))
    return t.select(*P.TILE, "colour", S.checker(F.col("x"), F.col("y")).alias("shade"), S.label_colour(F.col("colour") / 255).alias("label"))


@query("i26_forecast_period", "WITH t AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT event_id, t - (t - 1705000000) % 21600 AS period, strftime(make_timestamp((t - (t - 1705000000) % 21600) * 1000000), '%Y/%m/%d/%H') AS path FROM t")
def forecast(spark, d):
    t = F.col("ts").cast("timestamp").cast("long")
    p = S.period_start(t, 1705000000, 21600)
    return T.table(spark, d, "events").select("event_id", p.alias("period"), S.utc_path(p).alias("path"))


@query("j2_forecast_rollover", "WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(20,4))), 2) AS DOUBLE) AS total FROM events GROUP BY 1), m AS (SELECT epoch(max(start)) AS at FROM w) SELECT CAST(epoch(w.start) AS BIGINT) AS start, w.n, w.total, p.n AS previous_n, p.total AS previous_total, CAST(greatest(epoch(w.start) + 21600 - m.at, 0) AS BIGINT) AS remaining FROM m, w LEFT JOIN w p ON p.start + INTERVAL '6 hours' = w.start")
def rollover(spark, d):
    from tessera.streaming.refresh import rolled_over

    e = T.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    periods = e.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(20,4)")), 2).cast("double").alias("total"))
    return rolled_over(periods.select(F.col("w.start").cast("long").alias("start"), "n", "total"), 21600)


@query("i28_query_string", r"SELECT page_id, coalesce(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def query_string(spark, d):
    tail = F.regexp_extract("url", r"\?([^#]*)", 1)
    return T.table(spark, d, "pages").select("page_id", F.array_join(S.query_list(tail, "ref"), ",").alias("ref"))


@query("i29_relative_root", "SELECT a.n_nationkey, CASE WHEN a.n_regionkey <> b.n_regionkey THEN '../../' WHEN a.n_name <> b.n_name THEN '../' ELSE './' END AS root, 'rf/' || a.n_regionkey AS prefix FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey // 2")
def relative_root(spark, d):
    n = T.table(spark, d, "nation")
    b = n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("br"), F.col("n_name").alias("bn"))
    j = n.join(b, F.expr("n_nationkey div 2") == F.col("k"))
    return j.select("n_nationkey", S.relative_root([F.col("n_regionkey"), F.col("n_name")], [F.col("br"), F.col("bn")]).alias("root"), S.path_prefix([F.lit("rf"), F.col("n_regionkey").cast("string"), F.col("n_name")], 2).alias("prefix"))


_RUN = r"(?:[A-Za-z] ?[. ])+"
_DROPPED = r"regexp_replace(text, '\{[^}]*(?:\}|\z)|\[[^ \t-\r\]]*([ \t-\r][^\]]*)?(?:\]|\z)', '\1', 'g')"
_LATIN = "translate(lower(plain), 'áàâäãåéèêëíìîïóòôöõúùûüñçýß', 'aaaaaaeeeeiiiiooooouuuuncys')"


@query("i32_credit_ids", rf"""
WITH p AS (SELECT doc_id, {_DROPPED} AS plain FROM documents),
t AS (SELECT doc_id, plain, regexp_extract_all({_LATIN}, '{_RUN}|[A-Za-z0-9]+|[^A-Za-z0-9]+') AS parts FROM p),
c AS (SELECT doc_id, plain, array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_full_match(x, '{_RUN}') THEN translate(x, '. ', '') || ' ' ELSE x END), '') AS said FROM t)
SELECT doc_id, 'auto-' || regexp_replace(regexp_replace(said, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS credit, plain FROM c""")
def credit_ids(spark, d):
    return T.table(spark, d, "documents").select("doc_id", S.credit_id(F.col("text")).alias("credit"), S.drop_expansion(F.col("text")).alias("plain"))


@query("i33_resource_ids", r"SELECT page_id, regexp_extract(p, '([^/]+)/[^/]+$', 1) AS grp, regexp_extract(p, '([^/]+?)(\.[^./]*)?$', 1) AS id FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)")
def resource_ids(spark, d):
    grp, ident = S.resource_id(F.col("p"))
    return T.table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("p")).select("page_id", grp.alias("grp"), ident.alias("id"))


@query("e21_counters", "WITH e AS (SELECT *, epoch(time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01')) - 600 * k AS start FROM events, (SELECT unnest(range(0, 6)) AS k)) SELECT CAST(start AS BIGINT) AS start, event_type, count(*) AS n, round(CAST(avg(CAST(value AS DECIMAL(20,4))) AS DOUBLE) + 1e-7, 3) AS mean, max(value) AS most FROM e GROUP BY 1, 2")
def counters(spark, d):
    """Over a history of an hour that slides by ten minutes. Means that end halfway between two roundings are kept from it
    by a small shift."""
    from tessera.streaming.refresh import period_counters

    e = T.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = period_counters(e, "1 hour", "10 minutes")
    return c.select(F.col("window.start").cast("long").alias("start"), "event_type", "n", F.round(F.col("mean") + 1e-7, 3).alias("mean"), "most")


@query("j3_updated_since", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def updated_since(spark, d):
    return T.table(spark, d, "events").where(F.col("ts").cast("timestamp") > F.lit("2024-01-15").cast("timestamp")).select("event_id")


_ULP = "pow(2, greatest(floor(log2(greatest(abs({0}), 1e-300))), -14) - 10)"
_HELD = "least(greatest({0}, -65504), 65504)"


@query("i11_half_range", f"""
WITH {PYRAMID}, r AS (SELECT lod, x, y, min_z, max_z FROM pyramid UNION ALL SELECT lod, x, y, -max_z / 70000, min_z / 7e8 FROM pyramid),
h AS (SELECT *, {_HELD.format("min_z")} AS a, {_HELD.format("max_z")} AS b FROM r)
SELECT lod, x, y, min_z, max_z, floor(a / {_ULP.format("a")}) * {_ULP.format("a")} AS half_min, ceil(b / {_ULP.format("b")}) * {_ULP.format("b")} + 0.0 AS half_max FROM h""")
def half_range(spark, d):
    t = tiles(spark, d).select(*P.TILE, "min_z", "max_z")
    t = t.unionByName(t.select(*P.TILE, (-F.col("max_z") / 70000).alias("min_z"), (F.col("min_z") / 7e8).alias("max_z")))
    low, high = S.half_range(F.col("min_z"), F.col("max_z"))
    return t.select("*", low.alias("half_min"), (high + 0.0).alias("half_max"))


@query("e15_table_digest", None)
def table_digest(spark, d):
    return C.digest(tiles(spark, d), [*P.TILE, "watertight", "min_z", "max_z"])


@query("l3_survey", f"""
WITH {PYRAMID}, r AS (SELECT lod, count(*) AS n, count(*) FILTER (watertight) AS n_watertight, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, min(min_z) AS min_z, max(max_z) AS max_z FROM pyramid GROUP BY lod)
SELECT r.*, round(360 / pow(2, lod) / 256 * 111319.49079327358, 6) AS gsd, 25.0::DOUBLE AS target_gsd, round(-180 + (x0 + x1 + 1) * (360 / pow(2, lod)) / 2, 9) AS lon, round(90 - (y0 + y1 + 1) * (180 / pow(2, lod)) / 2, 9) + 0.0 AS lat, 'on (floor GSD 25 m)' AS prune, lod > 3 AS skip_partial, false AS force_watertight FROM r""")
def survey(spark, d):
    from tessera.operators.survey import report

    r = tiles(spark, d).groupBy("lod").agg(F.count(F.lit(1)).alias("n"), F.count_if("watertight").alias("n_watertight"), *[f(c).alias(f"{c}{i}") for i, f in ((0, F.min), (1, F.max)) for c in "xy"], F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z"))
    return report(r, (-180.0, -90.0, 180.0, 90.0), 25.0, dem=F.lit(True), skip_partial=F.col("lod") > 3)


@query("g4_violation_report", f"WITH {PYRAMID}, v AS (SELECT lod, x, y FROM pyramid WHERE watertight), r AS (SELECT *, row_number() OVER (ORDER BY lod, y, x) AS k, count(*) OVER () AS total FROM v) SELECT lod, x, y, total FROM r WHERE k <= 20")
def violations(spark, d):
    v = tiles(spark, d).where("watertight").select(*P.TILE)
    n = v.agg(F.count(F.lit(1)).alias("total"))
    return v.orderBy("lod", "y", "x").limit(20).join(F.broadcast(n), F.col("lod") >= 0)


@query("g2_page_order", f"WITH {PYRAMID} SELECT lod, x, y, CAST(row_number() OVER (PARTITION BY lod, x >> 5 ORDER BY y, x) AS INT) AS place FROM pyramid")
def page_order(spark, d):
    return tiles(spark, d).select(*P.TILE, F.row_number().over(Window.partitionBy("lod", F.shiftright("x", 5)).orderBy("y", "x")).alias("place"))
