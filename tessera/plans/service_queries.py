"""Queries over requests, outputs, configurations, survey figures and quadtrees."""

from __future__ import annotations

import contextlib
import http.server
import json
import threading
import time
from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import catalogue as C
from tessera.operators import mesh as M
from tessera.operators import pyramid as P
from tessera.operators import raster as R
from tessera.operators import survey as V
from tessera.plans.queries import _BLOCK, INDEX, LEAF, OTHER, PYRAMID, blocks, index, leaf, other, tiles
from tessera.plans.registry import query
from tessera.sources import remote
from tessera.sources import tables as T

FRAMES = "FROM (SELECT p_partkey AS n, CAST(p_size AS INT) AS size, p_brand AS brand, p_type AS type FROM part)"
#: Boxes of ten degrees by nation, and their borders of four samples to a side.
BOXES = "boxes AS (SELECT n_nationkey AS k, n_nationkey * 10.0 - 120 AS xmin, n_nationkey * 4.0 - 60 AS ymin, n_nationkey * 10.0 - 110 AS xmax, n_nationkey * 4.0 - 50 AS ymax FROM nation)"
BORDER = f"""{BOXES},
border AS (
  SELECT k, i, radians(CAST(CASE i // 4 % 4 WHEN 0 THEN xmin + i % 4 / 4 * 10 WHEN 1 THEN xmax WHEN 2 THEN xmax - i % 4 / 4 * 10 ELSE xmin END AS DOUBLE)) AS lo,
    radians(CAST(CASE i // 4 % 4 WHEN 0 THEN ymax WHEN 1 THEN ymax - i % 4 / 4 * 10 WHEN 2 THEN ymin ELSE ymin + i % 4 / 4 * 10 END AS DOUBLE)) AS la
  FROM boxes, (SELECT unnest(range(0, 17)) AS i)),
flat AS (SELECT k, i, lo * 6378137.0 AS x, ln(tan(pi() / 4 + la / 2)) * 6378137.0 AS y FROM border)"""


def boxes(spark, d):
    n = F.col("n_nationkey")
    return T.table(spark, d, "nation").select(n.alias("k"), (n * 10.0 - 120).alias("xmin"), (n * 4.0 - 60).alias("ymin"), (n * 10.0 - 110).alias("xmax"), (n * 4.0 - 50).alias("ymax"))


@query("a3_vector_or_empty", "SELECT c_custkey, c_name FROM customer")
def vectors(spark, d):
    read = lambda name: T.vector_or_empty(spark, f"{d}/{name}.parquet", "c_custkey long, c_name string")
    return read("customer").unionByName(read("no_such_layer"))


@query("a7_obj_faces", """
WITH l AS (SELECT p_partkey AS k, p_partkey % 7 = 3 AS named, p_brand FROM part),
f AS (SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS fid, k, last_value(CASE WHEN named THEN p_brand END IGNORE NULLS) OVER (ORDER BY k) AS m FROM l)
SELECT fid, CAST(k + 1 AS INT) AS a, CAST(k + 2 AS INT) AS b, CAST(k + 3 AS INT) AS c, coalesce(m, 'mesh') AS material FROM f""")
def obj_faces(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 3, F.concat(F.lit("usemtl "), F.col("p_brand"))).otherwise("#")
    point = F.format_string("v %d 0 -%d.5", k, k)
    face = F.format_string("f %d/1 %d/2 %d", k + 1, k + 2, k + 3)
    lines = T.table(spark, d, "part").select(k, F.posexplode(F.array(name, point, face)).alias("i", "line")).select((k * 3 + F.col("i")).alias("n"), "line")
    return T.obj_mesh(lines, block=64)[1]


class _Metadata(http.server.BaseHTTPRequestHandler):
    """A service's metadata; other paths don't answer, or answer something else."""

    REPLY = {"resourceSets": [{"resources": [{"imageUrl": "https://{subdomain}.tiles.example/{quadkey}.jpeg", "imageUrlSubdomains": ["t0", "t1", "t2", "t3"]}]}]}

    def do_GET(self):
        if self.path == "/slow":
            time.sleep(1.0)
        body = json.dumps(self.REPLY if self.path == "/good" else {}).encode()
        self.send_response(500 if self.path == "/broken" else 200)
        self.end_headers()
        with contextlib.suppress(OSError):
            self.wfile.write(body)

    def log_message(self, *_):
        pass


@contextlib.contextmanager
def _service():
    """A server on this host for as long as a query asks it."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Metadata)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_address[1]}"
    finally:
        server.shutdown()
        server.server_close()


@query("a15_url_templates", f"WITH {PYRAMID} SELECT lod, x, y, '//t' || ((x + y) % 4) || '.tiles.example/' || array_to_string(list_transform(range(1, lod + 1), lambda i: ((x >> CAST(lod - i AS INT)) & 1) + 2 * ((y >> CAST(lod - i AS INT)) & 1)), '') || '.jpeg' AS url FROM pyramid")
def url_templates(spark, d):
    with _service() as at:
        template, names = remote.tile_template(f"{at}/good")
    url = F.replace(F.lit(template), F.lit("{subdomain}"), F.get(F.array(*[F.lit(n) for n in names]), (F.col("x") + F.col("y")) % len(names)))
    return tiles(spark, d).select(*P.TILE, F.replace(url, F.lit("{quadkey}"), S.quadkey(F.col("lod"), F.col("x"), F.col("y"))).alias("url"))


@query("a15_fetch_errors", "SELECT * FROM (VALUES ('good', true), ('broken', false), ('empty', false), ('slow', false)) t(reply, answered)")
def fetch_errors(spark, d):
    """Which replies give a template: not those that fail, say something else or come too late."""
    out = []
    with _service() as at:
        for name in ("good", "broken", "empty", "slow"):
            try:
                out.append((name, bool(remote.tile_template(f"{at}/{name}", timeout=0.3))))
            except remote.FetchError:
                out.append((name, False))
    return spark.createDataFrame(out, "reply string, answered boolean")


@query("a16_forecast_config", "SELECT p_partkey, CAST(1705000000 + p_size AS BIGINT) AS base, CAST(p_size * 60 AS INT) AS period, 'https://f.example/{time}/' || p_brand AS url, p_size % 2 = 0 AS transparent FROM part")
def forecast_config(spark, d):
    text = F.format_string("base = %d\nperiod=%d\nurl = https://f.example/{time}/%s\ntransparent = %s\n", 1705000000 + F.col("p_size"), F.col("p_size") * 60, F.col("p_brand"), (F.col("p_size") % 2 == 0).cast("string"))
    c = T.table(spark, d, "part").select("p_partkey", S.ini_values(text).alias("c"))
    return c.select("p_partkey", F.col("c")["base"].cast("long").alias("base"), F.col("c")["period"].cast("int").alias("period"), F.col("c")["url"].alias("url"), F.col("c")["transparent"].cast("boolean").alias("transparent"))


@query("a17_tile_descriptors", f"WITH {LEAF} SELECT x, y, '<GDAL_WMS><Service name=\"TMS\"><ServerUrl>https://f.example/2024/01/15/06/7/' || x || '/' || y || '</ServerUrl></Service></GDAL_WMS>' AS xml FROM leaf")
def tile_descriptors(spark, d):
    time = S.utc_path(F.lit(1705298400))
    return leaf(spark, d).select("x", "y", F.format_string('<GDAL_WMS><Service name="TMS"><ServerUrl>https://f.example/%s/%d/%d/%d</ServerUrl></Service></GDAL_WMS>', time, *P.TILE).alias("xml"))


@query("a19_dem_registry", "WITH r AS (SELECT n_regionkey AS rf, n_nationkey AS id, n_name AS dataset FROM nation) SELECT * FROM r UNION ALL SELECT a.rf, a.alias, r.dataset FROM (SELECT c_nationkey % 5 AS rf, CAST(100 + c_custkey AS INT) AS alias, c_nationkey AS id FROM customer) a JOIN r USING (rf, id)")
def dem_registry(spark, d):
    r = T.table(spark, d, "nation").select(F.col("n_regionkey").alias("rf"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("dataset"))
    a = T.table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("rf"), (100 + F.col("c_custkey")).cast("int").alias("alias"), F.col("c_nationkey").alias("id"))
    return C.with_aliases(r, a)


@query("b20_dem_page", "SELECT n_nationkey AS id, n_name AS dataset FROM nation WHERE n_regionkey = 2")
def dem_page(spark, d):
    return T.table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("dataset"))


@query("b1_content_rows", "SELECT page_id, 'text/html' AS content_type, CAST(octet_length(encode(coalesce(html, ''))) AS INT) AS bytes, md5(coalesce(html, '')) AS etag FROM pages")
def content_rows(spark, d):
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return T.table(spark, d, "pages").select("page_id", F.lit("text/html").alias("content_type"), F.octet_length(body).alias("bytes"), F.md5(body).alias("etag"))


@query("b6_uniform_pages", f"""
WITH {INDEX}, w AS (SELECT s, CAST(x >> s AS INT) AS x, CAST(y >> s AS INT) AS y, min(flags) AS flags FROM idx, (SELECT CAST(unnest(range(0, 6)) AS INT) AS s) WHERE lod = 7 GROUP BY s, 2, 3 HAVING min(flags) = max(flags) AND count(*) = CAST(pow(4, s) AS BIGINT))
SELECT s, x, y, flags FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.s = a.s + 1 AND b.x = a.x >> 1 AND b.y = a.y >> 1)""")
def uniform_pages(spark, d):
    return P.uniform_quads(index(spark, d).where("lod = 7"), 5)


@query("b7_level_trees", f"WITH {INDEX} SELECT l.lod, count(i.flags) AS nodes FROM (SELECT CAST(unnest(range(0, (SELECT max(lod) + 1 FROM idx WHERE lod <> 6))) AS INT) AS lod) l LEFT JOIN (SELECT * FROM idx WHERE lod <> 6) i USING (lod) GROUP BY l.lod")
def level_trees(spark, d):
    counts = index(spark, d).where("lod <> 6").groupBy("lod").agg(F.count(F.lit(1)).alias("nodes"))
    levels = counts.agg(F.max("lod").alias("m")).select(F.explode(F.sequence(F.lit(0), "m")).alias("lod"))
    return levels.join(counts, "lod", "left").select("lod", F.coalesce("nodes", F.lit(0)).alias("nodes"))


@query("b13_free_layers", f"""SELECT n, '{{"id":"' || brand || '","type":"geodata-tiles","metaUrl":"{{lod}}-{{x}}-{{y}}.meta?gr=3&r=' || size || '","geodataUrl":"{{lod}}-{{x}}-{{y}}.geo?gr=3&r=' || size || '","style":"' || type || '.json","displaySize":256,"lodRange":[1,' || (size % 10 + 3) || ']}}' AS json {FRAMES}""")
def free_layers(spark, d):
    style = F.concat("p_type", F.lit(".json"))
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("n"), C.free_layer(F.col("p_brand"), 3, F.col("p_size"), style, 256, F.array(F.lit(1), F.col("p_size") % 10 + 3)).alias("json"))


@query("b14_map_configs", "WITH n AS (SELECT n_nationkey AS id, n_regionkey AS over, n_name AS own, n_regionkey % 2 AS kind FROM nation) SELECT a.id, CASE WHEN a.kind = 0 THEN 'a' ELSE 'b' END AS key, a.own AS url FROM n a UNION ALL SELECT a.id, CASE WHEN b.kind = 0 THEN 'a' ELSE 'b' END, '../' || a.over || '/' || b.own FROM n a JOIN n b ON b.id = a.over WHERE b.kind <> a.kind")
def map_configs(spark, d):
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("over"), F.create_map(F.when(F.col("n_regionkey") % 2 == 0, "a").otherwise("b"), "n_name").alias("layers"))
    return C.map_config(n, n, "over").select("id", F.explode("layers").alias("key", "url"))


def _tag(name: str, *inner: str) -> str:
    return f"'<{name}>' || " + " || ".join(inner) + f" || '</{name}>'"


_MATRIX_SQL = _tag("TileMatrix", _tag("ows:Identifier", "lod"), _tag("ScaleDenominator", "printf('%.6f', 40075016.68557849 / pow(2, lod) / 256 / 0.00028)"), "'<TopLeftCorner>-20037508.342789 20037508.342789</TopLeftCorner><TileWidth>256</TileWidth><TileHeight>256</TileHeight>'", _tag("MatrixWidth", "CAST(pow(2, lod) AS BIGINT)"), _tag("MatrixHeight", "CAST(pow(2, lod) AS BIGINT)"))


def _matrices(spark, d):
    n, half = F.pow(F.lit(2.0), F.col("lod")), 20037508.342789244
    cells = n.cast("long")
    return tiles(spark, d).select("lod").distinct().select("lod", (40075016.68557849 / n / 256 / 0.00028).alias("denominator"), F.lit(-half).alias("left"), F.lit(half).alias("top"), cells.alias("width"), cells.alias("height"))


@query("b15_tile_matrix_xml", f"WITH {PYRAMID} SELECT DISTINCT lod, {_MATRIX_SQL} AS xml FROM pyramid")
def matrix_xml(spark, d):
    return _matrices(spark, d).select("lod", C.tile_matrix_xml(*[F.col(c) for c in ("lod", "denominator", "left", "top", "width", "height")]).alias("xml"))


_LIMITS_SQL = _tag("TileMatrixLimits", *[_tag(n, c) for n, c in (("TileMatrix", "lod"), ("MinTileRow", "y0"), ("MaxTileRow", "y1"), ("MinTileCol", "x0"), ("MaxTileCol", "x1"))])


@query("b15_capabilities", f"""
WITH {PYRAMID}, r AS (SELECT 'layer & ' || (x + y) % 3 AS layer, lod, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pyramid GROUP BY 1, 2),
l AS (SELECT layer, string_agg({_LIMITS_SQL}, '' ORDER BY lod) AS limits, min(x0 / pow(2, lod)) AS xmin, min(y0 / pow(2, lod)) AS ymin, max((x1 + 1) / pow(2, lod)) AS xmax, max((y1 + 1) / pow(2, lod)) AS ymax FROM r GROUP BY 1),
x AS (SELECT string_agg({_tag("Layer", _tag("ows:Identifier", "replace(layer, '&', '&amp;')"), _tag("ows:BoundingBox", _tag("ows:LowerCorner", "printf('%.6f %.6f', xmin, ymin)"), _tag("ows:UpperCorner", "printf('%.6f %.6f', xmax, ymax)")), _tag("TileMatrixSetLink", "'<TileMatrixSet>world</TileMatrixSet>'", _tag("TileMatrixSetLimits", "limits")))}, '' ORDER BY layer) AS layers FROM l),
m AS (SELECT string_agg({_MATRIX_SQL}, '' ORDER BY lod) AS matrices FROM (SELECT DISTINCT lod FROM pyramid))
SELECT '<?xml version="1.0" encoding="UTF-8"?><Capabilities version="1.0.0" xmlns="http://www.opengis.net/wmts/1.0" xmlns:ows="http://www.opengis.net/ows/1.1">' || {_tag("Contents", "layers", _tag("TileMatrixSet", "'<ows:Identifier>world</ows:Identifier><ows:SupportedCRS>EPSG:3857</ows:SupportedCRS>'", "matrices"))} || '</Capabilities>' AS xml FROM x, m""")
def capabilities(spark, d):
    n = F.pow(F.lit(2.0), F.col("lod"))
    layer = F.concat(F.lit("layer & "), ((F.col("x") + F.col("y")) % 3).cast("string"))
    r = tiles(spark, d).groupBy(layer.alias("layer"), "lod").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    ends = [(F.col("x0") / n).alias("xmin"), (F.col("y0") / n).alias("ymin"), ((F.col("x1") + 1) / n).alias("xmax"), ((F.col("y1") + 1) / n).alias("ymax")]
    sets = _matrices(spark, d).select(F.lit("world").alias("set"), F.lit("EPSG:3857").alias("crs"), "*")
    return C.capabilities(sets, r.select("*", F.lit("world").alias("set"), *ends))


@query("b18_styles", f"""SELECT n, '{{"version":2,"sources":{{"main":{{"type":"surface","url":"' || brand || '"}}}},"terrain":{{"sources":["main"]}},"layers":["' || type || '"],"illumination":{{"light":["tracking","' || size || '","45"]}}}}' AS json {FRAMES}""")
def styles(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("n"), C.style(F.col("p_brand"), F.array("p_type"), F.col("p_size").cast("string")).alias("json"))


@query("b21_templates", f"""SELECT n, '{{"group":"TEMPLATE","id":"r' || n || '","type":"tms","driver":"' || brand || '","revision":' || size || '}}' AS json {FRAMES}""")
def templates(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("n"), C.definition_json(F.lit("g"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")), F.lit("tms"), F.col("p_brand"), F.col("p_size"), template=True).alias("json"))


def _next(n: int) -> str:
    """The SQL of an overview level; means are rounded half up in whole numbers, for ties are common there."""
    return f"o{n} AS (SELECT px >> 1 AS px, py >> 1 AS py, CAST((sum(CAST(round(z * 10000) AS BIGINT)) + 5 * count(*)) // (10 * count(*)) AS DOUBLE) / 1000 AS z FROM o{n - 1} WHERE z IS NOT NULL GROUP BY 1, 2)"


@query("b23_overview_levels", f"WITH {_BLOCK}, o0 AS (SELECT px, py, z FROM cell), {_next(1)}, {_next(2)}, {_next(3)} SELECT 1 AS ovr, * FROM o1 UNION ALL SELECT 2, * FROM o2 UNION ALL SELECT 3, * FROM o3")
def overview_levels(spark, d):
    level, out = blocks(spark, d), None
    for n in (1, 2, 3):
        level = R.overview_step(level)
        here = level.select(F.lit(n).alias("ovr"), *R.PIX, "z")
        out = here if out is None else out.unionByName(here)
    return out


@query("c6_file_names", f"""
WITH {PYRAMID}, n AS (SELECT CASE (x + y) % 4 WHEN 0 THEN 'surface' WHEN 1 THEN 'geodata' WHEN 2 THEN 'terrain' ELSE 'wmts' END AS interface, lod || '-' || x || '-' || y || '.' || CASE x % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'terrain' ELSE 'png' END AS name FROM pyramid)
SELECT interface, name, CASE WHEN interface = 'surface' AND name LIKE '%.meta' THEN 'tile' WHEN interface = 'geodata' AND name LIKE '%.meta' THEN 'metatile' WHEN interface = 'terrain' AND name LIKE '%.terrain' THEN 'terrain' WHEN interface = 'wmts' AND name LIKE '%.png' THEN 'image' ELSE 'unknown' END AS kind FROM n
UNION ALL SELECT * FROM (VALUES ('surface', 'tileset.index', 'index'), ('geodata', 'geo', 'unknown'), ('geodata', 'freelayer.json', 'definition'), ('terrain', 'layer.json', 'definition'), ('wmts', 'WMTSCapabilities.xml', 'capabilities'), ('wmts', 'layer.json', 'unknown'))""")
def file_names(spark, d):
    which, ext = (F.col("x") + F.col("y")) % 4, F.col("x") % 3
    n = tiles(spark, d).select(F.when(which == 0, "surface").when(which == 1, "geodata").when(which == 2, "terrain").otherwise("wmts").alias("interface"), F.concat(F.concat_ws("-", *P.TILE), F.lit("."), F.when(ext == 0, "meta").when(ext == 1, "terrain").otherwise("png")).alias("name"))
    more = [("surface", "tileset.index"), ("geodata", "geo"), ("geodata", "freelayer.json"), ("terrain", "layer.json"), ("wmts", "WMTSCapabilities.xml"), ("wmts", "layer.json")]
    n = n.unionByName(spark.createDataFrame(more, "interface string, name string"))
    return n.select("interface", "name", S.classify_name(F.col("interface"), F.col("name")).alias("kind"))


@query("c12_mask_short_circuit", f"WITH {T.PIXEL_SQL} SELECT px >> 1 AS tx, py >> 1 AS ty, CASE WHEN count(z) = 0 THEN 'EMPTY' WHEN count(z) = count(*) THEN 'FULL' ELSE 'DATA' END AS status FROM pixel GROUP BY 1, 2")
def mask_short_circuit(spark, d):
    g = T.pixels(spark, d).groupBy(F.shiftright("px", 1).alias("tx"), F.shiftright("py", 1).alias("ty"))
    return g.agg(F.when(F.count("z") == 0, "EMPTY").when(F.count("z") == F.count(F.lit(1)), "FULL").otherwise("DATA").alias("status"))


@query("d5_index_check", f"""
WITH {INDEX}, i AS (SELECT lod, x, y, flags | 2 AS flags FROM idx)
SELECT 'tile without payload' AS kind, lod, x, y FROM i WHERE lod = 7 AND y % 16 = 5
UNION ALL SELECT 'watertight with some children', i.lod, i.x, i.y FROM i JOIN (SELECT lod - 1 AS lod, x >> 1 AS x, y >> 1 AS y, count(*) AS n FROM i WHERE lod > 0 GROUP BY 1, 2, 3) k USING (lod, x, y) WHERE k.n BETWEEN 1 AND 3""")
def index_check(spark, d):
    t = tiles(spark, d)
    tight = index(spark, d).withColumn("flags", F.col("flags").bitwiseOR(P.WATERTIGHT))
    found = P.check_pair(tight, t.where("NOT (lod = 7 AND y % 16 = 5)").select(*P.TILE, "min_z", "max_z"))
    return found.where(F.col("kind").isin("tile without payload", "watertight with some children"))


@query("e2_coverage_pass", f"WITH {T.PIXEL_SQL} SELECT px >> 3 AS x, py >> 3 AS y, min(mask) AS mask_min, max(mask) AS mask_max FROM pixel GROUP BY 1, 2")
def coverage_pass(spark, d):
    return T.pixels(spark, d).groupBy(F.shiftright("px", 3).alias("x"), F.shiftright("py", 3).alias("y")).agg(F.min("mask").alias("mask_min"), F.max("mask").alias("mask_max"))


@query("e12_projected_extents", f"WITH {BORDER} SELECT k, round(min(x), 3) + 0.0 AS x0, round(min(y), 3) + 0.0 AS y0, round(max(x), 3) + 0.0 AS x1, round(max(y), 3) + 0.0 AS y1 FROM flat GROUP BY k")
def projected(spark, d):
    return V.projected_extents(boxes(spark, d), 4).select("k", *[(F.round(c, 3) + 0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("e12_refined_extents", f"""
WITH {BOXES}, p AS (
  SELECT k, radians(CAST(CASE i // 4096 % 4 WHEN 0 THEN xmin + i % 4096 / 4096 * 10 WHEN 1 THEN xmax WHEN 2 THEN xmax - i % 4096 / 4096 * 10 ELSE xmin END AS DOUBLE)) AS lo,
    radians(CAST(CASE i // 4096 % 4 WHEN 0 THEN ymax WHEN 1 THEN ymax - i % 4096 / 4096 * 10 WHEN 2 THEN ymin ELSE ymin + i % 4096 / 4096 * 10 END AS DOUBLE)) AS la
  FROM boxes, (SELECT unnest(range(0, 16384)) AS i)),
g AS (SELECT k, 6378137.0 / sqrt(1 - (1 / 298.257223563) * (2 - 1 / 298.257223563) * sin(la) ** 2) * cos(la) AS r, lo FROM p)
SELECT k, round(min(r * cos(lo)), -2) + 0.0 AS x0, round(min(r * sin(lo)), -2) + 0.0 AS y0, round(max(r * cos(lo)), -2) + 0.0 AS x1, round(max(r * sin(lo)), -2) + 0.0 AS y1 FROM g GROUP BY k""")
def refined(spark, d):
    """Extents in geocentric axes, in which borders bend: four samples to a side, refined around the extremes."""
    flat = lambda lon, lat: S.geocentric(lon, lat, F.lit(0.0))[:2]
    return V.projected_extents(boxes(spark, d), 4, 4, flat).select("k", *[(F.round(c, -2) + 0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("e13_camera_extents", f"""
WITH {BORDER}, c AS (SELECT *, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e FROM border JOIN (SELECT k, radians(CAST((xmin + xmax) / 2 AS DOUBLE)) AS clo, radians(CAST((ymin + ymax) / 2 AS DOUBLE)) AS cla FROM boxes) USING (k)),
n AS (SELECT *, 6378137.0 / sqrt(1 - e * sin(la) * sin(la)) AS n, 6378137.0 / sqrt(1 - e * sin(cla) * sin(cla)) AS m FROM c),
g AS (SELECT *, n * cos(la) * cos(lo) - m * cos(cla) * cos(clo) AS dx, n * cos(la) * sin(lo) - m * cos(cla) * sin(clo) AS dy, n * (1 - e) * sin(la) - m * (1 - e) * sin(cla) AS dz FROM n),
t AS (SELECT k, -sin(clo) * dx + cos(clo) * dy AS te, -sin(cla) * cos(clo) * dx - sin(cla) * sin(clo) * dy + cos(cla) * dz AS tn FROM g)
SELECT k, round(max(te) - min(te), 2) AS width, round(max(tn) - min(tn), 2) AS height, round(greatest(max(te) - min(te), max(tn) - min(tn)) * CAST(1.3 AS DOUBLE), 2) AS vertical FROM t GROUP BY k""")
def camera(spark, d):
    return V.camera_extents(boxes(spark, d), 4, dem=True).select("k", *[F.round(c, 2).alias(c) for c in ("width", "height", "vertical")])


@query("f7_sibling_window", f"WITH {INDEX} SELECT lod, x, y, count(*) OVER w AS n, bool_and(flags & 2 <> 0) OVER w AS all_watertight FROM idx WINDOW w AS (PARTITION BY lod, x >> 1, y >> 1)")
def sibling_window(spark, d):
    return P.siblings(index(spark, d))


@query("f9_geoid_lattice", "WITH p AS (SELECT c_custkey, CAST(least(64, 2 * (1 + c_nationkey), ceil((c_custkey % 90 + 1) / 2.5)) AS INT) AS cells, least(greatest((c_custkey % 53) / CAST(10 AS DOUBLE) - 0.5, 0), 3.999) AS fx, least(greatest((c_custkey % 31) / CAST(6 AS DOUBLE) - 0.5, 0), 3.999) AS fy FROM customer), l AS (SELECT n_nationkey % 5 AS i, n_nationkey // 5 AS j, n_regionkey * CAST(2 AS DOUBLE) - n_nationkey AS v FROM nation) SELECT c_custkey, cells, round(a.v * (1 - (fx - floor(fx))) * (1 - (fy - floor(fy))) + b.v * (fx - floor(fx)) * (1 - (fy - floor(fy))) + c.v * (1 - (fx - floor(fx))) * (fy - floor(fy)) + e.v * (fx - floor(fx)) * (fy - floor(fy)), 6) + 0.0 AS v FROM p JOIN l a ON a.i = floor(fx) AND a.j = floor(fy) JOIN l b ON b.i = floor(fx) + 1 AND b.j = floor(fy) JOIN l c ON c.i = floor(fx) AND c.j = floor(fy) + 1 JOIN l e ON e.i = floor(fx) + 1 AND e.j = floor(fy) + 1")
def geoid_lattice(spark, d):
    k = F.col("c_custkey")
    cells = F.least(F.lit(64), 2 * (1 + F.col("c_nationkey")), F.ceil((k % 90 + 1) / 2.5)).cast("int")
    held = lambda c: F.least(F.greatest(c - 0.5, F.lit(0.0)), F.lit(3.999))
    points = T.table(spark, d, "customer").select("c_custkey", cells.alias("cells"), held((k % 53) / 10.0).alias("fx"), held((k % 31) / 6.0).alias("fy"))
    nodes = T.table(spark, d, "nation").select((F.col("n_nationkey") % 5).alias("i"), F.expr("CAST(n_nationkey div 5 AS INT)").alias("j"), (F.col("n_regionkey") * 2.0 - F.col("n_nationkey")).alias("v"))
    return R.bilinear(points, nodes, (4, 4)).select("c_custkey", "cells", (F.round("v", 6) + 0.0).alias("v"))


@query("g1_job_order", f"WITH {INDEX} SELECT lod, x & ~31 AS bx, y & ~31 AS by, count(*) AS cells FROM idx GROUP BY 1, 2, 3")
def job_order(spark, d):
    jobs = P.metatiles(index(spark, d)).select("lod", "bx", "by", F.col("n").alias("cells"))
    return jobs.orderBy(F.desc("cells"), "lod", "by", "bx")


@query("i7_pixel_size", f"WITH {BOXES}, c AS (SELECT k, (ymin + ymax) / 2 AS la FROM boxes) SELECT k, round(greatest(radians(CAST(0.01 AS DOUBLE)) * 6378137.0, (ln(tan(pi() / 4 + radians(CAST(la + 0.02 AS DOUBLE)) / 2)) - ln(tan(pi() / 4 + radians(CAST(la - 0.02 AS DOUBLE)) / 2))) * 6378137.0 / 2), 3) AS gsd, round(CASE WHEN k % 3 = 0 THEN 2.25 ELSE CAST(100 AS DOUBLE) / (20 * (k + 1)) END, 6) AS area FROM c")
def pixel_size(spark, d):
    b = boxes(spark, d)
    size = V.gsd((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, F.lit(0.01), F.lit(0.02))
    area = V.gsd_area(F.when(F.col("k") % 3 == 0, 1.5), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(20.0), F.col("k") + 1.0)
    return b.select("k", F.round(size, 3).alias("gsd"), F.round(area, 6).alias("area"))


@query("i18_skirts", f"WITH {PYRAMID} SELECT lod, x, y, round(CAST(360 AS DOUBLE) / pow(2, lod) * CAST(0.01 AS DOUBLE), 9) AS skirt FROM pyramid")
def skirts(spark, d):
    return tiles(spark, d).select(*P.TILE, F.round(S.skirt_height(360.0 / F.pow(F.lit(2.0), F.col("lod"))), 9).alias("skirt"))


@query("i19_triangulation", f"WITH {_BLOCK}, v AS (SELECT px, py, z FROM cell WHERE z IS NOT NULL) SELECT a.px, a.py, t, a.z AS z0, CASE t WHEN 0 THEN b.z ELSE e.z END AS z1, CASE t WHEN 0 THEN e.z ELSE c.z END AS z2 FROM v a JOIN v b ON b.px = a.px + 1 AND b.py = a.py JOIN v c ON c.px = a.px AND c.py = a.py + 1 JOIN v e ON e.px = a.px + 1 AND e.py = a.py + 1, (SELECT CAST(unnest([0, 1]) AS INT) AS t)")
def triangulation(spark, d):
    cells = M.triangulate(blocks(spark, d))
    both = F.array(*[F.struct(F.lit(t).alias("t"), *[F.col(f"c{c}").alias(f"z{i}") for i, c in enumerate(corners)]) for t, corners in enumerate(((0, 1, 3), (0, 3, 2)))])
    return cells.select(*R.PIX, F.explode(both).alias("f")).select(*R.PIX, "f.*")


@query("i21_circumference", f"WITH {BORDER}, s AS (SELECT a.k, round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 3) AS l FROM flat a JOIN flat b ON b.k = a.k AND b.i = a.i + 1) SELECT k, CAST(sum(CAST(l AS DECIMAL(20,3))) AS DOUBLE) AS length FROM s GROUP BY k")
def circumferences(spark, d):
    return V.circumference(boxes(spark, d), 4)


@query("i23_tangent_planes", f"WITH {BOXES}, c AS (SELECT k, radians(CAST(xmin AS DOUBLE)) AS lo, radians(CAST(ymin AS DOUBLE)) AS la FROM boxes) SELECT k, round(-sin(lo), 9) + 0.0 AS e0, round(cos(lo), 9) + 0.0 AS e1, round(-sin(la) * cos(lo), 9) + 0.0 AS n0, round(-sin(la) * sin(lo), 9) + 0.0 AS n1, round(cos(la), 9) + 0.0 AS n2, round(cos(la) * cos(lo), 9) + 0.0 AS u0, round(cos(la) * sin(lo), 9) + 0.0 AS u1, round(sin(la), 9) + 0.0 AS u2 FROM c")
def tangent_planes(spark, d):
    east, north, up = V.tangent_basis(F.col("xmin"), F.col("ymin"))
    named = [(east[0], "e0"), (east[1], "e1"), *zip(north, ("n0", "n1", "n2"), strict=True), *zip(up, ("u0", "u1", "u2"), strict=True)]
    return boxes(spark, d).select("k", *[(F.round(c, 9) + 0.0).alias(n) for c, n in named])


@query("i35_definition_defaults", """
SELECT p_partkey, p_name AS dataset, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'hillshade' END AS processing, CASE WHEN p_size % 4 = 0 THEN '-z,' || p_size ELSE '' END AS options, CASE WHEN p_size % 3 = 0 THEN 'png' ELSE 'jpg' END AS format, CASE WHEN p_size % 5 = 0 THEN 'dem' ELSE 'cubic' END AS resampling, p_size % 7 = 0 AS erode,
  '{"dataset":"' || p_name || '","processing":"' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'hillshade' END || '"' || CASE WHEN p_size % 4 = 0 THEN ',"processingOptions":["-z","' || p_size || '"]' ELSE '' END || ',"format":"' || CASE WHEN p_size % 3 = 0 THEN 'png' ELSE 'jpg' END || '","resampling":"' || CASE WHEN p_size % 5 = 0 THEN 'dem' ELSE 'cubic' END || '","erodeMask":' || CASE WHEN p_size % 7 = 0 THEN 'true' ELSE 'false' END || '}' AS built FROM part""")
def definition_defaults(spark, d):
    s = F.col("p_size")
    options = F.when(s % 4 == 0, F.array(F.lit("-z"), s.cast("string")))
    text = F.to_json(F.struct(F.col("p_name").alias("dataset"), F.when(s % 2 == 0, F.col("p_brand")).otherwise("hillshade").alias("processing"), options.alias("processingOptions"), F.when(s % 3 == 0, "png").alias("format"), F.when(s % 5 == 0, "dem").alias("resampling"), F.when(s % 7 == 0, True).alias("erodeMask")))
    p = T.table(spark, d, "part").select("p_partkey", C.parse_definition(text, "tms-gdaldem").alias("d"))
    return p.select("p_partkey", "d.dataset", "d.processing", F.array_join("d.processingOptions", ",").alias("options"), "d.format", "d.resampling", F.col("d.erodeMask").alias("erode"), C.build_definition(F.col("d")).alias("built"))


@query("i35_vector_definitions", "SELECT p_partkey, p_brand AS dem, CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE '' END AS layers, CASE WHEN p_size % 3 = 0 THEN 'always' ELSE 'auto' END AS mode, CAST(CASE WHEN p_size % 5 = 0 THEN p_size ELSE 256 END AS INT) AS display FROM part")
def vector_definitions(spark, d):
    s = F.col("p_size")
    text = F.to_json(F.struct(F.col("p_name").alias("dataset"), F.col("p_brand").alias("demDataset"), F.when(s % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("layers"), F.when(s % 3 == 0, "always").alias("mode"), F.when(s % 5 == 0, s).alias("displaySize")))
    p = T.table(spark, d, "part").select("p_partkey", C.parse_definition(text, "geodata-vector").alias("d"))
    return p.select("p_partkey", F.col("d.demDataset").alias("dem"), F.array_join("d.layers", ",").alias("layers"), "d.mode", F.col("d.displaySize").alias("display"))


@query("l6_polygon_mask", """
WITH t AS (SELECT DISTINCT CAST(k * 3 + i AS INT) AS x, CAST(k * 2 + j AS INT) AS y FROM (SELECT n_nationkey AS k, 3 + n_nationkey % 6 AS s FROM nation), (SELECT unnest(range(0, 9)) AS i) a, (SELECT unnest(range(0, 9)) AS j) b WHERE i + j <= s),
p AS (SELECT DISTINCT CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y FROM t, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE x + dx BETWEEN 1 AND 70 AND y + dy BETWEEN 0 AND 47),
w AS (SELECT s, x >> s AS x, y >> s AS y, count(*) AS n FROM p, (SELECT CAST(unnest(range(0, 5)) AS INT) AS s) GROUP BY s, 2, 3 HAVING count(*) = CAST(pow(4, s) AS BIGINT))
SELECT s, x, y, 1 AS flags FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.s = a.s + 1 AND b.x = a.x >> 1 AND b.y = a.y >> 1)""")
def polygon_mask(spark, d):
    """Polygons to pixels, spread by two, cut to the frame, as a quadtree of uniform squares."""
    n = T.table(spark, d, "nation").select((F.col("n_nationkey") * 3).alias("x"), (F.col("n_nationkey") * 2).alias("y"), (3 + F.col("n_nationkey") % 6).alias("s"))
    tri = n.select(F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("s")).alias("bx"), F.col("y").alias("by"), F.col("x").alias("cx"), (F.col("y") + F.col("s")).alias("cy"))
    wide = R.dilate(M.covered(tri).withColumn("mask", F.lit(1)), 2)
    return P.uniform_quads(T.bbox(wide, 1, 0, 70, 47, "px", "py").select(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(1).alias("flags")), 4)


@query("l10_index_generator", f"WITH {OTHER} SELECT lod, x, y, flags | 2 AS flags FROM other WHERE lod = 5 AND x BETWEEN 3 AND 20 AND y BETWEEN 2 AND 25")
def index_generator(spark, d):
    return P.combine(P.stamp(spark, [(5, 3, 2, 20, 25)], P.WATERTIGHT), other(spark, d), (0, 7))


@query("l11_catalogue", "SELECT p_brand AS grp, count(*) AS n, count(*) FILTER (p_size > 25) AS ready, max(p_partkey) AS newest FROM part GROUP BY 1")
def catalogue(spark, d):
    return T.table(spark, d, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("ready"), F.max("p_partkey").alias("newest"))


_WHAT = "['list-resources', 'update-resources', 'updated-since', 'updated-since', 'supports-reference-frame', 'has-resource', 'is-resource-ready', 'resource-url', 'has-resource', 'no-such', 'updated-since'][1 + k % 11]"
_NAMED = "k % 13 <> 5 AND k % 11 <> 8"


@query("l11_commands", f"""
WITH r AS (SELECT CASE p_size % 2 WHEN 0 THEN 'earth' ELSE 'mars' END AS rf, p_brand AS grp, 'r' || p_partkey AS resource, p_size > 25 AS ready, p_size * 1000 AS updated, p_partkey AS k FROM part),
c AS (SELECT *, {_WHAT} AS command, CASE WHEN {_NAMED} THEN resource ELSE 'lost' END AS wanted, k % 11 AS w FROM r),
a AS (SELECT string_agg(rf || '/tms/' || grp || '/' || resource, chr(10) ORDER BY rf || '/tms/' || grp || '/' || resource) AS everything, max(updated) AS newest FROM r)
SELECT k AS id, CASE w WHEN 0 THEN everything WHEN 1 THEN 'resource updater notified' || chr(10) || 42 WHEN 2 THEN CASE WHEN newest > 20000 THEN 'true' ELSE 'false' END
  WHEN 3 THEN CASE WHEN {_NAMED} AND updated > 20000 THEN 'true' ELSE 'false' END WHEN 4 THEN CASE WHEN EXISTS (SELECT 1 FROM r q WHERE q.rf = c.rf) AND k % 2 = 0 THEN 'true' ELSE 'false' END
  WHEN 5 THEN CASE WHEN {_NAMED} THEN 'true' ELSE 'false' END WHEN 6 THEN CASE WHEN {_NAMED} AND ready THEN 'true' ELSE 'false' END
  WHEN 7 THEN CASE WHEN {_NAMED} THEN '/' || rf || '/tms/' || grp || '/' || resource || '/' ELSE 'error: no such resource' END
  WHEN 8 THEN 'error: has-resource expects 3 arguments' WHEN 9 THEN 'error: unknown command no-such' ELSE 'error: argument is not a number' END AS answer FROM c, a""")
def commands(spark, d):
    k = F.col("p_partkey")
    r = T.table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "earth").otherwise("mars").alias("rf"), F.col("p_brand").alias("grp"), F.concat(F.lit("r"), k.cast("string")).alias("resource"), F.lit("tms").alias("type"), (F.col("p_size") > 25).alias("ready"), (F.col("p_size") * 1000).cast("long").alias("updated"), k.alias("id"))
    w, i = F.col("id") % 11, F.col("id")
    name = F.array("rf", "grp", F.when((i % 13 != 5) & (w != 8), F.col("resource")).otherwise("lost"))
    none, since = F.array().cast("array<string>"), F.array(F.lit("20000"))
    args = F.when(w < 2, none).when(w == 2, since).when(w == 3, F.concat(since, name)).when(w == 4, F.array(F.when(i % 2 == 0, F.col("rf")).otherwise("venus"))).when(w == 8, since).when(w == 10, F.array(F.lit("soon"))).otherwise(name)
    what = F.element_at(F.array(*[F.lit(c) for c in ("list-resources", "update-resources", "updated-since", "updated-since", "supports-reference-frame", "has-resource", "is-resource-ready", "resource-url", "has-resource", "no-such", "updated-since")]), (w + 1).cast("int"))
    return C.answer(r.select("id", what.alias("command"), args.alias("args")), r.drop("id"), 42)


@query("i38_matrix_roots", "SELECT CAST(1 AS INT) AS lod, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, CAST(min(x) * 20 AS DOUBLE) AS xmin, CAST(min(y) * 10 AS DOUBLE) AS ymin, CAST(max(x) * 20 + 20 AS DOUBLE) AS xmax, CAST(max(y) * 10 + 10 AS DOUBLE) AS ymax FROM (SELECT CAST(n_nationkey % 5 AS INT) AS x, CAST(n_nationkey // 5 AS INT) AS y FROM nation WHERE n_regionkey = 2)")
def matrix_roots(spark, d):
    k = F.col("n_nationkey")
    n = T.table(spark, d, "nation").select(F.when(F.col("n_regionkey") == 2, 1).otherwise(2).alias("lod"), (k % 5).cast("int").alias("x"), F.expr("CAST(n_nationkey div 5 AS INT)").alias("y"), F.concat(F.lit("srs"), F.col("n_regionkey").cast("string")).alias("srs"))
    return C.matrix_roots(n.select("*", *[e.cast("double").alias(c) for c, e in (("xmin", F.col("x") * 20), ("ymin", F.col("y") * 10), ("xmax", F.col("x") * 20 + 20), ("ymax", F.col("y") * 10 + 10))]), "srs2")


def _kernel(name: str, t: str) -> str:
    return {
        "bilinear": f"greatest(0, 1 - abs({t}))",
        "cubic": f"CASE WHEN abs({t}) < 1 THEN 1.5 * abs({t}) ** 3 - 2.5 * {t} ** 2 + 1 WHEN abs({t}) < 2 THEN -0.5 * abs({t}) ** 3 + 2.5 * {t} ** 2 - 4 * abs({t}) + 2 ELSE 0 END",
        "cubicspline": f"CASE WHEN abs({t}) < 1 THEN CAST(2 AS DOUBLE) / 3 - {t} ** 2 + abs({t}) ** 3 / 2 WHEN abs({t}) < 2 THEN (2 - abs({t})) ** 3 / 6 ELSE 0 END",
        "lanczos": f"CASE WHEN abs({t}) < 1e-9 THEN 1 WHEN abs({t}) < 3 THEN 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t}) ** 2 ELSE 0 END",
    }[name]


def _resampled(method: str, kernel: str, scale: float) -> str:
    """Targets by kernel: cells meet the targets around their own, weights are kernels of both distances."""
    wide, n = max(scale, 1.0), 4 if scale >= 1 else 7
    return f"""SELECT '{method}' AS method, tx AS px, ty AS py, sum(w * z) / sum(w) AS z FROM (
  SELECT tx, ty, z, ({_kernel(kernel, "u")}) * ({_kernel(kernel, "v")}) AS w, floor((tx + CAST(0.5 AS DOUBLE)) * {scale}) = px AND floor((ty + CAST(0.5 AS DOUBLE)) * {scale}) = py AS own FROM (
    SELECT *, ((tx + CAST(0.5 AS DOUBLE)) * {scale} - (px + CAST(0.5 AS DOUBLE))) / {wide} AS u, ((ty + CAST(0.5 AS DOUBLE)) * {scale} - (py + CAST(0.5 AS DOUBLE))) / {wide} AS v FROM (
      SELECT px, py, CAST(z AS DOUBLE) AS z, CAST(floor((px + CAST(0.5 AS DOUBLE)) / {scale}) + i AS INT) AS tx, CAST(floor((py + CAST(0.5 AS DOUBLE)) / {scale}) + j AS INT) AS ty FROM few, (SELECT unnest(range(-{n}, {n + 1})) AS i), (SELECT unnest(range(-{n}, {n + 1})) AS j)))) GROUP BY 1, 2, 3 HAVING bool_or(own) AND abs(sum(w)) > 1e-9"""


@query("e7_interpolation", f"""
WITH {_BLOCK}, few AS (SELECT px, py, z FROM cell WHERE z IS NOT NULL AND px < 48 AND py < 48), u AS (
{" UNION ALL ".join(_resampled(m, m, 2.0) for m in ("bilinear", "cubic", "cubicspline", "lanczos"))} UNION ALL {_resampled("dem", "cubicspline", 0.5)}
UNION ALL SELECT 'texture', CAST(floor((px + CAST(0.5 AS DOUBLE)) / 2) AS INT), CAST(floor((py + CAST(0.5 AS DOUBLE)) / 2) AS INT), avg(CAST(z AS DOUBLE)) FROM few GROUP BY 2, 3)
SELECT method, px, py, round(z + 1e-7, 3) AS z FROM u""")
def interpolation(spark, d):
    """The interpolating methods at half size, and elevations at twice the size. Sums of prices by sixteenths end halfway
    between two roundings, from which a small shift keeps them."""
    g = blocks(spark, d).where("px < 48 AND py < 48").select(*R.PIX, F.col("z").cast("double").alias("z"))
    made = [R.interpolate(g, 0.5 if m == "dem" else 2.0, m).select(F.lit(m).alias("method"), *R.PIX, F.round(F.col("z") + 1e-7, 3).alias("z")) for m in ("bilinear", "cubic", "cubicspline", "lanczos", "texture", "dem")]
    return reduce(lambda a, b: a.unionByName(b), made)
