"""Queries over stores, definitions, registries, streams and whole builds."""

from __future__ import annotations

import json
import threading
import uuid
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import metatile, png
from tessera.functions import scalars as S
from tessera.operators import catalogue as C
from tessera.operators import pyramid as P
from tessera.plans import builds as B
from tessera.plans import plugins, service_queries  # noqa: F401  (its SQL is used here)
from tessera.plans.queries import CELL, INDEX, LOD, PYRAMID, SHIFT, cells, index, tiles
from tessera.plans.registry import ORACLES, query
from tessera.sources import definitions as D
from tessera.sources import store
from tessera.sources import tables as T
from tessera.streaming import jobs, refresh


@query("a1_open_once", f"WITH {T.PIXEL_SQL} SELECT count(*) AS first, count(*) AS again, true AS same FROM pixel")
def open_once(spark, d):
    a, b = (T.open_once(spark, f"{d}/lineitem.parquet") for _ in range(2))
    n = a.agg(F.count(F.lit(1)).alias("first")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("again"))), F.lit(True))
    return n.withColumn("same", F.lit(a is b))


def _entries(spark, d) -> DataFrame:
    """(region, entry): a definition of each nation."""
    n = T.table(spark, d, "nation")
    text = F.format_string('{"group":"g%d","id":"n%d","type":"tms","driver":"%s","revision":%d,"referenceFrames":{"earth":{"lodRange":[1,9]}}}', "n_regionkey", "n_nationkey", F.regexp_replace("n_name", '["\\\\]', ""), "n_nationkey")
    return n.select(F.col("n_regionkey").alias("region"), text.alias("entry"))


def _write_definitions(spark, d) -> str:
    """Files of definitions in two folders, and one that includes them by name, list and glob; the path of that."""
    root = store.scratch(spark, "definitions")
    entries = _entries(spark, d)
    for name, where in (("one", "region = 0"), ("two/odd", "region IN (1, 3)"), ("two/even", "region IN (2, 4)")):
        entries.where(where).groupBy().agg(F.concat(F.lit("["), F.array_join(F.collect_list("entry"), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(f"{root}/{name}")
    for name, includes in (("two/all", [{"include": "../odd/part-*"}]), ("main", [{"include": ["../one/part-*", "../two/all/part-*"]}, {"include": "../two/even/part-*"}, {"include": "../two/even/part-*"}])):
        spark.createDataFrame([(json.dumps(includes),)], "value string").coalesce(1).write.text(f"{root}/{name}")
    return f"{root}/main/part-*"


@query("a8_definition_files", "SELECT 'earth' AS rf, 'g' || n_regionkey AS \"group\", 'n' || n_nationkey AS id, replace(replace(n_name, '\"', ''), '\\', '') AS driver, CAST(n_nationkey AS INT) AS revision FROM nation")
def definition_files(spark, d):
    return D.load_resources(spark, _write_definitions(spark, d)).select("rf", "group", "id", "driver", "revision")


@query("a10_conf_file", "SELECT 'g' || n_regionkey AS \"group\", count(*) AS n FROM nation GROUP BY 1")
def conf_file(spark, d):
    return D.ConfFile(spark, _write_definitions(spark, d)).load().groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def example_definitions() -> list[dict]:
    return [{"group": f"g{i % 5}", "id": f"r{i}", "type": "tms", "driver": "patchwork", "revision": i, "referenceFrames": {"earth": {"lodRange": [1, 5 + i % 7]}}} for i in range(60)]


@query("a11_callable_backend", "SELECT 'g' || (i % 5) AS \"group\", 'r' || i AS id, CAST(i AS INT) AS revision, CAST(5 + i % 7 AS INT) AS lod_max FROM (SELECT unnest(range(0, 60)) AS i)")
def callable_backend(spark, d):
    return D.callable_backend(spark, __name__, "example_definitions").select("group", "id", "revision", "lod_max")


@query("a12_index_reader", f"WITH {INDEX} SELECT lod, x, y, flags FROM idx WHERE lod BETWEEN 2 AND 5")
def index_reader(spark, d):
    store.write_tiles(index(spark, d), path := store.scratch(spark, "index"))
    return store.read_tiles(spark, path, B.INDEX_COLUMNS).where("lod BETWEEN 2 AND 5").select(*P.TILE, "flags")


@query("b4_png_tiles", """
WITH c AS (SELECT l_partkey % 1024 AS px, l_orderkey % 1024 AS py, max(CASE WHEN l_linestatus = 'F' THEN 255 ELSE 0 END) AS mask FROM lineitem GROUP BY 1, 2),
t AS (SELECT DISTINCT px >> 3 AS x, py >> 3 AS y FROM c),
g AS (SELECT t.x, t.y, i, coalesce(c.mask, 0) AS v FROM t, (SELECT unnest(range(0, 64)) AS i) LEFT JOIN c ON c.px = t.x * 8 + i % 8 AND c.py = t.y * 8 + i // 8)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, 8 AS width, 8 AS height, string_agg(v, ',' ORDER BY i) AS pixels FROM g GROUP BY 1, 2""")
def png_tiles(spark, d):
    images = png.tile_images(cells(spark, d).select("px", "py", "mask"), SHIFT)
    return png.image_pixels(images).withColumn("pixels", F.array_join(F.col("pixels").cast("array<string>"), ","))


@query("b4_colour_tiles", """
WITH c AS (SELECT l_partkey % 1024 >> 3 AS px, l_orderkey % 1024 >> 3 AS py, max(l_suppkey) % 256 AS r, max(l_linenumber) * 30 AS g, max(l_quantity)::INT % 256 AS b FROM lineitem GROUP BY 1, 2),
t AS (SELECT DISTINCT px >> 3 AS x, py >> 3 AS y FROM c),
g AS (SELECT t.x, t.y, i, coalesce(c.r, 0) AS r, coalesce(c.g, 0) AS g, coalesce(c.b, 0) AS b, CASE WHEN c.r IS NULL THEN 0 ELSE 255 END AS a FROM t, (SELECT unnest(range(0, 64)) AS i) LEFT JOIN c ON c.px = t.x * 8 + i % 8 AND c.py = t.y * 8 + i // 8)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, 8 AS width, 8 AS height, string_agg(r || ',' || g || ',' || b || ',' || a, ',' ORDER BY i) AS pixels FROM g GROUP BY 1, 2""")
def colour_tiles(spark, d):
    """Tiles of red, green, blue and how opaque a pixel is; absent pixels are transparent."""
    li = T.table(spark, d, "lineitem")
    spot = [F.shiftright((F.col(c) % 1024).cast("int"), 3).alias(a) for c, a in (("l_partkey", "px"), ("l_orderkey", "py"))]
    c = li.groupBy(*spot).agg((F.max("l_suppkey") % 256).cast("int").alias("r"), (F.max("l_linenumber") * 30).cast("int").alias("g"), (F.max("l_quantity").cast("int") % 256).alias("b")).withColumn("a", F.lit(255))
    return png.image_pixels(png.tile_images(c, 3, ["r", "g", "b", "a"])).withColumn("pixels", F.array_join(F.col("pixels").cast("array<string>"), ","))


@query("b5_store_writer", f"WITH {PYRAMID} SELECT lod, x, y, min_z, max_z FROM pyramid")
def store_writer(spark, d):
    store.write_tiles(tiles(spark, d).select(*P.TILE, "min_z", "max_z"), path := store.scratch(spark, "store"))
    return store.read_tiles(spark, path, B.STORE_COLUMNS).select(*P.TILE, "min_z", "max_z")


@query("b8_paired_publication", f"WITH {INDEX} SELECT lod, x, y, flags, min_z, max_z FROM idx JOIN pyramid USING (lod, x, y)")
def paired_publication(spark, d):
    root, t = store.scratch(spark, "pair"), tiles(spark, d)
    store.publish(P.flags(t.where("lod < 3")), t.where("lod < 3").select(*P.TILE, "min_z", "max_z"), root, {"rf": "earth"})
    store.publish(P.flags(t), t.select(*P.TILE, "min_z", "max_z"), root, {"rf": "earth"})
    i, s = store.read_pair(spark, root, rf="earth")
    return i.join(s, P.TILE).select(*P.TILE, "flags", "min_z", "max_z")


@query("b9_coverage_publication", f"WITH {INDEX} SELECT lod, x, y, flags, false AS has_store FROM idx")
def coverage_publication(spark, d):
    store.publish(index(spark, d), None, root := store.scratch(spark, "coverage"), {"rf": "earth"})
    i, s = store.read_pair(spark, root)
    return i.select(*P.TILE, "flags", F.lit(s is not None).alias("has_store"))


@query("b10_metatile_files", ORACLES["e20_metatiles"])
def metatile_files(spark, d):
    """Metatiles written in their binary form, read again and taken apart."""
    metatile.metatile_files(P.metatiles(index(spark, d))).write.parquet(path := store.scratch(spark, "metatiles"))
    nodes = metatile.metatile_nodes(spark.read.parquet(path))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "flags"))), lambda e: F.concat_ws(":", e["y"].cast("string"), e["x"].cast("string"), e["flags"].cast("string")))
    return nodes.groupBy("lod", "bx", "by").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, " ").alias("nodes"))


@query("e15_file_digests", "SELECT n_nationkey AS id, md5(n_name || '|' || n_regionkey) AS digest FROM nation")
def file_digests(spark, d):
    """MD5 of the bytes of files, one written for each nation."""
    n = T.table(spark, d, "nation").select("n_nationkey", F.concat_ws("|", "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    n.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path := store.scratch(spark, "files"))
    files = spark.read.format("binaryFile").load(path)
    body = F.expr("substring(content, 1, length(content) - 1)")
    return files.select(F.col("n_nationkey").cast("int").alias("id"), F.md5(body).alias("digest"))


@query("i20_sample_counts", "SELECT c_custkey, CAST(greatest(2, least(24, round(12 * abs(c_acctbal) / 1000 / 4))) AS INT) AS samples FROM customer")
def sample_counts(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", S.sample_count(F.abs("c_acctbal") / 1000, 24).alias("samples"))


@query("i34_revisions", "SELECT p_partkey, CAST(greatest(p_size, p_partkey % 60) + CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 0 END AS INT) AS revision FROM part")
def revisions(spark, d):
    kind = F.when(F.col("p_brand").endswith("1"), "withRevisionBump").otherwise("safely")
    return T.table(spark, d, "part").select("p_partkey", C.revision(F.col("p_size"), F.col("p_partkey") % 60, kind).cast("int").alias("revision"))


def _definitions(spark, d) -> DataFrame:
    """Definitions that come and are revised: one of each user, by event."""
    e = T.table(spark, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").cast("int").alias("revision"), F.col("event_type").alias("body"), F.lit("2024-01-01 00:00:00").alias("loaded"))


@query("j1_refresh", "SELECT 'u' || user_id AS id, CAST(max(event_id) AS INT) AS revision, arg_max(event_type, event_id) AS body FROM events GROUP BY 1")
def refreshed(spark, d):
    """The stream of definition files, run until all that is there is served."""
    root = store.scratch(spark, "refresh")
    _definitions(spark, d).write.json(f"{root}/in")
    serving = refresh.Serving(spark, f"{root}/serving")
    refresh.refresh(spark, f"{root}/in", f"{root}/checkpoint", serving, lambda epoch, actions: None).awaitTermination()
    return serving.read().select("id", "revision", "body")


@query("j4_abort", "SELECT * FROM (VALUES ('tagged', 'aborted'), ('other', '10')) t(job, outcome)")
def aborted(spark, d):
    """A job that is aborted by its tag from another thread fails with that; one without the tag goes on."""
    outcome: list[str] = []

    def slow() -> None:
        try:
            jobs.abortable(spark, tag, lambda: spark.range(10**14).selectExpr("sum(sqrt(id))").collect())
            outcome.append("finished")
        except Exception as e:
            outcome.append("aborted" if "cancel" in str(e).lower() else str(e))

    tag = f"abort-{uuid.uuid4().hex}"
    run = threading.Thread(target=slow)
    run.start()
    while run.is_alive():
        jobs.abort(spark, tag)
        run.join(0.2)
    return spark.createDataFrame([("tagged", outcome[0]), ("other", str(spark.range(10).count()))], "job string, outcome string")


@query("j5_swap", "SELECT 'u' || user_id AS id, CAST(max(event_id) AS INT) AS revision FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def swap(spark, d):
    """A replacement that fails while it is prepared leaves the old generation serving."""
    newest = lambda df: df.groupBy("id").agg(F.max_by(F.struct("revision", "body"), "revision").alias("d")).select("id", "d.revision", "d.body")
    serving = refresh.Serving(spark, store.scratch(spark, "swap"))
    refresh.apply(newest(_definitions(spark, d).where("revision % 2 = 0")), serving)
    broken = newest(_definitions(spark, d)).withColumn("body", F.raise_error(F.lit("not prepared")).cast("string"))
    try:
        refresh.apply(broken, serving)
    except Exception as e:
        if "not prepared" not in str(e):
            raise
    return serving.read().select("id", "revision")


@query("j6_self_heal", "SELECT * FROM (VALUES ('same', true), ('other pair', false), ('other derivation', false)) t(derived, current)")
def self_heal(spark, d):
    store.publish(index(spark, d).where("lod < 5"), None, root := store.scratch(spark, "derived"), {"derivation": 2})
    mark = store.manifest(spark, root)["pairing"]
    cases = [("same", mark, 2), ("other pair", "x", 2), ("other derivation", mark, 1)]
    return spark.createDataFrame([(n, store.is_current(spark, root, {"pairing": p, "derivation": k})) for n, p, k in cases], "derived string, current boolean")


def _generate(spark, d, driver: str) -> DataFrame:
    return T.table(spark, d, "part").where(F.col("p_brand").endswith(driver)).select("p_partkey", F.lit(driver).alias("driver"))


for _driver, _make in (
    ("1", lambda r: r.select("p_partkey", "driver", (F.col("p_partkey") * 2).alias("made"))),
    ("2", lambda r: r.select("p_partkey", "driver", (F.col("p_partkey") + 7).alias("made"))),
):
    plugins.GENERATORS.register(f"tms/{_driver}", _make)
plugins.DEFINITIONS.register("tms/patchwork", "size int, name string")
plugins.DEFINITIONS.register("geodata/vector", "layers array<string>, size int")
plugins.BACKENDS.register("conffile", lambda spark, options: D.ConfFile(spark, options["path"]).load())
plugins.BACKENDS.register("callable", lambda spark, options: D.callable_backend(spark, options["module"], options["function"]))


@query("k1_generators", "SELECT p_partkey, right(p_brand, 1) AS driver, CASE WHEN p_brand LIKE '%1' THEN p_partkey * 2 ELSE p_partkey + 7 END AS made FROM part WHERE right(p_brand, 1) IN ('1', '2')")
def generators(spark, d):
    return plugins.GENERATORS.get("tms/1")(_generate(spark, d, "1")).unionByName(plugins.GENERATORS.get("tms/2")(_generate(spark, d, "2")))


@query("k2_definitions", "SELECT p_partkey, CAST(p_size AS INT) AS size, CASE WHEN p_size % 2 = 0 THEN p_brand END AS name, CASE WHEN p_size % 2 = 1 THEN p_brand || ',' || p_type END AS layers FROM part")
def parsed_definitions(spark, d):
    p = T.table(spark, d, "part")
    a = F.from_json(F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("name"))), plugins.DEFINITIONS.get("tms/patchwork"))
    b = F.from_json(F.to_json(F.struct(F.array("p_brand", "p_type").alias("layers"), F.col("p_size").alias("size"))), plugins.DEFINITIONS.get("geodata/vector"))
    even = p.where("p_size % 2 = 0").select("p_partkey", a.alias("f")).select("p_partkey", "f.size", "f.name", F.lit(None).cast("string").alias("layers"))
    return even.unionByName(p.where("p_size % 2 = 1").select("p_partkey", b.alias("f")).select("p_partkey", "f.size", F.lit(None).cast("string").alias("name"), F.array_join("f.layers", ",").alias("layers")))


@query("k3_backends", "SELECT 'conffile' AS backend, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'callable', 'r' || i FROM (SELECT unnest(range(0, 60)) AS i)")
def backends(spark, d):
    made = {"conffile": {"path": _write_definitions(spark, d)}, "callable": {"module": __name__, "function": "example_definitions"}}
    a, b = (plugins.BACKENDS.get(n)(spark, o).select(F.lit(n).alias("backend"), "id") for n, o in made.items())
    return a.unionByName(b)


class Doubled(jobs.Request):
    def run(self):
        return self.facts["size"] * 2


class Named(jobs.Request):
    def run(self):
        return self.facts["name"].upper()


@query("k4_worker_jobs", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size * 2 AS VARCHAR) WHEN 1 THEN '\"' || upper(p_brand) || '\"' END AS result, CASE WHEN p_partkey % 3 = 2 THEN 'KeyError: ''size''' END AS error FROM part")
def worker_jobs(spark, d):
    k = F.col("p_partkey") % 3
    kind = F.concat(F.lit(f"{__name__}:"), F.when(k == 1, "Named").otherwise("Doubled"))
    facts = F.when(k == 0, F.format_string('{"size":%d}', "p_size")).otherwise(F.to_json(F.struct(F.col("p_brand").alias("name"))))
    return jobs.in_workers(T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), facts.alias("facts")))


class TilesetProvider(Protocol):
    """What gives an index to others that need one."""

    def tileset(self) -> DataFrame: ...


class _Surface:
    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def tileset(self) -> DataFrame:
        return index(self.spark, self.d)


@query("k5_providers", f"WITH {INDEX} SELECT lod, count(*) AS n FROM idx GROUP BY lod")
def provided(spark, d):
    use = lambda p: p.tileset().groupBy("lod").agg(F.count(F.lit(1)).alias("n"))
    return plugins.provider(_Surface(spark, d), "tileset", use)


_HEIGHTS = {"function": "superelevation", "heightRange": [0, 50], "scaleRange": [1, 3]}
_COORDINATES = "round(CASE WHEN z <= 0 THEN z WHEN z >= 50 THEN z * 3 ELSE z * (1 + z / 50 * 2) END, 6)"


@query("k6_postprocess", f"""
WITH {CELL}, f AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT c_custkey, CAST(cell.z AS DOUBLE) + 1 AS z, f.s_name, CASE WHEN f.s_suppkey IS NULL THEN 1 ELSE 3 END AS n_props FROM customer LEFT JOIN cell ON px = c_custkey % 1024 AND py = c_nationkey * 7 LEFT JOIN f ON f.s_nationkey = c_nationkey AND f.r = 1""")
def postprocess(spark, d):
    """What runs on features once their heights are coded: attributes of a table, then heights raised by one."""
    k = F.col("c_custkey")
    c = T.table(spark, d, "customer").select(k, "c_nationkey", (k % 1024).cast("double").alias("x"), (F.col("c_nationkey") * 7).cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.create_map(F.lit("name"), F.col("c_name")).alias("props"))
    g = cells(spark, d).select("px", "py", "z")
    s = T.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.col("s_suppkey").alias("_order"))
    coded = C.height_code(c, [C.Raster(g, 0.0, 0.0, 1.0)], F.lit("auto"))
    out = plugins.postprocessed(coded, lambda f: C.enhance(f, s, "c_nationkey", "s_nationkey"), lambda f: f.withColumn("z", F.col("z") + 1))
    return out.select("c_custkey", "z", F.try_element_at("props", F.lit("s_name")).alias("s_name"), F.size("props").alias("n_props"))


@query("k7_height_functions", f"WITH f AS (SELECT p_partkey, least(greatest(p_size, 0), 50) * 1.0 AS z FROM part) SELECT p_partkey, 'scaled' AS kind, CAST({_COORDINATES} AS DOUBLE) AS h FROM f UNION ALL SELECT p_partkey, 'none', CAST(z AS DOUBLE) FROM f")
def height_functions(spark, d):
    f = T.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("z"))
    made = [(kind, plugins.height_function(definition)) for kind, definition in (("scaled", _HEIGHTS), ("none", None))]
    a, b = (f.select("p_partkey", F.lit(kind).alias("kind"), F.round(h(F.col("z")), 6).alias("h")) for kind, h in made)
    return a.unionByName(b)


@query("l1_build_tiling", f"WITH {INDEX} SELECT lod, x, y, flags, min_z, max_z FROM idx JOIN pyramid USING (lod, x, y)")
def build_tiling(spark, d):
    i, s = B.build_tiling(T.pixels(spark, d), LOD, SHIFT, store.scratch(spark, "tiling"), {"rf": "earth"})
    return P.serve(i.select(*P.TILE, "flags"), s.select(*P.TILE, "min_z", "max_z"))


@query("l4_setup_resource", f"""
WITH {PYRAMID}, o0 AS (SELECT px, py, max(z) AS z FROM pixel GROUP BY 1, 2),
o AS (SELECT s, px >> s AS x, py >> s AS y FROM o0, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS s) WHERE z IS NOT NULL GROUP BY 1, 2, 3)
SELECT min(px) AS xmin, max(px) AS xmax, min(py) AS ymin, max(py) AS ymax, count(*) AS n, (SELECT count(*) FROM o) AS n_overview, (SELECT min(lod) FROM pyramid) AS lod_min, (SELECT max(lod) FROM pyramid) AS lod_max, (SELECT count(*) FROM pyramid) AS n_tiles,
  'auto-open-terrain' AS credit, '{{"group":"g","id":"dem","type":"surface","driver":"surface-dem","revision":0}}' AS definition, 'g/dem' AS notified FROM pixel""")
def setup_resource(spark, d):
    told: list[str] = []
    made = B.setup_resource(spark, T.pixels(spark, d), "g", "dem", "© Open Terrain", store.scratch(spark, "resource"), told.append)
    return made.withColumn("notified", F.lit(",".join(told)))


@query("l5_overview_generator", ORACLES["b23_overview_levels"])
def overview_generator(spark, d):
    from tessera.plans.queries import blocks

    return B.build_overviews(blocks(spark, d), 3, store.scratch(spark, "overviews")).select("ovr", "px", "py", "z")


@query("l7_store_inspector", f"WITH {PYRAMID}, v AS (SELECT lod, count(*) AS n FROM pyramid WHERE lod = 7 AND y % 16 = 5 GROUP BY 1) SELECT p.lod, count(*) AS tiles, count(*) FILTER (watertight) AS watertight, count(*) FILTER (NOT (p.lod = 7 AND y % 16 = 5)) AS payloads, coalesce(any_value(v.n), 0) AS violations FROM pyramid p LEFT JOIN v USING (lod) GROUP BY p.lod")
def store_inspector(spark, d):
    t = tiles(spark, d)
    return B.inspect(P.flags(t), t.where("NOT (lod = 7 AND y % 16 = 5)").select(*P.TILE, "min_z", "max_z"))


@query("l9_index_converter", f"WITH {INDEX} SELECT lod, x, y, flags FROM idx")
def index_converter(spark, d):
    return B.convert(B.convert(index(spark, d), store.scratch(spark, "orc"), "orc"), store.scratch(spark, "csv"), "csv")
