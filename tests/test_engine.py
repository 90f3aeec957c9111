"""The engine's queries against their SQL, its invariants, store, streams and plug-ins."""

from __future__ import annotations

import hashlib
import json
import math
import threading
import time

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import metatile, png
from tessera.functions import scalars as S
from tessera.operators import catalogue, geometry, pyramid, raster
from tessera.plans import more_queries, plugins, queries, registry, service_queries, store_queries  # noqa: F401
from tessera.sources import definitions, store, tables
from tessera.streaming import jobs, refresh

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return round(float(x), 6) if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    a = sorted((tuple(value(x) for x in r) for r in got.collect()), key=repr)
    b = sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_steps_equal_the_closed_form(spark):
    a = queries.mip_steps(spark, SF)
    b = queries.tiles(spark, SF).where("lod >= 4")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@pytest.mark.parametrize("absent", [0, 3])
def test_store_round_trip(spark, tmp_path, absent):
    nodes = spark.range(4**5).select(F.lit(5).alias("lod"), F.expr("CAST(id % 32 AS INT)").alias("x"), F.expr("CAST(id DIV 32 AS INT)").alias("y"))
    nodes = nodes.where(F.pmod(F.xxhash64("lod", "x", "y"), F.lit(4)) != absent).withColumn("min_z", F.xxhash64("x", "y") % 1000 * 1.0).withColumn("max_z", F.col("min_z") + 5).withColumn("watertight", F.lit(True))
    tiles = pyramid.pyramid(nodes, 5)
    index = pyramid.flags(tiles)
    root = f"file://{tmp_path}/s"
    store.publish(index, tiles.select("lod", "x", "y", "min_z", "max_z"), root, {"rf": "earth"})
    i, s = store.read_pair(spark, root, rf="earth")
    assert pyramid.diff(index, i.select("lod", "x", "y", "flags")).count() == 0
    assert pyramid.check_pair(i, s).count() == 0
    with pytest.raises(ValueError):
        store.read_pair(spark, root, rf="mars")
    assert store.is_current(spark, root, {"pairing": store.manifest(spark, root)["pairing"]})
    store.publish(index.where("lod < 5"), None, root, {"rf": "earth"})
    assert store.read_pair(spark, root, whole=True)[1] is None


def test_a_pair_whose_files_changed_is_rejected(spark, tmp_path):
    index = queries.index(spark, SF).where("lod < 4")
    root = f"file://{tmp_path}/s"
    generation = store.publish(index, None, root, {})
    assert store.read_pair(spark, root)[0].count() == index.count()
    index.where("lod = 3").select("x", "y", "flags").write.mode("append").parquet(f"{root}/{generation}/index/lod=3")
    with pytest.raises(ValueError, match="different generations"):
        store.read_pair(spark, root)


def test_missing_payload_fails(spark):
    with pytest.raises(Exception, match="no payload"):
        pyramid.serve(queries.index(spark, SF), queries.tiles(spark, SF).where("lod <> 6").select("lod", "x", "y", "min_z", "max_z")).collect()


def test_refresh_stream(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    serving = refresh.Serving(spark, f"file://{tmp_path}/serving")
    report = lambda epoch, df: seen.append({r.id: r.action for r in df.collect()})
    for text in ('{"id":"a","revision":1,"body":"x"}\n{"id":"b","revision":1,"body":"y"}', '{"id":"a","revision":2,"body":"x"}\n{"id":"c","revision":1,"body":"z"}'):
        (src / f"{len(seen)}.json").write_text(text)
        refresh.refresh(spark, f"file://{src}", f"file://{tmp_path}/cp", serving, report).awaitTermination()
    assert seen == [{"a": "add", "b": "add"}, {"a": "replace", "b": "remove", "c": "add"}]
    assert {r.id: r.revision for r in serving.read().collect()} == {"a": 2, "c": 1}


def test_served_generations_outlive_a_restart(spark, tmp_path):
    root = f"file://{tmp_path}/serving"
    one = spark.createDataFrame([("a", 1, "x", False)], "id string, revision int, body string, system boolean")
    first = refresh.Serving(spark, root)
    assert first.generation() is None and first.read().count() == 0
    first.replace(one)
    held = first.read()
    again = refresh.Serving(spark, root)
    assert [r.id for r in again.read().collect()] == ["a"]
    again.replace(one.withColumn("id", F.lit("b")))
    assert [r.id for r in refresh.Serving(spark, root).read().collect()] == ["b"]
    # readers of the old generation still have it
    assert [r.id for r in held.collect()] == ["a"]


def test_updater_retries_wakes_and_says_when_it_is_ready():
    fails, done = [2], []

    def update():
        if fails[0]:
            fails[0] -= 1
            raise OSError("not there")
        done.append(time.time())

    u = refresh.Updater(update, period=60.0, retry=0.05)
    assert not u.ready(0)
    u.start()
    assert u.ready(10) and u.runs == 3 and u.error is None and len(done) == 1
    asked = u.wake()
    for _ in range(100):
        if u.updated_since(asked):
            break
        time.sleep(0.05)
    assert u.updated_since(asked) and len(done) == 2
    u.stop()
    assert not u.updated_since(time.time() + 1)


def test_forecast_rolls_over(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    serving = refresh.Serving(spark, f"file://{tmp_path}/serving")
    for n, hours in enumerate(([0, 1, 2], [5, 7, 8], [13, 19])):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{h:02}:30:00Z", "value": 1.0}) for h in hours))
        stream = spark.readStream.schema("ts timestamp, value double").json(f"file://{src}")
        refresh.forecast_stream(stream, serving, f"file://{tmp_path}/cp", "6 hours").awaitTermination()
    kept = sorted((r.id, r.revision) for r in serving.read().collect())
    assert [i[11:13] for i, _ in kept] == ["06", "12"] and [n for _, n in kept] == [2, 1]


def test_half_range_holds_the_range(spark):
    rows = spark.createDataFrame([(0.1, 0.1), (-70000.0, 70000.0), (1e-9, 1e-9), (1234.567, 1234.568), (0.0, 0.0)], "a double, b double")
    values = [*np.random.default_rng(1).normal(size=300).tolist(), *(np.random.default_rng(2).normal(size=300) * 1e4).tolist(), *[2.0**e * (1 + d) for e in range(-30, 17) for d in (-2e-16, 0.0, 3e-16, 1e-4)]]
    rows = rows.unionByName(spark.createDataFrame([(v * s, v * s) for v in values for s in (1.0, -1.0)], "a double, b double"))
    low, high = S.half_range(F.col("a"), F.col("b"))
    for r in rows.select("a", "b", low.alias("lo"), high.alias("hi")).collect():
        a, b = max(min(r.a, 65504), -65504), max(min(r.b, 65504), -65504)
        assert r.lo <= a and r.hi >= b
        assert np.float64(np.float16(r.lo)) == r.lo and np.float64(np.float16(r.hi)) == r.hi
        # no half-precision number is nearer
        assert float(np.nextafter(np.float16(r.lo), np.float16(np.inf))) > a or r.lo == 65504
        assert float(np.nextafter(np.float16(r.hi), np.float16(-np.inf))) < b or r.hi == -65504


def test_obj_and_missing_vectors(spark):
    lines = [(i, s) for i, s in enumerate(["v 0 0 0", "v 1 0 0", "v 0 1 0", "usemtl m", "f 1/1 2/2 3/3", "f 3 2 1"])]
    v, f = tables.obj_mesh(spark.createDataFrame(lines, "n int, line string"))
    assert v.count() == 3 and {r.material for r in f.collect()} == {"m"}
    name = "long " * 400
    text = ["v 1e-5 -2.5E2 .5", "v 1 2 x", "v 0 0 1 1", "v 0 1 1", f"usemtl {name}", "f 1 2/1 3//2 4", "v 5 5 5", "f -1 -2 -3", "f 1 2", "v 9 9 9", "f 1 -1 2 3 4"]
    for block in (1 << 16, 3):
        v, f = tables.obj_mesh(spark.createDataFrame(list(enumerate(text)), "n int, line string"), block=block)
        assert sorted(tuple(r) for r in v.collect())[:2] == [(1, 1e-5, -250.0, 0.5), (2, 1.0, 2.0, None)]
        assert sorted(tuple(r) for r in f.collect()) == [(i + 1, *c, name.strip()) for i, c in enumerate([(1, 2, 3), (1, 3, 4), (5, 4, 3), (1, 6, 2), (1, 2, 3), (1, 3, 4)])]
    assert tables.vector_or_empty(spark, "/nowhere/at/all.parquet", "fid long").count() == 0
    with pytest.raises(ValueError):
        tables.check_unique(spark.createDataFrame([(1,), (1,)], "id int"), ["id"])


def test_overview_sizes():
    assert raster.overview_sizes(16, 16) == [(8, 8), (4, 4), (2, 2)]
    assert raster.overview_sizes(5, 100) == [(3, 50), (2, 25)]


def test_plugins(spark):
    f = plugins.height_function({"function": "superelevation", "heightRange": [0, 10], "scaleRange": [1, 2]})
    got = [r[0] for r in spark.createDataFrame([(-5.0,), (5.0,), (50.0,)], "h double").select(f(F.col("h"))).collect()]
    assert got == [0.0, 7.5, 20.0]
    with pytest.raises(KeyError):
        plugins.GENERATORS.get("nothing")


def test_enhance_by_shuffle_equals_broadcast(spark):
    f = spark.createDataFrame([(1, {"a": "x"}), (2, {"b": "y"}), (3, None)], "k int, props map<string,string>")
    t = spark.createDataFrame([(1, "lost", 5), (2, "new", None)], "id int, a string, n int")
    for most in (0, 10):
        got = {r.k: r.props for r in catalogue.enhance(f, t, "k", "id", most=most).collect()}
        assert got == {1: {"a": "x", "n": "5"}, 2: {"b": "y", "a": "new"}, 3: None}


def test_digest_follows_rows_not_order(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 2).alias("v"))
    a, b, c = (catalogue.digest(x, ["id", "v"]).first()[0] for x in (df, df.orderBy(F.desc("id")).repartition(7), df.where("id <> 3")))
    assert a == b != c


def test_png_round_trip():
    grey = (np.arange(5 * 9).reshape(5, 9) * 37 % 256).astype(np.uint8)
    data = png.encode(grey)
    assert (png.decode(data) == grey).all()
    assert data[12:16] == b"IHDR" and data[-8:-4] == b"IEND"
    with pytest.raises(ValueError):
        png.decode(data.replace(b"IHDR", b"IHDX"))


def test_includes(spark, tmp_path):
    entry = lambda i: {"group": "g", "id": i, "type": "tms", "driver": "x", "referenceFrames": {"earth": {"lodRange": [1, 2]}}}
    (tmp_path / "sub").mkdir()
    files = {
        "main.json": [entry("a"), {"include": ["sub/b.json", "sub/nothing-*.json"]}, {"include": "sub/*.json"}],
        "sub/b.json": entry("b"), "sub/c.json": [{"include": "../d.json"}, entry("c")], "d.json": [entry("d")],
        "twice.json": [entry("d"), {"include": "d.json"}], "lost.json": [{"include": "no.json"}], "ring.json": [{"include": "ring.json"}, entry("r")],
    }
    for name, what in files.items():
        (tmp_path / name).write_text(json.dumps(what, indent=1))
    load = lambda name: sorted(r.id for r in definitions.load_resources(spark, f"file://{tmp_path}/{name}").collect())
    assert load("main.json") == ["a", "b", "c", "d"]
    assert load("ring.json") == ["r"]
    with pytest.raises(ValueError, match="duplicate"):
        load("twice.json")
    for name in ("lost.json", "absent.json"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            definitions.ConfFile(spark, f"file://{tmp_path}/{name}")


def test_abort_ends_a_job(spark):
    said = []

    def sleepy():
        try:
            jobs.abortable(spark, "slow", lambda: spark.range(10**14).selectExpr("sum(sqrt(id))").collect())
        except Exception as e:
            said.append(str(e))

    t = threading.Thread(target=sleepy)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        jobs.abort(spark, "slow")
        if said:
            break
    t.join(20)
    assert said and "cancel" in said[0].lower()
    assert spark.range(10).count() == 10


def test_a_step_that_drops_columns_fails(spark):
    df = spark.range(3).withColumn("v", F.lit(1))
    assert plugins.postprocessed(df, lambda f: f.withColumn("w", F.col("v"))).columns == ["id", "v", "w"]
    with pytest.raises(ValueError, match="dropped"):
        plugins.postprocessed(df, lambda f: f.drop("v"))
    with pytest.raises(TypeError, match="provides no"):
        plugins.provider(object(), "tileset", lambda p: p)


@pytest.mark.parametrize("method", ["bilinear", "cubic", "cubicspline", "lanczos", "texture", "dem"])
@pytest.mark.parametrize("scale", [0.5, 1.0, 2.0])
def test_interpolating_resampling(spark, method, scale):
    def cubic(t):
        return 1.5 * t**3 - 2.5 * t * t + 1 if t < 1 else -0.5 * t**3 + 2.5 * t * t - 4 * t + 2 if t < 2 else 0

    kernels = {
        "bilinear": lambda t: max(0, 1 - t), "cubic": cubic, "lanczos": lambda t: float(np.sinc(t) * np.sinc(t / 3)) if t < 3 else 0,
        "cubicspline": lambda t: 2 / 3 - t * t + t**3 / 2 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0,
    }
    cells = {(x, y): float((x * 7 + y * 13) % 11) for x in range(8) for y in range(8) if (x, y) != (3, 4)}
    df = spark.createDataFrame([(x, y, z) for (x, y), z in cells.items()] + [(3, 4, None)], "px int, py int, z double")
    got = {(r.px, r.py): r.z for r in raster.interpolate(df, scale, method).collect()}
    name = {"texture": "cubic" if scale < 2 else "average", "dem": "cubicspline" if scale < 2 else "average"}.get(method, method)
    wide, want = max(scale, 1.0), {}
    for x in range(int(8 / scale)):
        for y in range(int(8 / scale)):
            if name == "average":
                inside = [z for (i, j), z in cells.items() if (int((i + 0.5) / scale), int((j + 0.5) / scale)) == (x, y)]
                want[x, y] = sum(inside) / len(inside)
            elif (int((x + 0.5) * scale), int((y + 0.5) * scale)) in cells:
                w = {c: kernels[name](abs((x + 0.5) * scale - c[0] - 0.5) / wide) * kernels[name](abs((y + 0.5) * scale - c[1] - 0.5) / wide) for c in cells}
                want[x, y] = sum(w[c] * cells[c] for c in cells) / sum(w.values())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_windows_across_blocks_against_plain_ones(spark):
    r = np.random.default_rng(3)
    cells = {(int(x) - 8, int(y) - 8): (float(r.integers(100)) if r.random() < 0.8 else None, int(r.integers(2) * 255)) for x in range(20) for y in range(20) if r.random() < 0.85}
    df = spark.createDataFrame([(x, y, z, m) for (x, y), (z, m) in cells.items()], "px int, py int, z double, mask int")
    ring = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    near = lambda p: {o: cells[p[0] + o[0], p[1] + o[1]] for o in ring if (p[0] + o[0], p[1] + o[1]) in cells}
    for shift in (1, 2, 6):
        w = raster.around(df, ["z"], shift=shift).agg(F.count(F.lit(1)).alias("n"), raster.at("z", 1, -1).alias("v"))
        got = {(x.px, x.py): (x.n, x.v) for x in w.collect()}
        spots = {(x - dx, y - dy) for x, y in cells for dx, dy in ring}
        assert got == {p: (len(near(p)), near(p).get((1, -1), (None,))[0]) for p in spots}
    filled = {(x.px, x.py): x.z for x in raster.fill_holes(df).collect()}
    want = {}
    for p, (z, m) in cells.items():
        if z is None and m:
            v = [c[0] for o, c in near(p).items() if o != (0, 0) and c[0] is not None]
            want[p] = round(sum(v) / len(v), 3) if v else None
    assert filled.keys() == want.keys() and all(filled[p] == pytest.approx(want[p], abs=1e-3) for p in want)
    assert {(x.px, x.py): x["mask"] for x in raster.erode(df).collect()} == {p: min(c[1] for c in near(p).values()) for p, (_, m) in cells.items() if m}
    assert {(x.px, x.py) for x in raster.dilate(df, 2).collect()} == {(x + dx, y + dy) for (x, y), (_, m) in cells.items() if m for dx in range(-2, 3) for dy in range(-2, 3)}
    assert raster.fill_holes(df.limit(0)).count() == 0


def test_a_neighbourhood_shuffles_little_more_than_its_table(spark):
    df = spark.range(256 * 256).select((F.col("id") % 256).cast("int").alias("px"), F.expr("CAST(id DIV 256 AS INT)").alias("py"), F.col("id").cast("double").alias("z"), F.lit(255).alias("mask"))
    plan = raster.erode(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan
    copies = df.withColumn("b", F.explode(F.sequence(F.shiftright(F.col("px") - 1, 6), F.shiftright(F.col("px") + 1, 6)))).count()
    assert copies < 1.04 * 256 * 256


def test_pair_checks_name_each_violation(spark):
    index = spark.createDataFrame([(0, 0, 0, 3), (1, 0, 0, 3), (1, 1, 0, 1), (2, 0, 0, 1)], "lod int, x int, y int, flags int")
    rows = [(0, 0, 0, 0.0, 9.0), (1, 0, 0, -1.0, 5.0), (2, 0, 0, 1.0, 2.0), (1, 1, 1, 1.0, 2.0), (3, 7, 7, 1.0, 2.0)]
    got = {(r.kind, r.lod, r.x, r.y) for r in pyramid.check_pair(index, spark.createDataFrame(rows, "lod int, x int, y int, min_z double, max_z double")).collect()}
    assert got == {
        ("unreachable payload", 1, 1, 1), ("unreachable payload", 3, 7, 7), ("payload without parent", 3, 7, 7), ("parent does not contain child", 1, 0, 0),
        ("tile without payload", 1, 1, 0), ("watertight with some children", 0, 0, 0), ("watertight with some children", 1, 0, 0),
    }


def test_heights_are_coded_by_mode_and_priority(spark):
    cells = lambda rows: spark.createDataFrame(rows, "px int, py int, z double")
    stack = [catalogue.Raster(cells([(0, 0, 1.0), (1, 0, None)]), 10.0, 10.0, 1.0), catalogue.Raster(cells([(0, 0, 2.0)]), 0.0, 0.0, 20.0)]
    points = [(f"{m}{k}", m, x, y, z) for m in ("always", "auto", "never") for k, (x, y, z) in enumerate([(10.5, 10.5, None), (11.5, 10.5, 7.0), (99.0, 0.0, 8.0), (99.0, 0.0, None), (None, 1.0, 3.0)])]
    df = spark.createDataFrame(points, "k string, mode string, x double, y double, z double")
    got = {r.k: r.z for r in catalogue.height_code(df, stack, F.col("mode")).collect()}
    assert got == {
        "always0": 1.0, "always1": 2.0, "always2": 8.0, "always3": None, "always4": 3.0, "auto0": 1.0, "auto1": 7.0, "auto2": 8.0, "auto3": None, "auto4": 3.0,
        "never0": None, "never1": 7.0, "never2": 8.0, "never3": None, "never4": 3.0,
    }


def test_what_is_malformed_fails(spark):
    a = spark.createDataFrame([(1, 1, ["x"]), (2, 1, ["y"])], "k int, revision int, credits array<string>")
    with pytest.raises(Exception, match="no imagery for 2"):
        catalogue.compose(a, a.where("k = 1"), ["k"]).collect()
    nodes = spark.createDataFrame([(1, 0, 0, "a", 0.0, 0.0, 1.0, 1.0), (2, 0, 0, "a", 0.0, 0.0, 1.0, 1.0), (1, 1, 0, "b", 1.0, 0.0, 2.0, 1.0)], "lod int, x int, y int, srs string, xmin double, ymin double, xmax double, ymax double")
    for content, said in (("a", "one level"), ("c", "no root node"), (None, "single-rooted")):
        with pytest.raises(Exception, match=said):
            catalogue.matrix_roots(nodes, content).collect()
    assert catalogue.matrix_roots(nodes.where("lod = 2"), None).first().lod == 2
    with pytest.raises(Exception, match="no processing"):
        spark.range(1).select(catalogue.parse_definition(F.lit('{"dataset":"d"}'), "tms-gdaldem").alias("d")).collect()


def test_rings_and_segments_are_clipped(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    rings = {"inside": [(1, 1), (3, 1), (3, 3)], "outside": [(20, 20), (30, 20), (30, 30)], "around": [(-5, -5), (15, -5), (15, 15), (-5, 15)], "corner": [(-5, 5), (5, -5), (15, 5), (5, 15)], "half": [(5, -5), (15, 5), (5, 5)]}
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in rings.items()], "k string, ring array<struct<x:double,y:double>>")
    got = {r.k: r.a for r in df.select("k", geometry.ring_area(geometry.clip_ring(F.col("ring"), box)).alias("a")).collect()}
    step = 0.05
    at = np.arange(step / 2, 10, step)
    for k, ring in rings.items():
        n = 0
        for x in at:
            cross = []
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (ax > x) != (bx > x):
                    cross.append(ay + (x - ax) / (bx - ax) * (by - ay))
            cross = np.clip(sorted(cross), 0, 10)
            n += sum(b - a for a, b in zip(cross[::2], cross[1::2], strict=True)) * step
        assert got.get(k, 0) == pytest.approx(n, abs=0.05)
    lines = spark.createDataFrame([(0, -5.0, 5.0, 15.0, 5.0), (1, 2.0, 2.0, 3.0, 3.0), (2, 11.0, 0.0, 11.0, 9.0), (3, 5.0, 5.0, 5.0, 50.0), (4, 4.0, 4.0, 4.0, 4.0), (5, -1.0, 9.0, 2.0, 12.0)], "k int, a double, b double, c double, d double")
    cut = {r.k: r.l and tuple(r.l) for r in lines.select("k", geometry.clip_segment(*[F.col(c) for c in "abcd"], box).alias("l")).collect()}
    assert cut == {0: (0.0, 5.0, 10.0, 5.0), 1: (2.0, 2.0, 3.0, 3.0), 2: None, 3: (5.0, 5.0, 5.0, 10.0), 4: (4.0, 4.0, 4.0, 4.0), 5: (0.0, 10.0, 0.0, 10.0)}


def test_colour_png_round_trip():
    for channels in (3, 4):
        image = (np.arange(4 * 6 * channels).reshape(4, 6, channels) * 41 % 256).astype(np.uint8)
        assert (png.decode(png.encode(image)) == image).all()


def test_metatile_round_trip():
    r = np.random.default_rng(7)
    for order, n in ((5, 300), (0, 1), (2, 0), (3, 64)):
        side = 1 << order
        place = r.permutation(side * side)[:n]
        x, y, flags = 64 + place % side, 96 + place // side, r.integers(0, 256, n)
        data = metatile.encode(9, order, 64, 96, x, y, flags)
        lod, bx, by, gx, gy, got = metatile.decode(data)
        assert (lod, bx, by) == (9, 64, 96) and sorted(zip(y.tolist(), x.tolist(), flags.tolist(), strict=True)) == list(zip(gy.tolist(), gx.tolist(), got.tolist(), strict=True))
    with pytest.raises(ValueError, match="twice"):
        metatile.encode(1, 1, 0, 0, np.array([0, 0]), np.array([1, 1]), np.array([1, 1]))
    with pytest.raises(ValueError, match="no metatile"):
        metatile.decode(b"PNG")


def test_listings_repeat_once_a_file(spark, tmp_path):
    key, parts = "parquet.dictionary.page.size", 8
    r = spark.range(2000).select(F.lit("earth").alias("rf"), F.lit("g").alias("grp"), F.concat(*[F.sha2(F.concat(F.lit(f"{i}-"), F.col("id").cast("string")), 256) for i in range(16)]).alias("resource"), F.lit("tms").alias("type"), F.lit(True).alias("ready"), (F.col("id") * 10).alias("updated"))
    args = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("id").cast("string")))
    c = spark.range(480).select("id", F.when(F.col("id") % 4 == 0, "list-resources").otherwise("updated-since").alias("command"), args.alias("args"))
    listing = "\n".join(sorted(f"earth/tms/g/{x.resource}" for x in r.collect()))
    assert len(listing) > 1 << 20
    try:
        got = catalogue.answer(c, r, 7)
        each = {x.p: x.n for x in got.where("answer LIKE 'earth%'").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        assert sum(each.values()) == 120 and max(each.values()) <= 30
        got.write.parquet(f"file://{tmp_path}/out")
    finally:
        spark.conf.unset(key)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(x.a, x.n) for x in back.groupBy(F.sha2("answer", 256).alias("a")).agg(F.count(F.lit(1)).alias("n")).collect()} == {(hashlib.sha256(a.encode()).hexdigest(), n) for a, n in ((listing, 120), ("true", 360))}
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < (parts + 2) * len(listing)


def test_listings_are_not_compared_for_statistics(spark, tmp_path):
    keys = ("parquet.dictionary.page.size", "parquet.column.statistics.enabled#answer")
    r = spark.range(9000).select(F.lit("earth").alias("rf"), F.lit("g").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("resource"), F.lit("tms").alias("type"), F.lit(True).alias("ready"), F.col("id").alias("updated"))
    c = spark.range(60).select("id", F.when(F.col("id") % 3 == 0, "list-resources").when(F.col("id") % 3 == 1, "no-such").alias("command"), F.array().cast("array<string>").alias("args"))
    listing = "\n".join(sorted(f"earth/tms/g/{x.resource}" for x in r.collect()))
    bounds = lambda at: [m.row_group(g).column(i).has_column_index for f in at.glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups) for i in range(m.num_columns) if m.row_group(g).column(i).path_in_schema == "answer"]
    for k in keys:
        spark.conf.unset(k)
    try:
        catalogue.answer(c, r.limit(5), 7).write.parquet(f"file://{tmp_path}/few")
        assert any(bounds(tmp_path / "few"))
        catalogue.answer(c, r, 7).write.parquet(f"file://{tmp_path}/out")
        assert bounds(tmp_path / "out") and not any(bounds(tmp_path / "out"))
        spark.conf.set(keys[1], "true")
        catalogue.answer(c, r, 7)
        assert spark.conf.get(keys[1]) == "true"
    finally:
        for k in keys:
            spark.conf.unset(k)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert [back.where(w).count() for w in (F.col("answer") == listing, F.col("answer") == "error: unknown command no-such", F.col("answer").isNull(), F.col("answer") > "zzz")] == [20, 20, 20, 0]
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 10 * len(listing)


def test_commands_with_odd_arguments(spark):
    r = spark.createDataFrame([("earth", "g", "a", "tms", None, 30), ("mars", "g", "b", "tms", True, 10)], "rf string, grp string, resource string, type string, ready boolean, updated long")
    asked = {
        ("has-resource", ("earth", "g", "a")): "true", ("has-resource", ("earth", None, "a")): "false", ("has-resource", ("earth", "g", "a", "x")): "error: has-resource expects 3 arguments", ("has-resource", None): "error: has-resource expects 3 arguments",
        ("is-resource-ready", ("earth", "g", "a")): "false", ("is-resource-ready", ("mars", "g", "b")): "true", ("resource-url", ("mars", "g", "b")): "/mars/tms/g/b/", ("resource-url", ("mars", "g", "c")): "error: no such resource",
        ("updated-since", ("20", "earth", "g", "a")): "true", ("updated-since", ("20", "mars", "g", "b")): "false", ("updated-since", ("20", "mars", "g", "c")): "false", ("updated-since", ("soon", "mars", "g", "b")): "error: argument is not a number",
        ("updated-since", ("20",)): "true", ("updated-since", ("30",)): "false", ("updated-since", ("20", "mars")): "error: updated-since expects 1 or 4 arguments", ("list-resources", ("x",)): "error: list-resources expects 0 arguments",
        ("list-resources", ()): "earth/tms/g/a\nmars/tms/g/b", ("no-such", ("earth", "g", "a")): "error: unknown command no-such", (None, ("earth", "g", "a")): None, ("supports-reference-frame", ("venus",)): "false",
    }
    c = spark.createDataFrame([(i, k, None if a is None else list(a)) for i, (k, a) in enumerate(asked)], "id long, command string, args array<string>")
    assert [x.answer for x in catalogue.answer(c, r, 7).orderBy("id").collect()] == list(asked.values())
    assert [x.answer for x in catalogue.answer(c.where("command = 'list-resources'"), r.limit(0), 7).orderBy("id").collect()] == ["error: list-resources expects 0 arguments", ""]
