"""Resources as tables: reconciliation, changes, credits, compositions, view lists, attribute joins and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def reconcile(configured: DataFrame, serving: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """add, remove (never of system resources), replace or keep, for each resource of either side. serving has system
    boolean."""
    a = configured.select(*key, F.struct(*fields).alias("_new"))
    b = serving.select(*key, F.struct(*fields).alias("_old"), "system")
    j = a.join(b, key, "full_outer")
    action = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull() & F.col("system"), "keep").when(F.col("_new").isNull(), "remove").when(F.col("_new").eqNullSafe(F.col("_old")), "keep").otherwise("replace")
    return j.select(*key, action.alias("action"))


def change_kind(rules: list[tuple[str, str]], old: str = "old", new: str = "new") -> Column:
    """The first rule (field, kind) whose field differs, null-safe; "no" where none does."""
    out = F.lit("no")
    for field, kind in reversed(rules):
        out = F.when(~F.col(f"{old}.{field}").eqNullSafe(F.col(f"{new}.{field}")), kind).otherwise(out)
    return out


def revision(stored: Column, configured: Column, change: Column) -> Column:
    return F.greatest(stored, configured) + F.when(change == "withRevisionBump", 1).otherwise(0)


def enhance(features: DataFrame, table: DataFrame, key: str, ident: str, props: str = "props", most: int = 100_000) -> DataFrame:
    """Features with the columns of the first row of their key added to props as text; existing properties win, nulls
    are skipped, missing keys leave the feature as it is. The table is broadcast where it has at most `most` rows."""
    others = [c for c in table.columns if c not in (ident, "_order")]
    order = ["_order"] if "_order" in table.columns else others
    first = table.withColumn("_rank", F.row_number().over(Window.partitionBy(ident).orderBy(*order))).where("_rank = 1")
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in others])
    extra = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    small = first.select(F.col(ident).cast("string").alias("_id"), extra.alias("_extra"))
    if table.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    j = features.join(small, F.col(key).cast("string") == F.col("_id"), "left")
    held = F.coalesce(F.map_keys(props), F.array().cast("array<string>"))
    new = F.map_filter("_extra", lambda k, _: ~F.array_contains(held, k))
    return j.withColumn(props, F.when(F.col("_extra").isNull(), F.col(props)).otherwise(F.map_concat(props, new))).drop("_id", "_extra")


def feature_filter(props: str, field: str, regex: str) -> Column:
    """Any property of that name that holds a match."""
    return F.exists(F.map_entries(props), lambda e: (e["key"] == field) & F.regexp_like(e["value"], F.lit(regex)))


def view_datasets(requests: DataFrame, registry: DataFrame, fallback: str) -> DataFrame:
    """Datasets of each request's list (request, ids array) in its order, each once, unknown ids left out, the fallback
    last; complete where all were found. registry: id, dataset."""
    each = requests.select("request", F.posexplode_outer("ids").alias("pos", "id"))
    known = each.join(registry, "id", "left")
    first = known.where("dataset IS NOT NULL").groupBy("request", "dataset").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("pos", "dataset"))).alias("l"))
    complete = known.groupBy("request").agg(F.bool_and(F.col("id").isNull() | F.col("dataset").isNotNull()).alias("complete"))
    out = complete.join(listed, "request", "left")
    names = F.coalesce(F.transform("l", lambda e: e["dataset"]), F.array().cast("array<string>"))
    return out.select("request", F.array_distinct(F.concat(names, F.array(F.lit(fallback)))).alias("datasets"), "complete")


def credits(wanted: DataFrame, own: DataFrame, system: DataFrame) -> DataFrame:
    """Numbers of credits by the resource's own registry, then the system's; unknown ones are dropped."""
    j = wanted.join(own.select("credit", F.col("num").alias("_a")), "credit", "left").join(system.select("credit", F.col("num").alias("_b")), "credit", "left")
    return j.withColumn("num", F.coalesce("_a", "_b")).where("num IS NOT NULL").select(*wanted.columns, "num")


def merged_credits(own: Column, other: Column, replace: Column) -> Column:
    return F.when(replace, other).otherwise(F.array_sort(F.array_union(own, other)))


def compose(surface: DataFrame, imagery: DataFrame, key: list[str]) -> DataFrame:
    """Surface with imagery: the higher revision, all credits. A surface without imagery is an error."""
    j = surface.join(imagery.select(*key, F.col("revision").alias("_r"), F.col("credits").alias("_c"), F.lit(True).alias("_there")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no imagery for "), F.concat_ws("/", *key)))
    revision = F.when(F.col("_there").isNull(), missing.cast("int")).otherwise(F.greatest("revision", "_r"))
    return j.select(*key, revision.alias("revision"), F.array_sort(F.array_union("credits", "_c")).alias("credits"))


@dataclass
class Raster:
    """Elevations as cells (px, py, z) from x0, y0 on, `size` wide."""

    cells: DataFrame
    x0: float
    y0: float
    size: float


def height_code(points: DataFrame, rasters: list[Raster], mode: Column) -> DataFrame:
    """points (x, y, z) with z of the first raster of the stack that has one at the point's cell. mode: "always" takes it
    wherever there is one, "auto" only for points without z, "never" leaves all as they are.

    Each raster is met by an equi-join on the cell; points that keep their z take no part in its search."""
    asks = (mode == "always") | (mode == "auto") & F.col("z").isNull()
    out = points.withColumn("_asks", asks).withColumn("_z", F.lit(None).cast("double"))
    for r in rasters:
        spot = [F.when(F.col("_asks") & F.col("_z").isNull(), F.floor((F.col(c) - c0) / r.size).cast("int")) for c, c0 in (("x", r.x0), ("y", r.y0))]
        held = r.cells.where("z IS NOT NULL").select(F.col("px").alias("_px"), F.col("py").alias("_py"), F.col("z").cast("double").alias("_new"))
        out = out.withColumn("_px", spot[0]).withColumn("_py", spot[1]).join(held, ["_px", "_py"], "left")
        out = out.withColumn("_z", F.coalesce("_z", "_new")).drop("_px", "_py", "_new")
    return out.withColumn("z", F.when(F.col("_asks"), F.coalesce("_z", "z")).otherwise(F.col("z"))).select(*points.columns)


def cache_age(explicit: Column, kind: Column, ages: dict[str, int]) -> Column:
    """Explicit age, else that of the file's class, else -1."""
    table = F.create_map(*[F.lit(x) for kv in ages.items() for x in kv])
    return F.coalesce(explicit, F.try_element_at(table, kind), F.lit(-1))


def kill_until(df: DataFrame, memory: str, limit: float) -> DataFrame:
    """Workers to stop, largest first, while the total that remains is at or over the limit. One window over the
    workers of a host (a handful)."""
    total = F.sum(memory).over(Window.partitionBy("host"))
    gone = F.coalesce(F.sum(memory).over(Window.partitionBy("host").orderBy(F.desc(memory), "worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("left", total - gone).where(F.col("left") >= limit)


def bound_layer(rf: Column, group: Column, ident: Column, form: Column, generator: int, rev: Column) -> Column:
    """JSON of a bound layer: url templates that carry both revisions."""
    url = lambda ext, r: F.concat(F.lit("{lod}-{x}-{y}."), ext, F.lit(f"?gr={generator}&r="), r.cast("string"))
    return F.to_json(F.struct(F.concat_ws("/", rf, group, ident).alias("id"), F.lit("raster").alias("type"), url(form, rev).alias("url"), url(F.lit("mask"), rev).alias("maskUrl"), url(F.lit("meta"), rev).alias("metaUrl")))


def layer_json(ranges: DataFrame) -> DataFrame:
    """Availability of each level (lod, x0, y0, x1, y1) as one JSON text in level order."""
    by_lod = ranges.groupBy("lod").agg(F.sort_array(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("available"))
    return by_lod.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("lod", "available"))), lambda e: e["available"])).alias("available"))


def digest(df: DataFrame, columns: list[str], salt: int = 0) -> DataFrame:
    """MD5 of the MD5s of row groups in order: an order-free digest of a table made in parallel. Groups are bounded by
    hash, the last step sees 256 digests."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    part = F.conv(F.substring(F.md5(row), 1, 2), 16, 10).cast("int")
    sums = df.select(part.alias("part"), F.conv(F.substring(F.md5(row), 3, 12), 16, 10).cast("decimal(38,0)").alias("h")).groupBy("part").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h", "n"))), lambda e: F.concat_ws(":", e["part"].cast("string"), e["h"].cast("string"), e["n"].cast("string"))), ",")
    return sums.agg(F.md5(F.concat(F.lit(str(salt)), text)).alias("digest"))


def next_id(df: DataFrame, column: str, start: int) -> DataFrame:
    return df.agg(F.coalesce(F.max(column) + 1, F.lit(start)).alias("next_id"))


def dataset_kind(bands: Column, byte: Column) -> Column:
    return F.when(byte & bands.between(1, 4), "ophoto").when((bands == 1) & ~byte, "dem").when(bands == 0, "vector").otherwise("error")


def free_layer(ident: Column, generator: int, rev: Column, style: Column, display_size: int, lods: Column) -> Column:
    """JSON of a free layer: url templates of metatiles and geodata, style, display size, range of levels."""
    url = lambda ext: F.concat(F.lit("{lod}-{x}-{y}."), F.lit(ext), F.lit(f"?gr={generator}&r="), rev.cast("string"))
    return F.to_json(F.struct(ident.alias("id"), F.lit("geodata-tiles").alias("type"), url("meta").alias("metaUrl"), url("geo").alias("geodataUrl"), style.alias("style"), F.lit(display_size).alias("displaySize"), lods.alias("lodRange")))


def map_config(own: DataFrame, other: DataFrame, link: str) -> DataFrame:
    """Layers (map id -> url) of each resource with those of the resource that `link` names: their paths are made
    relative, and its own layers win. other: id, layers."""
    j = own.join(other.select(F.col("id").alias(link), F.col("layers").alias("_more")), link, "left")
    held = F.map_keys("layers")
    more = F.transform_values(F.map_filter(F.coalesce("_more", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(held, k)), lambda _, v: F.concat(F.lit("../"), F.col(link).cast("string"), F.lit("/"), v))
    return j.withColumn("layers", F.map_concat("layers", more)).drop("_more")


def style(source: Column, layers: Column, light: Column) -> Column:
    """JSON of an introspection style: sources, terrain, layers and illumination."""
    return F.to_json(F.struct(F.lit(2).alias("version"), F.struct(F.struct(F.lit("surface").alias("type"), source.alias("url")).alias("main")).alias("sources"), F.struct(F.array(F.lit("main")).alias("sources")).alias("terrain"), layers.alias("layers"), F.struct(F.array(F.lit("tracking"), light, F.lit("45")).alias("light")).alias("illumination")))


def _element(name: str, *inner: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in inner], F.lit(f"</{name}>"))


def escaped(text: Column) -> Column:
    """Text as it stands in XML."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def _number(value: Column) -> Column:
    return F.format_string("%.6f", value)


def tile_matrix_xml(lod: Column, denominator: Column, left: Column, top: Column, width: Column, height: Column, tile: int = 256) -> Column:
    """One matrix of a tile matrix set as XML."""
    corner = F.concat(_number(left), F.lit(" "), _number(top))
    parts = [_element("ows:Identifier", lod), _element("ScaleDenominator", _number(denominator)), _element("TopLeftCorner", corner), _element("TileWidth", str(tile)), _element("TileHeight", str(tile)), _element("MatrixWidth", width), _element("MatrixHeight", height)]
    return _element("TileMatrix", *parts)


def capabilities(sets: DataFrame, layers: DataFrame) -> DataFrame:
    """One XML document of layers (layer, set, lod, x0, y0, x1, y1, and extents xmin, ymin, xmax, ymax) with the limits of
    their levels, and of tile matrix sets (set, crs, lod, denominator, left, top, width, height). Layers and sets come in
    the order of their names, levels by number; a document holds what one server publishes."""
    ordered = lambda key, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), text.alias("t")))), lambda e: e["t"]), "")
    limit = _element("TileMatrixLimits", *[_element(n, F.col(c)) for n, c in (("TileMatrix", "lod"), ("MinTileRow", "y0"), ("MaxTileRow", "y1"), ("MinTileCol", "x0"), ("MaxTileCol", "x1"))])
    corners = [F.concat(_number(F.col(x)), F.lit(" "), _number(F.col(y))) for x, y in (("xmin", "ymin"), ("xmax", "ymax"))]
    each = layers.groupBy("layer", "set").agg(ordered("lod", limit).alias("limits"), *[f(c).alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])
    link = _element("TileMatrixSetLink", _element("TileMatrixSet", escaped(F.col("set"))), _element("TileMatrixSetLimits", F.col("limits")))
    box = _element("ows:BoundingBox", _element("ows:LowerCorner", corners[0]), _element("ows:UpperCorner", corners[1]))
    said = each.select("layer", "set", _element("Layer", _element("ows:Identifier", escaped(F.col("layer"))), box, link).alias("x")).agg(ordered("layer", F.col("x")).alias("layers"))
    matrix = tile_matrix_xml(F.col("lod"), F.col("denominator"), F.col("left"), F.col("top"), F.col("width"), F.col("height"))
    one = sets.groupBy("set", "crs").agg(ordered("lod", matrix).alias("m"))
    one = one.select("set", _element("TileMatrixSet", _element("ows:Identifier", escaped(F.col("set"))), _element("ows:SupportedCRS", F.col("crs")), F.col("m")).alias("x"))
    head = '<?xml version="1.0" encoding="UTF-8"?><Capabilities version="1.0.0" xmlns="http://www.opengis.net/wmts/1.0" xmlns:ows="http://www.opengis.net/ows/1.1">'
    whole = one.agg(ordered("set", F.col("x")).alias("sets")).join(F.broadcast(said), F.lit(True))
    return whole.select(F.concat(F.lit(head), _element("Contents", F.col("layers"), F.col("sets")), F.lit("</Capabilities>")).alias("xml"))


def matrix_roots(nodes: DataFrame, content: str | None) -> DataFrame:
    """Root level, tile range and extents of a tile matrix set over a frame's nodes (lod, x, y, srs, xmin, ymin, xmax,
    ymax): those in the system `content`, which must be there and all of one level; without it, the only node."""
    own = nodes.where(F.col("srs") == content) if content else nodes
    n, levels = F.count(F.lit(1)), (F.min("lod"), F.max("lod"))
    wrong = F.when(n == 0, f"no root node for {content}").when(F.lit(not content) & (n != 1), "the frame is not single-rooted").when(levels[0] != levels[1], "content roots are not at one level")
    ends = [f(c).alias(a) for c, f, a in (("x", F.min, "x0"), ("x", F.max, "x1"), ("y", F.min, "y0"), ("y", F.max, "y1"), ("xmin", F.min, "xmin"), ("ymin", F.min, "ymin"), ("xmax", F.max, "xmax"), ("ymax", F.max, "ymax"))]
    found = own.agg(levels[0].alias("lod"), *ends, wrong.alias("_wrong"))
    checked = F.when(F.col("_wrong").isNotNull(), F.raise_error(F.concat(F.lit("malformed extension: "), "_wrong")).cast("int")).otherwise(F.col("lod"))
    return found.withColumn("lod", checked).drop("_wrong")


#: Commands and how many arguments each takes.
COMMANDS = {"list-resources": {0}, "update-resources": {0}, "updated-since": {1, 4}, "supports-reference-frame": {1}, "has-resource": {3}, "is-resource-ready": {3}, "resource-url": {3}}


def keep_repeats(spark: SparkSession, size: int, column: str) -> None:
    """Lets Parquet writers of the session hold a value of so many bytes, and others of as many, in a column's dictionary, so
    that a file has it once however many rows repeat it. Past the limit (1 MB by default) each row has a copy of its own.
    They also stop to compare each such value of `column` with the least and the greatest so far, which a footer leaves out
    past 4 KB anyway. What the session says of these statistics already stays."""
    key, most, bounds = "parquet.dictionary.page.size", (1 << 31) - 1, f"parquet.column.statistics.enabled#{column}"
    if int(spark.conf.get(key, str(1 << 20))) < min(2 * size, most):
        spark.conf.set(key, min(2 * size, most))
    if size > 1 << 19 and spark.conf.get(bounds, None) is None:
        spark.conf.set(bounds, "false")


def answer(commands: DataFrame, resources: DataFrame, now: int) -> DataFrame:
    """(id, answer) of commands (id, command, args array<string>) over resources (rf, grp, resource, type, ready, updated:
    microseconds). A resource is named by its frame, group and id. Wrong numbers of arguments, what is no number and unknown
    commands are answered by errors; update-resources gives the time to ask updated-since about. Only commands that name a
    resource meet the resources; the others are dealt by id. Each listing is as long as the catalogue, which is measured at
    once for keep_repeats()."""
    n, command = F.size("args"), F.col("command")
    names = F.coalesce((n == 3) & command.isin("has-resource", "is-resource-ready", "resource-url") | (n == 4) & (command == "updated-since"), F.lit(False))
    first = F.when(command == "updated-since", 1).otherwise(0)
    arg = lambda i: F.get("args", first + i)
    asked = commands.where(names).withColumn("rf", arg(0)).withColumn("grp", arg(1)).withColumn("resource", arg(2))
    one = asked.join(resources.withColumn("_there", F.lit(True)), ["rf", "grp", "resource"], "left")
    name = F.concat_ws("/", "rf", "type", "grp", "resource")
    listed = F.array_join(F.sort_array(F.collect_list(name)), "\n")
    whole = resources.agg(listed.alias("_all"), F.max("updated").alias("_newest"), F.collect_set("rf").alias("_frames"))
    size = resources.agg(F.sum(F.octet_length(name) + 1).alias("n")).first().n
    keep_repeats(commands.sparkSession, size or 0, "answer")
    dealt = commands.where(~names).repartition(int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    there, at = F.col("_there").isNotNull(), F.get("args", F.lit(0)).try_cast("long")
    since = lambda c: F.coalesce(F.when(at.isNull(), "error: argument is not a number").otherwise((F.col(c) > at).cast("string")), F.lit("false"))
    of_one = {
        "updated-since": since("updated"), "has-resource": there.cast("string"), "is-resource-ready": (there & F.coalesce("ready", F.lit(False))).cast("string"),
        "resource-url": F.when(there, F.concat(F.lit("/"), name, F.lit("/"))).otherwise("error: no such resource"),
    }
    of_all = {
        "list-resources": F.col("_all"), "update-resources": F.lit(f"resource updater notified\n{now}"), "updated-since": since("_newest"),
        "supports-reference-frame": F.array_contains("_frames", F.get("args", F.lit(0))).cast("string"),
    }

    def answers(df: DataFrame, said: dict[str, Column]) -> DataFrame:
        out = F.concat(F.lit("error: unknown command "), "command")
        for c, counts in COMMANDS.items():
            few = F.lit(f"error: {c} expects {' or '.join(map(str, sorted(counts)))} arguments")
            out = F.when(command == c, F.when(n.isin(*counts), said[c]).otherwise(few) if c in said else few).otherwise(out)
        return df.select("id", out.alias("answer"))

    return answers(one, of_one).unionByName(answers(dealt.join(F.broadcast(whole), F.lit(True)), of_all))


#: Members of definitions by driver: name, type, default (None: an error where required, else absent).
DEFINITION_MEMBERS = {
    "tms-gdaldem": [("dataset", "string", None, True), ("processing", "string", None, True), ("processingOptions", "array<string>", "[]", False), ("poProgressions", "map<string,array<double>>", "{}", False), ("colorFile", "string", None, False), ("format", "string", '"jpg"', False), ("resampling", "string", '"cubic"', False), ("erodeMask", "boolean", "false", False)],
    "geodata-vector": [("dataset", "string", None, True), ("demDataset", "string", None, True), ("layers", "array<string>", "[]", False), ("clipLayers", "array<string>", None, False), ("mode", "string", '"auto"', False), ("displaySize", "int", "256", False)],
}


def parse_definition(text: Column, driver: str) -> Column:
    """A struct of a driver's members from JSON text: defaults where they are absent; an error where a required one is."""
    members = DEFINITION_MEMBERS[driver]
    parsed = F.from_json(text, ", ".join(f"{n} {k}" for n, k, _, _ in members))

    def member(name: str, kind: str, default: str | None, required: bool) -> Column:
        value = parsed[name]
        if required:
            return F.when(value.isNull(), F.raise_error(F.lit(f"{driver}: no {name}")).cast(kind)).otherwise(value)
        if default is None:
            return value
        return F.coalesce(value, F.from_json(F.lit(f'{{"v":{default}}}'), f"v {kind}")["v"])

    return F.struct(*[member(*m).alias(m[0]) for m in members])


def build_definition(definition: Column) -> Column:
    """JSON text of parse_definition()'s struct; absent members and empty lists and maps are left out."""
    text = F.to_json(definition)
    return F.regexp_replace(F.regexp_replace(text, r'"\w+":(?:\[\]|\{\}),', ""), r',"\w+":(?:\[\]|\{\})', "")


def definition_json(group: Column, ident: Column, kind: Column, driver: Column, rev: Column, template: bool = False) -> Column:
    """A definition as it is read; a template has the group TEMPLATE."""
    g = F.lit("TEMPLATE") if template else group
    return F.to_json(F.struct(g.alias("group"), ident.alias("id"), kind.alias("type"), driver.alias("driver"), rev.alias("revision")))


def with_aliases(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Records (rf, id, dataset) and the alias records (rf, alias, id) of those that are there."""
    found = aliases.join(records, ["rf", "id"]).select("rf", F.col("alias").alias("id"), "dataset")
    return records.select("rf", "id", "dataset").unionByName(found)
