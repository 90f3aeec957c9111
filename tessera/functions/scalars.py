"""Scalar functions as Spark columns: tile arithmetic, sampling depths, heights, colours, paths and texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tms_y(lod: Column, y: Column) -> Column:
    """Row counted from the other edge."""
    return (F.pow(F.lit(2.0), lod).cast("long") - 1 - y).cast("int")


def below_root(lod: Column, x: Column, y: Column, root: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    """Ids relative to a root tile; tiles above the root are the root itself."""
    k = F.greatest(lod - root[0], F.lit(0))
    side = F.pow(F.lit(2.0), k).cast("int")
    return k, F.when(lod < root[0], 0).otherwise(x - root[1] * side), F.when(lod < root[0], 0).otherwise(y - root[2] * side)


def range_extents(lod: Column, x: Column, y: Column, box: tuple[float, float, float, float]) -> list[Column]:
    """World extents of a tile (xmin, ymin, xmax, ymax); rows grow downwards."""
    n = F.pow(F.lit(2.0), lod)
    w, h = (box[2] - box[0]) / n, (box[3] - box[1]) / n
    return [box[0] + x * w, box[3] - (y + 1) * h, box[0] + (x + 1) * w, box[3] - y * h]


def depth(area: Column, gsd: float, scale: Column, tile: int = 256) -> Column:
    """Levels below a node until a pixel is as fine as the data: ceil of half the log2 of the pixel count's share.
    Negative: null (not tiled)."""
    d = F.ceil(0.5 * F.log2(area / (F.lit(float(tile * tile * gsd * gsd)) * scale))).cast("int")
    return F.when(d >= 0, d)


def floor_depth(constant: float, log_scale: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(constant - 0.5 * log_scale).cast("int"))


def min_lod(lod: Column, node_area: Column, data_area: Column) -> Column:
    """Lowest level at which the data fills a tile, between 0 and lod."""
    return F.least(lod, F.greatest(F.lit(0), F.floor(0.5 * F.log2(node_area / data_area)).cast("int")))


def x_overlap(width: Column, period: float, pixel: float) -> Column:
    """Columns beyond one period; null where there are none."""
    n = F.round(width - period / pixel).cast("int")
    return F.when(n > 0, n)


def true_scale(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Root of the area of a source pixel in destination pixels; 1 where it can't be told."""
    s = F.sqrt(F.abs(dx1 * dy2 - dx2 * dy1))
    return F.when(s.isNull() | F.isnan(s) | (s == 0), 1.0).otherwise(s)


def superelevation(h: Column, h0: float, h1: float, s0: float, s1: float) -> Column:
    """Heights scaled by a factor that runs from s0 at h0 to s1 at h1; beyond them the end's height is kept."""
    if h0 >= h1:
        raise ValueError("h0 must be below h1")
    at = F.least(F.greatest(h, F.lit(h0)), F.lit(h1))
    return at * ((at - h0) * ((s1 - s0) / (h1 - h0)) + s0)


def progression(value: Column, factor: Column, base_lod: int, lod: Column) -> Column:
    return value * F.pow(factor, base_lod - lod)


def meta_flags(flags: Column) -> Column:
    """Metatile bits of index flags: geometry 1, navtile 2, watertight 16."""
    has = lambda bit, out: F.when(flags.bitwiseAND(bit) != 0, out).otherwise(0)
    return has(1, 1) + has(8, 2) + has(2, 16)


def texel_size(area: Column, relief: Column, edge: Column) -> Column:
    r = F.least(relief / edge, F.lit(2.0))
    return F.sqrt(area / 65536) * F.sqrt(1 + 0.5 * r * r)


def triangle_area(p: list[Column], q: list[Column], r: list[Column]) -> Column:
    a, b = ([u - v for u, v in zip(t, p, strict=True)] for t in (q, r))
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return 0.5 * F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])


def quad_area(z: list[Column], step: float = 1.0) -> Column:
    """Area of the quad over four corner heights (00, 01, 10, 11), by two triangles; a missing corner leaves the one
    triangle of the others, two missing leave none."""
    p = [[F.lit(0.0), F.lit(0.0)], [F.lit(step), F.lit(0.0)], [F.lit(0.0), F.lit(step)], [F.lit(step), F.lit(step)]]
    v = [[*xy, h] for xy, h in zip(p, z, strict=True)]
    tri = lambda a, b, c: F.coalesce(triangle_area(v[a], v[b], v[c]), F.lit(0.0))
    first = z[0].isNotNull() & z[3].isNotNull()
    return F.when(first, tri(0, 1, 3) + tri(0, 3, 2)).otherwise(tri(0, 1, 2) + tri(1, 3, 2))


def face_budget(ratio: Column, quotient: float = 2 / 3) -> Column:
    return F.round(1000 * F.least(F.greatest((F.pow(F.lit(quotient), ratio) - 1) / (quotient - 1), F.lit(0.0)), F.lit(3.0))).cast("int")


def sample_count(circumference: Column, requested: int) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(requested), F.round(12 * circumference / 4).cast("int")))


def mercator(lon: Column, lat: Column, radius: float = 6378137.0) -> tuple[Column, Column]:
    """Spherical Mercator metres of degrees."""
    return F.radians(lon) * radius, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * radius


def geocentric(lon: Column, lat: Column, h: Column, a: float = 6378137.0, f: float = 1 / 298.257223563) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of geographic ones."""
    e2 = f * (2 - f)
    n = a / F.sqrt(1 - e2 * F.sin(F.radians(lat)) * F.sin(F.radians(lat)))
    flat = (n + h) * F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), (n * (1 - e2) + h) * F.sin(F.radians(lat))


def patchwork(lod: Column, x: Column, y: Column) -> Column:
    return (1 + (F.call_function("shiftleft", y, lod) + x) % 254).cast("int")


def checker(px: Column, py: Column) -> Column:
    """Brightness of a pixel on an 8 x 8 board: 1 or 0.8."""
    return F.when((F.shiftright(px, 3) + F.shiftright(py, 3)) % 2 == 0, 1.0).otherwise(0.8)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def label_colour(brightness: Column) -> Column:
    """Black or white text, whichever stands out more."""
    return F.when(contrast(brightness, F.lit(0.0)) >= contrast(brightness, F.lit(1.0)), "black").otherwise("white")


def period_start(time: Column, base: int, period: int) -> Column:
    """Start of the period that a time (epoch seconds) is in; before the base the remainder is negative."""
    return time - (time - base) % period


def utc_path(time: Column, form: str = "yyyy/MM/dd/HH") -> Column:
    return F.date_format(F.timestamp_seconds(time), form)


def query_list(url: Column, key: str) -> Column:
    """The comma-separated, decoded values of a key of a query string; an unexpanded {key} is no value."""
    raw = F.element_at(F.str_to_map(url, F.lit("&"), F.lit("=")), key)
    items = F.transform(F.split(raw, ","), F.url_decode)
    return F.when(raw.isNull() | (raw == f"{{{key}}}"), F.array().cast("array<string>")).otherwise(items)


def relative_root(a: list[Column], b: list[Column]) -> Column:
    """Steps up from a resource's folder to what it shares with another: by the first component that differs."""
    n = len(a)
    out = F.lit("./")
    for i in reversed(range(n)):
        out = F.when(a[i] != b[i], F.repeat(F.lit("../"), n - i)).otherwise(out)
    return out


def path_prefix(parts: list[Column], n: int) -> Column:
    return F.concat_ws("/", *parts[:n])


#: Letters that stand by themselves, each before a dot or blank.
_RUN = "(?:[A-Za-z] ?[. ])+"


def contract_acronyms(text: Column) -> Column:
    """Runs of single letters, each before a dot or blank, become one word with a blank after it."""
    parts = F.regexp_extract_all(text, F.lit(f"{_RUN}|[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    joined = lambda p: F.when(F.regexp_like(p, F.lit(f"^{_RUN}$")), F.concat(F.translate(p, ". ", ""), F.lit(" "))).otherwise(p)
    return F.array_join(F.transform(parts, joined), "")


def drop_expansion(text: Column) -> Column:
    """Text without what stands in braces, and without the first word of what stands in brackets."""
    return F.regexp_replace(text, r"\{[^}]*(?:\}|\z)|\[[^ \t-\r\]]*([ \t-\r][^\]]*)?(?:\]|\z)", "$1")


_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýß"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncys"


def credit_id(text: Column) -> Column:
    """Attribution to an id: expansions dropped, Latin letters without accents, acronyms as one word, runs of others to
    one hyphen, auto- before. The whole text counts."""
    plain = contract_acronyms(F.translate(F.lower(drop_expansion(text)), _ACCENTED, _PLAIN))
    return F.concat(F.lit("auto-"), F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def resource_id(path: Column) -> tuple[Column, Column]:
    """(group, id) from a path: the parent folder's name and the file's stem."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def content_type(form: Column) -> Column:
    return F.when(form == "jpg", "image/jpeg").when(form == "png", "image/png").when(form == "webp", "image/webp")


def classify_path(path: Column) -> Column:
    """What a request path asks for, by its number of components."""
    p = F.filter(F.split(path, "/"), lambda c: c != "")
    n, slash = F.size(p), F.endswith(path, F.lit("/"))
    name = F.element_at(p, -1)
    return (
        F.when(n == 0, "frames").when((n <= 4) & ~slash, "redirect").when(n == 1, "types").when(n == 2, "groups").when(n == 3, "ids").when(n == 4, "resource")
        .when((n == 5) & F.regexp_like(name, F.lit(r"^\d+-\d+-\d+\.(jpg|png|webp)$")), "image").when((n == 5) & F.regexp_like(name, F.lit(r"^\d+-\d+-\d+\.(mask|meta|geo|terrain|bin|nav)$")), "tile")
        .when((n == 5) & name.isin("mapConfig.json", "boundlayer.json", "freelayer.json", "layer.json", "tileset.conf"), "config").otherwise("not found")
    )


def tile_of(name: Column) -> list[Column]:
    """lod, x, y, extension of a file named lod-x-y.extension; nulls for others."""
    form = r"^(\d+)-(\d+)-(\d+)\.([a-z]+)$"
    return [F.nullif(F.regexp_extract(name, form, i), F.lit("")).cast(t) for i, t in ((1, "int"), (2, "int"), (3, "int"), (4, "string"))]


def quadkey(lod: Column, x: Column, y: Column) -> Column:
    """Digits 0 to 3 of the tile's path from the root; the root's is empty."""
    digit = lambda i: F.call_function("shiftright", x, lod - i).bitwiseAND(1) + 2 * F.call_function("shiftright", y, lod - i).bitwiseAND(1)
    steps = F.when(lod > 0, F.sequence(F.lit(1), lod)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(steps, lambda i: digit(i).cast("string")), "")


def skirt_height(width: Column) -> Column:
    return width * 0.01


def ini_values(text: Column) -> Column:
    """Map of the lines "key = value" of a configuration text."""
    return F.str_to_map(F.regexp_replace(F.trim(text), r"[ \t]*=[ \t]*", "="), F.lit("\n"), F.lit("="))


#: Fixed names of files by interface.
NAMED_FILES = {
    "surface": {"mapConfig.json": "config", "tileset.conf": "config", "debug.json": "config", "tileset.index": "index", "tileset.registry": "registry", "style.json": "style", "freelayer.json": "definition"},
    "geodata": {"mapConfig.json": "config", "freelayer.json": "definition", "style.json": "style", "geo": "geo"},
    "terrain": {"layer.json": "definition", "cesium.conf": "config"},
    "wmts": {"WMTSCapabilities.xml": "capabilities"},
}
#: Fixed extensions of tiles by interface.
TILE_FILES = {
    "surface": {"meta": "tile", "bin": "tile", "nav": "tile"},
    "geodata": {"geo": "geo", "meta": "metatile"},
    "terrain": {"terrain": "terrain"},
    "wmts": {"jpg": "image", "png": "image"},
}


def classify_name(interface: Column, name: Column, tiled: bool = True) -> Column:
    """What a file name asks for at an interface: a named file, a tile lod-x-y.extension, or "unknown". Geodata that is
    not tiled has one file and no tiles."""
    ext = F.regexp_extract(name, r"^\d+-\d+-\d+\.([a-z0-9]+)$", 1)
    out = F.lit("unknown")
    for kind, names in NAMED_FILES.items():
        tiles = {} if kind == "geodata" and not tiled else TILE_FILES[kind]
        if kind == "geodata" and tiled:
            names = {k: v for k, v in names.items() if k != "geo"}
        found = F.lit("unknown")
        for column, table in ((ext, tiles), (name, names)):
            for k, v in table.items():
                found = F.when(column == k, v).otherwise(found)
        out = F.when(interface == kind, found).otherwise(out)
    return out


def half_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """The narrowest pair of half-precision numbers around a range, kept within the largest finite one: a number has 11
    bits, and below 2^-14 the step of that."""
    held = [F.least(F.greatest(c, F.lit(-65504.0)), F.lit(65504.0)) for c in (lo, hi)]

    def step(c: Column) -> Column:
        size = F.abs(c)
        e = F.floor(F.log2(F.greatest(size, F.lit(1e-300))))
        # the logarithm may be rounded over a power of two
        e = e - F.when(F.pow(F.lit(2.0), e) > size, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), e + 1) <= size, 1).otherwise(0)
        return F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)

    return F.floor(held[0] / step(held[0])) * step(held[0]), F.ceil(held[1] / step(held[1])) * step(held[1])
