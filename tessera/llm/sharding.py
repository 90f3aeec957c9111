"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Only DataFrame functions run on the executors. The driver holds a row for each shard, for each group of texts that
weighs more than a set part of a shard, and, while it looks for cuts, histograms of a fixed number of bins in all.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

DIMS = ["d_order", "d_size", "d_source", "d_lang"]
#: Bins of a histogram, and of all histograms of a level; bits of a dimension that a cut is found to.
_BINS, _ALL_BINS, _BITS = 1024, 1 << 20, 40
#: Rows of a table that is broadcast; larger ones are joined by a shuffle.
_SMALL = 500_000
#: (digest, weight of a row, rows) and what goes where: (digest, number of the first row, one past the last, shard).
Group = tuple[bytes, int, int]
Part = tuple[bytes, int, int, int]


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of rows, as a literal of the plan: no Python on the executors. Binary values are bytes."""
    fields = [f.split() for f in schema.split(", ")]
    text = json.dumps([{n: v.hex() if isinstance(v, bytes) else v for (n, _), v in zip(fields, r, strict=True)} for r in rows])
    kinds = ", ".join(f"{n}: {'string' if k == 'binary' else k}" for n, k in fields)
    df = spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{kinds}>>")).alias("r"))
    df = df.select(*[(F.unhex(f"r.{n}") if k == "binary" else F.col(f"r.{n}")).alias(n) for n, k in fields])
    return F.broadcast(df) if len(rows) <= _SMALL else df


def reserve(groups: list[Group], total: int, shards: int) -> tuple[list[Part], list[float]]:
    """Places heavy groups in shards of total / shards each, heaviest first: whole in the fullest shard that has room;
    else in as few parts as fill the emptiest shards. Returns the parts, and what each shard can take beside them so
    that all are equally heavy (0 for those that are heavier already)."""
    share = total / shards
    room = [(share, i) for i in range(shards)]
    used, parts = [0.0] * shards, []
    for digest, size, n in sorted(groups, key=lambda g: (-g[1] * g[2], g[0])):
        first = 0
        while first < n:
            at = bisect_left(room, (float(size * (n - first)), -1))
            whole = at < len(room)
            free, i = room.pop(at if whole else -1)
            rows = n - first if whole else min(n - first, max(1, int(free / size)))
            parts.append((digest, first, first + rows, i))
            used[i] += rows * size
            insort(room, (free - rows * size, i))
            first += rows
    light = total - sum(used)
    # the level to which the rest fills all shards that are below it
    level, low, held = 0.0, sorted(used), 0.0
    for k in range(1, shards + 1):
        held += low[k - 1]
        level = (light + held) / k
        if k < shards and level <= low[k]:
            break
    return parts, [max(0.0, level - u) for u in used]


def _cuts(at: DataFrame, open_: dict[int, list[tuple[int, float]]], box: dict, axes: dict[int, int]) -> dict[int, float]:
    """Where each open node is cut along its axis: the edge that leaves its share of the weight below, by histograms
    whose bin around the place is cut into bins again, all nodes of a level in one pass for each round."""
    spark = at.sparkSession
    name = {k: DIMS[axes[k] - 1] for k in open_}
    want = {k: float(box[k].w) * sum(t for _, t in x[: len(x) // 2]) / sum(t for _, t in x) for k, x in open_.items()}
    low = {k: float(box[k][f"min_{name[k]}"]) for k in open_}
    high = {k: float(box[k][f"max_{name[k]}"]) for k in open_}
    high = {k: v + max(1e-6, abs(v) * 1e-12) for k, v in high.items()}
    below, inside = dict.fromkeys(open_, 0.0), dict.fromkeys(open_, 0.0)
    bins = max(16, min(_BINS, _ALL_BINS // len(open_)))
    for _ in range(ceil(_BITS / log2(bins))):
        width = {k: (high[k] - low[k]) / bins for k in open_}
        table = _table(spark, [(k, axes[k], low[k], high[k], width[k]) for k in open_], "k int, axis int, low double, high double, width double")
        rows = at.join(table, "k").withColumn("x", F.element_at(F.array(*DIMS), F.col("axis"))).where("x >= low AND x < high")
        bin_ = F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")).cast("int"), F.lit(bins - 1))
        found: dict[int, list[tuple[int, float]]] = {k: [] for k in open_}
        for r in rows.groupBy("k", bin_.alias("bin")).agg(F.sum("weight").alias("w")).collect():
            found[r.k].append((r.bin, float(r.w)))
        for k in open_:
            spot = 0
            for spot, w in sorted(found[k]):
                inside[k] = w
                if below[k] + w >= want[k]:
                    break
                below[k] += w
            low[k], high[k] = low[k] + spot * width[k], low[k] + (spot + 1) * width[k]
    return {k: high[k] if want[k] - below[k] > inside[k] / 2 else low[k] for k in open_}


def kd_tree(units: DataFrame, leaves: list[tuple[int, float]]) -> DataFrame:
    """units (DIMS double, weight) with `shard`: the leaf of the tree that each falls in.

    leaves: (shard, target weight), targets above zero. Each node is cut along the dimension that is widest there,
    measured against the whole table, at the weighted quantile that gives either half of its leaves their targets (the
    median where these are even). A level takes one pass for the boxes and a few for the cuts; nodes are a column, and a
    level's cuts a table that is joined to it, so that trees of many leaves are as plain as small ones."""
    spark = units.sparkSession
    at = units.withColumn("k", F.lit(0))
    open_, whole, made, level = {0: leaves}, None, 1, 0
    shard_of: dict[int, int] = {}
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in DIMS for f in (F.min, F.max)]
    while open_:
        shard_of |= {k: x[0][0] for k, x in open_.items() if len(x) == 1}
        open_ = {k: x for k, x in open_.items() if len(x) > 1}
        if not open_:
            break
        if level and level % 4 == 0:
            at = stash(at, "level")
        held = _table(spark, [(k,) for k in open_], "k int")
        box = {r.k: r for r in at.join(held, "k").groupBy("k").agg(F.sum("weight").alias("w"), *ends).collect()}
        whole = whole or {c: max(box[0][f"max_{c}"] - box[0][f"min_{c}"], 1e-9) if box else 1.0 for c in DIMS}
        wide = lambda k: [(box[k][f"max_{c}"] - box[k][f"min_{c}"]) / whole[c] for c in DIMS]  # noqa: E731, B023
        axes = {k: 1 + (w := wide(k)).index(max(w)) for k in box}
        cuts = _cuts(at, {k: open_[k] for k in box}, box, axes) if box else {}
        steps, after = [], {}
        for k in cuts:
            x, left, right = open_[k], made, made + 1
            made += 2
            after[left], after[right] = x[: len(x) // 2], x[len(x) // 2 :]
            steps.append((k, axes[k], cuts[k], left, right))
        table = _table(spark, steps, "k int, axis int, cut double, l int, r int")
        side = F.when(F.element_at(F.array(*DIMS), F.col("axis")) < F.col("cut"), F.col("l")).otherwise(F.col("r"))
        at = at.join(table, "k", "left").withColumn("k", F.when(F.col("axis").isNull(), F.col("k")).otherwise(side)).select(*units.columns, "k")
        open_, level = after, level + 1
    named = _table(spark, list(shard_of.items()) or [(0, 0)], "k int, shard int")
    return at.join(named, "k").drop("k")


def numbered(rows: DataFrame, key: str, name: str, deals: int) -> DataFrame:
    """rows with the long `name`: a number from 0 within key, by doc_id and row inside each of `deals` dealt parts, whose
    counts say where they start; so a key takes many tasks. rows must be a written table with a unique `row`."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("row"), F.lit(deals)).cast("int"))
    before = dealt.groupBy(key, "_deal").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(key, "_deal", (F.sum("_n").over(Window.partitionBy(key).orderBy("_deal")) - F.col("_n")).alias("_before"))
    spot = F.row_number().over(Window.partitionBy(key, "_deal").orderBy("doc_id", "row")) - 1
    return dealt.withColumn(name, spot.cast("long")).join(before, [key, "_deal"]).withColumn(name, F.col(name) + F.col("_before")).drop("_deal", "_before")


def _dealt(rows: DataFrame, parts: list[Part], deals: int) -> DataFrame:
    """The rows of heavy groups with the shard of their part, by their numbers within the group."""
    spark = rows.sparkSession
    count: dict[bytes, int] = {}
    many: dict[bytes, int] = {}
    for digest, _, until, _ in parts:
        count[digest], many[digest] = max(count.get(digest, 0), until), many.get(digest, 0) + 1
    # cells as wide as a part is on average: a number is looked for in the parts that meet its cell
    width = {d: -(-n // many[d]) for d, n in count.items()}
    cells = [(d, c, a, z, i) for d, a, z, i in parts for c in range(a // width[d], (z - 1) // width[d] + 1)]
    table = _table(spark, cells, "digest binary, cell long, first long, until long, shard int")
    one = numbered(rows.join(_table(spark, list(width.items()), "digest binary, width long"), "digest"), "digest", "number", deals)
    one = one.withColumn("cell", F.expr("number div width"))
    return one.join(table, ["digest", "cell"]).where("number >= first AND number < until")


def shard(docs: DataFrame, shards: int = 40, part: int = 8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) of every row of docs.

    size is the UTF-8 length of the text (null: 0) plus 16. Rows of equal texts are one unit, placed by its smallest
    doc_id, source and language, and stay together. Those that weigh more than a `part`-th of a shard (at most part *
    shards groups) are placed first, whole where a shard has room for them, and else in as few parts as fill shards;
    the k-d tree then divides all others by what the shards can still take, so that shards are equally heavy. Only a
    group without room in any one shard is parted, and only a row heavier than a shard makes one heavier than the rest.

    Dimensions are whole numbers to which the unit's hash adds a fraction: places differ between units and ties are cut
    evenly. slot numbers the rows of a shard from 0, by salted counts, so that numbering a shard takes many tasks. Null
    doc_id, source or lang have places of their own; missing source or lang columns count as null; repeated rows are
    placed each; other columns play no part, whatever their names; very long texts are hashed whole; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    get = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc).alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.md5(data)).alias("digest"), get("source").alias("source"), get("lang").alias("lang"))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    units = rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.min("doc_id").alias("d"), F.min("source").alias("s"), F.min("lang").alias("l"), F.min("size").alias("z"), F.count(F.lit(1)).alias("n"))
    units = stash(units, "groups")
    heavy = [(bytes(r.digest), r.z, r.n) for r in units.where(F.col("weight") * shards * part > total).select("digest", "z", "n").collect()]
    parts, targets = reserve(heavy, total, shards)
    tie = F.shiftrightunsigned(F.xxhash64("digest"), 24) / float(1 << 40)
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 20))
    order = F.coalesce(F.col("d").cast("double"), F.lit(-1.0)) if docs.schema[doc].dataType.typeName() in ("long", "integer", "short", "byte") else spot("d").cast("double")
    light = units.where(F.col("weight") * shards * part <= total)
    light = light.select("digest", F.col("weight").cast("double").alias("weight"), (order + tie).alias("d_order"), (F.col("z") + tie).alias("d_size"), (spot("s") + tie).alias("d_source"), (spot("l") + tie).alias("d_lang"))
    leaves = [(i, t) for i, t in enumerate(targets) if t > 0]
    deals = max(16, -(-total // (256 << 20) // shards))
    columns = ["doc_id", "size", "text_crc32", "shard", "row"]
    plain = rows.select("doc_id", "size", "text_crc32", "digest", "row")
    rest = plain.join(_table(spark, [(d,) for d, _, _ in heavy], "digest binary"), "digest", "left_anti") if heavy else plain
    out = rest.join(kd_tree(light, leaves).select("digest", "shard"), "digest").select(columns)
    if heavy:
        out = out.unionByName(_dealt(plain, parts, max(16, sum(n for _, _, n in heavy) // 200_000)).select(columns))
    out = numbered(stash(out, "placed"), "shard", "slot", deals)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
