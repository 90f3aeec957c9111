"""MinHash near-duplicates with sequential Bayesian verification.

Texts with the same word sequence are one class. Classes that share a band of their MinHash signatures are
candidates; signature batches prune them by the posterior chance of being similar enough, and survivors are compared
on their full shingle sets. Only what decides the components is compared: pairs within a component are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SOLID, Words, blocks, mix, small_batches, stash

#: 25 bands of 5: a pair at 0.85 shares none with a chance of 4e-7, one at 0.80 with one of 5e-5.
BANDS, ROWS = 25, 5
_N = BANDS * ROWS
_SEED = np.random.default_rng(20240607)
_XOR = _SEED.integers(0, 1 << 32, _N, dtype=np.uint32)
_MUL = _SEED.integers(0, 1 << 31, _N, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Values of a signature in each second key of a bucket that is too wide.
SECOND = 4
_SALT = _SEED.integers(1, 1 << 62, BANDS, dtype=np.uint64)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-word shingles (a shorter text is one shingle), and each text's first place among them."""
    _, h, own = w.windows(k)
    who, whole = w.wholes(k)
    if len(who):
        own = np.concatenate([own, who])
        order = np.argsort(own, kind="stable")
        h, own = np.concatenate([h, whole])[order], own[order]
    return h, np.searchsorted(own, np.arange(len(w.base)))


def digests(w: Words) -> list[bytes | None]:
    """MD5 of each text's words by one space; None for texts without words."""
    return [hashlib.md5(x).digest() if x else None for x in w.normal()]


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash signatures (one row per text with shingles; all ones where there are none)."""
    out = np.full((len(first) - 1, _N), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        x = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        for j in range(_N):
            v = (x ^ _XOR[j]) * _MUL[j]
            v ^= v >> np.uint32(15)
            out[full, j] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), first[full])
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """64-bit bucket of each band (n x BANDS); a bucket holds its band's number."""
    out = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS].astype(np.uint64) + _SALT)
    return out.view(np.int64)


def least_matches(percent: int, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): below it the posterior chance of a similarity of percent / 100
    or more, from a flat prior, is under `miss`."""
    t = percent / 100
    out = []
    for n in range(ROWS * 5, _N + 1, ROWS * 5):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return out


def _features(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, bands = [], [], []
            for _, part in blocks(b.column(text_at).to_pylist()):
                w = Words(part, SOLID)
                h, first = shingles(w)
                n += [len(np.unique(h[a:z])) for a, z in zip(first[:-1], first[1:], strict=True)]
                digest += digests(w)
                bands += list(band_hashes(signatures(h, first)))
            bands = pa.array([x.tolist() if d else None for x, d in zip(bands, digest, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != text_at), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), bands], ["doc_id", "key", "n_shingles", "digest", "bands"])

    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest, text) to (node, sig, text), for texts that have the digest."""
    for b in batches:
        node, digest, texts = (b.column(i).to_pylist() for i in range(3))
        at, sig = [], []
        for first, part in blocks(texts):
            w = Words(part, SOLID)
            found = signatures(*shingles(w))
            for i, d in enumerate(digests(w)):
                if d == digest[first + i]:
                    at.append(first + i)
                    sig.append(found[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in at], pa.int64()), pa.array(sig, pa.binary()), pa.array([texts[i] for i in at], pa.binary())], ["node", "sig", "text"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal first `keys` columns (rows come sorted by them); sig as a matrix."""
    held: list[np.ndarray] | None = None

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        read = {"sig": lambda c: np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint32).reshape(-1, _N), "text": lambda c: np.array([*c.to_pylist(), None], dtype=object)[:-1]}
        return [read.get(name, pa.Array.to_numpy)(c) for name, c in zip(b.schema.names, b.columns, strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        cols = columns(b)
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        new = reduce(np.logical_or, (np.diff(c) != 0 for c in cols[:keys]))
        cut = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            yield [c[a:z] for c in cols]
        held = [c[cut[-1] :] for c in cols]
    if held is not None:
        yield held


def _alive(sig: np.ndarray, i: int, others: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of `others` that may be similar enough to i, batch by batch, and their matches."""
    matches, at = np.zeros(len(others), dtype=np.int64), 0
    for n, least in steps:
        if not len(others):
            break
        matches = matches + (sig[others, at:n] == sig[i, at:n]).sum(1)
        stays = matches >= least
        others, matches, at = others[stays], matches[stays], n
    return others, matches


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(percent: int, steps: list[tuple[int, int]]):
    """Rows (bucket, block, node, sig): the likeliest pairs that join each group, a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, node, sig in _groups(batches, 2):
            pairs = []
            for i in range(len(node) - 1):
                o, m = _alive(sig, i, np.arange(i + 1, len(node)), steps)
                o, m = o[m * 100 >= percent * _N], m[m * 100 >= percent * _N]
                pairs += [(-int(y), i, int(x)) for x, y in zip(o, m, strict=True)]
            parent, out = list(range(len(node))), []
            for _, i, j in sorted(pairs):
                if (x := _find(parent, i)) != (y := _find(parent, j)):
                    parent[x] = y
                    out.append((i, j))
            if out:
                a, b = node[[i for i, _ in out]], node[[j for _, j in out]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    return run


def _second_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node, label, sig) to (bucket, node, label) under the second keys of a bucket: each SECOND values of the
    signature outside the bucket's own band."""
    for b in batches:
        bucket, node, label = (b.column(i).to_numpy() for i in range(3))
        sig = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint32).reshape(-1, _N)
        band = (band_hashes(sig) == bucket[:, None]).argmax(1)
        out = []
        for j in range((_N - ROWS) // SECOND):
            h = mix(bucket.view(np.uint64) + np.uint64(j + 1))
            for k in range(j * SECOND, (j + 1) * SECOND):
                # the columns after the band's own follow those before it
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[np.arange(len(sig)), k + ROWS * (k >= band * ROWS)])
            out.append(h.view(np.int64))
        for h in out:
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node), pa.array(label)], ["bucket", "node", "label"])


def _across(steps: list[tuple[int, int]]):
    """Rows (bucket, low block, high block, block, node, label, sig) to (bucket, low, high, node): those with a pair of
    another component that may be similar enough, a pair counting in the first band that its two share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, low, high, block, node, label, sig in _groups(batches, 3):
            seen = np.zeros(len(node), dtype=bool)
            for i, o, _ in _crossing(bucket[0], low[0] == high[0], block == low[0], label, sig, steps):
                seen[i] = True
                seen[o] = True
            if seen.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in (bucket, low, high, node)], ["bucket", "low", "high", "node"])

    return run


def _crossing(bucket: int, one: bool, left: np.ndarray, label: np.ndarray, sig: np.ndarray, steps: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, matches) of the pairs of different labels: within one block, or of the left with the right block. In the
    bucket of a band, only those that share no earlier band; under a second key, all."""
    bands = band_hashes(sig)
    mine = (bands[0] == bucket).argmax() if (bands[0] == bucket).any() else -1
    for i in range(len(label)) if one else np.flatnonzero(left):
        o = np.arange(i + 1, len(label)) if one else np.flatnonzero(~left)
        o = o[label[o] != label[i]]
        if len(o):
            if mine >= 0:
                o = o[(bands[o] == bands[i]).argmax(1) == mine]
            o, m = _alive(sig, i, o, steps)
            if len(o):
                yield int(i), o, m


def _linked(percent: int, steps: list[tuple[int, int]]):
    """Rows as of _across() with text to the links (u, v) that join different components, verified on full sets. The
    likeliest come first, and what a found link has joined is not compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, low, high, block, node, label, sig, text in _groups(batches, 3):
            names, at = np.unique(label, return_inverse=True)
            parent, sets, us, vs = list(range(len(names))), {}, [], []

            def full(i: int, text=text, sets=sets) -> np.ndarray:
                if i not in sets:
                    sets[i] = np.unique(shingles(Words([text[i]], SOLID))[0])
                return sets[i]

            for i, o, m in _crossing(bucket[0], low[0] == high[0], block == low[0], label, sig, steps):
                for j in o[np.argsort(-m, kind="stable")].tolist():
                    if (x := _find(parent, at[i])) != (y := _find(parent, at[j])) and _similar(full(i), full(j), percent):
                        parent[x] = y
                        us.append(node[i])
                        vs.append(node[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(us, vs)), pa.array(np.maximum(us, vs))], ["u", "v"])

    return run


def _verified(percent: int):
    """Rows (u, v, text of u, text of v) to the pairs with 100 * common >= percent * united shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for first, part in blocks([x for p in zip(ta, tb, strict=True) for x in p]):
                h, at = shingles(Words(part, SOLID))
                sets = [np.unique(h[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
                # a block can start with the second of a pair: its first is then done again below
                for i in range(first % 2, len(part) - 1, 2):
                    keep.append(((first + i) // 2, _similar(sets[i], sets[i + 1], percent)))
                if first % 2:
                    i = first // 2
                    h, at = shingles(Words([ta[i]], SOLID))
                    keep.append((i, _similar(np.unique(h), sets[0], percent)))
            ok = pa.array(sorted(i for i, yes in keep if yes), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok)], ["u", "v"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (u, v) reaches, itself included.

    Alternates large and small stars until the links are stars around the smallest nodes, which takes a number of
    rounds that grows with the logarithm of the links; each round is written to the shared folder.
    """
    edges = stash(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        # as many tasks and files as the links are worth, however many partitions the session has
        tasks = max(1, state[0] // 250_000)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.unionByName(least.withColumnRenamed("m", "v")).distinct().coalesce(tasks), "links")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mixed(named: DataFrame, block: int) -> DataFrame:
    """(bucket, node, label, block, others, few) of the buckets with nodes of several labels. The nodes of a bucket's
    commonest label need no comparing with each other: they get blocks of their own, which meet only the blocks of the
    rest. others: the blocks that a block is compared with; few: those of the rest, as often is such a node copied."""
    # the commonest by count, then by label, in one number, which a hash aggregation can hold
    rank = F.col("m").cast("decimal(38,0)") * F.lit(Decimal(10**19)) + F.col("label")
    sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m")).withColumn("rank", rank.cast("decimal(38,0)"))
    sizes = sizes.groupBy("bucket").agg(F.max("rank").alias("rank"), F.max("m").alias("m"), F.sum("m").alias("n")).where("n > m")
    most = (F.col("rank") % F.lit(Decimal(10**19))).cast("long")
    sizes = sizes.select("bucket", most.alias("most"), F.ceil(F.col("m") / block).alias("lots"), F.ceil((F.col("n") - F.col("m")) / block).alias("few"))
    mine, spot = F.col("label") == F.col("most"), F.xxhash64("node")
    mixed = named.join(sizes, "bucket").withColumn("block", F.when(mine, F.col("few") + F.pmod(spot, F.col("lots"))).otherwise(F.pmod(spot, F.col("few"))))
    return mixed.select("bucket", "node", "label", "block", F.when(mine, F.col("few")).otherwise(F.col("few") + F.col("lots")).alias("others"), "few")


def classify(docs: DataFrame, percent: int = 80, miss: float = 1e-6, block: int = 256, copies: int = 16, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, component_id and grp (the component; null without words) of every row of docs.

    key hashes doc_id and text and finds the row again. Links join texts with 100 * common >= percent * united
    five-word shingles. Null, empty or wordless text: no shingles, linked with nothing. Rows with null doc_id take
    part; component_id is the smallest doc_id that is not null. Repeated rows: same text, same component, and one of
    them is compared. Very long texts are read whole. Sets are of 64-bit hashes: two shingles of a pair are taken for one
    with a chance of about the square of their number over 2^65. Other columns play no part. Empty table: no rows.

    Buckets of candidates are cut into blocks and compared block against block, so no bucket is too large for a task and
    none is capped. A bucket whose nodes would be copied to more than `copies` blocks is dealt again by second keys, so
    that the copies grow with its nodes alone: a pair at 0.80 that shares its band shares no second key with a chance
    of 1.4e-7. What is too large even there is compared in blocks.
    """
    small_batches(docs.sparkSession)
    steps = least_matches(percent, miss)
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(doc), F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"))
    feats = stash(rows.mapInArrow(_features(2), f"doc_id {kind}, key long, n_shingles long, digest binary, bands array<long>"), "features")
    full = feats.where("digest IS NOT NULL")
    rep = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("rep")
    classes = full.groupBy("digest").agg(rep, F.first("bands").alias("bands")).select("digest", F.col("rep.doc_id").alias("doc_id"), F.col("rep.key").alias("key"), "bands")
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stash(banded.join(shared, "bucket"), "members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", "key")
    found = rows.select("key", "text").join(wanted, "key").select("node", "digest", "text")
    texts = stash(found.mapInArrow(_signed, "node long, sig binary, text binary"), "candidates")
    if texts.groupBy("node").count().where("count > 1").limit(1).count():
        # rows that repeat the representative's doc_id and text
        texts = stash(texts.dropDuplicates(["node"]), "candidates")
    sigs = texts.select("node", "sig")

    def similar(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
        b = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
        both = pairs.distinct().join(a, "u").join(b, "v").select("u", "v", "a", "b")
        return stash(both.mapInArrow(_verified(percent), "u long, v long"), "similar")

    dealt = members.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    near = dealt.join(sigs, "node").select("bucket", "block", "node", "sig")
    near = near.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    links = similar(near.mapInArrow(_forest(percent, steps), "u long, v long"))
    labels = stash(components(links), "labels")

    # what is left: buckets whose members are of different components
    named = dealt.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = stash(_mixed(named.select("bucket", "node", "label"), block), "mixed")
    wide = mixed.where(F.col("few") > copies)
    if wide.limit(1).count():
        wide = wide.join(sigs, "node").select("bucket", "node", "label", "sig")
        under = stash(wide.mapInArrow(_second_keys, "bucket long, node long, label long"), "second")
        mixed = stash(mixed.where(F.col("few") <= copies).unionByName(_mixed(under, block)), "mixed")
    far = mixed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    far = far.join(sigs, "node").select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "sig")
    keys = ["bucket", "low", "high"]
    far = far.repartition(*keys).sortWithinPartitions(*keys)
    wanted = stash(far.mapInArrow(_across(steps), "bucket long, low long, high long, node long"), "wanted")
    wanted = wanted.join(mixed.select("bucket", "node", "block", "label"), ["bucket", "node"]).join(texts, "node").select(*keys, "block", "node", "label", "sig", "text")
    more = stash(wanted.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(percent, steps), "u long, v long"), "similar")
    labels = stash(components(links.unionByName(more)), "labels")

    grouped = classes.select("digest", "node", "doc_id").join(labels, "node", "left").withColumn("grp", F.coalesce("label", "node"))
    smallest = grouped.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(smallest, "grp").select("digest", "grp", "component_id")
    out = full.select("doc_id", "key", "n_shingles", "digest").join(named, "digest").drop("digest")
    bare = feats.where("digest IS NULL").select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("grp"), F.col("doc_id").alias("component_id"))
    return out.unionByName(bare)


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Wordless rows all stay; of repeated rows
    one stays; of components without any doc_id one row stays. Columns are those of docs, whatever their names. Very long
    texts and empty tables as in classify()."""
    marks = classify(docs, **how)
    doc, text = how.get("doc", "doc_id"), how.get("text", "text")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    best = marks.where("grp IS NOT NULL").groupBy("grp").agg(F.min(rank).alias("best"))
    kept = stash(best.select(F.col("best.key").alias("_key"), F.lit(False).alias("_bare")).unionByName(marks.where("grp IS NULL").select(F.col("key").alias("_key"), F.lit(True).alias("_bare")).distinct()), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(doc), F.col(text)).alias("_key")).join(kept, "_key")
    repeated = marks.where("grp IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(kept, F.col("key") == F.col("_key"), "left_semi").limit(1).count()
    if repeated:
        rows = rows.where("_bare").unionByName(rows.where("NOT _bare").dropDuplicates(["_key"]))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
    return marks.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words
  UNION
  SELECT r.a, e.v FROM reach r JOIN both_ways e ON e.u = r.b),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, w.doc_id = l.component_id AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) JOIN least_ l USING (doc_id)
"""
