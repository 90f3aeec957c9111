"""The training-data operators against brute force, on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter, defaultdict
from math import log10
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontaminate, licences, lm, neardup, packing, quality, sharding, topk, urlfilter, warc

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300)
    out = [(i, edited(base, i, i % 7)) for i in range(40)]
    out += [(100 + i, prose(100 + i, 30 + i)) for i in range(20)]
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "ONE  two"), (205, "x " * 30000), (206, "é ß 漢字 " * 20), (None, base), (None, None), (7, edited(base, 7, 0)), (100, prose(100, 30))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).withColumn("score", F.lit("clash")).repartition(3).cache()


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_packing(spark, docs, rows):
    got = [r.asDict() for r in packing.pack(docs).collect()]
    encode = packing.encoder()
    want = Counter()
    for d, t in rows:
        ids = [*encode(t or "").tolist(), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[d, k, a, z - a, zlib.crc32(np.array(ids[a:z], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    # no packing has fewer: all tokens must fit, and no two pieces of over half a sequence share one
    assert len(by) <= max(-(-sum(r["length"] for r in got) // 1024), sum(r["length"] > 512 for r in got)) + 1


def test_tokenizer_gives_the_same_ids():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder()
    for t in ["", " ", "it's  1234\n\n x", "a<|endoftext|>b", "é漢字 🙂" * 9, "  lead", "tab\t\tend  ", prose(3, 200), "aaaa" * 500, "!?!?--" * 50, " " * 10**6, "a" * 10**6, "\n\t" * 10**6, prose(4, 300_000) + " <|endoftext|> it's " + prose(5, 100_000), ("x 1. y" * 60_000) + " " * 300_000 + "z"]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_packing_of_long_runs_and_repeats(spark):
    rows = [(1, " " * 10**6), (2, "a" * 10**6), (None, "again " * 40), (4, prose(1, 400_000))] + [(None, "again " * 40)] * 3000
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    encode = packing.encoder()
    assert Counter(r.doc_id for r in got) == Counter(d for d, t in rows for _ in range(-(-(len(encode(t)) + 1) // 1024)))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([length for _, length in sorted(places)])
        assert ends[-1] <= 1024 and [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()]
    n = len(encode("again " * 40)) + 1
    full = sum(r.length == 1024 for r in got)
    assert full > 2000 and len(by) <= full + -(-3001 // (1024 // n)) + 4


def test_local_search_keeps_every_piece_and_helps():
    r = random.Random(5)
    for _ in range(30):
        counts = Counter(r.randint(1, 100) for _ in range(r.randint(1, 200)))
        first = packing._first_runs(counts, 100)
        runs = packing.local_search(first, 100)
        assert Counter({x: sum(p.count(x) * m for p, m in runs) for x in counts}) == counts
        assert all(sum(p) <= 100 for p, _ in runs)
        assert sum(m for _, m in runs) <= sum(m for _, m in first)
    # pieces of a quarter to a half of a sequence are what best fit packs badly
    counts = Counter(r.randint(25, 52) for _ in range(30_000))
    first = packing._first_runs(counts, 100)
    assert sum(m for _, m in packing.local_search(first, 100)) < 0.99 * sum(m for _, m in first)
    bad = [((60,), 1), ((30,), 1), ((50, 40), 1), ((10,), 1)]
    assert sum(m for _, m in packing.local_search(bad, 100)) == 2


def words2(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def brute_decontaminate(rows, items, n=10):
    grams = defaultdict(set)
    for i, t in items:
        w = words2(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[a : a + n])].add(i)
    out = Counter()
    for d, t in rows:
        w, hit, who = words2(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in grams:
                    hit |= set(range(a, a + k))
                    who |= {str(x) for x in grams[tuple(w[a : a + k])] if x is not None}
        out[d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block", [32 << 20, 400])
def test_decontaminate(spark, docs, rows, block):
    w = rows[3][1].split()
    items = [(1, " ".join(w[20:35])), (2, "One, TWO"), (3, None), (4, "..."), (None, " ".join(w[30:42])), (10, "é ß 漢字 é ß 漢字 é ß 漢字 é"), (1, "x x x"), (5, " ".join(w[20:35]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=block)
    cols = ["doc_id", *decontaminate.NEW]
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == brute_decontaminate(rows, items)
    assert got.columns == ["doc_id", "text", "score", *decontaminate.NEW]
    cut = decontaminate.decontaminate(docs, bench, mode="spans", block_bytes=block)
    again = decontaminate.decontaminate(cut, bench).where("doc_id = 203 OR doc_id = 3")
    assert again.where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs, bench, mode="documents", block_bytes=block).count() == got.where("NOT contaminated").count()
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_benchmark_grams_with_colliding_hashes(monkeypatch):
    w = prose(2, 400).split()
    items = [(1, " ".join(w[20:45])), (2, "One, TWO"), (3, None), (4, "..."), (None, " ".join(w[30:42])), (5, "x x x"), (1, "x x x")] + [(i, " ".join(w[i : i + 12])) for i in range(50, 90)] + [(7, "two one")] * 50
    rows = [(1, " ".join(w)), (2, "one two one"), (3, None), (4, "... "), (5, "x x x x"), (6, prose(3, 50)), (7, " ".join(w[30:41]))]
    want = brute_decontaminate(rows, items)
    for patched in (False, True):
        if patched:
            monkeypatch.setattr(common, "mix", lambda h: h % np.uint64(97))
        grams = decontaminate.Grams([(None if i is None else str(i), None if t is None else t.encode()) for i, t in items], 10)
        assert bool(grams.odd) == patched
        marks = decontaminate._Marks(False)
        for text, words, o, spans, names in decontaminate._found(grams, [None if t is None else t.encode() for _, t in rows]):
            marks.add(text, words, o, decontaminate._spans(spans), names)
        got = Counter((d, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for (d, _), n, h, x in zip(rows, marks.words, marks.hits, marks.items, strict=True))
        assert got == want


def test_words_of_a_long_text_take_little_memory():
    text = (prose(6, 200_000) * 8).encode()
    tracemalloc.start()
    w = common.Words([text], common.SOLID)
    got = w.windows(5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got[0]) == len(text.split()) - 4 and peak < 14 * len(text) + (64 << 20)


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    texts = [t.encode() for t in ("", prose(1, 500), " a", "é漢字 " * 99, "b" * 1000)]
    a = common.Words(texts, common.ALNUM)
    want = a.hash, a.windows(3)[1], a.wholes(3)[1], a.start, list(a.normal())
    monkeypatch.setattr(common, "CHUNK", 64)
    monkeypatch.setattr(common, "_POWERS", {})
    b = common.Words(texts, common.ALNUM)
    for x, y in zip(want, (b.hash, b.windows(3)[1], b.wholes(3)[1], b.start, list(b.normal())), strict=True):
        assert list(x) == list(y)


def brute_components(rows, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sets, [least[find(i)] for i in range(len(rows))], [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("percent", "block", "copies"), [(85, 512, 16), (85, 4, 1000), (85, 4, 0), (80, 512, 16)])
def test_near_duplicates(spark, docs, rows, percent, block, copies):
    sets, least, groups = brute_components(rows, percent)
    got = neardup.classify(docs, percent, block=block, copies=copies).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((d, len(s), c) for (d, _), s, c in zip(rows, sets, least, strict=True))
    kept = neardup.near_dedup(docs, percent=percent, block=block, copies=copies)
    assert kept.columns == docs.columns
    n_groups = len({g for g, s in zip(groups, sets, strict=True) if s}) + sum(not s for s in sets)
    assert kept.count() == n_groups
    assert neardup.classify(docs.limit(0)).count() == 0


def test_near_duplicates_with_repeats_and_a_passage_of_many_texts(spark):
    passage = prose(1, 60)
    rows = [(i, f"{prose(1000 + i, 25)} {passage} {prose(5000 + i, 25)}") for i in range(1500)]
    rows += [(i, edited(rows[0][1], 1, 1)) for i in (5000, 5001)]
    df = spark.createDataFrame(rows + [(7000, prose(7, 200))] * 4000, "doc_id long, text string").repartition(4).withColumn("_key", F.lit(1))
    got = neardup.classify(df, 85, block=16, copies=4).select("doc_id", "n_shingles", "component_id").collect()
    least = {5000: 0, 5001: 0}
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, least.get(d, d)) for d, _ in rows) + Counter({(7000, 7000): 4000})
    kept = neardup.near_dedup(df, percent=85, block=16, copies=4)
    assert kept.count() == 1501 and kept.select("_key").distinct().collect()[0][0] == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}


def test_bayes_bounds():
    steps = neardup.least_matches(85, 1e-6)
    assert [n for n, _ in steps] == [25, 50, 75, 100, 125]
    assert all(0 < m < 0.85 * n for n, m in steps)


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    texts = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (3, mit + " more"), (4, None), (5, ""), (6, "licenced under the apache Licence -- version 2.0"), (6, "x" * 100000), (None, mit)]
    got = licences.scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("licence", F.lit(0)), licences.known_digests(spark))
    found = Counter((r.doc_id, r.licence) for r in got.collect())
    assert found == Counter([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "Apache-2.0"), (6, None), (None, "MIT")])
    assert Counter(map(tuple, licences.scan(spark.createDataFrame(texts, "doc_id long, text string"), licences.known_digests(spark), broadcast_rows=1).select("doc_id", "licence").collect())) == found
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string"), licences.known_digests(spark)).count() == 0


@pytest.mark.parametrize("bound", [200_000, 0])
def test_warc(spark, bound, tmp_path):
    pages = [(3, "http://a/", "same"), (1, "http://b/?q=1 2", "same"), (2, None, None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "u", "é" * 5000), (7, "u", "x" * 300000), (None, "u", "same"), (3, "http://a/", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, broadcast_rows=bound)
    got = warc.assemble(warc.read_records(spark, path, blocks=True)).collect()
    assert len(got) == len(pages)
    by = defaultdict(list)
    for r in got:
        by[r.response.digest].append(r)
        assert r.request is not None and r.metadata is not None
    import base64

    for html in {p[2] or "" for p in pages}:
        key = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        same = by.pop(key)
        assert len(same) == sum((p[2] or "") == html for p in pages)
        assert sum(r.response.kind == "response" for r in same) == 1
        main = next(r for r in same if r.response.kind == "response")
        assert bytes(main.response.block).partition(b"\r\n\r\n")[2] == html.encode()
        assert all(r.response.bytes == len(html.encode()) and r.response.refers_to == main.id for r in same if r is not main)
        ids = [p[0] for p in pages if (p[2] or "") == html and p[0] is not None]
        assert main.id.split(":")[3] == str(min(ids))
    assert not by
    assert warc.round_trip(df.limit(0)).count() == 0


def test_broken_warc_records():
    end = b"\r\n\r\n"
    head = lambda kind, more="": f"WARC/1.1\r\nWARC-Type: {kind}{more}\r\n\r\n".encode()
    data = head("metadata") + b"no length" + end + head("response", "\r\nContent-Length: 6") + b"ab" + end + end + head("request") + b"last" + end + b"WARC/1.1\r\ncut"
    assert [(f["warc-type"], b) for f, b in warc.parse(data)] == [("metadata", b"no length"), ("response", b"ab" + end), ("request", b"last")]
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"WARC/1.1\r\ncut")) == []


def test_url_filter(spark):
    urls = [
        (1, "http://www.Example.ORG/es/1?x", "www.example.org", "/es/1", "example.org/es/", "block"), (2, "https://example.org/en/12#y", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "ftp://b.org/", "b.org", "/", "org/", "allow"), (4, "x://org", "org", "", None, None), (5, "http://myorg/a", "myorg", "/a", None, None), (6, "http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        (7, "http://a.com/de/x://y", "a.com", "/de/x://y", "com/de/", "block"), (8, None, "", "", None, None), (9, "nothing", "", "", None, None), (10, "http://" + "a" * 5000 + "/" + "b" * 5000, "a" * 5000, "/" + "b" * 5000, None, None),
    ]
    df = spark.createDataFrame([u[:2] for u in urls] + [(1, urls[0][1])], "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    for i, _, host, path, rule, verdict in urls:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or verdict is None and got[i].verdict in ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_model_learns(spark):
    good = [(f"http://school{i}.edu/lesson/{i}", 1) for i in range(40)]
    bad = [(f"http://casino{i}.win/bet/{i}", 0) for i in range(40)]
    labelled = spark.createDataFrame(good[:30] + bad[:30], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(good[30:] + bad[30:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, [], labelled).collect()}
    assert got == {i: "allow" if i < 10 else "block" for i in range(20)}


def plain_url_model(urls, labels, n=4096, rounds=150, rate=2.0, decay=1e-3):
    """chance(url) of a logistic regression on hashed n-grams, in the same dual form, one row at a time."""

    def grams(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        out = set()
        for name, text in (("h", host), ("p", path)):
            chars = ["^", *text, "$"]
            for k in (3, 4):
                out |= {xxhash.xxh64("".join(chars[i : i + k]).encode(), xxhash.xxh64(name.encode(), 42).intdigest()).intdigest() % n for i in range(max(len(chars) - k, 0) + 1)}
        return out

    g = [grams(u) for u in urls]
    alpha = [0.0] * len(g)
    for _ in range(rounds):
        s = [sum(alpha[j] * (len(g[i] & g[j]) / (len(g[i]) * len(g[j])) ** 0.5 + 1) for j in range(len(g))) for i in range(len(g))]
        alpha = [a + rate * ((y - 1 / (1 + np.exp(-z))) / len(g) ** 0.5 - decay * a) for a, y, z in zip(alpha, labels, s, strict=True)]
    return lambda url: 1 / (1 + np.exp(-sum(a * (len((x := grams(url)) & h) / (len(x) * len(h)) ** 0.5 + 1) for a, h in zip(alpha, g, strict=True))))


def test_url_verdicts_against_a_plain_model(spark):
    known = [(f"http://school{i}.edu/lesson/{i * 7}", 1) for i in range(12)] + [(f"https://CASINO{i}.win/bet/{i}?x", 0) for i in range(12)]
    other = ["http://school99.edu/other", "http://casino77.win/", "http://a.b/ü", "", None, "no url", "http://lesson.win/bet", "http://casino.edu/lesson/1"]
    pages = spark.createDataFrame(list(enumerate(other)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(pages, [], spark.createDataFrame(known, "url string, label int")).collect()}
    plain = plain_url_model([u for u, _ in known], [y for _, y in known])
    for i, u in enumerate(other):
        assert abs(got[i].chance - plain(u)) < 1e-4
        assert got[i].verdict == ("allow" if plain(u) >= 0.5 else "block")
    few = urlfilter.judge(pages, [], spark.createDataFrame(known, "url string, label int"), max_rows=4)
    assert few.count() == len(other)


def test_sharding(spark, docs, rows):
    got = sharding.shard(docs, shards=5).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.createDataFrame([(i, prose(i, 40) if i % 3 else "copy " * 40) for i in range(600)], "doc_id long, text string")
    sizes = Counter()
    for r in sharding.shard(many, shards=7).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 7 and max(sizes.values()) < 1.1 * min(sizes.values())
    few = defaultdict(set)
    for r in sharding.shard(spark.createDataFrame([(i, f"text {i % 100} " * 5) for i in range(400)], "doc_id long, text string"), shards=4).collect():
        few[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in few.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_heavy_groups_stay_whole_where_a_shard_has_room():
    r = random.Random(8)
    for _ in range(200):
        shards = r.randint(1, 9)
        groups = [(bytes([i]), r.randint(1, 60), r.randint(1, 40)) for i in range(r.randint(0, 12))]
        total = sum(z * n for _, z, n in groups) + r.randint(0, 3000)
        parts, left = sharding.reserve(groups, total, shards)
        of, used = defaultdict(list), Counter()
        size = {d: z for d, z, _ in groups}
        for d, a, z, i in parts:
            of[d].append((a, z))
            used[i] += size[d] * (z - a)
        assert {d: n for d, _, n in groups} == {d: max(z for _, z in x) for d, x in of.items()}
        assert all([a for a, _ in sorted(x)] == [0, *[z for _, z in sorted(x)][:-1]] for x in of.values())
        share = total / shards
        whole = total - sum(z * n for _, z, n in groups)
        assert abs(sum(left) - whole) < 1e-6 * max(total, 1)
        assert all(used[i] <= share + 60 for i in range(shards))
        level = max((used[i] + t for i, t in enumerate(left) if t > 0), default=0)
        assert all(abs(used[i] + t - level) < 1e-6 * level if t > 0 else used[i] >= level - 1e-6 * total for i, t in enumerate(left))
    assert len(sharding.reserve([(b"a", 10, 9), (b"b", 10, 8)], 200, 2)[0]) == 2


def brute_tree(points, leaves, whole):
    """The shard of each (digest, weight, coordinates): cuts at the weighted quantile of the widest dimension."""
    if len(leaves) == 1:
        return {p[0]: leaves[0][0] for p in points}
    if not points:
        return {}
    dims = range(4)
    axis = max(dims, key=lambda c: (max(p[2][c] for p in points) - min(p[2][c] for p in points)) / whole[c])
    left, right = leaves[: len(leaves) // 2], leaves[len(leaves) // 2 :]
    want = sum(p[1] for p in points) * sum(t for _, t in left) / sum(t for _, t in leaves)
    points = sorted(points, key=lambda p: p[2][axis])
    below, n = 0.0, 0
    for p in points:
        if below + p[1] / 2 >= want:
            break
        below, n = below + p[1], n + 1
    return brute_tree(points[:n], left, whole) | brute_tree(points[n:], right, whole)


@pytest.mark.parametrize("bins", [1 << 20, 64])
def test_kd_tree_against_a_plain_one(spark, monkeypatch, bins):
    monkeypatch.setattr(sharding, "_ALL_BINS", bins)
    r = np.random.default_rng(2)
    points = [(i, float(r.integers(1, 50)), [float(x) for x in (r.normal() * 9, r.exponential() * 50, r.integers(3) + r.random(), r.random())]) for i in range(500)]
    whole = [max(p[2][c] for p in points) - min(p[2][c] for p in points) for c in range(4)]
    leaves = [(3, 10.0), (4, 2.0), (5, 10.0), (7, 10.0), (8, 5.0), (9, 10.0), (10, 10.0)]
    units = spark.createDataFrame([(i, w, *x) for i, w, x in points], "digest long, weight double, " + ", ".join(f"{c} double" for c in sharding.DIMS))
    assert {x.digest: x.shard for x in sharding.kd_tree(units, leaves).collect()} == brute_tree(points, leaves, whole)
    one = sharding.kd_tree(units, [(6, 1.0)]).select("shard").distinct().collect()
    assert [x.shard for x in one] == [6]


def test_sharding_with_a_text_that_holds_a_third_of_all(spark):
    rows = [(i, "copy " * 30 if i % 3 == 0 else f"half {i % 5} " * 20 if i % 3 == 1 and i < 600 else prose(i, 25)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(5), shards=9).collect()
    sizes, slots, of = Counter(), defaultdict(list), defaultdict(Counter)
    for x in got:
        sizes[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
        of[x.text_crc32][x.shard] += 1
    assert sorted(x.doc_id for x in got) == list(range(3000)) and set(sizes) == set(range(9))
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = "copy " * 30
    share = sum(sizes.values()) / 9
    for crc, shards in of.items():
        most = -(-1000 * (len(text) + 16) // share) + 1 if crc == zlib.crc32(text.encode()) else 1
        assert len(shards) <= most


def test_quality(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.op8_quality(spark, SF).toPandas()
    assert len(got) == d.count() and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == [quality.crc(i) % 4 == 2 for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.85
    labels = spark.createDataFrame([(0, 1), (100, 0), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels, held_out=False)
    assert quality.score(docs, model).count() == docs.count()
    one = quality.score(docs, quality.train(docs, labels.where("quality = 1"), held_out=False)).select("predicted").distinct().collect()
    assert [r.predicted for r in one] == [1]
    assert quality.score(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0


def plain_features(text):
    """The features of a text, one by one."""
    kind = lambda b: 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b >= 128 else 4 if chr(b) in ".,;:'()?" else 5 if b in (32, *range(9, 14)) else 6
    raw = text.encode() + b" "
    out = [sum(kind(b) == c for b in raw) / len(raw) for c in range(7)]
    # a word ends where the text's bytes say; its kinds are of the bytes as they stand
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return np.zeros(quality.N_STATS + quality.SHAPES)
    n, size, low = len(words), [len(w) for w in words], [w.lower() for w in words]
    mean = sum(size) / n
    counts = Counter(low)
    out += [mean / 10, max(0, sum(s * s for s in size) / n - mean**2) ** 0.5 / 10, len(counts) / n, max(counts.values()) / n, len(counts) / n * np.log1p(n) / 5]
    out.append(sum(a == b for a, b in zip(low, low[1:], strict=False)) / n)
    out += [sum(kind(w[-1]) == c for w in words) / n for c in (1, 4, 6, 2)]
    out += [sum(kind(w[0]) == c for w in words) / n for c in (1, 6)]
    out += [sum(s == 1 for s in size) / n, np.log1p(n) / 10, raw.count(10) / n]
    shape = Counter(((((kind(w[max(len(w) - 2, 0)]) * 7 + kind(w[-1])) * 7 + kind(w[0])) * 8 + min(len(w), 15) // 2) * 2654435761 >> 7) % quality.SHAPES for w in words)
    return np.array(out + [(shape[i] / n) ** 0.5 for i in range(quality.SHAPES)])


def test_quality_scores_against_a_plain_one(spark, rows):
    texts = [t or "" for _, t in rows] + ["One. TWO, three!! 44 (x) x X\n\nA", "ß" * 9]
    plain = np.array([plain_features(t) for t in texts])
    assert np.allclose(quality.features([t.encode() for t in texts]), plain, atol=1e-5)
    y = np.array([i % 2 for i in range(len(texts))])
    model = quality.fit(plain, y, pairs=5000, rounds=50)
    z = (plain - model.center) / model.scale
    good, bad = z[y == 1] @ model.weights, z[y == 0] @ model.weights
    # the loss over all preference pairs is less than without weights, and the threshold splits by the share of lows
    assert np.log1p(np.exp(bad[None] - good[:, None])).mean() < np.log(2)
    assert abs((np.concatenate([good, bad]) < model.threshold).mean() - (y == 0).mean()) < 0.05
    want = 1 / (1 + np.exp(-np.clip((z @ model.weights - model.threshold) / model.spread + np.log(0.7 / 0.3), -30, 30)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {x.doc_id: (x.score, x.predicted) for x in quality.score(df, model).collect()}
    assert all(abs(got[i][0] - w) < 1e-4 and (abs(w - 0.7) < 1e-4 or got[i][1] == (w >= 0.7)) for i, w in enumerate(want))


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, block):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8)).round(2)
    v[50:60] = v[50]
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    data += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, []), (None, [1.0] * 8)]
    df = topk.quantise(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for x in topk.top_k(df.where("vec_id % 20 = 0"), df, block=block, step=16, pivots=8).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    q = np.floor(v * 1024).astype(np.int64)
    for i in range(0, 300, 20):
        s = q @ q[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:10]
        assert got[i] == [(k + 1, j, s[j]) for k, j in enumerate(best)]
    assert topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id < 3")).count() == 2


def brute_top_k(data, query, k):
    rows = [(i, np.floor(np.array(v, dtype=float) * 1024).astype(np.int64)) for i, v in data if i is not None]
    out = Counter()
    for i, q in rows:
        if query(i):
            best = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return out


def test_top_k_with_many_files_in_a_task(spark):
    r = np.random.default_rng(9)
    data = [(i, r.normal(size=16).round(3).tolist()) for i in range(4000)]
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "2"}
    before = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, x in conf.items():
            spark.conf.set(c, x)
        df = topk.quantise(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
        index, _, _ = topk.build_index(df)
        assert len(index.inputFiles()) > 10 and index.rdd.getNumPartitions() <= 4
        for size in (16 << 20, 20_000):
            got = topk.top_k(df.where("vec_id % 40 = 0"), df, size=size).collect()
            assert Counter(map(tuple, got)) == brute_top_k(data, lambda i: i % 40 == 0, 10)
    finally:
        for c, x in before.items():
            spark.conf.unset(c) if x is None else spark.conf.set(c, x)


def test_top_k_of_vectors_of_several_lengths_and_sizes(spark):
    r = np.random.default_rng(4)
    data = [(i, (r.normal(size=7 + 2 * (i % 2)) * 10.0 ** (i % 5)).tolist()) for i in range(200)]
    df = topk.quantise(spark.createDataFrame([*data, (900, [1e300] * 7), (902, [65536.0] * 7)], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("n", F.lit("clash")))
    got = topk.top_k(df.where("vec_id % 3 = 0"), df, k=5, pivots=4).collect()
    assert Counter(map(tuple, got)) == brute_top_k(data, lambda i: i % 3 == 0, 5)


def test_licences_in_any_wrapping(spark):
    known = licences.KNOWN + [(f.stem, f.read_text(encoding="utf-8")) for f in (Path(licences.__file__).parent / "licence_texts").glob("*-2.0*.txt")]
    rows = []
    for name, text in known:
        for width in range(60, 101):
            # a paragraph with a copyright statement is not prose: its lines stay
            parts = [p if re.search(r"copyright *(\(c\)|\[)", p, re.I) else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n[ \t]*\n", text)]
            rows.append((name, "\n\n".join(parts)))
    for line in ("Copyright (c) 2020 Someone", "(C) 2020 Someone", "© Someone", "# Copyright 2020-2022, A", "Copyright by A", "Copyright [yyyy] [name of copyright owner]", "Copyright The Foo Authors", "Copyright The Foo Authors\nCopyright Bar Inc."):
        rows.append(("MIT", line + "\n\n" + licences.KNOWN[0][1]))
        rows.append(("MIT", "MIT License\n\n" + line + "\n\n" + licences.KNOWN[1][1]))
    got = licences.scan(spark.createDataFrame(rows, "name string, text string"), licences.known_digests(spark, known)).where("NOT licence <=> name").select("name", "text").collect()
    assert not [(r.name, r.text[:80]) for r in got]


def test_licences_equal_their_sql(spark, tmp_path):
    texts = [t for _, t in licences.KNOWN]
    heads = ["", "Copyright (c) 2020 A\n", "MIT License\n\nCopyright The A Authors\n\nCopyright B Inc.\n\n", "# Copyright by C\n#\n", "\n\ncopyright notice\n\n"]
    rows = [h + form(t) for t in texts for h in heads for form in (str, str.upper, lambda t: textwrap.fill(t, 71), lambda t: t.replace("license", "licence").replace("\n", "\r\n"))]
    rows += ["licence licence  licence", "per cent per cent copyright holder copyright holder", "", None, " \n", "© me\nlicence", "x copyright y", "é http://www.b.c Licence"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = licences.scan(df, licences.known_digests(spark)).select("doc_id", "digest", "n_canonical", "licence").collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(f"SELECT doc_id, digest, n_canonical, licence FROM ({licences.OP3_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {w[3] for w in want} == {n for n, _ in licences.KNOWN} | {None} and sum(w[3] is not None for w in want) > 100


def test_very_long_texts(spark):
    text = prose(12, 450_000)
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short text")], "doc_id long, text string")
    assert len(text) > 3_000_000
    bench = spark.createDataFrame([(1, " ".join(text.split()[300_000:300_015]))], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(df, bench).collect()}
    assert hits[1] == hits[2] >= 15 and hits[3] == 0
    assert {r.doc_id: r.component_id for r in neardup.classify(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.n_canonical for r in licences.scan(df, licences.known_digests(spark)).collect()} == {len(text), len(text) + 5, 10}
    assert Counter(r.doc_id for r in quality.score(df, quality.train(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"), held_out=False)).collect()) == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r["size"] for r in sharding.shard(df, shards=2).collect()} == {1: len(text) + 16, 2: len(text) + 21, 3: 26}
    tokens = {r.doc_id: (r.n_tokens, r.n_known) for r in lm.score(df, F.col("doc_id") == 2, steps=5).collect()}
    assert tokens[1] == (450_001, 450_001) and tokens[2] == (450_002, 450_001)


def test_licence_query_knows_whole_licences(spark, tmp_path):
    files = sorted((Path(licences.__file__).parent / "licence_texts").glob("*.txt"))
    texts = [(f.stem, f.read_text(encoding="utf-8")) for f in files]
    texts.append(("BSD-3-Clause", "Copyright (c) 2013, A and contributors.\nAll rights reserved.\n\n" + (licences._BSD + licences._BSD_NAME).format("1.", "2.", "3.") + licences._BSD_END.format(holder="HOLDER")))
    texts += [(None, texts[0][1] + " more")]
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.licence for r in licences.op3_licence_scan(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts] and len(files) > 10


def test_language_model(spark, docs, rows):
    held = F.pmod(F.col("doc_id"), F.lit(7)) == 2
    got = lm.score(docs, held, common_words=20, steps=150).collect()
    counts, toks = Counter(), []
    for d, t in rows:
        w = [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None]
        out = d is not None and d % 7 == 2
        toks.append((d, out, w))
        if not out:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, out, len(w), sum(counts[x] > 0 for x in w), n, round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)) for d, out, w in toks)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(docs.limit(0), held, steps=5).count() == 0


def test_language_model_scores_against_a_plain_one(spark):
    """Every word of every text by itself, with the fitted vectors looked up by word."""
    r = random.Random(3)
    heads = [f"head{i}" for i in range(lm.HEAD)]
    rare = [f"rare{i}{c}" for i in range(20) for c in ("xyz", "uvw")]
    texts = [" ".join(heads[i : i + 40] + r.choices(rare, k=2)) for i in list(range(0, lm.HEAD, 20)) * 8]
    texts += ["", None, "unseen1 head3 rare0xyz unseen2", "rare1xyz " * 5]
    held = lambda d: d % 5 == 2
    got = {}
    for common_words, hot in ((800, 10**6), (2000, 10**6), (2000, 6), (2000, 2)):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        rows = lm.score(df, F.col("doc_id") % 5 == 2, common_words=common_words, steps=40, hot=hot).collect()
        got[common_words, hot] = {x.doc_id: x.score for x in rows}
    key = lambda w: int(lm._keys(common.Words([w.encode()], common.SOLID))[0])
    tail = lambda w: int(lm.tail_class(common.Words([w.encode()], common.SOLID))[0])
    words = [[*(t or "").split(), None] for t in texts]
    counts = Counter(w for d, ws in enumerate(words) if not held(d) for w in ws)
    heads = sorted((w for w in counts if w is not None), key=lambda w: (-counts[w], key(w)))[: lm.HEAD]
    number = {None: 0} | {w: i + 1 for i, w in enumerate(heads)}
    cls = lambda w: number.get(w, 1 + lm.HEAD + tail(w) if w else 0)
    pairs, class_n, class_v = Counter(), np.zeros(lm.K), np.zeros(lm.K)
    after, before = defaultdict(Counter), defaultdict(Counter)
    for d, ws in enumerate(words):
        for p, w in zip([None, *ws[:-1]], ws, strict=True):
            if not held(d):
                pairs[cls(p), cls(w)] += 1
                after[p][cls(w)] += 1
                before[w][cls(p)] += 1
    for w, n in counts.items():
        class_n[cls(w)] += n
        class_v[cls(w)] += cls(w) > lm.HEAD
    h, out, bias = lm.train_vectors(np.array([(a, b, n) for (a, b), n in sorted(pairs.items())]), class_n, steps=40)
    table = lm._table(h, out, bias)
    around = np.zeros((lm.TAILS, lm.K), dtype=np.float32)
    for (a, b), n in pairs.items():
        if b > lm.HEAD:
            around[b - 1 - lm.HEAD, a] = n
    row = lambda c: np.array([[c[k] for k in range(lm.K)]], dtype=np.float32)
    own = [w for w, n in counts.items() if cls(w) > lm.HEAD and n >= lm.OWN]
    x = {w: lm.context_vectors(row(after[w]), (table * np.float32(np.log(10)))[cls(w)], out)[0] / np.log(10) for w in own}
    y = {w: lm.output_vectors(row(before[w]), around[cls(w) - 1 - lm.HEAD], h)[0] for w in own}
    added = np.zeros((lm.K, lm.K))
    for w in own:
        added[cls(w)] += (counts[w] + 1) * np.expm1(y[w].astype(float))
    whole = class_n + class_v + 1
    assert len(own) > 20 and any(counts[w] > 6 for w in own) and any(counts[w] <= 6 for w in own)

    def chance(p, w):
        a, c = cls(p), cls(w)
        s = float(table[a, c]) + (x[p][c] if p in x else 0)
        if c > lm.HEAD:
            s += log10(counts[w] + 1) - log10(max(whole[c] + added[c][a], 1)) + (y[w][a] / np.log(10) if w in y else 0)
        return s

    for d, ws in enumerate(words):
        want = sum(chance(p, w) for p, w in zip([None, *ws[:-1]], ws, strict=True))
        assert all(abs(g[d] - want) < 2e-3 * len(ws) for g in got.values())
    # all words that can follow, with one unseen word in each tail class, add to one
    for p in (None, heads[0], own[0]):
        total = sum(10 ** chance(p, w) for w in counts)
        a = cls(p)
        unseen = sum(10 ** (float(table[a, c]) + (x[p][c] if p in x else 0)) / max(whole[c] + added[c][a], 1) for c in range(1 + lm.HEAD, lm.K))
        assert abs(total + unseen - 1) < 1e-3


def test_language_model_is_normalised_and_better():
    r = np.random.default_rng(1)
    pairs = np.array([(i, (i + 1) % 20, 50) for i in range(20)] + [(i, int(r.integers(20)), 5) for i in range(20)])
    counts = np.zeros(lm.K)
    np.add.at(counts, pairs[:, 1], pairs[:, 2])
    table = lm.train_nce(pairs, counts, steps=300)
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(1), 1, atol=1e-3)
    base = np.log10((counts + 1) / (counts + 1).sum())
    assert (pairs[:, 2] * (table[pairs[:, 0], pairs[:, 1]] - base[pairs[:, 1]])).sum() > 0


def test_language_model_tells_words_of_one_class_apart(spark):
    fill = [f"f{i}" for i in range(lm.HEAD + 60)]
    texts = [" ".join(fill[i:] + fill[:i]) for i in range(0, 800, 20)]
    texts += ["f1 aaaxyz f2"] * 20 + ["f3 bbbxyz f4"] * 20
    own = ["f1 aaaxyz", "f1 bbbxyz", "aaaxyz f2", "bbbxyz f2", "f1 cccxyz"]
    df = spark.createDataFrame(list(enumerate(texts + own)), "doc_id long, text string")
    got = {r.doc_id - len(texts): r.score for r in lm.score(df, F.col("doc_id") >= len(texts), common_words=900, steps=150).where("held_out").collect()}
    assert got[0] > got[1] + 0.3 and got[2] > got[3] + 0.3 and got[0] > got[4]


def test_language_model_own_vectors_are_normalised_and_better():
    r = np.random.default_rng(5)
    h, out = r.normal(size=(2, lm.K, 8)).astype(np.float32)
    base = np.log(r.dirichlet(np.ones(lm.K), 1)[0]).astype(np.float32)
    seen = np.zeros((3, lm.K), dtype=np.float32)
    seen[0, 5], seen[1, 5:9], seen[2, 900] = 40, 10, 3
    x = lm.context_vectors(seen, base, out)
    assert np.allclose(np.exp(x + base).sum(1), 1, atol=1e-3) and ((seen * x).sum(1) > 0).all()
    around = seen.sum(0) + r.integers(0, 50, lm.K).astype(np.float32)
    y = lm.output_vectors(seen, around, h)
    # against what the words' weights come to on average over the contexts of their class
    assert ((seen * y).sum(1) / seen.sum(1) > np.log(np.exp(y) @ around / around.sum())).all()


def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, SF)
    assert good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    _, least, _ = brute_components(rows, 80)
    first = {d for (d, _), c in zip(rows, least, strict=True) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(d, t) for d, t in rows if d in first]
    clean = {k[0] for k in brute_decontaminate(left, items) if not k[5]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == clean
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pack"]


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    text = [(i, prose(i, 40), "own score", i * 1.5, f"hits {i}", f"key {i}") for i in range(12)]
    docs = spark.createDataFrame(text, "doc_id long, text string, score string, predicted double, n_hit string, _key string")
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(0, 1)] * 5, "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", prose(3, 40))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [r for r in sorted(text)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, str(tmp_path))
        assert docs_out.columns == docs.columns
        left = [r for r in want if not (name == "decontaminate" and r[0] == 3)]
        assert sorted(tuple(r) for r in docs_out.collect()) == left


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 300 + [(3, "b4d w0rds")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 400 + [(3, 0)] * 400, "doc_id long, quality int")
    model = quality.train(docs, labels, max_labelled=20, held_out=False)
    got = {r.doc_id: r.predicted for r in quality.score(docs, model).select("doc_id", "predicted").distinct().collect()}
    assert set(got) == {1, 3}
