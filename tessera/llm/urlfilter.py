"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

Everything on the main path is DataFrame functions; the training of the small labelled table is one expression.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

#: Fixed rules of the query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Both are
    empty for null and where there is no ://."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, form, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    rule = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _hashed(name: str, chars: Column, n: int, buckets: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(name), F.array_join(F.slice(chars, i + 1, n), "")), F.lit(buckets)).cast("int")


def grams(host: Column, path: Column, buckets: int, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Distinct buckets of the character n-grams of host and path, each with its ends marked and hashed apart."""
    found = []
    for name, text in (("h", host), ("p", path)):
        chars = F.concat(F.array(F.lit("^")), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("$")))
        for n in sizes:
            at = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
            found.append(F.transform(at, _hashed(name, chars, n, buckets)))
    return F.array_distinct(F.concat(*found))


def train(labelled: DataFrame, buckets: int = 4096, max_rows: int = 192, rounds: int = 150, rate: float = 2.0, decay: float = 1e-3) -> list[float]:
    """Weights (the last is the intercept) of a logistic regression on labelled (host, path, label double).

    The table is small by contract: at most max_rows rows (those of the smallest hashes) are read. Full-batch gradient
    descent runs in the dual form, one coefficient per row over the matrix of shared n-grams, inside one expression.
    An empty table gives zeros, which judge everything as allowed.
    """
    rows = labelled.select(grams(F.col("host"), F.col("path"), buckets).alias("g"), "label").orderBy(F.xxhash64("g"), "label").limit(max_rows)
    one = rows.agg(F.collect_list(F.struct("g", "label")).alias("r")).where(F.size("r") > 0)
    norm = lambda r: F.sqrt(F.size(r["g"]).cast("double"))
    kernel = F.transform("r", lambda a: F.transform("r", lambda b: F.size(F.array_intersect(a["g"], b["g"])) / (norm(a) * norm(b)) + 1.0))
    # written, for an inlined matrix would be computed anew for each of its uses
    one = stash(one.select("r", kernel.alias("k")), "kernel")
    n = F.size("r").cast("double")

    def step(alpha: Column, _: Column) -> Column:
        def row(a: Column, i: Column) -> Column:
            s = F.aggregate(F.zip_with(alpha, F.col("k")[i], lambda x, y: x * y), F.lit(0.0), lambda p, x: p + x)
            return a + F.lit(rate) * ((F.col("r")[i]["label"] - 1 / (1 + F.exp(-s))) / F.sqrt(n) - F.lit(decay) * a)

        return F.transform(alpha, row)

    start = F.transform("r", lambda _: F.lit(0.0))
    one = one.select("r", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("alpha"))
    each = one.select(F.explode(F.arrays_zip("r", "alpha")).alias("e")).select("e.r", "e.alpha")
    ngram = each.select(F.explode("r.g").alias("b"), (F.col("alpha") / F.sqrt(F.size("r.g").cast("double"))).alias("w"))
    total = ngram.unionByName(each.select(F.lit(buckets).alias("b"), F.col("alpha").alias("w"))).groupBy("b").agg(F.sum("w").alias("w"))
    weights = [0.0] * (buckets + 1)
    for r in total.collect():
        weights[r.b] = float(r.w)
    return weights


def chance(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's chance that a url is to be allowed."""
    w = F.from_json(F.lit(json.dumps([round(x, 9) for x in weights])), "array<double>")
    dot = lambda g: F.aggregate(g, F.lit(0.0), lambda s, i: s + F.get(w, i))
    logit = lambda g: dot(g) / F.sqrt(F.size(g).cast("double")) + F.lit(weights[-1])
    return 1 / (1 + F.exp(-F.transform(F.array(grams(host, path, len(weights) - 1)), logit)[0]))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, url: str = "url", cut: float = 0.5, max_rows: int = 192) -> DataFrame:
    """pages with host, path, rule, verdict and chance.

    verdict is that of the longest fitting rule; without one, the model's: allow where chance >= cut. labelled is a
    small table (url, label: 1 allow, 0 block). Without it, the urls of pages that rules decide are the labelled ones.
    The model is fitted on at most max_rows of them (the documented bound of the sample, as training grows with its
    square): those of the smallest hashes, without a table half of each label, each url once. Null or malformed urls
    have empty host and path, no rule, and the model's verdict; repeated rows have equal verdicts; very long urls are
    read whole; an empty table has no rows. Input columns with these names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "chance")
    host, path = parts(F.col(url))
    split = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    if labelled is None:
        known = split.select("host", "path", verdict.alias("v")).where("v IS NOT NULL")
        known = known.groupBy("v", F.xxhash64("host", "path").alias("h")).agg(F.min(F.struct("host", "path")).alias("s"))
        half = [known.where(F.col("v") == v).orderBy("h").limit(max_rows // 2) for v in ("allow", "block")]
        table = reduce(DataFrame.unionByName, half).select("s.host", "s.path", (F.col("v") == "allow").cast("double").alias("label"))
    else:
        h, p = parts(F.col("url"))
        table = labelled.where("label IS NOT NULL").select(h.alias("host"), p.alias("path"), F.col("label").cast("double").alias("label"))
    weights = train(stash(table, "labelled"), max_rows=max_rows)
    out = split.withColumn("rule", rule).withColumn("_said", verdict).withColumn("chance", chance(F.col("host"), F.col("path"), weights))
    return out.withColumn("verdict", F.coalesce("_said", F.when(F.col("chance") >= cut, "allow").otherwise("block"))).drop("_said")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
