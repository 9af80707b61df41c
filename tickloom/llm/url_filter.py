"""URL filters, in DataFrame functions only.

Spark's FP-growth mines combinations of URL tokens from labelled pages, the label being an item of its transaction; rules
"tokens -> block" of up to MAX_TOKENS tokens are kept by support and confidence, without those that a rule on fewer of the same tokens already makes.
Tokens come from the whole url, so a page may have many, and FP-growth, which knows no longest set, lists all subsets of a long common url. So
transactions hold only tokens that are frequent among bad pages and no rule by themselves, and tokens that are on exactly the same pages, such as those of one
host, count as one until the rules are written. The number of sets is bounded before mining (each frequent set is in ``need`` transactions or more, so there are at most
sum(2 ** size) / need). Beyond MAX_SETS, sets are counted level by level, which gives the same rules. An inverted index holds each rule under its
rarest token, in hashed slots of one array, so a page looks up its own tokens and checks only rules posted there.
Explicit rules on hosts and paths go first.

At support s there are at most m / s rules, m being the mean number of sets of one to three frequent tokens on a page: the index grows with
the length of urls, not with the number of pages. Explicit rules are a parameter of at most MAX_RULES.

Null url or one without ://: empty host and path, no tokens, allowed. Repeated rows and null ids pass through, one result per row.
With fewer than MIN_PAGES labelled pages the method allows all.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Sequence
from itertools import combinations, product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.002, 0.8, 3
#: Pages that a rule needs at least, where the support asks for fewer.
MIN_PAGES = 20
MAX_RULES = 512
#: Frequent sets, as bounded before mining, up to which FP-growth lists them.
MAX_SETS = 2_000_000
SLOTS = 1024
#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} explicit rules")
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def tokens(url: str, host: Column, path: Column) -> Column:
    """Distinct tokens of the whole url: the host, each suffix of its labels, each label, the first label, the scheme, each
    segment of the path (as it is, and with numbers as 0), the first two also by place, each word of a segment, the ending, depth, each name, value and
    both of the query, and the fragment. A suffix or label is without user and port."""
    labels, parts = F.split(F.regexp_replace(host, "^[^@]*@|:[0-9]*$", ""), r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    named = lambda k, c: F.concat(F.lit(f"{k}="), c)
    all_named = lambda k, c: F.transform(c, lambda x: named(k, x))
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    word = lambda i: plain(F.try_element_at(parts, F.lit(i)))
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "[&;]"), lambda q: q != "")
    value = lambda q: F.regexp_extract(q, "(?s)^[^=]*=(.*)$", 1)
    values = F.filter(F.transform(query, value), lambda v: v != "")
    words = F.filter(F.split(F.array_join(parts, "/"), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")
    own = F.array(named("host", host), named("first", F.element_at(labels, 1)), named("scheme", F.regexp_extract(url, "^([A-Za-z]*):", 1)), named("dir1", word(1)), named("dir2", word(2)), named("end", F.nullif(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1), F.lit(""))), named("depth", F.size(parts).cast("string")), named("fragment", F.nullif(F.regexp_extract(url, "(?s)#(.*)$", 1), F.lit(""))))
    every = (("suffix", suffixes), ("label", labels), ("seg", parts), ("seg", F.transform(parts, plain)), ("word", words), ("query", F.transform(query, lambda q: F.split_part(q, F.lit("="), F.lit(1)))), ("arg", query), ("value", values))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.concat(own, *[all_named(k, c) for k, c in every]))))


def _slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS))


def _grown(rows: DataFrame, need: int, size: int) -> DataFrame:
    """(ids, n, n_bad) of sets of two tokens or more, up to ``size``, in ``need`` bad rows or more, by FP-growth."""
    n, bad = rows.count(), F.array_contains("items", -1)
    if n < need:
        return rows.limit(0).select("ids", F.lit(0).alias("n"), F.lit(0).alias("n_bad"))
    baskets = rows.select(F.when(F.col("bad"), F.array_append("ids", -1)).otherwise(F.col("ids")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n).fit(baskets).freqItemsets
    own = sets.select(F.array_sort(F.array_remove("items", -1)).alias("ids"), F.when(~bad, F.col("freq")).alias("n"), F.when(bad, F.col("freq")).alias("n_bad"))
    return own.where(F.size("ids").between(2, size)).groupBy("ids").agg(F.max("n").alias("n"), F.max("n_bad").alias("n_bad")).where("n_bad is not null")


def _by_level(rows: DataFrame, need: int, size: int, rule: Column) -> DataFrame:
    """The same sets, less those that hold a rule, counted size by size: only sets that are no rule are extended. They are written, so that Spark sees their size and sends them
    to all tasks only if they are small."""
    keys, sets, levels = ["t0"], rows.select("bad", "ids", F.explode("ids").alias("t0")), []
    for k in range(2, size + 1):
        before, new = keys, f"t{k - 1}"
        keys = [*keys, new]
        sets = sets.select("bad", "ids", *before, F.explode(F.filter("ids", lambda x: x > F.col(before[-1]))).alias(new))
        if k > 2:  # all subsets one smaller are frequent and no rule
            for left in range(k - 2, -1, -1):
                own = [t for i, t in enumerate(keys) if i != left]
                sets = sets.join(open_sets.toDF(*own), own, "left_semi")
        found = cut(sets.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad")).where(F.col("n_bad") >= need))
        levels.append(found.select(F.array(*keys).alias("ids"), "n", "n_bad"))
        open_sets = found.where(~rule).select(*keys)
        if k < size:
            sets = sets.join(open_sets, keys, "left_semi")
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def rules_of(items: DataFrame, need: int, min_confidence: float, max_sets: int = MAX_SETS) -> list[tuple[list[str], float, int]]:
    """(tokens, confidence, number of rows) of the smallest sets of up to MAX_TOKENS tokens that ``need`` bad rows or more hold, and whose rows
    are bad with that confidence; from rows (items array<string>, distinct, bad boolean)."""
    rule = F.col("n_bad") / F.col("n") >= min_confidence
    # sums of 128 bits of each row's hash tell which tokens are on the same rows
    marks = [F.sum(f"mark{k}").alias(f"mark{k}") for k in (0, 1)]
    each = items.select("bad", *[F.xxhash64("items", F.lit(k)).cast("decimal(20,0)").alias(f"mark{k}") for k in (0, 1)], F.explode("items").alias("t"))
    ones = each.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), *marks).where(F.col("n_bad") >= need).select("*", rule.alias("rule"), _slot(F.col("t")).alias("slot")).collect()
    kept = [([r["t"]], r["n_bad"] / r["n"], r["n"]) for r in ones if r["rule"]]
    twins = defaultdict(list)
    for r in ones:
        if not r["rule"]:
            twins[r["n"], r["n_bad"], r["mark0"], r["mark1"]].append((r["t"], r["slot"]))
    groups = sorted(sorted(g) for g in twins.values())
    if len(groups) > 1:
        slots: list[list[dict]] = [[] for _ in range(SLOTS)]
        for i, ((t, slot), *_) in enumerate(groups):
            slots[slot].append({"t": t, "i": i})
        index = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t:string,i:int>>>")
        known = F.transform(F.flatten(F.transform("items", lambda t: F.filter(F.get(index, _slot(t)), lambda r: r["t"] == t))), lambda r: r["i"])
        rows = cut(items.select("bad", F.array_sort(known).alias("ids")).where("size(ids) > 1"))
        bound = rows.agg(F.sum(F.pow(F.lit(2.0), F.size("ids") + F.col("bad").cast("int")))).first()[0] or 0
        sets = _grown(rows, need, MAX_TOKENS) if bound / need <= max_sets else _by_level(rows, need, MAX_TOKENS, rule)
        found = {tuple(r["ids"]): (r["n_bad"] / r["n"], r["n"]) for r in sets.where(rule).collect()}
        for ids, (c, n) in found.items():
            if not any(small in found for k in range(2, len(ids)) for small in combinations(ids, k)):
                kept += [([t for t, _ in own], c, n) for own in product(*(groups[i] for i in ids))]
    return sorted(((sorted(own), c, n) for own, c, n in kept), key=lambda k: (len(k[0]), k[0]))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[list[str], float, int]]:
    """(tokens, confidence, number of pages) of rules that block, from pages with a label (low quality or toxic: bad)."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    items = pages.where("url is not null").select(F.col("page_id").alias("doc_id"), tokens("url", host(), path()).alias("items")).join(bad, "doc_id").where("size(items) > 0").select("items", F.coalesce(F.col("bad") == 1, F.lit(False)).alias("bad"))
    n = items.count()
    if n < MIN_PAGES:
        return []
    return rules_of(items, max(MIN_PAGES, math.ceil(min_support * n)), min_confidence)


def _matches(spark: SparkSession, rules: list[tuple[list[str], float, int]], tokens: Column) -> Column:
    """The confidence of the surest rule whose tokens are all there, or null."""
    if not rules:
        return F.lit(None).cast("double")
    seen: dict[str, int] = {}
    for own, _, n in rules:
        for t in own:
            seen[t] = max(seen.get(t, 0), n)
    # under its rarest token, in the slot that Spark's own hash gives; a constant, so that it is read once and looked up by place
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    at = {r["t"]: r["slot"] for r in spark.createDataFrame([(t,) for t in sorted(seen)], "t string").select("t", _slot(F.col("t")).alias("slot")).collect()}
    for own, c, _ in rules:
        t = min(own, key=lambda t: (seen[t], t))
        slots[at[t]].append({"t": t, "all": own, "c": c})
    index = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t:string,all:array<string>,c:double>>>")
    hit = lambda t: F.filter(F.get(index, _slot(t)), lambda r: (r["t"] == t) & (F.size(F.array_except(r["all"], tokens)) == 0))
    return F.array_max(F.transform(F.flatten(F.transform(tokens, hit)), lambda r: r["c"]))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page; confidence: the mined rule's, where one fits."""
    mined = mine(pages, labels, min_support, min_confidence)
    parts = pages.select("page_id", "url", host().alias("host"), path().alias("path"))
    found = parts.withColumns({"tokens": tokens("url", F.col("host"), F.col("path")), "own": explicit(rules, F.col("host"), F.col("path"))}).withColumn("confidence", _matches(pages.sparkSession, mined, F.col("tokens")))
    return found.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
