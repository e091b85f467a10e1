"""Operator 4: URL filter with a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; null or no :// gives an empty string."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without leading www. or m., path without closing slashes, and sorted parameters without those for tracking.

    Scheme and fragment do not count. A url without :// is its own canonical form; null gives an empty string.
    """
    query = F.filter(F.split(F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    rest = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit(""))
    made = F.concat(F.regexp_replace(host(url), "^(www|m)\\.", ""), F.regexp_replace(path(url), "/+$", ""), rest)
    return F.coalesce(F.when(url.contains("://"), made).otherwise(url), F.lit(""))


def longest_rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, "host/path") that fits host or parent domain and path; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """One bit in each word of a block, from a second hash of the key."""
    h = F.xxhash64(F.lit(17), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(h, F.lit(s)), F.lit(64)).cast("int")) for s in SALTS]


def bloom(listed: DataFrame, column: str, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """Blocks of a split-block Bloom filter as rows (block, w0 to w7), and the number of blocks it is dealt over."""
    blocks = max(1, -(-listed.count() * bits_per_key // (64 * WORDS)))
    k = F.col(column)
    rows = listed.select(F.pmod(F.xxhash64(k), F.lit(blocks)).alias("block"), *[b.alias(f"w{j}") for j, b in enumerate(_bits(k))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)]), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = (), url: str = "url") -> DataFrame:
    """Adds host, path, canonical_url, rule and verdict to each page.

    `listed` has one column of canonical urls; nulls there list nothing, repeats count once. The rule's verdict counts; else a listed page
    is blocked and any other allowed. Distinct canonical urls probe the filter, by a join on the block, so a url that fills
    a third of the rows probes once; possible hits go to an exact join. The filter is a table: it is broadcast only where
    Spark finds it small enough. Null urls have empty host, path and canonical form, which can't be listed. Existing columns
    of the added names are replaced; the list is written once, however it is made; an empty list allows everything that no rule blocks.
    """
    added = ("host", "path", "canonical_url", "rule", "verdict")
    u = F.col(f"`{url}`")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in added]
    df = pages.select(*kept, host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical_url"))
    names = listed.select(F.col(listed.columns[0]).alias("__url")).where("__url is not null and __url <> ''").distinct()
    names = Scratch(pages.sparkSession, "urls").keep(names, "listed")
    filt, blocks = bloom(names, "__url")
    c = F.col("canonical_url")
    keys = df.where(c != "").select("canonical_url").distinct()
    probe = keys.select("canonical_url", F.pmod(F.xxhash64(c), F.lit(blocks)).alias("block"), *[b.alias(f"b{j}") for j, b in enumerate(_bits(c))])
    all_set = reduce(lambda a, b: a & b, [F.col(f"w{j}").bitwiseAND(F.col(f"b{j}")) != 0 for j in range(WORDS)])
    possible = probe.join(filt, "block").where(all_set).select("canonical_url")
    hits = possible.join(names, possible["canonical_url"] == names["__url"], "left_semi").select(F.col("canonical_url").alias("__hit"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = df.join(hits, c == F.col("__hit"), "left").withColumns({"rule": rule, "__says": verdict})
    return out.withColumn("verdict", F.coalesce("__says", F.when(F.col("__hit").isNotNull(), "block").otherwise("allow"))).drop("__says", "__hit")
