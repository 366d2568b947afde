"""URL filters (operator 7), with DataFrame functions only.

A short policy of host and path rules decides first. Where none fits, a URL is blocked if its canonical form is
listed: a blocked Bloom filter of the list passes the few possible hits, and an exact join with the list removes those that are
false. The filter grows with the list, so that its rate of false hits does not. Up to ``MOST_BLOCKS`` it is broadcast; a larger one is dealt out
by block, and the pages' keys meet their blocks there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import written

#: The filter's blocks are 8 words of 64 bits, one bit set in each. So many are broadcast, which is 38 MB with block numbers and serves 16 million addresses.
MOST_BLOCKS, LANES, KEYS_PER_BLOCK = 524_288, 8, 32
MOST_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    rule: str  # host, a slash, and the start of a path

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., and path without a last slash, .html or /index; '' for no host."""
    bare = F.regexp_replace(host, "^www\\.", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(bare, F.regexp_replace(path, "(/index)?(\\.html?)?/?\\z", "")))


def matching_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; of two of one text, block goes first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"a policy has at most {MOST_RULES} rules")
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.rule), r.rule, r.action)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, action = F.when(fits, F.lit(rule.rule)).otherwise(name), F.when(fits, F.lit(rule.action)).otherwise(action)
    return name, action


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def lane_bits(key: Column) -> list[Column]:
    """For each lane the bit that the key sets, from six bits of a second hash."""
    h = F.xxhash64(key, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(LANES)]


def bloom_filter(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, lane_0 .. lane_7): at most ``blocks`` rows."""
    bits = lane_bits(F.col(column))
    keys = listed.select(block_of(F.col(column), blocks).alias("block"), *(b.alias(f"lane_{i}") for i, b in enumerate(bits)))
    return keys.groupBy("block").agg(*(F.bit_or(f"lane_{i}").alias(f"lane_{i}") for i in range(LANES)))


def possible_hits(rows: DataFrame, column: str, bloom: DataFrame, blocks: int, most: int) -> DataFrame:
    """Adds ``_possible``: false only for keys that are surely not listed (null keys are not). A filter of more than ``most`` blocks is not broadcast; a block that many rows ask for is split by Spark."""
    bits = lane_bits(F.col(column))
    passed = F.lit(True)
    for i, b in enumerate(bits):
        passed = passed & (F.col(f"lane_{i}").bitwiseAND(b) == b)
    held = F.broadcast(bloom) if blocks <= most else bloom
    out = rows.withColumn("_block", block_of(F.col(column), blocks)).join(held, F.col("_block") == F.col("block"), "left")
    return out.withColumn("_possible", F.coalesce(passed, F.lit(False))).drop("block", "_block", *(f"lane_{i}" for i in range(LANES)))


def url_filter(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url", id_column: str = "page_id", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(id, host, path, rule, verdict) of each page; ``listed`` has canonical URLs in ``canonical``. More than ``MOST_RULES`` rules are an error: each is an expression.

    A null URL or one without :// has empty host and path and no rule, and is allowed: '' is never listed.
    Repeated rows and null ids stay; the list may repeat itself or hold nulls; other columns of ``pages`` are not read. Empty
    tables are fine on either side.
    """
    listed = written(listed.where("canonical is not null and canonical <> ''").select("canonical").distinct())
    blocks, keys = 1, listed.count()
    while blocks * KEYS_PER_BLOCK < keys:
        blocks *= 2
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    name, action = matching_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "_action": action, "_key": canonical(F.col("host"), F.col("path"))})
    rows = possible_hits(rows, "_key", bloom_filter(listed, "canonical", blocks), blocks, most_blocks)
    ruled = F.col("rule").isNotNull() | ~F.col("_possible")
    settled = rows.where(ruled).select(id_column, "host", "path", "rule", F.coalesce("_action", F.lit("allow")).alias("verdict"))
    # The same URL may stand in many rows: the join's skew is split by Spark, its right side has each key once.
    hits = rows.where(~ruled).join(listed, F.col("_key") == F.col("canonical"), "left")
    return settled.unionByName(hits.select(id_column, "host", "path", "rule", F.when(F.col("canonical").isNotNull(), "block").otherwise("allow").alias("verdict")))


def repeated_addresses(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs that several different spellings share: addresses that a crawl fetches again and again."""
    host, path = host_and_path(F.col(url))
    keys = pages.select(F.col(url).alias("url"), host.alias("host"), path.alias("path")).select("url", canonical(F.col("host"), F.col("path")).alias("canonical"))
    return keys.where("canonical <> ''").groupBy("canonical").agg(F.min("url").alias("a"), F.max("url").alias("b")).where("a <> b").select("canonical")
