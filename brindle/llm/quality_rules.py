"""Host-level quality rules (operator 3), with DataFrame functions only.

Each document is measured on its own and checked against base rules. Failures are then counted by host, each
host's rates are shrunk towards the corpus by a beta prior that is fitted to the hosts by moments, less what chance alone makes
them differ. A host loses all its documents where even the low end of what its rate may be is a multiple of the corpus' rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import written

#: Fixed values of the contract: what parts words, and what counts as a symbol.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SPAN = 8
#: A host is dropped when the lower bound of its rate of failures of a rule - the shrunken rate less so many of its standard deviations - is
#: above so many times the corpus' rate, and above a least rate: rare failures are no reason to drop a host's good documents.
DEVIATIONS, TIMES, LEAST_RATE = 2.0, 2.0, 0.2
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6
#: Rejected hosts are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_HOSTS = 10_000
RULES = ("base", "symbols", "lines")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def repeated_words(words: Column, windows: Column) -> Column:
    """Words inside windows of SPAN words that the text has twice or more, given hashes of all windows.

    Equal windows have equal hashes: a text of distinct hashes has none. Else the windows themselves are
    sorted with their places; those equal to a neighbour are the repeated ones, and their union is counted.
    """
    text = F.transform(windows, lambda _, i: F.struct(F.array_join(F.slice(words, i + 1, SPAN), " ").alias("w"), i.alias("at")))
    same = lambda s: F.transform(
        s, lambda x, i: F.when((F.get(s, i - 1)["w"] == x["w"]) | (F.get(s, i + 1)["w"] == x["w"]), x["at"])
    )
    places = F.flatten(F.transform(F.array(F.array_sort(text)), lambda s: F.array_compact(same(s))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-SPAN).alias("last"))
    covered = F.aggregate(F.array_sort(places), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(SPAN), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("bigint"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    long = lambda c: c.cast("bigint")
    out = docs.withColumn("_words", words_of(whole)).withColumn("_lines", lines)
    windows = F.when(F.size("_words") >= SPAN, F.transform(F.sequence(F.lit(1), F.size("_words") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("_words", i, SPAN)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_windows", windows)
    out = out.withColumns(
        {
            "n_words": long(F.size("_words")),
            "word_chars": long(F.length(F.translate(whole, WHITE, ""))),
            "n_symbols": long(F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))),
            "n_lines": long(F.size("_lines")),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": repeated_words(F.col("_words"), F.col("_windows")),
        }
    ).drop("_words", "_lines", "_windows")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def rule_failures() -> dict[str, Column]:
    return {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def host_rates(rows: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, and per rule failures, rate, bound and limit) from measured rows with a host.

    With rate m over all N documents of H hosts, and v the mean squared distance of the hosts' rates from it, each host weighing as its documents, hosts
    differ by b = (v - m (1 - m) (H - 1) / N) / (1 - sum of squared shares): what chance makes v for equal hosts is taken off. The prior is
    beta(m s, (1 - m) s) with s = m (1 - m) / b - 1, held between bounds; without a difference it is as strong as can be. rate is the
    mean of a host's rate then, bound lies DEVIATIONS standard deviations below, and limit is what bound must not pass.
    """
    hosts = rows.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("n_docs"), *(F.sum(F.when(failed, 1).otherwise(0)).alias(f"{rule}_failures") for rule, failed in rule_failures().items())
    )
    hosts = written(hosts)
    n = F.sum("n_docs")
    totals = hosts.agg(
        ((F.count("*") - 1) / n).alias("chance"),
        (1 - F.sum(F.col("n_docs") * F.col("n_docs")) / (n * n)).alias("spread"),
        *(c for r in RULES for c in ((F.sum(f"{r}_failures") / n).alias(f"{r}_m"), (F.sum(F.col(f"{r}_failures") * F.col(f"{r}_failures") / F.col("n_docs")) / n - F.pow(F.sum(f"{r}_failures") / n, 2)).alias(f"{r}_v"))),
    )
    out = hosts.crossJoin(F.broadcast(totals))  # totals is one row
    for r in RULES:
        m, v = F.col(f"{r}_m"), F.col(f"{r}_v")
        differ = F.when(F.col("spread") > 1e-9, (v - m * (1 - m) * F.col("chance")) / F.col("spread"))
        strength = F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.when(differ > 1e-9, m * (1 - m) / differ - 1).otherwise(F.lit(STRONGEST))))
        out = out.withColumn(f"{r}_strength", strength).withColumn(f"{r}_rate", (F.col(f"{r}_failures") + m * F.col(f"{r}_strength")) / (F.col("n_docs") + F.col(f"{r}_strength")))
        rate = F.col(f"{r}_rate")
        out = out.withColumn(f"{r}_bound", rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + F.col(f"{r}_strength") + 1)))
        out = out.withColumn(f"{r}_limit", F.greatest(F.lit(LEAST_RATE), TIMES * m))
    return out.select(host, "n_docs", *(c for r in RULES for c in (f"{r}_failures", f"{r}_rate", f"{r}_bound", f"{r}_limit")))


def rejected_hosts(rates: DataFrame) -> DataFrame:
    return rates.where(" or ".join(f"{r}_bound > {r}_limit" for r in RULES))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures of each document, ``base_failed``, and ``kept``: neither it nor its host fails.

    Returns ``columns``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, in as many
    rows as ``docs`` has. A null text is an empty one and fails for its few words. A document of no host (null) is
    judged alone. Null ids and repeated rows stay as they are; columns of ``docs`` not named in ``columns`` are dropped, and a name in it that
    the result has already is an error; an empty table gives an empty result.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if clash := {*columns} & {*own, "kept"}:
        raise ValueError(f"the result has columns of its own named {', '.join(sorted(clash))}")
    rows = measured(docs.select(*(F.col(c).alias(f"_in_{c}") for c in columns), F.col(host).alias("_host"), F.col(text).alias("_text")), "_text").drop("_text")
    rows = written(rows)
    rejected = written(rejected_hosts(host_rates(rows, "_host")).select(F.col("_host").alias("_bad_host")))
    few = rejected.count() <= BROADCAST_HOSTS
    out = rows.join(F.broadcast(rejected) if few else rejected, F.col("_host") == F.col("_bad_host"), "left")
    return out.select(*(F.col(f"_in_{c}").alias(c) for c in columns), *own, (~F.col("base_failed") & F.col("_bad_host").isNull()).alias("kept"))
