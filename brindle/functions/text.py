"""Functions of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Octal escapes that text extraction leaves, and what they stand for.
ESCAPES = (("\\050", "("), ("\\051", ")"), ("\\002", "fi"), ("\\017", "*"), ("\\227", "--"), ("\\247", "Section "), ("\\223", '"'), ("\\224", '"'), ("\\000", "-"))


def repair_escapes(text: Column) -> Column:
    for code, char in ESCAPES:
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def shift_markers(marks: DataFrame) -> DataFrame:
    """Adds shifted to (byte_index, text): the byte offset after the text's repair.

    Offsets inside a character are left out.
    """
    head = F.substring(F.encode("text", "UTF-8"), F.lit(1), F.col("byte_index").cast("int"))
    rows = marks.withColumn("_head", head).where(F.is_valid_utf8(F.col("_head").cast("string")))
    return rows.withColumn("shifted", F.octet_length(repair_escapes(F.decode("_head", "UTF-8"))).cast("bigint")).drop("_head")


def whole_characters(text: Column, limit: int) -> Column:
    """Bytes of the longest start of whole characters within ``limit`` bytes."""
    raw = F.encode(text, "UTF-8")
    back = F.lit(limit)
    # A character has at most four bytes: step back over its second to fourth.
    inside = lambda at: F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80
    for k in range(3, 0, -1):
        hit = inside(F.lit(limit))
        for j in range(1, k):
            hit = hit & inside(F.lit(limit - j))
        back = F.when(hit & (back == limit), limit - k).otherwise(back)
    return F.when(F.octet_length(text) <= limit, F.octet_length(text)).otherwise(back)


def summary_end(text: Column, section_starts: Column, limit: int = 1000, gap: int = 100) -> Column:
    """Bytes of a text that stand for it: up to its introduction, else up to the first section that ends a gap, else ``limit``.

    The word is found whatever its ASCII case, at a byte of at most ``limit``; sections count if two that follow each other
    begin ``gap`` bytes or more apart, the first of them within ``limit``: then the second's start is meant.
    """
    before = F.regexp_extract(text, "(?s)^(.*?)(?i:introduction)", 1)
    at = F.when(F.rlike(text, F.lit("(?i:introduction)")), F.octet_length(before))
    pairs = F.zip_with(section_starts, F.slice(section_starts, 2, F.greatest(F.size(section_starts), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.filter(pairs, lambda p: (p["a"] <= limit) & (p["b"] - p["a"] >= gap))
    return F.coalesce(F.when(at <= limit, at), F.get(found, F.lit(0))["b"], whole_characters(text, limit)).cast("bigint")


def mentions(text: Column) -> Column:
    """Names after an @ at the start or after white space, in double quotes or bare; others, as in addresses, are not meant.

    A quote that is not closed anywhere after it belongs to a bare name; empty names are left out.
    """
    hits = F.regexp_extract_all(text, F.lit('(?U)(?:^|\\s)@("[^"]*"|\\S*)'), 1)
    closed = lambda m: F.rlike(m, F.lit('^"[^"]*"$'))
    names = F.transform(hits, lambda m: F.when(closed(m), F.substr(m, F.lit(2), F.char_length(m) - 2)).otherwise(m))
    return F.filter(names, lambda m: m != "")


def first_words(text: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, "[ \\t\\n\\x0b\\f\\r]+"), lambda x: x != ""), 1, n), " ")


def bytes_text(n: Column) -> Column:
    """B whole, KB to TB with one decimal, ties to the even digit, in steps of 1024."""
    out = F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1))
    for k, unit in ((4, "GB"), (3, "MB"), (2, "KB")):
        out = F.when(n < 1024.0**k, F.format_string(f"%.1f {unit}", F.bround(n / 1024.0 ** (k - 1), 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(out)


def after_scheme(path: Column) -> Column:
    """What follows the first colon; the whole of a text without one."""
    return F.when(F.instr(path, ":") > 0, F.regexp_replace(path, "^[^:]*:", "")).otherwise(path)


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))
