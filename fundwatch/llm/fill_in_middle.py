r"""Fill-in-the-middle texts: prefix, middle and suffix of a text change places around three markers.

A text is a row of units, a word with the white space before it, or white space at the end.
``regexp_count`` gives their number n, a hash of the id two cuts among them, and one regular
expression made for the row, ``\A(unit{a}+)(unit{b-a}+)(.*)``, takes all three parts in a single
match. Its counted groups are possessive: the matcher steps over the units in a loop and never
goes back, so a text of millions of units needs no stack. Everything is a column expression over
one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word and the white space before it, or the white space that no word follows.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _numbers(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for every row of ``docs`` (doc_id, text).

    ``percent`` of the texts are taken apart, ``spm_percent`` of those with the suffix first (form
    ``spm``), the others as ``psm``; which ones depends on ``seed`` and doc_id only, so rows with
    equal ids and texts are treated alike. A null text is an empty one; an empty text, or one that
    holds a marker, stays as it is (form ``plain``, lengths null). A null doc_id counts as an
    empty string. Cuts may meet, and parts be empty. Other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = _numbers(F.col("doc_id"), seed)
    units = F.col("n") + 1
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    plain = (F.col("_text") == "") | marked | (h3 % 100 >= percent)
    counted = docs.select("doc_id", text.alias("_text")).withColumn("n", F.regexp_count("_text", F.lit(UNIT)).cast("bigint"))
    drawn = counted.withColumns({
        "form": F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"),
        "_a": F.least(h1 % units, h2 % units), "_b": F.greatest(h1 % units, h2 % units)})
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), F.col("_a"), F.lit(rf"}}+)({UNIT}{{"), F.col("_b") - F.col("_a"), F.lit("}+)(.*+)"))
    order = F.when(F.col("form") == "spm", F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")).otherwise(F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))
    made = drawn.withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order)))
    p, s, m = (F.instr("output", F.lit(mark)) for mark in (PREFIX, SUFFIX, MIDDLE))
    cut = F.col("form") != "plain"
    return made.select(
        "doc_id", "n", "form",
        F.when(cut, F.when(F.col("form") == "spm", m - p - 3).otherwise(s - p - 3)).cast("bigint").alias("prefix_chars"),
        F.when(cut, F.length("output") - m - 2).cast("bigint").alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: its parts hold no marker, so the first of each is the real one."""
    p, s, m = (F.instr(output, F.lit(mark)) for mark in (PREFIX, SUFFIX, MIDDLE))
    part = lambda start, end: F.substring(output, start + 3, end - start - 3)
    middle = F.substring(output, m + 3, F.length(output))
    return F.when(form == "spm", F.concat(part(p, m), middle, part(s, p))).when(form == "psm", F.concat(part(p, s), middle, part(s, m))).otherwise(output)
