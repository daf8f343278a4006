"""Quality rules on lines that many documents of one host share, in DataFrame operations only.

Lines are normalised and hashed; per host the distinct documents with a line are counted; lines above the host's limit
are taken as boilerplate; a document that keeps too few of its words without them is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import stage

SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that the text holds twice or more, each word counted once."""

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda p, q: F.least(F.lit(WINDOW), q - p))
        return F.lit(WINDOW) + F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def neighbours(s: Column) -> Column:
        pairs = F.zip_with(
            F.slice(s, 1, F.size(s) - 1),
            F.slice(s, 2, F.size(s) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return bound(F.array_sort(F.array_distinct(F.flatten(pairs))), covered)

    def windows(h: Column) -> Column:
        heads = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        hashes = F.transform(heads, lambda first, i: F.xxhash64(first, *(F.get(h, i + k) for k in range(1, WINDOW))))

        def count(h: Column) -> Column:
            rows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(F.array_sort(rows), neighbours))

        return bound(hashes, count)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(bound(F.transform(words, lambda w: F.xxhash64(w)), windows))


def _dup_lines(text: Column) -> Column:
    with_words = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0)
    return bound(with_words, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def base_figures(docs: DataFrame) -> DataFrame:
    """``docs`` with column ``text`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    figures = docs.withColumn(
        "_f",
        bound(
            word_array(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")),
        ),
    )
    return figures.select(
        *docs.columns,
        "_f.n_words",
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines(text).cast("long").alias("n_dup_lines"),
        "_f.n_repeat_words",
        ((F.col("_f.n_words") < 20) | (100 * F.col("_f.n_repeat_words") > 30 * F.col("_f.n_words"))).alias("base_failed"),
    )


def host_lines(docs: DataFrame) -> DataFrame:
    """(host, text_hash, line_hash, words) of every line with a word; lines alike but for case, digits and spacing agree."""
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    lines = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("source"), F.lit("")).alias("host"),
        F.xxhash64("text").alias("text_hash"),
        F.explode(F.split(lowered, "\n", -1)).alias("line"),
    )
    words = word_array(F.col("line"))
    return lines.select("host", "text_hash", bound(words, lambda w: F.struct(F.xxhash64(w).alias("line_hash"), F.size(w).alias("words"))).alias("_l")).select(
        "host", "text_hash", "_l.line_hash", "_l.words"
    ).where(F.col("words") > 0)


def frequent_lines(lines: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, line_hash) of lines in more than ``min_docs`` distinct texts and ``share`` of the host's distinct texts."""
    counts = lines.select("host", "line_hash", "text_hash").distinct().groupBy("host", "line_hash").agg(F.count("*").alias("n_docs"))
    hosts = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("host_docs"))
    return counts.where(F.col("n_docs") > min_docs).join(hosts, "host").where(F.col("n_docs") > limit).select("host", "line_hash")


def quality_rules(docs: DataFrame, min_docs: int = 10, share: float = 0.01, min_left: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): the base figures, n_removed_words and whether the document is kept.

    A line is removed on a host when more than ``min_docs`` distinct texts and more than ``share`` of the host's distinct
    texts have it; copies of one text count once, so copying alone makes no line boilerplate. A document is rejected when
    the base rules fail or less than ``min_left`` of its words are left.

    Defined cases: a null text is an empty one, with 0 words, and fails the base rules; a null source is a host of its
    own; null doc_ids and repeated rows stay, each with the same result; other columns are ignored; no rows give no rows.
    Texts are split into lines once and never shuffled: hashes and counts are staged, and all passes send those only.
    """
    lines = stage(host_lines(docs.select("text", "source")), "host-lines")
    frequent = frequent_lines(lines, min_docs, share).withColumn("gone", F.lit(True))
    left = (
        lines.join(frequent, ["host", "line_hash"], "left")
        .groupBy("host", "text_hash")
        .agg((F.sum(F.when(F.col("gone"), F.col("words")).otherwise(0)) / F.sum("words")).alias("gone_share"))
        .where("gone_share > 0")
    )
    rows = base_figures(docs.select("doc_id", "text", "source")).select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("host"),
        F.xxhash64("text").alias("text_hash"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    )
    gone = F.coalesce(F.col("gone_share"), F.lit(0.0))
    return rows.join(left, ["host", "text_hash"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (1 - gone >= min_left)).alias("kept"),
        F.round(gone * F.col("n_words")).cast("long").alias("n_removed_words"),
    )
