"""Recurring lines dropped by a log-template tree of fixed depth.

A record is a sentence or the part of a line that holds one. Words with a digit in it are fields from the start. The tree has
the token count on its first level and the leading tokens on the next ones; records of one leaf are generalised by segments of
their other tokens: a segment that several documents have is kept, any other becomes a field. Templates that recur in several
documents are dropped wherever they stand.

Documents that copy one another count as one, whatever the templates: texts that are equal, and texts whose sets of 5-word
shingles are alike by their min-hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerline.llm.components import connected_components
from ledgerline.llm.words import BATCH_ROWS, DIGITS, Words, column, has_byte, mix, settings, unit_starts, window_hashes, word_slices
from ledgerline.session import stage

LEADING = 3  # tokens on the levels below the token count
SEGMENTS = 4
MIN_TOKENS = 4  # a shorter record falls only between dropped ones
FIXED = 0.6  # share of a template's tokens that are literal words, neither fields nor words with a digit
SHINGLE = 5
ALIKE = 0.7  # estimated similarity of the shingles of copies; near-duplicates have 0.75, and the estimate is 0.03 off
BINS_LOG = 8  # a sketch has 256 bins, each with the least hash of its part of the domain
BANDS, BAND = 20, 3  # bins that two texts must share to be compared; at a similarity of 0.75 once in 50,000 times no band does
EMPTY = np.uint16(0xFFFF)
SLICE = 300_000  # bytes of text in work at a time, as two tasks and their arrays share an executor with its heap
SEEN = 1_000_000  # texts that a task remembers, so that it sends the records of a repeated text once
BROADCAST_CLASSES = 1_000_000  # of 16 bytes
_FIELD = mix(np.array([3], dtype=np.uint64))[0]
RECORDS = "row_key long, record int, n_tokens int, leaf long, s0 int, s1 int, s2 int, s3 int, l0 int, l1 int, l2 int, l3 int, head int"


def _sum_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return sums[ends] - sums[starts]


def record_table(words: Words) -> tuple[np.ndarray, ...]:
    """Text, number in the text, token count, leaf, segment hashes, and literal words by segment and at the head of each record."""
    tokens = words.hashes()
    fields = has_byte(words, DIGITS)
    tokens[fields] = _FIELD
    starts = unit_starts(words)
    ends = np.append(starts[1:], len(tokens))
    n = ends - starts
    text = np.searchsorted(words.bounds, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, words.bounds[:-1])[text]
    place = np.arange(len(tokens)) - np.repeat(starts, n)
    placed = mix(tokens + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    head = np.minimum(n, LEADING)
    leaf = mix(_sum_runs(placed, starts, starts + head) + n.astype(np.uint64))
    cuts = [starts + head + (n - head) * k // SEGMENTS for k in range(SEGMENTS + 1)]
    segments = [(_sum_runs(placed, a, b) >> np.uint64(32)).astype(np.uint32).view(np.int32) for a, b in zip(cuts, cuts[1:])]
    literal = (~fields).astype(np.int64)
    literals = [_sum_runs(literal, a, b) for a, b in [*zip(cuts, cuts[1:]), (starts, starts + head)]]
    return (text, number, n, leaf.view(np.int64), *segments, *literals)


def _leaves_by_text(text: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, leaf) without repetitions."""
    order = np.lexsort((leaf, text))
    text, leaf = text[order], leaf[order]
    new = np.ones(len(leaf), dtype=bool)
    new[1:] = (leaf[1:] != leaf[:-1]) | (text[1:] != text[:-1])
    return text[new], leaf[new]


def _new_texts(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows hold a text that the task has not met."""
    if len(seen) > SEEN:
        seen.clear()
    new = np.zeros(len(keys), dtype=bool)
    for k, key in enumerate(keys.tolist()):
        if key not in seen:
            seen.add(key)
            new[k] = True
    return new


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.int32() for f in RECORDS.split(", ")]
    seen: set[int] = set()
    for batch in batches:
        keys = column(batch, "row_key").to_numpy()
        new = _new_texts(keys, seen)
        for words in word_slices(column(batch, "text"), SLICE):
            text, *rest = record_table(words)
            whole = rest[1] >= MIN_TOKENS
            keep = whole & new[words.first + text]
            arrays = [keys[words.first + text[keep]], *(x[keep] for x in rest)]
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(k) for x, k in zip(arrays, kinds)], names=names)


def _least_by_bin(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts with a shingle, and for each the least hash in every bin, the highest number in empty ones."""
    shingles = window_hashes(words.hashes(), SHINGLE)
    inside = np.ones(len(shingles), dtype=bool)
    for back in range(1, SHINGLE):  # windows that reach into the next text
        ends = words.bounds[1:] - back
        inside[ends[(ends >= 0) & (ends < len(shingles))]] = False
    text = np.searchsorted(words.bounds, np.arange(len(shingles)), side="right") - 1
    shingles, text = shingles[inside], text[inside]
    most = np.uint64((1 << 64) - 1)
    least = np.full(words.n_texts << BINS_LOG, most, dtype=np.uint64)
    np.minimum.at(least, (text << BINS_LOG) + (shingles >> np.uint64(64 - BINS_LOG)).view(np.int64), shingles)
    least = least.reshape(words.n_texts, 1 << BINS_LOG)
    filled = np.flatnonzero((least != most).any(axis=1))
    return filled, least[filled]


def _bands(least: np.ndarray) -> np.ndarray:
    """Hashes of groups of bins; an empty bin takes the value of the next filled one."""
    most = np.uint64((1 << 64) - 1)
    size = least.shape[1]
    place = np.where(np.tile(least, 2) != most, np.arange(2 * size), 4 * size)
    following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :size] % size
    values = np.take_along_axis(least, following, axis=1)
    at = (np.arange(BANDS * BAND) * size // (BANDS * BAND)).reshape(BANDS, BAND)
    bands = np.zeros((len(least), BANDS), dtype=np.uint64)
    for k in range(BAND):
        bands = mix(bands + values[:, at[:, k]] + np.arange(1, BANDS + 1, dtype=np.uint64))
    return bands.view(np.int64)


OVERVIEW = "leaf long, n_docs long, row_key long, n_words long, sketch binary, bands array<long>"


def _overview(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf with the number of texts of a slice that hold it, and a row for each text with a shingle, with its sketch;
    of a text that the task has met, no leaves and no sketch."""
    names = [f.split()[0] for f in OVERVIEW.split(", ")]
    kinds = [*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64())]
    seen: set[int] = set()
    for batch in batches:
        keys = column(batch, "row_key").to_numpy()
        new = _new_texts(keys, seen)
        for words in word_slices(column(batch, "text"), SLICE):
            text, _, n, leaf, *_ = record_table(words)
            keep = (n >= MIN_TOKENS) & new[words.first + text]
            leaf, counts = np.unique(_leaves_by_text(text[keep], leaf[keep])[1], return_counts=True)  # summed before any shuffle
            filled, least = _least_by_bin(words)
            fresh = new[words.first + filled]
            sketches = np.where(least == np.uint64((1 << 64) - 1), EMPTY, (mix(least) & np.uint64(0x7FFF)).astype(np.uint16))
            shown = [x.tobytes() if f else None for x, f in zip(sketches, fresh)]
            bands = [x if f else None for x, f in zip(_bands(least).tolist(), fresh)]
            for columns in (
                [leaf, counts, None, None, None, None],
                [None, None, keys[words.first + filled], np.diff(words.bounds)[filled], shown, bands],
            ):
                size = next(len(c) for c in columns if c is not None)
                arrays = [pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


@F.pandas_udf(BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the similarity of two texts, estimated from the bins that either fills, is at least ``ALIKE``."""
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), -1) for s in (a, b))
    used = ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
    return pd.Series(((x == y) & (x != EMPTY)).sum(axis=1) >= ALIKE * used)


def copies(texts: DataFrame) -> DataFrame:
    """(row_key, class) of the ``texts`` (row_key, n_copies, sketch, bands) that are alike to another one; ``class`` is the
    same for all that such links join.

    Texts with a band in common are compared with the one of them that is repeated most, so a group of any size costs one
    comparison a text and band.
    """
    signed = texts.select("row_key", "n_copies", F.explode("bands").alias("band"))
    first = signed.groupBy("band").agg(F.min(F.struct(-F.col("n_copies"), "row_key")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("band", F.col("first.row_key").alias("first"))
    pairs = signed.join(first, "band").where(F.col("row_key") != F.col("first")).select("row_key", "first").distinct()
    others = texts.select(F.col("row_key").alias("first"), F.col("sketch").alias("f_sketch"))
    linked = pairs.join(texts.select("row_key", "sketch"), "row_key").join(others, "first").where(alike("sketch", "f_sketch"))
    links = stage(linked.select(F.col("row_key").alias("u"), F.col("first").alias("v")), "copy-links")
    return connected_components(links).select(F.col("node").alias("row_key"), F.col("root").alias("class"))


def recurring_records(keyed: DataFrame, min_docs: int, passage_docs: int, most: float) -> DataFrame:
    """(row_key, record, often) of the records of ``keyed`` (row_key, text) whose template recurs in ``passage_docs`` documents
    or more; ``often`` says whether in ``min_docs``. Texts that copy one another count as one document; if more than ``most`` of
    the words of one of them recur, none of them has any."""
    overview = stage(keyed.mapInArrow(_overview, OVERVIEW), "overview")
    leaves = overview.where(F.col("leaf").isNotNull()).groupBy("leaf").agg(F.sum("n_docs").alias("n_docs"))
    shared = stage(leaves.where(F.col("n_docs") >= passage_docs).select("leaf"), "shared-leaves")
    records = stage(keyed.mapInArrow(_records, RECORDS).join(shared, "leaf"), "shared-records")
    firsts = (F.first(c, ignorenulls=True).alias(c) for c in ("n_words", "sketch", "bands"))
    texts = overview.where(F.col("row_key").isNotNull()).groupBy("row_key").agg(F.count("*").alias("n_copies"), *firsts)
    texts = stage(texts, "sketches")
    classes = stage(copies(texts), "copies")
    few = F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes
    records = records.join(few, "row_key", "left").withColumn("class", F.coalesce("class", "row_key"))
    segments = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("hash"), F.col(f"l{k}").alias("literal")) for k in range(SEGMENTS)))
    # Of a record of under seven tokens some segments are empty.
    first, end = (F.floor((F.col("n_tokens") - LEADING) * (F.col("s.k") + k) / SEGMENTS) for k in (0, 1))
    parts = records.select("row_key", "class", "record", "leaf", "n_tokens", "head", F.explode(segments).alias("s")).where(first < end).select(
        "row_key", "class", "record", "leaf", "n_tokens", "head", "s.k", "s.hash", "s.literal"
    )
    fixed = parts.select("leaf", "k", "hash", "class").distinct().groupBy("leaf", "k", "hash").count()
    fixed = fixed.where(F.col("count") >= passage_docs).select("leaf", "k", "hash", F.lit(True).alias("fixed"))
    kept = [F.max(F.when(F.col("fixed") & (F.col("k") == k), F.col("literal"))) for k in range(SEGMENTS)]
    hashes = [F.max(F.when(F.col("fixed") & (F.col("k") == k), F.col("hash"))) for k in range(SEGMENTS)]
    templates = (
        parts.join(fixed, ["leaf", "k", "hash"], "left")
        .groupBy("row_key", "class", "record", "leaf", "n_tokens", "head")
        .agg(
            sum((F.coalesce(x, F.lit(0)) for x in kept), F.lit(0)).alias("kept"),
            F.xxhash64("leaf", *(F.coalesce(h.cast("long"), F.lit(1 << 40)) for h in hashes)).alias("template"),
        )
        .where(F.col("kept") + F.col("head") >= FIXED * F.col("n_tokens"))
        .select("row_key", "class", "record", "n_tokens", "template")
    )
    templates = stage(templates, "templates")
    often = templates.select("template", "class").distinct().groupBy("template").count().where(F.col("count") >= passage_docs)
    often = often.select("template", (F.col("count") >= min_docs).alias("often"))
    found = stage(templates.join(often, "template"), "recurring-records")

    # Copies of one text that consist of templates for the most part are for near-duplicate search to decide on.
    repeated = texts.where("n_copies > 1").select(F.col("row_key").alias("class"))
    several = classes.select("class").union(repeated).distinct()
    heavy = found.groupBy("row_key", "class").agg(F.sum("n_tokens").alias("n")).join(texts.select("row_key", "n_words"), "row_key")
    heavy = heavy.where(F.col("n") > most * F.col("n_words")).select("class").distinct().join(several, "class")
    return found.join(heavy, "class", "left_anti").select("row_key", "record", "often")


def _stretches(gone: np.ndarray, short: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last record of each run of ``gone`` records, ``short`` ones between them included."""
    k = 0
    while k < len(gone):
        if not gone[k]:
            k += 1
            continue
        to = k
        while to + 1 < len(gone):
            ahead = to + 1
            while ahead < len(gone) and short[ahead] and not gone[ahead]:
                ahead += 1
            if ahead >= len(gone) or not gone[ahead]:
                break
            to = ahead
        yield k, to
        k = to + 1


def cut_text(data: np.ndarray, words: Words, text: int, dropped: np.ndarray, often: np.ndarray, run_tokens: int, passage: int) -> tuple[bytes, int]:
    """The text's bytes without runs of dropped records, and how many words went. ``often`` flags the records that any run
    may hold; the others only count in runs of ``passage`` words or more."""
    first, last = int(words.bounds[text]), int(words.bounds[text + 1])
    begin, end = int(words.text_starts[text]), int(words.text_starts[text + 1])
    data = data[begin:end]  # from here on positions count from the text's first byte
    own = words.starts[first:last] - begin, words.ends[first:last] - begin
    begin, end = 0, end - begin
    part = Words(0, data, *own, np.array([0, last - first]), np.array([begin, end]))
    starts = unit_starts(part)
    ends = np.append(starts[1:], last - first)
    gone, strong = np.zeros(len(starts), dtype=bool), np.zeros(len(starts), dtype=bool)
    gone[dropped[dropped < len(starts)]] = True
    strong[dropped[often & (dropped < len(starts))]] = True
    short = ends - starts < MIN_TOKENS
    runs = []
    for k, to in _stretches(gone, short):
        if ends[to] - starts[k] >= passage:
            runs.append((int(starts[k]), int(ends[to])))
            continue
        for x, y in _stretches(strong[k : to + 1], short[k : to + 1]):
            if ends[k + y] - starts[k + x] >= run_tokens:
                runs.append((int(starts[k + x]), int(ends[k + y])))
    lost = sum(b - a for a, b in runs)
    if not lost:
        return data[begin:end].tobytes(), 0
    kept, at = [], begin
    for a, b in runs:
        to = int(own[0][a])
        kept.append(data[at:to].tobytes())
        at = int(own[0][b]) if b < last - first else end
        gap = data[int(own[1][b - 1]) : at]
        if (gap == 10).any() and kept[-1].rstrip(b" \t") and not kept[-1].rstrip(b" \t").endswith(b"\n"):
            kept.append(b"\n")
    kept.append(data[at:end].tobytes())
    return b"".join(kept), lost


def drop_recurring_lines(docs: DataFrame, min_docs: int = 3, run_tokens: int = 5, passage: int = 50, passage_docs: int = 2, most: float = 0.6) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with recurring records cut from ``text``, and n_words_dropped.

    A record goes when its template recurs in ``min_docs`` documents and it stands in a run of such records of at least
    ``run_tokens`` tokens, or in ``passage_docs`` documents in a run of at least ``passage`` tokens; records of under 4 tokens
    go only between others that do. Documents that copy one another count as one, and stay whole when templates are more than
    ``most`` of one of them: near-duplicate search decides on copies. A template is mostly literal words: records of figures, or of few words among many
    figures, stay. A word that varies among the first three of a record gives another leaf and is not generalised. What is
    left keeps its line breaks and spacing.

    Defined cases: null and empty texts stay as they are; doc_id plays no part, and repeated rows stay and count as one
    document; a column of the input named n_words_dropped is replaced, all others stay, whatever their names; no rows give no
    rows. Only records in leaves that several texts share are shuffled in full, then texts once, to meet the numbers of their
    dropped records.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "n_words_dropped"]
    key, numbers = (next(n for n in (f"{'_' * k}{name}" for k in range(1, len(names) + 3)) if n not in names) for name in ("text_key", "numbers"))
    texts = docs.select(F.xxhash64("text").alias("row_key"), "text").where(F.length("text") > 0)
    with settings(spark, BATCH_ROWS):
        records = recurring_records(texts, min_docs, passage_docs, most)
        signed = F.when(F.col("often"), F.col("record")).otherwise(-F.col("record") - 1)
        dropped = records.groupBy(F.col("row_key").alias(key)).agg(F.collect_set(signed).alias(numbers))
        dropped = stage(dropped, "dropped-records")
    schema = docs.select(*names).schema.add("n_words_dropped", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, numbers).to_pylist()
            texts, lost = [], [0] * batch.num_rows
            for words in word_slices(column(batch, "text"), SLICE):
                for k in range(words.n_texts):
                    found = np.array(lists[words.first + k] or [], dtype=np.int64)
                    if len(found):
                        often = found >= 0
                        found = np.where(often, found, -found - 1)
                        text, lost[words.first + k] = cut_text(words.data, words, k, found, often, run_tokens, passage)
                        texts.append(text.decode())
                    else:
                        texts.append(None)
            changed = pa.array([n > 0 for n in lost])
            old = column(batch, "text")
            new = pa.compute.if_else(changed, pa.array(texts, old.type), old)
            arrays = [new if c == "text" else column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lost, pa.int64())], names=[*names, "n_words_dropped"])

    keyed = docs.select(*names, F.xxhash64("text").alias(key))
    return keyed.join(dropped, key, "left").select(*names, numbers).mapInArrow(cut, schema)
