"""Exact n-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its word shingles. Sets fall into size bands; in a band the feature domain is cut into
more partitions than two linked sets can differ in, so any two of them agree on a whole partition. The content of each
non-empty partition is a signature. Sets that share one are candidates and are compared exactly.

Why no link is lost. For sizes a <= b with Jaccard >= 3/4, the symmetric difference is at most (a + b) / 7 and b <= 4a/3.
A set signs for its own band and, as the smaller set, for the next one. A set with more non-empty partitions than the
difference can touch shares a non-empty one with each partner; the rare set with fewer also signs each single feature, on
which two such sets must meet. Signatures of many sets (common passages) are left out for a set with enough others: with
all rare signatures ordered first, the first k + 1 of both sets' orders have a common one (prefix filtering).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerline.llm.components import connected_components
from ledgerline.llm.words import BATCH_ROWS, Words, mix, sequence_hash, settings, window_hashes, word_slices
from ledgerline.session import stage

SHINGLE = 5
PARTS = 0.5  # partitions of a band per feature of its largest set; over 2/7, so that common signatures can be left out
COMMON = 8  # a signature of more sets is common
BINS = 128
COARSE = 64  # parts of the sketch that joins compare
BUCKET_SIGNATURES = 3_000_000  # signatures in one task of the grouping, which sets the number of buckets
SIGNATURES_PER_BYTE = 0.17
SIGNATURE_BYTES = 5  # kept of a signature in its bucket; a chance meeting only costs a comparison


def shingle_sets(words: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a shorter text is one shingle, one without words none."""
    hashes = words.hashes()
    shingles = window_hashes(hashes, size)
    for at, to in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if to - at >= size:
            yield np.unique(shingles[at : to - size + 1])
        elif to > at:
            yield np.array([sequence_hash(hashes[at:to])], dtype=np.uint64)
        else:
            yield shingles[:0]


def set_class(features: np.ndarray) -> int:
    """64 bits that stand for a set: two different sets among a thousand million meet with a chance of 3 in 100."""
    return int(mix(features).sum().astype(np.int64))


def band_of(n: int) -> tuple[int, int]:
    """Number and largest size of the band of sets of ``n`` features; bounds are 1, 2, 3, 4 and then a third more each."""
    k, top = 0, 1
    while top < n:
        top = max(top + 1, top * 4 // 3)
        k += 1
    return k, top


def band_signatures(features: np.ndarray, band: int, top: int) -> tuple[np.ndarray, int]:
    """The set's signatures in a band, and how many of them a partner there can miss.

    With no more non-empty partitions than that, the single features are added.
    """
    n = len(features)
    parts = int(PARTS * top) + 2
    part = ((features >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    salt = mix(np.array([band + 1], dtype=np.uint64))[0]
    signatures = mix(np.add.reduceat(mix(features ^ salt), first) + part[first] * np.uint64(0x9E3779B97F4A7C15) + salt)
    most = (n + min(top, n * 4 // 3)) // 7
    if len(signatures) <= most:
        signatures = np.concatenate((signatures, mix(features + salt)))
        most = len(signatures)  # of such a set no signature may be left out
    return signatures, most


def signatures(features: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
    """(role, signatures, may miss) in the set's own band (role 0) and, where a larger partner may be, the next (role 1)."""
    band, top = band_of(len(features))
    found = [(0, *band_signatures(features, band, top))]
    if len(features) * 4 // 3 > top:
        found.append((1, *band_signatures(features, band + 1, max(top + 1, top * 4 // 3))))
    return found


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


CLASSES = "doc_id long, n_shingles long, cls long, spare_own long, spare_next long, sketch binary, coarse array<short>"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, class and sketch of each document's set, and how many signatures of each role it can do without.

    The sketch counts the features in ``BINS`` parts of the domain, or about a quarter as many as features where that is
    more, up to 255 each. Two sketches never differ by more than the symmetric difference of the sets.
    """
    for batch in batches:
        rows = []
        for words in word_slices(_column(batch, "text")):
            for features in shingle_sets(words):
                if len(features):
                    spare = {role: len(s) - most for role, s, most in signatures(features)}
                    bins = max(BINS, 1 << (len(features) // 4).bit_length())
                    sketch = np.minimum(np.bincount((features % np.uint64(bins)).view(np.int64), minlength=bins), 255).astype(np.uint8)
                    rows.append((len(features), set_class(features), spare[0], spare.get(1, 0), sketch.tobytes(), _folded(sketch, COARSE)))
                else:
                    rows.append((0, 0, 0, 0, b"", []))
        columns = [_column(batch, "doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))]
        columns += [pa.array([r[4] for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.list_(pa.int16()))]
        yield pa.RecordBatch.from_arrays(
            columns, names=["doc_id", "n_shingles", "cls", "spare_own", "spare_next", "sketch", "coarse"]
        )


def _folded(sketch: np.ndarray, parts: int) -> np.ndarray:
    return np.minimum(sketch.reshape(-1, parts).sum(axis=0, dtype=np.int64), 32767)


SIGNED = "bucket int, cls binary, own binary, next binary, signatures binary"


def _signed(buckets: int):
    """Signatures of the texts, packed by bucket: classes, how many signatures of either role each has there, and these.

    Copies that one slice of texts holds sign once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(_column(batch, "text")):
                found = {set_class(f): f for f in shingle_sets(words) if len(f)}
                if found:
                    yield _packed(list(found), [signatures(f) for f in found.values()], buckets)

    return run


def _packed(classes: list[int], signed: list[list[tuple[int, np.ndarray, int]]], buckets: int) -> pa.RecordBatch:
    values = np.concatenate([values for roles in signed for _, values, _ in roles])
    owner = np.repeat([2 * k + role for k, roles in enumerate(signed) for role, _, _ in roles], [len(v) for roles in signed for _, v, _ in roles])
    bucket = (((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, values, owner = bucket[order], values[order], owner[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES]
    cls = np.array(classes, dtype="<i8")
    rows: list[tuple[int, bytes, bytes, bytes, bytes]] = []
    for at, to in zip(edges[:-1].tolist(), edges[1:].tolist()):
        counts = np.bincount(owner[at:to], minlength=2 * len(cls)).astype("<u2").reshape(-1, 2)
        here = counts.any(axis=1)
        counts = counts[here]
        rows.append((int(bucket[at]), cls[here].tobytes(), counts[:, 0].tobytes(), counts[:, 1].tobytes(), low[at:to].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))],
        names=["bucket", "cls", "own", "next", "signatures"],
    )


GROUPED = "gid long, shared int, cls long, role int, times int"


def _grouped(rows: pd.DataFrame) -> pd.DataFrame:
    """Groups of classes that share a signature of this bucket, alike groups once; ``shared`` is a group's size."""
    cls = np.concatenate([np.frombuffer(x, dtype="<i8") for x in rows["cls"]])
    counts = np.stack([np.concatenate([np.frombuffer(x, dtype="<u2") for x in rows[role]]) for role in ("own", "next")], axis=1).ravel()
    packed = np.frombuffer(b"".join(rows["signatures"]), dtype=np.uint8).reshape(-1, SIGNATURE_BYTES)
    values = np.zeros((len(packed), 8), dtype=np.uint8)
    values[:, :SIGNATURE_BYTES] = packed
    values = values.view("<u8").ravel()
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    same = values[1:] == values[:-1]
    keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    values, owner = values[keep], owner[keep]
    members, roles = cls[owner >> 1], (owner & 1).astype(np.int32)
    order = np.lexsort((members, values))
    values, members, roles = values[order], members[order], roles[order]
    if len(values):  # a class that several tasks have met counts once
        keep = np.concatenate(([True], (values[1:] != values[:-1]) | (members[1:] != members[:-1])))
        values, members, roles = values[keep], members[keep], roles[keep]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        size = np.diff(np.append(first, len(values)))
        gid = mix(np.add.reduceat(mix(members.view(np.uint64) * np.uint64(2) + roles.astype(np.uint64)), first)).view(np.int64)
        gid, size = np.repeat(gid, size), np.repeat(size, size)
        keep = size > 1
        found = pd.DataFrame({"gid": gid[keep], "shared": size[keep].astype(np.int32), "cls": members[keep], "role": roles[keep]})
    else:
        found = pd.DataFrame({"gid": members, "shared": roles, "cls": members, "role": roles})
    times = found.groupby(["gid", "shared", "cls", "role"], as_index=False).size()
    return times.rename(columns={"size": "times"}).astype({"times": np.int32})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the wanted classes; a text of another class under the same doc_id is passed over."""
    for batch in batches:
        wanted = _column(batch, "cls").to_pylist()
        sets = [f for words in word_slices(_column(batch, "text")) for f in shingle_sets(words)]
        found = [(c, f.tobytes()) for c, f in zip(wanted, sets) if len(f) and set_class(f) == c]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in found], pa.int64()), pa.array([f for _, f in found], pa.binary())], names=["cls", "features"]
        )


@F.pandas_udf(BooleanType())
def linked(a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    """Whether 100 * intersection >= percent * union of two sets."""
    found = []
    for x, y, p in zip(a, b, percent):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        found.append(100 * both >= p * (len(x) + len(y) - both))
    return pd.Series(found, dtype=bool)


@F.pandas_udf(BooleanType())
def may_link(a: pd.Series, b: pd.Series, sizes: pd.Series) -> pd.Series:
    """Whether two sketches differ by no more than linked sets of so many features together can."""
    found = []
    for x, y, n in zip(a, b, sizes):
        x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
        parts = min(len(x), len(y))  # the finer one is folded
        found.append(7 * int(np.abs(_folded(x, parts) - _folded(y, parts)).sum()) <= n)
    return pd.Series(found, dtype=bool)


def _plausible(pairs: DataFrame, holders: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and sketches allow a link."""
    one = holders.select(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    two = holders.select(F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    sized = pairs.join(one, "u").join(two, "v").where("4 * least(nu, nv) >= 3 * greatest(nu, nv)")
    return sized.where(may_link("su", "sv", F.col("nu") + F.col("nv"))).select("u", "v")


def _verified(pairs: DataFrame, docs: DataFrame, holders: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link, compared in full.

    Only the texts of classes in a pair are shuffled: Spark's runtime Bloom filter thins the scan before the join. A class
    that is compared with many meets them in a join that adaptive execution can split.
    """
    ends = pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct()
    wanted = stage(holders.select("doc_id", "cls", "n").join(ends, "cls", "left_semi"), "wanted").where("n > 0")
    texts = docs.join(wanted.select("doc_id", "cls"), "doc_id")
    sets = texts.select("cls", "text").mapInArrow(_sets, "cls long, features binary")
    left = sets.select(F.col("cls").alias("v"), F.col("features").alias("fv"))
    right = sets.select(F.col("cls").alias("u"), F.col("features").alias("fu"))
    return pairs.join(left, "v").join(right, "u").where(linked("fu", "fv", F.lit(percent))).select("u", "v")


def _open_pair() -> Column:
    """Whether classes x and y, each pair in one order, are in two components and have sizes and sketches that allow a link."""
    apart = F.aggregate(F.zip_with("x.coarse", "y.coarse", lambda a, b: F.abs(a - b).cast("int")), F.lit(0), lambda a, d: a + d)
    return (
        (F.col("x.cls") < F.col("y.cls"))
        & (F.col("x.root") != F.col("y.root"))
        & (4 * F.least("x.n", "y.n") >= 3 * F.greatest("x.n", "y.n"))
        & (7 * apart <= F.col("x.n") + F.col("y.n"))
    )


def _within_pivots(members: DataFrame) -> DataFrame:
    """Pairs of classes with one best-connected class that are not in one component and whose sketches allow a link.

    Such classes share many signatures, so they meet here once and not at every signature.
    """
    condition = (F.col("x.pivot") == F.col("y.pivot")) & _open_pair()
    return members.alias("x").join(members.alias("y"), condition).select(F.col("x.cls").alias("u"), F.col("y.cls").alias("v"))


def _across_pivots(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The other pairs of classes that share a signature both need, are not in one component and whose sketches allow a link."""
    placed = groups.where("needed").select("gid", "cls").join(members.select("cls", "n", "coarse", "pivot", "root"), "cls")
    mixed = placed.groupBy("gid").agg(*(f(c).alias(f"{k}_{c}") for c in ("root", "pivot") for k, f in (("a", F.min), ("b", F.max))))
    mixed = mixed.where("a_root <> b_root AND a_pivot <> b_pivot").select("gid")
    placed = stage(placed.join(mixed, "gid"), "open-groups")
    condition = (F.col("x.gid") == F.col("y.gid")) & (F.col("x.pivot") != F.col("y.pivot")) & _open_pair()
    return placed.alias("x").join(placed.alias("y"), condition).select(F.col("x.cls").alias("u"), F.col("y.cls").alias("v"))


def _groups(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(gid, shared, cls, needed) of the groups that can hold a link.

    A class that can spare all its common signatures is left out of their groups. Of the others' common signatures the most
    common ones, as many as the class can spare, are not ``needed``: linked classes also share one that both need.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, math.ceil(size * SIGNATURES_PER_BYTE / BUCKET_SIGNATURES))
    signed = docs.select("text").mapInArrow(_signed(buckets), SIGNED)
    grouped = signed.groupBy("bucket").applyInPandas(_grouped, GROUPED)
    groups = stage(grouped.groupBy("gid", "shared", "cls", "role").agg(F.sum("times").alias("times")), "signature-groups")
    spare = classes.groupBy("cls").agg(F.first("spare_own").alias("spare_own"), F.first("spare_next").alias("spare_next"))
    rare = groups.where(F.col("shared") <= COMMON).withColumn("needed", F.lit(True))
    role = W.partitionBy("cls", "role")
    most_common_first = role.orderBy(F.desc("shared"), F.desc("gid")).rowsBetween(W.unboundedPreceding, 0)
    common = groups.where(F.col("shared") > COMMON).withColumns(
        {"upto": F.sum("times").over(most_common_first), "all": F.sum("times").over(role)}
    )
    to_spare = F.when(F.col("role") == 0, F.col("spare_own")).otherwise(F.col("spare_next"))
    kept = common.join(spare, "cls").where(F.col("all") >= to_spare).withColumn("needed", F.col("upto") >= to_spare)
    every = rare.unionByName(kept.select(rare.columns)).groupBy("gid", "cls")
    figures = [F.max("shared").alias("shared"), F.sum("times").alias("times"), F.max("needed").alias("needed")]
    return stage(every.agg(*figures), "candidate-groups")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * intersection >= 75 * union of their sets of 5-word shingles. The guarantee is built on
    3/4; a higher ``percent`` compares more strictly. Equal sets are one class, so copies are never paired. First each
    class is compared with the best-connected class that shares a signature with it, which joins a group of copies
    whatever its size in one comparison a member; then all classes that share a signature but not yet a component.

    Defined cases: texts without words, empty or null have n_shingles 0 and their own doc_id as component; a repeated row
    links with its equal; a row without a doc_id links with nothing and has no component_id; other columns are ignored; no
    rows give none.
    """
    if percent < 75:
        raise ValueError("the signatures find links of 75 percent or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The runtime filter is Spark's own default for scans over 10 GB; here it serves smaller ones as well.
    with settings(docs.sparkSession, BATCH_ROWS | {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}):
        return _near_duplicates(docs, percent)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    every, docs = docs, docs.where(F.col("doc_id").isNotNull())
    classes = stage(every.mapInArrow(_classes, CLASSES), "set-classes")
    own = classes.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    groups = _groups(docs, own)

    weight = groups.groupBy("cls").agg(F.sum(F.col("shared") * F.col("times")).alias("weight"))
    weighted = groups.select("gid", "cls").join(weight, "cls")
    best = weighted.groupBy("gid").agg(F.max(F.struct("weight", "cls")).alias("best"))
    pivots = (
        weighted.join(best, "gid")
        .where(F.struct("weight", "cls") < F.col("best"))
        .groupBy(F.col("cls").alias("v"))
        .agg(F.max("best").alias("best"))
        .select("v", F.col("best.cls").alias("u"))
    )
    pivots = stage(pivots, "pivots")

    holders = own.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("coarse").alias("coarse"))
    holders = stage(holders, "holders")
    first_links = stage(_verified(stage(_plausible(pivots, holders), "first-pairs"), docs, holders, percent), "links")
    labels = connected_components(first_links)
    members = (
        holders.join(groups.select("cls").distinct(), "cls", "left_semi")
        .join(pivots.select(F.col("v").alias("cls"), F.col("u").alias("pivot")), "cls", "left")
        .join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        .select("cls", "n", "coarse", F.coalesce("pivot", "cls").alias("pivot"), F.coalesce("root", "cls").alias("root"))
    )
    members = stage(members, "members")
    pairs = _within_pivots(members).unionByName(_across_pivots(groups, members)).distinct()
    across = stage(_plausible(pairs, holders), "pairs")
    links = first_links.unionByName(_verified(across, docs, holders, percent))
    roots = connected_components(stage(links, "all-links"))

    rows = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "cls")).alias("root")
    )
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )
