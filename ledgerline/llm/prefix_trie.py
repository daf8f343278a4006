"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations that begin with the same turns share nodes. What a node's subtree sums up is found by splitting the parent
edges at centroids: each component is cut at the deepest node that still has more than half of the component's weight below
it, the total below that node is added to every node from there to the component's top, and the parts are split again.

A node's weight is its number of conversations, so the weight of its subtree is the sum of the turns its conversations
have left, which is known before any rollup. Each cut halves the weight; the nodes with more than half of it are exactly
the path from the top to the centroid. Large components are cut in rounds over the whole table, and what a round leaves
with at most ``piece_nodes`` nodes is finished within tasks, many components at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.words import column, mix
from ledgerline.operators.lookup import attach_group_stats
from ledgerline.operators.order import order_rows
from ledgerline.session import stage

FAMILY = 100  # conversations that begin with turns of one of them
BORROWED = 6  # a conversation borrows fewer turns than this
BROADCAST_COMPONENTS = 200_000
COMPONENT = ["top_depth", "top_a", "top_b"]
NODE = ["depth", "a", "b"]


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as rebuilt: (conv_id, depth, role, text_hash, chars) and (conv_id, place, length).

    ``place`` grows with conv_id. Rows get their place in the conversation from one range sort of all rows, so that a
    conversation with a third of all turns is in many tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.md5(text).alias("text_hash"),
        F.length(text).cast("long").alias("chars"),
    )
    rows = order_rows(turns, ["conv_id", "turn", "role", "text_hash"]).rows
    counts = stage(rows.groupBy("conv_id").agg(F.min("pos").alias("place"), F.count("*").alias("n")), "conversations")
    heads = counts.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = (
        counts.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % BORROWED)
        .join(heads, "base", "left")
        .withColumn("borrowed", F.least("h", F.coalesce("n_base", F.lit(0))))
        .withColumn("length", F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    convs = stage(convs.select("conv_id", "place", "n", "base", "h", "borrowed", "length"), "rebuilt-conversations")
    rows = attach_group_stats(rows, convs, ["conv_id"], ["place", "h", "borrowed"])
    rows = rows.withColumn("at", F.col("pos") - F.col("place") + 1)
    own = rows.where(F.col("at") > F.col("h")).withColumn("depth", F.col("at") - F.col("h") + F.col("borrowed"))
    lent = rows.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < BORROWED))
    lent = lent.select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "role", "text_hash", "chars")
    lent = lent.join(convs.select("conv_id", "base", "borrowed"), "base").where(F.col("depth") <= F.col("borrowed"))
    fields = ["conv_id", "depth", "role", "text_hash", "chars"]
    return own.select(*fields).unionByName(lent.select(*fields)), convs.select("conv_id", "place", "length")


def prefixes(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, chars, left, place): every prefix by two 64-bit hashes, its parent's, and how
    many prefixes the conversation has from there on. The empty prefix has depth 0 and hashes 0.

    A prefix's hash is the exclusive or of the hashes of (place, role, text) of its turns, so a long conversation is
    hashed in blocks of ``block`` turns whose totals are put together afterwards.
    """
    hashed = turns.select(
        "conv_id",
        "depth",
        "chars",
        F.floor(F.col("depth") / block).alias("slab"),
        *(F.xxhash64(F.lit(seed), "depth", "role", "text_hash").alias(f"own_{c}") for seed, c in ((1, "a"), (2, "b"))),
    )
    running = W.partitionBy("conv_id", "slab").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    found = hashed.select("*", *(F.bit_xor(f"own_{c}").over(running).alias(c) for c in "ab"))
    found = stage(found, "turn-hashes")
    if (convs.agg(F.max("length")).first()[0] or 0) >= block:
        totals = found.groupBy("conv_id", "slab").agg(*(F.bit_xor(f"own_{c}").alias(f"sum_{c}") for c in "ab"))
        before = W.partitionBy("conv_id").orderBy("slab").rowsBetween(W.unboundedPreceding, -1)
        totals = totals.select("conv_id", "slab", *(F.bit_xor(f"sum_{c}").over(before).alias(f"past_{c}") for c in "ab"))
        later = found.where(F.col("slab") > 0).join(totals, ["conv_id", "slab"])
        later = later.select(*(F.col(c) if c not in "ab" else F.col(c).bitwiseXOR(F.coalesce(f"past_{c}", F.lit(0))).alias(c) for c in found.columns))
        found = found.where(F.col("slab") == 0).unionByName(later)
    found = attach_group_stats(found, convs.withColumn("n", F.col("length")), ["conv_id"], ["place", "length"]).select(
        "conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"),
        "chars", (F.col("length") - F.col("depth") + 1).alias("left"), "place",
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *(zero.alias(c) for c in ("depth", "a", "b", "up_a", "up_b", "chars")), (F.col("length") + 1).alias("left"), "place")
    return stage(found.unionByName(roots), "prefixes")


def trie_nodes(found: DataFrame) -> DataFrame:
    """A row per node with its figures, own values and weight; a hot node is aggregated on the map side."""
    nodes = found.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *(F.first(c).alias(c) for c in ("chars", "up_a", "up_b")),
        F.sum("left").alias("weight"),
    )
    nodes = stage(nodes, "nodes")
    up = [(F.col("depth") - 1).alias("up_depth"), "up_a", "up_b"]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    named = children.select(F.col("up_depth").alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), "n_children")
    nodes = nodes.join(named, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stage(nodes.withColumn("up_depth", F.col("depth") - 1), "trie")
    parents = nodes.where("n_children > 0").select(
        F.col("depth").alias("up_depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    return attach_group_stats(nodes, parents, ["up_depth", "up_a", "up_b"], ["parent_conv_id"], weight="n_children").select(
        *NODE, "up_a", "up_b", "conv_id", "parent_conv_id", "n_convs", "n_children", "weight",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )


def _joined(rows: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """``few`` holds a row per component that is too large for a task, so a broadcast is bounded by their counted number."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_COMPONENTS else few, COMPONENT, how)


def _cut_large(state: DataFrame, found: DataFrame, large: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """One round on the components ``large``: (nodes that remain with their new components, finished centroids)."""
    work = _joined(state, large.select(*COMPONENT, "total"))
    heavy = work.where(2 * F.col("weight") > F.col("total"))
    centroid = F.min_by(F.struct("depth", "a", "b", "weight"), F.col("weight")).alias("c")
    centroids = stage(heavy.groupBy(*COMPONENT).agg(centroid), "centroids")
    work = _joined(work, centroids)

    # A node lies below the centroid when its conversation's prefix of that length is the centroid.
    deeper = work.where(F.col("depth") > F.col("c.depth")).withColumn("slab", F.floor(F.col("depth") / block))
    asked = deeper.select(*COMPONENT, "conv_id", "slab", "c").distinct()
    steps = found.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), *(F.col(c).alias(f"_{c}") for c in ("a", "b", "up_a", "up_b")))
    below = asked.join(steps, (F.col("conv_id") == F.col("_conv")) & (F.col("c.depth") + 1 == F.col("_depth")))
    below = below.where((F.col("_up_a") == F.col("c.a")) & (F.col("_up_b") == F.col("c.b"))).select(
        *COMPONENT, "conv_id", "slab", F.struct(F.col("_depth").alias("depth"), F.col("_a").alias("a"), F.col("_b").alias("b")).alias("part")
    )
    marked = work.withColumn("slab", F.floor(F.col("depth") / block)).join(below, [*COMPONENT, "conv_id", "slab"], "left")
    is_centroid = (F.col("depth") == F.col("c.depth")) & (F.col("a") == F.col("c.a")) & (F.col("b") == F.col("c.b"))
    under = F.col("part").isNotNull() & (F.col("depth") > F.col("c.depth"))
    marked = stage(marked.select(*state.columns, "c", "total", "part", is_centroid.alias("is_centroid"), under.alias("under")), "marked")

    sums = marked.where("under OR is_centroid").groupBy(*COMPONENT).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
    marked = _joined(marked, stage(sums, "component-totals"))
    on_path = 2 * F.col("weight") > F.col("total")
    changed = {
        "n_leaves": F.col("n_leaves") + F.when(on_path, F.col("t_leaf")).otherwise(0),
        "saved_tokens": F.col("saved_tokens") + F.when(on_path, F.col("t_saved")).otherwise(0),
        "weight": F.col("weight") - F.when(on_path, F.col("c.weight")).otherwise(0),
        **{f"top_{c}": F.when(F.col("under"), F.col("part")[c]).otherwise(F.col(f"top_{c}")) for c in NODE},
    }
    after = marked.select(*(changed.get(c, F.col(c)).alias(c) for c in state.columns), "is_centroid")
    return after.where(~F.col("is_centroid")).select(*state.columns), after.where("is_centroid").select(*state.columns)


def roll_up_components(top: np.ndarray, parent: np.ndarray, weight: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums of ``values`` for nodes in components, by centroid decomposition of all components at once.

    ``top`` is the index of each node's component's top, ``parent`` that of its parent or -1 for tops, ``weight`` the weight
    of the node's subtree, strictly less than that of its parent.
    """
    label, parent, weight = top.copy(), parent.copy(), weight.copy()
    sums = [np.zeros(len(top), dtype=np.int64) for _ in values]
    alive = np.arange(len(top))
    pointer = np.arange(len(top))
    while len(alive):
        own = label[alive]
        path = alive[2 * weight[alive] > weight[own]]
        order = np.lexsort((weight[path], label[path]))
        ordered = label[path[order]]
        centroids = path[order][np.concatenate(([True], ordered[1:] != ordered[:-1]))]
        centroid_of = pointer  # only the entries of this round's tops are read below
        centroid_of[label[centroids]] = centroids
        mine = centroid_of[label[path]]

        cut = np.zeros(len(top), dtype=bool)
        cut[centroids] = True
        upper = parent[alive]
        free = (upper < 0) | cut[upper] | cut[alive]
        ahead = np.arange(len(top))
        ahead[alive] = np.where(free, alive, upper)
        while True:  # each node finds the top of its new part in as many steps as the depth has bits
            further = ahead[ahead[alive]]
            if (further == ahead[alive]).all():
                break
            ahead[alive] = further
        part = ahead[alive]
        below = (parent[part] >= 0) & cut[parent[part]]
        for total, value in zip(sums, values):
            under = np.zeros(len(top), dtype=np.int64)
            np.add.at(under, parent[part[below]], value[alive[below]])
            under[centroids] += value[centroids]
            total[path] += under[mine]
        less = weight[mine]
        label[alive] = part
        parent[alive[free]] = -1
        weight[path] -= less
        alive = alive[~cut[alive]]
        pointer = np.arange(len(top))
    return sums


def _finish(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of whole components with their sums added."""
    get = {name: column(batch, name).to_numpy(zero_copy_only=False) for name in (*COMPONENT, *NODE, "up_a", "up_b", "weight", "leaf", "saved")}

    def key(depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(mix(mix(depth.astype(np.uint64)) + a.view(np.uint64)) + b.view(np.uint64))

    own = key(*(get[c] for c in NODE))
    order = np.argsort(own)

    def place(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(own[order], wanted), len(own) - 1)
        return np.where(own[order][at] == wanted, order[at], -1)

    parent = place(key(get["depth"] - 1, get["up_a"], get["up_b"]))
    top = place(key(*(get[c] for c in COMPONENT)))
    parent[top == np.arange(len(top))] = -1
    sums = roll_up_components(top, parent, get["weight"], [get["leaf"], get["saved"]])
    for name, values in zip(("n_leaves", "saved_tokens"), sums):
        at = batch.schema.get_field_index(name)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(column(batch, name).to_numpy() + values, pa.int64()))
    return batch


def _finish_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component; the last one of a batch waits for the rest of its rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tops = [column(batch, c).to_numpy() for c in COMPONENT]
        changes = reduce(np.logical_or, (t[1:] != t[:-1] for t in tops), np.zeros(batch.num_rows - 1, dtype=bool))
        if held and any(column(held[-1], c)[-1].as_py() != t[0] for c, t in zip(COMPONENT, tops)):
            yield _finish(pa.concat_batches(held))
            held = []
        last = np.flatnonzero(changes)
        if len(last):
            yield _finish(pa.concat_batches([*held, batch.slice(0, int(last[-1]) + 1)]))
            held = [batch.slice(int(last[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield _finish(pa.concat_batches(held))


def rolled_up(nodes: DataFrame, found: DataFrame, piece_nodes: int, block: int) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens of their subtrees."""
    zero = F.lit(0).cast("long")
    state = nodes.select("*", zero.alias("n_leaves"), zero.alias("saved_tokens"), *(zero.alias(c) for c in COMPONENT))
    state = stage(state, "trie")
    small, centroids = [], []
    while True:
        sizes = state.groupBy(*COMPONENT).agg(F.count("*").alias("n"), F.max("weight").alias("total"))
        large = stage(sizes.where(F.col("n") > piece_nodes), "large-components")
        if large.isEmpty():
            small.append(state)
            break
        small.append(_joined(state, large.select(*COMPONENT), "left_anti").select(*state.columns))
        state, cut = _cut_large(state, found, large, block)
        centroids.append(cut)
    rest = reduce(DataFrame.unionByName, small)
    rest = rest.repartition(*COMPONENT).sortWithinPartitions(*COMPONENT).mapInArrow(_finish_components, rest.schema)
    return reduce(DataFrame.unionByName, centroids, rest)


def member_hashes(found: DataFrame, block: int) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ascending ids of the conversations that end in a node.

    Ids are put together in blocks of ``block`` neighbouring conversations. A digest is sequential, so the blocks of one
    node pass through one task as a stream; only the state of the digest is held.
    """
    ends = found.where(F.col("left") == 1).withColumn("part", F.floor(F.col("place") / block))
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")))
    parts = ends.groupBy(*NODE, "part").agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *here, text in zip(*(column(batch, c).to_pylist() for c in (*NODE, "ids"))):
                if here == node:
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = here, hashlib.sha256(text.encode())
            yield _digests(done)
        yield _digests([(*node, state.hexdigest())] if node is not None else [])

    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "part").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[*NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame, piece_nodes: int = 50_000, block: int = 1024) -> DataFrame:
    """Per node of the trie of rebuilt ``conversations`` (conv_id, turn, role, text): conv_id, its smallest member, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation c is rebuilt from the first crc32(c) % 6 turns of conversation c - c % 100 and its own turns after as
    many. A component of up to ``piece_nodes`` nodes is finished in one task; ``block`` turns of one conversation, or ids of
    conversations that end in one node, are handled together.

    Defined cases: turns are in the order of turn, null first, ties by role and then by the MD5 of the text; null role or
    text counts as empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation; other
    columns are ignored; no conversations give no rows. Texts are hashed where they are read and never shuffled.
    """
    turns, convs = rebuilt_turns(conversations)
    found = prefixes(turns, convs, block)
    nodes = rolled_up(trie_nodes(found), found, piece_nodes, block)
    return nodes.join(member_hashes(found, block), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def trie_sql() -> str:
    """DuckDB SQL for the rows of ``prefix_trie`` over ``conversations``."""
    return """
    WITH crc_table AS (
      SELECT list(list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS steps
      FROM (SELECT unnest(range(256)) AS b)
    ),
    turns AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS at
      FROM conversations WHERE conv_id IS NOT NULL
    ),
    convs AS (
      SELECT conv_id, conv_id - conv_id % 100 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM turns), crc_table
    ),
    borrowed AS (
      SELECT c.conv_id, count(t.at) AS n FROM convs c LEFT JOIN turns t ON t.conv_id = c.base AND t.at <= c.h GROUP BY ALL
    ),
    rebuilt AS (
      SELECT c.conv_id, t.at AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.at <= c.h
      UNION ALL
      SELECT c.conv_id, t.at - c.h + b.n, t.role, t.text FROM convs c JOIN borrowed b USING (conv_id)
      JOIN turns t ON t.conv_id = c.conv_id AND t.at > c.h
    ),
    paths AS (
      SELECT c.conv_id, coalesce(list(struct_pack(role := r.role, text := md5(r.text), chars := length(r.text)) ORDER BY r.depth)
        FILTER (r.depth IS NOT NULL), []) AS path
      FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id
    ),
    prefixes AS (SELECT conv_id, path[1:d] AS node, d AS depth, len(path) = d AS at_end FROM paths, unnest(range(len(path) + 1)) AS u(d)),
    nodes AS (
      SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
      FROM prefixes GROUP BY node, depth
    ),
    own AS (
      SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.node[1:n.depth] = n.node) AS n_children
      FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
    ),
    sums AS (
      SELECT node[1:d] AS node, d AS depth, sum((n_children = 0)::BIGINT) AS n_leaves,
        sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * node[depth].chars END) AS saved_tokens
      FROM own, unnest(range(depth + 1)) AS u(d) GROUP BY ALL
    )
    SELECT o.conv_id, o.depth, o.parent_conv_id, o.n_convs, o.n_children, s.n_leaves::BIGINT AS n_leaves,
      s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
    FROM own o JOIN sums s USING (node, depth)
    """
