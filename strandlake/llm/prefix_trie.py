"""Trie of conversations by their turns: how many share a prefix, and how many words of it need no second pass.

A conversation is a sequence of turn digests. Equal sequences are merged first, so a conversation that occurs very often is one
path with a count. Paths are dealt by the digest of their first turn; each group is built as a trie of dictionaries inside
``applyInPandas`` and summed up in an iterative postorder. A group with more turns than a bound is not built: its top node is
summed by Spark, its first turn is cut off, and its paths are dealt anew by the next turn, until every group is small. What
small groups and cut tops add to the nodes above them is then summed level by level, up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, map_batches
from .conversation_repair import CRC_SQL

#: Turns of a group that one task builds.
GROUP_TURNS = 50_000
#: Buckets for as many turns as one group may have: a task builds one group that is nearly too large, or a bucket of small ones.
BUCKETS_A_GROUP = 4
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [f.split(" ")[0] for f in NODE.split(", ")]


def turn_digest() -> Column:
    """SHA-256 of role and text, told apart by the length of the role."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest, n_words: turns in order, nulls first; ties by role, then text. Rows without conv_id are of no conversation."""
    empty = F.lit("")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select(
        "conv_id", (F.row_number().over(order) - 1).alias("pos"), turn_digest().alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    )


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Numbered turns in which conversation c begins with the first h turns of conversation c - c % block, h = crc32(c) % heads.

    Its own turns after the first h follow. A conversation takes at most heads - 1 turns from one that at most ``2 * block`` share, so
    no key of these joins is hot that was not before.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.select("conv_id").distinct().select("conv_id", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    first = turns.where(F.col("pos") < heads - 1)
    taken = ids.join(first.withColumnRenamed("conv_id", "base"), "base").where("pos < h").select("conv_id", "pos", "digest", "n_words")
    lengths = first.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    # Where the conversation that lends its turns is shorter than h, own turns follow it at once.
    moved = ids.join(lengths, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("lent"))
    own = turns.join(moved, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "digest", "n_words")
    return taken.unionByName(own)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ids sorted within a sequence: the smallest, their number, and the hash of all, comma-joined; one id is held at a time."""
    now: list | None = None
    names = ["seq", "length", "conv_id", "n", "ends_sha256"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for batch in batches:
        out = []
        for seq, length, conv_id in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if now is None or now[:2] != [seq, length]:
                if now:
                    out.append((*now[:4], now[4].hexdigest()))
                now = [seq, length, conv_id, 1, hashlib.sha256(str(conv_id).encode())]
            else:
                now[3] += 1
                now[4].update(f",{conv_id}".encode())
        if out:
            yield done(out)
    if now:
        yield done([(*now[:4], now[4].hexdigest())])


def sequences(turns: DataFrame, every: DataFrame) -> DataFrame:
    """seq, length, conv_id (smallest), n, ends_sha256 of each distinct sequence; ``every``: ids, as some conversations have no turn.

    A sequence is told by the sum over its turns of a hash of place and digest, so nothing is collected and repeats combine
    before the shuffle.
    """
    mixed = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.col("digest")), 256)
    part = lambda k: F.bit_xor(F.conv(F.substring(mixed, 1 + 15 * k, 15), 16, 10).cast("long"))
    told = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), *[part(k).alias(f"x{k}") for k in range(4)])
    told = every.join(told, "conv_id", "left").select(
        F.concat_ws(",", *[F.coalesce(f"x{k}", F.lit(0)).cast("string") for k in range(4)]).cast("binary").alias("seq"), F.coalesce("length", F.lit(0)).alias("length"), "conv_id"
    )
    dealt = told.repartition("seq").sortWithinPartitions("seq", "length", "conv_id")
    return map_batches(dealt, _ends, "seq binary, length long, conv_id long, n long, ends_sha256 string")


def build(digests: list[list[bytes]], words: list[list[int]], convs: list[int], counts: list[int], ends: list[str], above: int, depth: int) -> list[tuple]:
    """Nodes of the trie of some paths that share their first turn; the first one returned is their top, at ``depth``, below a node of conversation ``above``.

    A node is [children, smallest conversation, conversations, words, ends, parent].
    """
    nodes: list[list] = []
    top: dict[bytes, int] = {}
    for path, n_words, conv, count, end in zip(digests, words, convs, counts, ends, strict=True):
        children, parent = top, -1
        for digest, w in zip(path, n_words, strict=True):
            at = children.get(digest)
            if at is None:
                at = children[digest] = len(nodes)
                nodes.append([{}, conv, 0, w, NOTHING, parent])
            node = nodes[at]
            node[1], node[2] = min(node[1], conv), node[2] + count
            children, parent = node[0], at
        nodes[parent][4] = end
    leaves, saved, deep = [0] * len(nodes), [0] * len(nodes), [depth] * len(nodes)
    for at, node in enumerate(nodes):
        if node[5] >= 0:
            deep[at] = deep[node[5]] + 1
    # A node is made after its parent, so the order of making, backward, is a postorder.
    for at in range(len(nodes) - 1, -1, -1):
        children, _, n, w, _, parent = nodes[at]
        leaves[at] += not children
        saved[at] += (n - 1) * w
        if parent >= 0:
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
    return [(n[1], deep[k], nodes[n[5]][1] if n[5] >= 0 else above, n[2], len(n[0]), leaves[k], saved[k], n[4]) for k, n in enumerate(nodes)]


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The tries of all groups of a bucket."""
    made = []
    for key, group in rows.sort_values(["conv_id", "pos"], kind="stable").groupby("key", sort=False):
        convs = group.conv_id.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], convs[1:] != convs[:-1]]))
        cut = lambda column, at=np.append(starts, len(convs)): [column[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        heads = group.iloc[starts]
        nodes = build(
            cut(group.digest.to_list()), cut(group.n_words.to_list()), heads.conv_id.to_list(), heads.n.to_list(), heads.ends_sha256.to_list(), int(heads.above.iloc[0]), int(heads.pos.iloc[0]) + 1
        )
        made += [(*node, k == 0, heads.up.iloc[0]) for k, node in enumerate(nodes)]
    return pd.DataFrame(made, columns=[*COLUMNS, "top", "up"])


def trie(turns: DataFrame, every: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (0, 1, ... in each conversation), digest, n_words, as ``numbered_turns`` makes them; ``every``: conv_id,
    distinct, of all conversations, turnless ones too. The root, of depth 0, is there even for an empty table: without members its
    conv_id is null. saved_tokens counts the words that every conversation but one need not read again. Equal conversations are one
    path; texts come as digests, however long; other columns are not read.
    """
    ship(turns.sparkSession)
    with Scratch(turns.sparkSession) as scratch:
        seqs = scratch.write(sequences(turns, every), "sequences")
        ways = seqs.where("length > 0").select("conv_id", "n", "ends_sha256", "length")
        low = seqs.agg(F.min("conv_id").alias("low"), F.sum("n").alias("n")).first()
        # ``up`` is the key of the node above; ``key`` that of the group: a prefix, told by the digest of digests.
        paths = turns.join(ways, "conv_id")
        first = paths.where("pos = 0").select("conv_id", F.col("digest").alias("key"))
        paths = paths.join(first, "conv_id").withColumns({"up": F.lit(b""), "above": F.lit(low.low).cast("long")})
        paths = scratch.write(paths, "paths")
        built, cut, depth = [], [], 0
        while True:
            sizes = paths.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
            # Small groups go to buckets by the hash of their key, so that a task does not begin anew for each.
            buckets = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKETS_A_GROUP * paths.count() // group_turns)
            large = scratch.write(sizes.where(F.col("size") > group_turns).select("key"), "large-groups")
            small = paths.join(large, "key", "left_anti").groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInPandas(_built, f"{NODE}, top boolean, up binary")
            built.append(scratch.write(small, "nodes"))
            depth += 1
            if large.isEmpty():
                break
            # Tops of large groups: every path of the group has one turn at this depth.
            split = paths.join(large, "key")
            here = split.where(F.col("pos") == depth - 1)
            whole = F.col("length") == depth
            tops = here.groupBy("key").agg(
                F.min("conv_id").alias("conv_id"), F.first("above").alias("parent_conv_id"), F.sum("n").alias("n_convs"),
                F.first("n_words").alias("n_words"), F.max(F.when(whole, F.col("ends_sha256"))).alias("ends_sha256"), F.first("up").alias("up"),
            )
            tops = scratch.write(tops.withColumn("depth", F.lit(depth).cast("long")), "tops")
            cut.append(tops)
            rest = split.where(F.col("pos") >= depth)
            following = split.where(F.col("pos") == depth).select("conv_id", F.unhex(F.sha2(F.concat("key", "digest"), 256)).alias("next"))
            dealt = rest.join(following, "conv_id").join(tops.select("key", F.col("conv_id").alias("low")), "key")
            old, paths = paths, scratch.write(
                dealt.select("conv_id", "pos", "digest", "n_words", "n", "ends_sha256", "length", F.col("next").alias("key"), F.col("key").alias("up"), F.col("low").alias("above")), "paths"
            )
            scratch.drop(old)
        nodes = [b.select(*COLUMNS) for b in built]
        below = built[-1].where("top").select("up", "n_leaves", "saved_tokens")
        sums = lambda rows: rows.groupBy("up").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        for level in range(len(cut) - 1, -1, -1):
            own = cut[level].join(sums(below).withColumnRenamed("up", "key"), "key", "left")
            zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
            own = own.select(
                "conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children").alias("n_children"), F.greatest(zero("n_leaves"), F.lit(1)).alias("n_leaves"),
                (zero("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "up",
            )
            own = scratch.write(own, "tops")
            nodes.append(own.select(*COLUMNS))
            below = own.select("up", "n_leaves", "saved_tokens").unionByName(built[level].where("top").select("up", "n_leaves", "saved_tokens"))
        total = below.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        turnless = seqs.where("length = 0").agg(F.max("ends_sha256").alias("ends_sha256")).first()
        root = total.withColumn("ends_sha256", F.lit(turnless.ends_sha256 or NOTHING))
        nodes.append(
            root.select(
                F.lit(low.low).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(low.n or 0).cast("long").alias("n_convs"), "n_children",
                F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), "ends_sha256",
            )
        )
        return scratch.keep(scratch.write(reduce(DataFrame.unionByName, nodes), "trie"))


def rebuilt_trie(conversations: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """``trie`` of the rebuilt conversations: what ``rebuilt`` makes of ``conversations`` (conv_id, turn, role, text). A null role or text is empty."""
    with Scratch(conversations.sparkSession) as scratch:
        turns = scratch.write(numbered_turns(conversations), "numbered-turns")
        every = turns.select("conv_id").distinct()
        return trie(scratch.write(rebuilt(turns), "rebuilt-turns"), every, group_turns)


def oracle_sql() -> str:
    crc = CRC_SQL.format("conv_id::VARCHAR")
    return rf"""
    WITH rows AS (
        SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    lists AS (SELECT conv_id, list({{'d': digest, 'w': n_words}} ORDER BY pos) AS turns FROM rows GROUP BY conv_id),
    heads AS (SELECT conv_id, ({crc} % 4)::BIGINT AS h, conv_id - conv_id % 20 AS base, turns FROM lists),
    paths AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:h], a.turns[h + 1:]) AS turns FROM heads a LEFT JOIN lists b ON b.conv_id = a.base),
    steps AS (
        SELECT conv_id, depth, len(turns) = depth AS over, CASE WHEN depth > 0 THEN turns[depth].w ELSE 0 END AS w,
               md5(array_to_string(list_transform(turns[1:depth], lambda t: t.d), ',')) AS node,
               CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(turns[1:depth - 1], lambda t: t.d), ',')) END AS parent
        FROM paths, unnest(range(len(turns) + 1)) r(depth)),
    nodes AS (
        SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256
        FROM steps GROUP BY node, depth),
    children AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
    counted AS (SELECT x.*, coalesce(c.n, 0) AS n_children FROM nodes x LEFT JOIN children c ON c.parent = x.node AND c.depth = x.depth),
    above AS (SELECT DISTINCT a.node AS top, a.depth AS top_depth, b.node, b.depth FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
    sums AS (
        SELECT top, top_depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
        FROM above JOIN counted USING (node, depth) GROUP BY top, top_depth)
    SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
    FROM counted x JOIN sums ON top = x.node AND top_depth = x.depth LEFT JOIN nodes p ON p.node = x.parent AND p.depth = x.depth - 1"""
