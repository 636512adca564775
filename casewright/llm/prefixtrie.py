"""Prefix trie of conversations.

A conversation is a sequence of turns (role, text); every distinct sequence of the first d turns is a node of
depth d, and the conversations that start with it are its members. A node belongs to its smallest member.
As members only get fewer with depth, a conversation owns either no node or all nodes of its path from some
first depth on: its chain. A node is told by its depth and a digest: turns are hashed to 128 bits, mixed with their
place and summed up, so that digests of all prefixes are running sums.

The first owned depth is searched for by halving: paths are cut into pieces of PIECE prefixes, and in each round
every piece asks, in one join for all, for the smallest member of its middle prefix and keeps one half of its
digests. Chains hang on the node above their first one. Going up from the innermost chains, each chain's
conversations, leaves and saved tokens are summed up at its top and handed to the chain above; then running
sums from the end of each chain to its top give the figures of every node. Only numbers and digests are
shuffled, never texts, and no step needs the rows of one conversation, prefix or node together in one task, except
that the hash of a node's ids is taken in one pass over them (in strings of many ids, made beforehand in parallel).

Defined results: a null role or text is empty; a null turn comes first; turns of one conversation with the same
turn number are ordered by the digest of role and text, repeated ones all count; rows without conv_id belong to no
conversation; an empty table has no node, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.running import running_sums
from casewright.llm.shared import staged, table, text_arrays

#: Prefixes to a piece: one less than a power of two, so that halving ends evenly.
PIECE = 15
#: Ids to a string when a node's ids are joined for their hash.
JOINED = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role: bytes, text: bytes) -> tuple[int, int]:
    h = hashlib.blake2b(struct.pack("<Q", len(role)), digest_size=16)
    h.update(role)
    h.update(text)
    return struct.unpack("<qq", h.digest())


def _turn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for batch in batches:
        role, text = text_arrays(batch, "role"), text_arrays(batch, "text")
        found = np.array([turn_digest(r.as_py(), t.as_py()) for r, t in zip(role, text)], np.int64).reshape(-1, 2)
        chars = pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index("text"))), 0).cast(pa.int64())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), chars], ["conv_id", "turn", "a", "b", "chars"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, chars): each turn's place in its conversation from 1, its digest and code points."""
    kind = conversations.schema["turn"].dataType.simpleString()
    known = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns = staged(known.mapInArrow(_turn_batches, f"conv_id long, turn {kind}, a long, b long, chars long"), "trie-turns")
    order = [F.col("turn").asc_nulls_first(), F.col("a").asc(), F.col("b").asc()]
    ranked = running_sums(turns.withColumn("one", F.lit(1).cast("long")), "conv_id", order, {"depth": "one"}, "trie-numbered")
    return ranked.select("conv_id", "depth", "a", "b", "chars")


def mix(x: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A turn's digest at a place: one of 64 bits for each, well spread (multipliers of the splitmix64 generator)."""
    with np.errstate(over="ignore"):
        z = x.view(np.uint64) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).view(np.int64)


def _mix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, depth, a, b, chars = (batch.column(i).to_numpy() for i in range(5))
        yield pa.record_batch([pa.array(x) for x in (conv, depth, mix(a, depth), mix(b, ~depth), chars)], ["conv_id", "depth", "a", "b", "chars"])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, pa, pb, chars, cc) of every prefix: its digest, its last turn's code points and those of all."""
    mixed = turns.select("conv_id", "depth", "a", "b", "chars").mapInArrow(_mix_batches, "conv_id long, depth long, a long, b long, chars long")
    return running_sums(mixed, "conv_id", ["depth"], {"pa": "a", "pb": "b", "cc": "chars"}, "trie-prefixes").select("conv_id", "depth", "pa", "pb", "chars", "cc")


def first_owned(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, length, first, up): the first depth that a conversation owns (length + 1 if none), and the owner of
    the depth above it (null at depth 1).

    In a piece, low is the depth before the digests still in question and up the owner of low, once asked.
    """
    minima = staged(paths.groupBy("depth", "pa", "pb").agg(F.min("conv_id").alias("owner")), "trie-minima")
    minima = minima.toDF("m_depth", "m_a", "m_b", "owner")
    pieces = paths.groupBy("conv_id", F.expr(f"(depth - 1) div {PIECE}").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("depth", "pa", "pb"))).alias("open"))
    state = staged(pieces.select("conv_id", (F.col("piece") * PIECE).alias("low"), "open", F.lit(None).cast("long").alias("up"), F.lit(False).alias("met")), "trie-pieces")
    done = None
    for _ in range((PIECE + 1).bit_length() - 1):
        ended = state.where("size(open) = 0")
        done = ended if done is None else done.union(ended)
        asked = state.where("size(open) > 0").withColumn("half", F.expr("(size(open) - 1) div 2")).withColumn("mid", F.expr("open[half]"))
        told = asked.join(minima, (F.col("mid.depth") == F.col("m_depth")) & (F.col("mid.pa") == F.col("m_a")) & (F.col("mid.pb") == F.col("m_b")))
        own = F.col("owner") == F.col("conv_id")
        state = staged(told.select(
            "conv_id", F.when(own, F.col("low")).otherwise(F.col("m_depth")).alias("low"),
            F.when(own, F.expr("slice(open, 1, half)")).otherwise(F.expr("slice(open, half + 2, size(open))")).alias("open"),
            F.when(own, F.col("up")).otherwise(F.col("owner")).alias("up"), (F.col("met") | own).alias("met"),
        ), "trie-search")
    done = done.union(state)
    found = done.groupBy("conv_id").agg(F.min(F.when(F.col("met"), F.col("low") + 1)).alias("first"), F.max(F.when(F.col("up").isNotNull(), F.struct("low", "up"))).alias("above"))
    out = lengths.join(found, "conv_id", "left")
    return out.select("conv_id", "length", F.coalesce("first", F.col("length") + 1).alias("first"), F.col("above.up").alias("up"))


def _levels(chains: DataFrame) -> DataFrame:
    """chains (conv_id, up) with level: the number of chains above. Each round doubles the way up that is known."""
    known = staged(chains.select("conv_id", "up", F.col("up").alias("far"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("level")), "trie-levels")
    while not known.where("far IS NOT NULL").isEmpty():
        above = known.select(F.col("conv_id").alias("far"), F.col("far").alias("farther"), F.col("level").alias("more"))
        known = staged(known.join(above, "far", "left").select("conv_id", "up", F.col("farther").alias("far"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "trie-levels")
    return known.select("conv_id", "level")


def _hash_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's joined strings, which come in order."""
    at, h, out = None, None, []
    for batch in rows:
        for conv, depth, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (conv, depth) != at:
                if at is not None:
                    out.append((*at, h.hexdigest()))
                at, h = (conv, depth), hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.encode())
        if out:
            yield pa.record_batch([pa.array([o[i] for o in out]) for i in range(3)], ["conv_id", "depth", "sha"])
            out = []
    if at is not None:
        yield pa.record_batch([pa.array([at[0]]), pa.array([at[1]]), pa.array([h.hexdigest()])], ["conv_id", "depth", "sha"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, sha) of each node where conversations end, from (node, depth, member)."""
    counted = ends.groupBy("node", "depth").agg(F.count("*").alias("n"), F.min("member").alias("low"))
    single = counted.where("n = 1").select(F.col("node").alias("conv_id"), "depth", F.sha2(F.col("low").cast("string"), 256).alias("sha"))
    several = ends.join(counted.where("n > 1").select("node", "depth"), ["node", "depth"]).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sums(several.select("node", "depth", "member", "one"), "node", ["depth", "member"], {"place": "one"}, "trie-ends")
    # Places run on over the depths of a chain; a string holds ids of one node whose places share a quotient.
    strings = ranked.groupBy("node", "depth", F.expr(f"place div {JOINED}").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids"))
    hashed = strings.select("node", "depth", "block", "ids").repartition("node", "depth").sortWithinPartitions("node", "depth", "block")
    return single.union(hashed.mapInArrow(_hash_batches, "conv_id long, depth long, sha string"))


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given by turns (conv_id, depth, a, b, chars) and members (conv_id, length);
    a conversation of length 0 is a member of the root."""
    lengths = staged(members.select("conv_id", "length"), "trie-members")
    paths = staged(prefixes(turns), "trie-paths")
    root = F.lit(lengths.agg(F.min("conv_id")).first()[0]).cast("long")
    first = F.when(F.col("conv_id") == root, F.lit(0)).otherwise(F.col("first"))
    up = F.when(F.col("conv_id") != root, F.coalesce("up", root))
    found = staged(first_owned(paths, lengths).select("conv_id", "length", first.cast("long").alias("first"), up.alias("up")), "trie-found")
    # Code points of the prefixes above and at the end of each chain; members without a chain need those of their end.
    totals = paths.join(found.select("conv_id", F.col("first").alias("f"), F.col("length").alias("l")), "conv_id").where("depth = f - 1 OR depth = l")
    totals = totals.groupBy("conv_id").agg(F.max(F.when(F.col("depth") == F.col("f") - 1, F.col("cc"))).alias("above"), F.max("cc").alias("all"))
    found = staged(found.join(totals, "conv_id", "left").fillna(0, ["above", "all"]), "trie-chains")
    chains = found.where("first <= length")
    owner = F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("up"))
    ends = found.select(owner.alias("node"), F.col("length").alias("depth"), F.col("conv_id").alias("member"), F.col("all").alias("cc"))
    events = ends.groupBy("node", "depth").agg(F.count("*").alias("n"), F.max("cc").alias("cc")).selectExpr("node", "depth", "cc", "n", "0L leaves", "0L saved", "0L kids")
    leveled = staged(chains.join(_levels(chains), "conv_id"), "trie-leveled")
    height = leveled.agg(F.max("level")).first()[0]
    events = staged(events, "trie-events")
    of_ends, below, all_events = events, None, events
    for level in range(height if height is not None else -1, 0, -1):
        own = leveled.where(F.col("level") == level)
        here = of_ends if below is None else of_ends.union(below)
        here = here.join(own.select(F.col("conv_id").alias("node"), F.col("length"), F.col("above").alias("base")), "node")
        weighed = F.sum(F.col("n") * (F.col("cc") - F.col("base"))) + F.sum("saved")
        tops = here.groupBy("node").agg(F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), weighed.alias("saved"), F.max(F.when(F.col("kids") > 0, F.col("depth"))).alias("deepest"))
        tops = own.join(tops, own.conv_id == tops.node).select(
            F.col("up").alias("node"), (F.col("first") - 1).alias("depth"), F.col("above").alias("cc"), "n",
            (F.col("leaves") + F.when(F.col("deepest") == F.col("length"), 0).otherwise(1)).alias("leaves"),
            (F.col("saved") - (F.col("all") - F.col("above"))).alias("saved"), F.lit(1).cast("long").alias("kids"),
        )
        tops = tops.groupBy("node", "depth").agg(F.max("cc").alias("cc"), *(F.sum(c).alias(c) for c in ("n", "leaves", "saved", "kids")))
        below = staged(tops.select(events.columns), "trie-tops")
        all_events = all_events.union(below)
    return _nodes(paths, chains, all_events, ends)


def _nodes(paths: DataFrame, chains: DataFrame, events: DataFrame, ends: DataFrame) -> DataFrame:
    own = chains.select(F.col("conv_id").alias("c"), "first", "length", "up")
    rows = paths.join(own, F.col("conv_id") == F.col("c")).where("depth >= first").select("conv_id", "depth", "chars", "cc", "first", "length", "up")
    top = chains.where("up IS NULL").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("cc"), "first", "length", "up")
    met = events.groupBy(F.col("node").alias("e_node"), F.col("depth").alias("e_depth")).agg(*(F.sum(c).alias(c) for c in ("n", "leaves", "saved", "kids")))
    rows = rows.union(top).join(met, (F.col("conv_id") == F.col("e_node")) & (F.col("depth") == F.col("e_depth")), "left").fillna(0, ["n", "leaves", "saved", "kids"])
    leaf = ((F.col("depth") == F.col("length")) & (F.col("kids") == 0)).cast("long")
    rows = rows.select("conv_id", "depth", "chars", "cc", "first", "length", "up", "n", (F.col("leaves") + leaf).alias("leaves"), "saved", "kids", (F.col("n") * F.col("cc")).alias("weighed"))
    # From the end of a chain up: what hangs on its nodes from this one on.
    sums = running_sums(rows, "conv_id", [F.col("depth").desc()], {"n_convs": "n", "n_leaves": "leaves", "s": "saved", "w": "weighed", "path": "chars"}, "trie-nodes")
    before = F.col("cc") - F.col("chars")
    sha = ends_hashes(ends).toDF("s_conv", "s_depth", "sha")
    out = sums.join(sha, (F.col("conv_id") == F.col("s_conv")) & (F.col("depth") == F.col("s_depth")), "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("kids") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"), "n_leaves",
        (F.col("s") + F.col("w") - before * F.col("n_convs") - F.col("path")).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of whole conversations (conv_id, turn, role, text)."""
    turns = staged(numbered_turns(conversations), "trie-whole")
    return trie(turns, turns.groupBy("conv_id").agg(F.max("depth").alias("length")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin with turns of the first one of their hundred: for conversation c
    and h = crc32(c) % 6, the first h turns of c - c % 100, then its own after its first h."""
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("size")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    heads = turns.where("depth <= 5").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("depth", "a", "b", "chars"))).alias("head"))
    made = sizes.join(heads, "base", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, cast(h as int))"))
    made = staged(made.withColumn("k", F.size("head").cast("long")), "trie-rebuilt")
    inherited = made.select("conv_id", F.inline("head"))
    own = turns.join(made.select("conv_id", "h", "k"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "chars")
    return inherited.union(own), made.select("conv_id", (F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = staged(numbered_turns(table(spark, sf_dir, "conversations")), "trie-whole")
    return trie(*rebuilt(turns)).select(*NODE)


#: Every prefix of every conversation is written out here, and subtrees are met by their members' prefixes.
ORACLE = r"""
WITH bits AS (
  SELECT n AS byte, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS entry FROM (SELECT unnest(range(256)) AS n)),
lookup AS (SELECT list(entry ORDER BY byte) AS e FROM bits),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, [coalesce(role, ''), coalesce(text, '')] AS s FROM conversations WHERE conv_id IS NOT NULL),
hs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: xor(crc // 256, e[xor(crc % 256, b) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t), lookup),
pieces AS (
  SELECT hs.c, 0 AS own, p, s FROM hs JOIN t ON t.c = hs.base AND p <= h
  UNION ALL SELECT hs.c, 1, p, s FROM hs JOIN t ON t.c = hs.c AND p > h),
seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, s FROM pieces),
pre AS (
  SELECT c, d, s, md5(to_json(list(s) OVER (PARTITION BY c ORDER BY d))::VARCHAR) AS k FROM seq
  UNION ALL SELECT c, 0, NULL, 'root' FROM hs),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(coalesce(length(s[2]), 0)) AS chars FROM pre GROUP BY d, k),
tops AS (SELECT pre.c, pre.d, pre.k, n.conv_id FROM pre JOIN nodes n USING (d, k)),
kids AS (
  SELECT up.d, up.k, count(DISTINCT down.k) AS n FROM tops up JOIN tops down ON up.c = down.c AND down.d = up.d + 1 GROUP BY ALL),
below AS (
  SELECT pre.d, pre.k, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, sum((kids.n IS NULL)::INT)::BIGINT AS n_leaves
  FROM nodes n JOIN pre ON pre.c = n.conv_id AND pre.d <= n.d LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k GROUP BY ALL),
ends AS (
  SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, d, k FROM pre QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY ALL),
parents AS (SELECT n.d, n.k, p.conv_id AS parent_conv_id FROM nodes n JOIN tops p ON p.c = n.conv_id AND p.d = n.d - 1)
SELECT n.conv_id, n.d::BIGINT AS depth, parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN parents USING (d, k) LEFT JOIN kids USING (d, k) JOIN below USING (d, k) LEFT JOIN ends USING (d, k)
"""
