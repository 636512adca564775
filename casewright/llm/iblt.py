"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. SQL functions only.

A text is the set of digests of its paragraph pieces (lines, cut every PIECE characters). A
sketch has three subtables; a digest falls into one cell of each, and a cell keeps how many
digests it holds, their exclusive or, and the exclusive or of their check hashes. Sketches of two
texts subtract cell by cell: what they share cancels. A cell that then holds a single digest (its
check agrees) gives it away, the digest leaves its other cells, and so on until all cells are
empty: the digests in which the texts differ are recovered, and with the sizes of both sets (the
sums of the counts of a subtable) their Jaccard likeness is exact.

A text's fingerprint is the hash of the text and its stored sketch of 24 cells. Texts are compared by
subtracting their stored sketches. Only where that gets stuck, as too much differs, sketches with room
for the digests of both are made and subtracted, then GROWTH times larger ones under another salt. A
pair that even those do not resolve is compared by its digests; on the documents of the test tables
that never happened (undecided() counts it).

Documents are dealt to buckets of neighbouring ids, so one shuffle of the texts brings each one
next to its successor, and all sketching and peeling stays inside the bucket's task without
another shuffle. The first document of a bucket is also sent to the bucket before it.

Defined results: null texts are empty (no digest; two empty sets have likeness 1); null doc_ids
come last, ordered by text hash; equal doc_ids are ordered by text hash; a single document is its
own successor; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.shared import table

PIECE = 96
SMALL = 8
GROWTH = 8
LEVELS = 3
ROUNDS = 15
#: Rounds of peeling for the few cells of stored sketches.
FEW_ROUNDS = 6
BUCKET_ROWS = 1000
BUCKET_CHARS = 4_000_000
QUANTILES = 256
#: Bounds the table of buckets, which is broadcast (some 40 bytes each).
MOST_BUCKETS = 200_000


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the pieces of a text."""
    pieces = F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{PIECE}}})"), F.lit(1))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


CELLS = "array<struct<cnt: bigint, id: bigint, chk: bigint>>"
#: Check hashes have 32 bits.
CHECK = "(xxhash64({}) & 4294967295L)"


def sketch(name: str) -> Column:
    """The stored cells of the digests in a column."""
    inside = f"filter({name}, d -> (shiftright(d, 21 * (c div {SMALL})) & {SMALL - 1}) = c % {SMALL})"
    cell = (
        f"transform(array({inside}), m -> named_struct('cnt', cast(size(m) as bigint), 'id', aggregate(m, 0L, (a, d) -> a ^ d),"
        f" 'chk', aggregate(m, 0L, (a, d) -> a ^ {CHECK.format('d')})))[0]"
    )
    return F.expr(f"transform(sequence(0, {3 * SMALL - 1}), c -> {cell})")


def written(digest: Column, cells: Column) -> Column:
    """A fingerprint as text: the hash of the text, then count, digests and checks of each cell, in hex."""
    number = lambda value, width: F.lpad(F.hex(value), width, "0")
    return F.lower(F.concat(number(digest, 16), F.array_join(F.transform(cells, lambda x: F.concat(number(x["cnt"], 8), number(x["id"], 16), number(x["chk"], 8))), "")))


def cells_of(fingerprint: str) -> Column:
    """The cells of a written fingerprint."""
    at = lambda first, size: f"conv(substr({fingerprint}, 17 + 32 * c + {first}, {size}), 16, -10)"
    return F.expr(f"transform(sequence(0, {3 * SMALL - 1}), c -> named_struct('cnt', cast({at(0, 8)} as bigint), 'id', cast({at(8, 16)} as bigint), 'chk', cast({at(24, 8)} as bigint)))")


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, rid, doc_id, n_chars, h, text, found, cells, next_text, next_found, next_cells): every
    document beside its successor in descending doc_id, clustered by bucket."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("h", F.xxhash64("text"))
    steps = F.array(*(F.lit((k + 1) / QUANTILES) for k in range(QUANTILES - 1)))
    size = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", steps, 10_000).alias("cuts")).first()
    buckets = min(MOST_BUCKETS, max(1, -(-size["n"] // BUCKET_ROWS), -(-(size["chars"] or 0) // BUCKET_CHARS)))
    a_row = buckets / max(1, size["n"])
    quantiles = size["cuts"] or []
    if size["low"] is None:
        cuts = [0, 1]
    else:
        keep = max(1, len(quantiles) // buckets)
        # An id that several quantiles share is a range of its own.
        often = {x for q, after in zip(quantiles, quantiles[1:]) if q == after for x in (q, q + 1)}
        cuts = sorted({size["low"], *quantiles[keep - 1 :: keep], *often, size["high"] + 1})
    # As many buckets for a range of ids as its quantiles ask for; within, ids and then hashes decide.
    held = [sum(low <= q < high for q in quantiles) + 1 for low, high in zip(cuts, cuts[1:])]
    fine = [max(1, math.ceil(h / QUANTILES * size["named"] * a_row)) for h in held]
    edges, counts, before = (F.array(*(F.lit(x).cast("long") for x in xs)) for xs in (cuts, fine, [sum(fine[:k]) for k in range(len(fine))]))
    part = F.least(F.greatest(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))), F.lit(1)), F.lit(len(fine)))
    low, high = F.element_at(edges, part), F.element_at(edges, part + 1)
    place = F.col("h") / 2.0**64 + 0.5
    many = F.element_at(counts, part)
    within = F.least(F.floor((F.col("doc_id") - low + place) / (high - low) * many), many - 1)
    nameless = max(1, math.ceil((size["n"] - size["named"]) * a_row))
    by_hash = F.least(F.floor(place * nameless), F.lit(nameless - 1)) - nameless - 1
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), by_hash).otherwise(F.element_at(before, part) + within).cast("long"))
    tops = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top"))
    around = Window.orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(around), F.min("bucket").over(Window.partitionBy()))
    tops = tops.select("bucket", F.col("top.doc_id").alias("top_id"), F.col("top.h").alias("top_h"), above.alias("ghost"))
    first = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("h") == F.col("top_h"))
    placed = rows.join(F.broadcast(tops), "bucket").withColumn("place", F.explode(F.when(first, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late")), F.struct(F.col("ghost").alias("bucket"), F.lit(1).alias("late")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late"))))))
    placed = placed.select("place.bucket", "place.late", "doc_id", "h", "n_chars", "text").repartition(int(min(buckets, 20_000)), "bucket")
    order = Window.partitionBy("bucket").orderBy("late", F.desc_nulls_last("doc_id"), F.desc("h"))
    placed = placed.withColumn("found", digests(F.col("text"))).withColumn("cells", sketch("found"))
    placed = placed.withColumn("rid", F.row_number().over(order)).withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "found", "cells")})
    return placed.where("late = 0").select("bucket", "rid", "doc_id", "n_chars", "h", "text", "found", "cells", "next_text", "next_found", "next_cells")


def _stored(rows: DataFrame, pairs: list[tuple[str, str]], head: list[str]) -> DataFrame:
    """Cells of the stored sketches of open pairs, subtracted, and one row a pair of texts with what travels along."""
    opened = []
    for k, (a, b) in enumerate(pairs):
        cell = f"named_struct('pair', {k}, 's', {SMALL}L, 'sub', cast(j div {SMALL} as int), 'pos', cast(j % {SMALL} as bigint), 'cnt', z.x.cnt - z.y.cnt, 'id', z.x.id ^ z.y.id, 'chk', z.x.chk ^ z.y.chk)"
        listed = f"transform(zip_with({a}_cells, {b}_cells, (x, y) -> named_struct('x', x, 'y', y)), (z, j) -> {cell})"
        opened.append(f"if(d{k} IS NULL, {listed}, cast(array() as array<struct<pair: int, s: bigint, sub: int, pos: bigint, cnt: bigint, id: bigint, chk: bigint>>))")
    tally = "array(named_struct('pair', -1, 's', 0L, 'sub', 4, 'pos', 0L, 'cnt', 0L, 'id', 0L, 'chk', 0L))"
    cells = rows.selectExpr("bucket", "rid", *head, f"inline(concat({', '.join([tally, *opened])}))")
    return cells.where("sub = 4 OR cnt <> 0 OR id <> 0 OR chk <> 0").select("bucket", "rid", "pair", "s", "sub", "pos", "cnt", "id", "chk", *(F.when(F.col("pair") < 0, F.col(c)).alias(c) for c in head))


def _larger(rows: DataFrame, pairs: list[tuple[str, str]], head: list[str], level: int, spots: str) -> DataFrame:
    """As _stored, from sketches made anew with room for the digests of both texts of an open pair."""
    opened = []
    for k, (a, b) in enumerate(pairs):
        size = f"cast({GROWTH ** (level - 1)} * greatest({SMALL}, pow(2, ceil(log2(greatest(1, size({a}_found) + size({b}_found)))))) as bigint)"
        signed = [f"transform({t}_found, d -> named_struct('pair', {k}, 's', {size}, 'id', d, 'cnt', {sign}L))" for t, sign in ((a, 1), (b, -1))]
        opened.append(f"if(d{k} IS NULL, concat({', '.join(signed)}), cast(array() as array<struct<pair: int, s: bigint, id: bigint, cnt: bigint>>))")
    first = "array(named_struct('pair', -1, 's', 0L, 'id', 0L, 'cnt', 0L))"
    digest = rows.selectExpr("bucket", "rid", *head, f"inline(concat({', '.join([first, *opened])}))")
    carried = [f"if(pair < 0, {c}, NULL) {c}" for c in head]
    return digest.selectExpr("bucket", "rid", "pair", "s", "id", "cnt", f"if(pair < 0, 0L, {CHECK.format('id')}) chk", *carried, f"inline(if(pair < 0, array(named_struct('sub', 4, 'pos', 0L)), array({spots})))")


def attempt(rows: DataFrame, level: int, pairs: list[tuple[str, str]], payload: list[str]) -> DataFrame:
    """rows with d0, d1, ... (the digests in which each pair of texts differs: id, and 1 or -1 for the text
    that has it) filled in where they were null and the sketches of this level can be peeled.

    rows has bucket and rid, which tell rows apart and cluster them, payload, d0, d1, ..., and for the
    texts of the pairs columns NAME_found (digests) and NAME_cells (stored sketch).
    """
    head = [*payload, *(f"d{k}" for k in range(len(pairs)))]
    keys = ["bucket", "rid", "pair", "s", "sub", "pos", *head]
    salted = "id" if level < 2 else f"xxhash64(id, {level})"
    spots = ", ".join(f"named_struct('sub', {j}, 'pos', shiftright({salted}, {21 * j}) & (s - 1))" for j in range(3))

    def summed(df: DataFrame) -> DataFrame:
        added = df.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.bit_xor("id").alias("id"), F.bit_xor("chk").alias("chk"))
        return added.where("sub >= 3 OR cnt <> 0 OR id <> 0 OR chk <> 0")

    cells = _stored(rows, pairs, head) if level == 0 else summed(_larger(rows, pairs, head, level, spots))
    for step in range(FEW_ROUNDS if level == 0 else ROUNDS):
        turn = step % 3
        pure = f"sub = {turn} AND abs(cnt) = 1 AND chk = {CHECK.format('id')}"
        away = ", ".join(f"named_struct('sub', {j}, 'pos', shiftright({salted}, {21 * j}) & (s - 1), 'cnt', -cnt, 'id', id, 'chk', chk)" for j in range(3) if j != turn)
        # What is recovered is a row of its own, its digest in the place of a position.
        found = "named_struct('sub', 3, 'pos', id, 'cnt', cnt, 'id', 0L, 'chk', 0L)"
        stay = "named_struct('sub', sub, 'pos', pos, 'cnt', cnt, 'id', id, 'chk', chk)"
        cells = summed(cells.selectExpr("bucket", "rid", "pair", "s", *head, f"inline(if({pure}, array({away}, {found}), array({stay}))) as (sub, pos, cnt, id, chk)"))
    told, stuck = [], []
    for k in range(len(pairs)):
        own = F.col("pair") == k
        told.append(F.collect_list(F.when(own & (F.col("sub") == 3), F.struct(F.col("pos").alias("id"), "cnt"))).alias(f"t{k}"))
        stuck.append(F.sum(F.when(own & (F.col("sub") < 3), 1).otherwise(0)).alias(f"stuck{k}"))
    out = cells.groupBy("bucket", "rid").agg(*(F.first(c, ignorenulls=True).alias(c) for c in head), *told, *stuck)
    solved = [F.coalesce(F.col(f"d{k}"), F.when(F.col(f"stuck{k}") == 0, F.col(f"t{k}"))).alias(f"d{k}") for k in range(len(pairs))]
    return out.select("bucket", "rid", *payload, *solved)


DIFFERENCE = "array<struct<id: bigint, cnt: bigint>>"


def resolved(rows: DataFrame, pairs: list[tuple[str, str]], payload: list[str]) -> DataFrame:
    """rows (see attempt) with d0, d1, ... as far as LEVELS sizes of sketches give them."""
    rows = rows.select("*", *(F.lit(None).cast(DIFFERENCE).alias(f"d{k}") for k in range(len(pairs))))
    for level in range(LEVELS):
        rows = attempt(rows, level, pairs, payload)
    return rows


def differences(pairs: DataFrame) -> DataFrame:
    """(key, only_a, only_b) from (key, a, b): the digests of pieces that only one of two texts has, in
    ascending order; null where the sketches did not give them. key tells rows apart."""
    rows = pairs.select(F.pmod(F.xxhash64("key"), F.lit(1024)).alias("bucket"), F.col("key").alias("rid"), digests(F.coalesce("a", F.lit(""))).alias("a_found"), digests(F.coalesce("b", F.lit(""))).alias("b_found"))
    rows = rows.repartition("bucket").withColumns({"a_cells": sketch("a_found"), "b_cells": sketch("b_found")})
    out = resolved(rows, [("a", "b")], ["a_found", "b_found"])
    one = lambda sign: F.array_sort(F.transform(F.filter("d0", lambda x: x["cnt"] == sign), lambda x: x["id"]))
    return out.select(F.col("rid").alias("key"), one(1).alias("only_a"), one(-1).alias("only_b"))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard likeness of two sets from their sizes and the size of their difference."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - differing) / (both + differing)).cast("double")


#: Columns that travel unchanged through the sketching of documents.
PAYLOAD = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "own_found", "edited_found", "next_found"]


def compared(docs: DataFrame) -> DataFrame:
    """Documents with PAYLOAD and the digests in which each differs from its edited text (d0) and the next (d1)."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    rows = neighbours(docs).withColumn("edited", edited).withColumn("edited_found", digests(F.col("edited"))).withColumn("edited_cells", sketch("edited_found"))
    rows = rows.select(
        "bucket", "rid", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("h"), F.col("cells")).alias("fingerprint"),
        written(F.xxhash64("edited"), F.col("edited_cells")).alias("edited_fingerprint"), F.col("found").alias("own_found"), F.col("cells").alias("own_cells"), "edited_found", "edited_cells", "next_found", "next_cells",
    )
    return resolved(rows, [("own", "edited"), ("own", "next")], PAYLOAD)


def undecided(docs: DataFrame) -> DataFrame:
    """One row: documents, and how many of their two comparisons the sketches did not resolve."""
    return compared(docs).agg(F.count("*").alias("documents"), F.sum(F.col("d0").isNull().cast("long") + F.col("d1").isNull().cast("long")).alias("undecided"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness, one row a document."""
    def differing(k: int, other: str) -> Column:
        plain = F.size(F.array_except("own_found", other)) + F.size(F.array_except(other, "own_found"))
        return F.when(F.col(f"d{k}").isNotNull(), F.size(f"d{k}")).otherwise(plain).cast("long")

    own = F.col("own_found")
    near = [likeness(own, F.col(other), differing(k, other)) for k, other in enumerate(("edited_found", "next_found"))]
    return compared(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
