"""Selection of paired probe records: cases by a caller's list, a fixed order of cells, complete groups.

A record is (case_id, context_load, prompt_exposure, ...). A case's records of one context are a group; a
group is complete if it has every expected exposure once and nothing else. The list is a table of
(place, case_id), so it may be as long as the data; of a case named twice the first place counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.shared import staged

CONTEXTS = ["short", "long"]
EXPOSURES = ["full", "partial", "minimal", "no_skill"]
#: Place of a cell that no order names: after all others.
UNKNOWN = 999


def list_place(values: Sequence[str], value: Column) -> Column:
    """Place of a value in a short list from 0; null if it is not in it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, values)), value), F.lit(0)).cast("int") - 1


def listed_cases(records: DataFrame, cases: DataFrame | None = None, most: int | None = None, preflight: bool = False) -> DataFrame:
    """(place, case_id) of the cases to select: those of the list in its order, else all in order of their
    ids; the first only for a preflight without a list; at most the given number. Without most and
    preflight nothing is sorted here: a place is the list's own, or the id itself."""
    if cases is None:
        chosen = records.select("case_id").distinct().select(F.col("case_id").alias("place"), "case_id")
        most = 1 if preflight else most
    else:
        chosen = cases.groupBy("case_id").agg(F.min("place").alias("place")).select("place", "case_id")
    return chosen if most is None else chosen.orderBy("place", "case_id").limit(most)


def selected(records: DataFrame, chosen: DataFrame, contexts: Sequence[str] = CONTEXTS, exposures: Sequence[str] = EXPOSURES) -> DataFrame:
    """records of the chosen cases and contexts with place and cell; ordered by (place, case_id, cell) they are in the
    probe's order. A context or exposure without a place of its own has cell UNKNOWN."""
    cell = F.coalesce(list_place(CONTEXTS, F.col("context_load")) * len(exposures) + list_place(exposures, F.col("prompt_exposure")), F.lit(UNKNOWN))
    return records.where(F.col("context_load").isin(list(contexts))).join(chosen, "case_id").withColumn("cell", cell)


def incomplete_groups(rows: DataFrame, chosen: DataFrame, contexts: Sequence[str] = CONTEXTS, exposures: Sequence[str] = EXPOSURES) -> DataFrame:
    """(case_id, context_load, records, missing, doubled, unexpected) of every group whose exposures are not the
    expected ones, each once. Groups without any record are found as well, as the expected groups are
    made from the chosen cases; one shuffle by group holds one counter an exposure."""
    expected = chosen.select("case_id", F.explode(F.array(*map(F.lit, contexts))).alias("context_load"))
    place = list_place(exposures, F.col("prompt_exposure"))
    counters = [F.count_if(place == i).alias(f"n{i}") for i in range(len(exposures))]
    met = rows.groupBy("case_id", "context_load").agg(F.count("*").alias("records"), *counters)
    both = expected.join(met, ["case_id", "context_load"], "left").fillna(0)
    names = lambda test: F.array_compact(F.array(*(F.when(test(F.col(f"n{i}")), F.lit(e)) for i, e in enumerate(exposures))))
    known = sum((F.col(f"n{i}") for i in range(1, len(exposures))), F.col("n0"))
    out = both.select("case_id", "context_load", "records", names(lambda n: n == 0).alias("missing"), names(lambda n: n > 1).alias("doubled"), (F.col("records") - known).alias("unexpected"))
    return out.where((F.size("missing") > 0) | (F.size("doubled") > 0) | (F.col("unexpected") > 0))


def select_probe(records: DataFrame, cases: DataFrame | None = None, most: int | None = None, preflight: bool = False, context: str | None = None, exposures: Sequence[str] = EXPOSURES) -> DataFrame:
    """The records of a probe with place, cell and position (from 1, in the probe's order).

    Raises if exposures repeat, the context is unknown, a listed case has no record, a group is not
    complete, or a preflight is more than one case. All groups being of one size, a record's position follows from
    its case's; only a list's cases are ranked, not its records. The cases are written to the shared folder once, as
    each later step reads them.
    """
    if not exposures or len(set(exposures)) != len(exposures):
        raise ValueError("expected exposures must be given, each once")
    if context is not None and context not in CONTEXTS:
        raise ValueError(f"context load must be one of {CONTEXTS}, not {context!r}")
    contexts = CONTEXTS if context is None else [context]
    chosen = staged(listed_cases(records, cases, most, preflight), "probe-cases")
    rows = selected(records, chosen, contexts, exposures)
    if faults := incomplete_groups(rows, chosen, contexts, exposures).limit(5).collect():
        # A case without a record has incomplete groups, so it is looked for only now.
        if absent := [r["case_id"] for r in chosen.join(records.select("case_id").distinct(), "case_id", "left_anti").limit(5).collect()]:
            raise ValueError(f"listed cases without a record: {absent}")
        raise ValueError(f"incomplete groups: {[(r['case_id'], r['context_load'], r['missing'], r['doubled'], r['unexpected']) for r in faults]}")
    if preflight and (n := chosen.count()) > 1:
        raise ValueError(f"a preflight takes one case, not {n}")
    size = len(contexts) * len(exposures)
    first = CONTEXTS.index(contexts[0]) * len(exposures)
    ranked = selected(records, list_ranks(chosen), contexts, exposures)
    return ranked.withColumn("position", ((F.col("case_rank") - 1) * size + F.col("cell") - first + 1).cast("long")).drop("case_rank")


#: Cases that one task ranks (about), and ranges at most.
RANGE_ROWS, MOST_RANGES = 200_000, 1024


def list_ranks(chosen: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """chosen with case_rank from 1 in the order of (place, case_id): ranges of the order are ranked in tasks of their
    own, and the ranges' sizes, one row a range, give the offsets. A sample of about 100 cases a range tells where
    ranges end; that moves work between tasks, not ranks."""
    n = chosen.count()
    parts = min(MOST_RANGES, n // rows)
    sample = chosen.sample(min(1.0, 100 * parts / n), seed=1).select("place", "case_id").orderBy("place", "case_id").collect() if parts else []
    kinds = [chosen.schema[c].dataType for c in ("place", "case_id")]
    ends = [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(r, kinds, ("place", "case_id")))) for r in sample[:: max(1, len(sample) // max(1, parts))]]
    at = F.size(F.filter(F.array(*ends), lambda e: e <= F.struct("place", "case_id"))) if ends else F.lit(0)
    inside = chosen.withColumn("_range", at).withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy("place", "case_id")))
    sizes = chosen.groupBy(at.alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return inside.join(F.broadcast(before), "_range").withColumn("case_rank", F.col("_before") + F.col("_r")).drop("_range", "_r", "_before")
