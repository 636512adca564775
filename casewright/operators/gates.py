"""Engineering gates: what must hold between a prediction panel and the manifests that describe its run.

Manifests are JSON documents in a table (manifest, document). Their top-level fields become facts (manifest,
parent, field, value), value as canonical JSON; a list of objects becomes manifests of its own ('formal.runs[0]')
with the list's as parent. What the panel itself comes to is one more manifest. Constraints are a table
too: a field must equal a literal, or another manifest's field. Facts and constraints are joined; what does
not hold is an error. Rows of the panel are judged one by one (stored flags against flags computed anew) and by
case, in one shuffle that holds one counter a cell, never a case's rows.

All results are (gate, subject, detail); a run passes if there are none.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import textjson
from casewright.operators import layout

CONSTRAINTS = "manifest string, each boolean, field string, expected string, of_manifest string, of_field string"
#: Marks a path or key of the sealed split.
SEALED = "confirmation"


def literal(value: Any) -> str:
    """A constraint's expected value as canonical JSON."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def constraints(spark: SparkSession, fixed: dict[str, dict[str, Any]], same: Sequence[tuple[str, str, str, str]] = (), each: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """A table of constraints: fixed literals by manifest and field; same as (manifest, field, other manifest, other
    field); each as fixed, for every object of a list."""
    rows = [(m, False, f, literal(v), None, None) for m, of in fixed.items() for f, v in of.items()]
    rows += [(m, False, f, None, n, g) for m, f, n, g in same]
    rows += [(m, True, f, literal(v), None, None) for m, of in (each or {}).items() for f, v in of.items()]
    return spark.createDataFrame(rows, CONSTRAINTS)


def facts(manifests: DataFrame, lists: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(manifest, parent, field, value) of all readable manifests; lists names (manifest, field) of lists of objects,
    whose parent is 'manifest.field'. Duplicate keys make a document unreadable."""
    read = manifests.select("manifest", F.lit(None).cast("string").alias("parent"), F.try_parse_json("document").alias("v"))
    items = None
    for manifest, field in lists:
        inner = read.where(F.col("manifest") == manifest).select(F.posexplode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("i", "v"))
        inner = inner.select(F.concat(F.lit(f"{manifest}.{field}["), "i", F.lit("]")).alias("manifest"), F.lit(f"{manifest}.{field}").alias("parent"), "v")
        items = inner if items is None else items.union(inner)
    every = read if items is None else read.union(items)
    fields = every.select("manifest", "parent", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("field", "v"))
    return fields.select("manifest", "parent", "field", F.to_json("v").alias("value"))


def unreadable(manifests: DataFrame, required: Sequence[str]) -> DataFrame:
    """Errors of required manifests that are missing or whose document is no JSON object."""
    known = manifests.sparkSession.createDataFrame([(m,) for m in required], "need string")
    both = known.join(manifests, F.col("need") == F.col("manifest"), "left")
    fine = F.try_variant_get(F.try_parse_json("document"), "$", "map<string,variant>").isNotNull()
    why = F.when(F.col("manifest").isNull(), "missing").when(~F.coalesce(fine, F.lit(False)), "no JSON object")
    return both.select(F.lit("manifest").alias("gate"), F.col("need").alias("subject"), why.alias("detail")).where("detail IS NOT NULL")


def broken(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Errors of the constraints that the facts do not meet; a field that is not there is null and meets nothing but null."""
    own = found.select(F.col("manifest").alias("f_manifest"), F.col("field").alias("f_field"), F.col("value").alias("got"))
    other = found.select(F.col("manifest").alias("o_manifest"), F.col("field").alias("o_field"), F.col("value").alias("other"))
    members = found.where("parent IS NOT NULL").select(F.col("parent").alias("p"), F.col("manifest").alias("member")).distinct()
    single = wanted.where("NOT each").withColumn("subject", F.col("manifest"))
    many = wanted.where("each").join(members, F.col("manifest") == F.col("p")).withColumn("subject", F.col("member")).drop("p", "member")
    rows = single.unionByName(many).join(own, (F.col("subject") == F.col("f_manifest")) & (F.col("field") == F.col("f_field")), "left")
    rows = rows.join(other, (F.col("of_manifest") == F.col("o_manifest")) & (F.col("of_field") == F.col("o_field")), "left")
    want = F.when(F.col("of_manifest").isNull(), F.col("expected")).otherwise(F.col("other"))
    shown = lambda c: F.coalesce(c, F.lit("nothing"))
    return rows.where(~F.col("got").eqNullSafe(want)).select(F.lit("constraint").alias("gate"), F.concat_ws(".", "subject", "field").alias("subject"), F.concat(shown(F.col("got")), F.lit(" is not "), shown(want)).alias("detail"))


def shared_value(found: DataFrame, parent: str, field: str) -> DataFrame:
    """An error unless all objects of a list have one and the same value in a field."""
    n = found.where((F.col("parent") == parent) & (F.col("field") == field)).agg(F.count_distinct("value").alias("n"))
    return n.where("n <> 1").select(F.lit("shared_value").alias("gate"), F.lit(f"{parent}.{field}").alias("subject"), F.concat(F.col("n").cast("string"), F.lit(" values")).alias("detail"))


def row_errors(panel: DataFrame, skills: Sequence[str], conditions: Sequence[str], endpoints: Sequence[str]) -> DataFrame:
    """Errors of single rows: unknown names, keys, and stored readings that differ from those computed from the completion.

    panel has skill, case, condition, endpoint, pairing_key, completion, gold (struct of decision, risk_level,
    need_human), and as stored: parse_failed, parsed_output (JSON), schema_errors, schema_valid, exact_correct,
    decision_correct, risk_level_correct, need_human_correct. A projection: one reading a row, no shuffle.
    """
    key = F.concat_ws("|", "skill", F.col("case").cast("string"), "condition", "endpoint")
    json_ = textjson.strict_object(F.col("completion"))
    rows = panel.withColumn("_key", key).withColumn("_json", json_).withColumn("_got", textjson.fields(F.col("_json"))).withColumn("_typed", textjson.values(F.col("_got")))
    rows = rows.withColumn("_errors", F.when(F.col("_json").isNull(), F.array().cast("array<string>")).otherwise(textjson.contract_errors(F.col("_json"), F.col("_got"), F.col("_typed"))))
    rows = rows.withColumn("_valid", F.col("_json").isNotNull() & (F.size("_errors") == 0))
    same = {f: F.col("_valid") & F.coalesce(F.col(f"_typed.{f}") == F.col(f"gold.{f}"), F.lit(False)) for f in ("decision", "risk_level", "need_human")}
    canonical = lambda c: F.to_json(F.try_parse_json(c))
    differs = lambda stored, now: ~F.coalesce(F.col(stored), F.lit(False)).eqNullSafe(now)
    unknown = lambda name, known: ~F.coalesce(F.col(name).isin(list(known)), F.lit(False))
    tests: dict[str, Column] = {
        "unexpected_skill": unknown("skill", skills), "unexpected_condition": unknown("condition", conditions), "unexpected_endpoint": unknown("endpoint", endpoints),
        "pairing_key": ~F.col("pairing_key").eqNullSafe(F.col("_key")), "sealed_marker": F.contains(F.lower(F.coalesce("pairing_key", F.lit(""))), F.lit(SEALED)),
        "parse_flag": differs("parse_failed", F.col("_json").isNull()), "parsed_output": F.when(F.col("parsed_output").eqNullSafe(F.col("_json")), False).otherwise(~canonical(F.col("parsed_output")).eqNullSafe(canonical(F.col("_json")))),
        "schema_errors": ~F.coalesce("schema_errors", F.array().cast("array<string>")).eqNullSafe(F.col("_errors")), "schema_flag": differs("schema_valid", F.col("_valid")),
        "exact_flag": differs("exact_correct", same["decision"] & same["risk_level"] & same["need_human"]),
        **{f"{f}_flag": differs(f"{f}_correct", same[f]) for f in same},
    }
    codes = F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items())))
    return rows.select(F.explode(codes).alias("gate"), F.col("_key").alias("subject"), F.lit("").alias("detail"))


def cases(panel: DataFrame, conditions: Sequence[str], endpoints: Sequence[str]) -> DataFrame:
    """One row a (skill, case): rows, a counter a cell (n0, n1, ...), rows of other cells, and extremes of target and family."""
    cells = [(c, e) for c in conditions for e in endpoints]
    counters = [F.count_if((F.col("condition") == c) & (F.col("endpoint") == e)).alias(f"n{i}") for i, (c, e) in enumerate(cells)]
    target = F.to_json(F.struct("gold.*"))
    stored = {"parse_failures": F.col("parse_failed"), "schema_failures": ~F.coalesce("schema_valid", F.lit(False)), "exact": F.col("exact_correct")}
    sums = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in stored.items()]
    ends = [f(c).alias(n) for f, c, n in ((F.min, target, "t_low"), (F.max, target, "t_high"), (F.min, F.col("family"), "f_low"), (F.max, F.col("family"), "f_high"))]
    found = panel.groupBy("skill", "case").agg(F.count("*").alias("rows"), *counters, *sums, *ends)
    return found.withColumn("cells", F.array(*(F.struct(F.lit(f"{c}|{e}").alias("cell"), F.col(f"n{i}").alias("n")) for i, (c, e) in enumerate(cells)))).drop(*(f"n{i}" for i in range(len(cells))))


def case_errors(by_case: DataFrame) -> DataFrame:
    """Errors of whole cases: doubled cells, missing or unknown ones, more than one target or family."""
    # All from one pass: a branch of a union each would make its own shuffle of the panel.
    error = lambda gate, subject, detail: F.struct(F.lit(gate).alias("gate"), subject.alias("subject"), detail.alias("detail"))
    kept = by_case.withColumn("_key", F.concat_ws("|", "skill", F.col("case").cast("string")))
    there = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    kept = kept.withColumn("_missing", F.size(F.filter("cells", lambda c: c["n"] == 0))).withColumn("_odd", F.col("rows") - there)
    doubled = F.transform(F.filter("cells", lambda c: c["n"] > 1), lambda c: error("duplicate_key", F.concat_ws("|", F.col("_key"), c["cell"]), c["n"].cast("string")))
    incomplete = F.when((F.col("_missing") > 0) | (F.col("_odd") > 0), error("incomplete_case", F.col("_key"), F.concat(F.col("_missing").cast("string"), F.lit(" missing, "), F.col("_odd").cast("string"), F.lit(" unknown"))))
    several = F.when(~F.col("t_low").eqNullSafe(F.col("t_high")) | ~F.col("f_low").eqNullSafe(F.col("f_high")), error("target_or_family", F.col("_key"), F.lit("")))
    return kept.select(F.explode(F.concat(doubled, F.array_compact(F.array(incomplete, several)))).alias("e")).select("e.*")


def panel_facts(panel: DataFrame, by_case: DataFrame, extra: dict[str, Any] | None = None) -> DataFrame:
    """The panel as a manifest named panel: counts, cases by skill, the ordered hash of its pairing keys, and given values."""
    once = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + (c["n"] > 0).cast("long"))
    names = ["rows", "unique_keys", "cases", "parse_failures", "schema_failures", "exact"]
    # Sums by skill, of which there are few, make both the totals and the cases of each skill.
    per = by_case.groupBy("skill").agg(*(F.sum(c).alias(n) for n, c in zip(names, (F.col("rows"), once, F.lit(1), F.col("parse_failures"), F.col("schema_failures"), F.col("exact")))))
    sums = per.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    fact = lambda field, value: [F.lit("panel").alias("manifest"), F.lit(None).cast("string").alias("parent"), field.alias("field"), value.alias("value")]
    counts = sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("string") for n in names)))).alias("field", "value")).select(*fact(F.col("field"), F.col("value")))
    skills = per.select(*fact(F.concat(F.lit("cases_"), "skill"), F.col("cases").cast("string")))
    hashed = layout.ordered_hash(panel, [], "pairing_key", "position").select(*fact(F.lit("ordered_sha256"), F.concat(F.lit('"'), "h", F.lit('"'))))
    out = counts.union(skills).union(hashed)
    if extra:
        out = out.union(panel.sparkSession.createDataFrame([("panel", None, f, literal(v)) for f, v in extra.items()], "manifest string, parent string, field string, value string"))
    return out


def engineering_gates(panel: DataFrame, manifests: DataFrame, wanted: DataFrame, skills: Sequence[str], conditions: Sequence[str], endpoints: Sequence[str], lists: Sequence[tuple[str, str]] = (), shared: Sequence[tuple[str, str]] = (), required: Sequence[str] = (), extra: dict[str, Any] | None = None) -> DataFrame:
    """All errors of a panel and its manifests. lists: lists of objects in manifests; shared: (list, field) with one value
    for all; required: manifests that must be there; extra: further facts of the panel, as the hash of its file."""
    by_case = cases(panel, conditions, endpoints)
    found = facts(manifests, lists).union(panel_facts(panel, by_case, extra))
    errors = unreadable(manifests, required).union(broken(found, wanted)).union(row_errors(panel, skills, conditions, endpoints)).union(case_errors(by_case))
    for parent, field in shared:
        errors = errors.union(shared_value(found, parent, field))
    return errors
