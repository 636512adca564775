"""Engineering gates: no error where nothing is wrong, and exactly the planted one otherwise."""

import json

from casewright.operators import gates

SKILLS, CONDITIONS, ENDPOINTS = ["s", "t"], ["full", "none"], ["x", "y"]
ANSWER = {"decision": "deny", "explanation": "e", "intent": "complaint", "need_human": False, "reason_codes": ["logistics_issue"], "risk_level": "low"}
DDL = """skill string, case string, family string, condition string, endpoint string, position long, pairing_key string, completion string, gold struct<decision: string, risk_level: string, need_human: boolean>,
 parse_failed boolean, parsed_output string, schema_errors array<string>, schema_valid boolean, exact_correct boolean, decision_correct boolean, risk_level_correct boolean, need_human_correct boolean"""


def row(skill, case, condition, endpoint, position):
    text = json.dumps(ANSWER)
    return {
        "skill": skill, "case": case, "family": "f", "condition": condition, "endpoint": endpoint, "position": position, "pairing_key": f"{skill}|{case}|{condition}|{endpoint}", "completion": text, "gold": ("deny", "low", False),
        "parse_failed": False, "parsed_output": json.dumps(dict(reversed(ANSWER.items()))), "schema_errors": [], "schema_valid": True, "exact_correct": True, "decision_correct": True, "risk_level_correct": True, "need_human_correct": True,
    }


def rows():
    cells = [(s, c, k, e) for s in SKILLS for c in ("1", "2") for k in CONDITIONS for e in ENDPOINTS]
    return [row(*x, i + 1) for i, x in enumerate(cells)]


def documents(**changes):
    runs = [{"arm": a, "steps": 2, "initial": "h"} for a in "ab"]
    out = {"done": {"status": "pass", "n": 16, "exact": 16}, "formal": {"runs": runs, "run_count": 2}}
    for name, of in changes.items():
        out[name] = None if of is None else {**out[name], **of}
    return [(m, json.dumps(d)) for m, d in out.items() if d is not None]


def errors(spark, panel, manifests):
    wanted = gates.constraints(spark, {"done": {"status": "pass"}, "formal": {"run_count": 2}}, [("done", "n", "panel", "rows"), ("done", "n", "panel", "unique_keys"), ("done", "exact", "panel", "exact"), ("panel", "cases_s", "panel", "cases_t")], {"formal.runs": {"steps": 2}})
    panel = spark.createDataFrame([tuple(r.values()) for r in panel], DDL)
    found = gates.engineering_gates(panel, spark.createDataFrame(manifests, "manifest string, document string"), wanted, SKILLS, CONDITIONS, ENDPOINTS, [("formal", "runs")], [("formal.runs", "initial")], ["done", "formal"])
    return sorted((r["gate"], r["subject"], r["detail"]) for r in found.collect())


def test_nothing_is_wrong(spark):
    assert errors(spark, rows(), documents()) == []


KEY, CASE = "s|1|full|x", "s|1"
#: What is changed in one row of a case, and the errors of row and case that follow.
CHANGES = [
    ({"pairing_key": "s|1|full|z"}, ["pairing_key"], []),
    ({"pairing_key": None}, ["pairing_key"], []),
    ({"parse_failed": True}, ["parse_flag"], []),
    ({"parsed_output": None}, ["parsed_output"], []),
    ({"parsed_output": json.dumps({**ANSWER, "more": 1})}, ["parsed_output"], []),
    ({"schema_errors": ["invalid_decision"]}, ["schema_errors"], []),
    ({"schema_valid": False}, ["schema_flag"], []),
    ({"decision_correct": None}, ["decision_flag"], []),
    ({"need_human_correct": False}, ["need_human_flag"], []),
    ({"family": "g"}, [], ["target_or_family"]),
    ({"exact_correct": False}, ["exact_flag"], []),
    ({"completion": json.dumps(ANSWER).replace('"', "'")}, ["decision_flag", "exact_flag", "need_human_flag", "parse_flag", "parsed_output", "risk_level_flag", "schema_flag"], []),
    ({"gold": ("deny", "high", False)}, ["exact_flag", "risk_level_flag"], ["target_or_family"]),
]


def test_each_wrong_row_is_told(spark):
    cells = [(s, str(c), k, e) for s in SKILLS for c in range(len(CHANGES)) for k in CONDITIONS for e in ENDPOINTS]
    panel, want = [row(*x, i + 1) for i, x in enumerate(cells)], [("constraint", "done.exact", f"{len(cells)} is not {len(cells) - 1}")]
    for k, (change, of_row, of_case) in enumerate(CHANGES):
        panel[4 * k].update(change)
        want += [(g, f"s|{k}|full|x", "") for g in of_row] + [(g, f"s|{k}", "") for g in of_case]
    assert errors(spark, panel, documents(done={"n": len(cells), "exact": len(cells)})) == sorted(want)


def test_cells(spark):
    panel = rows()
    assert errors(spark, panel[1:], documents(done={"n": 15, "exact": 15})) == [("incomplete_case", CASE, "1 missing, 0 unknown")]
    doubled = errors(spark, panel + panel[:1], documents(done={"exact": 17}))
    assert doubled == [("constraint", "done.n", "16 is not 17"), ("duplicate_key", KEY, "2")]
    odd = [{**panel[0], "endpoint": "z", "pairing_key": "s|1|full|z"}] + panel[1:]
    assert errors(spark, odd, documents()) == [("constraint", "done.n", "16 is not 15"), ("incomplete_case", CASE, "1 missing, 1 unknown"), ("unexpected_endpoint", "s|1|full|z", "")]
    sealed = [{**r, "skill": "confirmation", "pairing_key": "confirmation" + r["pairing_key"][1:]} if r["skill"] == "t" else r for r in panel]
    found = errors(spark, sealed, documents())
    assert {g for g, _, _ in found} == {"sealed_marker", "unexpected_skill", "constraint"} and ("constraint", "panel.cases_s", "2 is not nothing") in found


def test_manifests(spark):
    assert errors(spark, rows(), documents(done=None)) == [("constraint", "done.exact", "nothing is not 16"), ("constraint", "done.n", "nothing is not 16"), ("constraint", "done.n", "nothing is not 16"), ("constraint", "done.status", 'nothing is not "pass"'), ("manifest", "done", "missing")]
    runs = [{"arm": "a", "steps": 2, "initial": "h"}, {"arm": "b", "steps": "2", "initial": "i"}]
    assert errors(spark, rows(), documents(formal={"runs": runs})) == [("constraint", "formal.runs[1].steps", '"2" is not 2'), ("shared_value", "formal.runs.initial", "2 values")]
    assert ("manifest", "done", "no JSON object") in errors(spark, rows(), [("done", "[1]"), documents()[1]])


def test_the_panel_is_grouped_by_case_once_for_all_case_errors(spark):
    panel = spark.createDataFrame([tuple(r.values()) for r in rows()], DDL)
    plan = gates.case_errors(gates.cases(panel, CONDITIONS, ENDPOINTS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
