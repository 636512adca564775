"""Commands that select probes, gate checkpoints, lock splits and build smoke requests."""

import json

import pytest

from casewright import __main__ as command
from casewright.operators import builders, probes
from casewright.sources import files


def test_probe(spark, tmp_path):
    rows = [{"case_id": c, "context_load": k, "prompt_exposure": e} for c in "ab" for k in probes.CONTEXTS for e in probes.EXPOSURES]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, rows)))
    assert command.run(spark, ["probe", "--records", str(tmp_path / "in.json"), "--cases", "b,a", "--most", "1", "--output", str(tmp_path / "out")]) == 0
    got = [json.loads(x) for x in files.read_text(spark, str(tmp_path / "out") + "/part*").strip().split("\n")]
    assert [(r["case_id"], r["context_load"], r["prompt_exposure"]) for r in got] == [("b", k, e) for k in probes.CONTEXTS for e in probes.EXPOSURES]


def test_checkpoints(spark, tmp_path):
    cosine = {"full": {e: 0.5 for e in probes.EXPOSURES}}
    (tmp_path / "c1").mkdir()
    rows = [{"case_id": "x", "context_load": k, "rule_family": "f", "cosine": cosine} for k in probes.CONTEXTS]
    (tmp_path / "c1" / "per_case_metrics.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "c1" / "aggregate_summary.json").write_text('{"status": "pass", "record_count": 8}')
    options = ["checkpoints", "--root", str(tmp_path), "--output", str(tmp_path / "report"), "--checkpoint"]
    assert command.run(spark, [*options, "c1=8"]) == 0
    assert "| c1 | long | full | 1 | 0.5000 |" in files.read_text(spark, str(tmp_path / "report"))
    with pytest.raises(ValueError):
        command.run(spark, [*options, "c1=12"])


def test_lock_and_smoke(spark, tmp_path):
    cases = builders.skill_cases(spark, "refund", {"train": 20, "validation": 5, "confirmation": 5})
    files.write_jsonl(cases, str(tmp_path / "cases"))
    assert command.run(spark, ["lock", "--cases", str(tmp_path / "cases"), "--output", str(tmp_path / "lock")]) == 0
    found = {r["split"]: (r["cases"], r["locked"]) for r in spark.read.json(str(tmp_path / "lock")).collect()}
    assert found == {"train": (20, False), "validation": (5, False), "confirmation": (5, True)}
    assert command.run(spark, ["smoke", "--cases", str(tmp_path / "cases"), "--output", str(tmp_path / "smoke")]) == 0
    assert spark.read.json(str(tmp_path / "smoke")).count() == 2 * 7 * 2
    with pytest.raises(PermissionError):
        command.run(spark, ["smoke", "--cases", str(tmp_path / "confirmation"), "--output", str(tmp_path / "no")])
