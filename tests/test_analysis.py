import pytest

from casewright import __main__ as cli
from casewright.operators import builders
from casewright.plans import analysis
from casewright.sources import files

GOLD = ("deny", "low", False, ["logistics_issue"])
RIGHT = '{"intent":"complaint","decision":"deny","risk_level":"low","need_human":false,"reason_codes":["logistics_issue"],"explanation":"x"}'


def predictions(spark, staged_wrong=False):
    rows = []
    for s in "abc":
        for c in range(4):
            for k in builders.CONDITIONS:
                for e in builders.ENDPOINTS:
                    wrong = (e == "random_mix_order" and k in analysis.ROBUST and c < 2) != staged_wrong
                    rows.append((s, f"{s}{c}", f"f{c % 2}", k, e, RIGHT.replace('"deny"', '"allow_refund"') if wrong else RIGHT, GOLD))
    return spark.createDataFrame(rows, cli.PANEL)


def test_analysis(spark):
    panel = analysis.from_predictions(predictions(spark)).cache()
    tables = analysis.analyse(panel, 50)
    assert {r["skill"]: round(r["delta"], 9) for r in tables["primary"].collect()} == {k: 0.5 for k in ("a", "b", "c", "macro")}
    row = tables["decision"].first()
    assert row["data_valid"] and row["guards_pass"] and abs(row["macro"] - 0.5) < 1e-9
    for name in ("case", "family"):
        assert abs(row[f"{name}_lower"] - tables[f"{name}_bootstrap"].first()["ci95_lower"]) < 1e-9
    assert row["state"] == ("PASS" if min(row["case_lower"], row["family_lower"]) > 0 else "INCONCLUSIVE")
    gap = analysis.analyse(panel.where("NOT (case = 'a0' AND condition = 'no_skill')"), 20)["decision"].first()
    assert gap["state"] == "DATA_INVALID"
    assert tables["robust_tests"].count() == 12 and tables["canonical_tests"].where("p_value = 1").count() == 3
    assert analysis.gate_errors(panel).isEmpty()
    broken = analysis.gate_errors(panel.where("NOT (case = 'a0' AND condition = 'full')"))
    assert broken.count() == 1


def test_vector_summary(spark):
    m = lambda v: {"full": {"full": 1.0, "minimal": v}}
    rows = [(c, k, "ck", "f", m(v)) for c, k, v in (("x", "short", 0.5), ("x", "long", 0.7), ("y", "short", 0.1), ("y", "long", 0.4))]
    got = analysis.vector_summary(spark.createDataFrame(rows, cli.RECORDS))
    delta = got["context_delta"].where("exposure = 'minimal'").first()
    assert delta["n"] == 2 and abs(delta["mean"] - 0.25) < 1e-12 and delta["positive"] == 1.0
    assert got["families"].count() == 1
    with pytest.raises(Exception, match="lacks a context"):
        analysis.vector_summary(spark.createDataFrame(rows[:3], cli.RECORDS))["context_delta"].collect()


def test_layouts_of_arms(spark):
    arms = builders.training_arms(builders.skill_cases(spark, "refund"))
    assert analysis.layout_errors(arms).isEmpty()


def test_commands(spark, tmp_path):
    assert cli.run(spark, ["generate", "--output-dir", str(tmp_path / "g"), "--sample-count", "24"]) == 0
    assert spark.read.json(str(tmp_path / "g" / "eval_prompts")).count() == 96
    assert cli.run(spark, ["export", "--source", str(tmp_path / "g" / "no_skill_sft"), "--output", str(tmp_path / "e")]) == 0
    assert cli.run(spark, ["mix", "--method", "random_mix", "--records", "24", "--output", str(tmp_path / "m")]) == 0
    predictions(spark).write.json(str(tmp_path / "p"))
    assert cli.run(spark, ["analyze", "--predictions", str(tmp_path / "p"), "--output", str(tmp_path / "r"), "--draws", "20"]) == 0
    assert "## decision" in files.read_text(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("s", e, i, [], "original", "none", RIGHT, GOLD) for i, e in enumerate(builders.EXPOSURES)], cli.ANSWERS)
    rows.write.json(str(tmp_path / "a"))
    for command in (["evaluate", "--predictions", str(tmp_path / "a")], ["rewards", "--model", f"m={tmp_path}/a"], ["ablation-summary", "--model", f"m={tmp_path}/a"]):
        assert cli.run(spark, [*command, "--output", str(tmp_path / command[0])]) == 0
    assert "1.0000" in files.read_text(spark, str(tmp_path / "evaluate"))
    with pytest.raises(PermissionError):
        cli.run(spark, ["analyze", "--predictions", "/x/confirmation", "--output", str(tmp_path / "z")])
