import pytest

from casewright.sources import files


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "乙", None), (1, "甲", "x")], "position int, b string, a string")
    path = str(tmp_path / "rows")
    files.write_jsonl(df, path, "position")
    text = files.read_text(spark, path + "/part*").strip().split("\n")
    assert text == ['{"a":"x","b":"甲"}', '{"b":"乙"}']
    files.write_jsonl(df, path, mode="append")
    assert files.read_jsonl(spark, path, "a string, b string").count() == 4
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_jsonl(df, path, mode="errorifexists")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_tagged_and_checkpoints(spark, tmp_path):
    for name, n in (("one", 2), ("two", 3)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "per_case_metrics.jsonl").write_text('{"v": 1}\n' * n)
    got = files.read_checkpoints(spark, str(tmp_path), {"one": 2, "two": 3}, "v int")
    assert {r[0]: r[1] for r in got.groupBy("checkpoint_id").count().collect()} == {"one": 2, "two": 3}
    with pytest.raises(ValueError):
        files.read_checkpoints(spark, str(tmp_path), {"one": 2, "two": 4}, "v int")
    assert files.parse_tagged("m=/a/b.jsonl") == ("m", "/a/b.jsonl") and files.parse_tagged("/a/b.jsonl") == ("b", "/a/b.jsonl")


def test_reports(spark, tmp_path):
    files.write_json(spark, {"b": [1, "二"], "a": None}, str(tmp_path / "doc"))
    assert files.read_json(spark, str(tmp_path / "doc")) == {"a": None, "b": [1, "二"]}
    table = files.markdown_table(spark.createDataFrame([("x|y", 0.5, None)], "n string, rate double, v double"), percent=("rate",))
    assert table.split("\n")[2] == "| x\\|y | 50.00% | n/a |"
    with pytest.raises(PermissionError):
        files.reject_protected("/data/Confirmation/x")


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text("x = 1\nkey = 'sk-" + "a" * 24 + "'\n")
    (tmp_path / "b.bin").write_text("sk-" + "a" * 24)
    (tmp_path / "c.md").write_text("y" * 100)
    got = {(r["path"].rsplit("/", 1)[1], r["line"], r["finding"]) for r in files.scan_release(spark, str(tmp_path), most_bytes=90).collect()}
    assert got == {("a.py", 2, "openai_key"), ("c.md", 0, "too_large"), ("b.bin", 0, "pointer")}
    assert files.file_hashes(spark, str(tmp_path)).count() == 3


def test_scan_tells_every_match_and_keeps_the_order_of_tests(spark, tmp_path):
    key, token = "sk-" + "a" * 24, "hf_" + "b" * 24
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.py").write_text(key)
    (tmp_path / "a.YML").write_text(f"{key} {key}\n\n{token}\r\npassword = 'two\nlines' {key}\n")
    (tmp_path / "prod.env").write_text(f"\n{key}")
    (tmp_path / ".env").write_text(key)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe " + key.encode())
    (tmp_path / "big.weights").write_bytes(b"x" * 3000)
    (tmp_path / "m.safetensors").write_bytes(b"x" * 300)
    found = files.scan_release(spark, str(tmp_path), most_bytes=2000)
    got = sorted((r["path"].rsplit("/", 1)[1], r["line"], r["finding"]) for r in found.collect())
    assert got == [("a.YML", 1, "openai_key"), ("a.YML", 1, "openai_key"), ("a.YML", 3, "hf_token"), ("a.YML", 4, "credential_assignment"), ("a.YML", 5, "openai_key"), ("big.weights", 0, "too_large"), ("prod.env", 2, "openai_key")]
    row = files.scan_status(found).first()
    assert (row["openai_key"], row["too_large"], row["status"]) == (4, 1, "review_required")
    assert files.scan_status(found.where("false")).first()["status"] == "pass"


def test_checkpoints_are_gated_by_their_summaries(spark, tmp_path):
    import json

    def run(name, rows=2, summary={"status": "pass", "record_count": 8}, own=None):
        (tmp_path / name).mkdir()
        (tmp_path / name / "per_case_metrics.jsonl").write_text("".join(json.dumps({"v": k, **({"checkpoint_id": own} if own else {})}) + "\n" for k in range(rows)))
        if summary is not None:
            (tmp_path / name / "aggregate_summary.json").write_text(json.dumps(summary))

    run("good")
    run("named", own="named")
    run("failed", summary={"status": "fail", "record_count": 8})
    run("short", summary={"status": "pass", "record_count": 7})
    run("rows", rows=1)
    run("other", own="good")
    run("silent", summary=None)
    run("odd", summary=[1])
    run("unexpected", rows=9)
    expected = spark.createDataFrame([(k, 8) for k in ("good", "named", "failed", "short", "rows", "other", "silent", "odd", "gone")], "checkpoint_id string, records long")
    schema = "v int, checkpoint_id string"
    found = files.checkpoint_errors(files.checkpoint_runs(spark, str(tmp_path), schema), files.checkpoint_summaries(spark, str(tmp_path)), expected, 4)
    assert {tuple(r) for r in found.collect()} == {
        ("failed", "did not pass"), ("short", "incomplete records"), ("rows", "incomplete rows"), ("other", "rows of another checkpoint"), ("silent", "no summary"),
        ("odd", "did not pass"), ("odd", "incomplete records"), ("gone", "no summary"), ("gone", "incomplete rows"),
    }
    got = files.read_checkpoints(spark, str(tmp_path), {"good": 8, "named": 8}, schema, 4, summaries=True)
    assert sorted((r["checkpoint_id"], r["v"]) for r in got.collect()) == [("good", 0), ("good", 1), ("named", 0), ("named", 1)]
    with pytest.raises(ValueError, match="did not pass"):
        files.read_checkpoints(spark, str(tmp_path), {"good": 8, "failed": 8}, schema, 4, summaries=True)
