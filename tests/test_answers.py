from pyspark.sql import functions as F

from casewright.functions import scoring, textjson
from casewright.streaming import scoring as streaming

RIGHT = '{"intent":"complaint","decision":"deny","risk_level":"low","need_human":false,"reason_codes":["logistics_issue"],"explanation":"x"}'
GOLD = ("deny", "low", False, ["logistics_issue"])


def errors(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(textjson.contract_errors(textjson.lenient(F.col("t")))).collect()]


def test_contract(spark):
    found = errors(spark, RIGHT, f"```json\n{RIGHT}\n```", f"Well: {RIGHT} ok", RIGHT.replace("false", '"false"'), RIGHT.replace('"deny"', "3"), "[1]", '"x"', "", None, RIGHT.replace('["logistics_issue"]', '["zzz"]'), RIGHT.replace('["logistics_issue"]', "[1]"), RIGHT.replace('"x"', '""'), "{}")
    assert found[:3] == [[], [], []]
    assert found[3:] == [["need_human_not_boolean"], ["invalid_decision"], ["not_an_object"], ["not_an_object"], ["not_json"], ["not_json"], ["invalid_reason_codes"], ["reason_codes_not_strings"], ["explanation_empty"], ["missing_fields"]]


def test_strict_and_lenient_differ_on_duplicates(spark):
    text = '{"a":{"b":1,"b":2}}'
    df = spark.createDataFrame([(text,), ('<think>\n\n</think>\n\n{"a":1}',), ('{"a":1} x',), ("[1]",), ('{"a":1}',)], "t string")
    got = df.select(textjson.strict_object(F.col("t")).alias("s"), textjson.lenient(F.col("t")).alias("l")).collect()
    assert [r["s"] for r in got] == [None, '{"a":1}', None, None, '{"a":1}']
    assert [r["l"] for r in got] == [text, '{"a":1}', '{"a":1}', "[1]", '{"a":1}']
    first = spark.createDataFrame([('[{"a":1}]',)], "t string")
    assert first.select(textjson.lenient(F.col("t")), textjson.braces_first(F.col("t"))).first()[:] == ('[{"a":1}]', '{"a":1}')


def test_what_is_json(spark):
    whole = ['{"a":1}', "[1, 2]", ' 3 ', '"]"', '{"a":"}],["}', "null", '["it\'s", "\\"\'"]', "[\n1,\t2 ]", '["' + "a\\n" * 20_000 + '"]', "[" + '"a",' * 20_000 + "1]"]
    broken = ['{"a":1}] x', '{"a":1}],[{"b":2}', "1],[2", "1,2", "", "[", "]", '{"a":1}}', '{"a":1}, 1', '{"a":1},{"a":1}', '"a', "1]", '1,"x"]', None, "{'a':1}", "['a']", "'a'", '{"a":\'b\'}', '["a\nb"]', '["a\tb"]', '["a\x01b"]', '{"a\nb":1}', '["a\n","b"]', '["a\\\'b"]', '["\\\n"]']
    df = spark.createDataFrame([(t,) for t in whole + broken], "t string")
    got = df.select(textjson.is_json(F.col("t")).alias("j"), textjson.strict_object(F.col("t")).alias("s")).collect()
    assert [r["j"] for r in got] == [True] * len(whole) + [False] * len(broken)
    assert [r["s"] for r in got if r["s"]] == [whole[0], whole[4]]


def rewarded(spark, texts, mode="offline", gold=GOLD):
    rows = [("s", e, i, [], t, gold) for i, (e, t) in enumerate(zip(["full", "partial", "minimal", "no_skill"], texts))]
    df = spark.createDataFrame(rows, "sample_id string, prompt_exposure string, position int, hard_tags array<string>, prediction string, gold struct<decision: string, risk_level: string, need_human: boolean, reason_codes: array<string>>")
    return scoring.rewards(scoring.score_answers(scoring.read_answers(df, mode)), mode).orderBy("position").collect()


def test_consistency(spark):
    right = rewarded(spark, [RIGHT] * 2)
    assert abs(right[0]["exposure_consistency_reward"] - 1.0) < 1e-12 and right[0]["available_pairs"] == 1
    wrong = rewarded(spark, [RIGHT.replace('"deny"', '"allow_refund"')] * 2)
    assert abs(wrong[0]["exposure_consistency_reward"] + 0.1) < 1e-12 and wrong[0]["wrong_high_similarity_pairs"] == 1
    explained = rewarded(spark, [RIGHT, RIGHT.replace('"x"', '"other words"')])
    assert abs(explained[0]["exposure_consistency_reward"] - 1.0) < 1e-12


def test_false_manual_review(spark):
    review = RIGHT.replace('"deny"', '"manual_review"').replace("false", "true").replace('"low"', '"high"').replace("logistics_issue", "manual_review_required")
    row = rewarded(spark, [review])[0]
    assert row["false_manual_review_penalty"] == 1.0 and row["total_reward"] < 0.1


def test_metrics_of_gold_and_of_nothing(spark):
    rows = rewarded(spark, [RIGHT])
    assert rows[0]["s_decision"] == rows[0]["s_f1"] == 1.0
    bad = rewarded(spark, ["no json"])
    assert bad[0]["s_json"] == bad[0]["s_decision"] == bad[0]["s_f1"] == 0.0
    empty = spark.createDataFrame([], ", ".join(f"{c} double" for c in scoring.METRICS.values()))
    assert scoring.metrics(empty).first()["overall_score"] == 0.0


def test_code_f1(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "a", "b"], ["b"]), (None, None)], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(scoring.code_f1(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.666667, 1.0]


def test_stream(spark, tmp_path):
    rows = [("s1", e, i, [], RIGHT, "2024-01-01T00:00:00", GOLD) for i, e in enumerate(["full", "partial"])]
    df = spark.createDataFrame(rows, "sample_id string, prompt_exposure string, position int, hard_tags array<string>, prediction string, arrived string, gold struct<decision: string, risk_level: string, need_human: boolean, reason_codes: array<string>>")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    answers = streaming.read_answers(spark, str(tmp_path / "in"))
    assert streaming.windowed_validity(answers).isStreaming
    streaming.write_rewards(answers, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and out.where("exposure_consistency_reward = 1").count() == 2


def test_stream_with_lookup(spark, tmp_path):
    """Bare completions joined with the lookup's last rows; consistency within the micro-batch only."""
    import json

    from casewright.functions import messages

    wrong = RIGHT.replace('"deny"', '"allow_refund"')
    prompts = [("s1", "full", RIGHT), ("s1", "partial", RIGHT), ("s2", "full", wrong), ("s2", "partial", wrong), ("s3", "full", RIGHT), (None, None, RIGHT), ("s1", "minimal", RIGHT)]
    rows = [{"row_index": k, "prompt": f"sample_id: {s}\nprompt_exposure: {e}" if s else "hello", "prediction": p} for k, (s, e, p) in enumerate(prompts)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(map(json.dumps, rows[:6])))
    (source / "b.json").write_text(json.dumps(rows[6]))
    gold = lambda d: (d, "low", False, ["logistics_issue"])
    lookup = spark.createDataFrame([("s1", 0, gold("allow_refund"), ["old"]), ("s1", 1, gold("deny"), ["tag"]), ("s2", 0, gold("deny"), [])], f"sample_id string, position int, gold {scoring.CORE}, hard_tags array<string>")
    completions = streaming.read_completions(spark, str(source), 1)
    streaming.write_online_rewards(completions, lookup, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["row_index"]: r for r in spark.read.parquet(str(tmp_path / "out" / "rewards")).collect()}
    assert len(got) == 7 and got[5]["sample_id"] == "row_5" and got[5]["prompt_exposure"] == "unknown"
    assert got[0]["decision_reward"] == got[0]["hard_case_bonus"] == got[0]["exposure_consistency_reward"] == 1.0 and abs(got[0]["total_reward"] - 1.0) < 1e-12
    assert abs(got[2]["exposure_consistency_reward"] + 0.1) < 1e-12 and got[2]["decision_reward"] == 0.0
    assert got[4]["decision_reward"] == got[4]["exposure_consistency_reward"] == 0.0 and got[4]["schema_reward"] == 1.0
    assert got[6]["decision_reward"] == 1.0 and got[6]["exposure_consistency_reward"] == 0.0
    whole = spark.createDataFrame([(r["row_index"], r["prompt"], r["prediction"]) for r in rows], "row_index long, prompt string, prediction string").selectExpr("*", "null::string sample_id", "null::string prompt_exposure", "null::array<string> hard_tags", f"null::{scoring.CORE.replace('struct', 'STRUCT')} gold")
    together = {r["row_index"]: r for r in scoring.online_rewards(scoring.with_gold(whole, lookup)).collect()}
    assert together[6]["exposure_consistency_reward"] == 1.0 and all(together[k]["total_reward"] == got[k]["total_reward"] for k in (2, 3, 4, 5))
    texts = spark.createDataFrame([("a\nsk-x",), ("",), (None,)], "t string").select(messages.match_lines(F.col("t"), "sk-")).collect()
    assert [r[0] for r in texts] == [[2], [], None]


def test_reward_summary_and_order(spark):
    models = {"a": ["s1", "s2"], "b": ["s3"]}
    rows = []
    for model, samples in models.items():
        for s in samples:
            text = RIGHT if s != "s2" else RIGHT.replace('"deny"', '"allow_refund"')
            rows += [(model, s, e, i, [], text, GOLD) for i, e in enumerate(["full", "partial"])]
    df = spark.createDataFrame(rows, f"model string, sample_id string, prompt_exposure string, position int, hard_tags array<string>, prediction string, gold {scoring.CORE}")
    found = scoring.reward_summary(scoring.rewards(scoring.score_answers(scoring.read_answers(df)))).cache()
    got = {(r["model"], r["prompt_exposure"]): r for r in found.collect()}
    assert len(got) == 6 and got["a", None]["records"] == 4 and got["a", None]["groups"] == 2 and got["a", "full"]["groups"] is None
    assert got["a", None]["wrong_high_similarity_groups"] == 1 and abs(got["a", None]["group_consistency"] - 0.45) < 1e-12 and got["b", None]["group_consistency"] == 1.0
    assert got["a", "full"]["decision_reward"] == 0.5
    for wanted, passed in ((["b", "a"], True), (["a", "b"], False), (["b"], True), (["b", "c"], False)):
        assert scoring.order_gate(found, wanted).first()[:] == (["b", "a"], passed)


def test_answers_of_a_sample_are_compared_in_one_row(spark):
    """Every row of a sample has the terms that consistency() gives for it; pairs are compared in its first row alone."""
    right, wrong = ("deny", "low", False, ["a"]), ("allow_refund", "low", False, ["b"])
    rows = [(s, e, p, got, right, got is not None, ["x"]) for s in range(6) for p, (e, got) in enumerate([("full", right), ("partial", wrong if s % 2 else right), ("minimal", wrong), ("no_skill", None if s % 3 else wrong), ("full", wrong if s == 4 else right), ("other", right)])]
    rows += [(9, "other", 0, right, right, True, ["x"]), (10, "full", 0, right, None, True, ["x"]), (10, "partial", 0, right, None, True, ["x"])]
    df = spark.createDataFrame(rows, f"sample_id long, prompt_exposure string, position int, got {scoring.CORE}, gold {scoring.CORE}, schema_valid boolean, hard_tags array<string>")
    df = scoring.score_answers(df.withColumn("json_valid", F.lit(True)))
    for mode in ("offline", "online"):
        done = scoring.rewards(df, mode).select("sample_id", *scoring.TERMS).collect()
        one = {r[0]: tuple(r)[1:] for r in scoring.consistency(df, mode).collect()}
        assert len(done) == len(rows) and all(tuple(r)[1:] == one.get(r[0], (0, 0.0, 0)) for r in done)
        assert len({v for v in one.values()}) > 3
    plan = scoring.rewards(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN ((_one" in plan
