"""Difficult cases, request texts, explanations, and who may be asked for factorial requests."""

import pytest
from pyspark.sql import functions as F

from casewright.operators import builders, requests, rules


def test_difficult_cases_come_first(spark):
    rows = builders.generate_samples(spark, 30, 3).orderBy("position").collect()
    want = ["within_7_days_unused", "fresh_goods_no_reason_denied", "customized_goods_no_reason_denied", "virtual_goods_denied", "over_7_days_no_quality_issue", "quality_issue_with_evidence", "quality_issue_no_evidence"]
    want += ["within_7_days_unused"] * 2 + ["used_or_not_resellable"] + ["quality_issue_with_evidence"] * 3 + ["quality_issue_no_evidence", "quality_issue_with_evidence", "within_7_days_unused", "logistics_issue"]
    assert [r["reason_codes"][0] for r in rows[:17]] == want and len(requests.DIFFICULT) == 17
    assert [r["decision"] for r in rows[7:10]] == ["manual_review"] * 3 and rows[15]["decision"] == "allow_exchange" and rows[16]["order_status"] == "not_delivered"
    assert builders.generate_samples(spark, 5, 3).count() == 5
    other = builders.generate_samples(spark, 30, 4).orderBy("position").collect()
    facts = builders.FACTS
    assert [[r[f] for f in facts] for r in rows[:17]] == [[r[f] for f in facts] for r in other[:17]] != [[r[f] for f in facts] for r in rows[13:]]


def test_texts(spark):
    rows = {r["position"]: r for r in builders.generate_samples(spark, 17, 1).collect()}
    assert rows[5]["user_input"] == "It is 9 days old: a jacket, and it does not fit. Please take it back." and rows[5]["evidence_description"] is None
    assert rows[6]["evidence_description"] == "Photos or a film are attached." and rows[7]["evidence_description"] == "No usable photos so far."
    assert rows[10]["user_input"].endswith("The box is torn.") and "tried" not in rows[10]["user_input"]
    assert rows[17]["evidence_description"].startswith("The tracking shows") and rows[14]["user_input"].startswith("This is outrageous")
    some = spark.createDataFrame([("x", None, None, "zzz", None, None)], "product_type string, days_since_delivery int, is_resellable boolean, user_claim string, is_used boolean, has_evidence boolean").withColumn("seller_fault", F.lit(None).cast("boolean"))
    assert some.select(requests.request(F.lit(0.0)), requests.evidence()).first()[:] == ("It is some days old: goods. I changed my mind.", None)


def test_explanations(spark):
    base = {**requests.COMMON, "is_fresh": False, "is_customized": False, "is_virtual": False}
    kinds = {bool: "boolean", int: "int", str: "string"}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items())
    changes = [{}, dict(order_amount=1000, refund_count_30d=3), dict(days_since_delivery=None, order_status="lost", evidence_conflict=True)]
    got = rules.explain_refund(spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], ddl)).collect()
    assert {r["explanation"] for r in got} == {
        "Unused within a week: the goods can come back.", "Unused within a week: the goods can come back. A person decides because of: high_value_order, frequent_refund_user.",
        "The order does not tell days_since_delivery, order_status.",
    }


def test_factorial_and_smoke_requests(spark):
    cases = spark.createDataFrame([(s, split, f"{s}{split}{k}", "{}") for s in "ab" for split, n in (("discovery_eval", 64), ("validation", 2)) for k in range(n)], "skill_id string, split string, semantic_case_hash string, fields string")
    found = builders.factorial_requests(cases)
    assert found.count() == 2 * 1152 and found.where("placement = 'user'").count() == 2 * 128 and found.where("placement = 'user' AND factor_levels IS NOT NULL").isEmpty()
    placed = found.where("placement = 'user'").first()["messages"]
    assert len(placed) == 1 and placed[0]["content"].startswith("You decide cases of ") and placed[0]["content"].endswith("\n\n{}")
    assert {r["n"] for r in found.where("condition = 'isb_000'").select(F.size("messages").alias("n")).collect()} == {1}
    smoke = builders.smoke_requests(cases.where("split = 'validation'"))
    assert smoke.count() == 2 * 2 * 2 * 7 and smoke.select("split").distinct().first()[0] == "validation_smoke" and smoke.select("record_id").distinct().count() == 56
    with pytest.raises(PermissionError):
        builders.smoke_requests(cases)
    with pytest.raises(ValueError):
        builders.smoke_requests(cases.where("split = 'validation'").limit(3))
    with pytest.raises(ValueError):
        builders.factorial_requests(cases.where("semantic_case_hash <> 'adiscovery_eval3'"))
