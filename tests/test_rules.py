import pytest
from pyspark.sql import functions as F

from casewright.operators import builders, rules

BASE = dict(product_type="clothing", days_since_delivery=3, is_used=False, is_resellable=True, has_quality_issue=False, has_evidence=False, order_amount=199, refund_count_30d=0, user_claim="no_reason", order_status="delivered", is_customized=False, is_virtual=False, is_fresh=False, seller_fault=False, logistics_issue=False, evidence_conflict=False, order_info_conflict=False)
DDL = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in BASE.items())

GOLDEN = [
    ({}, ("return_refund_request", "allow_return_refund", "low", False, ["within_7_days_unused"])),
    (dict(product_type="virtual", is_virtual=True), ("return_refund_request", "deny", "low", False, ["virtual_goods_denied"])),
    (dict(has_quality_issue=True, user_claim="quality_issue"), ("refund_request", "request_more_evidence", "medium", False, ["quality_issue_no_evidence"])),
    (dict(order_amount=2499), ("return_refund_request", "manual_review", "medium", True, ["within_7_days_unused", "high_value_order", "manual_review_required"])),
    (dict(is_used=True, user_claim="claims_unused_but_used"), ("refund_request", "manual_review", "high", True, ["used_or_not_resellable", "order_info_conflict", "manual_review_required"])),
    (dict(user_claim="exchange"), ("exchange_request", "allow_exchange", "low", False, ["within_7_days_unused"])),
    (dict(days_since_delivery=None, evidence_conflict=True), ("return_refund_request", "request_more_evidence", "medium", False, ["manual_review_required"])),
    (dict(order_status="lost"), ("return_refund_request", "request_more_evidence", "medium", False, ["manual_review_required"])),
    (dict(order_amount=1000, refund_count_30d=3), ("return_refund_request", "manual_review", "high", True, ["within_7_days_unused", "high_value_order", "frequent_refund_user", "manual_review_required"])),
    (dict(logistics_issue=True, user_claim="logistics_issue"), ("refund_request", "request_more_evidence", "medium", False, ["logistics_issue"])),
]


def test_refund_golden(spark):
    rows = [(i, *{**BASE, **change}.values()) for i, (change, _) in enumerate(GOLDEN)]
    found = rules.decide_refund(spark.createDataFrame(rows, f"i int, {DDL}")).orderBy("i").collect()
    for row, (change, want) in zip(found, GOLDEN):
        assert (row["intent"], row["decision"], row["risk_level"], row["need_human"], row["reason_codes"]) == want, change


def test_normalised_reads_text(spark):
    df = spark.createDataFrame([("Yes ", "x", "12", "virtual"), ("no", "7", None, "home")], "is_used string, order_amount string, days_since_delivery string, product_type string")
    a, b = rules.normalised(df).orderBy(F.desc("is_used")).collect()
    assert (a["is_used"], a["order_amount"], a["days_since_delivery"], a["is_virtual"], a["seller_fault"]) == (True, 0, 12, True, False)
    assert (b["is_used"], b["order_amount"], b["days_since_delivery"], b["is_virtual"]) == (False, 7, None, False)


@pytest.mark.parametrize("skill", ["refund", "warranty", "expense"])
def test_every_code_is_reachable_and_in_domain(spark, skill):
    cases = builders.skill_cases(spark, skill)
    per_code = {r["code"]: r["count"] for r in cases.groupBy("code").count().collect()}
    assert set(per_code) == {r.code for r in rules.ENGINES[skill]}
    rows = [(c, *{**builders.BASE[skill], **o}.values()) for c, o in builders.CASES[skill].items()]
    bad = rules.violations(spark.createDataFrame(rows, f"wanted string, {builders._ddl(skill)}"), skill).where("size(violations) > 0")
    assert bad.count() == 0


def test_recheck_finds_spoiled(spark):
    df = spark.createDataFrame([tuple(builders.BASE["warranty"].values())], builders._ddl("warranty"))
    stored = rules.decide(df, "warranty")
    assert rules.recheck(stored, "warranty").isEmpty()
    assert rules.recheck(stored.withColumn("decision", F.lit("reject")), "warranty").count() == 1


def test_require_keys():
    class D:
        columns = ["a", "b"]

    rules.require_keys(D, ["b", "a"])
    with pytest.raises(ValueError):
        rules.require_keys(D, ["a", "c"])
