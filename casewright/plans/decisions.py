"""Queries that decide cases with the rule engines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import rules
from casewright.plans import facts
from casewright.plans.facts import LINES_SQL, PARTS_SQL, Duck, Spark, select_sql

# ---- SQL of the engines, written for themselves ----

RETURNABLE = "NOT is_used AND is_resellable AND product_type <> 'virtual'"

PILOT_CODE = f"""CASE WHEN days_since_delivery IS NULL OR order_status = 'unknown' THEN 'missing_required_facts'
 WHEN evidence_conflict THEN 'evidence_conflict' WHEN order_info_conflict THEN 'order_info_conflict'
 WHEN order_amount_cny >= 1000 THEN 'high_value_order' WHEN refund_count_30d >= 3 THEN 'frequent_refund_user'
 WHEN logistics_issue THEN CASE WHEN seller_fault OR has_evidence THEN 'logistics_issue_supported' ELSE 'logistics_issue_insufficient_evidence' END
 WHEN has_quality_issue THEN CASE WHEN NOT has_evidence THEN 'quality_issue_no_evidence' WHEN {RETURNABLE} THEN 'quality_issue_return_refund' ELSE 'quality_issue_refund_only' END
 WHEN product_type <> 'standard' AND user_claim IN ('no_reason', 'size_not_fit', 'exchange') THEN 'special_goods_exclusion'
 WHEN days_since_delivery > 7 THEN 'over_7_days_no_quality_issue'
 WHEN {RETURNABLE} THEN 'within_7_days_unused' ELSE 'used_or_not_resellable' END"""

WARRANTY_CODE = """CASE WHEN safety_recall THEN 'safety_recall' WHEN evidence_conflict THEN 'evidence_conflict'
 WHEN serial_status <> 'match' THEN 'serial_' || serial_status
 WHEN NOT has_purchase_proof THEN 'purchase_proof_missing' WHEN NOT failure_description_present THEN 'failure_description_missing'
 WHEN claim_amount_cny >= 3000 THEN 'abnormal_claim_amount' WHEN unauthorized_repair_caused_current_failure THEN 'unauthorized_repair_causal'
 WHEN days_since_purchase > warranty_days THEN CASE WHEN prior_repair_count >= 2 AND same_failure_recurrence THEN 'repeat_failure_after_repairs' ELSE 'warranty_expired' END
 WHEN failure_type IN ('accidental_damage', 'liquid_damage') THEN CASE WHEN extended_coverage THEN 'extended_damage_covered' ELSE 'accidental_or_liquid_not_covered' END
 WHEN failure_type = 'manufacturing_defect' THEN CASE WHEN has_diagnostic_evidence THEN 'manufacturing_defect_supported' ELSE 'diagnostic_evidence_missing' END
 WHEN failure_type = 'normal_wear' THEN 'normal_wear_excluded' ELSE 'failure_type_unclear' END"""

EXPENSE_CNY = "round(amount * CASE currency WHEN 'CNY' THEN 1.000::DECIMAL(10,3) WHEN 'USD' THEN 7.200::DECIMAL(10,3) WHEN 'EUR' THEN 7.800::DECIMAL(10,3) WHEN 'JPY' THEN 0.048::DECIMAL(10,3) WHEN 'GBP' THEN 9.100::DECIMAL(10,3) ELSE 0.920::DECIMAL(10,3) END, 2)::DECIMAL(18,2)"
EXPENSE_CODE = f"""CASE WHEN is_duplicate_claim THEN 'duplicate_claim' WHEN evidence_conflict THEN 'evidence_conflict'
 WHEN has_receipt AND NOT receipt_matches_amount THEN 'receipt_amount_mismatch' WHEN NOT has_receipt THEN 'receipt_missing'
 WHEN NOT business_purpose_present THEN 'business_purpose_missing' WHEN NOT project_code_valid THEN 'project_code_invalid'
 WHEN currency = 'CNY' AND amount_cny >= 5000 THEN 'high_value_expense' WHEN currency <> 'CNY' AND amount_cny >= 2000 THEN 'high_value_foreign_currency'
 WHEN (is_personal_expense OR days_since_expense > 30) AND NOT policy_exception_documented THEN CASE WHEN is_personal_expense THEN 'personal_expense' ELSE 'late_submission' END
 WHEN is_personal_expense OR days_since_expense > 30 THEN CASE WHEN manager_approved THEN 'documented_policy_exception' ELSE 'exception_manager_approval_missing' END
 WHEN amount_cny > CASE expense_category WHEN 'hotel' THEN 1200 * hotel_nights WHEN 'meal' THEN 300 WHEN 'local_transport' THEN 500 WHEN 'office_supply' THEN 1000 ELSE 3000 END
   THEN CASE WHEN manager_approved THEN 'cap_override_approved' ELSE 'category_cap_exceeded' END
 ELSE 'standard_compliant' END"""

#: Decision of each reason code, by engine (fixed values).
DECISION_OF = {
    "refund": {
        "approve": ["logistics_issue_supported", "quality_issue_refund_only"],
        "approve_with_conditions": ["quality_issue_return_refund", "within_7_days_unused"],
        "request_more_evidence": ["missing_required_facts", "logistics_issue_insufficient_evidence", "quality_issue_no_evidence"],
        "manual_review": ["evidence_conflict", "order_info_conflict", "high_value_order", "frequent_refund_user"],
    },
    "warranty": {
        "approve": ["manufacturing_defect_supported"],
        "approve_with_conditions": ["safety_recall", "extended_damage_covered"],
        "request_more_evidence": ["serial_missing", "purchase_proof_missing", "failure_description_missing", "diagnostic_evidence_missing", "failure_type_unclear"],
        "manual_review": ["evidence_conflict", "serial_mismatch", "abnormal_claim_amount", "repeat_failure_after_repairs"],
    },
    "expense": {
        "approve": ["standard_compliant"],
        "approve_with_conditions": ["documented_policy_exception", "cap_override_approved"],
        "request_more_evidence": ["receipt_missing", "business_purpose_missing", "project_code_invalid", "exception_manager_approval_missing"],
        "manual_review": ["duplicate_claim", "evidence_conflict", "receipt_amount_mismatch", "high_value_expense", "high_value_foreign_currency"],
    },
}


def outcome_sql(engine: str) -> str:
    """decision, risk_level and need_human of a reason code, in SQL."""
    decision = "CASE " + " ".join(f"WHEN code IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in DECISION_OF[engine].items()) + " ELSE 'reject' END"
    risk = f"CASE WHEN code = 'safety_recall' OR {decision} = 'manual_review' THEN 'high' WHEN {decision} IN ('approve', 'reject') THEN 'low' ELSE 'medium' END"
    return f"{decision} AS decision, {risk} AS risk_level, (code = 'safety_recall' OR {decision} = 'manual_review') AS need_human"


def refund_sql(source: str) -> str:
    """The first refund engine over a facts relation."""
    return f"""
SELECT *, CASE WHEN missing THEN 'request_more_evidence' WHEN len(risks) > 0 THEN 'manual_review' ELSE base END AS decision,
 CASE WHEN missing THEN 'medium' WHEN len(risks) = 0 THEN CASE base WHEN 'request_more_evidence' THEN 'medium' ELSE 'low' END
  WHEN list_contains(risks, 'evidence_conflict') OR list_contains(risks, 'order_info_conflict') OR len(risks) > 1 THEN 'high' ELSE 'medium' END AS risk_level,
 NOT missing AND len(risks) > 0 AS need_human,
 CASE WHEN missing THEN ['manual_review_required'] WHEN len(risks) > 0 THEN list_concat([code], risks, ['manual_review_required']) ELSE [code] END AS reason_codes
FROM (SELECT *,
 CASE WHEN logistics_issue THEN CASE WHEN seller_fault OR has_evidence THEN 'allow_refund' ELSE 'request_more_evidence' END
  WHEN has_quality_issue THEN CASE WHEN NOT has_evidence THEN 'request_more_evidence' WHEN is_virtual OR is_used OR NOT is_resellable THEN 'allow_refund' ELSE 'allow_return_refund' END
  WHEN is_virtual OR is_fresh OR is_customized OR days_since_delivery > 7 OR is_used OR NOT is_resellable THEN 'deny'
  WHEN intent = 'exchange_request' THEN 'allow_exchange' ELSE 'allow_return_refund' END AS base,
 CASE WHEN logistics_issue THEN 'logistics_issue' WHEN has_quality_issue THEN CASE WHEN has_evidence THEN 'quality_issue_with_evidence' ELSE 'quality_issue_no_evidence' END
  WHEN is_virtual THEN 'virtual_goods_denied' WHEN is_fresh THEN 'fresh_goods_no_reason_denied' WHEN is_customized THEN 'customized_goods_no_reason_denied'
  WHEN days_since_delivery > 7 THEN 'over_7_days_no_quality_issue' WHEN is_used OR NOT is_resellable THEN 'used_or_not_resellable' ELSE 'within_7_days_unused' END AS code,
 list_filter([CASE WHEN evidence_conflict THEN 'evidence_conflict' END,
  CASE WHEN order_info_conflict OR (user_claim = 'claims_unused_but_used' AND is_used) THEN 'order_info_conflict' END,
  CASE WHEN order_amount >= 1000 THEN 'high_value_order' END, CASE WHEN refund_count_30d >= 3 THEN 'frequent_refund_user' END], lambda x: x IS NOT NULL) AS risks,
 days_since_delivery IS NULL OR order_status NOT IN ('delivered', 'not_delivered', 'closed') AS missing
FROM (SELECT *, CASE WHEN user_claim = 'exchange' THEN 'exchange_request' WHEN user_claim IN ('complaint', 'strong_complaint') THEN 'complaint'
 WHEN user_claim IN ('size_not_fit', 'no_reason') THEN 'return_refund_request' ELSE 'refund_request' END AS intent FROM ({source})))"""


# ---- queries ----

COUNTED = ["decision", "risk_level", "need_human", "code"]


def refund_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.order_lines(spark, sf_dir).selectExpr("l_orderkey", "l_linenumber", *facts.refund_lines(Spark))


def refund_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.decide_refund(rules.normalised(refund_facts(spark, sf_dir)))
    return found.select("l_orderkey", "l_linenumber", "intent", "decision", "risk_level", "need_human", F.array_join("reason_codes", "|").alias("reason_codes"))


def decision_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decide_refund(refund_facts(spark, sf_dir)).groupBy("decision", "risk_level").agg(F.count("*").alias("n"))


def refund_pilot_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.order_lines(spark, sf_dir).selectExpr("l_orderkey", "l_linenumber", *facts.pilot_lines(Spark))
    return rules.decide(rows, "refund").select("l_orderkey", "l_linenumber", *COUNTED)


def warranty_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.part_lines(spark, sf_dir).selectExpr("l_orderkey", "l_linenumber", *facts.warranty_lines(Spark))
    return rules.decide(rows, "warranty").select("l_orderkey", "l_linenumber", *COUNTED)


def expense_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.read(spark, sf_dir, "orders").selectExpr(*facts.expense_orders(Spark))
    return rules.decide(rows, "expense").select("claim_id", "amount_cny", *COUNTED)


def _wide_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of all engines in one table; columns of other engines are null."""
    refund = facts.order_lines(spark, sf_dir).selectExpr("'refund' skill_id", *facts.pilot_lines(Spark))
    warranty = facts.part_lines(spark, sf_dir).selectExpr("'warranty' skill_id", *facts.warranty_lines(Spark))
    expense = rules.with_expense_amounts(facts.read(spark, sf_dir, "orders").selectExpr("'expense' skill_id", *facts.expense_orders(Spark)).drop("claim_id"))
    return refund.unionByName(warranty, allowMissingColumns=True).unionByName(expense, allowMissingColumns=True)


def engine_dispatch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decide_by_key(_wide_cases(spark, sf_dir)).groupBy("skill_id", "decision", "code").agg(F.count("*").alias("n"))


def _loose(d) -> list[str]:
    """Pilot refund facts that break their domain now and then."""
    return [
        "o_orderkey",
        f"{d.pick(['standard', 'fresh', 'customized', 'virtual', 'bundle'], 'o_orderkey % 5')} AS product_type",
        "cast(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey % 21 - 1 END AS int) AS days_since_delivery",
        "o_custkey % 2 = 0 AS is_resellable",
        f"{d.pick(['delivered', 'not_delivered', 'closed', 'unknown', 'lost'], 'o_custkey % 5')} AS order_status",
        "o_custkey % 3 = 0 AS seller_fault",
        "o_orderkey % 4 = 0 AS logistics_issue",
    ]


def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.violations(facts.read(spark, sf_dir, "orders").selectExpr(*_loose(Spark)), "refund")
    return rows.where(F.size("violations") > 0).select("o_orderkey", F.array_join("violations", "|").alias("violations"))


MUTATIONS = {
    "quality_evidence_added": {"has_quality_issue": True, "has_evidence": True},
    "amount_raised": {"order_amount": 2499},
    "used_item": {"is_used": True, "is_resellable": False},
}


def fact_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample under each mutation: overridden facts, decided anew, counted with the old decision."""
    rows = facts.read(spark, sf_dir, "orders").selectExpr(*facts.refund_orders(Spark))
    before = rules.decide_refund(rows).select("*", F.col("decision").alias("before")).drop("intent", "decision", "risk_level", "need_human", "reason_codes")
    names = sorted({c for m in MUTATIONS.values() for c in m})
    dim = spark.createDataFrame([(k, *(m.get(c) if c == "order_amount" else m.get(c) for c in names)) for k, m in MUTATIONS.items()], "mutation_type string, " + ", ".join(f"_{c} {'int' if c == 'order_amount' else 'boolean'}" for c in names))
    mutated = before.crossJoin(F.broadcast(dim)).withColumns({c: F.coalesce(f"_{c}", c) for c in names})
    return rules.decide_refund(mutated.drop(*(f"_{c}" for c in names))).groupBy("mutation_type", "before", "decision").agg(F.count("*").alias("n"))


def oracle_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results with every 50th reason code spoiled: the rows that the engine contradicts."""
    rows = facts.read(spark, sf_dir, "orders").selectExpr(*facts.expense_orders(Spark))
    stored = rules.decide(rows, "expense").withColumn("code", F.expr("if(claim_id % 50 = 0, 'spoiled', code)"))
    return rules.recheck(stored.drop("amount_cny", "cap_cny"), "expense").select("claim_id", "code", "stored_code")


QUERIES = {f.__name__: f for f in (refund_decide, decision_distribution, refund_pilot_decide, warranty_decide, expense_decide, engine_dispatch_union, domain_violations, fact_mutation, oracle_recheck)}

_lines = "SELECT l_orderkey, l_linenumber, {} FROM {}"
_refund_lines = _lines.format(", ".join(facts.refund_lines(Duck)), LINES_SQL)
_pilot = f"SELECT *, {PILOT_CODE} AS code FROM ({_lines.format(', '.join(facts.pilot_lines(Duck)), LINES_SQL)})"
_warranty = f"SELECT *, {WARRANTY_CODE} AS code FROM ({_lines.format(', '.join(facts.warranty_lines(Duck)), PARTS_SQL)})"
_expense = f"SELECT *, {EXPENSE_CODE} AS code FROM (SELECT *, {EXPENSE_CNY} AS amount_cny FROM ({select_sql(facts.expense_orders, 'orders')}))"
_samples = select_sql(facts.refund_orders, "orders")


def _mutation_sql() -> str:
    parts = []
    for name, change in MUTATIONS.items():
        swapped = ", ".join(f"{str(v).lower() if isinstance(v, bool) else v} AS {c}" for c, v in change.items())
        parts.append(f"SELECT '{name}' AS mutation_type, b.decision AS before, a.decision AS decision FROM ({refund_sql(_samples)}) b JOIN ({refund_sql(f'SELECT * REPLACE ({swapped}) FROM ({_samples})')}) a USING (sample_id)")
    return f"SELECT mutation_type, before, decision, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


ORACLES = {
    "refund_decide": f"SELECT l_orderkey, l_linenumber, intent, decision, risk_level, need_human, array_to_string(reason_codes, '|') AS reason_codes FROM ({refund_sql(_refund_lines)})",
    "decision_distribution": f"SELECT decision, risk_level, count(*) AS n FROM ({refund_sql(_refund_lines)}) GROUP BY ALL",
    "refund_pilot_decide": f"SELECT l_orderkey, l_linenumber, code, {outcome_sql('refund')} FROM ({_pilot})",
    "warranty_decide": f"SELECT l_orderkey, l_linenumber, code, {outcome_sql('warranty')} FROM ({_warranty})",
    "expense_decide": f"SELECT claim_id, amount_cny, code, {outcome_sql('expense')} FROM ({_expense})",
    "engine_dispatch_union": f"""SELECT skill_id, decision, code, count(*) AS n FROM (
 SELECT 'refund' AS skill_id, code, {outcome_sql('refund')} FROM ({_pilot})
 UNION ALL SELECT 'warranty', code, {outcome_sql('warranty')} FROM ({_warranty})
 UNION ALL SELECT 'expense', code, {outcome_sql('expense')} FROM ({_expense})) GROUP BY ALL""",
    "domain_violations": f"""SELECT o_orderkey, array_to_string(v, '|') AS violations FROM (SELECT o_orderkey, list_filter([
 CASE WHEN product_type = 'bundle' THEN 'product_type' END, CASE WHEN order_status = 'lost' THEN 'order_status' END,
 CASE WHEN days_since_delivery < 0 THEN 'days_negative' END, CASE WHEN product_type = 'virtual' AND is_resellable THEN 'virtual_resellable' END,
 CASE WHEN order_status = 'unknown' AND days_since_delivery IS NOT NULL THEN 'unknown_with_days' END,
 CASE WHEN order_status IN ('delivered', 'closed') AND days_since_delivery IS NULL THEN 'known_without_days' END,
 CASE WHEN order_status = 'not_delivered' AND (days_since_delivery IS NULL OR days_since_delivery <> 0 OR NOT logistics_issue) THEN 'not_delivered_facts' END,
 CASE WHEN seller_fault AND NOT logistics_issue THEN 'seller_fault_without_logistics' END], lambda x: x IS NOT NULL) AS v
 FROM ({select_sql(_loose, 'orders')})) WHERE len(v) > 0""",
    "fact_mutation": _mutation_sql(),
    "oracle_recheck": f"SELECT claim_id, code, 'spoiled' AS stored_code FROM ({_expense}) WHERE claim_id % 50 = 0",
}
