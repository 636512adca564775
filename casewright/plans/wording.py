"""Queries of request texts, explanations and factorial requests, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import builders, context, registries, requests, rules
from casewright.plans import facts
from casewright.plans.decisions import refund_sql
from casewright.plans.facts import Spark, read, select_sql


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's customer writes, and what is said of the evidence."""
    rows = read(spark, sf_dir, "orders").selectExpr(*facts.refund_orders(Spark))
    return rows.select("sample_id", requests.request(requests.drawn("5", F.col("sample_id"))).alias("request"), requests.evidence().alias("evidence"))


def refund_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.explain_refund(read(spark, sf_dir, "orders").selectExpr(*facts.refund_orders(Spark)))
    return found.select("sample_id", "decision", "explanation")


def factorial_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine conditions over the customers as cases, at both endpoints."""
    cases = read(spark, sf_dir, "customer").select(
        F.lower("c_mktsegment").alias("skill_id"), F.lit("discovery_eval").alias("split"), F.sha2(F.concat(F.lit("case|"), "c_custkey"), 256).alias("semantic_case_hash"), F.concat(F.lit('{"nation":'), "c_nationkey", F.lit("}")).alias("fields"))
    found = builders.factorial_requests(cases, count=None)
    return found.select("record_id", "condition", "endpoint", "placement", F.size("messages").alias("messages"), F.to_json("factor_levels").alias("levels"), "messages_sha256")


#: Skills by order status: name, rules, themes, reason codes.
SKILLS = {"F": ("filled", ["shipped goods count", "late goods do not"], ["shipping", "delay"], ["shipped", "late"]), "O": ("open", ["wait for the goods"], ["patience"], ["waiting", "cancelled"]), "P": ("partial", ["split the order", "ask the clerk", "refuse"], ["parts", "help"], ["split", "asked"])}


def registry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order under every exposure with the registered prompt of its skill, and the registered target of its reason."""
    stored = registries.registry(spark, {name: registries.Skill(*rest) for name, *rest in SKILLS.values()}, "v1")
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in SKILLS.items() for x in (k, i(v)))), F.col("o_orderstatus"))
    code = F.when(F.col("o_orderkey") % 2 == 0, pick(lambda v: v[3][0])).otherwise(pick(lambda v: v[3][1]))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", pick(lambda v: v[0]).alias("skill_id"), code.alias("reason_code"))
    rows = registries.with_entries(rows, stored, "target", "skill_id", "reason_code", "target")
    rows = rows.withColumn("exposure", F.explode(F.array(*map(F.lit, registries.EXPOSURE_IDS))))
    return registries.with_entries(rows, stored, "prompt", "skill_id", "exposure", "prompt").select("o_orderkey", "exposure", "target", F.sha2("prompt", 256).alias("prompt_sha256"))


SUBSET = ["order", "customer", "clerk", "priority", "refund", "status"]


def key_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of orders cut to a list of keys in its order; which of them there are differs by order."""
    facts_ = F.create_map(*(x for k, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("comment", "o_orderstatus"), ("customer", "o_custkey"), ("order", "o_orderkey")) for x in (F.lit(k), F.col(c).cast("string"))))
    facts_ = F.map_filter(facts_, lambda k, v: ~((k == "priority") & (F.col("o_orderstatus") == "P")))
    blank = F.transform_values(facts_, lambda k, v: F.when(~((k == "customer") & (F.col("o_orderkey") % 5 == 0)), v))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.to_json(context.key_subset(blank, SUBSET), {"ignoreNullFields": "false"}).alias("facts"))


QUERIES = {f.__name__: f for f in (request_texts, refund_explained, factorial_requests, registry_requests, key_subsets)}

_skills = ", ".join(f"('{k}', '{n}', {r!r}, {t!r}, {c!r})" for k, (n, r, t, c) in SKILLS.items())


def _template(text: str) -> str:
    """A text with its places for goods and time as SQL."""
    for name in ("g", "d"):
        text = text.replace("{" + name + "}", f"' || {name} || '")
    return f"'{text}'"


_goods = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in requests.GOODS.items())
_asks = " ".join(f"WHEN '{k}' THEN {_template(v)}" for k, v in requests.ASKS.items())
_plain = " ".join(f"WHEN {k} THEN {_template(v)}" for k, v in enumerate(requests.PLAIN))
_evidence = " ".join(f"WHEN '{k}' THEN CASE WHEN has_evidence{' OR seller_fault' if k == 'logistics_issue' else ''} THEN '{a}' ELSE '{b}' END" for k, (a, b) in requests.EVIDENCE.items())
_why = " ".join(f"WHEN '{d}|{c}' THEN '{text}'" for (d, c), text in requests.REASONS.items())
_base = """CASE reason_codes[1] WHEN 'logistics_issue' THEN CASE WHEN seller_fault OR has_evidence THEN 'allow_refund' ELSE 'request_more_evidence' END WHEN 'quality_issue_no_evidence' THEN 'request_more_evidence'
 WHEN 'quality_issue_with_evidence' THEN CASE WHEN is_virtual OR is_used OR NOT is_resellable THEN 'allow_refund' ELSE 'allow_return_refund' END
 WHEN 'within_7_days_unused' THEN CASE WHEN user_claim = 'exchange' THEN 'allow_exchange' ELSE 'allow_return_refund' END ELSE 'deny' END || '|' || reason_codes[1]"""
_conditions = ", ".join(f"('{c}', {', '.join(str(x).lower() for x in v)})" for c, v in builders.SETTINGS.items()) + f", ('{builders.PLACED}', NULL, NULL, NULL)"

ORACLES = {
    "request_texts": f"""SELECT sample_id, CASE user_claim {_asks} ELSE CASE floor(('0x' || substr(sha256('5|words|' || sample_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * {len(requests.PLAIN)})::INT {_plain} END END
 || CASE WHEN is_used AND user_claim <> 'claims_unused_but_used' THEN '{requests.USED}' ELSE '' END || CASE WHEN NOT is_resellable THEN '{requests.DAMAGED}' ELSE '' END AS request, CASE user_claim {_evidence} END AS evidence
 FROM (SELECT *, CASE product_type {_goods} END AS g, CASE WHEN days_since_delivery IN (0, 1) THEN 'brand new' ELSE coalesce(days_since_delivery::VARCHAR, 'some') || ' days old' END AS d FROM ({select_sql(facts.refund_orders, 'orders')}))""",
    "refund_explained": f"""SELECT sample_id, decision, CASE WHEN reason_codes = ['manual_review_required'] THEN 'The order does not tell ' || array_to_string(list_filter([CASE WHEN days_since_delivery IS NULL THEN 'days_since_delivery' END, CASE WHEN order_status NOT IN ('delivered', 'not_delivered', 'closed') THEN 'order_status' END], lambda x: x IS NOT NULL), ', ') || '.'
 WHEN need_human THEN why || ' A person decides because of: ' || array_to_string(reason_codes[2:len(reason_codes) - 1], ', ') || '.' ELSE why END AS explanation FROM (SELECT *, CASE {_base} {_why} END AS why FROM ({refund_sql(select_sql(facts.refund_orders, 'orders'))}))""",
    "factorial_requests": f"""SELECT sha256(key) AS record_id, condition, endpoint, CASE WHEN i IS NULL THEN 'user' ELSE 'system' END AS placement, CASE WHEN i IS NULL OR system = '' THEN 1 ELSE 2 END AS messages,
 CASE WHEN i IS NOT NULL THEN '{{"identity":' || i || ',"schema":' || s || ',"business_rules":' || b || '}}' END AS levels,
 sha256(CASE WHEN i IS NULL THEN '[{{"role":"user","content":' || to_json('You decide cases of ' || skill || chr(10) || 'Answer as JSON' || chr(10) || 'Apply the rules in order' || chr(10) || chr(10) || fields)::VARCHAR || '}}]'
  ELSE '[' || CASE WHEN system = '' THEN '' ELSE '{{"role":"system","content":' || to_json(system)::VARCHAR || '}},' END || '{{"role":"user","content":' || to_json(fields)::VARCHAR || '}}]' END) AS messages_sha256
 FROM (SELECT *, lower(c_mktsegment) AS skill, '{{"nation":' || c_nationkey || '}}' AS fields, lower(c_mktsegment) || '|' || sha256('case|' || c_custkey) || '|' || condition || '|' || endpoint AS key,
  array_to_string(list_filter([CASE WHEN i THEN 'You decide cases of ' || lower(c_mktsegment) END, CASE WHEN s THEN 'Answer as JSON' END, CASE WHEN b THEN 'Apply the rules in order' END], lambda x: x IS NOT NULL), chr(10)) AS system
  FROM customer CROSS JOIN (VALUES {_conditions}) v(condition, i, s, b) CROSS JOIN (VALUES ('random_mix_order'), ('staged_order')) e(endpoint))""",
    "registry_requests": f"""SELECT o_orderkey, exposure, 'The ' || name || ' rule ' || codes[1 + o_orderkey % 2] || ' holds.' AS target, sha256(CASE exposure
 WHEN 'full' THEN goal || ' Go through these rules and stop at the first that applies: ' || array_to_string(list_transform(rules, lambda r, k: '(' || k || ') ' || r || '.'), ' ')
 WHEN 'partial' THEN goal || ' Themes that matter, most important first: ' || t || '.' WHEN 'minimal' THEN goal WHEN 'no_skill' THEN 'Help with the request.'
 WHEN 'full_length_irrelevant' THEN array_to_string(list_transform(range(1, len(rules) + 2), lambda k: 'Note ' || k || ': keep a table''s columns in the order in which they came.'), ' ')
 WHEN 'partial_semantic_paraphrase_a' THEN 'You are given a case of ' || name || '. An earlier theme outweighs a later one (' || t || ').'
 ELSE 'What should happen in this ' || name || ' case? Think along these lines, in this order: ' || t || '.' END
 || ' Reply in JSON with the keys "decision", "risk_level", "need_human", "reason_codes", "explanation".') AS prompt_sha256
 FROM (SELECT *, 'Decide the case below as one of ' || name || '.' AS goal, array_to_string(themes, '; ') AS t FROM orders JOIN (VALUES {_skills}) v(o_orderstatus, name, rules, themes, codes) USING (o_orderstatus))
 CROSS JOIN (SELECT unnest({registries.EXPOSURE_IDS!r}) AS exposure)""",
    "key_subsets": """SELECT o_orderkey, '{"order":"' || o_orderkey || '","customer":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_custkey || '"' END
 || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"priority":"' || o_orderpriority || '"' END || ',"status":"' || o_orderstatus || '"}' AS facts FROM orders""",
}
