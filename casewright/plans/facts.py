"""Fact tables for the rule engines, derived from the star schema, in two SQL dialects.

The select lists below are plain SQL; the few functions that differ are filled in by dialect, so
queries and their oracles read the same facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Spark:
    @staticmethod
    def days(a: str, b: str) -> str:
        return f"datediff({a}, {b})"

    @staticmethod
    def number(x: str, digits: int = 8) -> str:
        return f"cast(conv(substr(sha2({x}, 256), 1, {digits}), 16, 10) as bigint)"

    @staticmethod
    def floor(x: str) -> str:
        return f"cast(floor({x}) as bigint)"

    @staticmethod
    def pick(values: list[str], index: str) -> str:
        return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} as int) + 1)"

    div = "div"


class Duck(Spark):
    @staticmethod
    def days(a: str, b: str) -> str:
        return f"datediff('day', {b}::DATE, {a}::DATE)"

    @staticmethod
    def number(x: str, digits: int = 8) -> str:
        return f"('0x' || substr(sha256({x}), 1, {digits}))::BIGINT"

    @staticmethod
    def pick(values: list[str], index: str) -> str:
        return f"([{', '.join(repr(v) for v in values)}])[({index})::INT + 1]"

    div = "//"


PRODUCTS = ["clothing", "electronics", "home", "fresh", "customized", "virtual"]
CLAIMS = ["no_reason", "size_not_fit", "quality_issue", "exchange", "logistics_issue", "strong_complaint", "claims_unused_but_used"]
EXPOSURES = ["full", "partial", "minimal", "no_skill"]


def refund_lines(d) -> list[str]:
    """First refund engine's facts from lineitem joined with orders."""
    return [
        f"{d.pick(PRODUCTS, 'l_partkey % 6')} AS product_type",
        f"cast(CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE abs({d.days('l_shipdate', 'o_orderdate')}) % 19 END AS int) AS days_since_delivery",
        "l_returnflag = 'R' AS is_used",
        "l_suppkey % 7 <> 0 AND l_returnflag <> 'R' AS is_resellable",
        "l_linestatus = 'F' AND l_orderkey % 3 = 0 AS has_quality_issue",
        "l_linenumber % 2 = 0 AS has_evidence",
        f"cast({d.floor('l_extendedprice / 80')} AS int) AS order_amount",
        f"cast({d.floor('(l_suppkey % 20) / 5')} AS int) AS refund_count_30d",
        f"{d.pick(CLAIMS, 'l_orderkey % 7')} AS user_claim",
        "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'not_delivered' ELSE 'closed' END AS order_status",
        "l_partkey % 6 = 4 AS is_customized",
        "l_partkey % 6 = 5 AS is_virtual",
        "l_partkey % 6 = 3 AS is_fresh",
        "l_partkey % 5 = 0 AS seller_fault",
        "l_orderkey % 7 = 4 AS logistics_issue",
        "l_orderkey % 31 = 0 AS evidence_conflict",
        "l_partkey % 41 = 0 AS order_info_conflict",
    ]


def refund_orders(d) -> list[str]:
    """First refund engine's facts, one sample an order."""
    return [
        "o_orderkey AS sample_id",
        f"{d.pick(PRODUCTS, 'o_orderkey % 6')} AS product_type",
        "cast(CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey % 19 END AS int) AS days_since_delivery",
        "o_custkey % 3 = 0 AS is_used",
        "o_orderkey % 7 <> 0 AND o_custkey % 3 <> 0 AS is_resellable",
        "o_orderkey % 5 = 0 AS has_quality_issue",
        "o_custkey % 2 = 0 AS has_evidence",
        "cast((o_custkey * 37) % 1300 AS int) AS order_amount",
        f"cast({d.floor('(o_custkey % 20) / 5')} AS int) AS refund_count_30d",
        f"{d.pick(CLAIMS, f'(o_orderkey {d.div} 3) % 7')} AS user_claim",
        "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'not_delivered' ELSE 'closed' END AS order_status",
        "o_orderkey % 6 = 4 AS is_customized",
        "o_orderkey % 6 = 5 AS is_virtual",
        "o_orderkey % 6 = 3 AS is_fresh",
        "o_custkey % 5 = 0 AS seller_fault",
        f"(o_orderkey {d.div} 3) % 7 = 4 AS logistics_issue",
        "o_orderkey % 31 = 0 AS evidence_conflict",
        "o_custkey % 41 = 0 AS order_info_conflict",
    ]


def pilot_lines(d) -> list[str]:
    """Pilot refund facts within their domain."""
    kind = d.pick(["standard", "fresh", "customized", "virtual"], "l_partkey % 4")
    status = "CASE WHEN l_partkey % 53 = 0 THEN 'unknown' WHEN l_orderkey % 7 = 4 AND o_orderstatus = 'O' THEN 'not_delivered' WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'closed' END"
    return [
        f"{kind} AS product_type",
        f"cast(CASE {status} WHEN 'unknown' THEN NULL WHEN 'not_delivered' THEN 0 ELSE abs({d.days('l_shipdate', 'o_orderdate')}) % 19 END AS int) AS days_since_delivery",
        "l_returnflag = 'R' AS is_used",
        "l_partkey % 4 <> 3 AND l_suppkey % 5 <> 0 AS is_resellable",
        "l_orderkey % 3 = 0 AS has_quality_issue",
        "l_linenumber % 2 = 0 AS has_evidence",
        f"cast({d.floor('l_extendedprice / 60')} AS decimal(18,2)) AS order_amount_cny",
        "cast(l_suppkey % 4 AS int) AS refund_count_30d",
        f"{d.pick(CLAIMS[:6], 'l_partkey % 6')} AS user_claim",
        f"{status} AS order_status",
        "l_orderkey % 7 = 4 AND l_partkey % 2 = 0 AS seller_fault",
        "l_orderkey % 7 = 4 AS logistics_issue",
        "l_orderkey % 31 = 0 AS evidence_conflict",
        "l_partkey % 41 = 0 AS order_info_conflict",
    ]


FAILURES = ["manufacturing_defect", "accidental_damage", "liquid_damage", "normal_wear", "unknown"]


def warranty_lines(d) -> list[str]:
    """Warranty facts from part joined with lineitem."""
    return [
        f"{d.pick(['electronics', 'appliance', 'tool', 'other'], 'p_size % 4')} AS product_category",
        "cast((l_orderkey * 7) % 900 AS int) AS days_since_purchase",
        "cast(365 * (1 + p_partkey % 2) AS int) AS warranty_days",
        f"{d.pick(FAILURES, 'l_suppkey % 5')} AS failure_type",
        "l_orderkey % 11 <> 0 AS failure_description_present",
        "l_orderkey % 13 <> 0 AS has_purchase_proof",
        "l_linenumber % 2 = 0 AS has_diagnostic_evidence",
        "l_partkey % 9 = 0 AS unauthorized_repair",
        "l_partkey % 18 = 0 AS unauthorized_repair_caused_current_failure",
        "l_suppkey % 2 = 0 AS extended_coverage",
        "cast(l_orderkey % 4 AS int) AS prior_repair_count",
        "l_orderkey % 4 >= 1 AND l_linestatus = 'F' AS same_failure_recurrence",
        "CASE WHEN l_partkey % 23 = 0 THEN 'mismatch' WHEN l_partkey % 29 = 0 THEN 'missing' ELSE 'match' END AS serial_status",
        "l_partkey % 47 = 0 AS safety_recall",
        f"cast({d.floor('l_extendedprice / 20')} AS decimal(18,2)) AS claim_amount_cny",
        "l_orderkey % 37 = 0 AS evidence_conflict",
    ]


CATEGORIES = ["meal", "local_transport", "office_supply", "training", "hotel"]
CURRENCIES = ["CNY", "USD", "EUR", "JPY", "GBP", "HKD"]


def expense_orders(d) -> list[str]:
    """Expense facts, one claim an order."""
    return [
        "o_orderkey AS claim_id",
        f"{d.pick(CATEGORIES, 'o_orderkey % 5')} AS expense_category",
        f"cast(cast({d.floor('o_totalprice')} % 4000 AS decimal(18,2)) + cast(o_custkey % 100 AS decimal(18,2)) * cast(0.01 AS decimal(3,2)) + cast(0.37 AS decimal(3,2)) AS decimal(18,2)) AS amount",
        f"{d.pick(CURRENCIES, 'o_custkey % 6')} AS currency",
        "cast(CASE WHEN o_orderkey % 5 = 4 THEN 1 + o_custkey % 4 ELSE 0 END AS int) AS hotel_nights",
        "cast(o_custkey % 40 AS int) AS days_since_expense",
        "o_orderkey % 11 <> 0 AS has_receipt",
        "o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0 AS receipt_matches_amount",
        "o_custkey % 19 <> 0 AS business_purpose_present",
        "o_custkey % 2 = 0 AS manager_approved",
        "o_custkey % 23 <> 0 AS project_code_valid",
        "o_orderkey % 29 = 0 AS is_duplicate_claim",
        "o_orderkey % 13 = 0 AS is_personal_expense",
        "o_orderkey % 7 = 0 AS is_weekend_or_holiday",
        "o_custkey % 6 <> 0 AS international_trip",
        "o_custkey % 3 = 0 AS policy_exception_documented",
        "o_orderkey % 31 = 0 AS evidence_conflict",
    ]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey)


LINES_SQL = "lineitem JOIN orders ON l_orderkey = o_orderkey"
PARTS_SQL = "lineitem JOIN part ON l_partkey = p_partkey"


def select_sql(columns, source: str) -> str:
    return f"SELECT {', '.join(columns(Duck))} FROM {source}"
