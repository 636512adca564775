"""The engineering gates over a panel of customers with planted faults, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import gates
from casewright.operators.panel import CONDITIONS, RANDOM, STAGED
from casewright.plans.facts import Duck, Spark, read

SKILLS = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
ENDPOINTS = [RANDOM, STAGED]
_CELLS = [(c, e, i) for i, (c, e) in enumerate((c, e) for c in CONDITIONS for e in ENDPOINTS)]
#: By the row's number modulo 400: which stored value is wrong.
LIES = {1: "parse", 2: "output", 3: "errors", 4: "valid", 5: "exact", 6: "decision", 7: "key", 8: "sealed", 9: "condition", 10: "double", 11: "lost", 12: "family", 13: "gold"}


def _number(d) -> str:
    case = '"case"' if d is Duck else "case"
    return d.number(f"concat('gate|', cast({case} AS varchar(20)), '|', condition, '|', endpoint)")


def gate_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer and cell: a right answer, a wrong one (every fifth), one against the contract (every
    seventh) or one in single quotes (every eleventh), with its flags as stored; LIES of them are not as they should be."""
    dim = F.broadcast(spark.createDataFrame(_CELLS, "condition string, endpoint string, cell int"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("skill"), F.col("c_custkey").alias("case"), F.col("c_nationkey").alias("nation")).crossJoin(dim)
    rows = rows.withColumn("number", F.expr(_number(Spark))).withColumn("lie", F.col("number") % 400).where(f"lie <> {11}")
    form = F.when(F.col("number") % 11 == 0, "quotes").when(F.col("number") % 7 == 0, "contract").when(F.col("number") % 5 == 0, "wrong").otherwise("right")
    rows = rows.withColumn("form", form)
    answer = lambda decision: F.concat(F.lit('{"decision":"'), decision, F.lit('","explanation":"as agreed","intent":"complaint","need_human":false,"reason_codes":["logistics_issue"],"risk_level":"low"}'))
    right = answer(F.lit("deny"))
    text = F.when(F.col("form") == "quotes", F.translate(right, '"', "'")).when(F.col("form") == "contract", answer(F.lit("maybe"))).when(F.col("form") == "wrong", answer(F.lit("allow_refund"))).otherwise(right)
    lie = lambda k: F.col("lie") == k
    parsed, valid, exact = F.col("form") != "quotes", F.col("form").isin("right", "wrong"), F.col("form") == "right"
    flip = lambda c, k: F.when(lie(k), ~c).otherwise(c)
    key = F.concat_ws("|", "skill", F.col("case").cast("string"), "condition", "endpoint")
    gold = F.struct(F.lit("deny").alias("decision"), F.when(lie(13), "high").otherwise("low").alias("risk_level"), F.lit(False).alias("need_human"))
    out = rows.select(
        "skill", "case", F.when(lie(12), "other").otherwise(F.concat(F.lit("family"), F.col("nation") % 4)).alias("family"), "condition", "endpoint", (F.col("case") * 16 + F.col("cell") + 1).alias("position"),
        F.when(lie(7), F.concat(key, F.lit("?"))).when(lie(8), F.concat(key, F.lit("|Confirmation"))).otherwise(key).alias("pairing_key"), text.alias("completion"), gold.alias("gold"),
        flip(~parsed, 1).alias("parse_failed"), F.when(parsed & ~lie(2), text).alias("parsed_output"), F.when((F.col("form") == "contract") & ~lie(3), F.array(F.lit("invalid_decision"))).otherwise(F.array().cast("array<string>")).alias("schema_errors"),
        flip(valid, 4).alias("schema_valid"), flip(exact & ~lie(13), 5).alias("exact_correct"), flip(exact, 6).alias("decision_correct"), (valid & ~lie(13)).alias("risk_level_correct"), valid.alias("need_human_correct"), "lie",
    )
    renamed = out.withColumn("condition", F.when(F.col("lie") == 9, "unheard_of").otherwise(F.col("condition")))
    return renamed.union(renamed.where("lie = 10")).drop("lie")


def gate_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of the run: its counts as customers tell them, regions as runs, one document that cannot be read."""
    n = read(spark, sf_dir, "customer").agg((F.count("*") * 16).alias("n"))
    done = n.select(F.lit("completion").alias("manifest"), F.to_json(F.struct(F.lit("pass").alias("status"), F.col("n").alias("expected_records"), F.lit(False).alias("sealed_used"), F.lit("0" * 64).alias("ordered_sha256"))).alias("document"))
    run = F.struct(F.col("r_name").alias("arm"), F.when(F.col("r_regionkey") == 3, 224).otherwise(225).alias("steps"), F.when(F.col("r_regionkey") == 1, "b").otherwise("a").alias("initial"))
    formal = read(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(run)).alias("runs")).select(F.lit("formal").alias("manifest"), F.to_json(F.struct(F.lit("pass").alias("status"), F.size("runs").alias("run_count"), "runs")).alias("document"))
    return done.union(formal).union(spark.createDataFrame([("recovery", '{"status":"pass","status":"fail"}')], "manifest string, document string"))


def engineering_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of the panel and its manifests."""
    wanted = gates.constraints(
        spark, {"completion": {"status": "pass", "sealed_used": False, "exit_code": 0}, "formal": {"status": "pass", "run_count": 6}},
        [("completion", "expected_records", "panel", "rows"), ("completion", "expected_records", "panel", "unique_keys"), ("completion", "ordered_sha256", "panel", "ordered_sha256")],
        {"formal.runs": {"steps": 225}},
    )
    panel = gate_panel(spark, sf_dir)
    return gates.engineering_gates(panel, gate_manifests(spark, sf_dir), wanted, SKILLS, CONDITIONS, ENDPOINTS, [("formal", "runs")], [("formal.runs", "initial")], ["completion", "recovery", "behaviour", "formal"])


QUERIES = {"engineering_gates": engineering_gates}

_cells = ", ".join(f"('{c}', '{e}', {i})" for c, e, i in _CELLS)
ORACLES = {
    "engineering_gates": f"""WITH raw AS (SELECT *, CASE WHEN number % 11 = 0 THEN 'quotes' WHEN number % 7 = 0 THEN 'contract' WHEN number % 5 = 0 THEN 'wrong' ELSE 'right' END AS form, number % 400 AS lie, skill || '|' || "case" AS ck,
  skill || '|' || "case" || '|' || CASE WHEN number % 400 = 9 THEN 'unheard_of' ELSE condition END || '|' || endpoint AS key, skill || '|' || "case" || '|' || condition || '|' || endpoint AS own
  FROM (SELECT *, {_number(Duck)} AS number FROM (SELECT c_mktsegment AS skill, c_custkey AS "case", c_nationkey AS nation FROM customer) CROSS JOIN (VALUES {_cells}) v(condition, endpoint, cell))),
 p AS (SELECT * FROM raw WHERE lie <> 11 UNION ALL SELECT * FROM raw WHERE lie = 10),
 k AS (SELECT count(*) AS rows, count(DISTINCT CASE WHEN lie <> 9 THEN own END) AS uniq FROM p),
 h AS (SELECT sha256(string_agg(h, '' ORDER BY b)) AS h FROM (SELECT (pos - 1) // 50000 AS b, sha256(to_json(list(pk ORDER BY pos, pk))::VARCHAR) AS h
  FROM (SELECT "case" * 16 + cell + 1 AS pos, CASE lie WHEN 7 THEN own || '?' WHEN 8 THEN own || '|Confirmation' ELSE own END AS pk FROM p) GROUP BY b)),
 n AS (SELECT count(*) * 16 AS n FROM customer)
SELECT gate, key AS subject, '' AS detail FROM (SELECT key, unnest(list_filter([CASE WHEN skill NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'unexpected_skill' END, CASE WHEN lie = 9 THEN 'unexpected_condition' END,
  CASE WHEN lie IN (7, 8, 9) THEN 'pairing_key' END, CASE WHEN lie = 8 THEN 'sealed_marker' END, CASE WHEN lie = 1 THEN 'parse_flag' END, CASE WHEN lie = 2 AND form <> 'quotes' THEN 'parsed_output' END,
  CASE WHEN lie = 3 AND form = 'contract' THEN 'schema_errors' END, CASE WHEN lie = 4 THEN 'schema_flag' END, CASE WHEN lie = 5 THEN 'exact_flag' END, CASE WHEN lie = 6 THEN 'decision_flag' END], lambda x: x IS NOT NULL)) AS gate FROM p)
UNION ALL SELECT 'duplicate_key', key, '2' FROM p WHERE lie = 10 GROUP BY key
UNION ALL SELECT 'incomplete_case', ck, count(*) FILTER (WHERE lie IN (9, 11)) || ' missing, ' || count(*) FILTER (WHERE lie = 9) || ' unknown' FROM raw GROUP BY ck HAVING count(*) FILTER (WHERE lie IN (9, 11)) > 0
UNION ALL SELECT 'target_or_family', ck, '' FROM p GROUP BY ck HAVING count(DISTINCT lie = 12) > 1 OR count(DISTINCT lie = 13) > 1
UNION ALL SELECT 'manifest', 'recovery', 'no JSON object' UNION ALL SELECT 'manifest', 'behaviour', 'missing' UNION ALL SELECT 'shared_value', 'formal.runs.initial', '2 values'
UNION ALL SELECT 'constraint', 'completion.exit_code', 'nothing is not 0' UNION ALL SELECT 'constraint', 'formal.run_count', '5 is not 6' UNION ALL SELECT 'constraint', 'formal.runs[' || r_rank || '].steps', '224 is not 225' FROM (SELECT r_regionkey, row_number() OVER (ORDER BY r_name) - 1 AS r_rank FROM region) WHERE r_regionkey = 3
UNION ALL SELECT 'constraint', 'completion.expected_records', n || ' is not ' || rows FROM n, k WHERE n <> rows UNION ALL SELECT 'constraint', 'completion.expected_records', n || ' is not ' || uniq FROM n, k WHERE n <> uniq
UNION ALL SELECT 'constraint', 'completion.ordered_sha256', '"{'0' * 64}" is not "' || h || '"' FROM h""",
}
