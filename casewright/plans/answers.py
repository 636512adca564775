"""Queries that read, score and reward model answers, and their SQL.

Answers are derived from the rule engine's own decisions: a hash of sample and exposure picks one
of twenty-five forms (right, fenced, wrapped in prose, wrong, invalid in some way, stray brackets,
single quotes, a raw line end in a string, no JSON at all).
The oracles know from the form what every score must be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import scoring, textjson
from casewright.operators import builders, context, rules
from casewright.plans import facts
from casewright.plans.decisions import refund_sql
from casewright.plans.facts import EXPOSURES, Duck, Spark, read, select_sql


def _form(d) -> str:
    number = d.number("concat('answer|', cast(sample_id AS varchar(20)), '|', prompt_exposure)")
    return f"CASE WHEN prompt_exposure = 'no_skill' AND {number} % 3 = 0 THEN 13 ELSE {number} % 25 END"


ABLATIONS = ["original", "rule_deleted_full", "schema_deleted_full", "fact_mutation"]


def _ablation(d) -> str:
    return f"CASE WHEN prompt_exposure = 'full' OR sample_id % 4 = 3 THEN {d.pick(ABLATIONS, 'sample_id % 4')} ELSE 'original' END"


def gold_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, facts..., gold, intent)."""
    found = rules.decide_refund(read(spark, sf_dir, "orders").selectExpr(*facts.refund_orders(Spark)))
    gold = F.struct("decision", "risk_level", "need_human", "reason_codes")
    return found.withColumn("gold", gold).drop("decision", "risk_level", "need_human", "reason_codes")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, prompt_exposure, position, gold, hard_tags, ablation_type, mutation_type, prediction).

    Rows are few bytes but costly to parse, so samples are dealt to all shuffle partitions before
    their answers are made; grouping and joining by sample_id later needs no further exchange.
    """
    dim = F.broadcast(spark.createDataFrame([(e, i) for i, e in enumerate(EXPOSURES)], "prompt_exposure string, position int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = gold_samples(spark, sf_dir).select("sample_id", "gold", "intent", "user_claim").repartition(parts, "sample_id").crossJoin(dim)
    rows = rows.selectExpr("*", f"{_form(Spark)} AS form", f"{_ablation(Spark)} AS ablation_type")
    text = lambda decision, human="need_human": F.to_json(F.struct(F.col("intent"), decision.alias("decision"), F.col("gold.risk_level"), F.col(f"gold.{human}"), F.col("gold.reason_codes"), F.lit("按规则处理").alias("explanation")))
    right = text(F.col("gold.decision"))
    wrong = text(F.when(F.col("gold.decision") == "deny", "allow_refund").otherwise("deny"))
    form = F.col("form")
    prediction = (
        F.when(form == 10, F.concat(F.lit("```json\n"), right, F.lit("\n```")))
        .when(form == 11, F.concat(F.lit("My answer: "), right))
        .when(form == 12, F.concat(right, F.lit(" Thanks!")))
        .when(form == 13, wrong)
        .when(form == 14, text(F.lit("maybe")))
        .when(form == 15, F.regexp_replace(right, ',"explanation":"[^"]*"', ""))
        .when(form == 16, F.regexp_replace(right, '"need_human":(true|false)', '"need_human":"$1"'))
        .when(form == 17, F.concat(F.lit('{"decision":"deny",'), F.substr(right, F.lit(2))))
        .when(form == 18, F.lit("I cannot decide."))
        .when(form == 19, F.lit("[1]"))
        .when(form == 20, F.concat(right, F.lit("] x")))
        .when(form == 21, F.concat(right, F.lit("}")))
        .when(form == 22, F.concat(right, F.lit("],["), right))
        .when(form == 23, F.translate(right, '"', "'"))
        .when(form == 24, F.regexp_replace(right, '"explanation":"', '"explanation":"\n'))
        .otherwise(right)
    )
    tags = F.array_compact(F.array(F.lit("target_case"), F.when(F.col("user_claim") == "logistics_issue", "logistics_issue")))
    kind = F.when(F.col("ablation_type") == "fact_mutation", "amount_raised").otherwise("none")
    return rows.select("sample_id", "prompt_exposure", "position", "gold", tags.alias("hard_tags"), "ablation_type", kind.alias("mutation_type"), prediction.alias("prediction"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_answers(scoring.read_answers(answers(spark, sf_dir)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def eval_by_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.metrics(scored(spark, sf_dir).where(F.col("prompt_exposure").isin(EXPOSURES)), "prompt_exposure"))


def retention_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric under full and under no skill text, their gap and ratio."""
    by = scoring.metrics(scored(spark, sf_dir), "prompt_exposure")
    names = [*scoring.METRICS, "overall_score"]
    long = by.select("prompt_exposure", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("metric", "value"))
    pick = lambda e: F.coalesce(F.max(F.when(F.col("prompt_exposure") == e, F.col("value"))), F.lit(0.0))
    out = long.groupBy("metric").agg(pick("full").alias("full"), pick("no_skill").alias("no_skill"))
    ratio = F.when(F.col("full") == 0, 0.0).otherwise(F.col("no_skill") / F.col("full"))
    return _rounded(out.select("metric", "full", "no_skill", (F.col("full") - F.col("no_skill")).alias("gap"), ratio.alias("retention")))


def ablation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = scored(spark, sf_dir).withColumn("group_key", F.concat_ws("/", F.coalesce("ablation_type", F.lit("original")), F.coalesce("prompt_exposure", F.lit("unknown")), F.coalesce("mutation_type", F.lit("none"))))
    return _rounded(scoring.metrics(keyed, "group_key"))


def dependency_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between named groups; a group that is missing counts as zero."""
    groups = ablation_groups_raw(spark, sf_dir)
    value = lambda key, metric: F.coalesce(F.max(F.when(F.col("group_key") == key, F.col(metric))), F.lit(0.0))
    whole = value("original/full/none", "overall_score")
    return _rounded(groups.agg(
        (whole - value("rule_deleted_full/full/none", "overall_score")).alias("rule_dependency_gap"),
        (value("original/full/none", "schema_valid_rate") - value("schema_deleted_full/full/none", "schema_valid_rate")).alias("schema_dependency_gap"),
        (whole - value("original/no_skill/none", "overall_score")).alias("retention_gap"),
    ))


def ablation_groups_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = scored(spark, sf_dir).withColumn("group_key", F.concat_ws("/", "ablation_type", "prompt_exposure", "mutation_type"))
    return scoring.metrics(keyed, "group_key")


def fact_mutation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right decisions among mutated records; an invalid schema does not matter here."""
    rows = scored(spark, sf_dir).where("ablation_type = 'fact_mutation' OR coalesce(mutation_type, 'none') <> 'none'")
    right = (F.col("json_valid") & F.col("got.decision").eqNullSafe(F.col("gold.decision"))).cast("double")
    return rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(right), F.lit(0.0)), 6).alias("accuracy"))


def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_ = scoring.read_answers(answers(spark, sf_dir))
    return read_.groupBy(F.array_join("errors", "|").alias("errors"), "schema_valid").agg(F.count("*").alias("n"))


def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties read as JSON, most of them with something before or after."""
    tails = {0: "concat(props, ' }')", 1: "concat('note ', props)", 2: "substr(props, 1, length(props) - 1)", 3: "concat(props, ' x')", 4: "concat(props, '] x')", 5: "concat(props, '],[', props)", 6: "concat(props, ', 1')", 7: "concat(props, '],[1')", 8: "translate(props, '\"', '\\'')", 9: "concat('[\"a\tb\",', props, ']')"}
    text = F.expr(f"CASE event_id % 13 {' '.join(f'WHEN {k} THEN {t}' for k, t in tails.items())} ELSE props END")
    rows = read(spark, sf_dir, "events").select("event_id", text.alias("text"))
    json = textjson.lenient(F.col("text"))
    return rows.select("event_id", json.isNotNull().alias("json_valid"), F.get_json_object(json, "$.k").try_cast("bigint").alias("k"))


def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).withColumn("text", F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit(textjson.THINKING), "prediction")).otherwise(F.col("prediction")))
    return rows.groupBy("prompt_exposure").agg(F.count_if(textjson.strict_object(F.col("text")).isNotNull()).alias("strict_objects"), F.count("*").alias("n"))


def code_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set F1 of gold codes against a spoiled copy: the last code dropped, or one added twice."""
    rows = gold_samples(spark, sf_dir).select("sample_id", F.col("gold.reason_codes").alias("a"))
    b = F.when(F.col("sample_id") % 3 == 0, F.expr("slice(a, 1, size(a) - 1)")).when(F.col("sample_id") % 3 == 1, F.concat("a", F.array(F.lit("extra"), F.lit("extra")))).otherwise(F.col("a"))
    return rows.select("sample_id", F.round(scoring.code_f1(F.col("a"), b), 6).alias("f1"))


def pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.consistency(scoring.read_answers(answers(spark, sf_dir)))).select("sample_id", F.col("available_pairs").cast("long"), "exposure_consistency_reward", F.col("wrong_high_similarity_pairs").cast("long"))


COMPONENTS = [*scoring.WEIGHTS, "total_reward"]


def reward_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every reward component by exposure."""
    out = scoring.rewards(scored(spark, sf_dir)).groupBy("prompt_exposure").agg(*(F.avg(c).alias(c) for c in COMPONENTS))
    return _rounded(out)


def reward_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures as models: mean total reward and rank, best first."""
    from pyspark.sql import Window

    means = scoring.rewards(scored(spark, sf_dir)).groupBy(F.col("prompt_exposure").alias("model")).agg(F.round(F.avg("total_reward"), 6).alias("total_reward"))
    return means.withColumn("place", F.rank().over(Window.orderBy(F.desc("total_reward"))))


def gold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare completions whose gold comes from a lookup by the id in the prompt; every third sample is not in it."""
    samples = gold_samples(spark, sf_dir).select(F.col("sample_id").cast("string").alias("sample_id"), F.col("sample_id").alias("n"), "gold", "user_claim")
    tags = F.array_compact(F.array(F.lit("target_case"), F.when(F.col("user_claim") == "logistics_issue", "logistics_issue")))
    lookup = samples.where("n % 3 <> 0").select("sample_id", F.lit(1).alias("position"), "gold", tags.alias("hard_tags"))
    stale = samples.where("n % 3 = 1").select("sample_id", F.lit(0).alias("position"), F.struct(F.lit("deny").alias("decision"), F.lit("low").alias("risk_level"), F.lit(False).alias("need_human"), F.array(F.lit("x")).alias("reason_codes")).alias("gold"), F.array(F.lit("old")).alias("hard_tags"))
    key = F.col("o_orderkey")
    text = F.when(key % 5 == 0, "nothing is named").when(key % 5 == 1, F.concat(F.lit('"C-ACTIVE-'), key, F.lit('"'))).otherwise(F.concat(F.lit("sample_id: "), key, F.lit("\nprompt_exposure: minimal")))
    rows = read(spark, sf_dir, "orders").select(key.alias("row_index"), text.alias("prompt"), *(F.lit(None).cast(t).alias(c) for c, t in (("sample_id", "string"), ("prompt_exposure", "string"), ("gold", scoring.CORE), ("hard_tags", "array<string>"))))
    found = scoring.with_gold(rows, lookup.unionByName(stale))
    return found.select("row_index", "sample_id", "prompt_exposure", F.col("gold.decision").alias("decision"), F.array_join("hard_tags", "|").alias("hard_tags"))


def contract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested contract document of every sample, hashed."""
    rows = read(spark, sf_dir, "orders").selectExpr(*facts.refund_orders(Spark))
    return rows.select("sample_id", F.sha2(context.contract_document(F.col("sample_id")), 256).alias("h"))


def long_context_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-context evaluation records of all samples: ids, number of tags and messages, hash of the user's text."""
    rows = gold_samples(spark, sf_dir).withColumn("position", F.col("sample_id"))
    found = context.long_context_eval(rows, 0, 7, 9)
    text = F.element_at("messages", -1)["content"]
    return found.select("sample_id", "prompt_exposure", "active_order_id", F.size("hard_tags").alias("tags"), F.size("messages").alias("messages"), F.sha2(text, 256).alias("user_sha256"))


QUERIES = {f.__name__: f for f in (gold_lookup, contract_documents, long_context_eval, eval_by_exposure, retention_curve, ablation_groups, dependency_gaps, fact_mutation_accuracy, contract_errors, json_lenient, json_strict, code_f1, pair_consistency, reward_components, reward_rank)}

# ---- SQL ----

_gold = refund_sql(select_sql(facts.refund_orders, "orders"))
_forms = f"""SELECT *, {_form(Duck)} AS form, {_ablation(Duck)} AS ablation_type FROM (SELECT * FROM ({_gold}) CROSS JOIN (VALUES ('full'), ('partial'), ('minimal'), ('no_skill')) v(prompt_exposure))"""
SCORED = f"""SELECT *, CASE WHEN ablation_type = 'fact_mutation' THEN 'amount_raised' ELSE 'none' END AS mutation_type,
 (form NOT IN (18, 21, 22, 23, 24))::INT::DOUBLE AS s_json, (form <= 13 OR form IN (17, 20))::INT::DOUBLE AS s_schema, (form <= 12 OR form IN (17, 20))::INT::DOUBLE AS s_decision FROM ({_forms})"""
_METRICS = """count(*) AS n, round(avg(s_json), 6) AS json_valid_rate, round(avg(s_schema), 6) AS schema_valid_rate, round(avg(s_decision), 6) AS decision_accuracy,
 round(avg(s_schema), 6) AS risk_level_accuracy, round(avg(s_schema), 6) AS need_human_accuracy, round(avg(s_schema), 6) AS reason_code_f1, round(avg(s_decision + 4 * s_schema) / 5, 6) AS overall_score"""
_overall = "avg(s_decision + 4 * s_schema) / 5"
_key = "ablation_type || '/' || prompt_exposure || '/' || mutation_type"
_single = "coalesce(avg({m}) FILTER (WHERE {k} = '{g}'), 0)"


def _group(metric: str, group: str) -> str:
    return f"coalesce(avg({metric}) FILTER (WHERE {_key} = '{group}'), 0)"


_o = "(s_decision + 4 * s_schema) / 5"
_retention = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, avg({m}) FILTER (WHERE prompt_exposure = 'full') AS f, avg({m}) FILTER (WHERE prompt_exposure = 'no_skill') AS z FROM ({SCORED})"
    for name, m in [("json_valid_rate", "s_json"), ("schema_valid_rate", "s_schema"), ("decision_accuracy", "s_decision"), ("risk_level_accuracy", "s_schema"), ("need_human_accuracy", "s_schema"), ("reason_code_f1", "s_schema"), ("overall_score", _o)]
)

# What an answer's fields hold, by form: its decision, whether they are there at all, and the human flag.
_parsed = f"""SELECT *, form NOT IN (18, 19, 21, 22, 23, 24) AS object,
 CASE WHEN form IN (18, 19, 21, 22, 23, 24) THEN NULL WHEN form = 13 THEN CASE decision WHEN 'deny' THEN 'allow_refund' ELSE 'deny' END WHEN form = 14 THEN 'maybe' ELSE decision END AS p_decision,
 CASE WHEN form IN (16, 18, 19, 21, 22, 23, 24) THEN NULL ELSE need_human END AS p_human FROM ({SCORED})"""
_pairs = f"""SELECT l.sample_id, w, l.s_decision = 1 AS a_ok, r.s_decision = 1 AS b_ok,
 0.45 * (l.p_decision IS NOT DISTINCT FROM r.p_decision)::INT + 0.20 * (l.p_human IS NOT DISTINCT FROM r.p_human)::INT
 + 0.15 * (l.object = r.object)::INT + 0.20 * (l.object = r.object)::INT AS sim
 FROM ({_parsed}) l JOIN (VALUES ('full', 'partial', 0.4::DOUBLE), ('partial', 'minimal', 0.3::DOUBLE), ('minimal', 'no_skill', 0.2::DOUBLE), ('full', 'no_skill', 0.1::DOUBLE)) p(a, b, w) ON l.prompt_exposure = p.a
 JOIN ({_parsed}) r ON r.sample_id = l.sample_id AND r.prompt_exposure = p.b"""
CONSISTENCY = f"""SELECT sample_id, count(*) AS available_pairs,
 sum(w * CASE WHEN a_ok AND b_ok THEN sim WHEN a_ok OR b_ok THEN 0.25 * sim WHEN sim > 0.9 THEN -0.1 ELSE 0 END) / sum(w) AS reward,
 count(*) FILTER (WHERE NOT a_ok AND NOT b_ok AND sim > 0.9) AS wrong FROM ({_pairs}) GROUP BY sample_id"""
_rewards = f"""SELECT sample_id, c.wrong, prompt_exposure, s_decision AS decision_reward, s_schema AS need_human_reward, s_schema AS risk_level_reward, s_schema AS reason_code_reward, s_schema AS schema_reward,
 c.reward AS exposure_consistency_reward,
 (s_decision = 1 AND (need_human OR user_claim = 'logistics_issue' OR list_has_any(reason_codes, {scoring.HARD_CODES!r})))::INT::DOUBLE AS hard_case_bonus,
 0.0::DOUBLE AS false_manual_review_penalty FROM ({SCORED}) s JOIN ({CONSISTENCY}) c USING (sample_id)"""
_total = "0.3 * decision_reward + 0.15 * need_human_reward + 0.1 * risk_level_reward + 0.15 * reason_code_reward + 0.05 * schema_reward + 0.15 * exposure_consistency_reward + 0.1 * hard_case_bonus - 0.1 * false_manual_review_penalty"

_facts = ", ".join(f"{c} := {c}" for c in sorted(builders.FACTS))
_document = f"""to_json(struct_pack(active_order_id := 'C-ACTIVE-' || sample_id, contract_version := '{context.CONTRACT["contract_version"]}', current_order := struct_pack({_facts}),
 evidence_summary := struct_pack(evidence_conflict := evidence_conflict, has_evidence := has_evidence, logistics_issue_claimed := logistics_issue, quality_issue_claimed := has_quality_issue, source := '{context.CONTRACT["evidence"]}'),
 output_contract := struct_pack(format := 'json_only', schema := {context.ANSWER_FIELDS!r}), routing := struct_pack(model_must_not_route_to_other_skill := true, selected_skill := 'refund_decision', skill_routing_confidence := 1.0::DOUBLE),
 task := 'refund_decision', user_risk_summary := struct_pack(refund_count_30d := refund_count_30d, risk_tags := list_filter([CASE WHEN order_amount >= 1000 THEN 'high_value_order' END,
  CASE WHEN refund_count_30d >= 3 THEN 'frequent_refund_user' END, CASE WHEN evidence_conflict THEN 'conflicting_evidence' END], lambda x: x IS NOT NULL), source := '{context.CONTRACT["user"]}')))"""

_noise = [context.NOISE[k % len(context.NOISE)] for k in range(9)]


def _drawn(name: str, n: int) -> str:
    return f"floor(('0x' || substr(sha256('7|{name}|' || sample_id || '|' || prompt_exposure), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * {n})::BIGINT"


ORACLES = {
    "gold_lookup": f"""SELECT o_orderkey AS row_index, CASE WHEN o_orderkey % 5 = 0 THEN 'row_' || o_orderkey ELSE o_orderkey::VARCHAR END AS sample_id, CASE WHEN o_orderkey % 5 > 1 THEN 'minimal' ELSE 'unknown' END AS prompt_exposure,
 g.decision, CASE WHEN g.decision IS NULL THEN '' WHEN g.user_claim = 'logistics_issue' THEN 'target_case|logistics_issue' ELSE 'target_case' END AS hard_tags
 FROM orders LEFT JOIN (SELECT sample_id AS k, decision, user_claim FROM ({_gold}) WHERE sample_id % 3 <> 0) g ON g.k = o_orderkey AND o_orderkey % 5 <> 0""",
    "contract_documents": f"SELECT sample_id, sha256({_document}) AS h FROM ({select_sql(facts.refund_orders, 'orders')})",
    "long_context_eval": f"""SELECT sample_id, prompt_exposure, 'C-ACTIVE-' || sample_id AS active_order_id, 2 AS tags, CASE WHEN prompt_exposure = 'no_skill' THEN 1 ELSE 2 END AS messages,
 sha256({_document} || chr(10) || chr(10) || array_to_string(list_transform(list_sort(list_transform({_noise!r}, lambda x: {{'h': sha256('7|' || sample_id || '|' || prompt_exposure || '|' || x), 'x': x}})), lambda s: s.x), chr(10))
  || chr(10) || chr(10) || to_json(struct_pack(member_months := {_drawn('months', 120)}, reviews_written := {_drawn('reviews', 40)}, last_delivery := ({context.CITIES!r})[{_drawn('city', len(context.CITIES))} + 1]))) AS user_sha256
 FROM ({select_sql(facts.refund_orders, 'orders')}) CROSS JOIN (VALUES ('full'), ('partial'), ('minimal'), ('no_skill')) v(prompt_exposure)""",
    "eval_by_exposure": f"SELECT prompt_exposure, {_METRICS} FROM ({SCORED}) GROUP BY prompt_exposure",
    "retention_curve": f'SELECT metric, round(f, 6) AS "full", round(z, 6) AS no_skill, round(f - z, 6) AS gap, CASE WHEN f = 0 THEN 0 ELSE round(z / f, 6) END AS retention FROM ({_retention})',
    "ablation_groups": f"SELECT {_key} AS group_key, {_METRICS} FROM ({SCORED}) GROUP BY 1",
    "dependency_gaps": f"""SELECT round({_group(_o, 'original/full/none')} - {_group(_o, 'rule_deleted_full/full/none')}, 6) AS rule_dependency_gap,
 round({_group('s_schema', 'original/full/none')} - {_group('s_schema', 'schema_deleted_full/full/none')}, 6) AS schema_dependency_gap,
 round({_group(_o, 'original/full/none')} - {_group(_o, 'original/no_skill/none')}, 6) AS retention_gap FROM ({SCORED})""",
    "fact_mutation_accuracy": f"SELECT count(*) AS n, round(avg((form <= 12 OR form IN (15, 16, 17, 20))::INT), 6) AS accuracy FROM ({SCORED}) WHERE mutation_type <> 'none'",
    "contract_errors": f"""SELECT CASE form WHEN 14 THEN 'invalid_decision' WHEN 15 THEN 'missing_fields' WHEN 16 THEN 'need_human_not_boolean' WHEN 18 THEN 'not_json' WHEN 21 THEN 'not_json' WHEN 22 THEN 'not_json' WHEN 23 THEN 'not_json' WHEN 24 THEN 'not_json' WHEN 19 THEN 'not_an_object' ELSE '' END AS errors,
 s_schema = 1 AS schema_valid, count(*) AS n FROM ({SCORED}) GROUP BY ALL""",
    "json_lenient": """SELECT event_id, event_id % 13 NOT IN (0, 2, 5, 8) AS json_valid, CASE WHEN event_id % 13 NOT IN (0, 2, 5, 8) THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events""",
    "json_strict": f"SELECT prompt_exposure, count(*) FILTER (WHERE form < 10 OR form BETWEEN 13 AND 16) AS strict_objects, count(*) AS n FROM ({SCORED}) GROUP BY 1",
    "code_f1": f"""SELECT sample_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM (
 SELECT sample_id, list_distinct(reason_codes) AS a, list_distinct(CASE sample_id % 3 WHEN 0 THEN reason_codes[1:len(reason_codes) - 1] WHEN 1 THEN list_concat(reason_codes, ['extra', 'extra']) ELSE reason_codes END) AS b FROM ({_gold}))""",
    "pair_consistency": f"SELECT sample_id, available_pairs, round(reward, 6) AS exposure_consistency_reward, wrong AS wrong_high_similarity_pairs FROM ({CONSISTENCY})",
    "reward_components": f"SELECT prompt_exposure, {', '.join(f'round(avg({c}), 6) AS {c}' for c in scoring.WEIGHTS)}, round(avg({_total}), 6) AS total_reward FROM ({_rewards}) GROUP BY 1",
    "reward_rank": f"SELECT model, total_reward, rank() OVER (ORDER BY total_reward DESC)::INT AS place FROM (SELECT prompt_exposure AS model, round(avg({_total}), 6) AS total_reward FROM ({_rewards}) GROUP BY 1)",
}
