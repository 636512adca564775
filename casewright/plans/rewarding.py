"""Queries that sum up rewards by model, look up the gold of bare completions and report validity, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import messages, scoring
from casewright.operators import panel as P
from casewright.plans import answers as A
from casewright.plans import panels
from casewright.plans.facts import read

MODELS = ["random_mix", "annealed", "full_skill"]
#: Secrets that DuckDB's patterns can state as well.
PLACED = {k: v for k, v in messages.SECRETS.items() if k != "private_path"}


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of all answers; every sample is one model's."""
    return scoring.rewards(A.scored(spark, sf_dir)).withColumn("model", F.element_at(F.array(*map(F.lit, MODELS)), (F.col("sample_id") % 3 + 1).cast("int")))


def _rounded(df: DataFrame) -> DataFrame:
    """To nine places: means of few records fall on the middle between six-place numbers."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.reward_summary(_modelled(spark, sf_dir)))


def reward_order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' order by reward, against one that is expected."""
    found = scoring.order_gate(_rounded(scoring.reward_summary(_modelled(spark, sf_dir))), MODELS)
    return found.select(F.array_join("ranking", ">").alias("ranking"), "passed")


def online_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rewards of bare completions: ids and exposure come from the prompt, gold from a lookup whose last row of a
    sample counts and which lacks every third sample."""
    rows = A.answers(spark, sf_dir)
    prompt = F.concat(F.lit("sample_id: "), F.col("sample_id").cast("string"), F.lit("\nprompt_exposure: "), F.col("prompt_exposure"))
    none = {"gold": scoring.CORE, "hard_tags": "array<string>", "sample_id": "string", "prompt_exposure": "string"}
    bare = rows.select((F.col("sample_id") * 4 + F.col("position")).alias("row_index"), prompt.alias("prompt"), "prediction", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    known = rows.where("sample_id % 3 <> 0 AND prompt_exposure = 'full'").select(F.col("sample_id").cast("string").alias("sample_id"), F.lit(1).alias("position"), "gold", "hard_tags")
    stale = known.where("cast(sample_id AS bigint) % 3 = 1").withColumns({"position": F.lit(0), "hard_tags": F.array(F.lit("old")), "gold": F.lit(None).cast(scoring.CORE)})
    done = scoring.online_rewards(scoring.with_gold(bare, known.unionByName(stale)))
    found = done.groupBy("prompt_exposure", F.col("gold").isNotNull().alias("has_gold")).agg(F.count("*").alias("records"), *(F.avg(c).alias(c) for c in A.COMPONENTS))
    return _rounded(found)


def validity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over the cells as validity_guards states them: rates to six places, passes from the exact ones."""
    return P.validity_report(panels.validity_guards(spark, sf_dir), 0.8, 0.7)


def secret_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line of every secret in documents and pages; the rest of the patterns is in secret_scan."""
    both = read(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text").union(read(spark, sf_dir, "pages").select(F.lit("pages"), "page_id", "html"))
    found = both.select("origin", "id", F.explode(messages.secret_places(F.col("text"), PLACED)).alias("f"))
    return found.groupBy("origin", "id", F.col("f.finding").alias("finding"), F.col("f.line").alias("line")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (reward_summary, reward_order_gate, online_rewards, validity_report, secret_places)}

_model = f"({MODELS!r})[sample_id % 3 + 1]"
_means = ", ".join(f"round(avg({c}), 9) AS {c}" for c in scoring.WEIGHTS)
_groups = f"SELECT {_model} AS model, round(avg(reward), 9) AS group_consistency FROM ({A.CONSISTENCY}) GROUP BY 1"
_summary = f"""SELECT r.*, g.group_consistency FROM (SELECT {_model} AS model, NULL::VARCHAR AS prompt_exposure, count(*) AS records, {_means}, round(avg({A._total}), 9) AS total_reward, count(DISTINCT sample_id) AS groups,
  count(DISTINCT CASE WHEN wrong > 0 THEN sample_id END) AS wrong_high_similarity_groups FROM ({A._rewards}) GROUP BY 1) r JOIN ({_groups}) g USING (model)
 UNION ALL BY NAME SELECT {_model} AS model, prompt_exposure, count(*) AS records, {_means}, round(avg({A._total}), 9) AS total_reward FROM ({A._rewards}) GROUP BY 1, 2"""
_no_gold = f"""SELECT sample_id, sum(w * CASE WHEN sim > 0.9 THEN -0.1 ELSE 0 END) / sum(w) AS reward FROM ({A._pairs}) GROUP BY sample_id"""
_online = f"""SELECT prompt_exposure, sample_id % 3 <> 0 AS has_gold, CASE WHEN has_gold THEN s_decision ELSE 0 END AS decision_reward, CASE WHEN has_gold THEN s_schema ELSE 0 END AS need_human_reward, CASE WHEN has_gold THEN s_schema ELSE 0 END AS risk_level_reward,
 CASE WHEN has_gold THEN s_schema ELSE 1 - s_schema END AS reason_code_reward, s_schema AS schema_reward, CASE WHEN has_gold THEN c.reward ELSE n.reward END AS exposure_consistency_reward, CASE WHEN has_gold THEN s_decision ELSE 0 END AS hard_case_bonus,
 (NOT has_gold AND s_schema = 1 AND p_decision = 'manual_review')::INT::DOUBLE AS false_manual_review_penalty FROM ({A._parsed}) s JOIN ({A.CONSISTENCY}) c USING (sample_id) JOIN ({_no_gold}) n USING (sample_id)"""


def _placed(name: str, pattern: str, origin: str, id_: str, column: str) -> str:
    """Matches of one pattern with the line ends before each: the pieces between matches, and the matches."""
    return f"""SELECT origin, id, '{name}' AS finding, 1 + sum(len(b) - len(replace(b, chr(10), ''))) OVER w + coalesce(sum(len(m) - len(replace(m, chr(10), ''))) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
 FROM (SELECT '{origin}' AS origin, {id_} AS id, generate_subscripts(regexp_extract_all({column}, $${pattern}$$), 1) AS k, unnest(regexp_extract_all({column}, $${pattern}$$)) AS m,
  unnest(string_split_regex({column}, $${pattern}$$)[1:len(regexp_extract_all({column}, $${pattern}$$))]) AS b FROM {origin}) WINDOW w AS (PARTITION BY id ORDER BY k)"""


_places = " UNION ALL ".join(_placed(n, p, *of) for n, p in PLACED.items() for of in (("documents", "doc_id", "text"), ("pages", "page_id", "html")))

ORACLES = {
    "reward_summary": _summary,
    "reward_order_gate": f"""SELECT string_agg(model, '>' ORDER BY total_reward DESC, model) AS ranking, list(model ORDER BY total_reward DESC, model) = {MODELS!r} AS passed FROM ({_summary}) WHERE prompt_exposure IS NULL""",
    "online_rewards": f"SELECT prompt_exposure, has_gold, count(*) AS records, {_means}, round(avg({A._total}), 9) AS total_reward FROM ({_online}) GROUP BY ALL",
    "validity_report": f"""SELECT bool_and(passed) AS passed, 0.8::DOUBLE AS endpoint_threshold, 0.7::DOUBLE AS condition_threshold, min(rate) FILTER (WHERE condition IS NULL) AS least_endpoint_rate, min(rate) FILTER (WHERE condition IS NOT NULL) AS least_condition_rate,
 count(*) FILTER (WHERE condition IS NULL AND NOT passed) AS failed_endpoints, count(*) FILTER (WHERE condition IS NOT NULL AND NOT passed) AS failed_conditions FROM ({panels.ORACLES["validity_guards"]})""",
    "secret_places": f"SELECT origin, id, finding, line::INT AS line, count(*) AS n FROM ({_places}) GROUP BY ALL",
}
