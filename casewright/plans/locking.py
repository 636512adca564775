"""Queries over locked splits and the causal comparison's datasets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import builders, causal, locks
from casewright.operators.layout import BLOCK_ROWS
from casewright.plans.facts import read

SPLITS = ["train", "train", "train", "train", "train", "train", "train", "validation", "discovery_eval", "confirmation"]
SEED = 7


def _cases(spark: SparkSession, sf_dir: str, spoiled: bool = False) -> DataFrame:
    """Orders as cases: skill by status, split by number; spoiled ones have some facts, texts and cases changed."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("skill_id"), F.element_at(F.array(*map(F.lit, SPLITS)), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("split"), (F.col("o_orderkey") + 1).alias("slot"),
        F.sha2(F.concat(F.lit("case|"), F.col("o_orderkey")), 256).alias("semantic_case_hash"), F.sha2(F.concat(F.lit("facts|"), F.col("o_custkey")), 256).alias("facts_hash"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("user_input"),
    )
    if not spoiled:
        return rows
    rows = rows.where("NOT (split = 'validation' AND skill_id = 'P' AND slot % 7 = 0)")
    text = F.when((F.col("split") == "confirmation") & (F.col("skill_id") == "F") & (F.col("slot") % 5 == 4), F.concat("user_input", F.lit("!"))).otherwise(F.col("user_input"))
    facts = F.when((F.col("split") == "train") & (F.col("skill_id") == "O") & (F.col("slot") % 11 == 0), F.sha2("facts_hash", 256)).otherwise(F.col("facts_hash"))
    return rows.withColumns({"user_input": text, "facts_hash": facts})


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.split_manifest(_cases(spark, sf_dir), "user_input", depth=1)


def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit finds where cases were changed after their splits had been locked."""
    return locks.audit(_cases(spark, sf_dir, spoiled=True), split_manifest(spark, sf_dir), "user_input", depth=1)


def causal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of all five variants over the customers, with half as many records again as customers."""
    samples = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    n = samples.count()
    return causal.causal_layout(samples, n, 12 * (3 * n // 24), SEED)


def causal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal.variant_summary(causal_sets(spark, sf_dir))


def replay_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay stages over the orders; hard are the few urgent ones that are open in part, which have to be repeated."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.expr("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").alias("hard"))
    found = builders.replay_layout(rows, rows.count() // 30 * 10, SEED)
    return found.select("stage", "position", "sample_id", "hard", "copy", "prompt_exposure")


QUERIES = {f.__name__: f for f in (split_manifest, split_audit, causal_sets, causal_summary, replay_sets)}

_cases_sql = f"""SELECT o_orderstatus AS skill_id, ({SPLITS!r})[o_orderkey % 10 + 1] AS split, o_orderkey + 1 AS slot, sha256('case|' || o_orderkey) AS semantic_case_hash, sha256('facts|' || o_custkey) AS facts_hash, 'Order ' || o_orderkey AS user_input FROM orders"""
_spoiled_sql = f"""SELECT * REPLACE (CASE WHEN split = 'confirmation' AND skill_id = 'F' AND slot % 5 = 4 THEN user_input || '!' ELSE user_input END AS user_input,
 CASE WHEN split = 'train' AND skill_id = 'O' AND slot % 11 = 0 THEN sha256(facts_hash) ELSE facts_hash END AS facts_hash) FROM ({_cases_sql}) WHERE NOT (split = 'validation' AND skill_id = 'P' AND slot % 7 = 0)"""


def _manifest(cases: str) -> str:
    ordered = lambda c, n: f"""SELECT skill_id, split, sha256(string_agg(h, '' ORDER BY b)) AS {n} FROM (SELECT skill_id, split, (slot - 1) // {BLOCK_ROWS} AS b, sha256(to_json(list({c} ORDER BY slot))::VARCHAR) AS h FROM ({cases}) GROUP BY ALL) GROUP BY ALL"""
    leaves = f"""SELECT skill_id, split, substr(key, 1, 1) AS node, sha256(to_json(list(facts_hash || ':' || n ORDER BY key))::VARCHAR) AS h FROM (SELECT skill_id, split, facts_hash, count(*) AS n, sha256(facts_hash) AS key FROM ({cases}) GROUP BY ALL) GROUP BY ALL"""
    return f"""SELECT * FROM (SELECT skill_id, split, count(*) AS cases, split = 'confirmation' AS locked FROM ({cases}) GROUP BY ALL) JOIN ({ordered('semantic_case_hash', 'case_sha256')}) USING (skill_id, split)
 JOIN (SELECT skill_id, split, sha256(string_agg(node || '=' || h, ',' ORDER BY node)) AS facts_sha256 FROM ({leaves}) GROUP BY ALL) USING (skill_id, split) JOIN ({ordered('user_input', 'text_sha256')}) USING (skill_id, split)"""


_stages = ", ".join(f"({k}, '{e}', {w}, {sum(x for _, x in s)})" for k, s in enumerate(builders.STAGES) for e, w in s)
_quarter = " ".join(f"WHEN slot <= {k + 1} * n // 4 THEN '{e}'" for k, e in enumerate(builders.EXPOSURES))


def _drawn(seed: str, size: str) -> str:
    """Sources repeated, in hash order and cut, by position."""
    return f"""SELECT sample_id, copy, row_number() OVER (ORDER BY sha256('{SEED}|{seed}|' || sample_id || '|' || copy), sample_id || '|' || copy) AS position
 FROM (SELECT c_custkey AS sample_id, unnest(range(1, greatest(1, ((SELECT {size} FROM s) + (SELECT c FROM s) - 1) // (SELECT c FROM s)) + 1)) AS copy FROM customer) QUALIFY position <= (SELECT {size} FROM s)"""


_staged = " UNION ALL ".join(f"SELECT '{stage}' AS stage, {k} AS k, d.* FROM ({_drawn(stage, 'n // 3')}) d" for k, stage in enumerate(causal.STAGE_NAMES))
_sets = f"""WITH s AS (SELECT count(*) AS c, 12 * (3 * count(*) // 24) AS n FROM customer),
 mixed AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}|mix|' || slot), slot) AS position, CASE {_quarter} END AS prompt_exposure FROM (SELECT n, unnest(range(1, n + 1)) AS slot FROM s)),
 quotas AS (SELECT k, e, q, sum(q) OVER (ORDER BY k, i ROWS UNBOUNDED PRECEDING) - q AS before FROM (SELECT row_number() OVER () AS i, k, e, n // 3 * w // whole AS q FROM (VALUES {_stages}) v(k, e, w, whole), s)),
 vector AS (SELECT k, e AS prompt_exposure, row_number() OVER (PARTITION BY k ORDER BY sha256('{SEED}|' || k || '|' || slot), slot) AS position FROM (SELECT k, e, unnest(range(before::BIGINT + 1, (before + q)::BIGINT + 1)) AS slot FROM quotas)),
 staged AS (SELECT stage, k, sample_id, copy, position, prompt_exposure FROM ({_staged}) JOIN vector USING (k, position))
SELECT 'balanced_random' AS variant, position, NULL AS stage, sample_id, copy::INT AS copy, prompt_exposure FROM ({_drawn('random', 'n')}) JOIN mixed USING (position)
UNION ALL SELECT 'balanced_staged_' || stage, position, stage, sample_id, copy::INT, prompt_exposure FROM staged
UNION ALL SELECT 'balanced_staged_all', position + k * (n // 3), stage, sample_id, copy::INT, prompt_exposure FROM staged, s"""

#: Cumulative tenths of exposures by replay stage.
_tenths = " ".join(f"WHEN k = {k} AND (position - 1) * 10 < {sum(list(w.values())[:i + 1])} * size THEN '{e}'" for k, w in enumerate(builders.REPLAY) for i, e in enumerate(w))

ORACLES = {
    "replay_sets": f"""WITH p AS (SELECT o_orderkey AS sample_id, o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS hard FROM orders),
 d AS (SELECT k, sample_id, hard, size, CASE WHEN hard THEN size // 5 ELSE size - size // 5 END AS want, count(*) OVER (PARTITION BY k, hard) AS n, row_number() OVER (PARTITION BY k, hard ORDER BY sha256('{SEED}|' || k || '|' || sample_id), sample_id) AS r
  FROM p CROSS JOIN (SELECT unnest(range(3)) AS k) CROSS JOIN (SELECT count(*) // 30 * 10 AS size FROM orders)),
 c AS (SELECT k, sample_id, hard, size, unnest(range(1, want // n + (r <= want % n)::INT + 1)) AS copy FROM d),
 o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sha256('{SEED}|place|' || k || '|' || sample_id || '|' || copy), sample_id || '|' || copy) AS position FROM c)
SELECT 'stage' || (k + 1) AS stage, position + k * size AS position, sample_id, hard, copy, CASE {_tenths} END AS prompt_exposure FROM o""",
    "split_manifest": _manifest(_cases_sql),
    "split_audit": f"""WITH a AS ({_manifest(_cases_sql)}), b AS ({_manifest(_spoiled_sql)}) SELECT skill_id, split, unnest(list_filter([CASE WHEN a.cases <> b.cases THEN 'cases' END, CASE WHEN a.case_sha256 <> b.case_sha256 THEN 'case_sha256' END,
 CASE WHEN a.facts_sha256 <> b.facts_sha256 THEN 'facts_sha256' END, CASE WHEN a.text_sha256 <> b.text_sha256 THEN 'text_sha256' END], lambda x: x IS NOT NULL)) AS problem FROM a JOIN b USING (skill_id, split)""",
    "causal_sets": _sets,
    "causal_summary": f"""SELECT variant, sum(copies)::BIGINT AS records, count(*) AS sources, max(copies) AS most_copies, {', '.join(f"sum(n_{e})::BIGINT AS n_{e}" for e in builders.EXPOSURES)}
 FROM (SELECT variant, sample_id, count(*) AS copies, {', '.join(f"count(*) FILTER (WHERE prompt_exposure = '{e}') AS n_{e}" for e in builders.EXPOSURES)} FROM ({_sets}) GROUP BY ALL) GROUP BY variant""",
}
