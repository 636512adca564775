"""Queries over a prediction panel and over vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import panel as P
from casewright.operators import vectors as V
from casewright.operators.bootstrap import case_bootstrap
from casewright.plans.facts import Duck, Spark, read

CONDITIONS = P.CONDITIONS
ROBUST = CONDITIONS[4:]
DRAWS = 200


def _right(d) -> str:
    number = d.number("concat('panel|', cast(\"case\" AS varchar(20)), '|', condition, '|', endpoint)" if d is Duck else "concat('panel|', cast(case AS string), '|', condition, '|', endpoint)")
    return f"{number} % 100 < CASE WHEN condition IN ('no_skill', 'irrelevant') THEN 60 ELSE 85 END + CASE WHEN endpoint = 'staged_order' THEN CASE skill WHEN 'F' THEN 7 WHEN 'O' THEN 6 ELSE -2 END ELSE 0 END"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(skill, case, family, condition, endpoint, ok, value): cases from orders, answers by hash."""
    dim = F.broadcast(spark.createDataFrame([(c, e) for c in CONDITIONS for e in (P.RANDOM, P.STAGED)], "condition string, endpoint string"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("skill"), F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("family")).crossJoin(dim)
    return rows.withColumn("ok", F.expr(_right(Spark))).withColumn("value", F.col("ok").cast("double"))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def macro_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.effects(P.by_case(panel(spark, sf_dir), P.BALANCED)))


def grouped_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.grouped_effects(panel(spark, sf_dir), "condition"))


def _pairs(rows: DataFrame) -> DataFrame:
    flag = lambda e, n: F.max(F.when(F.col("endpoint") == e, F.col("ok"))).alias(n)
    return rows.groupBy("skill", "condition", "case").agg(flag(P.RANDOM, "random_ok"), flag(P.STAGED, "staged_ok"))


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality against toxicity labels, by language."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    pairs = labels.join(docs.select("doc_id", "lang"), "doc_id").select("lang", (F.col("toxic") == 1).alias("random_ok"), (F.col("quality") == 1).alias("staged_ok"))
    return _rounded(P.mcnemar(pairs, "lang"), 9)


def mcnemar_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = P.mcnemar(_pairs(panel(spark, sf_dir).where(F.col("condition").isin(ROBUST))), "skill", "condition")
    return _rounded(P.holm(tests, order=["skill", "condition"]), 9)


def validity_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.validity(panel(spark, sf_dir), "ok", 0.8, 0.7))


def _case_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(skill, case, family, delta) of the balanced construct."""
    return P.case_deltas(panel(spark, sf_dir), P.BALANCED)


def bootstrap_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = P.poisson_bootstrap(_case_deltas(spark, sf_dir).select("skill", "case", "delta"), DRAWS, "boot", "case")
    return _rounded(P.interval(draws, DRAWS))


def bootstrap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case bootstrap of 10,000 draws, each of exactly as many cases as there are. Its random numbers have no SQL form;
    a test holds it to a version that splits all draws in one process."""
    draws = case_bootstrap(_case_deltas(spark, sf_dir).select("skill", "case", "delta"), 10_000, "boot", "case")
    return _rounded(P.interval(draws, 10_000))


def bootstrap_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _case_deltas(spark, sf_dir).groupBy("skill", "family").agg(F.avg("delta").alias("delta"))
    return _rounded(P.interval(P.cluster_bootstrap(means, DRAWS, "boot", "family"), DRAWS))


def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision about a panel, its bounds and its parts; a construct is each of the robust conditions."""
    row = P.decision(panel(spark, sf_dir), CONDITIONS, [[[c]] for c in ROBUST], DRAWS, "boot", 0.5, 0.5, case_bootstrap=P.poisson_bootstrap)
    return _rounded(row.select("state", "macro", "low", "high", F.col("gains").cast("long"), F.col("losses").cast("long"), "c_macro", "minimal_delta", "no_skill_delta", "case_lower", "family_lower", "guards_pass", "data_valid"))


def panel_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with some cells dropped and some doubled: the cases that fail."""
    rows = panel(spark, sf_dir).where("NOT (case % 40 = 0 AND condition = 'full')")
    doubled = rows.where("case % 60 = 7 AND condition = 'minimal' AND endpoint = 'staged_order'")
    return P.gates(rows.unionByName(doubled), len(CONDITIONS))


# ---- vectors: groups of four neighbouring vectors, one an exposure ----


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("grp"), (F.col("vec_id") % 4).cast("int").alias("exposure"), "embedding", "label")


def vector_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.gram(_grouped(spark, sf_dir), "grp", "exposure", "embedding"), 5)


def vector_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.centred(_grouped(spark, sf_dir), "grp", "embedding")
    return _rounded(rows.select("vec_id", V.norm(F.col("residual")).alias("residual_norm")), 5)


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.module_norms(_grouped(spark, sf_dir), "vec_id", "embedding", 16), 5)


def count_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.count_sketch(_grouped(spark, sf_dir), "vec_id", "embedding", 16, 20260724), 5)


def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the cosine to the group's first vector, by label and exposure."""
    rows = _grouped(spark, sf_dir)
    first = rows.where("exposure = 0").select("grp", F.col("embedding").alias("base"))
    cosines = rows.where("exposure > 0").join(first, "grp").withColumn("c", V.cosine(F.col("embedding"), F.col("base")))
    return _rounded(V.finite_stats(cosines, "c", "label", "exposure"), 5)


def context_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm of the even minus the odd vector of a pair, by label: paired contexts, both present."""
    rows = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), V.norm(F.col("embedding")).alias("n"), "label")
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = rows.groupBy("pair").agg(pick(0, "n").alias("a"), pick(1, "n").alias("b"), pick(0, "label").alias("label")).where("a IS NOT NULL AND b IS NOT NULL")
    return _rounded(V.finite_stats(both.withColumn("d", F.col("a") - F.col("b")), "d", "label"), 5)


QUERIES = {f.__name__: f for f in (macro_effect, grouped_effects, mcnemar, mcnemar_holm, validity_guards, bootstrap_case, bootstrap_exact, bootstrap_family, decision_ladder, panel_gates, vector_gram, vector_centered, vector_norms, count_sketch, vector_groups, context_delta)}

_panel = f"""SELECT *, ok::INT::DOUBLE AS value FROM (SELECT *, {_right(Duck)} AS ok FROM (SELECT o_orderstatus AS skill, o_orderkey AS "case", o_orderpriority AS family FROM orders)
 CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in CONDITIONS)}) c(condition) CROSS JOIN (VALUES ('random_mix_order'), ('staged_order')) e(endpoint))"""
_balanced = f"""SELECT skill, "case", any_value(family) AS family, endpoint, (max(value) FILTER (WHERE condition = 'no_system') + max(value) FILTER (WHERE condition = 'irrelevant')
 + (max(value) FILTER (WHERE condition = 'paraphrase_a') + max(value) FILTER (WHERE condition = 'paraphrase_b')) / 2) / 3 AS score FROM ({_panel}) GROUP BY skill, "case", endpoint"""


def _effects(cases: str) -> str:
    one = f"SELECT skill, avg(score) FILTER (WHERE endpoint = 'random_mix_order') AS r, avg(score) FILTER (WHERE endpoint = 'staged_order') AS s FROM ({cases}) GROUP BY skill"
    return f"SELECT skill, r AS random, s AS staged, s - r AS delta FROM ({one}) UNION ALL SELECT 'macro', avg(r), avg(s), avg(s) - avg(r) FROM ({one})"


def _single(condition: str) -> str:
    return f"SELECT skill, \"case\", endpoint, value AS score FROM ({_panel}) WHERE condition = '{condition}'"


_deltas = f"""SELECT skill, "case", any_value(family) AS family, sum(CASE endpoint WHEN 'staged_order' THEN score ELSE -score END) AS delta FROM ({_balanced}) GROUP BY skill, "case\""""


def _bootstrap(values: str, cluster: str, draws: int) -> str:
    return f"""WITH v AS (SELECT skill, row_number() OVER (PARTITION BY skill ORDER BY {cluster}) - 1 AS slot, count(*) OVER (PARTITION BY skill) AS size, delta FROM ({values})),
 p AS (SELECT draw, skill, ('0x' || substr(sha256('boot|' || draw || '|' || skill || '|' || slot), 1, 13))::BIGINT % size AS slot FROM v CROSS JOIN (SELECT unnest(range(0, {draws})) AS draw)),
 m AS (SELECT draw, avg(x) AS mean FROM (SELECT draw, skill, avg(delta) AS x FROM p JOIN v USING (skill, slot) GROUP BY ALL) GROUP BY draw),
 k AS (SELECT mean, row_number() OVER (ORDER BY mean, draw) - 1 AS k FROM m)
 SELECT avg(mean) AS mean, max(mean) FILTER (WHERE k = {int(.025 * draws)}) AS ci95_lower, max(mean) FILTER (WHERE k = {min(draws - 1, int(.975 * draws))}) AS ci95_upper FROM k"""


def _poisson(values: str, cluster: str, draws: int) -> str:
    """As poisson_bootstrap: the same mixed hashes, reckoned modulo 2 ** 64 in 128 bits."""
    mixed = "xor({x}, {x} >> {s})::UHUGEINT * {m} % 18446744073709551616"
    first = f"((key::UHUGEINT + draw::UHUGEINT * {P.MIX[0]}) % 18446744073709551616)::UBIGINT"
    weight = " ".join(f"WHEN u < {float(t)!r} THEN {k}" for k, t in enumerate(P.POISSON[:-1]))
    return f"""WITH v AS (SELECT skill, delta, ('0x' || substr(sha256('boot|' || skill || '|' || {cluster}), 1, 15))::BIGINT AS key FROM ({values})),
 a AS (SELECT skill, delta, draw, {first} AS x FROM v CROSS JOIN (SELECT unnest(range(1, {draws + 1})) AS draw)),
 b AS (SELECT skill, delta, draw, ({mixed.format(x='x', s=30, m=P.MIX[1])})::UBIGINT AS x FROM a),
 c AS (SELECT skill, delta, draw, ((({mixed.format(x='x', s=27, m=P.MIX[2])})::UBIGINT) >> 11)::DOUBLE / {float(1 << 53)!r} AS u FROM b),
 w AS (SELECT skill, delta, draw, CASE {weight} ELSE {len(P.POISSON) - 1} END AS w FROM c),
 m AS (SELECT draw, avg(x) AS mean FROM (SELECT draw, skill, CASE WHEN sum(w) > 0 THEN sum(w * delta) / sum(w) ELSE avg(delta) END AS x FROM w GROUP BY ALL) GROUP BY draw),
 k AS (SELECT mean, row_number() OVER (ORDER BY mean, draw) - 1 AS k FROM m)
 SELECT avg(mean) AS mean, max(mean) FILTER (WHERE k = {int(.025 * draws)}) AS ci95_lower, max(mean) FILTER (WHERE k = {min(draws - 1, int(.975 * draws))}) AS ci95_upper FROM k"""


_round3 = "SELECT round(mean, 6) AS mean, round(ci95_lower, 6) AS ci95_lower, round(ci95_upper, 6) AS ci95_upper FROM ({})"
_family = f"SELECT skill, family, avg(delta) AS delta FROM ({_deltas}) GROUP BY ALL"
_tail = "list_sum(list_transform(range(0, least(random_only, staged_only) + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))))"


def _mcnemar(pairs: str, keys: str) -> str:
    return f"""SELECT {keys}, cases, "both", random_only, staged_only, CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * {_tail}) END AS p_value, (staged_only - random_only) / cases AS delta
 FROM (SELECT *, random_only + staged_only AS n FROM (SELECT {keys}, count(*) AS cases, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS random_only, count(*) FILTER (WHERE NOT a AND b) AS staged_only FROM ({pairs}) GROUP BY ALL))"""


_robust = f"""SELECT skill, condition, "case", bool_or(ok AND endpoint = 'random_mix_order') AS a, bool_or(ok AND endpoint = 'staged_order') AS b FROM ({_panel}) WHERE condition IN ({', '.join(f"'{c}'" for c in ROBUST)}) GROUP BY ALL"""
_grouped_sql = f"""SELECT condition, avg(v) FILTER (WHERE endpoint = 'random_mix_order') AS random, avg(v) FILTER (WHERE endpoint = 'staged_order') AS staged FROM (SELECT condition, skill, endpoint, avg(value) AS v FROM ({_panel}) GROUP BY ALL) GROUP BY condition"""
_long = "SELECT vec_id, vec_id // 4 AS grp, (vec_id % 4)::INT AS exposure, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings"
_cos = f"""SELECT a.vec_id, a.label, a.exposure, sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)), 0) AS c FROM ({_long}) a JOIN ({_long}) b ON a.grp = b.grp AND a.i = b.i AND b.exposure = 0 WHERE a.exposure > 0 GROUP BY ALL"""


def _stats(value: str) -> str:
    return f"count({value}) AS n, round(avg({value}), 5) AS mean, round(median({value}), 5) AS median, round(min({value}), 5) AS low, round(max({value}), 5) AS high, round(avg(({value} > 0)::INT), 5) AS positive"


ORACLES = {
    "macro_effect": f"SELECT skill, round(random, 6) AS random, round(staged, 6) AS staged, round(delta, 6) AS delta FROM ({_effects(_balanced)})",
    "grouped_effects": f"SELECT condition, round(random, 6) AS random, round(staged, 6) AS staged, round(staged - random, 6) AS delta FROM ({_grouped_sql})",
    "mcnemar": f"""SELECT lang, cases, "both", random_only, staged_only, round(p_value, 9) AS p_value, round(delta, 9) AS delta FROM ({_mcnemar('SELECT lang, toxic = 1 AS a, quality = 1 AS b FROM labels JOIN documents USING (doc_id)', 'lang')})""",
    "mcnemar_holm": f"""SELECT skill, condition, cases, "both", random_only, staged_only, round(p_value, 9) AS p_value, round(delta, 9) AS delta,
 round(max(least(1, (m - k + 1) * p_value)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 9) AS holm_p FROM (SELECT *, row_number() OVER (ORDER BY p_value, skill, condition) AS k, count(*) OVER () AS m FROM ({_mcnemar(_robust, 'skill, condition')}))""",
    "validity_guards": f"""SELECT skill, endpoint, NULL AS condition, round(avg(value), 6) AS rate, count(*) AS n, avg(value) >= 0.8 AS passed FROM ({_panel}) GROUP BY skill, endpoint
 UNION ALL SELECT skill, endpoint, condition, round(avg(value), 6), count(*), avg(value) >= 0.7 FROM ({_panel}) GROUP BY skill, endpoint, condition""",
    "bootstrap_case": _round3.format(_poisson(_deltas, '"case"', DRAWS)),
    "bootstrap_family": _round3.format(_bootstrap(_family, "family", DRAWS)),
    "decision_ladder": f"""WITH p AS (SELECT max(delta) FILTER (WHERE skill = 'macro') AS macro, min(delta) FILTER (WHERE skill <> 'macro') AS low, max(delta) FILTER (WHERE skill <> 'macro') AS high,
  count(*) FILTER (WHERE skill <> 'macro' AND delta >= 0.05) AS gains, count(*) FILTER (WHERE skill <> 'macro' AND delta < 0) AS losses FROM ({_effects(_balanced)})),
 c AS (SELECT max(delta) FILTER (WHERE skill = 'macro') AS c_macro, min(delta) FILTER (WHERE skill <> 'macro') AS c_low FROM ({_effects(_single('full'))})),
 z AS (SELECT (SELECT delta FROM ({_effects(_single('minimal'))}) WHERE skill = 'macro') AS minimal_delta, (SELECT delta FROM ({_effects(_single('no_skill'))}) WHERE skill = 'macro') AS no_skill_delta,
  (SELECT min(staged - random) FROM ({_grouped_sql}) WHERE condition IN ({', '.join(f"'{x}'" for x in ROBUST)})) AS construct_min,
  (SELECT ci95_lower FROM ({_bootstrap(_family, 'family', DRAWS)})) AS family_lower, (SELECT ci95_lower FROM ({_poisson(_deltas, '"case"', DRAWS)})) AS case_lower,
  (SELECT bool_and(v >= 0.5) FROM (SELECT avg(value) AS v FROM ({_panel}) GROUP BY skill, endpoint, condition)) AND (SELECT bool_and(v >= 0.5) FROM (SELECT avg(value) AS v FROM ({_panel}) GROUP BY skill, endpoint)) AS guards_pass)
 SELECT CASE WHEN macro >= 0.05 AND case_lower > 0 AND family_lower > 0 AND gains >= 2 AND low > -0.05 AND construct_min > -0.05 AND c_macro >= -0.02 AND c_low > -0.05 AND minimal_delta > -0.05 AND no_skill_delta > -0.05 AND guards_pass THEN 'PASS'
  WHEN macro <= 0 OR losses >= 2 OR least(low, construct_min, c_macro, c_low, minimal_delta, no_skill_delta) <= -0.05 THEN 'FAIL'
  WHEN (gains > 0 AND losses > 0) OR high - low >= 0.10 THEN 'MIXED' ELSE 'INCONCLUSIVE' END AS state,
 round(case_lower, 6) AS case_lower, round(family_lower, 6) AS family_lower, (SELECT count(*) = 0 FROM (SELECT 1 FROM ({_panel}) GROUP BY skill, "case" HAVING count(*) <> 16)) AS data_valid, round(macro, 6) AS macro, round(low, 6) AS low, round(high, 6) AS high, gains, losses, round(c_macro, 6) AS c_macro, round(minimal_delta, 6) AS minimal_delta, round(no_skill_delta, 6) AS no_skill_delta, guards_pass FROM p, c, z""",
    "panel_gates": f"""WITH r AS (SELECT * FROM ({_panel}) WHERE NOT ("case" % 40 = 0 AND condition = 'full')), d AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE "case" % 60 = 7 AND condition = 'minimal' AND endpoint = 'staged_order')
 SELECT skill, "case", count(*) AS cells, count(DISTINCT condition || '|' || endpoint) AS distinct_cells, count(DISTINCT family) AS families FROM d GROUP BY skill, "case" HAVING count(*) <> 16 OR count(DISTINCT condition || '|' || endpoint) <> 16""",
    "vector_gram": f"""SELECT a.grp, a.exposure AS "left", b.exposure AS "right", round(sum(a.v * b.v), 5) AS dot, round(sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)), 0), 5) AS cosine
 FROM ({_long}) a JOIN ({_long}) b ON a.grp = b.grp AND a.i = b.i AND a.exposure <= b.exposure GROUP BY ALL""",
    "vector_centered": f"SELECT vec_id, round(sqrt(sum(power(v - m, 2))), 5) AS residual_norm FROM (SELECT *, avg(v) OVER (PARTITION BY grp, i) AS m FROM ({_long})) GROUP BY vec_id",
    "vector_norms": f"SELECT vec_id, (i // 16)::INT AS module, round(sqrt(sum(v * v)), 5) AS norm FROM ({_long}) GROUP BY ALL",
    "count_sketch": f"SELECT vec_id, (i::BIGINT * 1103515245 + 20260724) % 16 AS bucket, round(sum(CASE WHEN (i::BIGINT * 214013 + {20260724 // 7}) % 2 = 1 THEN v ELSE -v END), 5) AS value FROM ({_long}) GROUP BY ALL",
    "vector_groups": f"SELECT label, exposure, {_stats('c')} FROM ({_cos}) GROUP BY ALL",
    "context_delta": f"""SELECT label, {_stats('d')} FROM (SELECT a.label, a.n - b.n AS d FROM (SELECT vec_id, label, sqrt(sum(v * v)) AS n FROM ({_long}) GROUP BY ALL) a
 JOIN (SELECT vec_id, sqrt(sum(v * v)) AS n FROM ({_long}) GROUP BY ALL) b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) GROUP BY label""",
}
