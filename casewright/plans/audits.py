"""Queries that select probes, take exact medians and compare tables by hash trees, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import hashtree, probes, quantiles
from casewright.plans.facts import Duck, Spark, read

# ---- probes: a record for every order, context and exposure, some of them lost or doubled ----

_CELLS = [(c, e) for c in probes.CONTEXTS for e in probes.EXPOSURES]


def _fate(d) -> str:
    return d.number("concat('probe|', cast(o_orderkey AS varchar(20)), '|', context_load, '|', prompt_exposure)")


def _listed(d) -> str:
    return d.number("concat('list|', cast(o_orderkey AS varchar(20)))")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.broadcast(spark.createDataFrame(_CELLS, "context_load string, prompt_exposure string"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").crossJoin(dim).withColumn("fate", F.expr(_fate(Spark)) % 200)
    times = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 1, 2).otherwise(1)
    kept = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times)))
    odd = F.when(F.col("fate") == 2, "unheard_of").otherwise(F.col("prompt_exposure"))
    return kept.select(F.col("o_orderkey").alias("case_id"), "context_load", odd.alias("prompt_exposure"), F.col("o_orderpriority").alias("family"))


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fifths of the orders in an order of their own, some named twice."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.expr(_listed(Spark)).alias("place")).where("place % 5 < 2")
    return orders.union(orders.where("place % 7 = 0").select("case_id", F.col("place") - 1000))


def probe_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the listed cases with complete groups, by place in the list and cell."""
    records = _records(spark, sf_dir)
    chosen = probes.listed_cases(records, _list(spark, sf_dir))
    bad = probes.incomplete_groups(probes.selected(records, chosen), chosen).select("case_id").distinct()
    return probes.select_probe(records, chosen.join(bad, "case_id", "left_anti")).select("case_id", "context_load", "prompt_exposure", "place", "cell", "position")


def probe_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the listed cases whose exposures are not complete and unique."""
    records = _records(spark, sf_dir)
    chosen = probes.listed_cases(records, _list(spark, sf_dir))
    found = probes.incomplete_groups(probes.selected(records, chosen), chosen)
    return found.select("case_id", "context_load", "records", F.array_join("missing", "|").alias("missing"), F.array_join("doubled", "|").alias("doubled"), "unexpected")


# ---- exact medians ----


def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of prices by flags (four large groups) and by supplier (many small ones)."""
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", F.col("l_extendedprice").cast("double").alias("price"))
    large = quantiles.medians(lines, "price", "l_returnflag", "l_linestatus").select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("grp"), "median")
    small = quantiles.medians(lines, "price", "l_suppkey").select(F.col("l_suppkey").cast("string").alias("grp"), "median")
    return large.union(small).select("grp", F.round("median", 4).alias("median"))


# ---- hash trees ----

TREE_DEPTH = 2


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order keys of every line by status, and a version of it with some lines gone, some doubled and some changed."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), "l_orderkey", "l_linenumber")
    other = lines.where("NOT (l_orderkey % 997 = 0 AND l_linenumber = 1)").withColumn("l_orderkey", F.when((F.col("l_orderkey") % 1009 == 5) & (F.col("l_linenumber") == 2), -F.col("l_orderkey")).otherwise(F.col("l_orderkey")))
    return lines, other.union(lines.where("l_orderkey % 1499 = 3 AND l_linenumber = 1"))


def tree_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of a hash tree of depth two over the lines' order keys, by status."""
    lines, _ = _versions(spark, sf_dir)
    return hashtree.hash_tree(lines, ["grp"], "l_orderkey", TREE_DEPTH)


def tree_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys whose numbers of lines differ between two versions, met down the trees."""
    return hashtree.differing_ids(*_versions(spark, sf_dir), ["grp"], "l_orderkey", TREE_DEPTH)


QUERIES = {f.__name__: f for f in (probe_select, probe_incomplete, group_medians, tree_hashes, tree_differences)}

_cells = ", ".join(f"('{c}', '{e}', {i})" for i, (c, e) in enumerate(_CELLS))
_records_sql = f"""SELECT o_orderkey AS case_id, context_load, CASE WHEN fate = 2 THEN 'unheard_of' ELSE prompt_exposure END AS prompt_exposure, CASE WHEN fate = 2 THEN {probes.UNKNOWN} ELSE cell END AS cell
 FROM (SELECT *, {_fate(Duck)} % 200 AS fate FROM orders CROSS JOIN (VALUES {_cells}) v(context_load, prompt_exposure, cell)) JOIN (VALUES (1), (2)) t(copy) ON copy <= CASE fate WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END"""
_chosen_sql = f"""SELECT o_orderkey AS case_id, min(place) AS place FROM (SELECT o_orderkey, {_listed(Duck)} AS p FROM orders), LATERAL (SELECT unnest([p, CASE WHEN p % 7 = 0 THEN p - 1000 END]) AS place)
 WHERE p % 5 < 2 AND place IS NOT NULL GROUP BY o_orderkey"""
_faulty_sql = f"""SELECT * FROM (SELECT c.case_id, k.context_load, count(r.case_id) AS records,
  array_to_string([e FOR e IN {probes.EXPOSURES!r} IF NOT list_contains(coalesce(list(r.prompt_exposure), []), e)], '|') AS missing,
  array_to_string([e FOR e IN {probes.EXPOSURES!r} IF len(list_filter(list(r.prompt_exposure), lambda x: x = e)) > 1], '|') AS doubled,
  count(*) FILTER (WHERE r.prompt_exposure = 'unheard_of') AS unexpected
 FROM ({_chosen_sql}) c CROSS JOIN (VALUES ('short'), ('long')) k(context_load) LEFT JOIN ({_records_sql}) r ON r.case_id = c.case_id AND r.context_load = k.context_load GROUP BY c.case_id, k.context_load)
 WHERE missing <> '' OR doubled <> '' OR unexpected > 0"""


def _tree_sql(rows: str) -> str:
    """Nodes of a tree of depth two, level by level."""
    up = "SELECT grp, {k} AS level, substr(node, 1, {k}) AS node, sum(ids)::BIGINT AS ids, sum(rows)::BIGINT AS rows, sha256(string_agg(node || '=' || h, ',' ORDER BY node)) AS h FROM {t} GROUP BY grp, substr(node, 1, {k})"
    return f"""WITH c AS (SELECT grp, l_orderkey::VARCHAR AS id, count(*) AS n, sha256(l_orderkey::VARCHAR) AS key FROM ({rows}) GROUP BY ALL),
 l2 AS (SELECT grp, 2 AS level, substr(key, 1, 2) AS node, count(*) AS ids, sum(n)::BIGINT AS rows, sha256(to_json(list(id || ':' || n ORDER BY key))::VARCHAR) AS h FROM c GROUP BY ALL),
 l1 AS ({up.format(k=1, t='l2')}), l0 AS ({up.format(k=0, t='l1')}) SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0"""


_lines = "SELECT l_linestatus AS grp, l_orderkey, l_linenumber FROM lineitem"
_other = f"""SELECT grp, CASE WHEN l_orderkey % 1009 = 5 AND l_linenumber = 2 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey FROM ({_lines}) WHERE NOT (l_orderkey % 997 = 0 AND l_linenumber = 1)
 UNION ALL SELECT grp, l_orderkey FROM ({_lines}) WHERE l_orderkey % 1499 = 3 AND l_linenumber = 1"""

ORACLES = {
    "probe_select": f"""SELECT case_id, context_load, prompt_exposure, place, cell, row_number() OVER (ORDER BY place, case_id, cell) AS position
 FROM ({_records_sql}) JOIN ({_chosen_sql}) USING (case_id) WHERE case_id NOT IN (SELECT case_id FROM ({_faulty_sql}))""",
    "probe_incomplete": _faulty_sql,
    "group_medians": """SELECT l_returnflag || '|' || l_linestatus AS grp, round(median(l_extendedprice::DOUBLE), 4) AS median FROM lineitem GROUP BY ALL
 UNION ALL SELECT l_suppkey::VARCHAR, round(median(l_extendedprice::DOUBLE), 4) FROM lineitem GROUP BY l_suppkey""",
    "tree_hashes": _tree_sql(_lines),
    "tree_differences": f"""SELECT coalesce(a.grp, b.grp) AS grp, coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM (SELECT grp, l_orderkey::VARCHAR AS id, count(*) AS n FROM ({_lines}) GROUP BY ALL) a
 FULL JOIN (SELECT grp, l_orderkey::VARCHAR AS id, count(*) AS n FROM ({_other}) GROUP BY ALL) b ON a.grp = b.grp AND a.id = b.id WHERE a.n IS DISTINCT FROM b.n""",
}
