"""Queries about messages, prompts and texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import messages as M
from casewright.operators import layout
from casewright.plans import facts
from casewright.plans.facts import LINES_SQL, Duck, Spark, read

SYSTEM = "Follow the refund policy."


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.collected(read(spark, sf_dir, "conversations"), "conv_id", "turn")


def message_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document: system (none for odd ids), user and assistant text, flattened."""
    rows = read(spark, sf_dir, "documents")
    built = M.build(F.when(F.col("doc_id") % 2 == 0, SYSTEM).otherwise(""), F.col("text"), F.col("lang"))
    return rows.select("doc_id", F.size(built).cast("long").alias("n"), F.sha2(M.flatten(built), 256).alias("h"))


def message_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their system messages replaced: count and characters."""
    out = M.with_system(F.col("messages"), F.lit(SYSTEM))
    return _chats(spark, sf_dir).select("conv_id", F.size(M.without_role(F.col("messages"))).cast("long").alias("kept"), F.size(out).cast("long").alias("n"), M.characters(out).alias("characters"))


def last_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", M.last_of(F.col("messages"), "user", F.lit("(none)")).alias("last_user"))


def message_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", F.sha2(M.flatten(F.col("messages")), 256).alias("h"))


def char_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum, maximum, mean and median characters of documents by language, and of conversations."""
    docs = read(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("n"))
    chats = _chats(spark, sf_dir).select(F.lit("conversations").alias("lang"), M.characters(F.col("messages")).alias("n"))
    return docs.unionByName(chats).groupBy("lang").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 2).alias("mean"), F.round(F.median("n"), 2).alias("median"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered, distinct conditional tags of a case, counted."""
    tag = lambda when, name: F.when(F.expr(when), name)
    tags = F.array_distinct(F.array_compact(F.array(
        F.lit("target"), tag("evidence_conflict", "evidence_conflict"), tag("order_info_conflict OR user_claim = 'claims_unused_but_used'", "order_info_conflict"),
        tag("order_amount >= 1000", "high_value_order"), tag("refund_count_30d >= 3", "frequent_refund_user"), tag("is_fresh OR is_customized OR is_virtual", "special_goods"),
        tag("logistics_issue", "logistics_issue"), tag("has_quality_issue AND NOT has_evidence", "quality_without_evidence"),
    )))
    rows = facts.order_lines(spark, sf_dir).selectExpr(*facts.refund_lines(Spark))
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents with anything that looks like a secret, and how often."""
    both = read(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text").unionByName(read(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    counted = both.select("origin", "id", *M.secret_counts(F.col("text"), M.SECRETS))
    return counted.where(" OR ".join(f"{name} > 0" for name in M.SECRETS))


def user_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User prompts: a request by template, facts as JSON, an evidence line where there is evidence."""
    request = F.concat(F.lit("order "), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, " arrived broken").when(F.col("o_orderkey") % 3 == 1, " never came").otherwise(" is not wanted"))
    json = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")))
    prompt = M.user_prompt(request, json, F.when(F.col("o_custkey") % 2 == 0, "a photo"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(prompt, 256).alias("h"))


def noisy_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy lines repeated in turn, then put into each row's own order."""
    lines = M.cycled(["alpha rule", "beta rule", "gamma rule"], F.col("c_custkey") % 5)
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(M.shuffled_lines(lines, "noise", F.col("c_custkey")), "; ").alias("noise"))


def factorial_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight conditions of three prompt components for every nation."""
    bits = spark.range(8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("condition"), F.struct(*(((F.col("id").bitwiseAND(F.lit(1 << k))) > 0).alias(n) for k, n in enumerate(("identity", "schema", "rules")))).alias("levels"))
    parts = [("identity", F.concat(F.lit("You serve "), F.col("n_name"))), ("schema", F.lit("Answer in JSON")), ("rules", F.lit("Follow the rules"))]
    rows = read(spark, sf_dir, "nation").crossJoin(F.broadcast(bits))
    return rows.select("n_nationkey", "condition", M.composed(parts, F.col("levels")).alias("prompt"))


def prompt_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id (or the active order's) and exposure read back from prompt text; null or unknown if absent."""
    key = F.col("o_orderkey")
    named = F.when(key % 5 == 0, F.concat(F.lit('{"active_order_id": "C-ACTIVE-'), key, F.lit('"}'))).when(key % 5 == 1, "no id").otherwise(F.concat(F.lit("sample_id: "), key))
    text = F.concat(named, F.when(key % 4 > 0, F.concat(F.lit(" prompt_exposure: "), F.element_at(F.array(F.lit("full"), F.lit("partial"), F.lit("no_skill")), (key % 4).cast("int")))).otherwise(""))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    found = M.prompt_metadata(F.col("t"))
    return rows.select("o_orderkey", found["sample_id"].alias("sample_id"), F.coalesce(found["prompt_exposure"], F.lit("unknown")).alias("exposure"))


def completion_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common prefix and label mask of two token lists made from an order's digits."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", *(F.transform(F.split(F.col(c).cast("string"), ""), lambda x: x.cast("int")).alias(a) for c, a in (("o_orderkey", "full"), ("o_custkey", "prompt"))))
    mask = M.completion_mask(F.col("full"), F.col("prompt"))
    return rows.select("o_orderkey", M.common_prefix(F.col("full"), F.col("prompt")).cast("long").alias("shared"), F.array_join(F.transform(mask, lambda x: x.cast("string")), ",").alias("mask"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a line equal to a line of a benchmark item of at least eight words."""
    lines = lambda df, key: df.select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.regexp_count("line", F.lit(r"[^ ]+")) >= 8)
    left, right = lines(read(spark, sf_dir, "documents"), "doc_id"), lines(read(spark, sf_dir, "benchmark"), "item_id")
    return left.join(right, "line").groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


QUERIES = {f.__name__: f for f in (message_build, message_strip, last_user, message_flatten, char_stats, tag_counts, secret_scan, user_prompts, noisy_prompts, factorial_prompts, prompt_metadata, completion_masks, benchmark_leaks)}

def _counted(name: str, pattern: str, column: str) -> str:
    """SQL for the number of matches. DuckDB has no lookbehind: paths are put between marks first, and
    the marks after the start or anything but a word character are counted."""
    if name == "private_path":
        path = pattern.split("(?<![A-Za-z0-9_])")[1].replace("(?:", "(")
        column, pattern = f"regexp_replace({column}, '(?i){path}', chr(1) || '\\1' || chr(2), 'g')", r"(?:^|[^A-Za-z0-9_])\x01"
    return f"coalesce(len(regexp_extract_all({column}, '{pattern.replace(chr(39), chr(39) * 2)}')), 0) AS {name}"


_secret = " UNION ALL ".join(f"SELECT '{o}' AS origin, {k} AS id, {', '.join(_counted(n, p, c) for n, p in M.SECRETS.items())} FROM {o}" for o, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html")))

ORACLES = {
    "message_build": f"""SELECT doc_id, 2 + (doc_id % 2 = 0)::BIGINT AS n, sha256(CASE WHEN doc_id % 2 = 0 THEN '{SYSTEM}' || chr(10) ELSE '' END || coalesce(text, '') || chr(10) || lang) AS h FROM documents""",
    "message_strip": f"""SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS kept, 1 + count(*) FILTER (WHERE role <> 'system') AS n,
 ({len(SYSTEM)} + coalesce(sum(length(text)) FILTER (WHERE role <> 'system'), 0))::BIGINT AS characters FROM conversations GROUP BY conv_id""",
    "last_user": "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '(none)') AS last_user FROM conversations GROUP BY conv_id",
    "message_flatten": "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id",
    "char_stats": """SELECT lang, min(n) AS low, max(n) AS high, round(avg(n), 2) AS mean, round(median(n), 2) AS median FROM (SELECT lang, length(text) AS n FROM documents
 UNION ALL SELECT 'conversations', sum(length(text))::BIGINT FROM conversations GROUP BY conv_id) GROUP BY lang""",
    "tag_counts": f"""SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter(['target', CASE WHEN evidence_conflict THEN 'evidence_conflict' END, CASE WHEN order_info_conflict OR user_claim = 'claims_unused_but_used' THEN 'order_info_conflict' END,
 CASE WHEN order_amount >= 1000 THEN 'high_value_order' END, CASE WHEN refund_count_30d >= 3 THEN 'frequent_refund_user' END, CASE WHEN is_fresh OR is_customized OR is_virtual THEN 'special_goods' END,
 CASE WHEN logistics_issue THEN 'logistics_issue' END, CASE WHEN has_quality_issue AND NOT has_evidence THEN 'quality_without_evidence' END], lambda x: x IS NOT NULL)) AS tag
 FROM (SELECT {', '.join(facts.refund_lines(Duck))} FROM {LINES_SQL})) GROUP BY tag""",
    "secret_scan": f"SELECT * FROM ({_secret}) WHERE {' OR '.join(f'{n} > 0' for n in M.SECRETS)}",
    "user_prompts": """SELECT o_orderkey, sha256('order ' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN ' arrived broken' WHEN 1 THEN ' never came' ELSE ' is not wanted' END || chr(10)
 || 'facts: {"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}' || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || 'evidence: a photo' ELSE '' END) AS h FROM orders""",
    "noisy_prompts": """SELECT c_custkey, coalesce((SELECT string_agg(x, '; ' ORDER BY sha256('noise|' || c_custkey || '|' || x)) FROM (SELECT unnest(list_transform(range(0, c_custkey % 5), lambda i: (['alpha rule', 'beta rule', 'gamma rule'])[i % 3 + 1])) AS x)), '') AS noise FROM customer""",
    "factorial_prompts": """SELECT n_nationkey, 'c' || k AS condition, array_to_string(list_filter([CASE WHEN k & 1 > 0 THEN 'You serve ' || n_name END, CASE WHEN k & 2 > 0 THEN 'Answer in JSON' END, CASE WHEN k & 4 > 0 THEN 'Follow the rules' END], lambda x: x IS NOT NULL), chr(10)) AS prompt
 FROM nation CROSS JOIN (SELECT unnest(range(0, 8)) AS k)""",
    "prompt_metadata": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 1 THEN o_orderkey::VARCHAR END AS sample_id, CASE o_orderkey % 4 WHEN 1 THEN 'full' WHEN 2 THEN 'partial' WHEN 3 THEN 'no_skill' ELSE 'unknown' END AS exposure FROM orders",
    "completion_masks": """WITH t AS (SELECT o_orderkey, o_orderkey::VARCHAR AS a, o_custkey::VARCHAR AS b, list_max(list_filter(range(0, least(length(o_orderkey::VARCHAR), length(o_custkey::VARCHAR)) + 1), lambda k: left(o_orderkey::VARCHAR, k) = left(o_custkey::VARCHAR, k))) AS n FROM orders)
 SELECT o_orderkey, n AS shared, array_to_string(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN i <= n THEN '-100' ELSE a[i:i] END), ',') AS mask FROM t""",
    "benchmark_leaks": """WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)
 SELECT item_id, count(DISTINCT doc_id) AS documents FROM d JOIN b USING (line) WHERE len(regexp_extract_all(line, '[^ ]+')) >= 8 GROUP BY item_id""",
}
