"""URL filters with dated lists: a temporal join of captures with list entries. SQL functions only.

A list is a history of entries (pattern, category, action, effective_at) with actions add and
remove. Entries of a pattern and category become validity intervals: from each add to the next
entry. A capture is matched by the intervals of its own keys (every suffix of its host with two
labels or more, and its host with the first path segment) that hold its fetch time: what was in
force as of the fetch. Intervals are cut into bins of BIN_DAYS within the span of the captures
and meet them on (pattern, bin), so a pattern with a long history or a host with many captures
spreads over bins, and only equal keys are compared.

Defined results: captures without host or time match nothing; of entries at the same instant a
remove counts; repeated captures are evaluated once and answered each; repeated entries change
nothing; entries with a null in pattern, action or time are ignored, a null category is the empty
one; empty lists block nothing; further columns of captures stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.shared import fresh, table

BIN_DAYS = 30
DAY = 86_400
#: Host (behind user and password, before the port; addresses in brackets whole), and the first path
#: segment, of a URL with a scheme.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host(url: Column) -> Column:
    """Lower-cased host without the dot that may close it."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def segment(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SEGMENT, 1), F.lit(""))


def keys(host_name: str, segment_name: str) -> Column:
    """Every pattern that can match a host and first path segment."""
    labels = f"split({host_name}, '[.]')"
    suffixes = f"if(size({labels}) < 2, array({host_name}), transform(sequence(1, size({labels}) - 1), i -> array_join(slice({labels}, i, size({labels})), '.')))"
    path = f"if({segment_name} = '', cast(array() as array<string>), array(concat({host_name}, '/', {segment_name})))"
    return F.expr(f"array_distinct(concat({suffixes}, {path}))")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) in seconds; valid_to is null while in force."""
    rows = entries.where("pattern IS NOT NULL AND action IS NOT NULL AND effective_at IS NOT NULL")
    rows = rows.select("pattern", F.coalesce("category", F.lit("")).alias("category"), "action", "effective_at").distinct()
    history = Window.partitionBy("pattern", "category").orderBy("effective_at", "action")
    dated = rows.withColumn("valid_to", F.lead("effective_at").over(history))
    return dated.where("action = 'add'").select("pattern", "category", F.col("effective_at").alias("valid_from"), "valid_to").where("valid_to IS NULL OR valid_to > valid_from")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetched_at") -> DataFrame:
    """captures with url_host, n_active, categories and blocked; times are seconds since 1970."""
    new = ["url_host", "n_active", "categories", "blocked"]
    captures = captures.drop(*new)
    (part,) = fresh(captures, "url_segment")
    rows = captures.withColumn("url_host", host(F.col(url))).withColumn(part, segment(F.col(url)))
    asked = rows.where(F.col("url_host").isNotNull() & F.col(time).isNotNull()).select(F.col("url_host").alias("h"), F.col(part).alias("s"), F.col(time).alias("at")).distinct()
    width = BIN_DAYS * DAY
    span = asked.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    first, last = (0, -1) if span["first"] is None else (span["first"], span["last"])
    listed = intervals(entries).where((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
    low = F.floor(F.greatest("valid_from", F.lit(first)) / width)
    high = F.floor(F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last)) / width)
    binned = listed.withColumn("bin", F.explode(F.sequence(low, high)))
    probes = asked.select("*", F.explode(keys("h", "s")).alias("pattern"), F.floor(F.col("at") / width).alias("bin"))
    hits = probes.join(binned, ["pattern", "bin"]).where("at >= valid_from AND (valid_to IS NULL OR at < valid_to)")
    answers = hits.groupBy("h", "s", "at").agg(F.count_distinct("pattern", "category").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), "|").alias("c"))
    answer = F.struct("n", "c")
    names = fresh(rows, "asked_host", "asked_part", "asked_at", "answer")
    answers = answers.select("h", "s", "at", answer.alias("answer")).toDF(*names)
    met = (rows["url_host"] == answers[names[0]]) & (rows[part] == answers[names[1]]) & (rows[time] == answers[names[2]])
    out = rows.join(answers, met, "left")
    found = F.col(names[3])
    n = F.coalesce(found["n"], F.lit(0)).cast("long")
    return out.select(*captures.columns, "url_host", n.alias("n_active"), F.coalesce(found["c"], F.lit("")).alias("categories"), (n > 0).alias("blocked"))


def _number(text: str) -> str:
    return f"cast(conv(substr(sha2({text}, 256), 1, 8), 16, 10) as bigint)"


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the tables hold no fetch time, so the page's number gives one within 2024."""
    minutes = _number("concat('fetch|', coalesce(cast(page_id as string), ''))")
    return pages.select("page_id", "url", F.expr(f"1704067200 + 60 * ({minutes} % 525600)").alias("fetched_at"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own sites and site sections: of every third pattern an add, and of
    most of those a remove and a second add later."""
    seen = pages.select(host(F.col("url")).alias("h"), segment(F.col("url")).alias("s")).where("h IS NOT NULL")
    site = "array_join(slice(split(h, '[.]'), greatest(1, size(split(h, '[.]')) - 2), 3), '.')"
    both = seen.selectExpr(f"explode(array({site}, if(s = '', NULL, concat(h, '/', s)))) pattern").where("pattern IS NOT NULL").distinct()
    listed = both.withColumn("k", F.expr(_number("concat('list|', pattern)"))).where("k % 3 = 0")
    day = "1704067200 + 86400 * "
    steps = (
        f"array(named_struct('action', 'add', 'effective_at', {day}((k div 3) % 300)),"
        f" named_struct('action', if(k % 5 = 0, NULL, 'remove'), 'effective_at', {day}((k div 3) % 300 + 20 + (k div 7) % 60)),"
        f" named_struct('action', if(k % 5 < 3, NULL, 'add'), 'effective_at', {day}((k div 3) % 300 + 100 + (k div 11) % 90)))"
    )
    category = "element_at(array('ads', 'malware', 'phishing', 'spam'), cast((k div 13) % 4 as int) + 1)"
    return listed.selectExpr("pattern", f"{category} category", f"inline({steps})").where("action IS NOT NULL")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(page_captures(pages), page_list(pages)).select("page_id", "url_host", "fetched_at", "n_active", "categories", "blocked")


#: SQL that takes hosts apart with string functions, not with the patterns above.
ORACLE = r"""
WITH parts AS (
  SELECT page_id, nullif(rtrim(lower(CASE WHEN a[1] = '[' THEN split_part(a, ']', 1) || ']' ELSE split_part(a, ':', 1) END), '.'), '') AS h,
    CASE WHEN sch AND a <> '' THEN split_part(split_part(split_part(substr(rest, length(auth) + 2), '/', 1), '?', 1), '#', 1) ELSE '' END AS s,
    1704067200 + 60 * (('0x' || substr(sha256('fetch|' || coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT % 525600) AS t
  FROM (SELECT *, CASE WHEN sch THEN string_split(auth, '@')[-1] ELSE '' END AS a FROM (
    SELECT *, split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1) AS auth FROM (
      SELECT page_id, substr(url, strpos(url, '://') + 3) AS rest, regexp_full_match(split_part(url, '://', 1), '[A-Za-z][A-Za-z0-9+.-]*') AND strpos(url, '://') > 0 AS sch FROM pages)))),
patterns AS (
  SELECT DISTINCT pattern FROM (
    SELECT array_to_string(string_split(h, '.')[greatest(1, len(string_split(h, '.')) - 2):], '.') AS pattern FROM parts WHERE h IS NOT NULL
    UNION ALL SELECT h || '/' || s FROM parts WHERE h IS NOT NULL AND s <> '')),
listed AS (
  SELECT pattern, k, ['ads', 'malware', 'phishing', 'spam'][(k // 13) % 4 + 1] AS category, 1704067200 + 86400 * ((k // 3) % 300) AS d
  FROM (SELECT pattern, ('0x' || substr(sha256('list|' || pattern), 1, 8))::BIGINT AS k FROM patterns) WHERE k % 3 = 0),
entries AS (
  SELECT pattern, category, 'add' AS action, d AS t FROM listed
  UNION ALL SELECT pattern, category, 'remove', d + 86400 * (20 + (k // 7) % 60) FROM listed WHERE k % 5 <> 0
  UNION ALL SELECT pattern, category, 'add', d + 86400 * (100 + (k // 11) % 90) FROM listed WHERE k % 5 >= 3),
probes AS (
  SELECT page_id, t, unnest(list_distinct(list_concat(
    CASE WHEN len(string_split(h, '.')) < 2 THEN [h]
      ELSE list_transform(range(1, len(string_split(h, '.'))), lambda i: array_to_string(string_split(h, '.')[i:], '.')) END,
    CASE WHEN s = '' THEN [] ELSE [h || '/' || s] END))) AS pattern
  FROM parts WHERE h IS NOT NULL),
latest AS (
  SELECT p.page_id, p.t, e.pattern, e.category, arg_max(e.action, e.t) AS action
  FROM probes p JOIN entries e ON e.pattern = p.pattern AND e.t <= p.t GROUP BY ALL),
active AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, '|' ORDER BY category) AS c FROM latest WHERE action = 'add' GROUP BY page_id)
SELECT parts.page_id, h AS url_host, parts.t AS fetched_at, coalesce(n, 0)::BIGINT AS n_active, coalesce(c, '') AS categories, coalesce(n, 0) > 0 AS blocked
FROM parts LEFT JOIN active USING (page_id)
"""
