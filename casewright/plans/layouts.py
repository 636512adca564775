"""Queries about expansion, order, quotas, samples and hashes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import layout
from casewright.plans.facts import EXPOSURES, Duck, read

SEGMENTS = ["stage1", "stage2", "stage3"]
#: Exposure quotas of a segment in per cent.
SEGMENT_SHARES = {"stage1": [("full", 85), ("partial", 15)], "stage2": [("full", 20), ("partial", 55), ("minimal", 25)], "stage3": [("partial", 20), ("minimal", 45), ("no_skill", 35)]}


def exposure_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.broadcast(spark.createDataFrame([(e,) for e in EXPOSURES], "prompt_exposure string"))
    return read(spark, sf_dir, "orders").select("o_orderstatus").crossJoin(dim).groupBy("o_orderstatus", "prompt_exposure").agg(F.count("*").alias("n"))


def ablation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional cross join: ablations other than the original only under full exposure."""
    kinds = ["original", "rule_deleted_full", "schema_deleted_full", "shuffled_rules"]
    exposures = F.broadcast(spark.createDataFrame([(e,) for e in EXPOSURES], "prompt_exposure string"))
    ablations = F.broadcast(spark.createDataFrame([(k,) for k in kinds], "ablation_type string"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey").crossJoin(exposures).crossJoin(ablations).where("ablation_type = 'original' OR prompt_exposure = 'full'")
    return rows.withColumn("record_id", layout.hash_key(F.col("o_orderkey"), F.col("ablation_type"), F.col("prompt_exposure"))).select("o_orderkey", "ablation_type", "prompt_exposure", "record_id")


def hash_rank_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training arms: per segment a hash order gives exposures by quota, and two orders of the same
    records result: staged (segment by segment) and mixed (one hash order over all)."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("segment"))
    counts = rows.groupBy("segment").agg(F.count("*").alias("size"))
    placed = layout.hash_ranked(rows, "exposure", "id", "place", ["segment"]).join(F.broadcast(counts), "segment")
    chain = None
    for segment, shares in SEGMENT_SHARES.items():
        upto, pick = 0, None
        for value, share in shares:
            upto += share
            rule = F.col("place") * 100 <= F.col("size") * upto
            pick = F.when(rule, value) if pick is None else pick.when(rule, value)
        chain = F.when(F.col("segment") == segment, pick) if chain is None else chain.when(F.col("segment") == segment, pick)
    named = placed.withColumn("prompt_exposure", chain)
    named = named.withColumn("record_id", layout.hash_key("v1", F.col("id"), F.col("segment"), F.col("prompt_exposure")))
    staged = layout.hash_ranked(named, "within", "record_id", "staged_position", ["segment"])
    return layout.hash_ranked(staged, "mix", "record_id", "mixed_position", counted=named).select("id", "segment", "prompt_exposure", "staged_position", "mixed_position")


PHASES = [(0.3, [("full", 0.8), ("partial", 0.2)]), (0.7, [("full", 0.2), ("partial", 0.5), ("minimal", 0.3)]), (1.1, [("partial", 0.2), ("minimal", 0.4), ("no_skill", 0.4)])]


def phase_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey")
    n = rows.count()
    placed = layout.hash_ranked(rows, "phase", "o_orderkey")
    fraction = (F.col("position") - 1) / F.lit(float(max(1, n)))
    return placed.select("o_orderkey", "position", layout.phase_exposure(fraction, layout.unit("draw", F.col("o_orderkey")), PHASES).alias("prompt_exposure"))


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every distinct text the document of the lowest id."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_hash"))
    return layout.first_wins(rows, "text_hash", "doc_id")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return layout.last_wins(rows, "user_id", "event_id")


def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose count differs from what is expected; missing and unexpected groups too."""
    expected = spark.createDataFrame([(s, p, n) for s in ("F", "O", "P", "X") for p, n in (("1-URGENT", 1000), ("5-LOW", 900))], "o_orderstatus string, o_orderpriority string, expected bigint")
    found = read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    both = found.join(F.broadcast(expected), ["o_orderstatus", "o_orderpriority"], "full")
    return both.select("o_orderstatus", "o_orderpriority", F.coalesce("n", F.lit(0)).alias("n"), "expected").where("NOT n <=> expected")


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two splits of the documents share, for every pair of splits."""
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("split"), (F.col("doc_id") % 3).cast("string")).alias("split"), F.sha2("text", 256).alias("h")).distinct()
    pairs = rows.alias("l").join(rows.alias("r"), F.expr("l.h = r.h AND l.split < r.split"))
    return pairs.groupBy(F.col("l.split").alias("left_split"), F.col("r.split").alias("right_split")).agg(F.count("*").alias("shared"))


def sample_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling operator: a hundred documents, first in hash order."""
    return layout.sample_exactly(read(spark, sf_dir, "documents").select("doc_id", "lang"), "sample", "doc_id", 100)


def sample_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two and a half times as many rows as there are benchmark items: everyone twice, half a third time."""
    rows = read(spark, sf_dir, "benchmark").select("item_id")
    n = rows.count()
    return layout.sample_with_repeats(rows, "repeat", "item_id", n, n * 5 // 2).groupBy("item_id").agg(F.count("*").alias("copies"))


def multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.multiset_hash(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey")


def ordered_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.hash_ranked(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "order", "o_orderkey", "place", ["o_orderpriority"])
    return layout.ordered_hash(placed, ["o_orderpriority"], "o_orderkey", "place", rows=1000)


def template_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash of a record: SHA-256 of its JSON with sorted keys."""
    fields = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("shipped")), {"ignoreNullFields": "false"})
    return read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(fields, 256).alias("facts_hash"), F.sha2(F.concat(F.lit("orders|"), fields), 256).alias("semantic_hash"))


def pairing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.broadcast(spark.createDataFrame([(c, e) for c in ("full", "no_skill") for e in ("random_mix_order", "staged_order")], "prompt_condition string, endpoint string"))
    rows = read(spark, sf_dir, "orders").crossJoin(dim)
    key = F.concat_ws("|", "o_orderstatus", F.sha2(F.col("o_orderkey").cast("string"), 256), "prompt_condition", "endpoint")
    return rows.select("o_orderkey", "prompt_condition", "endpoint", key.alias("pairing_key"))


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items zipped with a vector of exposures in equal shares, both in hash order."""
    items = layout.hash_ranked(read(spark, sf_dir, "benchmark").select("item_id"), "left", "item_id")
    n = items.count()
    counts = layout.largest_remainder(n, {"full": 1, "partial": 1, "minimal": 1, "no_skill": 1})
    vector = spark.range(1, n + 1).select(F.col("id").alias("slot"), layout.quota_value(F.col("id"), list(counts.items())).alias("prompt_exposure"))
    return layout.zipped(items, layout.hash_ranked(vector, "right", "slot").drop("slot")).select("item_id", "position", "prompt_exposure")


def cyclic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes dealt in turn over the customers of a nation."""
    codes = F.array(*map(F.lit, ["alpha", "beta", "gamma"]))
    rows = layout.key_ranked(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", by=["c_nationkey"])
    return rows.select("c_custkey", F.element_at(codes, ((F.col("position") - 1) % 3 + 1).cast("int")).alias("code"))


def exposure_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of phase exposures."""
    return phase_exposure(spark, sf_dir).groupBy("prompt_exposure").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (exposure_cross_join, ablation_expand, hash_rank_arms, phase_exposure, first_wins, last_wins, quota_check, split_overlap, sample_topk, sample_repeats, multiset_hash, ordered_hash, template_hash, pairing_keys, positional_join, cyclic_assignment, exposure_distribution)}

_segment = Duck.pick(SEGMENTS, "o_orderkey % 3")
_unit = "('0x' || substr(sha256('draw|' || o_orderkey), 1, 13))::BIGINT / pow(16, 13)"
_phase = f"""SELECT o_orderkey, position, CASE WHEN (position - 1) / n < 0.3 THEN CASE WHEN u < 0.8 THEN 'full' ELSE 'partial' END
 WHEN (position - 1) / n < 0.7 THEN CASE WHEN u < 0.2 THEN 'full' WHEN u < 0.7 THEN 'partial' ELSE 'minimal' END
 ELSE CASE WHEN u < 0.2 THEN 'partial' WHEN u < 0.6 THEN 'minimal' ELSE 'no_skill' END END AS prompt_exposure
 FROM (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('phase|' || o_orderkey), o_orderkey) AS position, count(*) OVER ()::DOUBLE AS n, {_unit} AS u FROM orders)"""

_blocks = """SELECT o_orderpriority, sha256(string_agg(x, '' ORDER BY b)) AS h FROM (SELECT o_orderpriority, {block} AS b, sha256('["' || string_agg(o_orderkey::VARCHAR, '","' ORDER BY {place}) || '"]') AS x FROM {rows} GROUP BY ALL) GROUP BY 1"""

ORACLES = {
    "exposure_cross_join": "SELECT o_orderstatus, prompt_exposure, count(*) AS n FROM orders CROSS JOIN (VALUES ('full'), ('partial'), ('minimal'), ('no_skill')) v(prompt_exposure) GROUP BY ALL",
    "ablation_expand": """SELECT o_orderkey, ablation_type, prompt_exposure, sha256(o_orderkey || '|' || ablation_type || '|' || prompt_exposure) AS record_id FROM orders
 CROSS JOIN (VALUES ('original', 'full'), ('original', 'partial'), ('original', 'minimal'), ('original', 'no_skill'), ('rule_deleted_full', 'full'), ('schema_deleted_full', 'full'), ('shuffled_rules', 'full')) v(ablation_type, prompt_exposure)""",
    "hash_rank_arms": f"""SELECT id, segment, prompt_exposure, row_number() OVER (PARTITION BY segment ORDER BY sha256('within|' || r), r) AS staged_position, row_number() OVER (ORDER BY sha256('mix|' || r), r) AS mixed_position
 FROM (SELECT *, sha256('v1|' || id || '|' || segment || '|' || prompt_exposure) AS r FROM (SELECT id, segment,
  CASE segment WHEN 'stage1' THEN CASE WHEN p * 100 <= n * 85 THEN 'full' ELSE 'partial' END
   WHEN 'stage2' THEN CASE WHEN p * 100 <= n * 20 THEN 'full' WHEN p * 100 <= n * 75 THEN 'partial' ELSE 'minimal' END
   ELSE CASE WHEN p * 100 <= n * 20 THEN 'partial' WHEN p * 100 <= n * 65 THEN 'minimal' ELSE 'no_skill' END END AS prompt_exposure
  FROM (SELECT id, segment, row_number() OVER (PARTITION BY segment ORDER BY sha256('exposure|' || id), id) AS p, count(*) OVER (PARTITION BY segment) AS n FROM (SELECT o_orderkey AS id, {_segment} AS segment FROM orders))))""",
    "phase_exposure": _phase,
    "exposure_distribution": f"SELECT prompt_exposure, count(*) AS n FROM ({_phase}) GROUP BY 1",
    "first_wins": "SELECT doc_id, source, h AS text_hash FROM (SELECT doc_id, source, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
    "last_wins": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "quota_check": """SELECT o_orderstatus, o_orderpriority, coalesce(n, 0) AS n, expected FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
 FULL JOIN (SELECT s AS o_orderstatus, p AS o_orderpriority, e::BIGINT AS expected FROM (VALUES ('F'), ('O'), ('P'), ('X')) a(s) CROSS JOIN (VALUES ('1-URGENT', 1000), ('5-LOW', 900)) b(p, e)) USING (o_orderstatus, o_orderpriority)
 WHERE coalesce(n, 0) IS DISTINCT FROM expected""",
    "split_overlap": """WITH t AS (SELECT DISTINCT 'split' || (doc_id % 3) AS s, text FROM documents)
 SELECT a.s AS left_split, b.s AS right_split, count(*) AS shared FROM t a JOIN t b ON a.text = b.text AND a.s < b.s GROUP BY ALL""",
    "sample_topk": "SELECT doc_id, lang FROM documents ORDER BY sha256('sample|' || doc_id), doc_id LIMIT 100",
    "sample_repeats": """SELECT item_id, 2 + (k <= (n * 5 // 2) % n)::INT::BIGINT AS copies FROM (SELECT item_id, row_number() OVER (ORDER BY sha256('repeat|' || item_id), item_id) AS k, count(*) OVER () AS n FROM benchmark)""",
    "multiset_hash": _blocks.format(block="substr(sha256(o_orderkey::VARCHAR), 1, 3)", place="sha256(o_orderkey::VARCHAR)", rows="orders"),
    "ordered_hash": _blocks.format(block="(place - 1) // 1000", place="place", rows="(SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('order|' || o_orderkey), o_orderkey) AS place FROM orders)"),
    "template_hash": """SELECT o_orderkey, sha256(j) AS facts_hash, sha256('orders|' || j) AS semantic_hash FROM (SELECT o_orderkey,
 '{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"priority":"' || o_orderpriority || '","shipped":' || (o_orderstatus = 'F')::VARCHAR || '}' AS j FROM orders)""",
    "pairing_keys": """SELECT o_orderkey, prompt_condition, endpoint, o_orderstatus || '|' || sha256(o_orderkey::VARCHAR) || '|' || prompt_condition || '|' || endpoint AS pairing_key
 FROM orders CROSS JOIN (VALUES ('full'), ('no_skill')) c(prompt_condition) CROSS JOIN (VALUES ('random_mix_order'), ('staged_order')) e(endpoint)""",
    "positional_join": """SELECT item_id, l.position, CASE WHEN slot <= n / 4 THEN 'full' WHEN slot <= n / 2 THEN 'partial' WHEN slot <= 3 * n / 4 THEN 'minimal' ELSE 'no_skill' END AS prompt_exposure
 FROM (SELECT item_id, row_number() OVER (ORDER BY sha256('left|' || item_id), item_id) AS position, count(*) OVER () AS n FROM benchmark) l
 JOIN (SELECT slot, row_number() OVER (ORDER BY sha256('right|' || slot), slot) AS position FROM (SELECT unnest(range(1, (SELECT count(*) FROM benchmark) + 1)) AS slot)) r USING (position)""",
    "cyclic_assignment": "SELECT c_custkey, (['alpha', 'beta', 'gamma'])[(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 3 + 1] AS code FROM customer",
}
