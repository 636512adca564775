import pytest
from pyspark.sql import functions as F

from casewright.functions import messages
from casewright.operators import builders, context, layout, registries


def test_long_context(spark):
    samples = builders.generate_samples(spark, 30, 3)
    doubled = samples.unionByName(samples.withColumn("position", F.col("position") + 100).withColumn("order_amount", F.lit(1)))
    found = context.long_context_eval(doubled, 10, 5, 7)
    rows = found.collect()
    assert len(rows) == 40 and len({r["sample_id"] for r in rows}) == 10 and {r["order_amount"] for r in rows} != {1}
    for r in rows:
        user = r["messages"][-1]["content"]
        assert r["active_order_id"] == f"C-ACTIVE-{r['sample_id']}" and r["active_order_id"] in user
        assert sum(line in context.NOISE for line in user.split("\n")) == 7
        assert r["hard_tags"] == ["long_context_stage_c", "strong_backend_contract"] and len(r["messages"]) == 2 - (r["prompt_exposure"] == "no_skill")
    again = context.long_context_eval(doubled.repartition(3), 10, 5, 7)
    assert {(r["sample_id"], r["prompt_exposure"], r["messages"][-1]["content"]) for r in again.collect()} == {(r["sample_id"], r["prompt_exposure"], r["messages"][-1]["content"]) for r in rows}
    assert context.summary(found).first()["prompts"] == 40
    got = found.select(messages.prompt_metadata(messages.flatten(F.col("messages")))["sample_id"].alias("s"), "sample_id").where("s <> sample_id")
    assert got.isEmpty()


def test_registries(spark):
    skills = {"refund": registries.Skill(["check facts", "deny"], ["facts", "denial"], ["a", "b"]), "expense": registries.Skill(["pay"], ["payment"], ["c"])}
    rows = registries.registry(spark, skills, "v1")
    assert rows.where("kind = 'prompt'").count() == 14 and rows.where("kind = 'target'").count() == 3 and rows.select("registry_sha256").distinct().count() == 1
    assert registries.changed(rows, skills, "v1").isEmpty()
    assert registries.text_id("\n a \u0065\u0301 \n\n") == registries.text_id(" a \u00e9")
    spoiled = rows.withColumn("text_sha256", F.when(F.col("entry_id") == "a", "x").otherwise(F.col("text_sha256"))).where("entry_id <> 'c'").unionByName(rows.limit(1).withColumn("entry_id", F.lit("more")))
    assert sorted(r["problem"] for r in registries.changed(spoiled, skills, "v1").collect()) == ["changed", "missing", "unknown"]


def test_ablations(spark):
    found = builders.ablation_eval(builders.generate_samples(spark, 2, 1)).where("mutation_type = 'none' AND prompt_exposure = 'full'")
    system = {r["ablation_type"]: r["messages"][0]["content"] if r["messages"][0]["role"] == "system" else None for r in found.collect()}
    assert set(system) == {"original", *builders.ABLATIONS} and system["no_skill_current_order_only"] is None
    part = builders.PARTS
    assert part["rules"] not in system["rule_deleted_full"] and part["examples"] in system["rule_deleted_full"]
    assert part["schema"] not in system["schema_deleted_full"] and part["examples"] not in system["examples_deleted_full"]
    assert system["schema_only_full"] == part["task"] + "\n\n" + part["schema"] and system["rules_only_full"].endswith(builders.SHORT_RULES)


def test_spans_and_token_hashes(spark):
    df = spark.createDataFrame([(2, 5, 1, 9), (2, 2, 1, 9), (0, 5, 1, 9), (2, 10, 1, 9), (None, 5, 1, 9)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(messages.span_inside(*map(F.col, "abcd"))).collect()] == [True, False, False, False, False]
    tokens = spark.createDataFrame([([1, 2],), ([12],)], "t array<int>").select(layout.token_hash(F.col("t"))).collect()
    assert tokens[0][0] != tokens[1][0] and tokens[0][0] == pytest.importorskip("hashlib").sha256(b"[1,2]").hexdigest()


def test_registered_texts_and_key_subsets(spark):
    skills = {"refund": registries.Skill(["check facts"], ["facts"], ["a"])}
    stored = registries.registry(spark, skills, "v1")
    rows = spark.createDataFrame([(1, "refund", "minimal"), (2, "refund", "full")], "id int, skill_id string, exposure string")
    texts = {r["id"]: r["system"] for r in registries.with_entries(rows, stored, "prompt", "skill_id", "exposure", "system").collect()}
    assert texts == {1: registries.prompts_of("refund", skills["refund"])["minimal"], 2: registries.prompts_of("refund", skills["refund"])["full"]}
    for strange in ((3, "refund", "other"), (4, None, "full")):
        more = rows.union(spark.createDataFrame([strange], rows.schema))
        with pytest.raises(Exception, match="no prompt for"):
            registries.with_entries(more, stored, "prompt", "skill_id", "exposure", "system").collect()
    facts = spark.createDataFrame([({"b": "1", "x": "2", "a": None},), ({},), (None,)], "m map<string,string>")
    got = [r[0] for r in facts.select(F.to_json(context.key_subset(F.col("m"), ["a", "b", "c"]), {"ignoreNullFields": "false"})).collect()]
    assert got == ['{"a":null,"b":"1"}', "{}", None]
