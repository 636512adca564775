import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.functions import messages as M
from casewright.operators import builders, layout


@given(st.integers(4, 500), st.lists(st.integers(1, 20), min_size=1, max_size=4))
@settings(max_examples=50, deadline=None)
def test_largest_remainder(total, weights):
    counts = layout.largest_remainder(total, {str(i): w for i, w in enumerate(weights)})
    assert sum(counts.values()) == total and min(counts.values()) >= 1


def test_hash_rank_is_a_permutation(spark):
    df = layout.hash_ranked(spark.range(500), "s", "id")
    assert sorted(r["position"] for r in df.collect()) == list(range(1, 501))
    again = layout.hash_ranked(spark.range(500).repartition(7), "s", "id")
    assert builders.same_multiset(df, again)


def test_ranks_within_and_by_key(spark):
    df = spark.createDataFrame([(k % 3 or None, k * 7 % 101, k) for k in range(90)], "g int, k long, _r int")
    for got in (layout.hash_ranked(df, "s", "k", by=["g"]), layout.key_ranked(df, "k", by=["g"], width=10)):
        rows = got.collect()
        assert got.columns == ["g", "k", "_r", "position"] and len(rows) == 90
        for g in (None, 1, 2):
            assert sorted(r["position"] for r in rows if r["g"] == g) == list(range(1, 31))
    own = sorted((r for r in rows if r["g"] == 1), key=lambda r: r["k"])
    assert [r["position"] for r in own] == list(range(1, 31))
    assert layout.hash_ranked(df.where("false"), "s", "k").isEmpty()


def test_replay_repeats_only_what_is_rare(spark):
    pool = spark.range(40).select(F.col("id").alias("sample_id"), (F.col("id") < 2).alias("hard"))
    rows = builders.replay_layout(pool, 20, 1).collect()
    for k in range(3):
        stage = [r for r in rows if r["stage"] == f"stage{k + 1}"]
        assert sorted(r["position"] for r in stage) == list(range(20 * k + 1, 20 * k + 21))
        assert sorted(r["copy"] for r in stage if r["hard"]) == [1, 1, 2, 2] and {r["copy"] for r in stage if not r["hard"]} == {1}
    with pytest.raises(ValueError, match="to draw from"):
        builders.replay_layout(pool.where("hard"), 20, 1)


def test_wins_and_samples(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "x"), ("b", 2, "y")], "k string, p int, v string")
    assert {r["v"] for r in layout.first_wins(df, "k", "p").collect()} == {"x", "y"}
    assert {r["v"] for r in layout.last_wins(df, "k", "p").collect()} == {"z", "y"}
    many = layout.sample_with_repeats(spark.range(10), "s", "id", 10, 25).groupBy("id").count().collect()
    assert sum(r["count"] for r in many) == 25 and {r["count"] for r in many} == {2, 3}
    few = layout.sample_with_repeats(spark.range(10), "s", "id", 10, 4).collect()
    assert len({r["id"] for r in few}) == 4 == len(few) and {r["copy"] for r in few} == {1}


def test_zip_wants_equal_lengths(spark):
    a, b = (spark.range(1, n).select(F.col("id").alias("position"), F.col("id").alias(c)) for n, c in ((4, "x"), (3, "y")))
    with pytest.raises(Exception, match="differ in length"):
        layout.zipped(a, b).collect()


@pytest.mark.parametrize("method,counts", [("full_only", [24]), ("random_mix", [6, 6, 6, 6]), ("naive_staged", [6, 6, 6, 6])])
def test_exposure_mix(spark, method, counts):
    samples = builders.generate_samples(spark, 24, 7)
    rows = builders.exposure_mix(samples, method, 24, 7).orderBy("position").collect()
    seen = [r["prompt_exposure"] for r in rows]
    assert sorted(seen.count(e) for e in set(seen)) == counts
    if method == "naive_staged":
        assert set(seen[:8]) == {"full", "partial"} and set(seen[8:16]) == {"partial", "minimal"} and set(seen[16:]) == {"minimal", "no_skill"}
    assert all((r["messages"][0]["role"] == "system") == (r["prompt_exposure"] != "no_skill") for r in rows)
    with pytest.raises(ValueError):
        builders.exposure_mix(samples, "random_mix", 25, 7)


def test_export_sets(spark):
    sets = builders.export_sets(builders.generate_samples(spark, 120, 11), 11)
    assert sets["eval_prompts"].count() == 480 and sets["no_skill_sft"].where("messages[0].role = 'system'").isEmpty()
    annealed = sets["annealed_sft"]
    early, late = (annealed.where(c).where("prompt_exposure = 'full'").count() for c in ("position <= 40", "position > 80"))
    assert early > late and annealed.where("prompt_exposure = 'no_skill'").isEmpty()
    assert builders.trainer_export(annealed).columns == ["position", "messages"]


def test_causal_replay_targeted_ablation(spark):
    samples = builders.generate_samples(spark, 24, 3)
    two = builders.causal_variants(samples, 24, 3)
    count = lambda d: {r[0]: r[1] for r in d.groupBy("prompt_exposure").count().collect()}
    assert count(two["uniform_staged"]) == count(two["uniform_shuffled"]) == {e: 6 for e in builders.EXPOSURES}
    stages = builders.replay_stages(samples, 20, 3)
    assert stages.count() == 60 and stages.groupBy("stage").count().where("count <> 20").isEmpty()
    targeted = builders.targeted_samples(spark, 40, 3)
    assert targeted.where("category = 'conflict' AND decision <> 'manual_review'").isEmpty()
    assert builders.ablation_eval(samples).count() == 24 * 40


def test_bundle(spark):
    cases = None
    for skill in ("refund", "warranty", "expense"):
        part = builders.skill_cases(spark, skill)
        cases = part if cases is None else cases.unionByName(part)
    cases = cases.cache()
    arms, requests = builders.training_arms(cases).cache(), builders.eval_requests(cases)
    assert requests.count() == 3072 and builders.factorial_requests(cases).count() == 3 * 1152
    assert {r[0]: r[1] for r in arms.where("skill_id = 'refund'").groupBy("prompt_exposure").count().collect()} == {"full": 630, "partial": 540, "minimal": 420, "no_skill": 210}
    assert arms.where("staged_position <> mixed_position").count() > 5000
    assert builders.bundle_errors(cases, arms, requests).isEmpty()
    assert not builders.bundle_errors(cases, arms.where("staged_position > 1"), requests).isEmpty()


def test_messages(spark):
    df = spark.createDataFrame([("", "q", None), ("s", "q", "a")], "s string, u string, a string")
    built = M.build(F.col("s"), F.col("u"), F.col("a"))
    rows = df.select(built.alias("m"), M.with_system(built, F.lit("new")).alias("w"), M.last_of(built).alias("l"), M.characters(built).alias("c")).collect()
    assert [[m["role"] for m in r["m"]] for r in rows] == [["user"], ["system", "user", "assistant"]]
    assert rows[0]["w"][0]["content"] == "new" and rows[0]["l"] == "q" and rows[1]["c"] == 3
    masks = spark.createDataFrame([([1, 2, 3], [1, 2, 9]), ([1], [1, 2]), ([5], [1])], "f array<int>, p array<int>")
    assert [r[0] for r in masks.select(M.completion_mask(F.col("f"), F.col("p"))).collect()] == [[-100, -100, 3], [-100], [5]]
    assert spark.range(1).select(M.normalised_lines(F.lit("\n\na  \r\nb\n\n"))).first()[0] == "a\nb"
    assert spark.range(1).select(M.cycled(["a", "b"], F.lit(0))).first()[0] == []
