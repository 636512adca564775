import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import hashtree, probes, quantiles, vectors


def records(spark, cases, drop=(), more=()):
    rows = [(c, k, e) for c in cases for k in probes.CONTEXTS for e in probes.EXPOSURES if (c, k, e) not in drop]
    return spark.createDataFrame(rows + list(more), "case_id string, context_load string, prompt_exposure string").repartition(3)


def listed(spark, cases):
    return spark.createDataFrame(list(enumerate(cases)), "place long, case_id string")


def order(df):
    return [(r["case_id"], r["context_load"], r["prompt_exposure"]) for r in df.orderBy("position").collect()]


def test_selection_follows_the_list(spark):
    rows = records(spark, "dbca")
    want = [(c, k, e) for c in "bda" for k in probes.CONTEXTS for e in probes.EXPOSURES]
    got = probes.select_probe(rows, listed(spark, "bdab"))
    assert order(got) == want and [r["position"] for r in got.orderBy("position").collect()] == list(range(1, 25))
    assert order(probes.select_probe(rows, listed(spark, "bda"), most=2)) == want[:16]
    assert order(probes.select_probe(rows, listed(spark, "bda"), context="long")) == [w for w in want if w[1] == "long"]
    assert order(probes.select_probe(rows, preflight=True)) == [("a", k, e) for k in probes.CONTEXTS for e in probes.EXPOSURES]
    assert [x[0] for x in order(probes.select_probe(rows))][::8] == list("abcd")
    assert [x[0] for x in order(probes.select_probe(rows, most=3))][::8] == list("abc")


@pytest.mark.parametrize(
    "drop, more, options, told",
    [
        ([("b", "long", "full")], [], {}, "incomplete"),
        ([("b", "long", e) for e in probes.EXPOSURES], [], {}, "incomplete"),
        ([], [("b", "long", "full")], {}, "incomplete"),
        ([], [("b", "long", "other")], {}, "incomplete"),
        ([], [], {"cases": "bx"}, "without a record"),
        ([], [], {"context": "wide"}, "context load"),
        ([], [], {"exposures": ["full", "full"]}, "each once"),
        ([], [], {"exposures": []}, "each once"),
        ([], [], {"exposures": ["full"]}, "incomplete"),
        ([], [], {"preflight": True}, "one case"),
    ],
)
def test_selection_refuses(spark, drop, more, options, told):
    rows = records(spark, "abc", set(drop), more)
    with pytest.raises(ValueError, match=told):
        probes.select_probe(rows, listed(spark, options.pop("cases", "ba")), **options)


def test_a_fault_outside_the_selection_does_not_matter(spark):
    rows = records(spark, "abc", {("c", "long", "full"), ("a", "short", "full")})
    assert len(order(probes.select_probe(rows, listed(spark, "ba"), context="long"))) == 8


def test_ranks_over_ranges(spark):
    r = random.Random(3)
    cases = [(r.choice([1, 1, 2, r.randint(-50, 50)]), f"c{k}") for k in range(500)]
    df = spark.createDataFrame(cases, "place int, case_id string")
    for rows in (10, 1000):
        got = {(x["place"], x["case_id"]): x["case_rank"] for x in probes.list_ranks(df, rows).collect()}
        assert [got[c] for c in sorted(cases)] == list(range(1, 501))


def median(values):
    s = sorted(values)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_medians_of_any_shape(spark, accuracy):
    r = random.Random(accuracy)
    groups = {
        "even": [r.random() for _ in range(2000)], "odd": [r.gauss(0, 1e9) for _ in range(2001)], "ties": [1.0] * 900 + [2.0] * 900, "one": [7.0], "two": [1.0, -4.0],
        "skew": [0.0] * 1500 + [10.0 ** k for k in range(300)], "infinite": [float("inf"), float("-inf"), 3.0], "tiny": [5e-324, -5e-324, 0.0, 1e308], None: [4.0, 5.0, 6.0, 7.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("one", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x["k"]: x["median"] for x in quantiles.medians(df, "v", "k", accuracy=accuracy).collect()}
    assert got == {k: pytest.approx(median(v), rel=1e-15) for k, v in groups.items()}
    whole = quantiles.medians(df, "v", accuracy=accuracy).first()["median"]
    assert whole == pytest.approx(median([v for _, v in rows if v is not None]), rel=1e-15)
    assert quantiles.medians(df.where("false"), "v", "k").count() == 0 == quantiles.medians(df.where("false"), "v").count()


def test_finite_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", float("inf")), ("b", None), (None, 2.0)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in vectors.finite_stats(df, "v", "k").collect()}
    assert got == {"a": (2, 2.0, 2.0, 1.0, 3.0, 1.0), "b": (0, None, None, None, None, None), None: (1, 2.0, 2.0, 2.0, 2.0, 1.0)}
    assert tuple(vectors.finite_stats(df, "v").first()) == (3, 2.0, 2.0, 1.0, 3.0, 1.0)
    assert tuple(vectors.finite_stats(df.where("false"), "v").first()) == (0, None, None, None, None, None)


def test_trees_tell_where_tables_differ(spark):
    r = random.Random(1)
    ids = [("g", str(k)) for k in range(3000)] + [("h", "x")] * 500 + [("h", None), (None, "y")]
    r.shuffle(ids)
    left = spark.createDataFrame(ids, "grp string, id string").repartition(4)
    again = spark.createDataFrame(sorted(ids, key=repr), "grp string, id string")
    for depth in (0, 1, 3):
        trees = [hashtree.hash_tree(x, ["grp"], "id", depth) for x in (left, again)]
        assert hashtree.differing(*trees, ["grp"]).isEmpty() and hashtree.differing_ids(left, again, ["grp"], "id", depth).isEmpty()
        roots = {x["grp"]: (x["ids"], x["rows"]) for x in hashtree.root(trees[0]).collect()}
        assert roots == {"g": (3000, 3000), "h": (2, 501), None: (1, 1)}
    other = again.where("id <> '17' OR id IS NULL").union(spark.createDataFrame([("h", "x"), ("g", "new"), ("only", "z")], "grp string, id string"))
    got = {(x["grp"], x["id"]): (x["left_n"], x["right_n"]) for x in hashtree.differing_ids(left, other, ["grp"], "id", 3).collect()}
    assert got == {("g", "17"): (1, 0), ("h", "x"): (500, 501), ("g", "new"): (0, 1), ("only", "z"): (0, 1)}
    nodes = hashtree.differing(*(hashtree.hash_tree(x, ["grp"], "id", 2) for x in (left, other)), ["grp"])
    assert nodes.where("grp = 'g' AND level = 2").count() <= 2 and nodes.where("level = 0").count() == 3
    assert hashtree.differing_ids(left, other.union(other), [], "id", 1).where("id = 'new'").first()["right_n"] == 2


def test_depth_keeps_leaves_bounded(spark):
    assert [hashtree.depth_for(n) for n in (0, 4096, 4097, 65536, 65537, 10**12)] == [0, 0, 1, 1, 2, 7]
    tree = hashtree.hash_tree(spark.range(20_000), [], "id", hashtree.depth_for(20_000, 100))
    assert tree.where("level = 2").agg(F.max("ids")).first()[0] < 150


def test_records_are_read_twice_at_most(spark, monkeypatch):
    """Once to check the groups and once for the result, whatever the list is derived from."""
    made = records(spark, "dbca")
    once = made.groupBy("case_id").agg(F.count("*").alias("place")).select("place", "case_id")
    got = probes.select_probe(made, once)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert [x[0] for x in order(got)][::8] == list("abcd")
