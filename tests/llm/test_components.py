"""Connected components against union-find, and what later rounds read."""

import random

from casewright.llm import shared
from test_nearcopies import groups


def found(spark, edges):
    return {r["node"]: r["root"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).select("node", "root").collect()}


def wanted(edges):
    nodes = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    return {x: nodes[g] for x, g in zip(nodes, groups(len(nodes), [(at[a], at[b]) for a, b in edges]))}


def test_chains_stars_crowds_loops_and_repeats(spark):
    r = random.Random(2)
    chain = [(k + 1, k) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(100)] + [(5000, 1050)]
    crowd = [tuple(r.sample(range(2000, 2050), 2)) for _ in range(400)]
    sparse = [tuple(r.sample(range(10_000, 10_200), 2)) for _ in range(150)]
    edges = chain + star + crowd + sparse + chain[:5] + [(b, a) for a, b in sparse[:5]] + [(7000, 7000), (-5, 17_000), (-(2**63), 2**63 - 1)]
    assert found(spark, edges) == wanted(edges)
    assert found(spark, edges[:1]) == {0: 0, 1: 0}
    assert found(spark, []) == {}


def test_edges_inside_groups_are_not_read_again(spark, monkeypatch):
    """Of a crowd's edges, later rounds get those between groups only."""
    sizes, own = [], shared.checkpointed

    def counted(df):
        out = own(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(shared, "checkpointed", counted)
    r = random.Random(3)
    edges = list({tuple(sorted(r.sample(range(200), 2))) for _ in range(4000)})
    assert set(found(spark, edges).values()) == {0}
    assert sizes[0] == len(edges) and sizes[-1] == 0 and sum(sizes[1:]) < len(edges) / 10
