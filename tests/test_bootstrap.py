"""The exact case bootstrap against all draws split in one process, and its multinomial counts."""

import hashlib
import os
import random

import numpy as np
import pytest

from casewright.operators import bootstrap, panel
from casewright.plans import panels


def rows(n, seed=1):
    r = random.Random(seed)
    return [("a" if k % 3 else "b", k, r.choice([-1.0, 0.0, 0.5, 1.0])) for k in range(n)]


def split(values, draws, seed, leaf_size):
    """{(skill, case): counts} of every draw: nodes split from the root down, level by level, then leaves case by case."""
    skills = {}
    for skill, case, _ in values:
        skills.setdefault(skill, []).append((hashlib.sha256(f"{seed}|{skill}|{case}".encode()).hexdigest(), str(case), case))
    depth = min(bootstrap.MOST_DEPTH, (max(map(len, skills.values())) // leaf_size).bit_length())
    out = {}
    for skill, keyed in skills.items():
        leaves = [sorted(k for k in keyed if int(k[0][:8], 16) >> (32 - depth) == i) for i in range(1 << depth)]
        picks = {1: np.full(draws, len(keyed))}
        for level in range(depth):
            for node in range(1 << level, 2 << level):
                span = 1 << (depth - level)
                at = (node - (1 << level)) * span
                left, right = (sum(map(len, leaves[x : x + span // 2])) for x in (at, at + span // 2))
                here = picks[node] if not right else 0 * picks[node] if not left else bootstrap.generator(seed, skill, "node", node).binomial(picks[node], left / (left + right))
                picks[2 * node], picks[2 * node + 1] = here, picks[node] - here
        for i, cases in enumerate(leaves):
            rest, g = picks[(1 << depth) + i], bootstrap.generator(seed, skill, "leaf", i)
            for k, (_, _, case) in enumerate(cases):
                out[skill, case] = g.binomial(rest, 1 / (len(cases) - k)) if k < len(cases) - 1 else rest
                rest = rest - out[skill, case]
    return out


def means(values, counts):
    skills = sorted({v[0] for v in values})
    per = [sum(counts[s, c] * d for s, c, d in values if s == skill) / sum(v[0] == skill for v in values) for skill in skills]
    return np.mean(per, axis=0)


@pytest.mark.parametrize("n, leaf", [(1, 2048), (300, 2048), (300, 7), (40, 1)])
def test_draws_equal_those_of_one_process(spark, monkeypatch, n, leaf):
    monkeypatch.setattr(bootstrap, "LEAF", leaf)
    values = rows(n)
    counts = split(values, 200, "s", leaf)
    for skill in {v[0] for v in values}:
        own = [c for (s, _), c in counts.items() if s == skill]
        assert (sum(own) == len(own)).all() and all((c >= 0).all() for c in own)
    for parts in (1, 5):
        df = spark.createDataFrame(values, "skill string, case int, delta double").repartition(parts)
        got = bootstrap.case_bootstrap(df, 200, "s", "case").orderBy("draw").collect()
        assert np.allclose([r["mean"] for r in got], means(values, counts), atol=1e-12)


def test_counts_are_multinomial():
    n, draws = 40, 10_000
    counts = np.array([c for (s, _), c in split([("a", k, 0.0) for k in range(n)], draws, "m", 8).items()])
    assert (counts.sum(axis=0) == n).all()
    assert np.abs(counts.mean(axis=1) - 1).max() < 0.06
    spread = np.cov(counts)
    assert np.abs(np.diag(spread) - (1 - 1 / n)).max() < 0.1
    assert np.abs(spread - np.diag(np.diag(spread)) + (1 - np.eye(n)) / n).max() < 0.06


def test_interval_is_that_of_plain_resampling(spark):
    values = rows(400, 2)
    df = spark.createDataFrame(values, "skill string, case int, delta double")
    got = panel.interval(bootstrap.case_bootstrap(df, 10_000, "x", "case"), 10_000).first()
    r = np.random.default_rng(0)
    of = [np.array([v[2] for v in values if v[0] == s]) for s in "ab"]
    plain = np.sort(np.mean([d[r.integers(0, len(d), (10_000, len(d)))].mean(axis=1) for d in of], axis=0))
    assert abs(got["mean"] - plain.mean()) < 0.002 and abs(got["ci95_lower"] - plain[250]) < 0.004 and abs(got["ci95_upper"] - plain[9750]) < 0.004


def test_no_cases(spark):
    assert bootstrap.case_bootstrap(spark.createDataFrame([], "skill string, case int, delta double"), 10, "s", "case").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_query(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "LEAF", 64)
    values = [(r["skill"], r["case"], r["delta"]) for r in panels._case_deltas(spark, "/root/testdata/sf0.001").collect()]
    want = np.sort(means(values, split(values, 10_000, "boot", 64)))
    got = panels.bootstrap_exact(spark, "/root/testdata/sf0.001").first()
    assert np.allclose([got["mean"], got["ci95_lower"], got["ci95_upper"]], [want.mean(), want[250], want[9750]], atol=2e-6)


@pytest.mark.parametrize("cases, draws", [(700, 3000), (40, 50), (3, 1), (60, 200)])
def test_binomials_are_numpys_numbers(cases, draws):
    a, b = (bootstrap.generator("t", cases) for _ in "ab")
    n = bootstrap.generator("n", cases).binomial(4 * cases, 0.25, draws)
    for left in range(cases, 1, -1):
        want = a.binomial(n, 1 / left)
        assert (bootstrap.binomials(b, n, 1 / left) == want).all()
        n = n - want
    assert a.random() == b.random()
    assert (bootstrap.binomials(b, np.full(9, 10**6), 0.25) == a.binomial(np.full(9, 10**6), 0.25)).all()


def test_few_bytes_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "LEAF", 8)
    df = spark.createDataFrame(rows(3000), "skill string, case int, delta double")
    parts = bootstrap.dealt_leaves(df, "s", "case")[0].rdd.getNumPartitions()
    assert parts == bootstrap.TASKS * spark.sparkContext.defaultParallelism
