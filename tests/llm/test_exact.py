"""Exact dedup: filters give back what they hold, and groups equal a brute-force grouping by bytes."""

import hashlib
import random

import numpy as np
import pytest

from casewright.llm import exact, quotient

DDL = "doc_id bigint, text string, keep_id string, fp string, row string, body string, size string, n_chars string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], DDL)


def brute(rows):
    body = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(body(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, digest) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def cases():
    r = random.Random(5)
    base = [" ".join(r.choice(["the", "an", "ing", "é", "日本"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(1000 + k, t.replace(" ", r.choice(["", "  ", "\t", "\r\n"]))) for k, t in enumerate(base[:30])]
    rows += [(2000 + k, base[0]) for k in range(150)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, " "), (3004, "  "), (3005, "x" * 300_000), (3006, "x " * 300_000)]
    rows += [(None, base[1]), (None, base[1]), (None, "alone without id"), (None, "two"), (None, "two"), (7, base[2]), (7, base[2])]
    r.shuffle(rows)
    return rows


def test_groups_against_brute_force(spark):
    rows = cases()
    assert found(exact.exact_groups(table(spark, rows).repartition(7))) == brute(rows)


@pytest.mark.parametrize("hashed", [lambda x: len(x) % 3 << 61, lambda x: 0, lambda x: (1 << 64) - 1 - len(x) % 2])
def test_colliding_fingerprints_are_told_apart_by_bytes(spark, hashed):
    rows = cases()
    assert found(exact.exact_groups(table(spark, rows), hashed=hashed)) == brute(rows)


def test_dedup_keeps_one_row_and_all_columns(spark):
    rows = cases()
    docs = table(spark, rows)
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    want = [m for m in brute(rows) if m[3]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((m[0] for m in want), key=repr)
    twice = exact.exact_dedup(kept)
    assert twice.count() == len(want)


def test_ids_of_another_type_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "xy "), ("c", "xyz"), (None, "xyz")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.exact_groups(docs).collect()} == {("b", "a", 2), ("a", "a", 2), ("c", "c", 2), (None, "c", 2)}
    assert exact.exact_groups(table(spark, [])).count() == 0 and exact.exact_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000])
def test_filter_round_trip_split_and_merge(n):
    r = np.random.default_rng(n)
    fps = np.unique(np.concatenate((r.integers(0, 1 << 64, n, np.uint64, endpoint=False), np.array([0, (1 << 64) - 1], np.uint64)[:n])))
    counts = r.integers(1, 5, len(fps))
    got = quotient.decode(quotient.encode(fps, counts))
    assert (got[0] == fps).all() and (got[1] == counts).all()
    for bits in (0, 3, 8):
        parts = [quotient.merged([data, data], block) for block, data in quotient.split(fps, counts, bits)]
        if n:
            assert (np.concatenate([p[0] for p in parts]) == fps).all() and (np.concatenate([p[1] for p in parts]) == 2 * counts).all()
    half = quotient.merged([quotient.encode(fps[::2], counts[::2]), quotient.encode(fps[1::2], counts[1::2]), quotient.encode(fps, counts)])
    assert (half[0] == fps).all() and (half[1] == 2 * counts).all()


def test_only_repeated_fingerprints_are_marked(spark):
    docs = table(spark, [(k, f"text {k // 2 if k < 20 else k}") for k in range(500)])
    marks, bits, hot = exact.repeated_fingerprints(docs)
    places = {exact.fingerprint(b"text%d" % k) >> (64 - bits) for k in range(10)}
    assert {int(p) for p in np.nonzero(np.unpackbits(marks, bitorder="little"))[0]} == places and len(hot) == 10
