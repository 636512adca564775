"""Licences, fingerprints, embeddings, URL lists and the pipeline on small tables."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import embeddings, iblt, licenses, packing, urls

DATA = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id bigint, text string, bucket string, found string")


# ---- licences ----


def test_license_threshold_is_calibrated(spark):
    """Words of notices in other sentences are not confirmed, other wordings of notices are; no sample is needed for it."""
    others = [
        "The terms of the agreement were subject to review by the public.", "Permission is hereby asked to use the hall, free of charge, to any person who comes.",
        "A copy of the letter was found along with this program of the evening.", "The source code and the binary forms were compared, with or without a fault.",
        "All rights and duties are reserved for members of the public domain council.", "This work is free for visitors, without warranty that the doors open.",
    ]
    notices = [
        "The code is available under the terms of the MIT License.", "Redistribution in source and binary forms is permitted provided that the following conditions are met by you.",
        "This article is licensed under a Creative Commons Attribution 4.0 International License by its authors.", "Copyright 2023 Some Firm Ltd. All rights reserved.",
    ]
    docs = documents(spark, [(i, t) for i, t in enumerate(others + notices)])
    for sample in (docs, docs.where("false")):
        model = licenses.train(sample)
        assert 0.1 < model.threshold < 0.99
        assert {r["doc_id"] for r in licenses.scan(docs, model).where("confirmed").collect()} == set(range(len(others), len(others + notices)))


def test_licenses(spark):
    plain = "the quick brown fox is under the table of all rights and left"
    rows = [(k, f"{plain} {k}\nother words under the tree") for k in range(60)]
    notices = {100 + i: (family, t) for i, (family, t) in enumerate((f, t) for f, ts in licenses.TEMPLATES.items() for t in ts)}
    rows += [(k, f"{plain}\n{t}\n{plain}") for k, (_, t) in notices.items()]
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, "Released under the MIT License."), (503, "RELEASED UNDER THE mit license"), (503, "RELEASED UNDER THE mit license"), (504, "we were licensed to kill under the old bridge")]
    docs = documents(spark, rows)
    found = licenses.scan(docs, licenses.train(docs)).collect()
    by = {}
    for r in found:
        if r["confirmed"]:
            by.setdefault(r["doc_id"], set()).add((r["paragraph"], r["family"]))
    hits = sum((1, family) in by.get(k, ()) for k, (family, _) in notices.items())
    assert hits >= len(notices) - 1
    assert not [k for k in by if k is not None and (k < 100 or 500 <= k < 503 or k == 504)]
    assert by[503] == {(0, "mit")} and by[None] == {(0, "mit")}
    assert licenses.scan(documents(spark, []), licenses.train(documents(spark, []))).count() == 0


def test_unseen_and_wrapped_notices(spark):
    """Notices that are no templates, on one line or wrapped over three, and lines that only sound like one."""
    notices = [
        ("apache-2.0", "This software is released under the Apache License, Version 2.0."), ("gpl", "This file is part of Foo, which is licensed under the GNU General Public License version 2 or later."),
        ("mit", "Permission is hereby granted, free of\ncharge, to any person obtaining a copy of\nthis software and associated documentation"),
        ("apache-2.0", "Licensed under the Apache License,\nVersion 2.0 (the License); you may not use\nthis file except in compliance with the License."),
        ("bsd", "Redistributions of source code must retain\nthe above copyright notice, this list of\nconditions and the following disclaimer."),
    ]
    plain = ["the public has a licence to use the park", "a version of the work in the general direction", "he was granted the software and the copyright of a song"]
    rows = [(k, f"some words\n{t}\nother words") for k, (_, t) in enumerate(notices)] + [(100 + k, t) for k, t in enumerate(plain)] + [(200 + k, f"{plain[k % 3]} {k}") for k in range(60)]
    docs = documents(spark, rows)
    found = licenses.scan(docs, licenses.train(docs)).where("confirmed").collect()
    assert {k: {r["family"] for r in found if r["doc_id"] == k} for k in range(len(notices))} == {k: {f} for k, (f, _) in enumerate(notices)}
    assert not [r for r in found if r["doc_id"] >= 100]
    assert {r["lines"] for r in found if r["doc_id"] == 2} == {3} and {r["lines"] for r in found if r["doc_id"] < 2} == {1}


def test_license_training_counts_every_line(spark):
    """All lines of 4,000 distinct texts are counted, with their runs, against brute force; copies count once."""
    starts = ["of the public", "under the terms", "nothing here", "Released under the MIT License", "this file is old", "to any person"]
    texts = [f"{starts[k % 6]} {k}\n{starts[k // 6 % 6]}\nother {k}" for k in range(4000)]
    docs = documents(spark, list(enumerate(texts + texts[:500])))
    templates = [licenses.bigrams(licenses.words(t)) for ts in licenses.TEMPLATES.values() for t in ts]
    share = lambda ids, n: max(len(ids & t) / min(n, len(t)) for t in templates)
    want = {}
    for text in texts:
        lines = [licenses.bigrams(licenses.words(p)) for p in text.split("\n")]
        held = {k: (b & set(licenses.PAIRS), len(licenses.words(p)) + 1) for k, (b, p) in enumerate(zip(lines, text.split("\n"))) if b & set(licenses.PAIRS)}
        found = list(held.values())
        for first in range(-2, 3):
            inside = [held[k] for k in range(first, first + 3) if k in held]
            if len(inside) > 1:
                found.append((set().union(*(i for i, _ in inside)), sum(n for _, n in inside)))
        for ids, n in found:
            if share(ids, n) < licenses.CONFIRM:
                key = tuple(sorted(licenses.NUMBER[p] for p in ids))
                want[key] = want.get(key, 0) + 1
    rows = licenses.unknown(licenses.candidates(docs)).collect()
    assert {tuple(r["ids"]): r["train"] + r["held"] for r in rows if not r["hard"]} == want
    assert sum(want.values()) > 4000 and any(r["hard"] for r in rows) and licenses.lines_of(docs) == 12_000


def test_license_sums_agree_in_the_driver_and_in_tasks(spark, monkeypatch):
    rng = licenses.np.random.default_rng(1)
    rows = [(sorted(map(int, rng.choice(len(licenses.PAIRS), rng.integers(0, 6), replace=False))), float(rng.random())) for _ in range(50)]
    df = spark.createDataFrame(rows, "ids array<int>, share double")
    w, b = rng.normal(size=(len(licenses.PAIRS), len(licenses.FAMILIES))), rng.normal(size=len(licenses.FAMILIES))
    here = licenses._summed(df)(w, b)
    monkeypatch.setattr(licenses, "LOCAL", 10)
    there = licenses._summed(df)(w, b)
    assert licenses.np.allclose(here, there, atol=1e-12) and abs(here[-1].sum() - sum(s for _, s in rows)) < 1e-9
    assert not licenses._summed(df.where("false"))(w, b).any()


def test_license_threshold_of_all_counts():
    counts = {100_000: 4_000, 500_000: 5_990, 700_123: 7, 700_124: 4, 900_000: 6}

    def counted(low, high, parts):
        out, width = {}, (high - low) // parts
        for at, n in counts.items():
            if low <= at < high:
                out[(at - low) // width] = out.get((at - low) // width, 0) + n
        return out

    none = licenses.np.zeros(0)
    assert licenses._threshold(counted, none, [], 10_007) == 0.700124
    assert licenses._threshold(counted, licenses.np.array([0.95]), [1], 10_007) == 0.700125
    assert licenses._threshold(counted, licenses.np.array([0.95]), [20], 10_007) == 0.950001


def test_license_pairs_agree(spark):
    texts = ["A b, c.", "  v. 2.0. x ", "", "MIT", "a...b ..c"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    for t, r in zip(texts, df.select(licenses.pairs_of("p")).collect()):
        pairs = spark.createDataFrame([tuple(p.split(" ")) for p in licenses.bigrams(licenses.words(t))], "a string, b string")
        assert set(r[0]) == {x[0] for x in pairs.select(F.xxhash64("a", "b")).collect()}, t


# ---- fingerprints ----


def pieces(t):
    return set(re.findall(r"[^\n]{1,96}", t))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("rows_a_bucket", [1000, 3])
def test_fingerprints_against_brute_force(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(iblt, "BUCKET_ROWS", rows_a_bucket)
    r = random.Random(3)
    line = lambda: "".join(r.choice("abcdé 😀") for _ in range(r.randint(0, 300)))
    texts = ["\n".join(line() for _ in range(r.randint(1, 12))) for _ in range(25)]
    rows = [(k * k, t) for k, t in enumerate(texts)] + [(5, texts[3]), (6, None), (7, ""), (1000, "\n".join(line() for _ in range(400)))]
    got = {g["doc_id"]: g for g in iblt.fingerprints(documents(spark, rows)).collect()}
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda x: -x[0])
    seen = {}
    for i, (k, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        g = got[k]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(g["near_edited"] - jaccard(pieces(t), pieces(edited))) < 1e-12 and abs(g["near_next"] - jaccard(pieces(t), pieces(after))) < 1e-12
        assert seen.setdefault(t, g["fingerprint"]) == g["fingerprint"]
    assert len(set(seen.values())) == len(seen)


def test_fingerprints_of_few_nulls_and_repeats(spark):
    assert iblt.fingerprints(documents(spark, [])).count() == 0
    one = iblt.fingerprints(documents(spark, [(1, "a\nb")])).first()
    assert one["near_next"] == 1.0
    rows = [(None, "x y"), (None, None), (3, "p\nq"), (3, "p\nq"), (3, "r")]
    got = iblt.fingerprints(documents(spark, rows)).collect()
    assert len(got) == 5 and len({g["fingerprint"] for g in got if g["doc_id"] == 3}) == 2


def test_sketches_are_retried_larger(spark, monkeypatch):
    """A table far too small for the difference gets stuck; the next level or the arrays still give the answer."""
    texts = [(k, "\n".join(f"{k} {i}" for i in range(200))) for k in range(4)]
    want = sorted((g["doc_id"], g["near_next"], g["near_edited"]) for g in iblt.fingerprints(documents(spark, texts)).collect())
    monkeypatch.setattr(iblt, "ROUNDS", 2)
    assert sorted((g["doc_id"], g["near_next"], g["near_edited"]) for g in iblt.fingerprints(documents(spark, texts)).collect()) == want


def test_stored_sketches_subtract(spark):
    """Few differing pieces come out of the stored sketches alone, more from larger ones; signs say whose they are."""
    base = [f"line {i}" for i in range(60)]
    rows = [(1, "\n".join(base), "\n".join(base[:57] + ["x", "y"])), (2, "\n".join(base), "\n".join(reversed(base))), (3, "a", None), (4, "\n".join(base), "\n".join(f"other {i}" for i in range(90)))]
    df = spark.createDataFrame(rows, "key bigint, a string, b string")
    hashed = {r["p"]: r["h"] for r in spark.createDataFrame([(p,) for _, a, b in rows for p in pieces(a) | pieces(b or "")], "p string").selectExpr("p", "xxhash64(p) h").collect()}
    want = {k: (sorted(hashed[p] for p in pieces(a) - pieces(b or "")), sorted(hashed[p] for p in pieces(b or "") - pieces(a))) for k, a, b in rows}
    assert {r["key"]: (r["only_a"], r["only_b"]) for r in iblt.differences(df).collect()} == want
    few = df.selectExpr("1L bucket", "key rid", "a", "b").withColumns({"a_found": iblt.digests(F.col("a")), "b_found": iblt.digests(F.coalesce("b", F.lit("")))})
    few = few.withColumns({"a_cells": iblt.sketch("a_found"), "b_cells": iblt.sketch("b_found")})
    stored = few.withColumn("w", iblt.written(F.lit(7).cast("long"), F.col("a_cells")))
    assert stored.where(iblt.cells_of("w") != F.col("a_cells")).count() == 0
    first = iblt.attempt(few.withColumn("d0", F.lit(None).cast(iblt.DIFFERENCE)), 0, [("a", "b")], ["a_found", "b_found"])
    assert {r["rid"]: r["d0"] is not None and len(r["d0"]) for r in first.collect()} == {1: 5, 2: 0, 3: 1, 4: False}


def test_hot_ids(spark, monkeypatch):
    """A doc_id that a third of the rows have, and null ones, are dealt to many buckets; order holds."""
    monkeypatch.setattr(iblt, "BUCKET_ROWS", 10)
    rows = [(50, f"a {k}") for k in range(100)] + [(None, f"b {k}") for k in range(100)] + [(k, f"c {k}") for k in range(100)]
    docs = documents(spark, rows)
    found = iblt.neighbours(docs)
    assert found.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 40
    got = iblt.fingerprints(docs).collect()
    assert len(got) == 300 and iblt.undecided(docs).first()["undecided"] == 0
    follow = {r["text"]: r["next_text"] for r in found.collect()}
    at, seen = "c 99", []
    while at not in seen:
        seen.append(at)
        at = follow[at]
    assert len(seen) == 300 and [t[0] for t in seen] == ["c"] * 49 + [t[0] for t in seen[49:150]] + ["c"] * 50 + ["b"] * 100


# ---- embeddings ----


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([c + r.normal(scale=s, size=(12, 16)) for c, s in zip(centres, [0.05, 0.2, 0.3, 0.35] * 3)]).astype(np.float32)
    label = r.integers(0, 2, len(x))
    rows = [(int(i), v.tolist(), int(la), "k") for i, (v, la) in enumerate(zip(x, label))]
    rows += [(500, rows[0][1], rows[0][2], "k"), (501, rows[0][1], rows[0][2], "k"), (501, rows[0][1], rows[0][2], "k")]
    odd = [(600, None, 0, "k"), (601, [0.0] * 16, 0, "k"), (602, rows[0][1], None, "k"), (603, [float("nan")] * 16, 0, "k"), (604, [None] * 16, 0, "k"), (605, [], 0, "k"), (606, [1.0, 2.0], 0, "k"), (None, rows[0][1], rows[0][2], "k")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int, key string")
    got = embeddings.near_dup_vectors(df).collect()
    assert len(got) == len(rows) + len(odd)
    m = np.array([v for _, v, *_ in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids, la = np.array([k for k, *_ in rows]), np.array([k for _, _, k, _ in rows])
    link = (m @ m.T >= 0.93) & (la[:, None] == la[None, :])
    np.fill_diagonal(link, False)
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(link, root[None, :], 10**9).min(axis=1))
        if (low == root).all():
            break
        root = low
    want = sorted((int(k), int(n), int(c), bool(k == c)) for k, n, c in zip(ids, link.sum(axis=1), root))
    assert sorted(tuple(g) for g in got if g["vec_id"] is not None and g["vec_id"] < 600) == want
    for g in got:
        if g["vec_id"] is None or g["vec_id"] >= 600:
            assert (g["n_links"], g["component_id"], g["kept"]) == (0, g["vec_id"], True)
    assert embeddings.near_dup_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("count, least", [(256, 0.975), (512, 0.975), (2048, 0.975), (8192, 0.975), (16384, 0.975)])
def test_recall_of_the_index(count, least):
    """Pairs at exactly the threshold share a list, however many reference points there are."""
    r = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots, a = unit(r.normal(size=(count, 64))), unit(r.normal(size=(2000, 64)))
    away = r.normal(size=(2000, 64))
    away = unit(away - (away * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * away
    x, y = embeddings.list_keys(a, pivots), embeddings.list_keys(b, pivots)
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean() >= least


def test_pivots_are_thinned():
    r = np.random.default_rng(1)
    crowd = r.normal(size=(1, 8)) + 0.01 * r.normal(size=(600, 8))
    x = np.concatenate([crowd, r.normal(size=(50, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = embeddings.thinned(x, 1000)
    near = points @ points.T - 2 * np.eye(len(points))
    assert near.max() < embeddings.APART and 2 <= len(points) <= 51


# ---- URL lists ----


def test_url_filter(spark):
    entries = spark.createDataFrame([("bad.com", "ads", "add", 100), ("bad.com", "ads", "remove", 200), ("bad.com", "ads", "add", 10**7), ("x.org/sec", "spam", "add", 0), ("bad.com", "spam", "add", 150), ("bad.com", "spam", "remove", 150), ("bad.com", "ads", "add", 100), (None, "a", "add", 1), ("y.net", None, "add", 5)], "pattern string, category string, action string, effective_at bigint")
    asked = [("http://a.bad.com/p", 99), ("http://a.bad.com/p", 100), ("http://A.BAD.com/p", 199), ("http://bad.com", 200), ("https://bad.com:8080/", 10**7 + 5), ("http://notbad.com/", 150), ("http://x.org/sec/more?q", 1), ("http://x.org/other", 1), ("http://bad.com", 150), ("http://z.y.net", 5), (None, 150), ("no url", 150), ("http://bad.com", None), ("http://bad.com", 150)]
    df = spark.createDataFrame([(i, u, t, "n") for i, (u, t) in enumerate(asked)], "i int, url string, fetched_at bigint, blocked string")
    got = [(r["categories"], r["n_active"], r["blocked"]) for r in urls.url_filter(df, entries).orderBy("i").collect()]
    hit = lambda *c: ("|".join(c), len(c), True)
    no = ("", 0, False)
    assert got == [no, hit("ads"), hit("ads"), no, hit("ads"), no, hit("spam"), no, hit("ads"), ("", 1, True), no, no, no, hit("ads")]
    assert urls.url_filter(df, entries.where("false")).where("blocked").isEmpty() and urls.url_filter(df.where("false"), entries).count() == 0


# ---- pipeline ----


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids, columns = None, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name != "packing":
            assert out.columns == columns
            found = [r["doc_id"] for r in out.select("doc_id").collect()]
            assert found and (ids is None or set(found) <= ids)
            if name == "near_dedup":
                assert len(found) == len(set(found))
            ids = set(found)
        docs = out
    assert {r["doc_id"] for r in docs.collect()} == ids and set(docs.columns) >= {"sequence_id", "offset", "ids_crc32"}
    total = lambda df: df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, total(corpus_pipeline.run(spark, DATA)))) == sorted(map(tuple, total(docs)))
    assert packing.default_paths()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_url_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    got = urls.op10_urls(spark, DATA)
    want = con.execute(urls.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert {r["blocked"] for r in got.select("blocked").distinct().collect()} == {True, False}


def test_written_sketches_hold_large_counts(spark):
    """A cell of 70,000 digests, and one of the most that eight digits hold, are read back as they were written."""
    counts = [70_000, (1 << 32) - 1] + [0] * (3 * iblt.SMALL - 2)
    cells = spark.createDataFrame([(7, [(n, -n, n % 1000) for n in counts])], "digest long, cells array<struct<cnt: long, id: long, chk: long>>")
    back = cells.select(iblt.written(F.col("digest"), F.col("cells")).alias("fingerprint")).select(iblt.cells_of("fingerprint").alias("cells")).first()["cells"]
    assert [(c["cnt"], c["id"], c["chk"]) for c in back] == [(n, -n, n % 1000) for n in counts]
