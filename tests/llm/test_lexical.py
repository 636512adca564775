"""Ranked lexical search against a brute-force scorer, with ties, nulls, repeats and shards of any size."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from casewright.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k):
    counts = [(i, Counter(tokens(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(tokens(text))
    out = []
    for item, of in asked.items():
        found = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in of if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def tables(spark, docs, queries):
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id bigint, text string, item_id string, score int")
    q = spark.createDataFrame([(i, t, "b") for i, t in queries], "item_id bigint, text string, doc_id string")
    return d, q


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def cases():
    r = random.Random(2)
    vocabulary = [a + b for a in ["the", "An", "é", "ING", "x7", "日本"] for b in ["", "a", "Zz", "9", "ö"]]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "-", "\n", ", ", "\x7f"]) for _ in range(n))
    docs = [(k, text(r.randint(1, 40))) for k in range(300)] + [(1000 + k, "same theZz text theZz") for k in range(90)]
    docs += [(2000, None), (2001, ""), (2002, " .,\n"), (2003, "theZz " * 40_000), (None, "same theZz text"), (None, "same theZz text"), (5, "same theZz text"), (5, "same theZz text")]
    queries = [(k, text(r.randint(1, 12))) for k in range(12)] + [(50, "THEZZ"), (51, None), (52, "??"), (53, "unseen"), (54, "same unseen TEXT"), (54, "same"), (None, "x7")]
    r.shuffle(docs)
    return docs, queries


@pytest.mark.parametrize("k, parts", [(50, 9), (3, 1), (1000, 4)])
def test_search_against_brute_force(spark, k, parts):
    docs, queries = cases()
    d, q = tables(spark, docs, queries)
    assert got(lexical.search(lexical.index(d.repartition(parts)), q, k)) == brute(docs, queries, k)


def test_blocks_of_queries(spark, monkeypatch):
    docs, queries = cases()
    d, q = tables(spark, docs, queries)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 25)
    assert got(lexical.search(lexical.index(d), q, 5)) == brute(docs, queries, 5)


@pytest.mark.parametrize("n_docs, postings", [(1, 10), (7, 1 << 20), (1000, 60), (1000, 1)])
def test_shards_of_any_size(monkeypatch, n_docs, postings):
    """However shards end, they hold every document once, in order of doc_id."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", n_docs)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    docs, _ = cases()
    batch = pa.record_batch([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs])], ["doc_id", "text"])
    counted = [(i, Counter(tokens(t))) for i, t in docs]
    size = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    ids, df = [], Counter()
    for shard in lexical._shard_batches(size, pa.int64())([batch]):
        own = shard.column(0)[0].as_py()
        assert own == sorted(own, key=lambda i: (i is None, i or 0)) and len(own) <= n_docs
        starts = shard.column(2)[0].as_py()
        for t, a, b in zip(shard.column(1)[0].as_py(), starts, starts[1:]):
            df[t.decode()] += b - a
        ids += own
    assert sorted(ids, key=repr) == sorted((i for i, c in counted if c), key=repr)
    assert df == Counter(t for _, c in counted for t in c)


def test_rows_of_the_index_are_small(spark):
    """However many documents a partition holds, no row of the index holds more than one term's postings of one shard."""
    d = spark.range(5000).selectExpr("id AS doc_id", "concat('one two three four ', id % 7) AS text").coalesce(1)
    shards = lexical.index(d).shards
    lists = [c for c, t in shards.dtypes if t.startswith("array")]
    longest = shards.selectExpr(*(f"max(size({c}))" for c in lists)).first()
    assert max(longest) <= lexical.SHARD_DOCS
    q = spark.createDataFrame([(1, "one 3")], "item_id bigint, text string")
    best = [r["doc_id"] for r in lexical.search(lexical.index(d), q, 4).orderBy("rank").collect()]
    assert best == [3, 10, 17, 24]


def test_top_takes_ties_in_order():
    r = np.random.default_rng(1)
    for n in (0, 1, 10, 400):
        for k in (1, 5, 50):
            scores = r.integers(0, 6, n)
            want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], i))[:k]
            assert lexical.top(scores, k).tolist() == want


def test_empty_tables_and_ids_of_another_type(spark):
    docs, queries = cases()
    d, q = tables(spark, docs, queries)
    none, nothing = tables(spark, [], [])
    assert lexical.search(lexical.index(none), q).count() == 0
    assert lexical.search(lexical.index(d), nothing).count() == 0
    found = lexical.search(lexical.index(d.selectExpr("concat('d', doc_id) doc_id", "text")), q.selectExpr("cast(item_id as string) item_id", "text"), 2)
    assert found.where("item_id = '50' AND rank = 1").first()["doc_id"].startswith("d")
