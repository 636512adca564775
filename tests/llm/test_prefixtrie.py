"""The prefix trie against one built turn by turn in Python, and running sums over keys of any size."""

import hashlib
import random
import zlib

import pytest

from casewright.llm import prefixtrie
from casewright.llm.running import running_sums

DDL = "conv_id bigint, turn bigint, role string, text string, depth string, n string, owner string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DDL)


def sequences(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (*x[:2], prefixtrie.turn_digest(x[2].encode(), x[3].encode())))] for c, v in out.items()}


def rebuilt(whole):
    out = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = whole.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    """Rows of all nodes, from the members of every prefix."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*prefixtrie.NODE).collect()), key=repr)


def talk(c, texts):
    return [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def cases():
    r = random.Random(4)
    rows = []
    for c in range(120):
        rows += talk(c, [r.choice("abc") + "é" * r.randint(0, 2) for _ in range(r.randint(1, 9))])
    for c in range(200, 240):
        rows += talk(c, ["same", "talk", "again"])
    for c in range(300, 340):
        rows += talk(c, ["n"] * (c - 299))
    rows += talk(400, [f"long {k}" for k in range(130)]) + talk(401, [f"long {k}" for k in range(90)] + ["other"] * 50) + talk(399, [f"long {k}" for k in range(40)])
    rows += [(500, None, None, None), (500, 3, "user", None), (500, 3, "user", None), (500, 3, None, "b"), (None, 0, "user", "x"), (501, None, "", "")]
    r.shuffle(rows)
    return rows


def test_whole_conversations_against_brute_force(spark):
    rows = cases()
    assert found(prefixtrie.conversation_trie(table(spark, rows).repartition(5))) == brute(sequences(rows))


def test_rebuilt_conversations_against_brute_force(spark):
    rows = [x for x in cases() if x[0] != 200]
    turns = prefixtrie.numbered_turns(table(spark, rows)).cache()
    assert found(prefixtrie.trie(*prefixtrie.rebuilt(turns))) == brute(rebuilt(sequences(rows)))


def test_members_without_turns_and_joined_ids(spark, monkeypatch):
    """Ids by the thousand at one node, joined in short strings; turnless conversations end at the root."""
    monkeypatch.setattr(prefixtrie, "JOINED", 7)
    rows = [x for c in range(101, 199) for x in talk(c, ["q"])] + [x for c in range(1000, 1300) for x in talk(c, ["a", "b", "c", "d", "e", "f"])]
    turns = prefixtrie.numbered_turns(table(spark, rows)).cache()
    assert found(prefixtrie.trie(*prefixtrie.rebuilt(turns))) == brute(rebuilt(sequences(rows)))


def test_nested_chains(spark):
    """Each conversation branches off the one before it one turn deeper, so chains hang on chains."""
    rows = [x for c in range(12) for x in talk(c, [f"s{k}" for k in range(1, c + 1)] + [f"own {c}"] * 2)]
    assert found(prefixtrie.conversation_trie(table(spark, rows))) == brute(sequences(rows))


def test_empty_table(spark):
    assert prefixtrie.conversation_trie(table(spark, [])).count() == 0
    assert prefixtrie.conversation_trie(table(spark, [(None, 0, "user", "x")])).count() == 0


@pytest.mark.parametrize("parts", [1, 13])
def test_running_sums(spark, parts):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3, r.randint(4, 60)]), k, r.choice([1, -5, (1 << 62), (1 << 63) - 1])) for k in range(3000)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = running_sums(spark.createDataFrame(rows, "key long, at long, v long"), "key", ["at"], {"part": "v"}, "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total, want = {}, []
    for key, at, v in sorted(rows):
        total[key] = (total.get(key, 0) + v + (1 << 63)) % (1 << 64) - (1 << 63)
        want.append((key, at, v, total[key]))
    assert sorted((x["key"], x["at"], x["v"], x["part"]) for x in got) == want
