"""SimHash, language ID, quality, mixing, packing and language-model scoring on small tables."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casewright.llm import langid, lm, mixing, packing, quality, simhash
from casewright.llm.shared import connected_components, crc32_mod

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, copies string, size string, lang_pred string, quality_score string"


def table(spark, rows):
    """documents with further columns of clashing names."""
    return spark.createDataFrame([(i, t, la, s, len(t) if t else 0, "a", "b", "c", "d", "e") for i, t, la, s in rows], DDL)


def words(seed, n, syllables=("the", "an", "to", "ing", "er", "re", "on")):
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


ODD = [(900, None, None, None), (901, "", "xx", None), (902, " \n\t ", None, "s"), (903, "12 34 !!", None, "s"), (904, "é" * 5, "yy", "s"), (None, "some text here", None, "s"), (None, "some text here", None, "s")]


# ---- SimHash ----


def brute_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(i)
    result = [None] * len(ids)
    for members in out.values():
        known = [ids[i] for i in members if ids[i] is not None]
        for i in members:
            result[i] = min(known) if known else None
    return result


def test_simhash_against_brute_force(spark):
    base = [words(k, 400) for k in range(12)]
    rows = [(k, t, None, None) for k, t in enumerate(base)]
    for k in range(40):
        found = base[k % 12].split()
        found[(k * 7) % 400] = "changed"
        rows.append((100 + k, " ".join(found).upper() if k % 3 else " ".join(found), None, None))
    rows += [(200, base[0], None, None), (201, base[0].replace(" ", "\n\t"), None, None)] + ODD
    got = simhash.simhash_components(table(spark, rows)).collect()
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    want = sorted(zip(ids, fps, brute_components(ids, fps)), key=repr)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=repr) == want
    kept = simhash.near_dedup(table(spark, rows))
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for c in brute_components(ids, fps) if c is not None})
    assert kept.where("doc_id IS NULL").count() == 1


def test_golay_keys_meet_within_two_bits():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 23, 300)
    for flips in (0, 1, 2):
        b = a.copy()
        for _ in range(flips):
            b ^= 1 << r.integers(0, 23, 300)
        keys = [set() for _ in range(600)]
        for base, x in ((0, a), (300, b)):
            for row, key in zip(*simhash.fuzzy_indices(x, 23)):
                keys[base + row].add(int(key))
        assert all(keys[i] & keys[300 + i] for i in range(300))
        assert {len(k) for k in keys} <= {1, 6}


def test_linked_chain_and_crowds(spark):
    """Crowded buckets: a chain of fingerprints two bits apart, a whole ball, and strays."""
    fps = [(1 << (2 * k)) - 1 for k in range(20)] + [(0xABC << 40) ^ (1 << b) for b in range(64)]
    df = spark.createDataFrame([((x if x < 1 << 63 else x - (1 << 64)),) for x in set(fps)], "fp bigint")
    roots = {r["node"] % 2**64: r["root"] for r in connected_components(simhash.links(df)).collect()}
    want = brute_components(list(range(len(set(fps)))), sorted(set(fps)))
    groups = {}
    for x, c in zip(sorted(set(fps)), want):
        groups.setdefault(c, set()).add(x)
    for members in groups.values():
        if len(members) > 1:
            assert len({roots[m] for m in members}) == 1
    assert len(set(roots.values())) == sum(len(m) > 1 for m in groups.values())


def test_simhash_empty(spark):
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_fingerprint_blocks(monkeypatch):
    text = words(1, 300).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


# ---- language ID ----

SYLLABLES = {"aa": ("the", "ing", "wh", "er"), "bb": ("eau", "oi", "que", "ou"), "cc": ("sch", "ung", "ein", "zu")}


def test_langid(spark):
    rows = [(k, words(k, 20 + k % 30, SYLLABLES[la]), la, None) for k in range(300) for la in [sorted(SYLLABLES)[k % 3]]]
    model = langid.train(table(spark, rows[:240]))
    got = {r["doc_id"]: r for r in langid.identify(table(spark, rows[240:] + ODD), model).collect()}
    right = sum(got[k]["lang_pred"] == la for k, _, la, _ in rows[240:])
    assert right >= 58 and all(0 <= r["lang_score"] <= 1 for r in got.values())
    for k in (900, 901, 902, 903):
        assert (got[k]["lang_pred"], got[k]["lang_score"], got[k]["lang_accepted"]) == ("und", 0.0, False)
    assert got[904]["lang_pred"] in SYLLABLES
    assert all(got[k]["lang_accepted"] for k, _, la, _ in rows[240:] if got[k]["lang_pred"] == la)


def test_langid_long_text_in_slices(spark, monkeypatch):
    text = words(3, 4000, SYLLABLES["aa"])
    data = np.frombuffer(f" {text} ".encode(), np.uint8)

    def total():
        return sum(np.bincount(b, minlength=langid.BUCKETS) for _, b in langid.grams(data, np.array([0, len(data)])))

    whole = total()
    monkeypatch.setattr(langid, "SLICE", 1000)
    assert (total() == whole).all()


def test_langid_without_labels(spark):
    model = langid.train(table(spark, ODD[2:4]))
    assert {r["lang_pred"] for r in langid.identify(table(spark, [(1, "some words", None, None)]), model).collect()} == {"und"}
    assert langid.identify(table(spark, []), model).count() == 0


# ---- quality ----


def test_quality_held_out(spark):
    good = [(k, words(k, 60), None, None) for k in range(300)]
    bad = [(1000 + k, words(k, 40).upper().replace(" ", "!! ") if k % 2 else "again " * 50, None, None) for k in range(100)]
    docs = table(spark, good + bad + ODD)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad] + [(5, None), (None, 1)], "doc_id bigint, quality int")
    rows = quality.measured(docs.select("doc_id", "text")).cache()
    model = quality.train(quality.labelled(rows.where(crc32_mod("doc_id", 5) != 0), labels))
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    held = [k for k, *_ in good + bad if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.3) == (k < 1000) for k in held) >= 0.97 * len(held)
    assert all(0 <= v <= 1 for v in got.values())
    none = quality.train(quality.labelled(rows, labels.where("false")))
    assert {r["quality_score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_pooled():
    assert quality.pooled(np.array([0.0, 1.0, 0.0, 1.0]), np.array([1, 1, 3, 1])).tolist() == [0.0, 0.25, 0.25, 1.0]


def test_statistics_in_slices(monkeypatch):
    text = (words(5, 500) + " twice twice ").encode()
    whole = quality.statistics(text)
    assert (quality.statistics(b"") == 0).all()
    monkeypatch.setattr(quality, "SLICE", 10**9)
    assert np.allclose(quality.statistics(text), whole)


# ---- mixing ----


def brute_targets(sizes):
    """sizes in source order; water filling by repeated resharing."""
    weight = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    total, cap = 1.5 * sum(sizes), [2 * s for s in sizes]
    full, out = set(), [0.0] * len(sizes)
    while True:
        rest = total - sum(cap[k] for k in full)
        free = [k for k in range(len(sizes)) if k not in full]
        share = sum(weight[k] for k in free)
        out = [cap[k] if k in full else rest * weight[k] / share for k in range(len(sizes))]
        over = {k for k in free if out[k] > cap[k]}
        if not over:
            return out
        full |= over


def test_mixing(spark):
    r = random.Random(2)
    rows = [(k, words(k, r.choice([5, 20, 60, 200])), None, r.choice(["b", "a", "ä", "zz", None])) for k in range(400)] + [(k, None, None, "empty") for k in (800, 801)] + ODD[:4]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    again = mixing.mix(table(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    source = {k: s for k, _, _, s in rows}
    size = lambda t: len((t or "").split())
    order = sorted({s for s in source.values() if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(size(t) for _, t, _, s in rows if s == o) for o in order]
    for o, total, want in zip(order, sizes, brute_targets(sizes)):
        own = [g for g in got if source[g["doc_id"]] == o]
        assert all(g["source_size"] == total and abs(g["target"] - want) < 1e-6 * max(1, want) for g in own)
        taken = sum(g["copies"] * g["size"] for g in own)
        assert abs(taken - want) <= max(0.02 * want, 5), (o, taken, want)
    assert all(0 <= g["copies"] <= 2 for g in got)
    assert mixing.mix(table(spark, [])).count() == 0


def test_mixing_repeats_and_hot_copies(spark):
    rows = [(7, "same text here", None, "hot")] * 50 + [(k, words(k, 10), None, "b") for k in range(20)]
    got = mixing.mix(table(spark, rows)).collect()
    hot = sum(g["copies"] * g["size"] for g in got if g["doc_id"] == 7 and g["size"] == 3)
    assert abs(hot - next(g["target"] for g in got if g["size"] == 3)) <= 3
    out = mixing.mixed(table(spark, rows[50:]))
    assert out.columns == table(spark, []).columns and out.count() == sum(g["copies"] for g in mixing.mix(table(spark, rows[50:])).collect())


# ---- packing ----


def test_packing_round_trip(spark):
    rows = [(k, words(k, 5 + (k * 37) % 900), None, None) for k in range(60)] + [(70, "<|endoftext|> in text", None, None), (71, words(5, 6000), None, None)] + ODD
    got = packing.pack_documents(table(spark, rows).repartition(3), *packing.default_paths()).collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_paths()[0])
    want = {}
    for k, t, *_ in rows:
        want.setdefault(k, []).append(np.array(exact.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    for k, ids in want.items():
        pieces = [g for g in got if g["doc_id"] == k]
        assert sum(g["length"] for g in pieces) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for g in sorted(pieces, key=lambda g: g["start"]):
                assert g["start"] == at and g["doc_tokens"] == len(ids[0])
                assert g["ids_crc32"] == zlib.crc32(ids[0][at : at + g["length"]].tobytes())
                at += g["length"]
    sequences = {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.2 * total
    assert packing.pack_documents(table(spark, []), *packing.default_paths()).count() == 0


def test_padding_is_small_in_a_block():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 5000, 1500)
    used = [sum(n for _, _, n in pieces) for _, pieces in packing.pack_block(sizes, sizes, packing.Limits(), True)]
    assert sum(used) == sizes.sum()
    assert sum(0 if u & (u - 1) == 0 else 2048 - u for u in used) < 0.005 * sizes.sum()


def test_examples_keep_all_limits(spark):
    r = random.Random(4)
    rows = [(k, t, r.randint(0, min(t, 600))) for k in range(300) for t in [r.randint(1, 700)]] + [(900, 3000, 1), (901, 10, 900), (902, None, None)]
    limits = packing.Limits(tokens=1024, segments=4, loss_tokens=600)
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id bigint, tokens int, loss_tokens int"), limits).collect()
    assert {g["example_id"] for g in got if g["sequence_id"] is None} == {900, 901} and len(got) == 303
    bins = {}
    for g in got:
        if g["sequence_id"] is not None:
            bins.setdefault(g["sequence_id"], []).append(g)
    for own in bins.values():
        assert sum(g["tokens"] or 0 for g in own) <= 1024 and len(own) <= 4 and sum(g["loss_tokens"] or 0 for g in own) <= 600
    least = max(*(sum(g[c] or 0 for own in bins.values() for g in own) / most for c, most in (("tokens", 1024), ("loss_tokens", 600))), 301 / 4)
    assert len(bins) <= 1.35 * least + 4


# ---- language model ----


def test_lm_against_brute_force(spark, monkeypatch):
    rows = [(k, words(k, 30 + k % 50, SYLLABLES[la]), la, None) for k in range(160) for la in [sorted(SYLLABLES)[k % 3]]] + ODD
    docs = table(spark, rows).select("doc_id", (crc32_mod("doc_id", 7) == 2).alias("held_out"), "text", "lang")
    monkeypatch.setattr(lm, "FREQUENT", 40)
    corpus = lm.read_corpus(docs)
    got = lm.score(docs, corpus).collect()
    assert len(got) == len(rows)
    split = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts = {}
    for k, t, *_ in rows:
        if not held(k):
            for w in split(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert (corpus.tokens, corpus.distinct) == (n, v)
    want = sorted((repr(k), held(k), len(split(t)), sum(w in counts for w in split(t)), round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in split(t)), 6)) for k, t, *_ in rows)
    assert sorted((repr(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["score"] < 0 for g in got)


def test_lm_empty(spark):
    docs = table(spark, []).select("doc_id", F.lit(False).alias("held_out"), "text", "lang")
    assert lm.score(docs, lm.read_corpus(docs)).count() == 0


@pytest.mark.parametrize("size", [1, 3])
def test_lm_few_rows(spark, size):
    docs = table(spark, ODD[:size]).select("doc_id", F.lit(False).alias("held_out"), "text", "lang")
    assert lm.score(docs, lm.read_corpus(docs)).count() == size
