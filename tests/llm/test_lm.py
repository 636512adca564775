"""The language model against a scorer that goes bit by bit, and what a probability must obey."""

import random

import numpy as np
import pytest
import xxhash

from casewright.llm import lm, wordmix
from casewright.llm.blend import CELLS, FINE, LEVELS, STEPS
from pyspark.sql import functions as F

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def text_of(seed, words, lexicon=300):
    r = random.Random(seed)
    lex = random.Random(1)
    names = ["".join(lex.choice(["ba", "no", "ri", "tu", "sel"]) for _ in range(lex.randint(1, 4))) for _ in range(lexicon)]
    return " ".join(names[min(lexicon - 1, int(r.paretovariate(0.7)) - 1)] + ("x" * r.randint(1, 3) if r.random() < 0.05 else "") for _ in range(words))


def chain(seed):
    """Words each of which is followed by one of two others."""
    r, at, out = random.Random(seed), seed % 40, []
    for _ in range(80):
        out.append(f"k{at}")
        at = (at * 7 + r.choice([1, 2])) % 40
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus_and_docs(spark):
    passage = " ".join(f"p{k % 90} no" for k in range(120))
    texts = [text_of(k, 40 + k % 60) for k in range(200)] + [text_of(900 + k, 10) + " " + passage for k in range(6)] + ["", None, "One one ONE " * 30, passage]
    rows = [(k, k % 7 == 2, t, "l") for k, t in enumerate(texts)]
    rows += [(1000 + k, False, chain(k), "l") for k in range(60)] + [(2000 + k, True, chain(500 + k), "l") for k in range(30)]
    rows += [(3000 + k, True, " ".join(random.Random(k).sample(chain(500 + k).split(), 80)), "l") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string, lang string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "FREQUENT", 60)
        corpus = lm.read_corpus(docs)
    return corpus, docs, rows


def entry_cost(mixer, before, i, ids, befores):
    """log10 probability of one token, bit by bit."""
    tree, word = mixer.tree, ids[i]
    last = next((j for j in range(i - 1, -1, -1) if befores[j] == befores[i]), None)
    level = 0
    if last is not None:
        level = 1
        while level < 3 and last >= level and befores[i - level] == befores[last - level]:
            level += 1
    guess = [] if last is None else tree.sign[tree.start[ids[last]] :][: tree.length[ids[last]]].tolist()
    total, right = 0.0, True
    for d in range(tree.length[word]):
        at = tree.start[word] + d
        node, sign = int(tree.node[at]), float(tree.sign[at])
        c = (before + 1) * 0x85EBCA6B & M32
        c ^= c >> 15
        s = (c ^ (node * 0x9E3779B1 + 0x7F4A7C15 & M32)) * 0xC2B2AE35 & M32
        s = ((s ^ s >> 13) * 0x27D4EB2F & M32) >> (32 - mixer.bits)
        state = int(mixer.state[s])
        own = mixer.odds[0][node] * sign
        after = ((state & FINE) * (24 / FINE) - 12) * sign
        here = level if right and level else 0
        match = 0.0 if not here else (1.0 if guess[d] == sign else -1.0)
        gate = (state >> 12) * LEVELS + here
        w = mixer.blend.weights
        z = min(11.9, max(-11.9, float(w[0][gate] * own + w[1][gate] * after + w[2][gate] * match)))
        total += float(mixer.blend.cost[gate][round(z * STEPS) + CELLS])
        right = right and match > 0
    return total


def plain_scores(corpus, rows):
    """Scores of all rows: tree bits token by token, rare words, then repeated chunks."""
    reader, known = corpus.reader, {bytes(r["word"]): (r["counts"][0] or 0) for r in corpus.vocabulary.collect()}
    out, parts, table = [], [], {}
    for _, held_out, text, _ in rows:
        words = (text or "").encode().lower().split() + [lm.END]
        ids = [reader.index.get(w, reader.escape) for w in words]
        befores = [reader.escape + 1, *ids[:-1]]
        cost = [entry_cost(corpus.mixer, befores[i], i, ids, befores) for i in range(len(ids))]
        h = [xxhash.xxh64_intdigest(w) for w in words]
        cuts = [0] + [i for i in range(2, len(h)) if ((((h[i - 1] ^ h[i - 2] * 0xD6E8FEB86659FD93 & M64) * 0x9E3779B97F4A7C15 & M64) >> 40) % lm.CHUNK_WORDS) == 0]
        own = [(tuple(words[a:b]), sum(cost[a:b])) for a, b in zip(cuts, [*cuts[1:], len(h)])]
        parts.append([(own[k - 1][0], *own[k]) for k in range(1, len(own))])
        if not held_out:
            for before, chunk, _ in {(p[0], p[1], 0) for p in parts[-1]}:
                at = table.setdefault(before, {})
                at[chunk] = at.get(chunk, 0) + 1
        rare = [w for w in words if w not in reader.index]
        spelled = corpus.speller.log10(rare, np.zeros(len(rare), int))
        total = sum(cost) + corpus.prior[0]
        for w, s in zip(rare, spelled):
            n, d = corpus.rare_tokens[0], corpus.rare_words[0]
            total += np.log10(max(0.0, known[w] - 0.5) / n + 0.5 * d / n * 10**s)
        out.append(total)
    hits = 0
    for k, own in enumerate(parts):
        for before, chunk, cost in own:
            best = table.get(before, {})
            n, total = max(best.values(), default=0), sum(best.values())
            if n >= 2:
                if [c for c in best if best[c] == n] == [chunk]:
                    out[k] += np.log10((n - 1) / total) - cost
                    hits += 1
                elif list(best.values()).count(n) == 1:
                    out[k] += np.log10((total - n + 1) / total)
    return out, hits


def test_scores_bit_by_bit(corpus_and_docs):
    corpus, docs, rows = corpus_and_docs
    scores, hits = plain_scores(corpus, rows)
    want = {r[0]: s for r, s in zip(rows, scores)}
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, corpus).collect()}
    assert hits > 5
    assert max(abs(got[k] - want[k]) / max(1, abs(want[k])) for k in got) < 1e-3


def test_order_counts(corpus_and_docs):
    """The same words in another order have another score, a lower one."""
    corpus, docs, _ = corpus_and_docs
    got = {r["doc_id"]: r["score"] for r in lm.score(docs.where("doc_id >= 2000"), corpus).collect()}
    assert all(got[2000 + k] > got[3000 + k] for k in range(30))


def test_tree_is_a_probability(corpus_and_docs):
    """Whatever stands before, all words and the escape add up to one."""
    corpus, _, _ = corpus_and_docs
    n = corpus.reader.escape + 1
    for history in ([3, 5, 3], [0, 1, 0, 1, 0], [n]):
        ids = np.concatenate([np.append(history, w) for w in range(n)]).astype(np.int32)
        unit = np.repeat(np.arange(n), len(history) + 1)
        before = np.concatenate([[n], ids[:-1]]).astype(np.int32)
        before[:: len(history) + 1] = n
        if history == [n]:
            ids[0::2], before[1::2] = 0, 0
        cost = corpus.mixer.log10(wordmix.Tokens(ids, before, np.zeros(len(ids), int), unit))
        assert abs((10 ** cost[len(history) :: len(history) + 1]).sum() - 1) < 1e-3


def test_spelling_is_a_probability_and_has_no_floor(corpus_and_docs):
    speller = corpus_and_docs[0].speller
    alphabet = [bytes([b]) for b in range(256) if b not in b" \t\n\x0b\x0c\r"]
    some = [*alphabet, *(a + b for a in alphabet[::5] for b in alphabet)]
    assert 0 < (10 ** speller.log10(some, np.zeros(len(some), int))).sum() <= 1
    long = speller.log10([b"qz" * 1000, b"qz" * 50_000, b"\xe4\xb8\xad" * 40_000], np.zeros(3, int))
    assert long[1] < 20 * long[0] < 0 and np.isfinite(long).all() and long[2] < -1000


def test_long_texts(spark):
    word = "qz" * 50_000
    rows = [(1, True, word), (2, True, word + "q"), (3, True, text_of(4, 300_000)), (4, True, " " * 2_000_000)] + [(10 + k, False, text_of(k, 50)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").selectExpr("*", "CAST(NULL AS string) lang")
    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in lm.score(docs, lm.read_corpus(docs)).collect()}
    assert got[2][0] < got[1][0] < -1000 and got[3][1] == 300_001 and got[4][1] == 1


def test_unknown_words_are_refused(spark, corpus_and_docs):
    with pytest.raises(Exception, match="has not met"):
        lm.score(spark.createDataFrame([(1, True, "neverseenbefore")], "doc_id long, held_out boolean, text string"), corpus_and_docs[0]).collect()


def test_documents_that_occur_twice(spark):
    """Texts with a copy in training take fewer bits than others, in training and held out."""
    texts = [" ".join(f"u{random.Random(k * 997 + i).randint(0, 3000)}" for i in range(200)) for k in range(300)]
    rows = [(k, k % 7 == 2, t, None) for k, t in enumerate(texts)] + [(1000 + k, False, t, None) for k, t in enumerate(texts[:30])] + [(2000 + k, False, t, None) for k, t in enumerate(texts[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string, lang string")
    found = lm.score(docs, lm.read_corpus(docs)).select("doc_id", lm.bits_per_byte(F.col("score"), F.col("n_bytes")).alias("b")).collect()
    again = [r["b"] for r in found if r["doc_id"] % 1000 < 30]
    once = [r["b"] for r in found if 30 <= r["doc_id"] < 1000]
    assert np.mean([b < min(once) for b in again]) > 0.9
