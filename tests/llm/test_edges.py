"""Long texts, repeats, clashing names, and what must be rejected."""

import random

import numpy as np
import pytest

from casewright.llm import langid, mixing, nearcopies, packing, quality, simhash, urls

#: Syllables of invented languages; unseen is in no training.
SYLLABLES = {
    "aa": "the ing and er on re sh ly ha en".split(), "bb": "ein ich der sch ung aus vor mit pf tz".split(), "cc": "que les ont ai oux eau pre ier du ch".split(),
    "dd": "los cion ar ez ado os an ti un gar".split(), "unseen": "krz wy szy nie ow ska pol gdy jem mu".split(),
}


def text_of(language, seed, words=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[language]) for _ in range(r.randint(1, 3))) for _ in range(words))


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 2_000_000, "a" + " " * 300_000 + "b"])
def test_packing_of_long_blanks(text):
    from tokenizers import Tokenizer

    paths = packing.default_paths()
    want = Tokenizer.from_file(paths[0]).encode(text, add_special_tokens=False).ids
    assert packing.encoder(*paths)(text).tolist() == [*want, packing.END]


def test_statistics_however_cut(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "bb", "CCC", "d!", "é9"]) for _ in range(n)) + "\nx  y \n" for n in (5, 400, 9000)] + ["z" * 5000 + " z " + "z" * 3000, " " * 4000, "a a\ta\na"]
    whole = [quality.statistics(t.encode()) for t in texts]
    for size in (1, 7, 1000):
        monkeypatch.setattr(quality, "SLICE", size)
        for text, want in zip(texts, whole):
            assert b"".join(quality.slices(text.encode(), size)) == text.encode()
            assert np.allclose(quality.statistics(text.encode()), want, atol=1e-12)


def languages(spark, left_out=()):
    rows = [(i, text_of(k, i), k) for i, k in enumerate(["aa", "bb", "cc", "dd"] * 60) if k not in left_out]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_rejection(spark):
    """A language never seen, letter junk and reversed words go; clean and two-language documents stay."""
    docs = languages(spark)
    model = langid.train(docs)
    half = [(9000 + i, text_of("aa", 5000 + i, 30) + " " + text_of("cc", 6000 + i, 30)) for i in range(30)]
    clean = [(8000 + i, text_of(k, 7000 + i)) for i, k in enumerate(["aa", "bb", "cc", "dd"] * 10)]
    bad = [(7000 + i, langid.junk(text_of("aa", i), i % 4, i)) for i in range(40)] + [(7100 + i, text_of("unseen", 100 + i)) for i in range(40)]
    found = langid.identify(spark.createDataFrame(half + clean + bad, "doc_id long, text string"), model)
    kept = {r["doc_id"] for r in found.where("lang_accepted").collect()}
    assert len([r for r in half + clean if r[0] not in kept]) <= 1
    assert len([r for r in bad if r[0] in kept]) <= 4
    without = langid.train(languages(spark, ["bb"]))
    unseen = langid.identify(docs.where("lang = 'bb'"), without)
    assert unseen.where("lang_accepted").count() <= 6


def test_calibration():
    scores, flags = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([False, False, False, True, True])
    assert 0.3 < langid.calibrated(scores, flags) < 0.8
    assert langid.calibrated(np.array([]), np.array([], bool)) == 0.5


CLASHES = ["row_number", "_row_number", "mix_row", "mix_copies", "mix_copy", "padded", "letters", "_padded", "row_key", "_key", "key", "size", "copies", "row", "fp", "root", "first", "url_segment", "answer", "asked_at", "h", "s", "at", "pattern", "bin", "n", "statistics"]


def test_clashing_names(spark):
    rows = [(i, text_of("aa", i % 6), "s", f"http://site{i}.example.com/a", i, *range(len(CLASHES))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, url string, fetched_at long, " + ", ".join(f"{c} int" for c in CLASHES))
    for out in (simhash.near_dedup(docs), nearcopies.drop_near_copies(docs)):
        got = out.collect()
        assert out.columns == docs.columns and sorted(r["doc_id"] for r in got) == list(range(6))
        assert all(r[c] == k for r in got for k, c in enumerate(CLASHES))
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and all(r[c] == k for r in taken.collect() for k, c in enumerate(CLASHES))
    model = langid.train(docs.withColumnRenamed("source", "lang"))
    assert langid.identify(docs, model).where(" AND ".join(f"{c} = {k}" for k, c in enumerate(CLASHES))).count() == 12
    entries = spark.createDataFrame([("example.com", "ads", "add", 3)], "pattern string, category string, action string, effective_at long")
    assert urls.url_filter(docs, entries).where("blocked").where(" AND ".join(f"{c} = {k}" for k, c in enumerate(CLASHES))).count() == 9


def test_repeats_get_their_own_copies(spark):
    """Fifty equal rows and a large other source: the mix takes as many of the fifty as it says."""
    rows = [(1, "a b c d", "x")] * 50 + [(None, "e f", "x")] * 5 + [(2 + i, "w " * (i % 9 + 1), "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(r["doc_id"], r["size"]): r["n"] for r in mixing.mix(docs).groupBy("doc_id", "size").agg({"copies": "sum"}).toDF("doc_id", "size", "n").where("n > 0").collect()}
    got = {}
    for r in mixing.mixed(docs).collect():
        at = (r["doc_id"], len(r["text"].split()))
        got[at] = got.get(at, 0) + 1
    assert got == want and got[(1, 4)] > 0


def test_texts_under_one_id_stay(spark):
    rows = [(1, text_of("aa", 1)), (1, text_of("aa", 2)), (1, text_of("aa", 1)), (2, text_of("aa", 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (simhash.near_dedup(docs), nearcopies.drop_near_copies(docs)):
        assert sorted(r["text"] for r in out.collect()) == sorted({r[1] for r in rows})


def test_crowds_of_near_copies(spark):
    """A crowd of 200 round one source, near it but not always near one another, and a chain whose ends differ."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    crowd = []
    for k in range(200):
        words = list(base)
        for i in r.sample(range(400), 7):
            words[i] = f"c{k}x{i}"
        crowd.append(" ".join(words))
    chain = [" ".join(f"h{i}" for i in range(25 * k, 25 * k + 400)) for k in range(30)]
    texts = [" ".join(base), *crowd, *chain]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in nearcopies.drop_near_copies(docs).collect()) == [0, 201]


def test_hosts(spark):
    want = {
        "http://user@bad.com/x": "bad.com", "http://u:p@bad.com:80/x": "bad.com", "http://bad.com./x": "bad.com", "HTTP://BAD.com": "bad.com",
        "http://a@b@bad.com?q=@x": "bad.com", "http://[2001:db8::1]:8080/x": "[2001:db8::1]", "http:///x": None, "bad.com/x": None, "ftp://h#f": "h", None: None,
    }
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r["url"]: r["h"] for r in df.select("url", urls.host(df["url"]).alias("h")).collect()} == want
