"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and one end. The at most FREQUENT most frequent words are coded as
paths of a Huffman tree (wordmix): their bits are predicted by the text's class, by the hashed word
before, and by what followed the same words earlier in the text. All other words take the tree's
escape, and then either their plain frequency among such words or, by absolute discounting, their
spelling (spelling), whose bits have predictors of their own. Long repeated passages are told by a
third kind of context: a text is cut into chunks where the hash of two neighbouring words says so,
and the chunk before predicts, as one bit, the chunk that follows it in most of at least two training
texts; what is predicted so needs no tree bits. The log-odds of predictors are combined by gated
weights and refined by an adaptive map (blend).

Where the numbers come from: word counts, chunk counts, distinct words and context bits are counted
over all training texts, without caps, and joined by Spark; they grow with the corpus. The tables of
context bits that every task holds have a slot for every eighth training token (spelling: for every
second distinct word), up to 2 ** 21 slots (2 ** 19 for the last bytes), which is what a task can hold
beside its rows. Weights and map are learned by partition on every TUNE-th training text (word), with the
tables counted without those, and averaged; the final tables have them.

The text's class is the language whose words it holds most likely, decided by word frequencies from
at most about CLASS_SAMPLE labelled documents (a label itself is never read when scoring); with more
than CLASSES languages, texts of the others take the likeliest of these. A text's probability is its
class's prior times the product over its parts, a term of the mixture over classes, and so a
probability: equal texts score alike wherever they are.

Defined results: null texts are empty (the end alone); null doc_ids count as the empty id in the
fold; repeated rows are scored each; without labels there is one class; an empty table gives an
empty result; further columns are ignored. Words, contexts and chunks meet by 64-bit hash; a text
over a MiB is read in slices, each with a memory of its own for matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import spelling, wordmix
from casewright.llm.blend import CELLS, GATES, TALLY, Blend, Tally, added_outcomes, averaged, outcome_rows, refined, tables, weight_rows
from casewright.llm.shared import WORD, crc32_mod, slices, staged, table, text_arrays

END = b"\n"
FREQUENT = 1 << 16
TUNE = 16
CLASSES = 32
CLASS_SAMPLE = 2_000
CLASS_WORDS = 4_000
HELD_WORDS = 400_000
#: Tokens of several texts that are worked on together.
GROUP = 1 << 17
#: A chunk ends, on average, after so many words; a power of two.
CHUNK_WORDS = 32
#: Frequent chunks (one in HOT) are told by a broadcast of at most HOT rows.
HOT = 1000
DISCOUNT = 0.5
ODD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MATRIX = "cell long, value double, n long"
COUNTS = "cell long, n long"


@dataclass(frozen=True)
class Classes:
    """Word log-frequencies by class, from a bounded sample of labelled documents."""

    words: dict[bytes, int]
    logs: np.ndarray
    count: int

    def of(self, words) -> int:
        """Class of a text from its words."""
        if self.count == 1:
            return 0
        at = places(self.words, words, -1)
        counts = np.bincount(at[at >= 0], minlength=len(self.words))
        return int((counts.astype(np.float64) @ self.logs).argmax())


def places(index: dict[bytes, int], words, missing: int) -> np.ndarray:
    """Number of each word."""
    return np.fromiter(map(index.get, words, repeat(missing)), np.int32, len(words))


def find_classes(docs: DataFrame) -> Classes:
    """Classes from the lang of docs (held_out, text, lang); the caller's held-out rows are left out."""
    labelled = docs.where("NOT held_out AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES).collect()
    names = sorted(r["lang"] for r in sizes)
    if len(names) < 2:
        return Classes({}, np.zeros((0, 1)), 1)
    share = min(1.0, CLASS_SAMPLE / sum(r["count"] for r in sizes))
    drawn = labelled.where(F.col("lang").isin(names)).where(F.pmod(F.xxhash64("text", F.lit("class")), F.lit(1 << 30)) < share * (1 << 30))
    counts = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"))).alias("word")).groupBy("lang", "word").count()
    top = counts.orderBy(F.desc("count"), "word", "lang").limit(CLASS_WORDS).collect()
    table_ = {r["word"].encode(): np.full(len(names), 0.5) for r in top}
    for r in top:
        table_[r["word"].encode()][names.index(r["lang"])] += r["count"]
    totals = sum(table_.values(), np.ones(len(names)))
    return Classes({w: i for i, w in enumerate(table_)}, np.log(np.array(list(table_.values())) / totals), len(names))


def _count_words(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for k, own in enumerate(counts):
                if own:
                    yield pa.record_batch([pa.array(list(own), pa.binary()), pa.array(np.full(len(own), k, np.int32)), pa.array(list(own.values()), pa.int64())], ["word", "class", "c"])
                    own.clear()

        counts: list[Counter[bytes]] = [Counter() for _ in range(classes.count)]
        for batch in batches:
            for held_out, text in zip(batch.column(0).to_pylist(), text_arrays(batch, "text")):
                words = text.as_py().lower().split()
                own = counts[classes.of(words)]
                if held_out:
                    for word in words:
                        own.setdefault(word, 0)
                    own.setdefault(END, 0)
                else:
                    own.update(words)
                    own[END] += 1
                if sum(map(len, counts)) > HELD_WORDS:
                    yield from rows()
        yield from rows()

    return run


@dataclass
class Text:
    """A text's words as leaves of the tree, by slice; the words that take the escape; its class."""

    ids: list[np.ndarray]
    rare: list[bytes]
    kind: int
    size: int


class Reader:
    """Texts as leaves of the tree: the dictionary's words, then the escape; a last number stands before a text."""

    def __init__(self, words: list[bytes], classes: Classes):
        self.words, self.escape = words, len(words)
        self.index = {w: i for i, w in enumerate(words)}
        self.end = self.index[END]
        self.logs = np.zeros((len(words) + 1, classes.count))
        for word, row in classes.words.items():
            if word in self.index:
                self.logs[self.index[word]] = classes.logs[row]

    def text(self, raw: bytes) -> Text:
        ids, rare, size = [], [], 1
        for part in slices(raw.lower()):
            words = part.split()
            own = places(self.index, words, self.escape)
            rare.extend(compress(words, (own == self.escape).tolist()))
            size += sum(map(len, words)) + len(words)
            ids.append(own)
        ids.append(np.array([self.end], np.int32))
        if len(ids) > 1:
            ids[-2:] = [np.concatenate(ids[-2:])]
        kind = int(sum(self.logs[x].sum(axis=0) for x in ids).argmax()) if self.logs.shape[1] > 1 else 0
        return Text(ids, rare, kind, size)

    def tokens(self, texts: list[Text]) -> tuple[wordmix.Tokens, np.ndarray]:
        """The tokens of texts, and the number of the text of each."""
        parts = [(t, k, part) for t, text in enumerate(texts) for k, part in enumerate(text.ids)]
        sizes = np.array([len(p) for _, _, p in parts])
        ids = np.concatenate([p for _, _, p in parts])
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        starts = np.cumsum(sizes) - sizes
        before[starts[[k == 0 for _, k, _ in parts]]] = self.escape + 1
        owner = np.repeat([t for t, _, _ in parts], sizes)
        kinds = np.array([t.kind for t in texts])
        return wordmix.Tokens(ids, before, kinds[owner], np.repeat(np.arange(len(parts)), sizes)), owner

    def groups(self, texts: Iterator[bytes]) -> Iterator[list[Text]]:
        held, size = [], 0
        for raw in texts:
            held.append(self.text(raw))
            size += sum(map(len, held[-1].ids))
            if size >= GROUP:
                yield held
                held, size = [], 0
        if held:
            yield held


@dataclass(frozen=True)
class Corpus:
    """What the training texts say. vocabulary has (word, c, counts): counts lists, by class, the
    training count or null where no text of that class has the word; rare words are known ones outside
    the dictionary: their tokens and number by class."""

    vocabulary: DataFrame
    reader: Reader
    counts: np.ndarray
    tokens: int
    distinct: int
    prior: np.ndarray
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    mixer: wordmix.Mixer
    speller: spelling.Speller


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_py() for x in text_arrays(batch, "text"))


def _slots(number: int, share: int, least: int, most: int) -> int:
    """Bits of a table with a slot for each share of number."""
    return min(most, max(least, (number // share).bit_length()))


def _learned(rows: DataFrame, first: np.ndarray, feed) -> Blend:
    """Weights and map, learned by partition and averaged; feed(batch, blend) gives inputs and gates of bits."""
    shape = first.shape

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blend, speed, seen = Blend(first.copy()), np.zeros(shape), 0
        for batch in batches:
            for x, gate in feed(batch, blend):
                blend.descend(x, gate, speed)
                seen += len(gate)
        if seen:
            yield weight_rows(blend.weights, seen)

    weights = averaged(rows.mapInArrow(descend, MATRIX), shape, first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GATES, 2 * CELLS + 1), np.int64)
        for batch in batches:
            for x, gate in feed(batch, Blend(weights)):
                total += Blend(weights).outcomes(x, gate)
        yield outcome_rows(total)

    return Blend(weights, refined(added_outcomes(rows.mapInArrow(count, COUNTS))))


def word_mixer(texts: DataFrame, reader: Reader, counts: np.ndarray, tokens: int) -> wordmix.Mixer:
    """The mixer of tree bits from training texts (tune, text); counts are the leaves' by class."""
    spark = texts.sparkSession
    bits = _slots(tokens, 8, 12, 21)
    tree = wordmix.Tree(counts.sum(axis=0))
    whole = counts.sum(axis=0) / max(1.0, counts.sum())
    odds = tree.odds(counts + 1000 * whole + 1e-3)
    shared = spark.sparkContext.broadcast((reader, tree))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tree = shared.value
        total = Tally((bits,))
        for batch in batches:
            flags = batch.column(0).to_numpy(zero_copy_only=False)
            raw = list(_bytes(batch))
            for tune in (0, 1):
                for group in reader.groups(compress(raw, (flags == tune).tolist())):
                    for at in reader.tokens(group)[0].slots(tree, bits):
                        total.add(tune, 0, at)
        yield from total.rows()

    apart, final = tables(texts.mapInArrow(tally, TALLY), (bits,))
    tuning = spark.sparkContext.broadcast(wordmix.Mixer(tree, odds, apart[0], bits, Blend(wordmix.first_weights())))

    def feed(batch: pa.RecordBatch, blend: Blend):
        mixer = tuning.value
        for group in shared.value[0].groups(_bytes(batch)):
            for b in shared.value[0].tokens(group)[0].parts(mixer.tree, bits):
                yield mixer.inputs(b)

    blend = _learned(texts.where("tune = 1"), wordmix.first_weights(), feed)
    return wordmix.Mixer(tree, odds, final[0], bits, blend)


def speller_of(words: DataFrame, distinct: int) -> spelling.Speller:
    """The speller from distinct words (tune, word, class)."""
    spark = words.sparkSession
    bits = (*[_slots(distinct, 2, 10, 19)] * spelling.ORDERS, _slots(distinct, 1, 12, 21))

    def spelled(batch: pa.RecordBatch, keep=None) -> Iterator[spelling.Spelled]:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            if keep is not None:
                part = part.filter(pa.array(part.column(0).to_numpy(zero_copy_only=False) == keep))
            yield spelling.Spelled.of(part.column(1).to_pylist(), part.column(2).to_numpy(zero_copy_only=False))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Tally(bits)
        for batch in batches:
            for tune in (0, 1):
                for symbols in spelled(batch, tune):
                    for span in symbols.spans():
                        ones = spelling.ONES[symbols.byte[span]].ravel()
                        for k in range(spelling.ORDERS + 1):
                            total.add(tune, k, (symbols.slot(span, k, bits[k]) << np.uint32(1)) | ones)
        yield from total.rows()

    apart, final = tables(words.mapInArrow(tally, TALLY), bits)
    tuning = spark.sparkContext.broadcast(apart)

    def feed(batch: pa.RecordBatch, blend: Blend):
        speller = spelling.Speller(tuning.value, bits, blend)
        for symbols in spelled(batch):
            for span in symbols.spans():
                yield speller.inputs(symbols, span)

    return spelling.Speller(final, bits, _learned(words.where("tune = 1"), spelling.first_weights(), feed))


def read_corpus(docs: DataFrame) -> Corpus:
    """Corpus of docs (held_out, text, lang)."""
    classes = find_classes(docs)
    counts = docs.select("held_out", "text").mapInArrow(_count_words(classes), "word binary, class int, c long")
    each = [F.sum(F.when(F.col("class") == k, F.col("c"))).alias(f"c{k}") for k in range(classes.count)]
    vocabulary = counts.groupBy("word").agg(F.sum("c").alias("c"), *each)
    vocabulary = staged(vocabulary.select("word", "c", F.array(*(f"c{k}" for k in range(classes.count))).alias("counts")), "lm-words")
    known = vocabulary.where("c > 0")
    by_class = [F.sum(F.coalesce(F.col("counts")[k], F.lit(0))).alias(f"t{k}") for k in range(classes.count)]
    level = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int").alias("level")
    levels = known.groupBy(level).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least"), *by_class).collect()
    tokens, distinct = sum(r["c"] for r in levels), sum(r["n"] for r in levels)
    totals = np.array([sum(r[f"t{k}"] for r in levels) for k in range(classes.count)], float)
    least, room = 1 << 62, FREQUENT
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    # The dictionary: frequent words, the end, and the words that decide classes.
    listed = docs.sparkSession.createDataFrame([(w,) for w in (END, *classes.words)], "listed binary")
    top = known.join(F.broadcast(listed), F.col("word") == F.col("listed"), "left").where((F.col("c") >= least) | F.col("listed").isNotNull()).select("word", "counts").toArrow()
    found = dict(sorted(zip(top["word"].to_pylist(), top["counts"].to_pylist()))) or {END: [1] * classes.count}
    reader = Reader(list(found), classes)
    leaves = np.zeros((classes.count, len(found) + 1))
    leaves[:, :-1] = np.array([[x or 0 for x in row] for row in found.values()], float).T
    rare_tokens = np.maximum(0, totals - leaves.sum(axis=1))
    leaves[:, -1] = rare_tokens
    prior = leaves[:, reader.end] + 0.5
    tune = lambda name: (F.pmod(F.xxhash64(name, F.lit("tune")), F.lit(TUNE)) == 0).cast("int").alias("tune")
    mixer = word_mixer(docs.where("NOT held_out").select(tune("text"), "text"), reader, leaves, tokens)
    names = docs.sparkSession.createDataFrame([(w,) for w in found], "word binary")
    rare = known.join(F.broadcast(names), "word", "left_anti").select(tune("word"), "word", F.posexplode("counts").alias("class", "here")).where("here > 0")
    rare_words = np.zeros(classes.count)
    for r in rare.groupBy("class").count().collect():
        rare_words[r["class"]] = r["count"]
    speller = speller_of(rare.select("tune", "word", "class"), int(rare_words.sum()))
    return Corpus(vocabulary, reader, leaves, tokens, distinct, np.log10(prior / prior.sum()), rare_tokens, rare_words, mixer, speller)


def rare_log10(here: np.ndarray, kinds: np.ndarray, spelled: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log10 probability of rare words after the escape: their counts less DISCOUNT, and what that leaves
    spread by spelling."""
    total, kept = np.maximum(tokens, 1)[kinds], (DISCOUNT * words + (tokens == 0))[kinds]
    with np.errstate(divide="ignore"):
        plain = np.log10(np.maximum(0, here - DISCOUNT) / total)
    return np.logaddexp(plain * np.log(10), (np.log10(np.maximum(kept, DISCOUNT) / total) + spelled) * np.log(10)) / np.log(10)


def chunks(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, digest, digest of the chunk before, 0 for a text's first) of all chunks of texts in a row."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        pair = (hashes[1:] ^ (hashes[:-1] * STEP)) * ODD
        new_text = owner[1:] != owner[:-1]
        # A chunk starts behind a pair of words whose hash says so, within one text.
        cut = np.concatenate([[True], new_text])
        cut[2:] |= (pair[:-1] >> np.uint64(40)) % np.uint64(CHUNK_WORDS) == 0
        start = np.flatnonzero(cut)
        powers, back = (np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64) for base in (ODD, INVERSE))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
        digest = (running[np.append(start[1:], n)] - running[start]) * back[start]
        digest = (digest ^ (digest >> np.uint64(31))) * STEP | np.uint64(1)
    before = np.concatenate([np.zeros(1, np.uint64), digest[:-1]])
    before[np.concatenate([[True], owner[start[1:]] != owner[start[:-1]]])] = 0
    return start, digest, before


def _listed(owner: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """Values in the order of owner as one list a row."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _read_group(group: list[Text], reader: Reader, mixer: wordmix.Mixer, hashes: np.ndarray, base: np.ndarray, prior: np.ndarray) -> list[pa.Array]:
    digest = xxhash.xxh64_intdigest
    tokens, owner = reader.tokens(group)
    rows = len(group)
    cost = mixer.log10(tokens)
    own = hashes.take(tokens.ids)
    escaped = tokens.ids == reader.escape
    words = [w for t in group for w in t.rare]
    own[escaped] = np.fromiter(map(digest, words), np.uint64, len(words))
    start, found, before = chunks(own, owner)
    sums = np.add.reduceat(cost, start)
    whose = owner[start]
    # Equal chunks behind equal ones count together within a text.
    with np.errstate(over="ignore"):
        key = ((whose.astype(np.uint64) * ODD ^ found) * STEP ^ before) * ODD
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(whose[first], kind="stable")
    times, spent = np.bincount(at), np.bincount(at, weights=sums)
    pick = order[before[first[order]] != 0]
    listed = lambda values, kind: _listed(whose[first[pick]], values, rows, kind)
    rare = [Counter(t.rare) for t in group]
    sizes = np.fromiter(map(len, rare), np.int64, rows)
    rare_hash = np.array([digest(w, 42 + t.kind) for t, c in zip(group, rare) for w in c], np.uint64).view(np.int64)
    rare_times = np.array([n for c in rare for n in c.values()], np.int32)
    n = np.bincount(owner, minlength=rows)
    total = np.bincount(owner, weights=cost, minlength=rows) + prior[[t.kind for t in group]]
    return [
        pa.array(n), pa.array(n - np.bincount(owner, weights=escaped, minlength=rows).astype(np.int64)), pa.array(np.bincount(owner, weights=base.take(tokens.ids), minlength=rows)),
        pa.array(total), pa.array([t.size for t in group], pa.int64()),
        _listed(np.repeat(np.arange(rows), sizes), rare_hash, rows, pa.int64()), _listed(np.repeat(np.arange(rows), sizes), rare_times, rows, pa.int32()),
        listed(before[first[pick]].view(np.int64), pa.int64()), listed(found[first[pick]].view(np.int64), pa.int64()), listed(times[pick].astype(np.int32), pa.int32()), listed(spent[pick], pa.float64()),
    ]


READ = "n_tokens long, known long, base double, own double, n_bytes long, hashes array<long>, times array<int>, before array<long>, chunk array<long>, repeats array<int>, spent array<double>"
NAMES = ["doc_id", "held_out", "row", *(c.split()[0] for c in READ.split(", "))]


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """(before, best, n, total): for each chunk the one that most of the training texts which have it go on
    with, if at least two do; how many do so, and how many texts go on from there in any way."""
    told = rows.where("NOT held_out").select(F.explode(F.arrays_zip("before", "chunk")).alias("c")).groupBy("c.before", "c.chunk").agg(F.count("*").alias("n"))
    best = told.groupBy("before").agg(F.max(F.struct("n", "chunk")).alias("top"), F.sum("n").alias("total"))
    return best.select("before", F.col("top.chunk").alias("best"), F.col("top.n").alias("n"), "total").where("n >= 2")


def chunk_gains(rows: DataFrame) -> DataFrame:
    """(row, own): what predicted chunks add to a text's log10 probability."""
    told = staged(repeated_chunks(rows), "lm-chunks")
    hot = told.agg(F.sum("total").alias("s")).first()["s"] or 0
    met = rows.select("row", F.explode(F.arrays_zip("before", "chunk", "repeats", "spent")).alias("c")).select("row", "c.*")
    frequent = F.broadcast(told.where(F.col("total") * HOT > hot).withColumn("hot", F.lit(True)))
    quick = met.join(frequent, "before", "left")
    rest = quick.where("hot IS NULL").select("row", "before", "chunk", "repeats", "spent").join(told.where(F.col("total") * HOT <= hot), "before")
    columns = ["row", "chunk", "repeats", "spent", "best", "n", "total"]
    right = F.col("repeats") * F.log10((F.col("n") - 1) / F.col("total")) - F.col("spent")
    wrong = F.col("repeats") * F.log10((F.col("total") - F.col("n") + 1) / F.col("total"))
    return quick.where("hot").select(*columns).union(rest.select(*columns)).select("row", F.when(F.col("chunk") == F.col("best"), right).otherwise(wrong).alias("own"))


def score(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, n_bytes), one row per row of docs; docs are
    those that read_corpus() got (or some of them): texts that are only to be scored are held out there."""
    spark = docs.sparkSession
    unseen, reader = corpus.tokens + corpus.distinct + 1, corpus.reader
    base = np.append(np.log10((corpus.counts[:, :-1].sum(axis=0) + 1) / unseen), 0.0)
    hashes = np.append(np.array([xxhash.xxh64_intdigest(w) for w in reader.words], np.uint64), np.uint64(0))
    model = spark.sparkContext.broadcast((reader, corpus.mixer, hashes, base, corpus.prior))
    speller = spark.sparkContext.broadcast(corpus.speller)
    rare_tokens, rare_words = corpus.rare_tokens, corpus.rare_words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, row = model.value[0], TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for group in reader.groups(_bytes(batch)):
                part = batch.slice(at, len(group))
                at += len(group)
                rows = pa.array(np.arange(row, row + len(group)))
                row += len(group)
                yield pa.record_batch([part.column(0), part.column(1), rows, *_read_group(group, *model.value)], NAMES)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, kinds = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            c, here = batch.column(1).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            found = np.array([xxhash.xxh64_intdigest(w, 42 + k) for w, k in zip(words, kinds.tolist())], np.uint64).view(np.int64)
            own = rare_log10(here, kinds, speller.value.log10(words, kinds), rare_tokens, rare_words)
            yield pa.record_batch([pa.array(found), pa.array(c > 0), pa.array(np.log10((c + 1) / unseen)), pa.array(own)], ["hash", "seen", "base_word", "own_word"])

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(docs.select("doc_id", "held_out", "text").mapInArrow(read, f"doc_id {key}, held_out boolean, row long, {READ}"), "lm-rows")
    names = spark.createDataFrame([(w,) for w in reader.words], "word binary")
    met = corpus.vocabulary.join(F.broadcast(names), "word", "left_anti").select("word", "c", F.posexplode("counts").alias("class", "here")).where("here IS NOT NULL")
    rated = met.mapInArrow(rate, "hash long, seen boolean, base_word double, own_word double")
    pairs = rows.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("p")).select("row", F.col("p.hashes").alias("hash"), F.col("p.times").alias("times"))
    # Every word of docs is in the vocabulary of the corpus, which has held-out texts' words too.
    seen = F.coalesce("seen", F.raise_error(F.lit("a word that read_corpus() has not met")).cast("boolean"))
    words = pairs.join(rated, "hash", "left").select("row", F.when(seen, F.col("times")).otherwise(0).cast("long").alias("known"), (F.col("times") * F.col("base_word")).alias("base"), (F.col("times") * F.col("own_word")).alias("own"))
    gains = chunk_gains(rows).select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "own")
    sums = words.union(gains).groupBy("row").agg(*(F.sum(c).alias(f"{c}_more") for c in ("known", "base", "own")))
    both = rows.select("doc_id", "held_out", "row", "n_tokens", "known", "base", "own", "n_bytes").join(sums, "row", "left")
    add = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_more"), F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", add("known").alias("n_known"), add("base").alias("base_score"), add("own").alias("score"), "n_bytes")


def bits_per_byte(score: Column, n_bytes: Column) -> Column:
    return -score * float(np.log2(10)) / n_bytes


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc32_mod("doc_id", 7) == 2).alias("held_out"), "text", "lang")
    corpus = read_corpus(docs)
    found = score(docs, corpus)
    bits = bits_per_byte(F.col("score"), F.col("n_bytes")).alias("bits_per_byte")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score", bits)
