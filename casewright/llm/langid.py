"""Language identification: averaged hashed subword embeddings with a linear softmax.

Words are lower-cased; their byte 2-, 3- and 4-grams with word boundaries are hashed to BUCKETS
embeddings, a text is the average of its subwords' embeddings, and a softmax layer turns the
average into probabilities. Embeddings and layer are trained together by stochastic gradient
descent in numpy on a sample of about SAMPLE labelled documents (never more than twice as many),
balanced over languages.

Rejection is calibrated on what must go. Every sampled document also gives one text of no language,
by turns its letters dealt anew over its words, its words reversed, or letters drawn evenly from a to
z or from a block of another script; these are one more class of the softmax. A text is accepted if the probability of that class is below a
threshold: of the fifth of the sample kept from training, texts and junk, the threshold is the one
that parts both best while at most REJECT of the documents go. A text half in one and half in another
language is accepted, one in a language never seen mostly is not.

Scoring needs one small matrix (embeddings times layer) and reads every text wholly, in slices.

Defined results: a text that is null or has no letter is `und` with score 0 and not accepted;
without any labelled row every text is `und`; null doc_ids count as the empty id in the fold;
repeated rows give repeated results, and are one text of the sample; further columns stay, whatever
their names; earlier columns named lang_pred, lang_score or lang_accepted are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.shared import appended, crc32_mod, fresh, table, text_arrays

BITS = 16
BUCKETS = 1 << BITS
WIDTH = 16
SAMPLE = 1200
#: Most of the documents of a known language that calibration may reject.
REJECT = 0.002
SLICE = 1 << 20
#: First and last code points of blocks of letters other than a to z.
BLOCKS = ((0xDF, 0x24F), (0x370, 0x3FF), (0x430, 0x52F), (0x5D0, 0x64A), (0x905, 0xDC6), (0x3041, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: ASCII letters and all non-ASCII bytes stay, anything else is a word boundary.
KEEP = np.full(256, 32, np.uint8)
KEEP[97:123], KEEP[65:91], KEEP[128:] = np.arange(97, 123), np.arange(65, 91), np.arange(128, 256)


FEATURES = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("buckets", pa.binary()), ("share", pa.binary())])


@dataclass(frozen=True)
class Model:
    """weights has a column a language and a last one for texts of no language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    temperature: float
    threshold: float


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray):
    """(cuts, buckets) per slice and length: the subwords of row i are buckets[cuts[i]:cuts[i + 1]]."""
    kept = KEEP[data]
    for at in range(0, len(kept), SLICE):
        part = kept[at : at + SLICE + 3].astype(np.uint32)
        blank = part == 32
        for n in (2, 3, 4):
            size = min(SLICE, len(part) - n + 1)
            if size <= 0:
                continue
            packed = np.zeros(size, np.uint32)
            for k in range(n):
                packed |= part[k : k + size] << np.uint32(8 * k)
            valid = ~(blank[:size] & blank[1 : 1 + size]) if n == 2 else ~blank[1 : 1 + size]
            if n == 4:
                valid &= ~blank[2 : 2 + size]
            where = np.flatnonzero(valid)
            mixed = packed[where] * np.uint32(2654435761) + np.uint32(n * 0x51ED270B & 0xFFFFFFFF)
            yield np.searchsorted(where, offsets - at), (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS)


def rows_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array."""
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if len(array) and array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(array: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each row the sum of its subwords' weight rows, and in the last column their number."""
    data, offsets = rows_of(array)
    out = np.zeros((len(array), weights.shape[1] + 1))
    for cuts, buckets in grams(data, offsets):
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(full):
            out[full, :-1] += np.add.reduceat(weights[buckets], cuts[full], axis=0, dtype=np.float64)
            out[full, -1] += (cuts[1:] - cuts[:-1])[full]
    return out


def junk(text: str, kind: int, seed: int) -> str:
    """A text of no language with the words' lengths of a text: its letters dealt anew (0), its words
    reversed (1), letters drawn evenly from a to z (2) or from one of BLOCKS (3)."""
    if kind == 1:
        return " ".join(w[::-1] for w in text.split())
    rng = np.random.default_rng(seed)
    found = np.array(list(text))
    letters = np.char.isalpha(found)
    if kind == 0:
        found[letters] = rng.permutation(found[letters])
    else:
        first, last = (97, 122) if kind == 2 else BLOCKS[seed // 4 % len(BLOCKS)]
        found[letters] = list(map(chr, rng.integers(first, last + 1, int(letters.sum()))))
    return "".join(found)


def _shares(text: str) -> tuple[bytes, bytes]:
    """The distinct subwords of a text and their shares, packed."""
    data = np.frombuffer(text.encode(), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for _, buckets in grams(data, np.array([0, len(data)])):
        total += np.bincount(buckets, minlength=BUCKETS)
    hit = np.flatnonzero(total)
    return hit.astype(np.uint16).tobytes(), (total[hit] / max(1, total.sum())).astype(np.float32).tobytes()


def _features(batches):
    for batch in batches:
        rows = []
        for lang, h, text in zip(*(c.to_pylist() for c in batch.columns)):
            for name, content in ((lang, text), (None, f" {junk(text.strip(), h % 4, h % (1 << 32))} ")):
                rows.append((name, h, *_shares(content)))
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "h", "buckets", "share"])


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = 4, rate: float = 0.5) -> Model:
    """Model from the text and lang of docs; the caller leaves out held-out rows."""
    labelled = docs.where("lang IS NOT NULL").where(has_letter(F.col("text"))).select("lang", padded(F.col("text")).alias("text"), F.xxhash64("text").alias("h"))
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return Model((), np.zeros((BUCKETS, 1), np.float32), 1.0, 0.5)
    each = max(32, sample // len(sizes))
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / float(1 << 40)
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, each / r["count"]))))
    # Copies of a text are drawn together and count once; the limit bounds what reaches the driver.
    drawn = labelled.where(draw < F.element_at(shares, F.col("lang"))).groupBy("lang", "h").agg(F.first("text").alias("text"))
    drawn = drawn.select("lang", "h", "text").limit(2 * max(sample, 32 * len(sizes)))
    languages = tuple(r["lang"] for r in sizes)

    def fit(batches):
        rows = pa.Table.from_batches(list(batches), FEATURES)
        number = {x: k for k, x in enumerate(languages)} | {None: len(languages)}
        y = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
        h = rows["h"].to_numpy()
        order = np.lexsort((y, h))
        ids = [np.frombuffer(rows["buckets"][int(i)].as_py(), np.uint16) for i in order]
        share = [np.frombuffer(rows["share"][int(i)].as_py(), np.float32) for i in order]
        model = _descend(ids, share, y[order], h[order], languages, epochs, rate)
        yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.temperature]), pa.array([model.threshold])], ["weights", "temperature", "threshold"])

    # The sample is bounded, and one task descends on it; the driver gets the model alone.
    features = drawn.mapInArrow(_features, "lang string, h long, buckets binary, share binary").repartition(1)
    found = features.mapInArrow(fit, "weights binary, temperature double, threshold double").first()
    weights = np.frombuffer(bytes(found["weights"]), np.float32).reshape(BUCKETS, len(languages) + 1)
    return Model(languages, weights, found["temperature"], found["threshold"])


def _descend(ids, share, y, h, languages, epochs, rate) -> Model:
    """Weights by stochastic gradient descent; a document and its junk are both trained on or both kept."""
    rng = np.random.default_rng(7)
    classes = len(languages) + 1
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, classes), np.float32)
    tuning = h % 5 == 4 if len(y) >= 100 else np.zeros(len(y), bool)
    train_rows = np.flatnonzero(~tuning)
    steps, done = epochs * max(1, len(train_rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(train_rows):
            speed = rate * (1 - done / steps)
            done += 1
            hidden = share[i] @ embed[ids[i]]
            z = hidden @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= speed * np.outer(hidden, p)
            embed[ids[i]] -= speed * np.outer(share[i] * np.float32(min(64.0, len(ids[i]))), back)
    weights = (embed @ layer).astype(np.float32)
    held = np.flatnonzero(tuning) if tuning.any() else np.arange(len(y))
    z = np.array([share[i] @ weights[ids[i]] for i in held]).reshape(len(held), classes)
    softmax = lambda t: z / t - np.logaddexp.reduce(z / t, axis=1, keepdims=True)
    at = np.arange(len(held)), y[held]
    t = min(np.geomspace(0.05, 5, 40), key=lambda t: -softmax(t)[at].mean())
    return Model(languages, weights, float(t), calibrated(np.exp(softmax(t))[:, -1], y[held] == classes - 1))


def calibrated(junk_score: np.ndarray, is_junk: np.ndarray) -> float:
    """The threshold on the probability of no language that parts documents from junk best, with at most
    REJECT of the documents at or above it; between neighbouring scores, the middle."""
    good, bad = np.sort(junk_score[~is_junk]), junk_score[is_junk]
    if not len(good):
        return 0.5
    least = good[min(len(good) - 1, int(np.ceil(len(good) * (1 - REJECT))) - 1)]
    above = bad[bad > least]
    return float(min(0.99, (least + (np.quantile(above, 0.01) if len(above) else 1.0)) / 2))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1: probability of that language) and lang_accepted."""
    new = ["lang_pred", "lang_score", "lang_accepted"]
    names = np.array([*model.languages, "und"], dtype=object)
    docs = docs.drop(*new)
    text, letters = fresh(docs, "padded", "letters")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        array = text_arrays(batch, text)
        has = batch.column(batch.schema.get_field_index(letters)).to_numpy(zero_copy_only=False).astype(bool)
        total = sums(array, model.weights)
        known = has & (total[:, -1] > 0) if model.languages else np.zeros(len(array), bool)
        z = total[:, :-1] / np.maximum(total[:, -1:], 1) / model.temperature
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        own = p[:, :-1] if model.languages else p
        pick = np.where(known, own.argmax(axis=1), len(names) - 1)
        score = np.where(known, own.max(axis=1), 0.0)
        return [pa.array(names[pick].tolist(), pa.string()), pa.array(score), pa.array(known & (p[:, -1] < model.threshold))]

    helpers = {text: padded(F.col("text")), letters: has_letter(F.col("text"))}
    return appended(docs, "lang_pred string, lang_score double, lang_accepted boolean", work, helpers)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 4) == 2
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
