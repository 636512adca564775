"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A document is a vector of statistics (sizes, character classes, repetition, entropy).
Standardised, it is mapped to random cosines whose inner products approximate a Gaussian kernel;
every partition sums its share of the normal equations, the sums are added up by Spark, and one
small ridge system is solved. A quarter of the labelled rows is kept from that fit: its scores,
counted in BINS bins, give the isotonic curve (pool adjacent violators) that turns a ridge score
into the probability of label 1.

Defined results: null and empty texts have all-zero statistics and a score like any other text;
without usable labels every score is 0.5; several labels of a doc_id are averaged; null doc_ids
meet no label; repeated rows give repeated results; further columns stay, and earlier columns
named quality_score are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.shared import appended, crc32_mod, slices, staged, table, text_arrays

COSINES = 128
BINS = 512
SLICE = 1 << 20
CLASSES = np.zeros((256, 8))
CLASSES[65:91, 0] = CLASSES[97:123, 1] = CLASSES[48:58, 2] = CLASSES[128:, 3] = 1
CLASSES[[32, 9, 10, 11, 12, 13], 4] = 1
CLASSES[[ord(c) for c in ".,;:'\"?-()"], 5] = 1
CLASSES[ord("!"), 6] = 1
CLASSES[:, 7] = CLASSES.sum(axis=1) == 0
STATISTICS = 17


def statistics(text: bytes) -> np.ndarray:
    """STATISTICS numbers about a whole text, gathered in slices; the same however it is cut."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    counts, words, letters, seen, last, repeats, lines = np.zeros(256), 0, 0, set(), None, 0, 0
    for part in slices(text, SLICE):
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        found = part.split()
        words += len(found)
        letters += sum(map(len, found))
        seen.update(found)
        repeats += sum(map(eq, found, found[1:])) + (bool(found) and found[0] == last)
        last = found[-1] if found else last
        lines += part.count(b"\n")
    share = counts @ CLASSES / len(text)
    p = counts[counts > 0] / len(text)
    out[:8] = share
    out[8] = np.log1p(len(text))
    out[9] = np.log1p(words)
    out[10] = min(40.0, letters / max(1, words))
    out[11] = len(seen) / max(1, words)
    out[12] = repeats / max(1, words)
    out[13] = -(p * np.log2(p)).sum()
    out[14] = np.log1p(lines)
    out[15] = share[0] / max(1e-3, share[0] + share[1])
    out[16] = np.log1p(len(text) / (1 + lines))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / COSINES), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _measure(batch: pa.RecordBatch) -> np.ndarray:
    texts = text_arrays(batch, "text")
    return np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), STATISTICS)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the column statistics (array<double>) in place of text."""
    return appended(docs, "statistics array<double>", lambda batch: [_listed(_measure(batch))]).drop("text")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy().reshape(len(column), STATISTICS)


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression of values in order: adjacent violators are pooled."""
    stack: list[list[float]] = []
    for v, w in zip(values, weights):
        stack.append([v, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, w2, n2 = stack.pop()
            v1, w1, n1 = stack.pop()
            stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in stack]) if stack else np.zeros(0)


def train(rows: DataFrame, ridge: float = 1e-3) -> Model:
    """Model from rows (doc_id, statistics, y); the caller leaves out held-out rows."""
    rng = np.random.default_rng(11)
    frequencies = rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, COSINES))
    phases = rng.uniform(0, 2 * np.pi, COSINES)
    at = [F.col("statistics")[k] for k in range(STATISTICS)]
    sums = rows.agg(F.count("*").alias("n"), *(f(c) for c in at for f in (F.avg, F.stddev_pop))).first()
    constant = Model(np.zeros(STATISTICS), np.ones(STATISTICS), frequencies, phases, np.zeros(COSINES + 1), np.array([0.0]), np.array([0.5]))
    if not sums["n"]:
        return constant
    mean, scale = np.array(sums[1::2], float), np.array(sums[2::2], float)
    scale[scale < 1e-9] = 1
    base = Model(mean, scale, frequencies, phases, constant.weights, constant.knots, constant.values)
    size = COSINES + 2
    upper = np.triu_indices(size)

    def normal_equations(batches):
        total = np.zeros((size, size))
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            z = np.hstack([base.lift(_matrix(batch, "statistics")), y[:, None]])
            total += z.T @ z
        if total[COSINES, COSINES]:
            yield pa.record_batch([pa.array(np.arange(len(upper[0])), pa.int64()), pa.array(total[upper])], ["cell", "value"])

    tuning = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    cells = rows.where(~tuning).mapInArrow(normal_equations, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    if not len(cells):
        return constant
    full = np.zeros(len(upper[0]))
    full[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = full
    gram = gram + np.triu(gram, 1).T
    a, b, n = gram[:-1, :-1], gram[:-1, -1], gram[COSINES, COSINES]
    weights = np.linalg.solve(a + ridge * n / COSINES * np.diag([1.0] * COSINES + [0.0]), b)
    fitted = Model(mean, scale, frequencies, phases, weights, constant.knots, constant.values)

    def binned(batches):
        for batch in batches:
            raw = np.clip(fitted.raw(_matrix(batch, "statistics")), -0.5, 1.5)
            yield pa.record_batch([pa.array(((raw + 0.5) * (BINS / 2)).astype(np.int64)), batch.column(batch.schema.get_field_index("y")), pa.array(raw)], ["bin", "y", "raw"])

    counts = rows.where(tuning).mapInArrow(binned, "bin long, y double, raw double").groupBy("bin").agg(F.avg("y").alias("y"), F.avg("raw").alias("raw"), F.count("*").alias("n")).orderBy("bin").toArrow()
    if not len(counts):
        return Model(mean, scale, frequencies, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    values = pooled(counts["y"].to_numpy(), counts["n"].to_numpy())
    # A slight slope keeps the order of scores inside a pooled block.
    knots = counts["raw"].to_numpy()
    values = 0.998 * values + 0.001 + 0.001 * np.clip(knots - 0.5, -1, 1)
    return Model(mean, scale, frequencies, phases, weights, knots, values)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, statistics, y) of the rows with a quality label."""
    y = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    return rows.select("doc_id", "statistics").join(y, "doc_id")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score, read from the whole text."""
    return appended(docs, "quality_score double", lambda batch: [pa.array(model.score(_measure(batch)))])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = staged(measured(docs.withColumn("held_out", crc32_mod("doc_id", 5) == 0)), "quality")
    model = train(labelled(rows.where(~F.col("held_out")), table(spark, sf_dir, "labels").select("doc_id", "quality")))
    found = appended(rows, "score double", lambda batch: [pa.array(model.score(_matrix(batch, "statistics")))])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
