"""Gated logistic mixing of bit predictors, refined by an adaptive map; tables of counted bits.

Numbers about a bit carry the sign of the bit that came: positive log-odds are right. That makes the
mixing symmetric in zeros and ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: How much a context has seen, in so many levels; a gate is a pair of such levels.
LEVELS = 4
GATES = LEVELS * LEVELS
STEPS = 16
CELLS = 12 * STEPS
FIRST_CELL = (np.arange(GATES) * (2 * CELLS + 1) + CELLS).astype(np.int32)
PRIOR = 64.0
RATE = 0.05
BATCH = 1 << 16
FINE = (1 << 12) - 1
ODDS = (np.arange(FINE + 1) * (24 / FINE) - 12).astype(np.float32)
#: Counts that travel in one row.
CHUNK = 1 << 14


def states(counts: np.ndarray) -> np.ndarray:
    """Each slot's (zeros, ones) as 12 bits of log-odds and, above, how much it has seen."""
    n = counts.sum(axis=1)
    odds = np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4))
    seen = np.searchsorted([1, 3, 16], n, side="right").astype(np.uint16)
    fine = np.rint((np.clip(odds, -12, 12) + 12) * (FINE / 24)).astype(np.uint16)
    return (seen << np.uint16(12)) | fine


def opened(state: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed log-odds and level of states."""
    odds = ODDS.take(state & np.uint16(FINE))
    odds *= sign
    return odds, state >> np.uint16(12)


@dataclass
class Blend:
    """Weights (predictors, gates), and the log10 probability by gate and cell of the mixed log-odds."""

    weights: np.ndarray
    cost: np.ndarray | None = None

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.weights[0].take(gate) * x[0]
        for k in range(1, len(x)):
            z += self.weights[k].take(gate) * x[k]
        return np.clip(z, -11.9, 11.9, out=z)

    def cells(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.mixed(x, gate)
        z *= STEPS
        return np.rint(z, out=z).astype(np.int32) + FIRST_CELL.take(gate)

    def log10(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        return self.cost.ravel().take(self.cells(x, gate))

    def descend(self, x: list[np.ndarray], gate: np.ndarray, speed: np.ndarray) -> None:
        """Moves the weights, bits in turn, along the gradient of their log probability."""
        for at in range(0, len(gate), BATCH):
            part, g = [v[at : at + BATCH] for v in x], gate[at : at + BATCH]
            error = 1 / (1 + np.exp(self.mixed(part, g)))
            for k in range(len(x)):
                moved = np.bincount(g, weights=error * part[k], minlength=GATES)
                speed[k] += moved * moved
                self.weights[k] += (RATE * moved / np.sqrt(speed[k] + 1e-3)).astype(np.float32)

    def outcomes(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """How often bits were right, (gates, cells of the log-odds from wrong to right)."""
        return np.bincount(self.cells(x, gate), minlength=GATES * (2 * CELLS + 1)).reshape(GATES, 2 * CELLS + 1)


def refined(outcomes: np.ndarray) -> np.ndarray:
    """log10 probability by gate and cell: how often bits of this confidence were right, with PRIOR
    bits' worth of trust in the mixed log-odds themselves."""
    trust = 1 / (1 + np.exp(-np.arange(CELLS + 1) / STEPS))
    right, wrong = outcomes[:, CELLS:], outcomes[:, CELLS::-1]
    p = (right + PRIOR * trust) / (right + wrong + PRIOR)
    p[:, 0] = 0.5
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log10(np.concatenate([1 - p[:, :0:-1], p], axis=1)).astype(np.float32)


class Tally:
    """Counts of zero and one bits in tables of 2 ** bits slots, and of those that tune the weights apart."""

    def __init__(self, bits: tuple[int, ...]):
        self.bits = bits
        self.counts: dict[tuple[int, int], np.ndarray] = {}

    def add(self, tune: int, table: int, at: np.ndarray) -> None:
        """at: twice the slot, and one more for a one bit."""
        if (tune, table) not in self.counts:
            self.counts[tune, table] = np.zeros(2 << self.bits[table], np.uint32)
        np.add.at(self.counts[tune, table], at.astype(np.intp), np.uint32(1))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (tune, table), counts in self.counts.items():
            for at in range(0, len(counts), CHUNK):
                part = counts[at : at + CHUNK]
                if part.any():
                    packed = zlib.compress(part.astype("<u4").tobytes(), 1)
                    yield pa.record_batch([pa.array([tune], pa.int32()), pa.array([table], pa.int32()), pa.array([at], pa.int64()), pa.array([packed], pa.binary())], ["tune", "table", "at", "counts"])


TALLY = "tune int, table int, at long, counts binary"


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(c.as_py()), "<u4").astype(np.int64) for c in group["counts"])
    first = [pa.array([group[n][0].as_py()], t) for n, t in (("tune", pa.int32()), ("table", pa.int32()), ("at", pa.int64()))]
    return pa.table([*first, pa.array([zlib.compress(total.astype("<u4").tobytes(), 1)], pa.binary())], ["tune", "table", "at", "counts"])


def tables(tallies: DataFrame, bits: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """States of all tables without the rows that tune the weights, and with them."""
    counts = [[np.zeros(2 << b, np.uint32) for b in bits] for _ in range(2)]
    for row in tallies.groupBy("tune", "table", "at").applyInArrow(_summed, TALLY).toArrow().to_pylist():
        part = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
        counts[row["tune"]][row["table"]][row["at"] : row["at"] + len(part)] = part
    return [states(c.reshape(-1, 2)) for c in counts[0]], [states((a + b).reshape(-1, 2)) for a, b in zip(*counts)]


def averaged(rows: DataFrame, shape: tuple[int, int], first: np.ndarray) -> np.ndarray:
    """The partitions' weights, each with the number of bits it saw; first where there were none."""
    found = rows.groupBy("cell").sum("value", "n").toArrow()
    out = first.astype(float).ravel().copy()
    cells, value, n = (found[c].to_numpy() for c in found.column_names)
    out[cells] = value / np.maximum(n, 1)
    return out.reshape(shape).astype(np.float32)


def weight_rows(weights: np.ndarray, n: int) -> pa.RecordBatch:
    flat = weights.astype(float).ravel()
    return pa.record_batch([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat * n), pa.array(np.full(len(flat), n), pa.int64())], ["cell", "value", "n"])


def outcome_rows(total: np.ndarray) -> pa.RecordBatch:
    flat = total.ravel()
    hit = np.flatnonzero(flat)
    return pa.record_batch([pa.array(hit, pa.int64()), pa.array(flat[hit], pa.int64())], ["cell", "n"])


def added_outcomes(rows: DataFrame) -> np.ndarray:
    found = rows.groupBy("cell").sum("n").toArrow()
    total = np.zeros(GATES * (2 * CELLS + 1))
    total[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return total.reshape(GATES, 2 * CELLS + 1)
