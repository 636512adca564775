"""The spelling of rare words: byte contexts inside the word, mixed bit by bit.

A word's bytes and a closing space are coded; the predictors are hashed contexts of its last 2, 3 and
5 bytes and of all bytes so far, each with the class of the text. They are counted over the distinct
words of each class, once each, as what is to be told is how a new word is spelled (how often a known
one comes, its count tells).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from casewright.llm.blend import GATES, LEVELS, Blend, opened

LENGTHS = (2, 3, 5)
ORDERS = len(LENGTHS)
SPAN = 1 << 14
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_byte, _shift = np.arange(256, dtype=np.uint32)[:, None], np.arange(8, dtype=np.uint32)[None, :]
#: Hash of the node of each bit of each byte, and the bit.
NODES = ((np.uint32(1) << _shift | _byte >> (np.uint32(8) - _shift)) * np.uint32(0x85EBCA6B) + np.uint32(0x3C6EF372)).astype(np.uint32)
ONES = (_byte >> (np.uint32(7) - _shift) & np.uint32(1)).astype(np.uint32)


@dataclass
class Spelled:
    """The bytes of a list of words: the word of each byte, the byte, and its context hashes."""

    word: np.ndarray
    byte: np.ndarray
    contexts: np.ndarray

    @staticmethod
    def of(words: list[bytes], classes: np.ndarray) -> Spelled:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8) if words else np.zeros(0, np.uint8)
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(data)) - starts[word]
        salt = (np.asarray(classes, np.uint64) + np.uint64(1))[word] << np.uint64(56)
        contexts = np.zeros((ORDERS + 1, len(data)), np.uint32)
        packed = np.zeros(len(data), np.uint64)
        for k in range(max(LENGTHS)):
            before = np.zeros(len(data), np.uint64)
            before[k + 1 :] = data[: -k - 1] if k + 1 <= len(data) else 0
            packed |= np.where(at > k, before, np.uint64(0)) << np.uint64(8 * k)
            if k + 1 in LENGTHS:
                contexts[LENGTHS.index(k + 1)] = (packed + salt) * ODD >> np.uint64(32)
        # Polynomial prefix hashes of all words at once; arithmetic is modulo 2 ** 64.
        powers, back = (np.cumprod(np.full(len(data), base, np.uint64), dtype=np.uint64) for base in (ODD, INVERSE))
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64, out=running[1:])
        first = starts[word]
        contexts[ORDERS] = ((running[: len(data)] - running[first]) * back[first] + salt) * ODD >> np.uint64(32)
        return Spelled(word, data, contexts)

    def spans(self) -> Iterator[slice]:
        for a in range(0, len(self.byte), SPAN):
            yield slice(a, a + SPAN)

    def slot(self, span: slice, order: int, bits: int) -> np.ndarray:
        slot = (self.contexts[order, span][:, None] ^ NODES[self.byte[span]]).ravel()
        slot *= np.uint32(0xC2B2AE35)
        slot ^= slot >> np.uint32(15)
        slot *= np.uint32(0x27D4EB2F)
        slot >>= np.uint32(32 - bits)
        return slot


@dataclass
class Speller:
    """States of the tables by order, and the blend of the predictors."""

    states: list[np.ndarray]
    bits: tuple[int, ...]
    blend: Blend

    def inputs(self, symbols: Spelled, span: slice) -> tuple[list[np.ndarray], np.ndarray]:
        sign = ONES[symbols.byte[span]].ravel().astype(np.float32) * 2 - 1
        found = [opened(self.states[k].take(symbols.slot(span, k, self.bits[k])), sign) for k in range(ORDERS + 1)]
        return [x for x, _ in found], found[ORDERS - 1][1] * np.uint16(LEVELS) + found[ORDERS][1]

    def log10(self, words: list[bytes], classes: np.ndarray) -> np.ndarray:
        """log10 probability of the spelling of each word in its class; never clipped."""
        out = np.zeros(len(words))
        symbols = Spelled.of(words, classes)
        for span in symbols.spans():
            cost = self.blend.log10(*self.inputs(symbols, span)).reshape(-1, 8).sum(axis=1, dtype=float)
            first = symbols.word[span][0]
            each = np.bincount(symbols.word[span] - first, weights=cost)
            out[first : first + len(each)] += each
        return out


def first_weights() -> np.ndarray:
    weights = np.full((ORDERS + 1, GATES), 0.3, np.float32)
    return weights
