"""Frequent words as paths of a binary tree, and the mixing of bit predictors along them.

Words and one escape (for all others) are the leaves of a Huffman tree; a text is the bits of its
paths. Four predictors look at every bit: how often the class of the text goes each way at this
node; what followed the word before (a hashed context, in a table of counted bits); and the word
that followed the last place in this text where the same words stood before (one, two or three).
Their log-odds are combined with weights that a gate selects: how much the hashed context has seen,
and how long the match is. An adaptive map by gate refines the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from casewright.llm.blend import GATES, LEVELS, Blend, opened

CODE = 40
#: Tokens whose bits are worked on at once.
TOKENS = 1 << 14


class Tree:
    """Huffman tree of leaves with these counts; path of leaf i: the entries from start[i] on, length[i] of them."""

    def __init__(self, counts: np.ndarray):
        m = len(counts)
        # No leaf below a share of 2 ** -22, so that codes fit CODE bits.
        smoothed = counts.astype(float) + counts.sum() / (1 << 22) + 1e-9
        heap = [(float(c), i) for i, c in enumerate(smoothed)]
        heapq.heapify(heap)
        self.children = np.zeros((m - 1, 2), np.int64)
        for k in range(m - 1):
            a, i = heapq.heappop(heap)
            b, j = heapq.heappop(heap)
            self.children[k] = i, j
            heapq.heappush(heap, (a + b, m + k))
        parent, side = np.zeros(2 * m - 1, np.int64), np.zeros(2 * m - 1, np.int64)
        for s in (0, 1):
            parent[self.children[:, s]] = np.arange(m - 1) + m
            side[self.children[:, s]] = s
        depth, code = [0] * (2 * m - 1), [0] * (2 * m - 1)
        up, turn = parent.tolist(), side.tolist()
        for i in range(2 * m - 3, -1, -1):
            p = up[i]
            depth[i], code[i] = depth[p] + 1, code[p] | turn[i] << (CODE - 1 - depth[p])
        self.nodes = m - 1
        self.length = np.array(depth[:m], np.int32)
        self.code = np.array(code[:m], np.int64)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.node = np.empty(int(self.length.sum()), np.int32)
        self.sign = np.empty(len(self.node), np.float32)
        leaf, at = np.arange(m), self.start + self.length - 1
        while len(leaf):
            self.node[at], self.sign[at] = parent[leaf] - m, side[leaf] * 2 - 1
            leaf, at = parent[leaf], at - 1
            up_ = leaf < 2 * m - 2
            leaf, at = leaf[up_], at[up_]
        self.one = (self.sign > 0).astype(np.uint32)
        self.hash = self.node.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)

    def odds(self, counts: np.ndarray) -> np.ndarray:
        """(classes, nodes) log-odds of the second child from the leaves' counts (classes, leaves)."""
        m = counts.shape[1]
        total = np.zeros((2 * m - 1, len(counts)))
        total[:m] = counts.T
        for k, (i, j) in enumerate(self.children.tolist()):
            total[m + k] = total[i] + total[j]
        a, b = total[self.children[:, 0]], total[self.children[:, 1]]
        return np.log((b + 1e-6) / (a + 1e-6)).T.astype(np.float32)




def matches(ids: np.ndarray, before: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(guess, level) of each token: what followed the last place in its unit with the same word before;
    level 1, 2 or 3 by how many words before agree there, 0 for no such place."""
    n = len(ids)
    order = np.sort((unit.astype(np.int64) << 40) | (before.astype(np.int64) << 20) | np.arange(n))
    at = order & ((1 << 20) - 1)
    same = (order[1:] >> 20) == (order[:-1] >> 20)
    last = np.full(n, -1, np.int64)
    last[at[1:][same]] = at[:-1][same]
    level = (last >= 0).astype(np.int32)
    for back in (1, 2):
        ok = np.flatnonzero((level == back) & (last >= back) & (np.arange(n) >= back))
        ok = ok[(unit[ok - back] == unit[ok]) & (unit[last[ok] - back] == unit[ok]) & (before[ok - back] == before[last[ok] - back])]
        level[ok] += 1
    return np.where(last >= 0, ids[np.maximum(last, 0)], 0), level


@dataclass
class Tokens:
    """Tokens of several texts (fewer than 2 ** 20): leaf, leaf before, class, unit (a text or a slice of one)."""

    ids: np.ndarray
    before: np.ndarray
    kind: np.ndarray
    unit: np.ndarray

    def slots(self, tree: Tree, bits: int) -> Iterator[np.ndarray]:
        """Twice the slot of every bit's hashed context, and one more for a one bit."""
        for at in range(0, len(self.ids), TOKENS):
            _, token, flat = paths(tree, self.ids[at : at + TOKENS])
            yield (hashed(tree, bits, self.before[at : at + TOKENS], token, flat) << np.uint32(1)) | tree.one.take(flat)

    def parts(self, tree: Tree, bits: int) -> Iterator[Bits]:
        guess, level = matches(self.ids, self.before, self.unit)
        gap = tree.code[guess] ^ tree.code[self.ids]
        shared = np.where(level > 0, CODE - np.frexp(gap.astype(float))[1], -1).astype(np.int32)
        for at in range(0, len(self.ids), TOKENS):
            s = slice(at, at + TOKENS)
            yield Bits.of(tree, bits, at, self.ids[s], self.before[s], self.kind[s], shared[s], level[s])


def paths(tree: Tree, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each token's bits, token of each bit, place of each bit in the tree's paths)."""
    length = tree.length.take(ids)
    token = np.repeat(np.arange(len(ids), dtype=np.int32), length)
    begin = (np.cumsum(length) - length).astype(np.int32)
    return begin, token, np.arange(len(token), dtype=np.int32) + (tree.start.take(ids) - begin).take(token)


def hashed(tree: Tree, bits: int, before: np.ndarray, token: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slot of each bit: word before and node, hashed."""
    context = (before.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    context ^= context >> np.uint32(15)
    slot = context.take(token)
    slot ^= tree.hash.take(flat)
    slot *= np.uint32(0xC2B2AE35)
    slot ^= slot >> np.uint32(13)
    slot *= np.uint32(0x27D4EB2F)
    slot >>= np.uint32(32 - bits)
    return slot


@dataclass
class Bits:
    """The bits of some tokens: begin of each token's, token, place in the tree's paths, slot of the hashed context, signed
    match (1 right, -1 wrong, 0 none) and its level."""

    first: int
    begin: np.ndarray
    token: np.ndarray
    flat: np.ndarray
    slot: np.ndarray
    match: np.ndarray
    level: np.ndarray
    kind: np.ndarray

    @staticmethod
    def of(tree: Tree, bits: int, first: int, ids, before, kind, shared, level) -> Bits:
        begin, token, flat = paths(tree, ids)
        match, at = np.zeros(len(token), np.float32), np.zeros(len(token), np.uint16)
        # A match speaks up to the first bit in which guess and word differ.
        on = np.flatnonzero(shared >= 0)
        size = np.minimum(shared[on] + 1, tree.length.take(ids[on]))
        place = np.arange(int(size.sum())) + np.repeat(begin[on] - (np.cumsum(size) - size), size)
        match[place] = 1
        at[place] = np.repeat(level[on], size)
        wrong = on[shared[on] < tree.length.take(ids[on])]
        match[begin[wrong] + shared[wrong]] = -1
        return Bits(first, begin, token, flat, hashed(tree, bits, before, token, flat), match, at, kind)


@dataclass
class Mixer:
    """The predictors of a bit: a class' log-odds at nodes, the slots' states, the match; and their blend."""

    tree: Tree
    odds: np.ndarray
    state: np.ndarray
    bits: int
    blend: Blend

    def inputs(self, b: Bits) -> tuple[list[np.ndarray], np.ndarray]:
        own = self.signed().take((b.kind * len(self.tree.node)).astype(np.int32).take(b.token) + b.flat)
        after, level = opened(self.state.take(b.slot), self.tree.sign.take(b.flat))
        return [own, after, b.match], level * np.uint16(LEVELS) + b.level

    def signed(self) -> np.ndarray:
        """Log-odds of every entry of the tree's paths by class, with the path's sign; made once a process."""
        if not hasattr(self, "_signed"):
            self._signed = (self.odds[:, self.tree.node] * self.tree.sign).ravel()
        return self._signed

    def log10(self, tokens: Tokens) -> np.ndarray:
        """log10 probability of each token's path."""
        out = np.empty(len(tokens.ids))
        for b in tokens.parts(self.tree, self.bits):
            out[b.first : b.first + len(b.begin)] = np.add.reduceat(self.blend.log10(*self.inputs(b)), b.begin)
        return out


def first_weights() -> np.ndarray:
    weights = np.zeros((3, GATES), np.float32)
    weights[0], weights[1] = 0.9, 0.2
    weights[2] = np.tile([0, 1, 2, 3], LEVELS)
    return weights
