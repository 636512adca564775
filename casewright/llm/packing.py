"""Vector bin packing of tokenised documents and of instruction examples.

An item is a vector: tokens, one segment, loss-bearing tokens. A sequence has a limit for each.
The dot-product heuristic fills one open sequence at a time: of the items that fit it takes the
one with the largest inner product of demand and remaining room, both in units of the limits.
Where items may be cut, a sequence that no whole item fits any more is filled with the head of
the longest item, and what is left at the end of a block fills sequences of powers of two.

Blocks are runs of at most BLOCK_ITEMS items and about BLOCK_TOKENS tokens of one partition, so
nothing is shuffled, memory is bounded by a block, and a lost task repeats its own block alone.

Defined results: null and empty texts are one token (the end); repeated rows are packed as often
as they occur; an item that exceeds a limit and may not be cut gets null as its sequence; an
empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from casewright.llm.shared import table

END = 1
BLOCK_ITEMS = 4096
BLOCK_TOKENS = 1 << 23
SMALLEST_TAIL = 64


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    smallest_cut: int = 16


def pack_block(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(sequence, [(item, start, length), ...]); sequence -1 holds the items that fit nowhere.

    Cutting takes all tokens of an item to bear loss in the same proportion.
    """
    left, cost = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy()
    start = np.zeros(len(left), np.int64)
    alive = np.ones(len(left), bool)
    if not cut and (over := np.flatnonzero((left > limits.tokens) | (cost > limits.loss_tokens))).size:
        alive[over] = False
        yield -1, [(int(i), 0, int(left[i])) for i in over]
    index = np.flatnonzero(alive)
    sequence = 0
    while index.size:
        total = int(left[index].sum())
        room = limits.tokens
        if cut and total < room:
            room = 1 << (total.bit_length() - 1) if total > SMALLEST_TAIL else SMALLEST_TAIL
        loss_room, segments, pieces = limits.loss_tokens, limits.segments, []
        live = np.ones(index.size, bool)
        size, need = left[index], cost[index]
        while segments and room:
            fit = live & (size <= room) & (need <= loss_room)
            gain = size * (room / limits.tokens**2) + need * (loss_room / limits.loss_tokens**2) + segments / limits.segments**2
            pick = int(np.argmax(np.where(fit, gain, -1.0)))
            if not fit[pick]:
                break
            i = int(index[pick])
            pieces.append((i, int(start[i]), int(size[pick])))
            live[pick] = False
            room, loss_room, segments = room - int(size[pick]), loss_room - int(need[pick]), segments - 1
        if cut and segments and room and live.any() and (room >= limits.smallest_cut or not pieces):
            pick = int(np.argmax(np.where(live, size, -1)))
            i = int(index[pick])
            take = room if not need[pick] else min(room, loss_room * int(size[pick]) // int(need[pick]))
            if take:
                pieces.append((i, int(start[i]), take))
                start[i] += take
                cost[i] -= -(-int(need[pick]) * take // int(size[pick]))
                left[i] -= take
        yield sequence, pieces
        sequence += 1
        index = index[live]


@lru_cache(2)
def _encoders(json_path: str, ranks_path: str):
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return quick, Tokenizer.from_file(json_path)


def encoder(json_path: str, ranks_path: str):
    """text -> token ids and the end token. The rank file holds the same vocabulary and is quicker
    to apply; texts that spell a special token, or that it fails on, go through the JSON file's own
    tokenizer."""
    quick, exact = _encoders(json_path, ranks_path)

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.array([END], "<u4")
        if "<|" in text:
            ids = exact.encode(text, add_special_tokens=False).ids
        else:
            try:
                ids = quick.encode_ordinary(text)
            except BaseException as error:  # it panics, which is no Exception, on very long runs of blanks
                if isinstance(error, (KeyboardInterrupt, SystemExit)):
                    raise
                ids = exact.encode(text, add_special_tokens=False).ids
        ids.append(END)
        return np.array(ids, "<u4")

    return encode


def _piece_batch(doc_ids: list, ids: list[np.ndarray], limits: Limits, first: int, kind: pa.DataType) -> tuple[pa.RecordBatch, int]:
    sizes = np.array([len(x) for x in ids], np.int64)
    rows: list[tuple] = []
    last = -1
    # A document's first token is predicted from nothing and bears no loss.
    for sequence, pieces in pack_block(sizes, sizes - 1, limits, cut=True):
        offset, last = 0, sequence
        for i, start, length in pieces:
            crc = zlib.crc32(ids[i][start : start + length].tobytes())
            rows.append((doc_ids[i], start, length, crc, int(sizes[i]), first + sequence, offset))
            offset += length
    columns = list(zip(*rows))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.record_batch([pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:]], names), first + last + 1


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, limits: Limits = Limits()) -> DataFrame:
    """One row per piece of a document; offsets run without gaps from 0 in each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        first = TaskContext.get().partitionId() << 32
        doc_ids, ids, held = [], [], 0
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(encode(text.as_py()))
                held += len(ids[-1])
                if len(ids) >= BLOCK_ITEMS or held >= BLOCK_TOKENS:
                    out, first = _piece_batch(doc_ids, ids, limits, first, kind)
                    yield out
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield _piece_batch(doc_ids, ids, limits, first, kind)[0]

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, limits: Limits) -> DataFrame:
    """Whole examples (example_id, tokens, loss_tokens) with sequence_id and offset; nothing is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ITEMS):
                batch = whole.slice(at, BLOCK_ITEMS)
                tokens, loss = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
                where, offsets = [None] * batch.num_rows, [None] * batch.num_rows
                last = -1
                for sequence, pieces in pack_block(tokens, loss, limits, cut=False):
                    offset, last = 0, max(last, sequence)
                    for i, _, length in pieces:
                        if sequence >= 0:
                            where[i], offsets[i] = first + sequence, offset
                        offset += length
                first += last + 1
                yield pa.record_batch([*batch.columns, pa.array(where, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    picked = examples.selectExpr("example_id", "cast(tokens as bigint) tokens", "cast(loss_tokens as bigint) loss_tokens")
    key = picked.schema["example_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"example_id {key}, tokens long, loss_tokens long, sequence_id long, offset long")


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *default_paths())
