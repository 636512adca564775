"""Running sums within keys over any number of tasks.

Rows are range-partitioned by key and order, so a key with many rows spreads over partitions. Each task sums
up its own rows; what the parts of a key before it came to (at most two rows a partition) is added in a second
step. Sums are 64-bit and wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from casewright.llm.shared import fresh, staged


def _local_batches(key: str, sums: dict[str, str], place: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, done = None, {name: np.int64(0) for name in sums}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            keys = batch.column(names.index(key)).to_numpy()
            first = np.append(True, keys[1:] != keys[:-1])
            start = np.nonzero(first)[0]
            run_of = np.cumsum(first) - 1
            new = []
            for name, of in sums.items():
                values = batch.column(names.index(of)).to_numpy().astype(np.int64)
                with np.errstate(over="ignore"):
                    total = np.cumsum(values)
                    total = total - (total[start] - values[start])[run_of]
                    if keys[0] == last:
                        total[run_of == 0] += carry[name]
                carry[name] = total[-1]
                new.append(pa.array(total, pa.int64()))
            last = keys[-1]
            new.append(pa.array(np.arange(done, done + batch.num_rows), pa.int64()))
            done += batch.num_rows
            yield pa.record_batch([*batch.columns, *new], [*names, *sums, place])

    return run


def _carry_batches(key: str, part: str, sums: list[str], before: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = {n: batch.column(i) for i, n in enumerate(names) if n != part}
            keys, parts = batch.column(names.index(key)).to_numpy(), batch.column(names.index(part)).to_numpy()
            new = {s: columns[s].to_numpy().copy() for s in sums}
            for p in np.unique(parts).tolist():
                if p in before:
                    rows = (parts == p) & (keys == before[p][0])
                    for s, value in zip(sums, before[p][1]):
                        with np.errstate(over="ignore"):
                            new[s][rows] += np.int64(value)
            yield pa.record_batch([pa.array(new[n], pa.int64()) if n in new else c for n, c in columns.items()], list(columns))

    return run


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def running_sums(df: DataFrame, key: str, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each new column of sums, the sum of its long column over the key's rows so far in order.

    key and the summed columns are longs without nulls; rows that tie in order keep one order among them.
    """
    part, place = fresh(df.select("*", *(F.lit(0).alias(s) for s in sums)), "part", "place")
    schema = StructType([*df.schema.fields, StructField(part, LongType()), *(StructField(s, LongType()) for s in (*sums, place))])
    placed = df.repartitionByRange(key, *order).withColumn(part, F.spark_partition_id().cast("long")).sortWithinPartitions(key, *order)
    local = staged(placed.mapInArrow(_local_batches(key, sums, place), schema), name)
    spans = local.groupBy(part).agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy(part).collect()
    shared = {b["low"] for a, b in zip(spans, spans[1:]) if a["high"] == b["low"]}
    if not shared:
        return local.drop(part, place)
    # Keys that go on from one part into the next number fewer than the parts.
    keys = local.sparkSession.createDataFrame([(k,) for k in shared], f"{key} long")
    ends = local.join(F.broadcast(keys), key).groupBy(part, key).agg(F.max_by(F.struct(*sums), place).alias("total")).collect()
    totals = {(r[part], r[key]): r["total"] for r in ends}
    before, open_key, carry = {}, None, []
    for r in spans:
        p, low, high = r[part], r["low"], r["high"]
        if low == open_key:
            before[p] = (low, carry)
        held = carry if low == open_key == high else [0] * len(sums)
        open_key = high if high in shared else None
        carry = [_wrapped(a + b) for a, b in zip(held, totals[p, high])] if open_key is not None else []
    out = StructType([f for f in local.schema.fields if f.name not in (part, place)])
    return local.drop(place).mapInArrow(_carry_batches(key, part, list(sums), before), out)
