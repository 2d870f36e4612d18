"""Running counts, sums and exclusive ors over all rows in one order, without one task that sees them all.

Rows are dealt by ranges of the order and scanned within each range; what a range hands on to the next (two rows a range
tell it) is added by the driver, whose work grows with the number of partitions alone. A group of rows, however large,
may span many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import settle, ship, thrifty

_OPS = {"sum": (np.add, 0), "xor": (np.bitwise_xor, 0)}


def scan(df: DataFrame, keys: list[str], order: list[Column], running: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """df with n (a row's place in its group, from 1), last (is it the group's last row), and running values.

    keys: long columns without nulls that make up a group; none for all rows as one. order: the order in a group, full
    enough that equal rows are alike. running: by name, (sum or xor, a long column without nulls), the row itself
    included. df must not have columns named as those that are added, or beginning with scan_.
    """
    ship(df.sparkSession)
    running, names = running or {}, df.columns
    ops = [_OPS[op] for op, _ in running.values()]
    values = [names.index(c) for _, c in running.values()]
    at = [names.index(k) for k in keys]
    added = StructType([*[StructField(c, LongType()) for c in ("n", *running)], StructField("scan_lead", BooleanType()), StructField("last", BooleanType()), StructField("scan_first", BooleanType()), StructField("scan_final", BooleanType()), StructField("scan_part", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, n, totals, lead, held = None, 0, [0] * len(ops), True, None

        def out(batch, columns, last, final):
            rows = len(batch)
            first, finals = np.zeros(rows, bool), np.zeros(rows, bool)
            first[0], finals[-1] = columns[0], final
            arrays = [*batch.columns, *[pa.array(c) for c in columns[1:]], pa.array(last), pa.array(first), pa.array(finals), pa.array(np.full(rows, part, np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names=[*names, *added.names])

        for b in batches:
            if not len(b):
                continue
            own = [b.column(k).to_numpy(zero_copy_only=False) for k in at]
            begins = np.zeros(len(b), bool)
            for c in own:
                begins[1:] |= c[1:] != c[:-1]
            now = tuple(int(c[0]) for c in own)
            begins[0] = key is not None and now != key
            if held is not None:
                held[2][-1] = begins[0]
                yield out(*held, False)
            place = np.arange(len(b))
            start = np.maximum.accumulate(np.where(begins, place, -1))
            count = np.where(start < 0, place + 1 + n, place - start + 1)
            columns = [key is None, count]
            for k, ((op, zero), v) in enumerate(zip(ops, values, strict=True)):
                upto = op.accumulate(b.column(v).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.where(start > 0, upto[np.maximum(start, 1) - 1], zero)
                before = np.where(start < 0, totals[k], before)
                upto = upto ^ before if op is np.bitwise_xor else np.where(start < 0, upto + before, upto - before)
                columns.append(upto)
                totals[k] = int(upto[-1])
            columns.append((start < 0) & lead)
            lead = lead and not begins.any()
            key, n = tuple(int(c[-1]) for c in own), int(count[-1])
            last = np.zeros(len(b), bool)
            last[:-1] = begins[1:]
            held = (b, columns, last)
        if held is not None:
            held[2][-1] = True
            yield out(*held, True)

    by = [*[F.asc(k) for k in keys], *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    stored = settle(dealt.mapInArrow(thrifty(run), StructType([*df.schema.fields, *added.fields])), "scan")
    edges = stored.where("scan_first OR scan_final").select("scan_part", "scan_first", "scan_final", "scan_lead", *keys, "n", *running).collect()  # up to two rows a partition
    return _carried(stored, edges, keys, running).select(*names, "n", *running, "last")


def _carried(stored: DataFrame, edges: list, keys: list[str], running: dict) -> DataFrame:
    """The stored ranges with what earlier ones hand on to each."""
    firsts = {r["scan_part"]: tuple(r[k] for k in keys) for r in edges if r["scan_first"]}
    finals = {r["scan_part"]: r for r in edges if r["scan_final"]}
    rows, key, carry = [], None, [0] * (1 + len(running))
    for p in sorted(firsts):
        if key != firsts[p]:
            carry = [0] * len(carry)
        rows.append((p, *carry))
        r = finals[p]
        tail = [r["n"], *[r[c] for c in running]]
        if r["scan_lead"]:  # one group fills the range
            tail = [a ^ b if op == "xor" else a + b for a, b, op in zip(tail, carry, ["sum", *[op for op, _ in running.values()]], strict=True)]
        key, carry = tuple(r[k] for k in keys), tail
    parts = sorted(firsts)
    more = {p for p, q in zip(parts, parts[1:], strict=False) if tuple(finals[p][k] for k in keys) == firsts[q]}
    carries = stored.sparkSession.createDataFrame([(*r, r[0] in more) for r in rows], "scan_part int, " + ", ".join(f"scan_carry{k} long" for k in range(len(carry))) + ", scan_more boolean")
    out = stored.join(F.broadcast(carries), "scan_part")  # a row a partition
    lead = lambda k: F.when(F.col("scan_lead"), F.col(f"scan_carry{k}")).otherwise(F.lit(0).cast("long"))
    add = {"n": F.col("n") + lead(0), "last": F.col("last") & ~(F.col("scan_final") & F.col("scan_more"))}
    for k, (c, (op, _)) in enumerate(running.items(), 1):
        add[c] = F.col(c).bitwiseXOR(lead(k)) if op == "xor" else F.col(c) + lead(k)
    return out.withColumns(add)
