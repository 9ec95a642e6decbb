"""CIGAR strings as Columns, and as aligned bases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = r"^([0-9]+[MIDNSHP=X])+$"


def operations(cigar: Column) -> Column:
    """array<struct<len, op>>."""
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("long").alias("len"), o.alias("op")))


def is_valid(cigar: Column) -> Column:
    return (cigar == "*") | cigar.rlike(VALID)


def length_of(ops: Column, kinds: str) -> Column:
    """Summed lengths of the operations in ``kinds``."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + F.when(F.instr(F.lit(kinds), x["op"]) > 0, x["len"]).otherwise(0))


def stats(df: DataFrame, cigar: str) -> DataFrame:
    """Adds query_length, ref_length, aligned (M, = and X) and identity (M counts as match)."""
    ops = operations(F.col(cigar))
    d = df.withColumn("_ops", ops)
    o = F.col("_ops")
    match, total = length_of(o, "M="), length_of(o, "M=XID")
    return d.withColumns({"query_length": length_of(o, "MIS=X"), "ref_length": length_of(o, "MDN=X"), "aligned": length_of(o, "M=X"), "identity": F.when(total > 0, match / total).otherwise(0.0)}).drop("_ops")


_OPS = "MIDNSHP=X"
_QUERY, _REF, _BASE = (np.array([o in kinds for o in _OPS]) for kinds in ("MIS=X", "MDN=X", "M=X"))
_CODE = np.full(256, 255, np.uint8)
_CODE[[ord(o) for o in _OPS]] = np.arange(len(_OPS))


def parsed(cigars: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, length and operation number of all operations; ``*`` and anything malformed have none."""
    cigars = [c if re.fullmatch(rb"([0-9]{1,15}[MIDNSHP=X])+", c) else b"" for c in cigars]
    text = np.frombuffer(b"".join(cigars), np.uint8)
    op = _CODE[text]
    ends = np.flatnonzero(op < 255)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    place = np.repeat(ends, ends - starts + 1) - np.arange(len(text)) - 1  # digits right of this one
    worth = np.where(place >= 0, (text.astype(np.int64) - 48) * 10 ** np.maximum(place, 0), 0)
    length = np.add.reduceat(worth, starts) if len(ends) else np.zeros(0, np.int64)
    row = np.searchsorted(np.cumsum([len(c) for c in cigars]), ends, side="right")
    return row, length, op[ends]


def walk(df: DataFrame, keys: list[str], cigar: str, start: str, *, most: int = 1 << 20) -> DataFrame:
    """(keys, ref_pos, read_pos) of each aligned base.

    An Arrow kernel: the operations' offsets are running sums over all rows of a batch, so the work is linear in a
    CIGAR's length; about ``most`` bases leave it at a time.
    """
    names = [*keys, "ref_pos", "read_pos"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", ref_pos long, read_pos long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n, op = parsed([(c or "").encode() for c in b.column(len(keys)).to_pylist()])
            if not len(row):
                continue
            first = b.column(len(keys) + 1).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            new = np.append(True, row[1:] != row[:-1])
            at = []
            for moves in (np.where(_REF[op], n, 0), np.where(_QUERY[op], n, 0)):
                before = np.cumsum(moves) - moves
                at.append(before - np.maximum.accumulate(np.where(new, before, 0)))
            own = np.flatnonzero(_BASE[op] & (n > 0))
            total = np.cumsum(n[own])
            for a in range(0, int(total[-1]) if len(own) else 0, most):
                k = np.arange(a, min(a + most, int(total[-1])))
                i = np.searchsorted(total, k, side="right")
                step = k - (total[i] - n[own[i]])
                o = own[i]
                columns = [c.take(pa.array(row[o])) for c in b.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(first[row[o]] + at[0][o] + step), pa.array(at[1][o] + step)], names=names)

    return df.select(*keys, cigar, F.col(start).cast("long")).mapInArrow(run, schema)


def bases_at(df: DataFrame, keys: list[str], site: str, *, most: int = 1 << 22) -> DataFrame:
    """(keys, site, read_pos, base) of rows (keys, cigar, start, seq, _at, site): the aligned bases at the reference positions ``_at``, an
    array beside the array of their ``site``.

    As :func:`walk`, but only what is asked for is looked up; texts of about ``most`` characters are held at a time.
    """
    names = [*keys, site, "read_pos", "base"]
    kinds = {f.name: f.dataType for f in df.schema}
    schema = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + f", {site} {kinds[site].elementType.simpleString()}, read_pos long, base string"

    def some(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size, first = 0, 0
        for i, (c, s) in enumerate(zip(b.column("cigar").to_pylist(), b.column("seq").to_pylist())):
            size += len(c or "") + len(s or "")
            if size > most:
                yield b.slice(first, i + 1 - first)
                size, first = 0, i + 1
        if first < b.num_rows:
            yield b.slice(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in some(whole)):
            row, n, op = parsed([(c or "").encode() for c in b.column("cigar").to_pylist()])
            if not len(row):
                continue
            new, at = np.append(True, row[1:] != row[:-1]), []
            for moves in (np.where(_REF[op], n, 0), np.where(_QUERY[op], n, 0)):
                before = np.cumsum(moves) - moves
                at.append(before - np.maximum.accumulate(np.where(new, before, 0)))
            own = np.flatnonzero(_BASE[op] & (n > 0))
            if not len(own):
                continue
            asked = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("_at")).to_numpy(zero_copy_only=False))
            pos = b.column("_at").flatten().to_numpy(zero_copy_only=False) - b.column("start").fill_null(0).to_numpy(zero_copy_only=False)[asked]
            wide = max(int((at[0][own] + n[own]).max()), int(pos.max(initial=0))) + 1
            o = own[np.maximum(np.searchsorted(row[own] * wide + at[0][own], asked * wide + pos, side="right") - 1, 0)]
            step = pos - at[0][o]
            texts = [s or "" for s in b.column("seq").to_pylist()]
            length = np.array([len(s) for s in texts])
            begin = np.cumsum(length) - length
            read_pos = at[1][o] + step
            hit = np.flatnonzero((row[o] == asked) & (step >= 0) & (step < n[o]) & (read_pos < length[asked]))
            letter = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)[begin[asked[hit]] + read_pos[hit]]
            seen, which = np.unique(letter, return_inverse=True)
            base = pa.array([chr(x) for x in seen], pa.string()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(asked[hit])) for k in keys), b.column(site).flatten().take(pa.array(hit)), pa.array(read_pos[hit]), base], names=names)

    return df.select(*keys, "cigar", "start", "seq", "_at", site).mapInArrow(run, schema)
