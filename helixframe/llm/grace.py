"""Grace hash grouping of records by complete content (exact deduplication, and the payload store of the archive).

1. *Fold.* Each scan task groups its own rows in open-addressing tables and passes on one record for each
   different content, so a content that a third of all rows share crosses the network once a task, not once a row.
2. *Grace.* These records are partitioned by their digest. A task that gets more bytes than its table may hold
   partitions them by further digest bits to spill files, and those again, until a bucket fits. Tables compare
   digests first and then the complete bytes: equal digests alone never make two records equal. A table, and a spill
   file too, holds a content once, whatever the number of its records: of the others eight bytes are kept.
3. *Join.* Every row finds its group by the row number of the record that stood for it in step 1.

Spill files lie in the folder of ``spark.checkpoint.dir``, reached by ``pyarrow.fs``; they live no longer than
their task, which starts anew if its executor is lost.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, arrow, shared_dir

FOLDED = "rid long, id long, rep long, digest binary, n_bytes long, rows long, content binary"
DECIDED = "rid long, keep_rid long, keep_id long, group_size long, digest binary, n_bytes long, payload binary"


class OpenTable:
    """Open addressing with linear probing over (digest, content); no content is stored twice."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self.slots, self.digests, self.contents = [-1] * slots, [], []

    def find(self, digest: bytes, content: bytes) -> int:
        """The entry of ``content``, made if there is none."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (k := self.slots[at]) >= 0:
            if self.digests[k] == digest and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        k = self.slots[at] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        if 2 * k > mask:
            self._grow()
        return k

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, d in enumerate(self.digests):
            at = int.from_bytes(d[8:16], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _small(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of few rows: Python objects are made of one at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _order(id_: int | None, rid: int) -> tuple:
    """Larger is better: the largest id, null ids last; among equal ids the largest row number."""
    return (id_ is not None, id_ or 0, rid)


def _fold(lower: bool, most: int, digest: Callable[[bytes], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(FOLDED)
        rows: list[tuple] = []
        entry: list[int] = []
        held, t = 0, OpenTable()

        def flush() -> pa.RecordBatch:
            best: list[int] = [-1] * len(t.contents)
            count = [0] * len(t.contents)
            for k, e in enumerate(entry):
                count[e] += 1
                if best[e] < 0 or _order(rows[k][1], rows[k][0]) > _order(rows[best[e]][1], rows[best[e]][0]):
                    best[e] = k
            own = [best[e] == k for k, e in enumerate(entry)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r for r, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.int64()), pa.array([rows[best[e]][0] for e in entry], pa.int64()),
                    pa.array([t.digests[e] for e in entry], pa.binary()), pa.array([len(t.contents[e]) for e in entry], pa.int64()),
                    pa.array([count[e] if o else None for e, o in zip(entry, own)], pa.int64()), pa.array([t.contents[e] if o else None for e, o in zip(entry, own)], pa.binary()),
                ],
                schema=schema,
            )

        for b in _small(batches):
            for rid, id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.cast(b.column(2), pa.binary()).to_pylist()):
                text = (text or b"").translate(LOWER) if lower else text or b""
                before = len(t.contents)
                entry.append(t.find(digest(text), text))
                rows.append((rid, id_))
                held += 64 + (len(text) if len(t.contents) > before else 0)
                if held >= most:
                    yield from _small([flush()])
                    held, t = 0, OpenTable()
                    rows, entry = [], []
        if rows:
            yield from _small([flush()])

    return run


class Group:
    """The records of one content: their numbers, the best of them, and how many rows they stand for."""

    __slots__ = ("best", "rids", "rows")

    def __init__(self) -> None:
        self.rids, self.rows, self.best = array("q"), 0, None

    def add(self, rids: array | list, best: tuple, rows: int) -> None:
        self.rids.extend(rids)
        self.rows += rows
        if self.best is None or _order(*best) > _order(*self.best):
            self.best = best


class _Spill:
    """Files that hold the groups of one level, by the digest byte of that level."""

    def __init__(self, base: str, level: int, fan: int) -> None:
        self.fs, root = pafs.FileSystem.from_uri(base)
        self.root, self.level, self.fan, self.open, self.bytes = f"{root}/grace-{uuid.uuid4().hex}", level, fan, {}, 0
        self.fs.create_dir(self.root, recursive=True)

    def add(self, t: OpenTable, groups: list[Group]) -> None:
        parts: dict[int, list[int]] = {}
        for k, d in enumerate(t.digests):
            parts.setdefault(d[16 + self.level] % self.fan, []).append(k)
        for p, all_ in parts.items():
            for at in range(0, len(all_), 512):
                ks = all_[at : at + 512]
                columns = [
                    pa.array([t.digests[k] for k in ks], pa.binary()), pa.array([t.contents[k] for k in ks], pa.large_binary()), pa.array([groups[k].rids.tobytes() for k in ks], pa.large_binary()),
                    pa.array([groups[k].best[0] for k in ks], pa.int64()), pa.array([groups[k].best[1] for k in ks], pa.int64()), pa.array([groups[k].rows for k in ks], pa.int64()),
                ]
                data = pa.RecordBatch.from_arrays(columns, names=list("abcdef"))
                if p not in self.open:
                    sink = self.fs.open_output_stream(f"{self.root}/{p}")
                    self.open[p] = (sink, pa.ipc.new_stream(sink, data.schema))
                self.open[p][1].write_batch(data)
                self.bytes += data.nbytes

    def close(self) -> None:
        for sink, writer in self.open.values():
            writer.close()
            sink.close()

    def read(self, p: int) -> Iterator[tuple]:
        with self.fs.open_input_stream(f"{self.root}/{p}") as source, pa.ipc.open_stream(source) as stream:
            for b in stream:
                for digest, content, rids, id_, rid, rows in zip(*(c.to_pylist() for c in b.columns)):
                    own = array("q")
                    own.frombytes(rids)
                    yield digest, content, own, (id_, rid), rows

    def remove(self) -> None:
        self.fs.delete_dir(self.root)


def _bucket(records: Iterator[tuple], base: str, most: int, level: int, fan: int, on_spill: Callable | None = None) -> Iterator[tuple[bytes, bytes, Group]]:
    """The groups of ``records`` (digest, content, record numbers, (id, number) of the best, rows); spills what doesn't fit.

    A level beyond the digest's bytes would hold equal digests only, so it is taken as it is.
    """
    t, groups, size, spill = OpenTable(), [], 0, None
    try:
        for digest, content, rids, best, rows in records:
            k = t.find(digest, content)
            if k == len(groups):
                groups.append(Group())
                size += 320 + len(content)
            groups[k].add(rids, best, rows)
            size += 8 * len(rids)
            if size > most and level < 16 and len(groups) > 1:
                spill = spill or _Spill(base, level, fan)
                spill.add(t, groups)
                t, groups, size = OpenTable(), [], 0
        if spill is None:
            yield from zip(t.digests, t.contents, groups)
            return
        spill.add(t, groups)
        t, groups = OpenTable(), []
        spill.close()
        if on_spill:
            on_spill(spill.bytes)
        for p in sorted(spill.open):
            yield from _bucket(spill.read(p), base, most, level + 1, fan, on_spill)
    finally:
        if spill:
            spill.remove()


def _grace(base: str, most: int, fan: int, payload: Callable | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(DECIDED)
        records = ((d, c, [rid], (id_, rid), n) for b in _small(batches) for rid, id_, n, d, c in zip(*(c.to_pylist() for c in b.columns)))
        held: list[list] = [[] for _ in schema]
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)

        for digest, content, group in _bucket(records, base, most, 0, fan):
            id_, keep = group.best
            for at in range(0, len(group.rids), 1 << 16):
                rids = group.rids[at : at + (1 << 16)]
                for column, values in zip(held, (rids, [keep] * len(rids), [id_] * len(rids), [group.rows] * len(rids), [digest] * len(rids), [len(content)] * len(rids), [None] * len(rids))):
                    column.extend(values)
                size += 64 * len(rids)
                if payload and keep in rids:
                    held[-1][rids.index(keep) - len(rids)] = payload(content)
                    size += len(content)
                if size > 8 << 20:
                    yield flush()
                    held, size = [[] for _ in schema], 0
        if size:
            yield flush()

    return run


def folded(rows: DataFrame, *, lower: bool, fold_bytes: int = 24 << 20, digest: Callable[[bytes], bytes] = lambda b: hashlib.sha256(b).digest()) -> DataFrame:
    """``rows`` (rid, id, content) with the record that stands for each; ``content`` only on those records."""
    return rows.mapInArrow(_fold(lower, fold_bytes, digest), FOLDED)


def decided(local: DataFrame, *, table_bytes: int = 64 << 20, fan: int = 16, payload: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """A row for each record of ``local`` that has content: its group's kept row, id and size over all rows.

    The kept row's has the content as ``payload`` stores it (nothing if that is None).
    """
    reps = local.filter(F.col("content").isNotNull()).select("rid", "id", "rows", "digest", "content")
    return reps.repartition("digest").mapInArrow(_grace(shared_dir(local.sparkSession), table_bytes, fan, payload), DECIDED)
