"""Best-fit packing by large-item matching (operator 10).

Lengths are integers from 1 to the capacity, so the packing is solved on their histogram: the plan says for
*ranges* of equally long pieces into which range of sequences they go, and at what offset. Its size depends on the
capacity alone, not on the rows; each piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow, batch_of, slices, stored, table, texts_of
from .tokens import default_path, tokenizer

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, rid long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PROBES = ["A b  c\n\n d's 12.5%  x", "Àé ñü ß  \t\r\n ok!! 'tis", "", " ", "a<|endoftext|> b", "x" * 300]


@functools.cache
def encoder(path: str) -> Callable[[str, bool], np.ndarray]:
    """A function of a text and whether it holds only characters below U+0800, which gives its ids.

    The vocabulary of a byte-level BPE file whose ids are its merge ranks is also run by tiktoken, four times as
    fast, for texts of those characters; whether both agree is tried on probes, else tokenizers alone is used.
    """
    tok = tokenizer(path)

    def slow(text: str, _: bool = False) -> np.ndarray:
        return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path) as f:
        spec = json.load(f)
    if spec["model"].get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") is not None:
        return slow
    import public_tokenizers
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    if any(fast.encode(p, allowed_special="all") != tok.encode(p, add_special_tokens=False).ids for p in _PROBES):
        return slow
    return lambda text, simple: fast.encode_to_numpy(text, allowed_special="all") if simple else slow(text)


def _pieces(path: str, end: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        schema = arrow(PIECES)
        for b in batches:
            buf, off = texts_of(b.column(1))
            for i, j in slices(off):
                out: list[list] = [[] for _ in schema]
                doc_ids, rids = b.column(0).slice(i, j - i).to_pylist(), b.column(2).slice(i, j - i).to_pylist()
                high = np.flatnonzero(buf[off[i] : off[j]] >= 0xE0) + off[i]
                simple = np.searchsorted(high, off[i + 1 : j + 1]) == np.searchsorted(high, off[i:j])
                for k, text in enumerate(b.column(1).slice(i, j - i).to_pylist()):
                    ids = np.append(encode(text or "", bool(simple[k])), np.uint32(end)).astype("<u4", copy=False)
                    first = len(ids) % capacity or capacity  # only the first piece may be shorter
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    for p, (x, y) in enumerate(zip(bounds, bounds[1:])):
                        for column, v in zip(out, (doc_ids[k], p, x, y - x, zlib.crc32(ids[x:y].tobytes()), rids[k])):
                            column.append(v)
                yield batch_of(schema, *out)

    return run


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the pieces go: (length, first rank, pieces, first sequence, offset) and the number of sequences.

    Large pieces (over a third of the capacity), from the longest: each is paired with the largest other large
    piece that still fits, so that a sequence has two at most. Then the others, from the longest, go best-fit into
    the least gap that holds them, else into new sequences. Sequences alike are one group: (gap, first, number).
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    used = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int]] = []
    groups: list[tuple[int, int, int]] = []  # sorted by gap
    bins = 0

    def put(s: int, n: int, first: int, offset: int) -> None:
        placed.append((s, used[s], n, first, offset))
        used[s] += n
        left[s] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            mates = [m for m in large if m <= min(s, capacity - s) and left[m] - (m == s) > 0]
            m = mates[0] if mates else None
            n = left[s] if m is None else left[s] // 2 if m == s else min(left[s], left[m])
            put(s, n, bins, 0)
            if m is not None:
                put(m, n, bins, s)
            insort(groups, (capacity - s - (m or 0), bins, n))
            bins += n
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            k = bisect_left(groups, (s, -1, -1))
            if k == len(groups):
                groups.append((capacity, bins, n := -(-left[s] // (capacity // s))))
                bins += n
                continue
            gap, first, n = groups.pop(k)
            each = min(gap // s, left[s])
            full = min(n, left[s] // each)  # this many sequences of the group take `each` pieces
            for x in range(each):
                put(s, full, first, capacity - gap + x * s)
            insort(groups, (gap - each * s, first, full))
            if n > full:
                insort(groups, (gap, first + full, n - full))
    return placed, bins


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of each row: ``doc_id, piece, start, length, ids_crc32, rid``; see :func:`pack`."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.monotonically_increasing_id())
    return rows.mapInArrow(_pieces(path or default_path(), end, capacity), PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    """All texts as token pieces in sequences of at most ``capacity`` tokens, in as few sequences as the method finds.

    One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null and empty texts
    have the end token alone. Rows with null or repeated ids are packed like others. An empty table gives no rows.
    The texts are read and encoded once; later steps handle the pieces' numbers, kept in the shared folder.
    """
    spark = docs.sparkSession
    rows = stored(pieces_of(docs, id_col, text_col, path=path, end=end, capacity=capacity))
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.lit(salts)).cast("int"))
    # Ranks among equally long pieces: a count for each (length, salt), at most capacity x salts rows, then a window in each.
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    placed, _ = plan(histogram, capacity)
    within = Window.partitionBy("length", "salt").orderBy("rid", "piece")
    ranked = rows.withColumn("r", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(placed), PACKED
    )


def _place(placed: list[tuple[int, int, int, int, int]]) -> Callable:
    key = np.array(sorted(placed), np.int64).reshape(-1, 5)
    at = (key[:, 0] << 44) + key[:, 1]  # ranks stay below 2^44

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(PACKED)
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            k = np.searchsorted(at, (length << 44) + rank, side="right") - 1
            yield batch_of(schema, b.column(0), b.column(1), b.column(2), length, b.column(4), key[k, 3] + rank - key[k, 1], key[k, 4])

    return run


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
