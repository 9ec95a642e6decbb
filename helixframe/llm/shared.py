"""What the corpus operators share: reading tables, the shared folder, and byte-level text kernels.

The kernels see a batch of texts as one flat ``uint8`` buffer with offsets, so that a step over all
bytes of a batch is one numpy call instead of a Python loop over texts.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def _give_back() -> None:
    """Large arrays are mapped apart, so that a worker returns their memory when they are freed (glibc's threshold would adapt)."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_give_back()

#: Texts are handled in slices of about this many bytes, so that the arrays over their bytes stay in the cache; a single longer text is a slice of its own.
CHUNK_BYTES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("helixframe.shared.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="helixframe-")
            spark.conf.set("helixframe.shared.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_SPLITS = "spark.sql.files.minPartitionNum"
_REPLAYED = {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "Union"}


def numbered(df: DataFrame) -> DataFrame:
    """``df``, or a written copy of it, as rows that are the same and in the same tasks in every scan.

    Operators number rows by ``monotonically_increasing_id`` in several branches of a plan, so the numbers must not
    depend on how a branch is planned. A scan of files with deterministic projections and filters is taken as it is, and
    the number of its splits, which else follows the executors at hand, is fixed for the session. All others (joins,
    aggregates, repartitions, Python functions) are written once to the shared folder and scanned from there.
    """
    spark = df.sparkSession
    if spark.conf.get(_SPLITS, None) is None:
        spark.conf.set(_SPLITS, str(spark.sparkContext.defaultParallelism))
    return df if _is_scan(df._jdf.queryExecution().analyzed()) else stored(df)


def _is_scan(plan) -> bool:
    """Whether a logical plan reads files and does nothing that could move a row to another task."""
    below = plan.children()
    below = [below.apply(k) for k in range(below.size())]
    name = plan.nodeName().split(" ")[0]
    return (name in _REPLAYED or name.startswith("Relation")) and plan.deterministic() and all(map(_is_scan, below))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_2``, ``name_3``, .. that no column of ``df`` has."""
    taken, out, k = {c.lower() for c in df.columns}, name, 1
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null ids belong to fold 0 of nobody (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def texts_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One flat uint8 buffer and int64 offsets (n+1) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, so that work is balanced by bytes and not by rows."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


_MASK = (1 << 64) - 1
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_powers: list[np.ndarray] = []
_STEP, _STEP_BACK = pow(_RADIX, 1 << 15, 1 << 64), pow(_INVERSE, 1 << 15, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^0..r^n and r^-0..r^-n modulo 2^64; kept between calls of a worker."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        a, b = np.full(size, _RADIX, np.uint64), np.full(size, _INVERSE, np.uint64)
        a[0] = b[0] = 1
        _powers[:] = [np.multiply.accumulate(a), np.multiply.accumulate(b)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_NP = np.frombuffer(LOWER, np.uint8)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


NONSPACE = bytes(int(not x) for x in SPACES)


def through(buf: np.ndarray, table: bytes) -> np.ndarray:
    """Each byte's entry in a table of 256."""
    return np.frombuffer(buf.tobytes().translate(table), np.uint8)


def holds(buf: np.ndarray, table: bytes) -> np.ndarray:
    """Where the bytes' entries in a table of 0 and 1 are 1."""
    return through(buf, table).view(np.bool_)


def _two_bytes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below U+0800: whether it is a capital, and its lower case (where that has two bytes as well)."""
    upper, lower = np.zeros(2048, bool), np.arange(2048)
    for c in range(128, 2048):
        low = chr(c).lower()
        upper[c] = chr(c).isupper()
        if len(low) == 1 and 128 <= ord(low) < 2048:
            lower[c] = ord(low)
    return upper, lower


_UPPER, _LOWERED = _two_bytes()


def folded_case(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, and the first bytes of capitals; characters of one or two bytes (Latin, Greek, Cyrillic, ..)."""
    low, capital = through(buf, LOWER), (buf >= 65) & (buf <= 90)
    at = np.flatnonzero((buf >= 0xC2) & (buf < 0xE0))
    at = at[at + 1 < len(buf)]
    if len(at):
        code = ((buf[at] & 31).astype(np.int64) << 6) | (buf[at + 1] & 63)
        capital[at[_UPPER[code]]] = True
        change = _LOWERED[code] != code
        at, code = at[change], _LOWERED[code[change]]
        if len(at):
            low = low.copy()
            low[at], low[at + 1] = 0xC0 | (code >> 6), 0x80 | (code & 63)
    return low, capital


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of True that doesn't cross a text's border."""
    n = len(inside)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    inner = off[(off > 0) & (off < n)]
    inner = np.unique(inner[inside[inner] & inside[inner - 1]])
    starts = np.concatenate([[0] if inside[0] else [], starts, inner]).astype(np.int64)
    ends = np.concatenate([ends, inner, [n] if inside[-1] else []]).astype(np.int64)
    if len(inner):
        starts.sort()
        ends.sort()
    # Texts by the number of runs that begin in them: texts are fewer than runs.
    return starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))


_BLOCK = 1 << 15


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by differences of one running sum; starts and ends ascend.

    The sum runs in blocks that stay in the cache, so memory doesn't grow with the texts beyond what the spans need.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(_BLOCK)
    n = len(buf)
    lower, upper = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    edges = np.arange(0, n + _BLOCK, _BLOCK)
    first, last = np.searchsorted(starts, edges), np.searchsorted(ends, edges, side="right")
    last[0] = 0
    shift, carry = 1, np.uint64(0)
    sums = np.empty(_BLOCK + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, a in enumerate(range(0, n, _BLOCK)):
            x = buf[a : a + _BLOCK].astype(np.uint64)
            m = len(x)
            x += np.uint64(1)
            x *= up[:m]
            x *= np.uint64(shift)
            x[0] += carry
            sums[0] = carry
            np.cumsum(x, out=sums[1 : m + 1])
            s, e = slice(first[k], first[k + 1]), slice(last[k], last[k + 1])
            at = starts[s] - a
            lower[s] = sums[at]
            upper[e] = sums[ends[e] - a]

            carry = sums[m]
            shift = shift * _STEP & _MASK
        lower[first[-1] :] = carry  # empty spans at the very end
        upper[: np.searchsorted(ends, 0, side="right")] = 0  # empty spans at the very beginning
        scale = down[starts % _BLOCK] * _block_scales(n // _BLOCK + 1)[starts // _BLOCK]
        return mix((upper - lower) * scale + (ends - starts).astype(np.uint64))


def _block_scales(count: int) -> np.ndarray:
    """Powers of the inverse radix at the blocks' beginnings."""
    with np.errstate(over="ignore"):
        x = np.full(count, _STEP_BACK, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values (len - width + 1 of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = mix(out ^ values[k : k + n]) + np.uint64(k + 1) if k < 2 else (out * np.uint64(_RADIX)) ^ values[k : k + n]
        return mix(out)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of ``name type``."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
