"""Sequence functions as Columns, and minimizers in both forms: declarative and as an Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_SEED = 0x517CC1B727220A95


def reverse_complement(s: Column) -> Column:
    """Lower-case bases are accepted; everything but A, C, G and T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "N"), "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer (upper-case ACGT) and its reverse complement; strings order as 2-bit codes do."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def gc_content(s: Column) -> Column:
    """G and C over valid bases; 0 without any."""
    valid = F.length(F.regexp_replace(s, "[^ACGTacgt]", ""))
    return F.when(valid > 0, F.length(F.regexp_replace(s, "[^GCgc]", "")) / valid).otherwise(0.0)


def kmers(df: DataFrame, key: str, seq: str, k: int, *, tile: int = 512) -> DataFrame:
    """(key, pos, last, kmer) of all positions; ``last`` is the last one's.

    Sequences are cut into tiles first (see :func:`pieces`) and k-mers from those.
    """
    tiles = pieces(df.select(key, F.col(seq).alias("_s"), (F.length(seq) - k).alias("last")), [key, "last"], "_s", tile, tile, name="_w", overlap=k - 1)
    tiles = tiles.filter(F.length("_w") >= k).withColumnRenamed("start", "_t")
    inner = F.explode(F.sequence(F.lit(0), F.length("_w") - k))
    return tiles.select(key, "last", "_t", "_w", inner.alias("_i")).select(key, (F.col("_t") + F.col("_i")).cast("int").alias("pos"), "last", F.substr("_w", F.col("_i") + 1, F.lit(k)).alias("kmer"))


def minimizers(df: DataFrame, key: str, seq: str, *, k: int = 11, w: int = 5) -> DataFrame:
    """(key, pos, kmer, same_strand): lexicographic minimizers of sequences of A, C, G and T, as windows.

    Of each ``w`` consecutive k-mers the least canonical one, the earlier of equals; emitted where its position
    changes, from position w - 1 on and at the last k-mer.
    """
    order = Window.partitionBy(key).orderBy("pos")
    c = kmers(df, key, seq, k)
    m = F.min(F.struct(canonical(F.col("kmer")).alias("c"), "pos", "kmer")).over(order.rowsBetween(-(w - 1), 0))
    seen = c.withColumn("_m", m).filter((F.col("pos") >= w - 1) | (F.col("pos") == F.col("last")))
    kept = seen.withColumn("_before", F.lag("_m.pos").over(order)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("_m.pos")))
    return kept.select(key, F.col("_m.pos").alias("pos"), F.col("_m.c").alias("kmer"), (F.col("_m.c") == F.col("_m.kmer")).alias("same_strand"))


_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def hash_kmer(x: np.ndarray, seed: int = HASH_SEED) -> np.ndarray:
    """An invertible 64-bit mix modulo 2^64."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = (~x + (x << u(21))) ^ u(seed)
        x = x ^ (x >> u(24))
        x = x + (x << u(3)) + (x << u(8))
        x = x ^ (x >> u(14))
        x = x + (x << u(2)) + (x << u(4))
        x = x ^ (x >> u(28))
        return x + (x << u(31))


def minimizers_of(seq: bytes, k: int, w: int, mix=hash_kmer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (or code, where ``mix`` is None), position and strand (True: forward) of a sequence's minimizers; an N restarts k-mers and windows."""
    code = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(code) - k + 1
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    if n <= 0:
        return empty
    fwd, rev = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        c = (code[i : i + n] & 3).astype(np.uint64)
        fwd = (fwd << np.uint64(2)) | c
        rev |= (np.uint64(3) - c) << np.uint64(2 * i)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    good = bad[k:] == bad[:-k]
    h = np.minimum(fwd, rev)
    h = mix(h) if mix else h
    starts = np.flatnonzero(good & ~np.concatenate([[False], good[:-1]]))
    ends = np.flatnonzero(good & ~np.concatenate([good[1:], [False]])) + 1
    at: list[np.ndarray] = []
    for a, e in zip(starts, ends):
        x = h[a:e]
        pos = np.arange(a, e)
        padded = np.concatenate([np.full(w - 1, np.uint64(2**64 - 1)), x])
        win = np.lib.stride_tricks.sliding_window_view(padded, w)
        m = np.maximum(np.arange(len(x)) - (w - 1) + win.argmin(axis=1), 0) + a  # argmin takes the earlier of equals
        emit = (pos >= w - 1) | (pos == n - 1)
        m = m[emit]
        at.append(m[np.concatenate([[True], m[1:] != m[:-1]])] if len(m) else m)
    p = np.concatenate(at) if at else empty[1]
    return h[p], p, fwd[p] <= rev[p]


def minimizer_kernel(k: int, w: int, mix=hash_kmer):
    """For mapInArrow over (key, seq): rows (key, hash, pos, forward); hashes as signed 64-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [minimizers_of((s or "").encode(), k, w, mix) for s in b.column(1).to_pylist()]
            size = [len(f[1]) for f in found]
            keys = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), size)))
            if not found:
                continue
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[2] for f in found]))],
                names=["key", "hash", "pos", "forward"],
            )

    return run


def hashed_minimizers(df: DataFrame, key: str, seq: str, *, k: int = 19, w: int = 19) -> DataFrame:
    out = df.select(key, seq).mapInArrow(minimizer_kernel(k, w), "key long, hash long, pos long, forward boolean")
    return out.withColumnRenamed("key", key)


def coded_minimizers(df: DataFrame, key: str, seq: str, *, k: int = 11, w: int = 5) -> DataFrame:
    """(key, kmer, pos, same_strand) as :func:`minimizers` gives them, with k-mers as 2-bit codes (k up to 31).

    Codes order as strings do, so the kernel finds the same minimizers without a row for each k-mer.
    """
    out = df.select(key, seq).mapInArrow(minimizer_kernel(k, w, None), "key long, hash long, pos long, forward boolean")
    return out.select(F.col("key").alias(key), F.col("hash").alias("kmer"), "pos", F.col("forward").alias("same_strand"))


def minimizer_totals(df: DataFrame, key: str, seq: str, *, k: int = 11, w: int = 5) -> DataFrame:
    """(key, n, first_pos, last_pos, n_kmers) of each row's minimizers as :func:`coded_minimizers` finds them, without a row for each; rows that have none are left out."""
    kinds = {"n": pa.int64(), "first_pos": pa.int32(), "last_pos": pa.int32(), "n_kmers": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, told = [], []
            for i, s in enumerate(b.column(1)):
                h, pos, _ = minimizers_of((s.as_py() or "").encode(), k, w, None)
                if len(pos):
                    rows.append(i)
                    told.append((len(pos), pos[0], pos[-1], len(np.unique(h))))
            own = b.column(0).take(pa.array(rows, pa.int64())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([own, *(pa.array([t[j] for t in told], kind) for j, kind in enumerate(kinds.values()))], names=["key", *kinds])

    out = df.select(key, seq).mapInArrow(run, "key long, n long, first_pos int, last_pos int, n_kmers long")
    return out.withColumnRenamed("key", key)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base codes (4: none) of all sequences of a batch and their offsets."""
    texts = [(s or "").encode() for s in col.to_pylist()]
    return _CODE[np.frombuffer(b"".join(texts), np.uint8)], np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _codes(code: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, sequence numbers and 2-bit codes of the k-mers without N."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = np.zeros(n, np.uint64)
    for i in range(k):
        c = (c << np.uint64(2)) | (code[i : i + n] & 3).astype(np.uint64)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero((bad[k:] == bad[:-k]) & (owner[:n] == owner[k - 1 :]))
    return at, owner[at], c[at]


def reverse_codes(c: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    out = np.zeros_like(c)
    for i in range(k):
        out = (out << np.uint64(2)) | (np.uint64(3) - ((c >> np.uint64(2 * i)) & np.uint64(3)))
    return out


def window_statistics(df: DataFrame, keys: list[str], seq: str, *, k: int = 3, palindrome: int = 6) -> DataFrame:
    """(keys, entropy, density) of each window: what :func:`kmer_entropy` and :func:`palindrome_density` compute, in one
    pass over the windows and without a row for each k-mer. No k-mer: entropy 0, density null."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", entropy double, density double"
    names = [*keys, "entropy", "density"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, off = _flat(b.column(len(keys)))
            m = b.num_rows
            _, owner, c = _codes(code, off, k)
            cell, count = np.unique(owner * 4**k + c.astype(np.int64), return_counts=True)
            total = np.bincount(owner, minlength=m).astype(np.float64)
            spread = np.bincount(cell // 4**k, count * np.log2(count), m)
            entropy = np.where(total > 0, np.log2(np.maximum(total, 1)) - spread / np.maximum(total, 1), 0.0)
            _, owner, c = _codes(code, off, palindrome)
            n = np.bincount(owner, minlength=m)
            own = np.bincount(owner, c == reverse_codes(c, palindrome), m)
            density = pa.array(own / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(entropy), density], names=names)

    return df.select(*keys, seq).mapInArrow(run, schema)


def seeds_in(df: DataFrame, key: str, seq: str, wanted: np.ndarray, k: int) -> DataFrame:
    """(key, pos, code): k-mers of the sequences whose code is in the sorted array ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                code, off = _flat(part.column(1))
                at, owner, c = _codes(code, off, k)
                hit = wanted[np.minimum(np.searchsorted(wanted, c), len(wanted) - 1)] == c if len(wanted) else np.zeros(len(c), bool)
                at, owner, c = at[hit], owner[hit], c[hit]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)).cast(pa.int64()), pa.array(at - off[owner]), pa.array(c.view(np.int64))], names=["key", "pos", "code"])

    return df.select(key, seq).mapInArrow(run, "key long, pos long, code long").withColumnRenamed("key", key)


def code_of(kmer: Column) -> Column:
    """The 2-bit code of a k-mer of A, C, G and T (k up to 31)."""
    return F.aggregate(F.filter(F.split(kmer, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 2).bitwiseOR(F.instr(F.lit("ACGT"), x).cast("long") - 1))


def tokens(s: Column, length: int = 512) -> Column:
    """Token ids of a nucleotide text: CLS 2, A4 C5 G6 T7 N8 (others UNK 1), SEP 3, cut and padded (0) to ``length``."""
    ids = F.transform(F.split(F.upper(s), ""), lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in zip("ACGTN", range(4, 9)) for x in p]), c), F.lit(1)))
    body = F.slice(F.filter(ids, lambda x: x.isNotNull()), 1, length - 2)
    full = F.concat(F.array(F.lit(2)), F.when(F.length(s) > 0, body).otherwise(F.array().cast("array<int>")), F.array(F.lit(3)))
    return F.slice(F.concat(full, F.array_repeat(F.lit(0), length)), 1, length)


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of equally long strings; null for others."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))))


def pieces(df: DataFrame, keys: list[str], seq: str, size: int, step: int, *, stop_at_end: bool = False, name: str = "piece", overlap: int = 0) -> DataFrame:
    """(keys, start, end, piece): ``size`` bases from every ``step``-th on, and ``overlap`` more in the text of a piece.

    The last pieces are shorter; with ``stop_at_end`` none begins after one that reaches the end. An Arrow kernel, as
    slicing costs nothing there, while a substring of a UTF-8 string costs its position: this is linear in the
    sequence, so whole chromosomes can be cut.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + f", start long, end long, {name} string"
    names = [*keys, "start", "end", name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: pa.RecordBatch, rows: list[int], starts: list[int], ends: list[int], texts: list[str]) -> pa.RecordBatch:
            take = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:-1]), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())], names=names)

        for b in batches:
            rows, starts, ends, texts, held = [], [], [], [], 0
            for i, s in enumerate(b.column(len(keys)).to_pylist()):
                n = len(s or "")
                last = max(0, -(-(n - size) // step)) * step if stop_at_end else n - 1
                for at in range(0, min(last, n - 1) + 1 if n else 0, step):
                    rows.append(i)
                    starts.append(at)
                    ends.append(min(at + size, n))
                    texts.append(s[at : at + size + overlap])
                    held += size + overlap
                    if held > 4 << 20:
                        yield made(b, rows, starts, ends, texts)
                        rows, starts, ends, texts, held = [], [], [], [], 0
            if rows:
                yield made(b, rows, starts, ends, texts)

    return df.select(*keys, seq).mapInArrow(run, schema)


def windows(df: DataFrame, key: str, seq: str, size: int, step: int) -> DataFrame:
    """(key, start, end, window): windows of ``size`` every ``step`` bases; the last ones are shorter."""
    return pieces(df, [key], seq, size, step, name="window")


def chunks(df: DataFrame, key: str, seq: str, *, size: int = 1024, overlap: int = 128) -> DataFrame:
    """(key, start, end, chunk): overlapping windows; none begins after one that reaches the end."""
    return pieces(df, [key], seq, size, size - overlap, stop_at_end=True, name="chunk")


def kmer_entropy(df: DataFrame, keys: list[str], seq: str, k: int) -> DataFrame:
    """(keys, entropy): Shannon entropy in bits of the k-mers without N."""
    at = F.explode(F.sequence(F.lit(0), F.length(seq) - k))
    found = df.filter(F.length(seq) >= k).select(*keys, F.col(seq), at.alias("_p")).select(*keys, F.substr(F.col(seq), F.col("_p") + 1, F.lit(k)).alias("kmer")).filter("kmer not like '%N%'")
    n = found.groupBy(*keys, "kmer").agg(F.count("*").alias("n"))
    # -sum(p log p) = log N - sum(n log n) / N: no join with the totals.
    return n.groupBy(*keys).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def palindrome_density(df: DataFrame, keys: list[str], seq: str, k: int = 6) -> DataFrame:
    """(keys, density): share of valid k-mers that equal their reverse complement."""
    at = F.explode(F.sequence(F.lit(0), F.length(seq) - k))
    found = df.filter(F.length(seq) >= k).select(*keys, F.col(seq), at.alias("_p")).select(*keys, F.substr(F.col(seq), F.col("_p") + 1, F.lit(k)).alias("kmer")).filter("kmer not like '%N%'")
    return found.groupBy(*keys).agg((F.count_if(F.col("kmer") == F.reverse(F.translate("kmer", "ACGT", "TGCA"))) / F.count("*")).alias("density"))


def period_of(seq: bytes, most: int = 1000, least_share: float = 0.85) -> int:
    """The shift (from 2, at most half the length) at which most bases repeat, the first of equals; -1 below the share."""
    s = np.frombuffer(seq.upper(), np.uint8)
    best, at = -1.0, -1
    for p in range(2, min(most, len(s) // 2) + 1):
        share = float((s[:-p] == s[p:]).mean())
        if share > best:
            best, at = share, p
    return at if best >= least_share else -1


def tandem_period(df: DataFrame, keys: list[str], seq: str, most: int = 1000) -> DataFrame:
    names = [*keys, "period"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", period int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([period_of((s or "").encode(), most) for s in b.column(len(keys)).to_pylist()], pa.int32())], names=names)

    return df.select(*keys, seq).mapInArrow(run, schema)


def found_within(seq: bytes, anchor: bytes, k: int) -> bool:
    """Whether the anchor occurs with at most ``k`` mismatches; tiles shorter than 8 bases allow exact matches only.

    By the pigeon-hole principle one of k + 1 tiles occurs unchanged; its places are verified.
    """
    tile = len(anchor) // (k + 1)
    if k == 0 or tile < 8:
        return anchor in seq
    a = np.frombuffer(anchor, np.uint8)
    s = np.frombuffer(seq, np.uint8)
    for t in range(k + 1):
        part, at = anchor[t * tile : (t + 1) * tile], -1
        while (at := seq.find(part, at + 1)) >= 0:
            start = at - t * tile
            if 0 <= start <= len(seq) - len(anchor) and (s[start : start + len(a)] != a).sum() <= k:
                return True
    return False
