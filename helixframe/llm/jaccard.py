"""Similarity join on word n-gram sets by chosen paths (operator 8).

A text's set of hashed word trigrams is embedded in COORDINATES one-permutation minima, so that two sets agree in a
coordinate with the probability of their Jaccard similarity. Each run of the join starts at an own root; a set goes
from a node to the children (coordinate, value) of a few coordinates that the node's path chooses, the same for all
sets there. Buckets of at most BLOCK sets are compared as they are. A larger one is split further, unless its sets
agree so often that splitting can't part them; these, and what is still large at MOST_DEPTH, are compared in blocks.
The number of runs gives each pair at the threshold a chance of at least RECALL to meet, also if all its buckets are split.

Equal sets are one class from the start. A bucket compares sketches first, then complete sets, and yields each set's
number of links and a spanning forest, never its pairs; a pair that meets in several buckets is counted in one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow, batch_of, folded_case, fresh, holds, mix, numbered, runs, slices, span_hashes, stored, table, texts_of, window_hashes

NGRAM, THRESHOLD, RECALL = 3, 0.5, 0.99
COORDINATES, SKETCH, BLOCK, BRANCHES, MOST_DEPTH = 128, 64, 512, 3, 4
#: Mean agreement from which a bucket isn't split further.
DENSE = 0.4
EMBEDDED = "rid long, id long, size long, s1 long, s2 long, coords binary"

_INSIDE = bytes(int(48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256))
_EDGES = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(64 - int(math.log2(COORDINATES)))
_SALTS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def gram_sets(buf: np.ndarray, off: np.ndarray, n: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; a text of fewer words has one gram of all its words."""
    low, _ = folded_case(buf)
    starts, ends, doc = runs(holds(buf, _INSIDE), off)
    tokens = span_hashes(low, starts, ends)
    grams = window_hashes(tokens, n)
    first = np.searchsorted(doc, np.arange(len(off)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(tokens[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation minima (sets, COORDINATES); an empty part takes the set's minimum under a hash function of its own.

    Two sets agree in a part with the probability of their similarity, also where both have it empty, and the parts of
    small sets are as independent as those of large ones.
    """
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    for k, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, _EDGES)
            ends = np.append(at[1:], len(s))
            out[k] = s[np.minimum(at, len(s) - 1)]
            empty = np.flatnonzero(ends == at)
            if len(empty):
                out[k, empty] = mix(s[None, :] ^ _SALTS[empty, None]).min(axis=1)
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = texts_of(b.column(2))
        for i, j in slices(off):
            sets = gram_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            with np.errstate(over="ignore"):
                s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                s2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield batch_of(arrow(EMBEDDED), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), [len(s) for s in sets], s1, s2, [c.tobytes() for c in embed(sets)])


def meets(rate: float | np.ndarray) -> float | np.ndarray:
    """The least probability with which sets that agree in ``rate`` of their coordinates meet in a run: its buckets are all split to the end."""
    below = 1.0
    for _ in range(MOST_DEPTH - 1):
        below = 1 - (1 - rate * below) ** BRANCHES
    return rate * below


def runs_for(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold meets with probability ``recall`` even if all its buckets are split.

    The runs choose from the same coordinates, so a pair that happens to agree in few of them is lost in all runs more often.
    """
    if threshold >= 1:
        return 1
    agree = np.arange(COORDINATES + 1)
    ways = np.array([math.lgamma(COORDINATES + 1) - math.lgamma(k + 1) - math.lgamma(COORDINATES - k + 1) for k in agree])
    share = np.exp(ways + agree * math.log(threshold) + (COORDINATES - agree) * math.log(1 - threshold))
    miss = 1 - meets(agree / COORDINATES)
    number = 1
    while number < COORDINATES and share @ miss**number > 1 - recall:
        number += 1
    return number


def _chosen(path: np.ndarray, k: int) -> np.ndarray:
    """The coordinate that a path chooses as its ``k``-th; they differ, as the step is odd."""
    h = mix(path + np.uint64(0xD1342543DE82EF95))
    with np.errstate(over="ignore"):
        return (((h >> np.uint64(32)) + np.uint64(k) * (h | np.uint64(1))) % np.uint64(COORDINATES)).astype(np.int64)


def _split(branches: int) -> Callable:
    """Each row (path, rid, coords) to the children of its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            path = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            coords = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(n, COORDINATES)
            for k in range(branches):
                c = _chosen(path, k)
                with np.errstate(over="ignore"):
                    child = mix(mix(path + np.uint64(k + 1)) ^ (coords[np.arange(n), c].astype(np.uint64) << np.uint64(8)) ^ c.astype(np.uint64))
                yield batch_of(arrow("parent long, branch int, path long, rid long"), b.column(0), pa.array(np.full(n, k), pa.int32()), child.view(np.int64), b.column(1))

    return run


def _roots(number: int) -> Callable:
    """Each row (rid, coords) to one bucket of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            coords = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(n, COORDINATES)
            for r in range(number):
                c = r * (COORDINATES // number)
                path = mix((coords[:, c].astype(np.uint64) << np.uint64(8)) | np.uint64(r))
                yield batch_of(arrow("path long, rid long"), path.view(np.int64), b.column(0))

    return run


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell (the first three columns, by which they are sorted), however they come in batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if held:
            last = held[-1]
            if [last.column(k)[last.num_rows - 1].as_py() for k in range(3)] != key[:, 0].tolist():
                yield _joined(held)
                held = []
        for a, e in zip(cuts[:-2], cuts[1:-1]):
            held.append(b.slice(a, e - a))
            yield _joined(held)
            held = []
        held.append(b.slice(cuts[-2], cuts[-1] - cuts[-2]))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _sides(cell: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both sides of a cell; the same array twice if it compares a block with itself."""
    i, j = cell.column(1)[0].as_py(), cell.column(2)[0].as_py()
    if i == j:
        rows = np.arange(cell.num_rows)
        return rows, rows
    block = cell.column(4).to_numpy(zero_copy_only=False)
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def _sift(least: float) -> Callable:
    """Rows (path, i, j, rid, block, sketch) whose sketch is like another's in its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, rids = [], []
        for cell in _by_cell(batches):
            x, y = _sides(cell)
            if not len(x) or not len(y):
                continue
            sketch = np.frombuffer(b"".join(cell.column(5).to_pylist()), np.uint8).reshape(cell.num_rows, SKETCH)
            near = np.zeros(cell.num_rows, bool)
            for a in range(0, len(x), 64):
                like = (sketch[x[a : a + 64], None, :] == sketch[None, y, :]).sum(axis=2) >= least * SKETCH
                like &= x[a : a + 64, None] != y[None, :]
                near[x[a : a + 64]] |= like.any(axis=1)
                near[y] |= like.any(axis=0)
            if near.any():
                rids.append(cell.column(3).to_numpy(zero_copy_only=False)[near])
                paths.append(np.full(int(near.sum()), cell.column(0)[0].as_py()))
            if len(paths) > 5000:
                yield batch_of(arrow("path long, rid long"), np.concatenate(paths), np.concatenate(rids))
                paths, rids = [], []
        if paths:
            yield batch_of(arrow("path long, rid long"), np.concatenate(paths), np.concatenate(rids))

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets in ``a`` with those in ``b`` (None: with each other)."""
    if b is None and len(a) == 2:
        n = len(np.intersect1d(a[0], a[1], assume_unique=True))
        return np.array([[len(a[0]), n], [n, len(a[1])]])
    both = a if b is None else a + b
    tokens, column = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    many = np.bincount(column, minlength=len(tokens))[column] > 1  # tokens of one set alone add nothing to other pairs
    _, column = np.unique(column[many], return_inverse=True)
    row = row[many]
    n = np.zeros((len(a), len(both) if b is None else len(b)))
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c in range(0, width, 1 << 14):
        s = slice(*np.searchsorted(column, [c, c + (1 << 14)]))
        m = np.zeros((len(both), min(1 << 14, width - c)), np.float32)
        m[row[s], column[s] - c] = 1
        n += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    if b is None:
        np.fill_diagonal(n, [len(s) for s in a])
    return n


def _verify(threshold: float) -> Callable:
    """Rows (path, i, j, rid, block, set, paths) to (a, b, n): n links of a, or (n = 0) an edge of a forest of a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for cell in _by_cell(batches):
            x, y = _sides(cell)
            if not len(x) or not len(y) or cell.num_rows < 2:
                continue
            rid = cell.column(3).to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(s, np.uint32) for s in cell.column(5).to_pylist()]
            size = np.array([len(s) for s in sets])
            own = x is y
            common = overlaps([sets[k] for k in x], None if own else [sets[k] for k in y])
            total = size[x][:, None] + size[y][None, :] - common
            linked = common >= threshold * total - 1e-9
            if own:
                linked &= x[:, None] < y[None, :]
            p, q = np.nonzero(linked)
            if not len(p):
                continue
            # A pair belongs to the least of the paths on which both are.
            here, paths = cell.column(0)[0].as_py(), cell.column(6).to_pylist()
            before = [{v for v in ps if v < here} for ps in paths]
            first = np.array([before[x[s]].isdisjoint(before[y[t]]) for s, t in zip(p, q)])
            p, q = x[p[first]], y[q[first]]
            if not len(p):
                continue
            n = np.bincount(np.concatenate([p, q]), minlength=len(rid))
            some = np.flatnonzero(n)
            out.append(np.stack([rid[some], rid[some], n[some]]))
            root = list(range(len(rid)))
            forest = []
            for s, t in zip(p.tolist(), q.tolist()):
                u, v = s, t
                while root[u] != u:
                    root[u] = u = root[root[u]]
                while root[v] != v:
                    root[v] = v = root[root[v]]
                if u != v:
                    root[u] = v
                    forest.append((rid[s], rid[t], 0))
            out.append(np.array(forest, np.int64).T)
            if len(out) > 4000:
                yield batch_of(arrow(FOUND), *np.concatenate(out, axis=1).astype(np.int64))
                out = []
        if out:
            yield batch_of(arrow(FOUND), *np.concatenate(out, axis=1).astype(np.int64))

    return run


FOUND = "a long, b long, n long"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = texts_of(b.column(1))
        for i, j in slices(off):
            sets = gram_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield batch_of(arrow("rid long, grams binary"), b.column(0).slice(i, j - i), [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets])


def _cells(members: DataFrame) -> DataFrame:
    """Rows (path, rid, n) for each cell they belong to: blocks of about BLOCK members, compared two by two."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rid", "block")


def _gathered(cells: DataFrame) -> DataFrame:
    return cells.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (path, rid) of paths with at least two sets, with their number ``n``."""
    return rows.join(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "path").select("path", "rid", "n")


def _buckets(reps: DataFrame, number: int) -> DataFrame:
    """The buckets to compare: rows (path, rid, n)."""
    level = stored(_sized(reps.select("rid", "coords").mapInArrow(_roots(number), "path long, rid long")))
    done = level.filter(F.col("n") <= BLOCK)
    for depth in range(1, MOST_DEPTH + 1):
        large = level.filter(F.col("n") > BLOCK)
        if large.isEmpty():
            return done
        if depth == MOST_DEPTH:
            return done.unionByName(large)
        children = stored(large.join(reps.select("rid", "coords"), "rid").select("path", "rid", "coords").mapInArrow(_split(BRANCHES), "parent long, branch int, path long, rid long"))
        parts = children.groupBy("parent", "branch", "path").agg(F.count("*").alias("n"))
        rate = parts.groupBy("parent").agg((F.sum(F.col("n") * F.col("n")) * BRANCHES / F.sum("n") / F.sum("n")).alias("rate"))
        dense = rate.filter(F.col("rate") >= DENSE).select(F.col("parent").alias("path"))
        done = done.unionByName(large.join(dense, "path", "left_semi"))
        level = stored(_sized(children.join(dense.withColumnRenamed("path", "parent"), "parent", "left_anti").select("path", "rid")))
        done = done.unionByName(level.filter(F.col("n") <= BLOCK))
    return done


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the least node of its component) of an edge list ``a, b``, by large-star and small-star steps."""
    now, mark = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        small = wide.join(least, "u")
        now = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        found = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if found == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = found


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Classes and links of the texts whose trigram sets have a Jaccard similarity of at least ``threshold``.

    One row for each input row: ``row, doc_id, class_id, class_size, n_links, group_id, group_size, kept``. A class is all
    rows with equal sets, ``class_id`` its largest id; ``n_links`` counts the other classes that it is linked to; a
    group is a connected component of classes, ``group_id`` its largest id, of which one row is ``kept``. Texts
    without words (null and empty ones too) are one class without links. Null ids are smaller than all others;
    of rows that repeat an id each is a row. Sets are compared by 32-bit hashes of their grams.
    """
    docs = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "id", "text")
    rows = stored(texts.mapInArrow(_embed, EMBEDDED))
    classes = stored(rows.groupBy("s1", "s2", "size").agg(F.max(F.struct("id", "rid", "coords")).alias("top"), F.count("*").alias("class_size")).select("s1", "s2", "size", "class_size", "top.*"))
    reps = classes.filter("size > 0")
    members = _buckets(reps, runs_for(threshold, recall))
    sketch = _sketch(F.col("coords"))
    # A pair at the threshold agrees in fewer than this share of a sketch's coordinates once in some 10,000 cases.
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)
    near = stored(_gathered(_cells(members).join(reps.select("rid", sketch.alias("sketch")), "rid").select("path", "i", "j", "rid", "block", "sketch")).mapInArrow(_sift(least), "path long, rid long").distinct())
    # Of buckets with the same members one is compared.
    marks = near.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(20,0)")).alias("m1"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("m2"))
    own = stored(near.join(marks.groupBy("n", "m1", "m2").agg(F.min("path").alias("path")).select("path", "n"), "path").select("path", "rid", "n"))
    paths = own.groupBy("rid").agg(F.collect_set("path").alias("paths"))
    # The same plan at every size: what survives grows with the input, so it isn't broadcast where it happens to be small.
    sets = texts.select("rid", "text").join(paths.select("rid").hint("merge"), "rid", "left_semi").mapInArrow(_sets, "rid long, grams binary")
    compared = _gathered(_cells(own).join(sets.join(paths, "rid"), "rid").select("path", "i", "j", "rid", "block", "grams", "paths"))
    found = stored(compared.mapInArrow(_verify(threshold), FOUND))
    links = found.filter("n > 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n_links"))
    roots = components(found.filter("n = 0")).select(F.col("node").alias("rid"), "root")
    judged = classes.select("s1", "s2", "size", "class_size", "id", "rid").join(links, "rid", "left").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    groups = judged.groupBy("root").agg(F.max(F.struct("id", "rid")).alias("first"), F.sum("class_size").alias("group_size"))
    told = judged.join(groups, "root").select("s1", "s2", "size", F.col("id").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("first.id").alias("group_id"), F.col("first.rid").alias("first"), "group_size")
    return rows.select("rid", "id", "s1", "s2", "size").join(told, ["s1", "s2", "size"]).select(
        F.col("rid").alias("row"), F.col("id").alias("doc_id"), "class_id", "class_size", "n_links", "group_id", "group_size", (F.col("rid") == F.col("first")).alias("kept")
    )


def _sketch(coords):
    """The lowest byte of every second coordinate."""
    step = COORDINATES // SKETCH
    return F.unhex(F.concat(*[F.hex(F.substring(coords, 4 * step * k + 1, 1)) for k in range(SKETCH)]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that are kept of their groups (see :func:`similar`), with all their columns, whatever their names.

    Texts without words (null and empty ones too) are one group, of which the row of the largest id is kept; of rows that
    repeat an id and a text one is kept. An empty table stays empty.
    """
    docs = numbered(docs)
    key = fresh(docs, "row_number")
    kept = similar(docs, id_col, text_col, **kw).filter("kept").select(F.col("row").alias(key))
    return docs.withColumn(key, F.monotonically_increasing_id()).join(kept, key, "left_semi").drop(key)


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).drop("row")
