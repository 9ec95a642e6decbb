"""Similarity graphs: nearest neighbours, edges, components, communities, self-EM, representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, kept_by, ratio, scratch

NEIGHBOURS = "src long, dst long, similarity double"


def unit(v):
    """An array column over its Euclidean norm."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def cosine(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return dot / (size(a) * size(b))


METRICS = ("cosine", "inner", "l2")


def likeness(u: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Cosine, inner product or negative squared distance of all rows of both matrices: larger is nearer."""
    if metric == "cosine":
        u, v = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (u, v))
    s = u @ v.T
    return 2 * s - (u * u).sum(axis=1)[:, None] - (v * v).sum(axis=1)[None, :] if metric == "l2" else s


def nearest(s: np.ndarray, left: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest values of each row, itself (an equal id) left out; ties go to the smaller id."""
    s = np.where(left[:, None] == ids[None, :], -np.inf, s)
    few = min(k, len(ids))
    worst = np.partition(s, len(ids) - few, axis=1)[:, len(ids) - few]
    rows, cols = np.nonzero((s >= worst[:, None]) & (s > -np.inf))
    order = np.lexsort((ids[cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(left)))
    keep = np.arange(len(rows)) - first[rows] < few
    return rows[keep], cols[keep]


def merged(old: tuple, rows: np.ndarray, similarity: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple:
    """The ``k`` best (rows, similarity, ids) of each of ``n`` rows among those so far and new ones; ties go to the smaller id."""
    rows, similarity, ids = (np.concatenate(x) for x in zip(old, (rows, similarity, ids)))
    order = np.lexsort((ids, -similarity, rows))
    rows, similarity, ids = rows[order], similarity[order], ids[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows] < k
    return rows[keep], similarity[keep], ids[keep]


def scan(u: np.ndarray, own: np.ndarray, blocks, k: int, metric: str, least: float = -np.inf, tall: int = 2048) -> tuple:
    """(rows, similarity, ids): the ``k`` nearest of each row of ``u`` among the blocks (ids, vectors), an equal id left out.

    Products of blocks find the candidates (unit vectors' in single precision, less the most that this can be off); their
    similarities are then summed pair by pair, so that equal vectors tie. Pairs below ``least`` are left out.
    A block is taken once, and meets ``tall`` rows of ``u`` at a time.
    """
    norm = lambda m: np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    unit_ = metric == "cosine"
    u = u / norm(u) if unit_ else u
    # Unit vectors meet few columns at a time, always in the same memory, so that products stay in a core's cache.
    single, width = u.astype(np.float32) if unit_ else u, 512
    room = np.empty(min(len(u), tall) * width * unit_, np.float32)
    rows_of = [slice(i, i + tall) for i in range(0, len(u), tall)]
    best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in rows_of]
    floor, most = np.full(len(u), least), norm(u).max(initial=0.0)
    for ids, v in blocks:
        if unit_:
            v = v / norm(v)
            fine = np.isfinite(v).all(axis=1)
            ids, v = (ids, v) if fine.all() else (ids[fine], v[fine])
            slack = (u.shape[1] + 8) * 2.0**-23
            tiles = [v[i : i + width].astype(np.float32) for i in range(0, len(v), width)]
        else:
            slack, tiles = 1e-12 * (1 + (most + norm(v).max(initial=0.0)) ** 2), [v]
        for j, at in enumerate(rows_of):
            best[j], floor[at] = met(u[at], own[at], single[at], floor[at], best[j], ids, v, tiles, slack, room, k, metric, least)
    if not best:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    rows, similarity, ids = zip(*best)
    return np.concatenate([r + at.start for r, at in zip(rows, rows_of)]), np.concatenate(similarity), np.concatenate(ids)


def met(u, own, single, floor, best, ids, v, tiles, slack, room, k, metric, least) -> tuple:
    """The ``k`` best of each row of ``u`` after one block, and what a candidate has to reach from now on (:func:`scan`)."""
    unit_, found, at = metric == "cosine", [], 0
    for t in tiles:
        s = np.matmul(single, t.T, out=room[: len(u) * len(t)].reshape(len(u), len(t))) if unit_ else likeness(u, t, metric)
        if len(t) > k and np.isneginf(floor).any():  # one more, as the row itself may be among them
            floor = np.maximum(floor, np.partition(s, len(t) - k - 1, axis=1)[:, len(t) - k - 1] - slack)
        limit = (floor - slack).astype(s.dtype)
        some = np.flatnonzero(s.max(axis=1, initial=-np.inf) >= limit) if unit_ else np.arange(len(u))
        r, c = np.divmod(np.flatnonzero(s[some] >= limit[some, None]), len(t))
        found.append((some[r], c + at))
        at += len(t)
    if not found:
        return best, floor
    rows, cols = (np.concatenate(x) for x in zip(*found))
    other = own[rows] != ids[cols]
    rows, cols = rows[other], cols[other]
    for i in range(0, len(rows), 1 << 18):
        r, c = rows[i : i + (1 << 18)], cols[i : i + (1 << 18)]
        x = (u[r] * v[c]).sum(axis=1)
        if metric == "l2":
            x = 2 * x - (u * u).sum(axis=1)[r] - (v * v).sum(axis=1)[c]
        near = x >= least
        best = merged(best, r[near], x[near], ids[c[near]], len(u), k)
    full = np.bincount(best[0], minlength=len(u)) == k
    if len(rows) and full.any():
        last = np.searchsorted(best[0], np.flatnonzero(full), side="right") - 1
        floor = floor.copy()
        floor[full] = np.maximum(floor[full], best[1][last])
    return best, floor


def vectors_in(files: list[str], rows: int):
    """(ids, vectors) of files (id, vector) in the shared folder, ``rows`` at a time."""
    for f in files:
        where, at = fs.FileSystem.from_uri(f)
        with where.open_input_file(at) as h:
            for b in pq.ParquetFile(h).iter_batches(batch_size=rows, columns=["id", "vector"]):
                if b.num_rows:
                    yield b.column("id").to_numpy(), b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)


def knn(queries: DataFrame, base: DataFrame, k: int, *, block: int = 2048, metric: str = "cosine", least: float = -np.inf, least_tasks: int = 24, most: int = 32_768) -> DataFrame:
    """(src, dst, similarity): the ``k`` rows of ``base`` nearest to each stated query, itself left out.

    ``metric``: the cosine, the inner product, or l2 (the negative squared distance); none below ``least``.

    Exact. The base is written once to the shared folder; a task holds from ``block`` to ``most`` queries, as many as keep
    three tasks a core, and reads the base from there, some rows at a time, keeping ``k`` a query. So the base is read some
    times a core, however many rows there are, until all tasks hold ``most``. What is shuffled and written grows with the
    rows, not with their pairs. Where queries are few, parts of the base are tasks of their own. The products are
    quadratic, as the job is.
    """
    from .relational import top_k

    n, tasks = queries.count(), max(least_tasks, 3 * queries.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, min(-(-n // block), -(-n // (most * tasks)) * tasks))
    parts = -(-least_tasks // blocks)
    path = scratch(base.sparkSession)
    base.select("id", "vector").repartition(least_tasks).write.parquet(path)
    where, at = fs.FileSystem.from_uri(path)
    scheme = path.split("/")[0] + "//" + (path.split("/")[2] if "://" in path else "")
    files = sorted(scheme + f.path for f in where.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = queries.select("id", "vector", (F.pmod(F.xxhash64("id"), F.lit(blocks)) * parts).cast("int").alias("x"), part.alias("y")).select("id", "vector", (F.col("x") + F.col("y")).alias("z"))

    def best(left: pd.DataFrame) -> pd.DataFrame:
        u, own = np.stack(left["vector"].to_numpy()).astype(np.float64), left["id"].to_numpy()
        rows, similarity, ids = scan(u, own, vectors_in(files[int(left["z"].iloc[0]) % parts :: parts], 4096), k, metric, least)
        return pd.DataFrame({"src": own[rows], "dst": ids, "similarity": similarity})

    # Rows are few bytes for the work that they are: each group is a task, not as many as their bytes fill, nor two groups that hash alike.
    return top_k(q.repartitionById(blocks * parts, "z").groupBy("z").applyInPandas(best, NEIGHBOURS), ["src"], [F.desc("similarity"), F.col("dst")], k)


def nearest_list(x: np.ndarray, centroids: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Each row's nearest centroid, a thousand rows at a time: no matrix of all rows and all lists."""
    return np.concatenate([(x[i : i + rows] @ centroids.T).argmax(axis=1) for i in range(0, len(x), rows)])


def ivf_centroids(base: DataFrame, lists: int, *, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the ``sample`` rows (all, if fewer) with the least hashes of their ids."""
    rows = base.select("id", "vector").orderBy(F.xxhash64("id")).limit(sample).toPandas()
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest_list(x, c)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-300)
    return c


def ivf_assign(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, list): each row once for each of its ``probes`` nearest lists."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = max(1, min(1024, 50_000 // probes))  # rows at a time: neither they nor their copies are many
        for whole in it:
            for i in range(0, len(whole), some):
                pdf = whole.iloc[i : i + some]
                s = np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ centroids.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(pdf)), near.shape[1])
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[rows], "vector": pdf["vector"].to_numpy()[rows], "list": near.ravel()})

    return df.select("id", "vector").mapInPandas(run, "id long, vector array<double>, list long")


def residual_codebooks(base: DataFrame, centroids: np.ndarray, parts: int, *, codes: int = 16, sample: int = 20_000, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Product quantiser of vectors less their list's centroid: (parts, codes, width), by k-means on the bounded sample."""
    rows = base.select("id", "vector").orderBy(F.xxhash64("id")).limit(sample).toPandas()
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    x = x - centroids[nearest_list(x, centroids)]
    rng, books = np.random.default_rng(seed), []
    for part in np.split(x, parts, axis=1):
        c = part[rng.choice(len(part), min(codes, len(part)), replace=False)].copy()
        for _ in range(rounds):
            own = likeness(part, c, "l2").argmax(axis=1)
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = part[own == j].mean(axis=0)
        books.append(c)
    return np.stack(books)


def quantised(vectors: np.ndarray, centroids: np.ndarray, books: np.ndarray) -> np.ndarray:
    """What the product quantiser keeps of unit vectors."""
    unit_ = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    own = nearest_list(unit_, centroids)
    parts = np.split(unit_ - centroids[own], len(books), axis=1)
    return centroids[own] + np.concatenate([c[likeness(p, c, "l2").argmax(axis=1)] for p, c in zip(parts, books)], axis=1)


def knn_ivf(queries: DataFrame, base: DataFrame, k: int, *, lists: int, probes: int, part_rows: int = 4096, pq_parts: int = 0, again: int = 8) -> DataFrame:
    """Approximate nearest neighbours (cosine) by inverted lists: every base row is indexed, a query meets its nearest lists.

    A long list is cut into parts of about ``part_rows`` rows, and a task multiplies the queries of a list by one part of
    it, so an unbalanced list is no hot key. ``pq_parts``: the lists hold vectors as a product quantiser of so many parts
    keeps them; the nearest ``again`` k by these are ranked again by the vectors themselves.
    """
    from .relational import top_k

    c = ivf_centroids(base, lists)
    books = residual_codebooks(base, c, pq_parts) if pq_parts else None
    double = lambda df: df.select("id", F.col("vector").cast("array<double>").alias("vector"))
    b = cut(ivf_assign(double(base), c, 1))
    sizes = b.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))  # one row a list
    b = b.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("list", "part", "id", "vector")
    q = ivf_assign(double(queries), c, probes).join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "id", "vector")
    more = again * k if pq_parts else k

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"src": [], "dst": [], "similarity": []})
        v, ids = np.stack(right["vector"].to_numpy()), right["id"].to_numpy()
        v = quantised(v, c, books) if pq_parts else v
        out = []
        for i in range(0, len(left), 2048):
            u, own = np.stack(left["vector"].to_numpy()[i : i + 2048]), left["id"].to_numpy()[i : i + 2048]
            s = likeness(u, v, "cosine")
            rows, cols = nearest(s, own, ids, more)
            out.append(pd.DataFrame({"src": own[rows], "dst": ids[cols], "similarity": s[rows, cols]}))
        return pd.concat(out)

    found = top_k(q.groupBy("list", "part").cogroup(b.groupBy("list", "part")).applyInPandas(best, NEIGHBOURS), ["src"], [F.desc("similarity"), F.col("dst")], more)
    if not pq_parts:
        return found
    full = found.select("src", "dst").join(queries.select(F.col("id").alias("src"), F.col("vector").alias("_q")), "src").join(base.select(F.col("id").alias("dst"), F.col("vector").alias("_b")), "dst")
    return top_k(full.select("src", "dst", cosine(F.col("_q"), F.col("_b")).alias("similarity")), ["src"], [F.desc("similarity"), F.col("dst")], k)


def all_pairs(vectors: DataFrame, *, block: int = 1024) -> DataFrame:
    """(a, b, similarity) of all pairs a < b: the asked-for matrix itself, block by block; for small sets such as a pyramid's top."""
    n = max(1, -(-vectors.count() // block))
    own = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).alias("g"))
    sides = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select("id", "vector", F.least("g", "o").alias("x"), F.greatest("g", "o").alias("y"), "g")

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids, g = np.stack(pdf["vector"].to_numpy()).astype(np.float64), pdf["id"].to_numpy(), pdf["g"].to_numpy()
        s = likeness(v, v, "cosine")
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        i, j = np.nonzero((ids[:, None] < ids[None, :]) & ((x == y) | (g[:, None] != g[None, :])))
        return pd.DataFrame({"a": ids[i], "b": ids[j], "similarity": s[i, j]})

    return sides.groupBy("x", "y").applyInPandas(matrix, "a long, b long, similarity double")


def mean_pool(tokens: DataFrame, key: str, vector: str = "vector", mask: str = "mask") -> DataFrame:
    """(key, vector): the mean of a text's unmasked token vectors; zeros if all are masked."""
    at = tokens.select(key, mask, F.posexplode(vector).alias("_i", "_x"))
    sums = at.groupBy(key, "_i").agg(F.sum(F.when(F.col(mask) > 0, F.col("_x")).otherwise(0.0)).alias("_s"), F.sum(F.when(F.col(mask) > 0, 1).otherwise(0)).alias("_n"))
    each = F.struct("_i", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(0.0).alias("_v"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["_v"]).alias(vector))  # as many as a vector has coordinates


def similarity_of(distance, scale: float = 1.0):
    return 1 / (1 + distance * scale)


def distance_of_inner(inner):
    return 1 - inner


def edge_weights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (src, dst) with ``has_edge`` and ``weight``, 0 where there is none."""
    j = pairs.join(edges.select("src", "dst", F.col("weight").alias("_w")), ["src", "dst"], "left")
    return j.select("src", "dst", F.col("_w").isNotNull().alias("has_edge"), F.coalesce("_w", F.lit(0.0)).alias("weight"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, hits, recall) of found neighbours among the exact ones."""
    j = exact.select("src", "dst").join(found.select("src", "dst", F.lit(1).alias("_h")), ["src", "dst"], "left")
    return j.agg(F.count("*").alias("n"), F.count("_h").alias("hits")).withColumn("recall", ratio("hits", "n"))


def graph(neighbours: DataFrame, *, least: float = 0.0, most_edges: int | None = None) -> DataFrame:
    """Symmetric edges (src, dst, weight) with weight 1 / (1 + distance) of unit vectors; duplicates keep the larger."""
    from .relational import top_k

    d = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity")))
    e = neighbours.filter("src <> dst").select("src", "dst", (1 / (1 + d)).alias("weight")).filter(F.col("weight") >= least)
    if most_edges:
        e = top_k(e, ["src"], [F.desc("weight"), F.col("dst")], most_edges).drop("rank")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Statistics of a symmetric edge table."""
    return degrees(edges).agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("min_weight").alias("min_weight"), F.max("max_weight").alias("max_weight"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of symmetric ``edges`` under ``labels`` (node, label)."""
    l = labels.select(F.col("node").alias("src"), F.col("label").alias("_a"))
    r = labels.select(F.col("node").alias("dst"), F.col("label").alias("_b"))
    e = edges.join(l, "src").join(r, "dst")
    c = e.groupBy(F.col("_a").alias("label")).agg(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    two_m = c.agg(F.sum("total").alias("_m"))
    return c.join(F.broadcast(two_m)).agg(F.sum(F.col("inside") / F.col("_m") - resolution * F.pow(F.col("total") / F.col("_m"), 2)).alias("modularity"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by large-star and small-star rounds."""
    now, mark = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(wide.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        found = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if found == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = found


def well_connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n_parts, connected): the number of connected parts of each label's nodes."""
    l, r = labels.select(F.col("node").alias("src"), F.col("label").alias("_a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("_b"))
    inside = edges.join(l, "src").join(r, "dst").filter("_a = _b").select("src", "dst")
    parts = labels.join(components(inside), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return parts.groupBy("label").agg(F.count_distinct("root").alias("n_parts")).withColumn("connected", F.col("n_parts") == 1)


def gains(edges: DataFrame, labels: DataFrame, resolution: float = 1.0, strength: DataFrame | None = None, two_m: float | None = None) -> DataFrame:
    """(node, to, gain): the modularity that each node would gain by moving to each neighbouring community, to nine digits."""
    if strength is None:
        strength = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    if two_m is None:
        two_m = float(strength.agg(F.coalesce(F.sum("k"), F.lit(0.0))).first()[0]) or 1.0
    m = two_m / 2
    own = labels.join(strength, "node")
    sigma = own.groupBy("label").agg(F.sum("k").alias("sigma"))
    links = edges.filter("src <> dst").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
    here = own.join(sigma, "label").join(links.select("node", F.col("to").alias("label"), F.col("w").alias("w_here")), ["node", "label"], "left")
    there = links.join(sigma.withColumnRenamed("label", "to").withColumnRenamed("sigma", "s_to"), "to")
    j = here.join(there, "node").filter("to <> label")
    gain = (F.col("w") - F.coalesce("w_here", F.lit(0.0))) / m - resolution * F.col("k") * (F.col("s_to") - (F.col("sigma") - F.col("k"))) / (2 * m * m)
    return j.select("node", "to", F.round(gain, 9).alias("gain"))


def communities(edges: DataFrame, *, resolution: float = 1.0, sweeps: int = 100, least_gain: float = 1e-7) -> DataFrame:
    """(node, label): local moving in bulk sweeps of two rounds, one half of the nodes (by a hash of node and sweep) moving in each.

    A node moves to the neighbouring community of largest modularity gain, ties to the smaller label; the graph is
    symmetric. The edges are kept by their ``dst``; a round sends the labels there, and each node's links with its own label
    to the node. The driver sees one number of a round.
    """
    strength = cut(edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")))
    two_m = float(strength.agg(F.coalesce(F.sum("k"), F.lit(0.0))).first()[0]) or 1.0
    m, own, none = two_m / 2, Window.partitionBy("node"), F.lit(None).cast("double")
    # The round's number is a column, so that all rounds run the same code, compiled once. Half of the nodes, by arithmetic that any engine can repeat.
    now, sweep = strength.select("node", F.col("node").alias("label"), "k", F.lit(0).alias("t")), F.floor(F.col("t") / 2)
    half = F.pmod((F.pmod("src", F.lit(65_537)) + sweep + 1) * (7919 + 2 * sweep), F.lit(65_537)) % 2 == F.col("t") % 2
    still = 0
    with kept_by(edges.filter("src <> dst").select("src", "dst", "weight"), "dst") as links:
        for r in range(2 * sweeps):
            told = now.join(now.groupBy("label").agg(F.sum("k").alias("s")).hint("shuffle_hash"), "label").select("node", "label", "k", "s", "t")
            seen = links.join(told.select(F.col("node").alias("dst"), F.col("label").alias("to"), "s", "t").hint("shuffle_hash"), "dst").filter(half)
            rows = seen.select(F.col("src").alias("node"), "to", "s", "weight", none.alias("k"), "t")
            rows = rows.unionByName(told.select("node", F.col("label").alias("to"), "s", none.alias("weight"), "k", "t")).repartition("node")
            c = rows.groupBy("node", "to").agg(F.sum("weight").alias("w"), F.max("s").alias("s"), F.max("k").alias("k"), F.first("t").alias("t"))
            mine = F.max(F.when(F.col("k").isNotNull(), F.struct("to", "s", "k", F.coalesce("w", F.lit(0.0)).alias("w")))).over(own)
            c = c.withColumn("o", mine)
            gain = F.round((F.col("w") - F.col("o.w")) / m - resolution * F.col("o.k") * (F.col("s") - (F.col("o.s") - F.col("o.k"))) / (2 * m * m), 9)
            better = F.col("k").isNull() & (gain > least_gain)
            best = c.groupBy("node").agg(F.min(F.when(better, F.struct((-gain).alias("g"), F.col("to").alias("to")))).alias("b"), F.first("o").alias("o"), (F.first("t") + 1).alias("t"))
            now = cut(best.select("node", F.coalesce("b.to", "o.to").alias("label"), F.col("o.k").alias("k"), "t", F.col("b").isNotNull().alias("moved")))
            n = now.filter("moved").count()
            now = now.select("node", "label", "k", "t")
            still = n if r % 2 == 0 else still + n
            if r % 2 and not still:  # both halves stand still
                break
    return now.select("node", "label")


def split_small(labels: DataFrame, least: int, most: int) -> DataFrame:
    """Adds ``kept``: the label's number of nodes is within bounds; the others keep their label, flagged."""
    n = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(n, "label").withColumn("kept", F.col("size").between(least, most))


def filter_sizes(labels: DataFrame, least: int, most: int) -> DataFrame:
    """(node, label, name): labels within bounds numbered from 0 in their order; all other nodes share the next one, named FILTERED."""
    from .relational import dense_ids

    sized = split_small(labels, least, most)
    kept = dense_ids(sized.filter("kept").select("label").distinct(), ["label"], "_new")
    total = kept.agg(F.count("*").alias("_k"))
    j = sized.join(kept, "label", "left").join(F.broadcast(total))  # one row
    return j.select("node", F.coalesce("_new", "_k").alias("label"), F.when(F.col("kept"), F.concat(F.lit("C"), F.col("_new").cast("string"))).otherwise("FILTERED").alias("name"))


def cluster_anchors(assigned: DataFrame) -> DataFrame:
    """(label, size, anchor, confidence) of (node, label, anchor, p): the anchor with the largest sum of its members' confidences."""
    per = assigned.groupBy("label", "anchor").agg(F.sum("p").alias("c"), F.count("*").alias("n"))
    return per.groupBy("label").agg(F.sum("n").alias("size"), F.min_by("anchor", F.struct(-F.round("c", 9), F.col("anchor"))).alias("anchor"), F.max("c").alias("confidence"))


def em_summary(assigned: DataFrame) -> DataFrame:
    """One row over (node, label, p, collapsed): nodes, clusters, collapsed, mean confidence, single nodes."""
    per = assigned.groupBy("label").agg(F.count("*").alias("n"), F.count_if("collapsed").alias("c"), F.sum("p").alias("p"))
    return per.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_clusters"), F.sum("c").alias("n_collapsed"), (F.sum("p") / F.sum("n")).alias("mean_p"), F.count_if(F.col("n") == 1).alias("n_single"), F.max("n").alias("largest"))


def self_em_start(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """In-cluster similarities with ones on the diagonal (i, j, s), and each node's normalised row of them (i, j, p)."""
    l, r = labels.select(F.col("node").alias("src"), F.col("label").alias("_a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("_b"))
    s = edges.filter("src <> dst").join(l.hint("shuffle_hash"), "src").join(r.hint("shuffle_hash"), "dst").filter("_a = _b").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("s"))
    s = s.unionByName(labels.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("s")))
    return s, s.select("i", "j", (F.col("s") / F.sum("s").over(Window.partitionBy("i"))).alias("p"))


def self_em_step(s: DataFrame, p: DataFrame, gamma: float = 0.3) -> DataFrame:
    """One round of self-EM in sparse form: u_ij = s_ij^2 * sum_k p_kj s_ik, p' = (1 - g) p + g u / sum u, rows normalised.

    A missing edge has similarity 0, so nothing outside the edges ever gets mass: no dense cluster matrix.
    """
    reach = s.select("i", F.col("j").alias("k"), F.col("s").alias("_s")).join(p.select(F.col("i").alias("k"), "j", F.col("p").alias("_p")), "k").groupBy("i", "j").agg(F.sum(F.col("_s") * F.col("_p")).alias("_r"))
    u = s.join(reach, ["i", "j"]).select("i", "j", (F.col("s") * F.col("s") * F.col("_r")).alias("u"))
    j = p.join(u, ["i", "j"]).join(u.groupBy("i").agg(F.sum("u").alias("_u")), "i")
    raw = j.select("i", "j", ((1 - gamma) * F.col("p") + F.when(F.col("_u") > 0, gamma * F.col("u") / F.col("_u")).otherwise(0.0)).alias("_n"))
    return raw.join(raw.groupBy("i").agg(F.sum("_n").alias("_t")), "i").select("i", "j", (F.col("_n") / F.col("_t")).alias("p"))


def self_em(edges: DataFrame, labels: DataFrame, *, gamma: float = 0.3, rounds: int = 20, epsilon: float = 1e-5, collapse: float = 0.95) -> DataFrame:
    """(node, anchor, p, collapsed) after rounds until nothing moves by more than epsilon.

    The rounds of :func:`self_em_step`: similarities are kept by k of (i, k), a round sends the rows of p there and each
    product to its i, where both are summed and normalised. Nothing is sent through the driver, whatever its size.
    """
    w = Window.partitionBy("i")
    s, p = self_em_start(edges, labels)
    none = F.lit(None).cast("double")
    now = cut(s.join(p.hint("shuffle_hash"), ["i", "j"]).select("i", "j", "s", "p"))
    with kept_by(now.select("i", F.col("j").alias("k"), F.col("s").alias("_s")), "k") as known:
        for _ in range(rounds):
            reach = known.join(now.select(F.col("i").alias("k"), "j", F.col("p").alias("_p")).hint("shuffle_hash"), "k").select("i", "j", (F.col("_s") * F.col("_p")).alias("r"), none.alias("s"), none.alias("p"))
            both = reach.unionByName(now.select("i", "j", none.alias("r"), "s", "p")).repartition("i")
            c = both.groupBy("i", "j").agg(F.sum("r").alias("r"), F.max("s").alias("s"), F.max("p").alias("p")).filter("s is not null")
            c = c.withColumn("u", F.col("s") * F.col("s") * F.col("r")).withColumn("_u", F.sum("u").over(w))
            c = c.withColumn("_n", (1 - gamma) * F.col("p") + F.when(F.col("_u") > 0, gamma * F.col("u") / F.col("_u")).otherwise(0.0))
            c = c.withColumn("_q", F.col("_n") / F.sum("_n").over(w))
            after = cut(c.select("i", "j", "s", F.col("_q").alias("p"), F.abs(F.col("_q") - F.col("p")).alias("moved")))
            moved = after.agg(F.max("moved")).first()[0]
            now = after.select("i", "j", "s", "p")
            if moved is None or moved < epsilon:
                break
    return now.groupBy(F.col("i").alias("node")).agg(F.min_by("j", F.struct(-F.col("p"), F.col("j"))).alias("anchor"), F.max("p").alias("p")).withColumn("collapsed", F.col("p") >= collapse)


def cluster_table(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, node, size, inside): each node's weight to its own cluster, from which all of the below follow."""
    l, r = labels.select(F.col("node").alias("src"), F.col("label").alias("_a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("_b"))
    w = edges.filter("src <> dst").join(l, "src").join(r, "dst").filter("_a = _b").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("_w"))
    n = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(n, "label").join(w, "node", "left").select("label", "node", "size", F.coalesce("_w", F.lit(0.0)).alias("inside"))


def representatives(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, representative, mean_distance): the medoid under distance 1 - weight (1 without an edge).

    The sum of distances to the other size - 1 nodes is size - 1 minus the in-cluster weight, so the medoid is the node
    of largest in-cluster weight (ties: the smaller), without any pairs.
    """
    g = cluster_table(edges, labels).groupBy("label").agg(F.first("size").alias("size"), F.min_by("node", F.struct(-F.col("inside"), F.col("node"))).alias("representative"), F.max("inside").alias("_w"))
    return g.withColumn("mean_distance", F.when(F.col("size") > 1, (F.col("size") - 1 - F.col("_w")) / (F.col("size") - 1)).otherwise(0.0)).drop("_w")


def representatives_by(edges: DataFrame, labels: DataFrame, method: str, confidence: DataFrame | None = None, *, sample: int = 0) -> DataFrame:
    """(label, representative) by ``medoid``, ``degree`` (most edges inside), ``confidence`` ((node, p), ties of 1e-6 to the larger
    in-cluster weight) or ``approximate`` (the medoid by the distances to the ``sample`` smallest nodes of each cluster); further ties to the smaller node."""
    from .relational import top_k

    if method == "medoid":
        return representatives(edges, labels).select("label", "representative")
    if method == "confidence":
        t = cluster_table(edges, labels).join(confidence, "node", "left")
        order = F.struct(-F.floor(F.coalesce("p", F.lit(0.0)) * 1e6), -F.round("inside", 9), F.col("node"))
        return t.groupBy("label").agg(F.min_by("node", order).alias("representative"))
    l, r = labels.select(F.col("node").alias("src"), F.col("label").alias("_a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("_b"))
    inside = edges.filter("src <> dst").join(l, "src").join(r, "dst").filter("_a = _b")
    if method == "approximate":
        told = top_k(labels, ["label"], [F.col("node")], sample).select(F.col("node").alias("dst"))
        inside = inside.join(told, "dst", "left_semi")
        w = inside.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("_w"))
        # Distance 0 to itself counts like an edge of weight 1, if the node is one of those told.
        own = labels.join(w, "node", "left").join(told.select(F.col("dst").alias("node"), F.lit(1.0).alias("_o")), "node", "left")
        score = F.round(F.coalesce("_w", F.lit(0.0)) + F.coalesce("_o", F.lit(0.0)), 9)
    elif method == "degree":
        w = inside.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_w"))
        own = labels.join(w, "node", "left")
        score = F.coalesce("_w", F.lit(0))
    else:
        raise ValueError(f"no such method: {method}")
    return own.groupBy("label").agg(F.min_by("node", F.struct(-score, F.col("node"))).alias("representative"))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, cohesion): mean weight over all pairs of the cluster, missing edges 0; 1 for single nodes."""
    g = cluster_table(edges, labels).groupBy("label").agg(F.first("size").alias("size"), F.sum("inside").alias("_w"))
    return g.withColumn("cohesion", F.when(F.col("size") > 1, F.col("_w") / (F.col("size") * (F.col("size") - 1))).otherwise(1.0)).drop("_w")


def hash_embedding(text, dim: int = 64):
    """A pseudo-embedding of a text: hashed coordinates in (-1, 1), normalised."""
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.xxhash64(text, i) / F.lit(2.0**63)))


def kmer_sketch(reads: DataFrame, *, k: int = 7, dim: int = 256) -> DataFrame:
    """(id, vector): counts of canonical k-mers in ``dim`` signed hashed coordinates, so that like reads have like vectors."""
    base = np.full(256, 4, np.uint8)
    base[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for s in pdf["seq"]:
                code, n = base[np.frombuffer((s or "").encode(), np.uint8)].astype(np.int64), len(s or "") - k + 1
                v = np.zeros(dim)
                if n > 0:
                    fwd = sum((code[i : i + n] & 3) << (2 * (k - 1 - i)) for i in range(k))
                    rev = sum((3 - (code[i : i + n] & 3)) << (2 * i) for i in range(k))
                    h = (np.minimum(fwd, rev) + 1) * 2_654_435_761 % (1 << 32)
                    np.add.at(v, (h >> 8) % dim, np.where(h & 1, 1.0, -1.0))
                out.append(v / max(np.linalg.norm(v), 1e-300))
            yield pd.DataFrame({"id": pdf["read_id"], "vector": out})

    return reads.select("read_id", "seq").mapInPandas(run, "id long, vector array<double>")


def allpair(reads: DataFrame, *, k: int = 10, least: float = 0.35, dim: int = 256) -> DataFrame:
    """Reads (read_id, seq) to (read_id, cluster_id, anchor, confidence, is_representative, cluster_size, read_length)."""
    v = cut(kmer_sketch(reads, dim=dim))
    # The least weight 1 / (1 + distance) as a similarity; the graph compares weights once more.
    e = cut(graph(knn(v, v, k, block=4096, least=1 - (1 / least - 1) ** 2 / 2 - 1e-9), least=least))
    found = communities(e)
    labels = cut(v.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    em, reps, sizes = self_em(e, labels), representatives(e, labels), labels.groupBy("label").agg(F.count("*").alias("cluster_size"))
    j = labels.join(em, "node").join(reps.select("label", "representative"), "label").join(sizes, "label").join(reads.select(F.col("read_id").alias("node"), F.length("seq").alias("read_length")), "node")
    return j.select(F.col("node").alias("read_id"), F.col("label").alias("cluster_id"), "anchor", F.col("p").alias("confidence"), (F.col("node") == F.col("representative")).alias("is_representative"), "cluster_size", "read_length")
