"""Quality classification with a linear-chain conditional random field over lines (operator 1).

Each line is a position of a chain with the states bad and good. Emissions are linear in features of the line and of
its neighbours; transitions are free. A document's score is the mean of its lines' marginals of *good*, from the
forward-backward algorithm, weighted by line length. The field is fitted by L-BFGS on whole texts of a bounded sample
of labelled documents, whose lines all carry the label of their document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NONSPACE, arrow, batch_of, fold_of, holds, runs, slices, span_hashes, stored, table, texts_of

#: The most labelled documents the field is fitted on, and the most lines they may have in all (about 400 bytes each).
SAMPLE, SAMPLE_LINES = 4000, 1 << 17
SAMPLED = "k long, mark long, label int, n long, lines binary"
SCORED = "doc_id long, held_out boolean, score double, predicted int"
_LINE_BYTES = 1 << 20  # longer lines count as several
_SLICE = 2 << 20  # chains of many texts are stepped through together

_SETS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?", b".", b",;:", b"|", b"#$%&*@^~", b"<>{}[]()\\/=+_", b"'\"`-", b" \t\r\v\f")
_CLASSES = len(_SETS) + 1  # and bytes of characters outside ASCII


def _class_table() -> np.ndarray:
    """For each byte, its class as a count in one of the 21-bit fields of ceil(classes / 3) words."""
    t = np.zeros((-(-_CLASSES // 3), 256), np.uint64)
    for c, members in enumerate(_SETS):
        t[c // 3, list(members)] += np.uint64(1 << (21 * (c % 3)))
    t[(_CLASSES - 1) // 3, 128:] += np.uint64(1 << (21 * ((_CLASSES - 1) % 3)))
    return t


_TABLE = _class_table()


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of each text: its text's number, its length in bytes, and its features with its neighbours'."""
    n = len(off) - 1
    breaks = np.flatnonzero(buf == 10) + 1
    long = np.concatenate([np.arange(a, b, _LINE_BYTES)[1:] for a, b in zip(off[:-1], off[1:]) if b - a > _LINE_BYTES] or [np.zeros(0, np.int64)])
    edges = np.unique(np.concatenate([off[:-1], breaks, long]))
    edges = edges[edges < off[-1]] if len(buf) else np.zeros(0, np.int64)
    # Empty texts have one empty line; a line break at the very end of a text begins no line.
    empty = np.flatnonzero(np.diff(off) == 0)
    starts = np.concatenate([edges, off[empty]])
    doc = np.concatenate([np.searchsorted(off, edges, side="right") - 1, empty])
    ends = np.concatenate([np.append(edges[1:], off[-1])[: len(edges)], off[empty]])
    order = np.lexsort((starts, doc))
    starts, ends, doc = starts[order], ends[order], doc[order]
    ends = ends - ((ends > starts) & (buf[np.maximum(ends - 1, 0)] == 10) if len(buf) else 0)
    size = (ends - starts).astype(np.float64)
    columns = []
    at = buf.astype(np.intp)
    total = np.zeros(len(buf) + 1, np.uint64)
    for row in _TABLE:
        with np.errstate(over="ignore"):
            np.cumsum(row[at], out=total[1:])
            s = total[ends] - total[starts]
        columns += [((s >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1)).astype(np.float64) for k in range(3)]
    counts = np.stack(columns[:_CLASSES], axis=1)
    share = counts / np.maximum(size, 1)[:, None]
    # Words of the line: number, mean length, how many repeat the word before, how many are different.
    nonspace = holds(buf, NONSPACE)
    ws, we, _ = runs(nonspace, off)
    line = np.searchsorted(starts, ws, side="right") - 1 if len(starts) else ws
    if len(empty):  # empty lines share their start with the next line; words belong to the last one that starts there
        line = np.minimum(line, len(starts) - 1)
    m = len(starts)
    words = np.bincount(line, minlength=m).astype(np.float64)[:m]
    h = span_hashes(buf, ws, we)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, m)[:m]
    keys = np.sort((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    different = np.bincount((keys[first] >> np.uint64(40)).astype(np.int64), minlength=m).astype(np.float64)[:m]
    letters = np.bincount(line, we - ws, m)[:m]
    lh = span_hashes(buf, starts, ends)
    both = (doc.astype(np.uint64) << np.uint64(40)) | (lh >> np.uint64(24))
    _, inverse, times = np.unique(both, return_inverse=True, return_counts=True)
    own = np.column_stack([
        share, np.log1p(size) / 8, np.log1p(words) / 6, letters / np.maximum(words, 1) / 10, repeats / np.maximum(words, 1), different / np.maximum(words, 1),
        np.log1p(counts[:, 4] + counts[:, 5]) / 4, (times[inverse] > 1).astype(np.float64), words == 0,
    ])
    own = np.column_stack([own, np.sqrt(share)])
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    edge = np.ones((m, 3))
    edge[1:, 1] = ~same
    edge[:-1, 2] = ~same
    assert n == 0 or m >= n
    return doc, size + 1, np.column_stack([own, before, after, edge])


FEATURES = 3 * (2 * _CLASSES + 8) + 3


class Chains:
    """Lines of several documents in time-major order, for forward-backward over all documents at once."""

    def __init__(self, doc: np.ndarray) -> None:
        _, inverse, count = np.unique(doc, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        t = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(count)[:-1]])[inverse] if len(doc) else np.zeros(0, np.int64)
        self.order = np.lexsort((rank[inverse], t))
        per_t = np.bincount(t, minlength=1)
        self.at = np.concatenate([[0], np.cumsum(per_t)])
        self.steps = len(per_t) if len(doc) else 0

    def marginals(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of *good* in the lines' own order, expected transitions, and the sum of log partition values.

        ``emit``: the log weight of *good* against *bad* for each line; ``trans``: log weights from state to state.
        """
        e = emit[self.order]
        at, n = self.at, len(e)
        a, b, pair = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((2, 2))
        for t in range(self.steps):
            s = slice(at[t], at[t + 1])
            if t:
                p = a[at[t - 1] : at[t - 1] + at[t + 1] - at[t]]
                for j in (0, 1):
                    a[s, j] = np.logaddexp(p[:, 0] + trans[0, j], p[:, 1] + trans[1, j])
            a[s, 1] += e[s]
        for t in range(self.steps - 1, 0, -1):
            s, width = slice(at[t], at[t + 1]), at[t + 1] - at[t]
            q = b[s] + np.column_stack([np.zeros(width), e[s]])
            for i in (0, 1):
                b[at[t - 1] : at[t - 1] + width, i] = np.logaddexp(trans[i, 0] + q[:, 0], trans[i, 1] + q[:, 1])
        z = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
        for t in range(1, self.steps):
            s, width = slice(at[t], at[t + 1]), at[t + 1] - at[t]
            p = slice(at[t - 1], at[t - 1] + width)
            for i in (0, 1):
                for j in (0, 1):
                    pair[i, j] += np.exp(a[p, i] + trans[i, j] + j * e[s] + b[s, j] - z[p]).sum()
        good = np.empty(n)
        good[self.order] = np.exp(a[:, 1] + b[:, 1] - z)
        return good, pair, float(z[: at[1]].sum()) if n else 0.0


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray


def minimise(f: Callable, x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` gives value and gradient."""
    fx, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d = g.copy()
        alphas = []
        for s, y in reversed(steps):
            alphas.append(a := s @ d / (s @ y))
            d -= a * y
        if steps:
            d *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1])
        for (s, y), a in zip(steps, reversed(alphas)):
            d += (a - y @ d / (s @ y)) * s
        rate = 1.0 if steps else 1 / max(1e-12, np.abs(g).sum())
        while rate > 1e-10:
            fn, gn = f(x - rate * d)
            if fn <= fx - 1e-4 * rate * (g @ d):
                break
            rate /= 2
        else:
            break
        s, y = -rate * d, gn - g
        done = fx - fn < 1e-6 * abs(fx)
        x, fx, g = x + s, fn, gn
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        if done or np.abs(g).max() < 1e-5:
            break
    return x


def fit(doc: np.ndarray, x: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> Model:
    """The field that fits lines ``x`` of documents ``doc`` (sorted) with 0/1 labels ``label`` of each line."""
    if not len(doc):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[scale < 1e-9], scale[scale < 1e-9] = 0, 1
    z, chains, k = (x - mean) / scale, Chains(doc), x.shape[1]
    same = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    docs = len(np.unique(doc))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        trans = w[k:].reshape(2, 2)
        emit = z @ w[:k]
        good, pair, log_z = chains.marginals(emit, trans)
        value = log_z - emit @ label - (seen * trans).sum() + ridge * (w @ w) / 2
        return value / docs, np.concatenate([z.T @ (good - label), (pair - seen).ravel()]) / docs + ridge * w / docs

    w = minimise(loss, np.zeros(k + 4))
    return Model(mean, scale, w[:k], w[k:].reshape(2, 2))


def scores(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The length-weighted mean marginal of *good* of each text."""
    doc, size, x = line_features(buf, off)
    good, _, _ = Chains(doc).marginals(((x - model.mean) / model.scale) @ model.weights, model.trans)
    n = len(off) - 1
    return np.clip(np.bincount(doc, good * size, n) / np.bincount(doc, size, n), 0, 1) if n else np.zeros(0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = texts_of(b.column(3))
        for i, j in slices(off, _SLICE):
            doc, _, x = line_features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            yield batch_of(arrow(SAMPLED), *(b.column(c).slice(i, j - i) for c in range(3)), np.diff(cut), [x[a:e].astype(np.float32).tobytes() for a, e in zip(cut, cut[1:])])


def fit_on(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Model:
    """The field fitted on the ``sample`` labelled documents (all, if there are fewer) with the least hashes of their ids.

    Whole texts are taken in that order; a document whose lines would make more than ``lines`` in all is passed over, so
    the driver gets a bounded number of bytes. Null labels and ids are left out; of conflicting labels of an id the lower
    counts; rows that repeat an id and a text are one. Without labelled texts every score is 0.5.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("k").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("k"), "k").limit(sample)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    # At most `sample` rows of two numbers, so the broadcast has a fixed bound.
    rows = texts.join(F.broadcast(chosen), "k").select("k", F.xxhash64("text").alias("mark"), "label", "text").mapInArrow(_sampled, SAMPLED)
    rows = stored(rows)
    told = rows.groupBy("k", "mark").agg(F.max("n").alias("n")).orderBy(F.xxhash64("k"), "k", "mark").limit(sample).collect()
    taken, total = [], 0
    for r in told:
        if total + r["n"] <= lines:
            taken.append((r["k"], r["mark"]))
            total += r["n"]
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(taken, "k long, mark long"))
    found = rows.join(wanted, ["k", "mark"]).groupBy("k", "mark").agg(F.min("label").alias("label"), F.min("lines").alias("lines")).toArrow().to_pylist()
    found.sort(key=lambda r: (r["label"], r["lines"]))
    x = [np.frombuffer(r["lines"], np.float32).reshape(-1, FEATURES) for r in found]
    doc = np.repeat(np.arange(len(x)), [len(a) for a in x])
    label = np.repeat(np.array([int(r["label"] > 0) for r in found], np.int64), [len(a) for a in x])
    return fit(doc, np.concatenate(x).astype(np.float64) if x else np.zeros((0, FEATURES)), label)


def _score(model: Model, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = texts_of(b.column(2))
            s = np.concatenate([scores(model, buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off, _SLICE)] or [np.zeros(0)])
            yield batch_of(arrow(SCORED), b.column(0), b.column(1), s, (s >= threshold).astype(np.int32))

    return run


def score_quality(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, in one pass without a shuffle.

    Null texts count as empty; an empty text is one empty line. Null ids aren't held out. Repeated rows stay.
    """
    held = F.coalesce(fold_of(F.col(id_col), folds) == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("long"), held, F.col(text_col).cast("string")).mapInArrow(_score(model, threshold), SCORED)


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Fits on the labels outside the held-out fold and scores every row of ``docs``."""
    return score_quality(docs, fit_on(docs, labels.filter(fold_of(F.col("doc_id"), 5) != 0), **kw))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, whatever their names.

    Null texts count as empty; an empty text is one empty line and judged as such. Repeated rows are judged alike, rows
    with null ids by their text. Without labels every score is 0.5, so every row stays.
    """
    model = fit_on(docs, labels.filter(fold_of(F.col("doc_id"), 5) != 0), id_col=id_col, text_col=text_col)
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = texts_of(b.column(at))
            for i, j in slices(off, _SLICE):
                s = scores(model, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield b.slice(i, j - i).filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
