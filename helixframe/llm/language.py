"""Language identification with string kernels (operator 7).

The kernel of two texts is that of the blended spectrum with presence: the number of hashed byte n-grams (n = 1..3,
lower-cased, everything but letters as one space) in both, over the geometric mean of their numbers. Nystrom
features are a text's kernel values with landmark texts times the inverse root of the landmarks' kernel matrix; a
ridge regression for each language against the rest is fitted on them. All of this after the presence vector is
linear, so a batch is scored by one product of its presence matrix with a (n-gram, language) matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LOWER, arrow, batch_of, fold_of, holds, slices, stored, table, texts_of, through

#: Hashed n-grams, and the most texts for each language that the regression and the landmarks are taken from.
DIMENSION, SAMPLE, LANDMARKS = 1 << 15, 600, 80
#: The most texts and landmarks in all; with many languages each has its share of them.
MOST_SAMPLE, MOST_LANDMARKS = 24_000, 1_600
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_ROWS = 128

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_LETTER = bytes(_LETTER.tolist())
#: Letters of any script count by their UTF-8 bytes; everything else is a space.
_CODE = bytes(LOWER[b] if _LETTER[b] or b >= 128 else 32 for b in range(256))


def presence(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 0/1 matrix (texts, n-grams)."""
    n = len(off) - 1
    flat = np.zeros(n * DIMENSION, bool)
    if not len(buf):
        return flat.reshape(n, DIMENSION)
    code = through(buf, _CODE).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMENSION, np.diff(off))
    left = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))  # bytes before this one in its text
    gram = np.zeros(len(buf), np.uint32)
    for k in (1, 2, 3):
        gram[k - 1 :] |= code[: len(buf) - k + 1] << np.uint32(8 * (k - 1))
        with np.errstate(over="ignore"):
            h = (gram + np.uint32(k << 24)) * np.uint32(2654435761)
            h = ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(17)
        inside = left >= k - 1
        flat[row[inside] + h[inside]] = True
    return flat.reshape(n, DIMENSION)


def has_letter(col: pa.Array, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    n = len(off) - 1
    found = np.zeros(n, bool)
    at = np.flatnonzero(holds(buf, _IS_LETTER))
    found[np.searchsorted(off, at[np.flatnonzero(np.diff(np.searchsorted(off, at, side="right"), prepend=-1))], side="right") - 1] = True
    for k in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[k] = any(c.isalpha() for c in col[int(k)].as_py())
    return found


class Model(NamedTuple):
    langs: list[str]
    matrix: np.ndarray  # (n-grams, languages)


def _unit(packed: np.ndarray) -> np.ndarray:
    """Presence rows of bits as rows of length 1."""
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


_BLOCK = 256


def fit(x: np.ndarray, langs: list[str], landmarks: np.ndarray, ridge: float = 1e-2) -> Model:
    """``x``: presence rows as packed bits; ``landmarks``: the numbers of those that are landmarks.

    Rows are unpacked in blocks, and of the regression only sums over rows are held.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((DIMENSION, 0), np.float32))
    marks = x[landmarks]
    m = len(marks)
    blocks = range(0, m, _BLOCK)

    def kernel(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([rows @ _unit(marks[a : a + _BLOCK]).T for a in blocks], axis=1).astype(np.float64)

    values, vectors = np.linalg.eigh(np.concatenate([kernel(_unit(marks[a : a + _BLOCK])) for a in blocks]))
    kept = values > 1e-8 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    number = np.array([names.index(n) for n in langs])
    share = len(langs) / len(names) / np.bincount(number, minlength=len(names))  # every language weighs the same
    r = root.shape[1] + 1
    gram, right = ridge * np.eye(r), np.zeros((r, len(names)))
    for a in range(0, len(x), _BLOCK):
        own = number[a : a + _BLOCK]
        phi = np.column_stack([kernel(_unit(x[a : a + _BLOCK])) @ root, np.ones(len(own))])
        weighted = phi * share[own][:, None]
        gram += weighted.T @ phi
        right += weighted.T @ np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = np.linalg.solve(gram, right)
    back = (root @ w[:-1]).astype(np.float32)
    matrix = sum(_unit(marks[a : a + _BLOCK]).T @ back[a : a + _BLOCK] for a in blocks)
    return Model([*names], np.vstack([matrix, w[-1:]]).astype(np.float32))


def predict(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number and its score, a softmax of the regressions' values, for each text."""
    best, score = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1)
    for i in range(0, len(off) - 1, _ROWS):
        j = min(i + _ROWS, len(off) - 1)
        x = presence(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        v = (x.astype(np.float32) @ model.matrix[:-1]) / norm + model.matrix[-1]
        e = np.exp(4 * (v - v.max(axis=1, keepdims=True)))
        best[i:j], score[i:j] = v.argmax(axis=1), (e.max(axis=1) / e.sum(axis=1))
    return best, score


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = texts_of(b.column(2))
        for i in range(0, b.num_rows, _ROWS):
            j = min(i + _ROWS, b.num_rows)
            x = np.packbits(presence(buf[off[i] : off[j]], off[i : j + 1] - off[i]), axis=1)
            yield batch_of(arrow("lang string, rank int, grams binary"), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), [r.tobytes() for r in x])


def fit_on(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """The model of the ``sample`` texts for each language (all, if fewer) with the least hashes of their ids.

    The first ``landmarks`` of each language are landmarks. Of many languages each has an equal share of MOST_SAMPLE texts
    and MOST_LANDMARKS landmarks, so the driver's memory has a bound (4 KB a text). Null languages and ids and empty
    texts are left out; of rows that repeat an id and a language one is taken.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("k is not null and lang is not null and text <> ''")
    # Each task keeps at most `sample` rows of a language before the shuffle (window group limit), texts aren't shuffled.
    ranked = rows.select("k", "lang").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k"))).filter(F.col("rank") <= sample)
    chosen = stored(ranked.groupBy("k", "lang").agg(F.min("rank").alias("rank")))
    count = chosen.select("lang").distinct().count()
    if count > MOST_LANDMARKS:
        raise ValueError(f"{count} languages; at most {MOST_LANDMARKS} can be told apart")
    sample, landmarks = min(sample, MOST_SAMPLE // max(count, 1)), min(landmarks, MOST_LANDMARKS // max(count, 1))
    # At most MOST_SAMPLE rows of two numbers and a language.
    near = F.broadcast(chosen.filter(F.col("rank") <= sample))
    found = rows.join(near, ["k", "lang"]).select("lang", "rank", "text").mapInArrow(_sampled, "lang string, rank int, grams binary")
    found = found.groupBy("lang", "rank").agg(F.min("grams").alias("grams")).toArrow().to_pylist()
    found.sort(key=lambda r: (r["rank"], r["lang"]))
    x = np.frombuffer(b"".join(r["grams"] for r in found), np.uint8).reshape(len(found), DIMENSION // 8)
    return fit(x, [r["lang"] for r in found], np.flatnonzero([r["rank"] <= landmarks for r in found]))


def _predict(model: Model) -> Callable:
    names = pa.array([*model.langs, "und"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = texts_of(b.column(2))
            for i, j in slices(off):
                own, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                known = has_letter(b.column(2).slice(i, j - i), own, o) & bool(model.langs)
                best, score = predict(model, own, o) if model.langs else (np.zeros(j - i, np.int64), np.zeros(j - i))
                lang = names.take(pa.array(np.where(known, best, len(model.langs))))
                yield batch_of(arrow(PREDICTED), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), lang, np.where(known, score, 0.0))

    return run


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row, in one pass over whole texts without a shuffle.

    Null texts and texts without a letter, and all texts if nothing could be learned, are ``und`` with score 0.
    Null ids aren't held out. Repeated rows stay.
    """
    held = F.coalesce(fold_of(F.col(id_col), fold[0]) == fold[1], F.lit(False))
    return docs.select(F.col(id_col).cast("long"), held, F.col(text_col).cast("string")).mapInArrow(_predict(model), PREDICTED)


def op7_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_on(docs.filter(fold_of(F.col("doc_id"), 4) != 2)))
