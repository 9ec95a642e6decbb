"""Token counts (operator 9) and what both tokenising operators share."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import arrow, batch_of, slices, table, texts_of

#: Texts of more bytes than this are cut at safe boundaries; a batch for the tokenizer has about BATCH_BYTES.
PIECE_BYTES, BATCH_BYTES = 16 << 10, 1 << 20
COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: A space between a character that isn't white space and an ASCII letter: byte-level BPE splits words there in any case.
_SAFE = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def safe_to_split(path: str) -> bool:
    """Whether the tokenizer is a byte-level BPE without normaliser, for which ``_SAFE`` is a safe boundary."""
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))


def pieces(text: str, most: int = PIECE_BYTES) -> list[str]:
    """``text`` cut at safe boundaries into pieces of about ``most`` characters; uncut where there are none."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def _count(path: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cut = tokenizer(path), safe_to_split(path)
        schema = arrow(COUNTED)
        for b in batches:
            _, off = texts_of(b.column(1))
            sizes, counts = np.diff(off), np.zeros(b.num_rows, np.int64)
            for i, j in slices(off, BATCH_BYTES):
                texts, owner = [], []
                for k, text in enumerate(b.column(1).slice(i, j - i).to_pylist(), i):
                    parts = pieces(text) if cut and text else [text or ""]
                    texts += parts
                    owner += [k] * len(parts)
                lengths = [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
                counts += np.bincount(owner, lengths, b.num_rows).astype(np.int64)
            yield batch_of(schema, b.column(0), sizes, counts, counts > limit)

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, in one pass without a shuffle.

    Null and empty texts have 0 bytes and tokens. Null ids and repeated rows stay as they are. Special tokens'
    strings inside a text count as the library's default has it. Only lengths leave the Arrow function.
    """
    return docs.selectExpr(f"cast(`{id_col}` as long)", f"cast(`{text_col}` as string)").mapInArrow(_count(path or default_path(), limit), COUNTED)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
