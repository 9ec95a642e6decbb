import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import packing, tokens


def ids_of(text):
    return tokens.tokenizer(tokens.default_path()).encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(odd):
    for limit in (3, 1024):
        rows = tokens.token_counts(odd, limit=limit).collect()
        assert len(rows) == odd.count()
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(r.text))) for r in odd.collect()), key=str)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == want
        assert all(r.over_limit == (r.n_tokens > limit) for r in rows)


def test_no_rows(none):
    assert tokens.token_counts(none).count() == 0
    assert packing.pack(none).count() == 0


ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "don't", "12", "3.5", "!", "<|endoftext|>", "中", "word", ".", " "]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=80))
def test_cutting_at_safe_boundaries_changes_nothing(parts):
    text = "".join(parts)
    cut = tokens.pieces(text, 5)
    assert "".join(cut) == text
    assert sum(len(ids_of(p)) for p in cut) == len(ids_of(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60))
def test_fast_encoder_equals_the_library(parts):
    text = "".join(parts)
    simple = all(b < 0xE0 for b in text.encode())
    assert packing.encoder(tokens.default_path())(text, simple).tolist() == ids_of(text)


def test_fast_encoder_on_every_character_of_one_or_two_bytes():
    """The faster encoder is used for texts below U+0800: all of these characters, in several surroundings."""
    encode = packing.encoder(tokens.default_path())
    for form in ("{}", "a{}", "{}a", " {}", "{} ", "1{}1", "A{}b {}", "{}\n", "'{}", "{}{}{}"):
        texts = [form.replace("{}", chr(c)) for c in range(0x800)]
        want = [e.ids for e in tokens.tokenizer(tokens.default_path()).encode_batch(texts, add_special_tokens=False)]
        assert [encode(t, True).tolist() for t in texts] == want


def check_packing(rows, texts, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, own in by_doc.items():
        ids = np.array([*ids_of(texts[doc]), 2], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and 0 < r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
        assert len(own) == -(-len(ids) // capacity)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= capacity
    return len(used)


def test_packing_is_valid(spark, odd):
    one_each = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in one_each.collect()}
    for capacity in (64, 1024):
        rows = packing.pack(one_each, capacity=capacity).collect()
        n = check_packing(rows, texts, capacity)
        assert n <= 1.2 * sum(r.length for r in rows) / capacity + 1
    assert packing.pack(odd).count() == sum(-(-(len(ids_of(r.text)) + 1) // 1024) for r in odd.collect())


def test_packing_of_real_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 1024)
    assert n <= 1.05 * sum(r.length for r in rows) / 1024 + 1


def unpack(placed, bins, capacity):
    load = [[] for _ in range(bins)]
    seen = {}
    for s, rank, n, first, offset in placed:
        for k in range(n):
            load[first + k].append((offset, s))
            assert (s, rank + k) not in seen
            seen[s, rank + k] = True
    for b in load:
        end = 0
        assert b
        for o, s in sorted(b):
            assert o == end
            end += s
        assert end <= capacity
        assert sum(3 * s > capacity for _, s in b) <= 2  # large ones pair at most twice
    return seen


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100])
    histogram = {s: rng.randint(1, 40) for s in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    placed, bins = packing.plan(histogram, capacity)
    seen = unpack(placed, bins, capacity)
    assert sorted(seen) == sorted((s, k) for s, n in histogram.items() for k in range(n))
    total = sum(s * n for s, n in histogram.items())
    # First-fit decreasing item by item is a yardstick.
    loads = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        k = next((k for k, x in enumerate(loads) if x + s <= capacity), None)
        loads.append(s) if k is None else loads.__setitem__(k, loads[k] + s)
    assert -(-total // capacity) <= bins <= 1.1 * len(loads) + 1
