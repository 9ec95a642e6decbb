"""Language-model scoring with a probabilistic suffix tree (operator 2).

The symbols are the words that occur often enough to be contexts (CONTEXT_COUNT times), a class for each pair of last
bytes of the other words, and the end of a text. A symbol has 20 bits, so at most the LEXICON most frequent words are
symbols of their own. Contexts of up to DEPTH symbols are counted over all training texts. A context is a candidate if
it occurs CONTEXT_COUNT times (its next symbols, if they do ENTRY_COUNT times), whatever the size of the input, and a
state of the tree if its next-symbol distribution diverges from that of its longest suffix (a log-likelihood gain of
at least PENALTY ln N) or a longer state needs it. A state's distribution is smoothed with that of its suffix, the
root's is the unigram base. A token is scored by the state that is the longest suffix of what precedes it; a word of a
class has its unigram share of the class.

The tree is a written table of weights that add up to a token's score, so its size isn't bounded. Tokens and weights
meet in parts by the symbol before the token, which all its weights have in common; a symbol that is too frequent for
a part has several, by the token itself. Counts, tokens and sums cross the network as compressed arrays, a row for each
task and part, not as a row each. Only the lexicon and a filter of fixed size are sent to all tasks. Words are told by
64-bit keys of a hash and the last two bytes; words outside the lexicon are joined by key.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LOWER, NONSPACE, arrow, batch_of, fold_of, holds, mix, numbered, runs, slices, span_hashes, stored, table, texts_of, through

DEPTH = 2
CONTEXT_COUNT, ENTRY_COUNT, PENALTY, SMOOTHING = 40, 4, 1.0, 50.0
#: Symbols: 0 start, 1 end, from 2 words, from _CLASS pairs of bytes; each has _BITS bits of a gram.
_BITS, _SYMBOLS = 20, 1 << 20
_END, _CLASS = 1, _SYMBOLS - (1 << 16)
#: At most so many words are sent to all tasks, and 2^_FILTER bits that tell which grams may be candidates.
LEXICON, _FILTER, _PAGE = _CLASS - 2, 27, 15
#: Tokens for each part of the tree, and the most parts (hot symbols' own ones not counted).
PART_TOKENS, MOST_PARTS = 1 << 20, 1 << 16
WORDS, GRAMS = "word long, n long", "gram long, n long"
SCORES = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double"
#: Words of a text that aren't in the lexicon, with their number in it.
RARE = "rid long, word long, n long"
#: Compressed arrays: counted keys of a part; a part's weights (kind 0) and tokens (1) of the rows from ``base`` on; sums of these rows.
COUNTS, MEETS, SUMS = "part long, n long, a binary, b binary", "part long, kind int, base long, n long, a binary, b binary, c binary, d binary", "base long, n long, a binary, b binary"
#: From this bit a weight's key tells its depth and whether it is a context's or an entry's; a gram of two symbols has this bit.
_KIND = _BITS * (DEPTH + 1)
_PAIR = 1 << _KIND


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end, text and key of each word: 48 bits of a hash and the last two bytes."""
    low = through(buf, LOWER)
    starts, ends, doc = runs(holds(buf, NONSPACE), off)
    h = span_hashes(low, starts, ends)
    h &= np.uint64((1 << 64) - (1 << 16))
    h |= endings(low, starts, ends)
    return low, starts, ends, doc, np.where(h == _END_WORD, np.uint64(1 << 63), h)


def endings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of each word as a number; a word of one byte has a zero before it."""
    if not len(ends):
        return np.zeros(0, np.uint64)
    return low[ends - 1].astype(np.uint64) | np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64) << np.uint64(8)


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and their numbers."""
    x = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _tally(read: Callable, parts: int) -> Callable:
    """Counts of the keys that ``read(buf, off)`` gives, for every _HELD keys or so of a task, as sorted arrays by the key's part."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = _counted(held)
        part = (mix(keys) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[p] : edges[p + 1]]
            rows.append((p, len(own), _pack(np.diff(keys[own], prepend=np.uint64(0))), _pack(counts[own].astype(np.uint32))))
        for a in range(0, len(rows), 256):
            yield batch_of(arrow(COUNTS), *(list(c) for c in zip(*rows[a : a + 256])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            buf, off = texts_of(b.column(0))
            for i, j in slices(off):
                held.append(read(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
                size += len(held[-1])
                if size >= _HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """The rows of each value of the first column, by which they are sorted; each group's rows are to be read before the next."""
    rows = (r for b in batches for k in range(0, b.num_rows, 16) for r in zip(*(c.to_pylist() for c in b.slice(k, 16).columns)))
    return itertools.groupby(rows, key=lambda r: r[0])


def _merged(least: int, ddl: str) -> Callable:
    """The sums of each part's counts that are at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            keys, counts = [], []
            for _, n, a, b in rows:
                keys.append(np.cumsum(_unpack(a, n, np.uint64), dtype=np.uint64))
                counts.append(_unpack(b, n, np.uint32))
            keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.add.reduceat(counts[order], first)
            keep = counts >= least
            keys, counts = keys[first][keep], counts[keep]
            for a in range(0, len(keys), _ROWS):
                yield batch_of(arrow(ddl), keys[a : a + _ROWS].view(np.int64), counts[a : a + _ROWS])

    return run


def _counts(texts: DataFrame, read: Callable, parts: int, least: int, ddl: str) -> DataFrame:
    """How often the keys that ``read`` gives of ``texts`` occur, those of at least ``least``; parts are reduced one by one."""
    return texts.mapInArrow(_tally(read, parts), COUNTS).repartition("part").sortWithinPartitions("part").mapInArrow(_merged(least, ddl), ddl)


_ROWS, _HELD = 1 << 17, 1 << 20
#: The end token among the words.
_END_WORD = 0


def _word_keys(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The keys of all words, and one end token for each text."""
    return np.concatenate([words_of(buf, off)[4], np.zeros(len(off) - 1, np.uint64)])


class Table:
    """An immutable open-addressing map from 64-bit keys to floats, for lookups of whole arrays."""

    _EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self._EMPTY), np.zeros(1 << bits, np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == self._EMPTY
            take, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[take], self.values[take] = keys[won], values[won]
            left = left[keys[left] != self.keys[slot[left]]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the map, and their values (0 for others)."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        found = seen == keys
        left = np.flatnonzero(~found & (seen != self._EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            found[left[hit]] = True
            left = left[~hit & (seen != self._EMPTY)]
        return found, np.where(found, self.values[slot], np.float32(0))


class Lexicon(NamedTuple):
    """Frequent words with their counts and symbols (0: none of its own)."""

    at: Table  # number of a word by its hash; the most frequent is 0
    counts: np.ndarray
    own: int  # so many words have symbols of their own, from 2 on
    end: int  # count of the end token
    tokens: int
    distinct: int

    def log10(self, c: np.ndarray | float) -> np.ndarray | float:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0: not frequent) and symbols (0: none) of words."""
        if not len(self.counts):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        hit, k = self.at.find(h)
        k = k.astype(np.int64)
        return np.where(hit, self.counts[k], 0), np.where(hit & (k < self.own), k + 2, 0)


class Text(NamedTuple):
    """Words of a slice of texts, and the grams of all tokens with the texts they belong to."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    grams: np.ndarray
    owner: np.ndarray


def read(lexicon: Lexicon, buf: np.ndarray, off: np.ndarray) -> Text:
    low, starts, ends, doc, h = words_of(buf, off)
    counts, own = lexicon.look_up(h)
    n = len(off) - 1
    words = np.bincount(doc, minlength=n)
    symbols = np.full(len(starts) + n, _END, np.uint64)
    symbols[np.arange(len(starts)) + doc] = np.where(own > 0, own.astype(np.uint64), np.uint64(_CLASS) + (h & np.uint64(0xFFFF)))
    owner = np.repeat(np.arange(n), words + 1)
    first = np.concatenate([[0], np.cumsum(words + 1)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    grams, back = symbols.copy(), symbols
    for k in range(1, DEPTH + 1):
        back = np.concatenate([np.zeros(1, np.uint64), back[:-1]])
        back[first] = 0  # the start, also before itself
        grams |= back << np.uint64(_BITS * k)
    return Text(low, starts, ends, doc, h, counts, grams, owner)


def _pairs_of(lexicon: Broadcast) -> Callable:
    """The grams of two symbols, marked by _PAIR."""
    return lambda buf, off: _low(read(lexicon.value, buf, off).grams, 2) | np.uint64(_PAIR)


def _grams_of(lexicon: Broadcast, bits: Broadcast) -> Callable:
    """The grams of three symbols whose context and suffix may be candidates, so that few of those that can't be are counted."""

    def wanted(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        grams = read(lexicon.value, buf, off).grams
        grams = grams[_maybe(bits.value, _low(grams, 2))]
        return grams[_maybe(bits.value, (grams >> np.uint64(_BITS)) | np.uint64(_PAIR))]

    return wanted


class Tree(NamedTuple):
    entries: list[Table]  # for depth 1..: (context, symbol) -> log10 probability
    back: list[Table]  # for depth 1..: context -> log10 weight of its suffix's distribution


def _low(keys: np.ndarray, symbols: int) -> np.ndarray:
    return keys & np.uint64((1 << (_BITS * symbols)) - 1)


def build(contexts: list[tuple[np.ndarray, np.ndarray]], entries: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray, penalty: float = PENALTY, smoothing: float = SMOOTHING) -> Tree:
    """In memory, what :func:`_weights` does with tables: the tree of, for each depth from 1, candidate contexts with their counts and (context, symbol) grams with theirs.

    ``root``: log10 probability of each symbol without context.
    """
    levels: list[dict] = [{}]
    positions = max((t.sum() for _, t in contexts), default=0)
    for d, ((ctx, total), (key, n)) in enumerate(zip(contexts, entries), 1):
        order = np.argsort(ctx)
        v = {"ctx": ctx[order], "total": total[order].astype(np.float64)}
        up = levels[d - 1]
        if d > 1:  # a candidate's suffix is one, as it is at least as frequent
            v["parent"] = _find(up["ctx"], _low(v["ctx"], d - 1))
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.float64)
        owner = _find(v["ctx"], key >> np.uint64(_BITS))
        v["key"], v["n"], v["owner"] = key[owner >= 0], n[owner >= 0], owner[owner >= 0]
        size = len(v["ctx"])
        v["back"] = (v["total"] - np.bincount(v["owner"], v["n"], size) + smoothing) / (v["total"] + smoothing)
        below = _prob(levels, root, d - 1, _low(v["key"], d), v["parent"][v["owner"]] if d > 1 else None)
        v["p"] = v["n"] / (v["total"] + smoothing)[v["owner"]] + v["back"][v["owner"]] * below
        v["need"] = np.bincount(v["owner"], v["n"] * np.log(v["p"] / below), size) >= penalty * np.log(max(positions, 2))
        levels.append(v)
    for d in range(len(contexts), 1, -1):  # suffixes of states are states
        levels[d - 1]["need"][np.unique(levels[d]["parent"][levels[d]["need"]])] = True
    kept = [v["need"][v["owner"]] for v in levels[1:]]
    return Tree([Table(v["key"][k], np.log10(v["p"][k])) for v, k in zip(levels[1:], kept)], [Table(v["ctx"][v["need"]], np.log10(v["back"][v["need"]])) for v in levels[1:]])


def _find(where: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Positions in a sorted array, -1 for what isn't there."""
    if not len(where):
        return np.full(len(what), -1)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return np.where(where[at] == what, at, -1)


def _prob(levels: list[dict], root: np.ndarray, d: int, keys: np.ndarray, owner: np.ndarray | None) -> np.ndarray:
    """Smoothed probabilities at depth ``d``; ``owner``: the contexts' numbers in that level."""
    if d == 0:
        return 10.0 ** root[_low(keys, 1).astype(np.int64)]
    v = levels[d]
    at = _find(v["key"], keys)
    out = np.zeros(len(keys))
    out[at >= 0] = v["p"][at[at >= 0]]
    rest = at < 0
    if rest.any():
        out[rest] = v["back"][owner[rest]] * _prob(levels, root, d - 1, _low(keys[rest], d), v["parent"][owner[rest]] if d > 1 else None)
    return out


def log_gains(tree: Tree, root: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """log10 of each symbol's probability after the longest state that is a suffix of its context, over the root's."""
    out = np.zeros(len(grams), np.float64)
    left = np.arange(len(grams))
    for d in range(DEPTH, 0, -1):
        key = _low(grams[left], d + 1)
        found, p = tree.entries[d - 1].find(key)
        out[left[found]] += p[found] - root[_low(key[found], 1).astype(np.int64)]
        left, key = left[~found], key[~found]
        out[left] += tree.back[d - 1].find(key >> np.uint64(_BITS))[1]
    return out


def keys_of(grams: np.ndarray) -> list[np.ndarray]:
    """The keys of the weights that a gram's score is the sum of: for each depth its context's, then its entry's."""
    parts = [part for d in range(1, DEPTH + 1) for part in (_low(grams >> np.uint64(_BITS), d), _low(grams, d + 1))]
    return [part | np.uint64(kind << _KIND) for kind, part in enumerate(parts)]


def _slot(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key's two bits of the filter."""
    h = mix(keys)
    return (h >> np.uint64(64 - _FILTER)).astype(np.int64), (h & np.uint64((1 << _FILTER) - 1)).astype(np.int64)


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The numbers of the keys that may be among those the filter was made of."""
    one, two = _slot(keys)
    at = np.flatnonzero(bits[one >> 3] & (np.uint8(128) >> (one & 7).astype(np.uint8)))
    two = two[at]
    return at[np.flatnonzero(bits[two >> 3] & (np.uint8(128) >> (two & 7).astype(np.uint8)))]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slot = np.unique(np.concatenate(_slot(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
        yield batch_of(arrow("page long, slot long"), slot >> _PAGE, slot)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap of the slots of each page; a page's rows are in one task."""
    pages: dict[int, np.ndarray] = {}
    for b in batches:
        page, slot = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        for p in np.unique(page).tolist():
            pages.setdefault(p, np.zeros(1 << _PAGE, bool))[slot[page == p] & ((1 << _PAGE) - 1)] = True
    if pages:
        yield batch_of(arrow("page long, bits binary"), list(pages), [np.packbits(x).tobytes() for x in pages.values()])


def _filter(keys: DataFrame) -> np.ndarray:
    """2^_FILTER bits, set where a key may be: the driver gathers these, whatever the number of keys."""
    bits = np.zeros(1 << (_FILTER - 3), np.uint8)
    size = 1 << (_PAGE - 3)
    pages = keys.mapInArrow(_slots, "page long, slot long").repartition("page").mapInArrow(_pages, "page long, bits binary").toArrow()
    for page, part in zip(pages["page"].to_pylist(), pages["bits"].to_pylist()):
        bits[page * size : (page + 1) * size] = np.frombuffer(part, np.uint8)
    return bits


class Routes(NamedTuple):
    """The part of each token and weight: by the symbol before it, and for frequent ones by the token as well."""

    parts: int
    hot: np.ndarray  # symbols that have parts of their own, at most as many as there are parts
    first: np.ndarray  # of these parts
    splits: np.ndarray  # their number

    @staticmethod
    def of(count: np.ndarray, parts: int) -> Routes:
        most = max(2 * int(count.sum()) // parts, 1)
        hot = np.flatnonzero(count > most)
        splits = -(-count[hot] // most)
        return Routes(parts, hot, parts + np.cumsum(splits) - splits, splits)

    def split(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first part and the number of parts of each symbol."""
        if not len(self.hot):
            return before % self.parts, np.ones(len(before), np.int64)
        k = np.minimum(np.searchsorted(self.hot, before), len(self.hot) - 1)
        own = self.hot[k] == before
        return np.where(own, self.first[k], before % self.parts), np.where(own, self.splits[k], 1)

    def part(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        first, n = self.split(before)
        return first + np.where(n > 1, mix(token.astype(np.uint64)) % n.astype(np.uint64), np.uint64(0)).astype(np.int64)


def _cut(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by parts that keeps the rows' own, the parts, and their edges in it."""
    order = np.argsort(part, kind="stable")
    found, at = np.unique(part[order], return_index=True)
    return order, found, np.append(at, len(part))


def _weights_by_part(routes: Routes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = b.column(1).to_numpy(zero_copy_only=False).astype(np.float32)
            entry = (keys >> np.uint64(_KIND)) & np.uint64(1) == 1
            low = _low(keys, 1).astype(np.int64)
            before = np.where(entry, _low(keys >> np.uint64(_BITS), 1).astype(np.int64), low)
            # A context is in all parts of its symbol.
            first, splits = routes.split(before)
            copies = np.where(entry, 1, splits)
            row = np.repeat(np.arange(len(keys)), copies)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            part = np.where(entry, routes.part(before, low), first)[row] + nth
            order, found, edges = _cut(part)
            rows = []
            for k, p in enumerate(found.tolist()):
                own = row[order[edges[k] : edges[k + 1]]]
                rows.append((p, 0, 0, len(own), _pack(keys[own]), _pack(values[own]), None, None))
            for a in range(0, len(rows), 256):
                yield batch_of(arrow(MEETS), *(list(c) for c in zip(*rows[a : a + 256])))

    return run


def _tokens_by_part(lexicon: Broadcast, routes: Routes) -> Callable:
    """All tokens with the two symbols before them and their rows' numbers, for every _HELD tokens or so of a task."""

    def flush(base: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        at, first, second, token = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, found, edges = _cut(routes.part(second.astype(np.int64), token))
        rows = []
        for k, p in enumerate(found.tolist()):
            own = order[edges[k] : edges[k + 1]]
            rows.append((p, 1, base, len(own), _pack(np.diff(at[own], prepend=np.uint32(0))), *(_pack(x[own]) for x in (first, second, token))))
            if len(rows) == 256:
                yield batch_of(arrow(MEETS), *(list(c) for c in zip(*rows)))
                rows = []
        if rows:
            yield batch_of(arrow(MEETS), *(list(c) for c in zip(*rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, 0
        for b in batches:
            rid = b.column(0).to_numpy(zero_copy_only=False)  # ascending in a task
            buf, off = texts_of(b.column(1))
            for i, j in slices(off):
                t = read(lexicon.value, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if held and (size >= _HELD or int(rid[j - 1]) - base >= 1 << 32):
                    yield from flush(base, held)
                    held, size = [], 0
                if not held:
                    base = int(rid[i])
                symbols = (_low(t.grams >> np.uint64(_BITS * k), 1).astype(np.uint32) for k in (2, 1, 0))
                held.append(((rid[i:j] - base).astype(np.uint32)[t.owner], *symbols))
                size += len(t.grams)
        if held:
            yield from flush(base, held)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the weights of each row's tokens in each part; a part's weights come before its tokens."""
    for _, rows in _groups(batches):
        table, keys, values, out = None, [], [], []
        for _, kind, base, n, a, b, c, d in rows:
            if kind == 0:
                keys.append(_unpack(a, n, np.uint64))
                values.append(_unpack(b, n, np.float32))
                continue
            if not keys:
                continue  # no weights here: nothing to add
            if table is None:
                table = Table(np.concatenate(keys), np.concatenate(values))
            at = np.cumsum(_unpack(a, n, np.uint32), dtype=np.uint32)
            first, second, token = (_unpack(x, n, np.uint32).astype(np.uint64) for x in (b, c, d))
            grams = (first << np.uint64(2 * _BITS)) | (second << np.uint64(_BITS)) | token
            gain = np.zeros(n, np.float64)
            for k in keys_of(grams):
                gain += table.find(k)[1]
            edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # rows ascend
            gain = np.add.reduceat(gain, edge)
            at, gain = at[edge][gain != 0], gain[gain != 0]
            if len(at):
                out.append((base, len(at), _pack(np.diff(at, prepend=np.uint32(0))), _pack(gain.astype(np.float32))))
        for k in range(0, len(out), 256):
            yield batch_of(arrow(SUMS), *(list(c) for c in zip(*out[k : k + 256])))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for base, rows in _groups(batches):
        at, gain = [], []
        for _, n, a, b in rows:
            at.append(np.cumsum(_unpack(a, n, np.uint32), dtype=np.uint32))
            gain.append(_unpack(b, n, np.float32))
        found, inverse = np.unique(np.concatenate(at), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(gain), len(found))
        yield batch_of(arrow("rid long, gain double"), base + found.astype(np.int64), total)


def _gained(rows: DataFrame, weights: DataFrame, lexicon: Broadcast, routes: Routes) -> DataFrame:
    """(rid, gain): the sum of the weights of each row's tokens; rows without any are left out."""
    meets = weights.select("key", "value").mapInArrow(_weights_by_part(routes), MEETS).unionByName(rows.select("rid", "text").mapInArrow(_tokens_by_part(lexicon, routes), MEETS))
    sums = meets.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_met, SUMS)
    return sums.repartition("base").sortWithinPartitions("base").mapInArrow(_summed, "rid long, gain double")


def _score(shared: Broadcast) -> Callable:
    """Each text's tokens, and the base score of those in the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for b in batches:
            buf, off = texts_of(b.column(3))
            for i, j in slices(off, 1 << 18):
                n = j - i
                _, _, _, doc, h = words_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                counts, _ = lexicon.look_up(h)
                known = counts > 0
                tokens = np.bincount(doc, minlength=n) + 1
                base = np.bincount(doc, np.where(known, lexicon.log10(counts), 0.0), n) + lexicon.log10(lexicon.end)
                seen = np.bincount(doc, known, n).astype(np.int64) + int(lexicon.end > 0)
                yield batch_of(arrow(SCORES), *(b.column(k).slice(i, n) for k in range(3)), tokens.astype(np.int64), seen, base)

    return run


def _rare(lexicon: Broadcast) -> Callable:
    """The different words of each text that aren't in the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = texts_of(b.column(1))
            for i, j in slices(off, 1 << 18):
                _, _, _, doc, h = words_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                rare = np.flatnonzero(lexicon.value.look_up(h)[0] == 0)
                if len(rare):
                    _, first, n = np.unique(mix(h[rare] ^ mix(doc[rare].astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
                    at = rare[first]
                    yield batch_of(arrow(RARE), b.column(0).slice(i, j - i).take(pa.array(doc[at])), h[at].view(np.int64), n.astype(np.int64))

    return run


def _most(rows: DataFrame, most: int) -> int:
    """The least n of the rows of largest ``n``, ``most`` of them at most, that can be told by eighths of octaves."""
    sizes = rows.groupBy(F.floor(F.log2("n") * 8).alias("o")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()  # at most 512 rows
    held, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["o"]):
        held += r["rows"]
        if held > most:
            break
        least = r["least"]
    return least


def _lexicon(words: DataFrame, most: int) -> tuple[Lexicon, int, np.ndarray, np.ndarray]:
    """The lexicon of counted words, the count from which a word is in it, and each symbol's log10 base probability and count."""
    said = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), F.coalesce(F.sum(F.when(F.col("word") == _END_WORD, F.col("n"))), F.lit(0)).alias("end")).first()
    words = words.filter(F.col("word") != _END_WORD)
    least = _most(words, most)
    often = words.filter(F.col("n") >= least).select("word", "n").toArrow()  # at most LEXICON rows of two numbers
    own = max(least, CONTEXT_COUNT)
    classes = words.filter(F.col("n") < own).groupBy(F.col("word").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # at most 65,536 rows
    mass, count = np.full(_SYMBOLS, 0.5), np.zeros(_SYMBOLS, np.int64)
    count[0] = count[_END] = said["end"]
    mass[_END] += said["end"]
    for r in classes:
        mass[_CLASS + r["ending"]] += r["n"] + 0.5 * r["v"]
        count[_CLASS + r["ending"]] = r["n"]
    h, counts = often["word"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.lexsort((h, -counts))
    h, counts = h[order], counts[order]
    frequent = int((counts >= own).sum())
    mass[2 : 2 + frequent] += counts[:frequent]
    count[2 : 2 + frequent] = counts[:frequent]
    lexicon = Lexicon(Table(h, np.arange(len(h)).astype(np.float64)), counts, frequent, int(said["end"]), int(said["tokens"]), int(said["distinct"]))
    return lexicon, least, np.log10(mass / (said["tokens"] + 0.5 * (said["distinct"] + 1))), count


def _weights(grams: DataFrame, tokens: int, root: np.ndarray, count: np.ndarray) -> DataFrame:
    """The tree as rows (key, value, n): log10 weights whose sum over :func:`keys_of` is a gram's gain over the base, and their counts.

    A context's is the weight of its suffix's distribution, an entry's is what its probability exceeds this by.
    ``grams``: those of three symbols and, with _PAIR, of two, that occur ENTRY_COUNT times. A context of two symbols
    occurs as often as the gram of both (no text goes on after its end; the start stands twice before each text).
    """
    spark, levels = grams.sparkSession, []
    mask = lambda symbols: F.lit((1 << (_BITS * symbols)) - 1)
    seen = np.flatnonzero((count > 0) | (root > root.min()))
    seen = seen if len(seen) else np.arange(1)
    # At most _SYMBOLS rows.
    symbols = stored(spark.createDataFrame(pa.table({"sub": seen.astype(np.int64), "below": 10.0 ** root[seen], "total": count[seen]})))
    below, pair = symbols.select("sub", "below"), F.col("gram") >= _PAIR
    for d in range(1, DEPTH + 1):
        joint = grams.filter(pair).select(F.col("gram").bitwiseAND(mask(2)).alias("gram"), "n") if d == 1 else grams.filter(~pair)
        if d == 1:
            ctx = symbols.select(F.col("sub").alias("ctx"), "total")
        else:
            ctx = grams.filter(pair).select(F.col("gram").bitwiseAND(mask(2)).alias("ctx"), F.col("n").alias("total")).filter(F.col("ctx").bitwiseAND(mask(1)) != _END)
            ctx = ctx.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("ctx"), F.lit(int(count[0])).cast("long").alias("total")))
        entries = joint.filter(F.col("n") >= ENTRY_COUNT).withColumn("ctx", F.shiftright("gram", _BITS)).withColumn("sub", F.col("gram").bitwiseAND(mask(d)))
        # An entry's suffix is one, as it is at least as frequent.
        v = entries.join(ctx.filter(F.col("total") >= CONTEXT_COUNT), "ctx").join(below, "sub")
        own, all_ = Window.partitionBy("ctx"), F.col("total") + SMOOTHING  # at most _SYMBOLS rows a context
        v = v.withColumn("back", (all_ - F.sum("n").over(own)) / all_).withColumn("p", F.col("n") / all_ + F.col("back") * F.col("below"))
        v = v.withColumn("need", F.sum(F.col("n") * F.log(F.col("p") / F.col("below"))).over(own) >= PENALTY * np.log(max(tokens, 2)))
        levels.append(stored(v.select("gram", "ctx", "n", "total", "back", "p", "below", "need")))
        below = levels[-1].select(F.col("gram").alias("sub"), F.col("p").alias("below"))
    out, longer = None, None
    for d in range(DEPTH, 0, -1):
        v, needed = levels[d - 1], levels[d - 1].filter("need").select("ctx")
        if longer is not None:  # suffixes of states are states
            needed = needed.unionByName(longer.select(F.col("ctx").bitwiseAND(mask(d)).alias("ctx")))
        longer = needed.distinct()
        kept = v.join(longer, "ctx", "left_semi")
        key = lambda column, kind: F.col(column).bitwiseOR(F.lit(kind << _KIND)).alias("key")
        contexts = kept.select(key("ctx", 2 * d - 2), F.log10("back").alias("value"), F.col("total").alias("n")).distinct()
        rows = contexts.unionByName(kept.select(key("gram", 2 * d - 1), (F.log10("p") - F.log10("below") - F.log10("back")).alias("value"), "n"))
        out = rows if out is None else out.unionByName(rows)
    return stored(out)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold: tuple[int, int] = (5, 1), most_words: int = LEXICON, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Learns from the rows outside the held-out fold (null ids are outside). Null texts count as empty: an empty text
    is its end alone. Repeated rows count and are scored as often as they occur; other columns are ignored, whatever
    their names. Without training rows every token is unknown and the score is the base. At most ``most_words`` words
    (LEXICON at most) are sent to all tasks; ``part_tokens`` is the size of the parts in which tokens meet the tree.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold_of(F.col(id_col), fold[0]) == fold[1], F.lit(False))
    docs = numbered(docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "id", "held", "text")
    train = docs.filter("not held").select("text")
    # The number of tokens isn't known yet: as many parts as the session's shuffles have.
    words = stored(_counts(train, _word_keys, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1, WORDS))
    lexicon, least, root, count = _lexicon(words, min(most_words, LEXICON))
    parts = int(min(max(-(-lexicon.tokens // part_tokens), 1), MOST_PARTS))
    shared = spark.sparkContext.broadcast(lexicon)  # once for all steps: some 40 MB at most, as LEXICON bounds it
    pairs = stored(_counts(train, _pairs_of(shared), parts, ENTRY_COUNT, GRAMS))
    # A gram of three is a candidate only if its last two are an entry and its first two a context; (start, start) is one.
    ends = pairs.select(F.col("gram").bitwiseAND(F.lit(_PAIR - 1)).alias("key"))
    fronts = pairs.filter(F.col("n") >= CONTEXT_COUNT).select(F.col("gram").alias("key")).unionByName(spark.range(1).select(F.lit(_PAIR).alias("key")))
    grams = stored(_counts(train, _grams_of(shared, spark.sparkContext.broadcast(_filter(ends.unionByName(fronts)))), parts, ENTRY_COUNT, GRAMS))
    weights = _weights(pairs.unionByName(grams), lexicon.tokens, root, count)
    gained = _gained(rows, weights, shared, Routes.of(count, parts))
    # None of the words outside the lexicon is a hot key, and no position is shuffled, only different (text, word) pairs.
    others = words.filter((F.col("n") < least) & (F.col("word") != _END_WORD)).select("word", F.col("n").alias("c"))
    found = rows.select("rid", "text").mapInArrow(_rare(shared), RARE).join(others.hint("merge"), "word", "left")
    total = lexicon.tokens + 0.5 * (lexicon.distinct + 1)
    extra = found.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(total))).alias("plus")
    )
    base = F.col("base") + F.coalesce("plus", F.lit(0.0))
    scored = rows.mapInArrow(_score(shared), SCORES)
    return scored.join(extra, "rid", "left").join(gained, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
