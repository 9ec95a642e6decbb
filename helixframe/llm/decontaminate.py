"""Benchmark decontamination by template canonicalisation (operator 3).

Texts become templates: numbers (in digits or words), names (runs of capitalised words) and units give way to typed
placeholders, all other words are case-folded. Windows of template tokens are hash-joined with those of the benchmark's
items. The placeholders' values of the joined windows are the slots; an item counts as leaked if enough of its windows
are found and each of its slot values stands for one value of the document throughout, which also catches questions
asked with other numbers or names. A window of which more than half are placeholders says too little as a template; it
is joined by its values, so a verbatim copy is found there too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow, batch_of, folded_case, fresh, holds, mix, numbered, slices, span_hashes, stored, table, texts_of, through, window_hashes

WIDTH = 8
#: Up to so many windows, repeated ones counted, the benchmark is sent to all tasks; beyond, all windows are shuffled.
BROADCAST_WINDOWS = 1 << 20
WINDOWS = "row long, id long, at int, width int, hash long, slots array<long>"

UNITS = """g kg mg lb lbs oz ton tons tonnes m km cm mm mile miles yard yards foot feet ft inch inches in l ml litre litres liter liters gallon
gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years percent pct dollar dollars usd eur
euro euros cent cents pound pounds gbp yen degree degrees celsius fahrenheit kelvin volt volts watt watts kw kwh mph kmh hz khz mhz ghz kb mb gb
tb joule joules newton newtons pascal bar mol""".split()

#: Number words; neighbours are one number. Those that are also articles (a, ein, un, una) are left out.
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty
thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf
dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend deux trois
quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille dos tres cuatro cinco
seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil""".split()
#: Words that are no names where they begin a sentence.
COMMON = """the an if then when while where what which who whom whose why how in on at by for from to of off with without into onto over under after before
between during until since as than that this these those there here it its he she they we you his her their our your my and or but so because is are was
were be been do does did has have had can could will would shall should may might must let each every all both some any no not only now also one two
der die das den dem des ein eine einen einem einer eines und oder aber wenn dann als wie was wer wo warum in im an am auf aus bei mit nach von vom zu zum
zur für über unter vor zwischen ist sind war waren hat haben hatte kann wird werden er sie es wir ihr sein seine ihre nicht kein keine jede jeder jedes
le la les un une des du de et ou mais si quand comme que qui quoi où pourquoi dans sur sous avec sans pour par en au aux est sont était ont il elle ils
elles nous vous ce cette ces chaque tous el los las una unos unas y o pero si cuando como que quien donde por para con sin en es son era fue hay su sus
este esta estos estas cada todos""".split()

_KIND = bytes(1 if 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 2 if 48 <= b < 58 else 0 for b in range(256))
_POINT = bytes(int(b in b",.") for b in range(256))
_GAP = bytes(int(b in b" -") for b in range(256))


def _word_hash(word: str) -> np.uint64:
    b = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(b, np.array([0]), np.array([len(b)]))[0]


_COMMON, _UNIT, _NUMBER = 1, 2, 4
_MARKS: dict[int, int] = {}
for _words, _mark in ((COMMON, _COMMON), (UNITS, _UNIT), (NUMBERS, _NUMBER)):
    for _w in _words:
        _MARKS[int(_word_hash(_w))] = _MARKS.get(int(_word_hash(_w)), 0) | _mark
_KNOWN = np.array(sorted(_MARKS), np.uint64)
_MARK = np.array([_MARKS[int(h)] for h in _KNOWN])
#: Literals keep their hash; placeholders have one value for each type.
NUMBER, NAME, UNIT = (_word_hash(f"\x00{t}") for t in ("number", "name", "unit"))


class Template(NamedTuple):
    tokens: np.ndarray  # template token
    values: np.ndarray  # hash of what stands there
    slot: np.ndarray  # whether it is a placeholder
    doc: np.ndarray


def canonical(buf: np.ndarray, off: np.ndarray) -> Template:
    """The template tokens of each text: runs of letters, or numbers with inner points and commas.

    Neighbours with one space or hyphen between them are one token if both are names or both number words.
    """
    low, upper = folded_case(buf)
    kind = through(buf, _KIND).copy()
    if len(buf) > 2:
        digit = kind == 2
        point = np.flatnonzero(holds(buf, _POINT)[1:-1] & digit[:-2] & digit[2:]) + 1
        kind[point] = 2
    # A token is a run of one kind within a text.
    new = np.ones(len(buf), bool)
    if len(buf):
        new[1:] = kind[1:] != kind[:-1]
        new[off[:-1][off[:-1] < len(buf)]] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(buf))
    keep = kind[at] > 0
    starts, ends = at[keep], ends[keep]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))
    if not len(starts):
        return Template(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), doc)
    values = span_hashes(low, starts, ends)
    k = np.minimum(np.searchsorted(_KNOWN, values), len(_KNOWN) - 1)
    mark = np.where(_KNOWN[k] == values, _MARK[k], 0)
    digits = kind[starts] == 2
    second = starts + 1 + (buf[starts] >= 0xC2)  # a capital of two bytes begins here
    shouted = (second < ends) & upper[np.minimum(second, len(buf) - 1)]
    spelled = (mark & _NUMBER) > 0
    name = ~digits & ~spelled & upper[starts] & ~shouted & (ends - starts > 1) & ((mark & _COMMON) == 0)
    same = np.append(False, doc[1:] == doc[:-1])
    near = same & (starts - np.append(0, ends[:-1]) == 1) & holds(buf, _GAP)[starts - 1]
    joined = near & ((name & np.append(False, name[:-1])) | (spelled & np.append(False, spelled[:-1])))
    if joined.any():
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(starts)) - 1
        many = last > first
        merged = values[first]
        merged[many] = span_hashes(low, starts[first[many]], ends[last[many]])
        values, doc, name, spelled, digits, mark, same = merged, doc[first], name[first], spelled[first], digits[first], mark[first], same[first]
    number = digits | spelled
    unit = ~number & ~name & same & np.append(False, number[:-1]) & ((mark & _UNIT) > 0)
    tokens = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, values)))
    return Template(tokens, values, number | name | unit, doc)


#: Whole items that are shorter than this and mostly placeholders say nothing.
_LEAST_VERBATIM = 3


def _windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of all windows within a text: of the template, or of the values if over half of it are placeholders."""
    n = len(t.tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    inside = t.doc[:n] == t.doc[width - 1 :]
    rich = 2 * (slots[width:] - slots[:-width]) > width
    h = window_hashes(t.tokens, width)
    if rich.any():
        at = np.flatnonzero(rich)
        verbatim = mix(window_hashes(t.values, width)[at] ^ np.uint64(0x5851F42D4C957F2D))
        h[at] = verbatim
        if width < _LEAST_VERBATIM:
            inside &= ~rich
    at = np.flatnonzero(inside)
    return at, h[at]


def _emit(width: int, widths: list[int], wanted: np.ndarray | None, whole_only: bool) -> Callable:
    """Windows of each text. whole_only: a text shorter than ``width`` gives one window of all its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(WINDOWS)
        for b in batches:
            buf, off = texts_of(b.column(2))
            for i, j in slices(off):
                t = canonical(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                first = np.searchsorted(t.doc, np.arange(j - i + 1))
                count = np.diff(first)
                out: list[list] = [[], [], [], [], [], []]
                for w in [*range(1, width), width] if whole_only else widths:
                    at, h = _windows(t, w)
                    if whole_only and w < width:
                        at, h = at[count[t.doc[at]] == w], h[count[t.doc[at]] == w]
                    if wanted is not None and len(at):
                        k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                        hit = wanted[k] == h
                        at, h = at[hit], h[hit]
                    d = t.doc[at]
                    out[0].append(d + i)
                    out[2].append(at - first[d])
                    out[3].append(np.full(len(at), w))
                    out[4].append(h.view(np.int64))
                    out[5] += [t.values[a : a + w][t.slot[a : a + w]].view(np.int64) for a in at]
                rows = np.concatenate(out[0]).astype(np.int64)
                if not len(rows):
                    continue
                take = pa.array(rows)
                yield batch_of(schema, b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(out[2]), pa.int32()), pa.array(np.concatenate(out[3]), pa.int32()), np.concatenate(out[4]), out[5])

    return run


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


LEAKS = "row long, doc_id long, item_id long, n_matched long, n_windows long, coverage double, n_slots long"


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, coverage: float = 0.5, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Pairs of a document's row and a benchmark item that leaked into it.

    ``row, doc_id, item_id, n_matched, n_windows, coverage, n_slots``: ``row`` is the document's row number; coverage
    is the share of the item's windows found in the document. An item of fewer than ``width`` tokens is one window of
    all its tokens; null and empty items, and those of fewer than three tokens that are mostly placeholders, match
    nothing. Null and empty texts have no leaks. Rows with repeated or null ids are judged one by one, as are repeated
    items. Each value of the item must stand for one value of the text; two values of the item may stand for the same
    (another question may use a number twice). Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs, benchmark = numbered(docs.select(id_col, text_col)), numbered(benchmark.select(item_col, item_text))
    bench = stored(_rows(benchmark, item_col, item_text).mapInArrow(_emit(width, [], None, True), WINDOWS))
    bench = bench.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("at").alias("item_at"), "width", "hash", F.col("slots").alias("item_slots"))
    seen = bench.select("hash", "width").limit(broadcast_windows + 1).toArrow()
    small = seen.num_rows <= broadcast_windows
    widths = sorted(set(seen["width"].to_pylist())) if small else [*range(1, width + 1)]
    wanted = np.unique(seen["hash"].to_numpy().view(np.uint64)) if small else None
    if not seen.num_rows:
        return spark.createDataFrame([], LEAKS)
    # Used several times; texts are read once, and only windows of the benchmark are written (all windows beyond the bound).
    found = stored(_rows(docs, id_col, text_col).mapInArrow(_emit(width, widths, wanted, False), WINDOWS))
    # With a benchmark of a checked number of rows, only windows that occur in it have left the scan; they meet it by a broadcast.
    side = F.broadcast if small else (lambda df: df)
    # A text that has m of an item's n windows has one of any n - m + 1; those that the fewest texts have find the
    # candidates, so that no window which many items and many texts share is joined for all of them.
    often = found.groupBy("hash", "width").agg(F.count("*").alias("times"))
    ranked = bench.select("item_row", "item_at", "hash", "width").join(often, ["hash", "width"], "left").fillna(0, ["times"])
    totals = bench.groupBy("item_row").agg(F.count("*").alias("n_windows"))
    order = Window.partitionBy("item_row").orderBy("times", "item_at")  # the windows of one item
    rare = ranked.withColumn("rank", F.row_number().over(order)).join(side(totals), "item_row").filter(F.col("rank") <= F.col("n_windows") - F.ceil(coverage * F.col("n_windows") - 1e-9) + 1)
    candidates = found.select("row", "hash", "width").join(side(rare.select("item_row", "n_windows", "hash", "width")), ["hash", "width"]).select("row", "item_row", "n_windows").distinct()
    wide = candidates.join(side(bench), "item_row")
    pairs = wide.join(found, ["row", "hash", "width"]).filter(F.size("slots") == F.size("item_slots"))
    matched = pairs.groupBy("row", "id", "item_row", "item_id", "n_windows").agg(F.count_distinct("item_at").alias("n_matched"))
    # A slot of an alignment (the shift between both texts): one value of the document for each of the item's.
    shift = F.col("at") - F.col("item_at")
    slots = pairs.select("row", "item_row", shift.alias("shift"), "item_at", F.inline(F.arrays_zip("item_slots", "slots"))).groupBy("row", "item_row", "shift", "item_slots").agg(F.min("slots").alias("lo"), F.max("slots").alias("hi"))
    bad = slots.groupBy("row", "item_row", "shift").agg(F.max((F.col("lo") != F.col("hi")).cast("int")).alias("bad"), F.count("*").alias("n"))
    # The alignments of a pair are judged together: it is consistent if one of them that has slots is, or none has slots.
    judged = bad.groupBy("row", "item_row").agg(F.min("bad").alias("bad"), F.max("n").alias("n_slots"))
    return (
        matched.filter(F.col("n_matched") >= coverage * F.col("n_windows") - 1e-9)
        .join(judged, ["row", "item_row"], "left").filter(F.coalesce("bad", F.lit(0)) == 0)
        .select("row", F.col("id").alias("doc_id"), "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"))
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without a leaked item (see :func:`leaks`), with all their columns, whatever their names.

    Null and empty texts stay; repeated rows are judged one by one; an empty benchmark drops nothing.
    """
    docs = numbered(docs)
    key = fresh(docs, "row_number")
    rows = leaks(docs, benchmark, **kw).select(F.col("row").alias(key)).distinct()
    return docs.withColumn(key, F.monotonically_increasing_id()).join(rows, key, "left_anti").drop(key)


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
