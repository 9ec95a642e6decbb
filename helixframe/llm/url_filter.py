"""URL filtering with a bit-parallel wildcard automaton (operator 6).

All glob rules are packed into one multiword Shift-And automaton: a bit for each literal position, words of 64 bits,
a carry from each word to the next. A batch of URLs is simulated together, one byte position at a time, so the cost
of a step is a few numpy operations on (URLs, words) whatever the number of rules.

Globs match a whole canonical URL: ``*`` any run without ``/``, ``**`` any run, ``?`` one byte that isn't ``/``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow, batch_of, table, texts_of


class Rule(NamedTuple):
    """``host`` and all its subdomains, and paths that start with ``path``."""

    allow: bool
    host: str
    path: str

    def globs(self) -> tuple[str, str]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


RULES = (Rule(True, "org", "/"), Rule(False, "example.org", "/es/"), Rule(False, "example.org", "/en/1"), Rule(True, "com", "/fr/"), Rule(False, "com", "/de/"))
#: The method's own rules, for URLs that no rule above fits: a match blocks.
BLOCKED = ("*spam*/**", "*spam*", "*casino*/**", "*casino*", "**/ads/**", "**/wp-login*")


class Automaton:
    """Shift-And over several globs; ``*`` and ``**`` are self-loops on the position before them."""

    def __init__(self, globs: Sequence[str]) -> None:
        positions: list[tuple[int, bool, str]] = []  # of each state: byte (-1: any but /, -2: start), loop kinds
        self.accept: list[list[int]] = []
        starts: list[int] = []
        for g in globs:
            raw, at = g.encode(), 0
            starts.append(len(positions))
            positions.append((-2, False, ""))
            while at < len(raw):
                if raw[at : at + 2] == b"**":
                    positions[-1] = (positions[-1][0], True, "**")
                    at += 2
                elif raw[at : at + 1] == b"*":
                    if positions[-1][2] != "**":
                        positions[-1] = (positions[-1][0], True, "*")
                    at += 1
                else:
                    positions.append((-1 if raw[at : at + 1] == b"?" else raw[at], False, ""))
                    at += 1
            self.accept.append([len(positions) - 1])
        bits = len(positions)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # states that a byte may enter
        self.loop = np.zeros((256, self.words), np.uint64)  # states that stay on a byte
        self.init = np.zeros(self.words, np.uint64)
        slash = ord("/")
        for s, (byte, _, loop) in enumerate(positions):
            w, bit = s // 64, np.uint64(1 << (s % 64))
            if byte >= 0:
                self.step[byte, w] |= bit
            elif byte == -1:
                self.step[:, w] |= bit
                self.step[slash, w] &= ~bit
            if loop:
                self.loop[:, w] |= bit
                if loop == "*":
                    self.loop[slash, w] &= ~bit
        for s in starts:
            self.init[s // 64] |= np.uint64(1 << (s % 64))

    def match(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A boolean for each (text, glob)."""
        n = len(off) - 1
        sizes = np.diff(off)
        order = np.argsort(-sizes, kind="stable")
        state = np.tile(self.init, (n, 1))
        at = off[:-1][order]
        active = n
        lengths = sizes[order]
        for k in range(int(lengths[0]) if n else 0):
            while active and lengths[active - 1] <= k:
                active -= 1
            byte = buf[at[:active] + k]
            d = state[:active]
            moved = d << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[byte]) | (d & self.loop[byte])
        out = np.empty((n, len(self.accept)), bool)
        for g, (s,) in enumerate(self.accept):
            out[order, g] = (state[:, s // 64] >> np.uint64(s % 64)) & np.uint64(1) == 1
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judge(rules: Sequence[Rule], blocked: Sequence[str]) -> Callable:
    ranked = sorted(rules, key=lambda r: -len(r.host + r.path))
    auto = Automaton([g for r in ranked for g in r.globs()] + list(blocked))
    names = pa.array([r.host + r.path for r in ranked], pa.string())
    verdicts = np.array([r.allow for r in ranked], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(JUDGED)
        for b in batches:
            hit = auto.match(*texts_of(b.column(3)))
            by_rule = hit[:, 0 : 2 * len(ranked) : 2] | hit[:, 1 : 2 * len(ranked) : 2]
            first = by_rule.argmax(axis=1) if len(ranked) else np.zeros(b.num_rows, np.int64)
            fits = by_rule.any(axis=1)
            allow = np.where(fits, verdicts[first] if len(ranked) else True, ~hit[:, 2 * len(ranked) :].any(axis=1))
            rule = names.take(pa.array(first, mask=~fits)) if len(ranked) else pa.nulls(b.num_rows, pa.string())
            yield batch_of(schema, b.column(0), b.column(1), b.column(2), rule, pa.array(np.where(allow, "allow", "block"), pa.string()))

    return run


JUDGED = "page_id long, host string, path string, rule string, verdict string"


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[Rule] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row.

    The longest rule that fits decides; ``rule`` is its host and path. Where none fits, ``rule`` is null and a match
    of ``blocked`` blocks. Null urls and urls without ``://`` have an empty host and path, which no rule fits.
    Null ids and repeated rows stay as they are. One pass, no shuffle; the automaton's size depends on the rules only.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumn("canonical", F.concat("host", "path")).mapInArrow(_judge(rules, blocked), JUDGED)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(verdict, h, s) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(verdict, length(h || s)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(best.verdict,
       CASE WHEN contains(host, 'spam') OR contains(host, 'casino') OR contains(path, '/ads/')
                 OR regexp_matches(path, '/wp-login[^/]*$') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""
