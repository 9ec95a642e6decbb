"""Decontamination, URL rules and the similarity join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import decontaminate, jaccard, url_filter
from helixframe.llm.shared import texts_of


def flat(texts):
    return texts_of(pa.array(texts, pa.string()))


# Decontamination

ITEMS = [
    (0, "If Anna buys 12 apples and gives 5 apples to her friend Paul, then Anna walks 3 km home, how many apples are left over?"),
    (1, "short question here"),
    (2, None),
    (3, ""),
    (4, "11 22 33 44 55 66 77 88 99"),
    (5, "Alice buys 3 pens."),
    (6, "thirty two people went from Paris to the next town by train"),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(i, t, "z", None) for i, t in ITEMS], "item_id long, text string, doc_id string, row string")


CASES = [
    (10, "Some words before. " + ITEMS[0][1] + " And after.", True),
    (11, "Intro. If Maria buys 40 apples and gives 7 apples to her friend Peter, then Maria walks 9 km home, how many apples are left over?", True),  # other numbers and names
    (12, "Intro. If Maria buys 40 apples and gives 7 apples to her friend Peter, then Klara walks 9 km home, how many apples are left over?", False),  # one name, two people
    (13, "If somebody buys apples and goes home there is nothing to see.", False),
    (14, "A short question here", True),
    (15, "See 11 22 33 44 55 66 77 88 99", True),  # no literals, no template: verbatim
    (19, "See 12 23 34 45 56 67 78 89 91", False),
    (20, "MARY said: Mary buys 8 pens. Then some more.", True),  # a name begins the sentence
    (21, "So forty one people went from New York to the next town by train.", True),  # number words, names of two words
    (22, "So forty one people went from New York to the next village by bus and stayed there.", False),
    (16, None, False),
    (17, "", False),
    (18, "if anna BUYS", False),
]


@pytest.mark.parametrize("bound", [1 << 20, 2])
def test_leaks_and_parameters(spark, benchmark, bound):
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in CASES] + [(10, CASES[0][1], 1), (None, CASES[0][1], 1)], "doc_id long, text string, item_id int")
    got = decontaminate.leaks(docs.repartition(2), benchmark, broadcast_windows=bound).collect()
    assert sorted((r.doc_id for r in got if r.doc_id is not None)) == sorted([i for i, _, leak in CASES if leak] + [10])
    assert sum(r.doc_id is None for r in got) == 1
    kept = decontaminate.drop_leaks(docs, benchmark, broadcast_windows=bound)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, leak in CASES if not leak)


def test_no_benchmark_no_documents(spark, benchmark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in CASES], "doc_id long, text string")
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == len(CASES)
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0


def brute_template(text):
    """The rules of canonical(), token by token."""
    found, end = [], None
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+", text):
        token, near = m.group(), end is not None and text[end : m.start()] in (" ", "-")
        if token[0].isdigit():
            kind = "number"
        elif token.lower() in decontaminate.NUMBERS:
            kind = "spelled"
        elif len(token.encode()) > 1 and token[0].isupper() and not (len(token) > 1 and token[1].isupper()) and token.lower() not in decontaminate.COMMON:
            kind = "name"
        else:
            kind = token.lower()
        if not (found and near and kind == found[-1] and kind in ("name", "spelled")):
            found.append(kind)
        end = m.end()
    out = []
    for kind in found:
        kind = "number" if kind == "spelled" else kind
        out.append("unit" if out and out[-1] == "number" and kind in decontaminate.UNITS else kind)
    return out


def test_templates_match_brute_force():
    words = ["The", "tree", "Anna", "km", "KM", "12", "3.5", "1,000", "é", "École", "ÜBER", "x", "Ähre", "percent", "I", "two", "Thirty", "zwölf", "Москва", "МИР", "город", "Ωμέγα", "Łódź", "Ő", "中文"]
    gaps = [" ", " ", "-", ", ", ". ", "! ", "\n", " - ", "; ", " (", "5", ""]
    rng = random.Random(5)
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    t = decontaminate.canonical(*flat(texts))
    names = {int(decontaminate.NUMBER): "number", int(decontaminate.NAME): "name", int(decontaminate.UNIT): "unit"}
    for k, text in enumerate(texts):
        want = brute_template(text)
        got = t.tokens[t.doc == k]
        assert [names.get(int(h), h) if isinstance(names.get(int(h), h), str) else int(h) for h in got] == [w if w in names.values() else int(decontaminate._word_hash(w)) for w in want], text


def brute_leaks(docs, items, width, coverage):
    """Window join and slot consistency by plain loops over one document and one item at a time."""

    def tokens(text):
        t = decontaminate.canonical(*flat([text]))
        return [(int(a), int(v), bool(s)) for a, v, s in zip(t.tokens, t.values, t.slot)]

    def key(window):
        rich = 2 * sum(s for _, _, s in window) > len(window)
        return None if rich and len(window) < 3 else (rich, tuple(v if rich else a for a, v, _ in window))

    found = set()
    for k, text in enumerate(docs):
        d = tokens(text)
        for i, item in enumerate(items):
            t = tokens(item)
            w = min(width, len(t))
            starts = [a for a in range(len(t) - w + 1) if w and key(t[a : a + w]) is not None]
            pairs = [(a, b) for a in starts for b in range(len(d) - w + 1) if key(d[b : b + w]) == key(t[a : a + w])]
            if not starts or len({a for a, _ in pairs}) < coverage * len(starts):
                continue
            shifts = {}
            for a, b in pairs:
                for (_, v, slot), (_, x, _) in zip(t[a : a + w], d[b : b + w]):
                    if slot:
                        shifts.setdefault(b - a, {}).setdefault(v, set()).add(x)
            if not shifts or any(all(len(x) == 1 for x in m.values()) for m in shifts.values()):
                found.add((k, i))
    return found


@pytest.mark.parametrize("bound", [1 << 20, 2])
def test_window_join_and_slots_match_brute_force(spark, bound):
    rng = random.Random(8)
    words = ["the", "a", "cat", "runs", "Anna", "Bob", "Carol", "3", "5", "seven", "km", "home", "with"]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 6, 9]))) for _ in range(12)]
    swap = lambda t: " ".join(rng.choice([w, w, w, {"Anna": "Dora", "3": "9", "Bob": "Carol", "5": "seven"}.get(w, w)]) for w in t.split())
    docs = [". ".join([" ".join(rng.choice(words) for _ in range(8)), swap(rng.choice(items)), swap(rng.choice(items))]) for _ in range(40)]
    got = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), width=5, broadcast_windows=bound)
    want = brute_leaks(docs, items, 5, 0.5)
    assert want and {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_planted_passages_are_all_found(spark, medium):
    got = {r.doc_id for r in decontaminate.op3_template_decontamination(spark, medium).collect()}
    items = [r.text for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    want = {r.doc_id for r in spark.read.parquet(f"{medium}/documents.parquet").collect() if any(t in r.text for t in items)}
    assert want and got == want


# URLs


def glob_regex(g):
    out = ""
    for part in re.split(r"(\*\*|\*|\?)", g):
        out += {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return re.compile(out.encode(), re.DOTALL)


def test_automaton_matches_regular_expressions():
    rng = random.Random(6)
    pieces = ["a", "b", "/", ".", "*", "**", "?", "ab", "a/b"]
    globs = list(dict.fromkeys("".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(70)))
    urls = ["".join(rng.choice(["a", "b", "/", ".", "ab"]) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", "ü/ü", "a" * 3000]
    auto = url_filter.Automaton(globs)
    assert auto.words > 1
    hit = auto.match(*flat(urls))
    for k, u in enumerate(urls):
        for g, pattern in enumerate(globs):
            assert hit[k, g] == bool(glob_regex(pattern).fullmatch(u.encode())), (u, pattern)


def brute_judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([k for k in (tail.find(c) for c in "?#") if k >= 0], default=len(tail))]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        r = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, r.host + r.path, "allow" if r.allow else "block"
    bad = "spam" in host or "casino" in host or "/ads/" in path or re.search(r"/wp-login[^/]*\Z", path)
    return host, path, None, "block" if bad else "allow"


def test_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.org/en/12?x=1", "https://a.example.org/es/", "https://a.example.org/es", "ftp://org/", "http://x.org", "http://notexample.org/en/1", "http://evilorg/", "http://b.com/fr/x#y", "http://com/de/",
        "http://b.com/de?/de/", "http://spam.net/a", "http://my-casino.net", "http://ok.net/a/ads/b", "http://ok.net/x/wp-login.php", "http://ok.net/wp-login/x", "http://x://y/en", "http://ex\nample.net/a\nb/ads/", "http://ü.org/es/", "http://u:p@host.net:80/de/?#",
    ]
    df = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)] + [(None, urls[4], None, None), (4, urls[4], None, None)], "page_id long, url string, host string, verdict string")
    rows = url_filter.judge(df).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute_judge(urls[4 if r.page_id is None else r.page_id])
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.rule for r in url_filter.judge(df, rules=(), blocked=()).collect()} == {None}


# Similarity join


def brute_links(texts, threshold=jaccard.THRESHOLD):
    sets = [frozenset(s.tolist()) for s in jaccard.gram_sets(*flat(texts))]
    distinct = sorted({s for s in sets if s}, key=hash)
    links = {s: set() for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if len(a & b) >= threshold * len(a | b):
                links[a].add(b)
                links[b].add(a)
    return sets, links


def test_gram_sets_match_brute_force():
    texts = ["a b c d", "A, b. C! d", "a b", "", "a", None, "x y z x y z x y z"]
    s = jaccard.gram_sets(*flat(texts))
    assert [len(x) for x in s] == [2, 2, 1, 0, 1, 0, 3]
    assert np.array_equal(s[0], s[1]) and not np.array_equal(s[2], s[4])


def test_embedding_agrees_as_often_as_sets_are_similar():
    rng = np.random.default_rng(8)
    u = [np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)) for _ in range(40)]
    a, b = [x[:600] for x in u], [x[200:800] for x in u]  # similarity 1/2
    rate = (jaccard.embed([np.sort(x) for x in a]) == jaccard.embed([np.sort(x) for x in b])).mean()
    hashed = [np.sort(jaccard.mix(x)) for x in a], [np.sort(jaccard.mix(x)) for x in b]
    rate = (jaccard.embed(hashed[0]) == jaccard.embed(hashed[1])).mean()
    assert abs(rate - 0.5) < 0.03
    tiny = [np.sort(jaccard.mix(np.array(x, np.uint64))) for x in ([1, 2, 3], [1, 2, 3, 4])]
    assert 0.5 < (jaccard.embed(tiny)[0] == jaccard.embed(tiny)[1]).mean() <= 1


def check_join(rows, texts):
    sets, links = brute_links([texts[k] for k in sorted(texts)])
    by_id = dict(zip(sorted(texts), sets))
    want = found = 0
    for r in rows:
        s = by_id[r.doc_id]
        true = len(links.get(s, ()))
        assert r.n_links <= true
        want, found = want + true, found + r.n_links
        assert r.class_size == sum(x == s for x in sets)
        assert r.class_id == max(k for k in by_id if by_id[k] == s)
    # Groups: components of the classes, one row kept of each.
    groups = {}
    for r in rows:
        groups.setdefault(r.group_id, []).append(r)
    for g, own in groups.items():
        assert sum(r.kept for r in own) == 1 and all(r.group_size == len(own) for r in own)
        assert g == max(r.doc_id for r in own) == next(r.doc_id for r in own if r.kept)
    return found, want


def test_join_matches_brute_force(spark, medium):
    rows = jaccard.op8_chosen_path_join(spark, medium).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    found, want = check_join(rows, texts)
    assert want > 100 and found >= 0.99 * want


@pytest.mark.parametrize("block", [512, 16])
def test_large_groups_lose_no_links(spark, monkeypatch, block):
    """A cluster beyond a bucket's size, and a passage that many otherwise different texts share."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for k in range(60):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        texts[k] = " ".join(words)
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for k in range(60, 140):
        own = [rng.choice(vocabulary) for _ in range(200)]
        texts[k] = " ".join(own[:100] + passage + own[100:])
    texts[140] = texts[141] = texts[0]
    rows = jaccard.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found, want = check_join(rows, texts)
    assert want > 1000 and found >= 0.99 * want


def test_runs_reach_the_recall_where_buckets_are_split():
    """The walk of pairs at the threshold through buckets that are all split to the end, by the coordinates that paths choose."""
    rng = np.random.default_rng(12)
    number, trials = jaccard.runs_for(jaccard.THRESHOLD, jaccard.RECALL), 20_000
    same = rng.random((trials, jaccard.COORDINATES)) < jaccard.THRESHOLD
    met = np.zeros(trials, bool)
    for r in range(number):
        pair = np.flatnonzero(same[:, r * (jaccard.COORDINATES // number)])
        path = rng.integers(0, 1 << 63, len(pair)).astype(np.uint64)
        for _ in range(jaccard.MOST_DEPTH - 1):
            chosen = np.stack([jaccard._chosen(path, k) for k in range(jaccard.BRANCHES)])
            assert all((chosen[a] != chosen[b]).all() for a in range(jaccard.BRANCHES) for b in range(a))
            pair = np.concatenate([pair[same[pair, c]] for c in chosen])
            path = rng.integers(0, 1 << 63, len(pair)).astype(np.uint64)
        met[pair] = True
    assert met.mean() >= jaccard.RECALL - 0.002


def test_pairs_at_the_threshold_in_small_blocks(spark, monkeypatch):
    """Pairs of a similarity from 0.5 to 0.55 that share their frequent grams with all other texts, so that buckets are split."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(60)]
    texts = {}
    for k in range(300):
        shared = [word() for _ in range(75)]
        for s in range(2):
            texts[2 * k + s] = " ".join(passage + shared + [word() for _ in range(58)])
    rows = jaccard.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found, want = check_join(rows, texts)
    assert want >= 600 and found >= 0.98 * want


@pytest.mark.parametrize("union", [2, 4, 8, 16, 40])
def test_sketches_of_small_sets_at_the_threshold(union):
    """The sift's bound holds for sets of few grams too."""
    rng = np.random.default_rng(union)
    grams = rng.integers(0, 1 << 63, (4000, union)).astype(np.uint64) * np.uint64(2)
    small = jaccard.embed([np.sort(g[: union // 2]) for g in grams])
    large = jaccard.embed([np.sort(g) for g in grams])
    rate = (small == large)[:, :: jaccard.COORDINATES // jaccard.SKETCH].mean(axis=1)
    assert abs(rate.mean() - 0.5) < 0.02 and (rate < 0.25).mean() < 0.002


def test_short_texts_at_the_threshold(spark):
    rng = random.Random(14)
    texts = {}
    for k in range(200):
        words = [f"w{rng.randrange(10**9)}" for _ in range(22)]
        for n in (3, 4, 6):  # one, two and four trigrams
            texts[len(texts)] = " ".join([f"n{n}", *words[: n - 1]])
            texts[len(texts)] = " ".join([f"n{n}", *words[: 2 * n - 3]])
    rows = jaccard.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found, want = check_join(rows, texts)
    assert want >= 1200 and found >= 0.985 * want


def test_join_odd_rows(odd, none):
    rows = jaccard.similar(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r.doc_id in (3, 4, 6)]
    assert {(r.class_id, r.class_size, r.n_links, r.group_id) for r in empty} == {(6, 3, 0, 6)}
    assert sum(r.kept for r in empty) == 1
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert {(r.class_id, r.class_size) for r in same} == {(2, 3)} and sum(r.kept for r in same) == 1
    assert jaccard.similar(none).count() == 0
    out = jaccard.one_of_each(odd)
    assert out.columns == odd.columns and out.count() == sum(r.kept for r in rows)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100, **{k: 200 for k in range(200, 260)}}
