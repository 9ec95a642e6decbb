"""Quality field, suffix tree, language kernels: against brute force and on held-out rows."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import language, quality, suffix_tree
from helixframe.llm.shared import texts_of


def flat(texts):
    return texts_of(pa.array(texts, pa.string()))


# Quality


def brute_marginals(emit, trans):
    weights, good = [], np.zeros(len(emit))
    for path in itertools.product((0, 1), repeat=len(emit)):
        w = math.exp(sum(e for e, s in zip(emit, path) if s) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        weights.append(w)
        good += w * np.array(path)
    return good / sum(weights), math.log(sum(weights))


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    sizes = [4, 1, 6, 2, 6]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    emit, trans = rng.normal(size=len(doc)), rng.normal(size=(2, 2))
    good, pair, z = quality.Chains(doc).marginals(emit, trans)
    logs = 0.0
    for d in range(len(sizes)):
        g, lz = brute_marginals(emit[doc == d], trans)
        assert np.allclose(good[doc == d], g)
        logs += lz
    assert np.isclose(z, logs)
    assert np.isclose(pair.sum(), len(doc) - len(sizes))


def test_loss_gradient_is_right():
    rng = np.random.default_rng(2)
    doc = np.repeat(np.arange(5), [3, 1, 4, 2, 5])
    x, trans = rng.normal(size=(len(doc), 3)), rng.normal(size=(2, 2))
    w = rng.normal(size=3)
    good, pair, z = quality.Chains(doc).marginals(x @ w, trans)
    for k in range(3):
        d = np.zeros(3)
        d[k] = 1e-6
        up = quality.Chains(doc).marginals(x @ (w + d), trans)[2]
        assert np.isclose((up - z) / 1e-6, x[:, k] @ good, atol=1e-3)
    for i, j in itertools.product((0, 1), repeat=2):
        t = trans.copy()
        t[i, j] += 1e-6
        assert np.isclose((quality.Chains(doc).marginals(x @ w, t)[2] - z) / 1e-6, pair[i, j], atol=1e-3)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["one line", "", "a\nb\n\nc\n", "\n\n", "ÄÖ !!! ### | x x x", None, "last\nline"]
    doc, size, x = quality.line_features(*flat(texts))
    for k, t in enumerate(texts):
        d, s, y = quality.line_features(*flat([t]))
        assert np.array_equal(size[doc == k], s) and np.allclose(x[doc == k], y)
        assert len(d) == max(1, len((t or "").removesuffix("\n").split("\n")))
    assert x.shape[1] == quality.FEATURES


def test_long_lines_count_as_several():
    doc, size, _ = quality.line_features(*flat(["x y " * 600_000, "short"]))
    assert (doc == 0).sum() == 3 and (doc == 1).sum() == 1


def test_quality_on_held_out_documents(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet").toPandas()
    from helixframe.llm.quality import op1_quality_crf

    got = op1_quality_crf(spark, medium).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert len(held) > 30 and (held.predicted == held.quality).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (5, 1, 0), (8, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).count() == odd.count()
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_the_sample_has_a_bound_on_lines(spark):
    """Long documents are passed over once the lines are used up; repeated ids and texts are one."""
    docs = spark.createDataFrame([(k, "good line of text\n" * (200 if k % 4 == 0 else 3)) for k in range(40)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    taken = []
    fit = quality.fit

    def spy(doc, x, label, **kw):
        taken.append((len(set(doc.tolist())), len(doc)))
        return fit(doc, x, label, **kw)

    quality.fit = spy
    try:
        quality.fit_on(docs, labels, lines=150)
        quality.fit_on(docs, labels)
    finally:
        quality.fit = fit
    assert taken[0] == (30, 90) and taken[1] == (40, 90 + 10 * 200)


# Suffix tree


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "The CAT sat", "", None, "der hund saß auf der matte", "the the the", "dog cat\n\tmat  the"] * 6


def test_base_scores_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    import zlib

    rows = {r.doc_id: r for r in suffix_tree.lm_scores(docs.repartition(3)).collect()}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    train = [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in [*lower(TEXTS[i]), None])
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(TEXTS)
    for i, r in rows.items():
        tokens = [*lower(TEXTS[i]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert np.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)


def brute_tree(grams, root, penalty, smoothing):
    """States and smoothed probabilities by plain dictionaries; grams: {(.., symbol): count}."""
    depth = suffix_tree.DEPTH
    joint = [Counter() for _ in range(depth + 1)]
    for g, n in grams.items():
        for d in range(1, depth + 1):
            joint[d][g[depth - d :]] += n
    ctx = [Counter() for _ in range(depth + 1)]
    for d in range(1, depth + 1):
        for g, n in joint[d].items():
            ctx[d][g[:-1]] += n
    positions = sum(grams.values())

    def prob(c, s):
        if not c:
            return root[s]
        return (joint[len(c)][c + (s,)] + smoothing * prob(c[1:], s)) / (ctx[len(c)][c] + smoothing) if c in ctx[len(c)] else prob(c[1:], s)

    states = set()
    for d in range(depth, 0, -1):
        for c in ctx[d]:
            gain = sum(n * math.log(prob(c, g[-1]) / prob(c[1:], g[-1])) for g, n in joint[d].items() if g[:-1] == c)
            if gain >= penalty * math.log(positions):
                states.update(c[k:] for k in range(d))
    return states, prob


def test_tree_matches_dictionaries():
    rng = np.random.default_rng(3)
    grams = Counter()
    seq = [0, 0]
    for _ in range(3000):
        seq.append(int(rng.choice(5, p=np.roll([0.6, 0.2, 0.1, 0.05, 0.05], seq[-1] + seq[-2]))) + 2)
    for k in range(2, len(seq)):
        grams[tuple(seq[k - 2 : k + 1])] += 1
    share = Counter(seq[2:])
    root = {s: share[s] / 3000 for s in range(2, 7)}
    table = np.full(suffix_tree._SYMBOLS, -9.0)
    table[list(root)] = np.log10(list(root.values()))
    bits = suffix_tree._BITS
    pack = lambda g: sum(s << (bits * k) for k, s in enumerate(reversed(g)))
    levels = []
    for d in (1, 2):
        j = Counter()
        for g, n in grams.items():
            j[g[2 - d :]] += n
        c = Counter()
        for g, n in j.items():
            c[g[:-1]] += n
        arrays = [(np.array([pack(g) for g in x], np.uint64), np.array(list(x.values()))) for x in (c, j)]
        levels.append(arrays)
    tree = suffix_tree.build([a for a, _ in levels], [b for _, b in levels], table, penalty=2.0, smoothing=5.0)
    states, prob = brute_tree(grams, root, 2.0, 5.0)
    assert states
    for d in (1, 2):
        found, _ = tree.back[d - 1].find(np.array([pack(c) for c in states if len(c) == d], np.uint64))
        assert found.all() and (tree.back[d - 1].keys != tree.back[d - 1]._EMPTY).sum() == len([c for c in states if len(c) == d])
    g = np.array([pack(x) for x in grams], np.uint64)
    gain = suffix_tree.log_gains(tree, table, g)
    for x, value in zip(grams, gain):
        c = x[:-1]
        while c and c not in states:
            c = c[1:]
        want = math.log10(prob(c, x[-1]) / root[x[-1]])
        assert np.isclose(value, want, atol=1e-5)
        if c:  # a state's distribution sums to 1
            assert np.isclose(sum(prob(c, s) for s in root), 1)


def packed(grams):
    bits = suffix_tree._BITS
    return np.array([sum(s << (bits * k) for k, s in enumerate(reversed(g))) for g in grams], np.uint64)


@pytest.mark.parametrize("tokens", [30_000, 10**9])
def test_weights_do_not_depend_on_the_share(spark, tokens):
    """What is frequent enough counts, be it as small a share of a large input: the written tree is that built in memory."""
    rng = np.random.default_rng(5)
    seq = [0, 0]
    for _ in range(30_000):
        seq.append(int(rng.choice(30, p=np.roll([0.71, *[0.01] * 29], 3 * seq[-1] + 7 * seq[-2]))) + 2)
    grams = Counter(tuple(seq[k - 2 : k + 1]) for k in range(2, len(seq)))
    root = np.full(suffix_tree._SYMBOLS, -9.0)
    share = Counter(seq[2:])
    root[list(share)] = np.log10(np.array(list(share.values())) / 30_000)
    levels = []
    for d in (1, 2):
        j, c = Counter(), Counter()
        for g, n in grams.items():
            j[g[2 - d :]] += n
            c[g[2 - d : -1]] += n
        levels.append([{k: n for k, n in x.items() if n >= least} for x, least in ((c, suffix_tree.CONTEXT_COUNT), (j, suffix_tree.ENTRY_COUNT))])
    arrays = [[(packed(x), np.array(list(x.values()))) for x in level] for level in levels]
    tree = suffix_tree.build([a for a, _ in arrays], [b for _, b in arrays], root, penalty=suffix_tree.PENALTY * math.log(tokens) / math.log(30_000))
    pairs, count = Counter(), np.zeros(suffix_tree._SYMBOLS, np.int64)
    for g, n in grams.items():
        pairs[g[1:]] += n
        count[g[1]] += n
    table = [(int(k), n) for k, n in zip(packed(grams), grams.values())] + [(int(k) | suffix_tree._PAIR, n) for k, n in zip(packed(pairs), pairs.values())]
    table = spark.createDataFrame([(k, n) for k, n in table if n >= suffix_tree.ENTRY_COUNT], "gram long, n long")
    rows = suffix_tree._weights(table, tokens, root, count).toPandas()
    assert rows.key.is_unique and (rows.n < 1e-6 * tokens).any() == (tokens == 10**9)
    weights = suffix_tree.Table(rows.key.to_numpy(np.int64).view(np.uint64), rows.value.to_numpy())
    g = packed(grams)
    want = suffix_tree.log_gains(tree, root, g)
    assert (want != 0).mean() > 0.5
    assert np.allclose(sum(weights.find(k)[1] for k in suffix_tree.keys_of(g)), want, atol=1e-4)


def test_scores_are_the_same_in_parts_of_any_size(spark, monkeypatch):
    """One part or hundreds, frequent symbols split or not, many flushes of a task or one."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(300):
        at, words = 0, []
        for _ in range(100):
            at = (3 * at + 1) % 40 if rng.random() < 0.7 else int(rng.integers(40))
            words.append(f"w{at}")
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r for r in suffix_tree.lm_scores(docs).collect()}
    assert all(r.score > r.base_score for r in whole.values())
    for size in (20_000, 300):
        monkeypatch.setattr(suffix_tree, "_HELD", 4_000)
        rows = suffix_tree.lm_scores(docs, part_tokens=size).collect()
        assert len(rows) == len(whole) and all(np.isclose(r.score, whole[r.doc_id].score, atol=1e-3) for r in rows)


def test_routes_send_a_token_to_all_its_weights():
    rng = np.random.default_rng(9)
    count = np.zeros(suffix_tree._SYMBOLS, np.int64)
    count[:50] = [5000, 0, *rng.integers(1, 40, 48)]
    count[7] = 3000
    routes = suffix_tree.Routes.of(count, 20)
    assert routes.hot.tolist() == [0, 7] and routes.splits[0] > 5 and routes.splits[1] > 3
    symbols = rng.choice([0, 2, 7, 8, 9], (500, 3)).astype(np.uint64)
    grams = (symbols[:, 0] << np.uint64(40)) | (symbols[:, 1] << np.uint64(20)) | symbols[:, 2]
    keys = np.unique(np.concatenate(suffix_tree.keys_of(grams)))
    batch = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.ones(len(keys)))], names=["key", "value"])
    there = {}
    for b in suffix_tree._weights_by_part(routes)(iter([batch])):
        for r in b.to_pylist():
            there.setdefault(r["part"], set()).update(suffix_tree._unpack(r["a"], r["n"], np.uint64).tolist())
    part = routes.part(symbols[:, 1].astype(np.int64), symbols[:, 2])
    for p, *own in zip(part.tolist(), *suffix_tree.keys_of(grams)):
        assert {int(k) for k in own} <= there[p]


def test_lookup_table():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 60, 5000).astype(np.uint64))
    t = suffix_tree.Table(keys, np.arange(len(keys), dtype=float))
    found, values = t.find(np.concatenate([keys, keys + np.uint64(1)]))
    assert found[: len(keys)].all() and np.array_equal(values[: len(keys)], np.arange(len(keys), dtype=np.float32))
    assert not found[len(keys) :][~np.isin(keys + np.uint64(1), keys)].any()
    assert not suffix_tree.Table(keys[:0], np.zeros(0)).find(keys)[0].any()


def test_tree_beats_the_base_on_held_out_texts(spark, medium):
    r = suffix_tree.op2_suffix_tree(spark, medium).toPandas()
    held = r[r.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert (held.score > held.base_score).mean() > 0.8
    assert (r.score <= 0).all()


def test_tree_odd_rows(spark, odd, none):
    rows = suffix_tree.lm_scores(odd).collect()
    assert len(rows) == odd.count()
    assert all(math.isfinite(r.score) and r.n_tokens >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 6)} == {1}
    assert suffix_tree.lm_scores(none).count() == 0


# Language


def test_presence_is_by_text():
    texts = ["abc", "", "ABC abc", "ü", None, "x1y2"]
    x = language.presence(*flat(texts))
    for k, t in enumerate(texts):
        assert np.array_equal(x[k], language.presence(*flat([t]))[0])
    assert x[1].sum() == x[4].sum() == 0


def test_scores_are_those_of_the_kernel_machine():
    """The collapsed product gives the same values as landmark kernels, inverse root and ridge regression one by one."""
    train = ["the cat and the dog", "der hund und die katze", "le chat et le chien", "the house and the tree", "das haus und der baum", "la maison et le bois"]
    langs = ["en", "de", "fr"] * 2
    x = language.presence(*flat(train))
    model = language.fit(np.packbits(x, axis=1), langs, np.arange(3), ridge=0.1)
    kernel = lambda a, b: (a.astype(int) @ b.astype(int).T) / np.sqrt(np.outer(a.sum(1), b.sum(1)))
    k_mm = kernel(x[:3], x[:3])
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors / np.sqrt(values)
    phi = np.column_stack([kernel(x, x[:3]) @ root, np.ones(6)])
    y = np.where(np.array(langs)[:, None] == np.array(["de", "en", "fr"])[None], 1, -1)
    w = np.linalg.solve(phi.T @ phi + 0.1 * np.eye(4), phi.T @ y)
    test = language.presence(*flat(["the dog and the tree", "der baum"]))
    want = np.column_stack([kernel(test, x[:3]) @ root, np.ones(2)]) @ w
    got = test.astype(np.float32) @ model.matrix[:-1] / np.sqrt(test.sum(1))[:, None] + model.matrix[-1]
    assert np.allclose(got, want, atol=1e-4)


def test_language_on_held_out_documents(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang").toPandas()
    r = language.op7_language_kernel(spark, medium).toPandas().merge(docs, on="doc_id")
    held = r[r.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() >= 0.97
    assert r.score.between(0, 1).all()


def test_language_odd_rows(spark, odd, none):
    model = language.fit_on(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 6)) for r in rows)
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit_on(none)).collect()} == {"und"}


def test_many_languages_share_the_sample(spark, monkeypatch):
    """Twenty languages: the driver gets a bounded number of texts and landmarks, and every language is learned."""
    monkeypatch.setattr(language, "MOST_SAMPLE", 400)
    monkeypatch.setattr(language, "MOST_LANDMARKS", 60)
    rng = np.random.default_rng(10)
    words = {k: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(30)] for k in range(20)}
    docs = spark.createDataFrame([(20 * n + k, " ".join(rng.choice(words[k], 12)), f"l{k:02d}") for k in range(20) for n in range(40)], "doc_id long, text string, lang string")
    sizes = []
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda x, langs, marks, **kw: (sizes.append((len(x), len(marks))), fit(x, langs, marks, **kw))[1])
    model = language.fit_on(docs.filter("doc_id % 7 <> 0"))
    assert sizes == [(400, 60)] and len(model.langs) == 20
    rows = language.identify(docs.filter("doc_id % 7 = 0"), model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 20:02d}" for r in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("text,want", [("1 2 !", False), ("中", True), ("—«»", False), ("a", True), ("é", True)])
def test_letters(text, want):
    col = pa.array([text])
    assert language.has_letter(col, *texts_of(col))[0] == want
