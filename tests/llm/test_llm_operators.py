"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from windlass.llm import exact_dedup, html_blocks, html_extract, html_labelled, jaccard_join, lattice, license_scan, lm_scoring, mixing, pieces, quality, suffix_array, suffix_dedup, warc

SCHEMA = "doc_id long, text string, source string, size int, kept string, h int, n int, rep int, bucket int, src string"
rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]


def sentence(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents():
    base = sentence(80, 1)
    near = base.split()
    near[3] = "changed"
    texts = [base, base, " ".join(near), None, "", "  \n\t", "one", "One", "one two", base.upper(), base.replace(" ", "\n"), base + " tail", sentence(300, 2), "x" * 400, "x" * 70, "aXb" * 60]
    texts += [sentence(60, 10 + i) + " " + base[:200] + " " + sentence(30, 40 + i) for i in range(6)] + ["é" * 30 + base[:90], "▁ mark <0x0A> " + base[:40], "word " * 3000]
    rows = [(i, t, ["a", "b", "c", None][i % 4], 1, "k", 2, 3, 4, 5, "s") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, "a", 1, "k", 2, 3, 4, 5, "s"), (None, None, None, 1, "k", 2, 3, 4, 5, "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_with_id():
    return [r for r in documents() if r[0] is not None]


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 5000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1" if i else None, h, "x") for i, h in enumerate(html)] + [(None, None, "<p>b</p>", "x")], "page_id long, url string, html string, refers_to string")
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert len(got) == 8
    last = {h or "": max(i for i, x in enumerate(html) if (x or "") == (h or "")) for h in html}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        want = None if last[h or ""] == i else last[h or ""]
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to) == (len(raw), warc.sha1_base32(raw), want)
        assert got[i].record_type == ("response" if want is None else "revisit")
    folder, manifest = warc.write_archives(pages)
    bodies = {r.page_id: r.html for r in warc.read_archives(folder, manifest).collect() if r.record_type == "response" and r.page_id is not None}
    assert bodies == {i: h or "" for i, h in enumerate(html) if last[h or ""] == i}
    assert {r.record_type for r in warc.archive_pages(pages, min_bytes=10**6).collect()} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_lm_scores(docs, empty):
    got = collections.defaultdict(list)
    for r in lm_scoring.score_texts(docs).collect():
        got[r.doc_id].append(r)
    counts = collections.Counter()
    for i, t, *_ in documents():
        if not lm_scoring.held_out(i):
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in documents():
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = next(x for x in got[i] if x.n_tokens == len(tokens))
        assert (r.n_known, r.train_tokens, r.held_out) == (sum(counts[w] > 0 for w in tokens), n, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base)
        assert math.isfinite(r.score) and r.score < 0
    assert lm_scoring.score_texts(empty).count() == 0


def test_lm_score_is_the_model(spark):
    """score against plain recursions: two rounds of expectation-maximisation, then all segmentations and the whole word."""
    pieces_, ranks = lattice.load_ranked(lm_scoring.VOCABULARY)
    start = dict(zip(pieces_, lattice.rank_weights(ranks).tolist(), strict=True))
    longest = max(map(len, pieces_))
    rows = [(i, " ".join(WORDS[(i * k) % 60] for k in range(1, 8 + i))) for i in range(40)]
    train = [w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.lower().encode().split()]
    ends, counts = sum(1 for i, _ in rows if zlib.crc32(str(i).encode()) % 10), collections.Counter(train)
    add = lambda xs: max(xs) + math.log(math.fsum(math.exp(x - max(xs)) for x in xs)) if xs else -math.inf

    def sums(s, logp, ahead):
        out = {len(s) if ahead else 0: 0.0}
        for j in range(len(s) - 1, -1, -1) if ahead else range(1, len(s) + 1):
            near = range(j + 1, min(len(s), j + longest) + 1) if ahead else range(max(0, j - longest), j)
            out[j] = add([out[k] + logp[s[min(j, k) : max(j, k)]] for k in near if s[min(j, k) : max(j, k)] in logp and out[k] > -math.inf])
        return out

    logp = start
    for _ in range(lm_scoring.ROUNDS):
        uses = collections.Counter()
        for w in counts:
            s = b" " + w
            fore, after = sums(s, logp, False), sums(s, logp, True)
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    if s[i:j] in logp and fore[i] + after[j] > -math.inf:
                        uses[s[i:j]] += lm_scoring.DISCOUNT * math.exp(fore[i] + logp[s[i:j]] + after[j] - fore[len(s)])
        mass = {p: uses[p] + lm_scoring.PRIOR * math.exp(x) for p, x in start.items()}
        total = math.fsum(mass.values())
        logp = {p: math.log(x / total) for p, x in mass.items()}
    n = len(train) + ends

    def word(w):
        return math.log10((lm_scoring.DISCOUNT * len(counts) * math.exp(sums(b" " + w, logp, False)[len(w) + 1]) + max(counts[w] - lm_scoring.DISCOUNT, 0.0)) / n)

    got = {r.doc_id: r for r in lm_scoring.score_texts(spark.createDataFrame([*rows, (114, "unseen zebra")], "doc_id long, text string")).collect()}
    for i, t in [*rows, (114, "unseen zebra")]:
        assert got[i].score == pytest.approx(math.fsum(word(w) for w in t.lower().encode().split()) + math.log10(ends / n), rel=1e-6)


def test_lattice_is_the_sum_over_segmentations():
    words = [b"a", b"b", b"ab", b"ba", b"aba", b"bab"]
    p = np.log(np.array([0.3, 0.25, 0.2, 0.1, 0.1, 0.05]))
    vocabulary = lattice.Vocabulary(words, p)

    def brute(s):
        return 1.0 if not s else sum(math.exp(p[words.index(s[:k])]) * brute(s[k:]) for k in range(1, min(3, len(s)) + 1) if s[:k] in words)

    strings = [b"a", b"abab", b"bbaab", b"ab" * 30]
    got = lattice.marginals(vocabulary, strings)
    for s, x in zip(strings[:3], got, strict=False):
        assert math.exp(x) == pytest.approx(brute(s))
    short = lattice.Lattice(vocabulary, [b"ab" * 10])
    long = lattice.Lattice.__new__(lattice.Lattice)
    long.vocabulary, long.rows, long.length, long.steps = vocabulary, 1, 20, []
    long._one_by_one([b"ab" * 10])
    assert long.forward()[-1] == pytest.approx(short.forward()[-1])
    use = np.zeros(6)
    lattice.Lattice(vocabulary, [b"aba"]).expected(np.array([2.0]), use)
    assert (use * [1, 1, 2, 2, 3, 3]).sum() == pytest.approx(6.0)  # every byte is covered once in both copies


def test_html_extraction(spark):
    page = "<html><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><article><h1>Some title here</h1><p>First &amp; only\n  text, with a<br>break. It goes on, and on.</p><script>bad()</script></article><footer>&copy; Someone</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "v", "", 0), (4, "w", "<p", 0), (1, "u", page, 0)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[1].text == "Some title here\nFirst & only text, with a break. It goes on, and on." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and html_extract.extract(pages).count() == 5
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_of_the_article_that_is_no_prose():
    """Formulas, fallbacks and scripts' replacements are text; the content of scripts, styles and form controls is not."""
    page = "<article><p>Let <math><mi>x</mi></math> be it.</p><noscript><p>Plain words.</p></noscript><p>A <object>fallback</object> <svg><text>label</text></svg></p><select><option>No</select><textarea>No</textarea><style>p{}</style></article>"
    assert [b.text for b in html_blocks.blocks_of(page)] == ["Let x be it.", "Plain words.", "A fallback label"]


def test_html_open_quotes_hide_no_more_than_their_tag():
    texts = lambda page: [b.text for b in html_blocks.blocks_of(page)]
    assert texts('<p><a href="q>z</a> and more</p>') == ["z and more"]
    assert texts("<p title='a > b'>x</p><p class=it's>y</p>") == ["x", "y"]
    assert texts('<p a="1>2" b>c</p>') == ["c"]
    assert texts("1 < 2 <b>and</b> <3 </> <!x> <!-- <p>no</p> --> 4 <p") == ["1 < 2 and <3 </> 4 <p"]


@pytest.mark.parametrize("part", ["<a ", "<a b=\"", "<a b='x\" ", "<div><b>", "</x>", "<p>word ", "<!-", "<!x ", "<script>", "&", "<i></p>"])
def test_html_pages_of_a_megabyte(part):
    begin = time.time()
    html_blocks.blocks_of("<p>x</p>" + part * (1_000_000 // len(part)))
    html_blocks.blocks_of("<p>x</p>" + part * (1_000_000 // len(part)) + ">\"'>")
    assert time.time() - begin < 30


def test_html_of_another_layout():
    """A page of tables and generic elements, as none that the model learned from."""
    body = "".join(f"<p>This is paragraph number {i}, with some clauses, and it says a thing or two about the matter at hand.</p>" for i in range(6))
    page = f"<html><body><div id=top class='nav-bar'><a href=/a>Home</a> <a href=/b>About</a></div><table><tr><td><div class='post-content'>{body}</div></td></tr></table><div class=comments><p>Nice one! <a href=/u>user7</a></p></div><div class=footer>Copyright 2020, all rights reserved</div></body></html>"
    got = [b.text for b in html_extract.main_blocks(page, html_extract.default_chain())]
    assert [t for t in got if t.startswith("This is paragraph")] == [b.text for b in html_blocks.blocks_of(body)]
    assert not any("Copyright" in t or "Home" in t for t in got)


def test_html_held_out_accuracy():
    chain = html_extract.default_chain()
    right = total = 0
    for seed in range(50_000, 50_100):
        page, labels = html_labelled.labelled_page(seed)
        found = chain.decode([html_blocks.features_of(b) for b in html_blocks.blocks_of(page)])
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    chain = html_extract.Chain({"a": 1.3, "b": -0.7, "c": 0.2}, [[0.4, -0.9], [-0.6, 0.8]])
    r = random.Random(2)
    for _ in range(30):
        feats = [[r.choice("abc")] for _ in range(r.randint(1, 7))]
        score = lambda y: sum(chain.weights[f[0]] * v for f, v in zip(feats, y, strict=True)) + sum(chain.move[p][q] for p, q in zip(y, y[1:], strict=False))  # noqa: B023, E731
        every = [[k >> i & 1 for i in range(len(feats))] for k in range(1 << len(feats))]
        assert score(chain.decode(feats)) == pytest.approx(max(map(score, every)))
        z = sum(math.exp(score(y)) for y in every)
        assert chain.marginals(feats)[0][0] == pytest.approx(sum(math.exp(score(y)) for y in every if y[0]) / z)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    top = {i: i for i, _ in sets}

    def root(x):
        return x if top[x] == x else root(top[x])

    for i, a in sets:
        for j, b in sets:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_jaccard_components(docs, k, num, den):
    want = brute_components(rows_with_id(), k, num, den)
    got = jaccard_join.jaccard_components(docs, k, num, den).collect()
    assert len(got) == len(documents())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want


def test_jaccard_chain_of_near_copies(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # a walk: neighbours link, ends do not; and copies around one base
        if i < 60:
            words = list(words)
            words[r.randrange(120)] = f"z{i}"
            rows.append((i, " ".join(words)))
        else:
            w = [f"b{j}" for j in range(150)]
            for _ in range(r.randint(1, 4)):
                w[r.randrange(150)] = f"q{r.randrange(40)}"
            rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_divide_skip_is_exact():
    r = np.random.default_rng(4)
    for _ in range(40):
        q = np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64))
        sets = [np.unique(np.r_[q[r.uniform(size=len(q)) < 0.95], r.integers(0, 80, r.integers(0, 4))].astype(np.uint64)) for _ in range(12)]
        want = {(i, len(np.intersect1d(q, s))) for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= jaccard_join.needed(len(q), len(s), 9, 10) and 10 * len(np.intersect1d(q, s)) >= 9 * len(np.union1d(q, s))}
        index = jaccard_join.Inverted(sets)
        assert set(index.search(q, 9, 10)) == want
        assert set(index.search(q, 9, 10, {1, 5})) == {x for x in want if x[0] in (1, 5)}
    assert jaccard_join.Inverted([]).search(q, 9, 10) == [] == jaccard_join.Inverted([q]).search(q[:0], 9, 10)


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_pieces_round_trip(docs, empty):
    rows = pieces.round_trip(docs, with_ids=True).collect()
    assert len(rows) == len(documents()) and all(r.lossless for r in rows)
    encoded = pieces.encode(docs)
    decoded = {r.doc_id: r.text for r in pieces.decode(encoded.where("doc_id IS NOT NULL")).collect()}
    assert decoded == {i: t or "" for i, t, *_ in rows_with_id()}
    assert {r.doc_id: r.ids for r in encoded.collect() if r.doc_id is not None} == {r.doc_id: r.ids for r in rows if r.doc_id is not None}
    assert pieces.round_trip(empty).count() == 0


def test_sampling_follows_the_lattice():
    model = pieces.PieceModel(pieces.MODEL)
    unit, seen = b" the", collections.Counter()
    ids, per = pieces.Sampler(model).sample([pieces.row_key(i) for i in range(4000)], [unit] * 4000)
    for x in np.split(ids, np.cumsum(per)[:-1]):
        seen[tuple(model.bytes_of[i] for i in x.tolist())] += 1
    p = dict(zip(model.vocabulary.pieces, np.exp(model.vocabulary.logp), strict=True))

    def ways(s):
        return [()] if not s else [(s[:k], *rest) for k in range(1, len(s) + 1) if s[:k] in p for rest in ways(s[k:])]

    weight = {w: math.prod(p[x] for x in w) for w in ways(unit)}
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for w, x in weight.items():
        assert abs(seen[w] / 4000 - x / total) < 0.04


@pytest.mark.parametrize("text", [b"   ", b"    if", b"a  b", b"\n  \n"])
def test_sampling_follows_the_lattice_over_runs_of_spaces(text):
    model = pieces.PieceModel(pieces.MODEL)
    ids, per = pieces.Sampler(model).sample([pieces.row_key(i) for i in range(4000)], [text] * 4000)
    seen = collections.Counter(tuple(model.bytes_of[i] for i in x.tolist()) for x in np.split(ids, np.cumsum(per)[:-1]))
    p = dict(zip(model.vocabulary.pieces, np.exp(model.vocabulary.logp), strict=True))

    def ways(s):
        return [()] if not s else [(s[:k], *rest) for k in range(1, len(s) + 1) if s[:k] in p for rest in ways(s[k:])]

    weight = {w: math.prod(p[x] for x in w) for w in ways(text)}
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for w, x in weight.items():
        assert abs(seen[w] / 4000 - x / total) < 0.04


def test_draws_do_not_depend_on_what_else_is_kept():
    """With millions of states before it, and a number next to one, a draw still is an edge of its own state."""
    model = pieces.PieceModel(pieces.MODEL)
    own = pieces.Sampler(model)
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(10)).encode() for _ in range(16_000)]
    own.rows(list(range(len(texts))), texts)
    assert len(own.heads) > 2_000_000
    word = b" w0198001"
    first, _ = own.sample([5], [word])
    again, _ = pieces.Sampler(model).sample([5], [word])
    assert first.tolist() == again.tolist() and model.decode(first.tolist()) == word
    base, size = int(own.base[own.known[word]]), len(word)
    for u in (np.nextafter(1.0, 0.0), 1 - 2.0**-35, 0.0):
        edges = own.draw(base + np.arange(1, size + 1), np.full(size, u))
        for end, edge in enumerate(edges.tolist(), 1):
            assert own.heads[base + end] <= edge < own.heads[base + end + 1]
            assert model.vocabulary.pieces[own.piece[edge]] == word[end - own.back[edge] : end]


def test_pieces_of_other_batches_agree(spark, docs):
    """Equal ids, whatever order and batches the rows come in; long texts are cut where no unit is."""
    rows = {r.doc_id: r.ids for r in pieces.encode(docs.where("doc_id IS NOT NULL")).collect()}
    again = pieces.encode(docs.where("doc_id IS NOT NULL").orderBy(F.desc("text")).repartition(5))
    assert {r.doc_id: r.ids for r in again.collect()} == rows
    text = ("word  two\n\n  indented é " * 500).encode()
    own = pieces.sampler(pieces.MODEL)
    whole = own.rows([3], [text])[0].tolist()
    size, pieces.PART = pieces.PART, 100
    try:
        assert own.rows([3], [text])[0].tolist() == whole and len(list(pieces._parts(text))) > 50
    finally:
        pieces.PART = size


def test_long_lattice_is_the_lattice():
    model = pieces.PieceModel(pieces.MODEL)
    text = b" " * 19 + b"indented" + "é".encode() * 4
    ends, back, piece, share = pieces.long_lattice(model.vocabulary, text)
    plain = lattice.Lattice(model.vocabulary, [text])
    alpha = plain.forward()[:, 0]
    want = {(j, j - i, int(p[0])): math.exp(alpha[i] + model.vocabulary.logp[p[0]] - alpha[j]) for i, j, _, p in plain.steps if alpha[j] > -math.inf}
    got = {(a, b, c): x for a, b, c, x in zip(ends.tolist(), back.tolist(), piece.tolist(), share.tolist(), strict=True) if x > 0}
    assert got == pytest.approx({k: x for k, x in want.items() if x > 0})


def features(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + d for p in at.values() if len(p) > 1 for i in p for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered)


def cells(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = lambda s, seed: xxhash.xxh64_intdigest(s.encode(), seed)
    out = [signed(one(x, 42)) % quality.BUCKETS for x in w]
    return out + [signed(one(b, one(a, 42))) % quality.BUCKETS for a, b in zip(w, w[1:], strict=False)]


def test_quality_reads_whole_words(spark):
    """Texts whose words differ at their beginnings only have ratios of their own."""
    good = " ".join(f"fine{i}able" for i in range(60))
    poor = good.replace("fine", "poor")
    docs = spark.createDataFrame([(i, good if i < 5 else poor) for i in range(10)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_rules(docs, spark.createDataFrame([(0, 1, 0), (1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert got[4].llr > 0 > got[9].llr and got[4].kept


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (12, 1, 0), (12, 1, 0), (16, 1, 1), (17, 0, 0), (None, 1, 0), (18, None, None)], "doc_id long, quality int, toxic int")
    raw, target = collections.Counter(), collections.Counter()
    for i, t, *_ in documents():
        raw.update(cells(t))
        if i in (0, 12):
            target.update(cells(t))
    share, much = sum(target.values()) / sum(raw.values()), quality.SMOOTHING
    ratio = [round(quality.SCALE * math.log((target[b] + much * share) / (share * (raw[b] + much)))) for b in range(quality.BUCKETS)]
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == len(documents())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t, *_ in rows_with_id():
        r, f, g = by_id[i], features(t), cells(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0])
        score = sum(ratio[x] for x in g) / len(g) / quality.SCALE if g else 0.0
        assert r.llr == pytest.approx(score, abs=2e-6) and r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == sum(r.kept for r in got)
    assert quality.quality_rules(empty, labels).count() == 0
    assert {r.llr for r in quality.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def test_license_scan(spark, empty):
    texts = ["Some prose here.\nReleased under the MIT License.", "released UNDER the mit license", None, "", "nothing of the kind at all\nin here", "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", " ".join(t for s, t in license_scan.TEMPLATES if "hereby granted" in t and s == "MIT")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}

    def norm(t):
        return license_scan._parts(t)

    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        want = set()
        for piece in lines + ([t] if len(lines) > 1 else []):
            a = norm(piece or "")
            want |= {s for s, x in license_scan.TEMPLATES if a and 2 * len(a & norm(x)) / (len(a) + len(norm(x))) >= license_scan.THRESHOLD}
        assert set(got[i].licenses) == want
    assert got[0].best_license == "MIT" and got[0].best_dice == 1.0 and got[2].best_license is None
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_finds_wrapped_and_inline_notices(spark):
    mit = next(t for s, t in license_scan.TEMPLATES if s == "MIT" and "hereby granted" in t)
    head = "MIT License\n\nCopyright (c) 2020 Some One\n\n"
    tail = "\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"
    gpl = next(t for s, t in license_scan.TEMPLATES if s == "GPL-3.0" and "free software" in t)
    prose = "Some prose about the thing that we made last year."
    texts = {
        0: (head + textwrap.fill(mit, 76) + tail, ["MIT"]),
        1: (f"{prose} Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        2: ("\n".join(f"# {x}" for x in textwrap.wrap(gpl, 60)) + "\nimport this\n" + prose, ["GPL-3.0"]),
        3: (f"{prose} Released under the MIT License. {prose * 30} Licensed under CC BY 4.0. {prose}", ["CC-BY-4.0", "MIT"]),
        4: (" ".join([prose] * 50), []),
        5: ("licensed under\nthe", []),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: w for i, (_, w) in texts.items()}
    assert got[0].best_dice == got[1].best_dice == got[3].best_dice == 1.0 and got[3].n_places == 2 and got[4].n_places == 0


def test_license_scan_tells_templates_of_one_wording_apart(spark):
    gpl3, gpl2 = ("This work is licensed under the GNU General Public License, version %d." % v for v in (3, 2))
    cc = "This work is licensed under a Creative Commons Attribution 4.0 International License."
    texts = [gpl3, f"Prose.\n{gpl2}\nMore prose.", f"{gpl3}\n{gpl2}", cc, cc.replace("Attribution", "Attribution-NonCommercial"), "Nothing of the kind.", None]
    want = [["GPL-3.0"], ["GPL-2.0"], ["GPL-2.0", "GPL-3.0"], ["CC-BY-4.0"], ["CC-BY-NC-4.0"], [], []]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.identified for r in got} == dict(enumerate(want))


def test_license_windows_equal_brute_force(spark):
    r, t = random.Random(11), license_scan.THRESHOLD
    short = [(s, x) for s, x in license_scan.TEMPLATES if len(license_scan._parts(x)) < 14]
    pool = sorted({w for _, x in short for w in license_scan._words_of(x)})
    texts = []
    for _ in range(60):
        words = license_scan._words_of(r.choice(short)[1])
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(pool)
        texts.append(" ".join(r.choices(pool, k=r.randint(0, 8)) + words + r.choices(pool, k=r.randint(0, 8))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.best_dice for x in license_scan.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        w = license_scan._words_of(text)
        every = [license_scan._parts(" ".join(w[a:b])) for a in range(len(w)) for b in range(a + 2, len(w) + 1)]
        best = max(2 * len(g & s) / (len(g) + len(s)) for _, x in license_scan.TEMPLATES for s in [license_scan._parts(x)] for g in every)
        assert got[i] == (pytest.approx(best, abs=1e-8) if round(best, 9) >= t else None)


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(documents())
    size = collections.Counter()
    for _, t, s, *_ in documents():
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while True:
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.discard(s)
    target |= share
    ids = {i: s for i, _, s, *_ in documents() if i is not None}
    for r in rows:
        if r.doc_id is not None:
            assert r.target == pytest.approx(target[ids[r.doc_id]]) and r.source_size == size[ids[r.doc_id]]
            assert r.taken == r.size * r.copies and r.copies <= 3
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(empty).count() == 0 and mixing.emit_mix(empty).count() == 0


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in documents():
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup.exact_dedup(docs, capacity=2).collect()
    assert len(got) == len(documents())
    texts = {hashlib.sha256(x.encode()).hexdigest(): g for x, g in groups.items()}
    for r in got:
        g = texts[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min(g)[3] and r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize(("capacity", "depth"), [(25, 4), (1, 4), (10_000, 4), (3, 1)])
def test_directory_splits_until_buckets_fit(spark, capacity, depth):
    sizes = {i: 10 for i in range(1 << depth)} | {1: 100}
    rows = exact_dedup.directory_of(spark.createDataFrame(list(sizes.items()), "cell long, n long"), depth, capacity).collect()
    assert {r.cell for r in rows} == set(sizes)
    total = lambda local, prefix: sum(n for c, n in sizes.items() if c >> (depth - local) == prefix)
    for r in rows:
        want = next((k for k in range(depth + 1) if total(k, r.cell >> (depth - k)) <= capacity), depth)
        assert (r.local, r.bucket) == (want, (1 << want) + (r.cell >> (depth - want)))


def brute_repeats(rows, span=50):
    seen = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            seen[w] = min(seen.get(w, i if i is not None else math.inf), i if i is not None else math.inf)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] < (math.inf if i is None else i):
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(documents())
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 20])
def test_suffix_dedup_of_hot_minimizers(spark, docs, hot):
    """One phrase in many contexts, a text that repeats itself and near copies: the hot ones' way gives the same result."""
    r = random.Random(5)
    phrase = "the very common phrase"
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(6)) + f" {phrase} {r.choice(WORDS)} {i % 40} " + "ab cd " * (i % 30)) for i in range(300)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(many, hot=hot, texts=False).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)
    got = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(documents())


def test_suffix_dedup_bounds(spark):
    """A text of 20 MB and 5,000 contexts of one 16-byte string: units stay bounded, and no bucket has all the contexts."""
    r = random.Random(6)
    big = "".join(r.choices("abcdefghij ", k=20_000_000))
    rows = [(1, big), (2, "x" * 100 + big[1_000_000:1_000_200] + "y" * 100)]
    rows += [(10 + i, f"{r.getrandbits(150):040x} sixteen bytes it {r.getrandbits(150):040x}") for i in range(5_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    units = suffix_dedup.Units(df)
    assert units.rows == 5_002 and all(x.n <= 4_000 for x in units.table.collect())
    hot = suffix_dedup.hot_minimizers(units, suffix_dedup.SPAN, 500)
    assert len(hot) >= 1
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(df, texts=False, hot=500).collect()}
    assert len(got) == 5_002 and (got[1].n_bytes, got[1].n_removed) == (20_000_000, 0)
    assert 200 <= got[2].n_removed <= 204 and got[2].n_spans == 1
    assert all(got[10 + i].n_removed == 0 for i in range(5_000))


@pytest.mark.parametrize("alphabet", [b"ab", bytes(range(0x80))])
def test_needed_suffixes_and_classes(alphabet):
    r = random.Random(4)
    for _ in range(25):
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 9))]
        buf = suffix_array.joined(strings)
        b = buf.tobytes()
        place, kind = suffix_array.prefix_classes(buf, 7)
        starts = [i for i in range(len(b)) if 0 not in b[i : i + 7] and len(b) - i > 7]
        assert sorted(place.tolist()) == starts
        assert len(set(kind.tolist())) == len({b[i : i + 7] for i in starts}) == len({(b[i : i + 7], k) for i, k in zip(place.tolist(), kind.tolist(), strict=True)})


def test_distinct_strings_apart():
    data = b"abcabcabdab" + bytes(3)
    firsts, number = suffix_dedup.distinct(suffix_dedup._loads(data, 64), np.array([0, 3, 6, 9, 0]), np.array([3, 3, 3, 2, 2]), np.array([0, 0, 0, 0, 1]))
    assert number[0] == number[1] and len(set(number.tolist())) == 4 == len(firsts)
    assert [0, 0, 0, 1] == [[0, 0, 0, 0, 1][i] for i in firsts]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(0x80))])
def test_suffix_array_order(alphabet):
    r = random.Random(3)
    for _ in range(25):
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 9))]
        buf = suffix_array.joined(strings)
        b = buf.tobytes()
        suffix = lambda i: b[i : b.index(0, i)][:20]  # noqa: B023, E731
        order = suffix_array.suffix_array(buf, 20)
        assert sorted(order.tolist()) == [i for i in range(len(b)) if b[i]]
        found = [suffix(i) for i in order]
        assert found == sorted(found)
