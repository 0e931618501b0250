"""Training-data operators against brute force on small tables, with nulls, empty tables, ties and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import chat, hashing, html_text, mixing, ngram_join, pieces, pii, topk, toxicity, url_filter, words
from strandlake.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_jaccard_components_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    texts = []
    for i in range(60):
        changed = list(base)
        for j in rng.integers(0, 60, i % 4):
            changed[j] = f"x{rng.integers(99)}"
        texts.append(" ".join(changed))
    texts += ["", None, "one two", "one two", "ONE two", " ".join(base)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == {i: (find(i), len(sets[i])) for i in sets}
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


def test_exact_top_and_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(400, None), (500, [float("nan")] * 16), (600, [0.0] * 16), (700, [None] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ids = np.array([*range(300), 600])
    whole = np.floor(256 * np.concatenate([x, np.zeros((1, 16))]))
    got = topk.exact_top(vectors, F.col("vec_id") % 50 == 0, 5).collect()
    for q in (0, 50, 600):
        s = whole @ whole[ids == q][0]
        want = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(int(ids[i]), int(s[i])) for i in want]
    found = hashing.neighbours(vectors, F.col("vec_id") % 20 == 0, 5).collect()
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        want = [int(i) for i in np.argsort(-s) if i != q][:5]
        hit += len(set(want) & {r.vec_id for r in found if r.query_id == q})
    assert hit >= 0.9 * 5 * 15 and not any(r.query_id == 600 for r in found)


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model, library = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = [w for w in model.ids if len(w) > 1 and not w.startswith("▁▁") and pieces.merged(w, model) != pieces._one_pass(w, model)]
    assert not odd
    texts = ["", None, " ", "  a  b\n\tc ", "x" * 300 + " 日本語😀 ﬁ\r\n", "▁", "Hello, world! 12345", *(" " * n + "a" for n in range(1, 12)), "-" * 90]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    encoded = pieces.encode(docs(spark, rows), model)
    got = {r.doc_id: (r.ids, r.text) for r in pieces.decode(encoded, model).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    assert all(got[i][1] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_viterbi_fold(spark):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -2.2, "bb": -3.0}
    model = pieces.Pieces({p: i + 1 for i, p in enumerate(scores)}, scores, None, 0, "viterbi", frozenset(a + b for p in scores for a, b in zip(p, p[1:], strict=False)))

    def best(word):
        if not word:
            return (0.0, [])
        options = [(scores[word[:k]] + best(word[k:])[0], [model.ids[word[:k]], *best(word[k:])[1]]) for k in range(1, len(word) + 1) if word[:k] in scores]
        return max(options)

    inputs = ["▁abb", "▁aab", "abab", "▁bb"]
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in inputs], "word string"), model).collect()}
    assert got == {w: best(w)[1] for w in inputs}


def test_pii(spark):
    text = "mail joe@example.org.uk or +1 (555) 123-4567, host 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111é"
    rows = [(1, text, "s"), (2, None, "s"), (3, "", "s"), (4, "a.b" * 2000 + "1" * 5000, "s")]
    got = {r.doc_id: [(s.kind, text[s.start : s.stop]) for s in r.base] for r in pii.detect(docs(spark, rows)).collect()}
    assert got[1] == [("email", "joe@example.org.uk"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert got[2] == got[3] == got[4] == []
    clean = {r.doc_id: r.text for r in pii.redacted(docs(spark, rows)).collect()}
    assert clean[1] == "mail [EMAIL] or [PHONE], host [IP] not 10.0.0.256, card [CARD]é" and clean[2] is None


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 5}" if i % 11 else None) for i in range(200)]
    frame = docs(spark, rows).withColumn("size", F.lit(-1))
    got = mixing.mix(frame).collect()
    assert len(got) == 200 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].target <= 2 * own[0].source_size + 1e-6
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert mixing.mix(docs(spark, [])).count() == 0


def test_chat_round_trip(spark):
    marks = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", marks), (1, 1, "assistant", "a<\\|b é\n" + marks), (2, 0, None, None), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    for part in (8 << 20, 10):
        formatted = chat.format_conversations(frame, part).collect()
        by = {}
        for r in sorted(formatted, key=lambda r: r.part):
            by.setdefault(r.conv_id, []).extend(chat.parse(r.formatted))
        assert by == {1: [("user", marks), ("assistant", "a<\\|b é\n" + marks)], 2: [("", "")], None: [("assistant", "x")]}
    assert chat.format_conversations(frame.where("conv_id = 9")).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.COM/en/7?x", "https://example.net/de/81", "x.net/de/", None, "http://foo.org/es/#a", "http://com/en/", "http://xcom/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, labels).collect()}
    assert got == {0: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 1: ("example.net", "/de/81", "example.net/de/8", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("foo.org", "/es/", "org/es/", "block"), 5: ("com", "/en/", "com/en/", "block"), 6: ("xcom", "/en/", None, "allow")}


def test_html():
    model = html_text.train(["alpha", "beta", "gamma", "delta."] * 5, 200)
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div><article><h1>Title &amp; more</h1><p>First   text, with words and more words.<p>Second <b>text</b>.</article><div class="comments"><p>Nice one</p></div><footer>&copy; us</footer>'
    assert html_text.extracted([page, "", "<p>"], model) == ["Title & more\n\nFirst text, with words and more words.\n\nSecond text.", "", ""]


def test_toxicity(spark):
    rows = [(i, ("you idiot moron loser " if i % 5 == 0 else "a fine day ") + f"word{i % 13} other{i % 7}", "s") for i in range(300)] + [(1000, None, "s"), (1001, "", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs(spark, rows), toxicity.fit(docs(spark, rows), labels)).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(300)) and got[1000] == got[1001] < 0.7
    flat = toxicity.fit(docs(spark, rows), labels.where("toxic = 0"))
    assert len({r.score for r in toxicity.scored(docs(spark, rows), flat).collect()}) == 1


def test_words():
    import pyarrow as pa

    texts = ["One two\tthree", "", None, "four", "ONE two three"]
    got = [len(s) for s in words.shingle_sets(pa.array(texts), 2)]
    assert got == [2, 0, 0, 1, 2]
    sets = list(words.shingle_sets(pa.array(texts), 2))
    assert (sets[0] == sets[4]).all()


def test_components_of_chains_stars_and_odd_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(101, 100), (102, 100), (100, 102), (200, 200), (None, 7), (302, 301), (302, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    least = list(range(120))
    for _ in range(120):
        for u, v in links:
            least[u] = least[v] = min(least[u], least[v])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {n: least[n] for u, v in links if u != v for n in (u, v)}
