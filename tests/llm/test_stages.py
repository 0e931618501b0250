"""The stages of the corpus pipeline and operators of it against brute force, on small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import chat, mixing, pieces, url_filter

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic documents of two sources, exact and near copies, personal data."""
    rng = np.random.default_rng(8)
    path = str(tmp_path_factory.mktemp("corpus"))
    prose = lambda n: " ".join(WORDS[int(i)] for i in rng.integers(0, 300, n))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        text = prose(60) + (" you stupid idiot moron pathetic trash" if toxic else " thank you")
        rows.append((i, text, "en", ("a", "b", None)[i % 3], len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(300, rows[1][1], "en", "a", 0), (301, rows[1][1] + " more", "en", "a", 0), (302, "write to me.you@mail.example.com now", "en", "b", 0), (303, "", "en", "a", 0), (304, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_one_by_one(spark, corpus):
    path, rows = corpus
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    docs = stages["toxicity"](spark, docs, path)
    assert docs.columns == names and {r.doc_id for r in docs.select("doc_id").collect()} == {r[0] for r in rows if "idiot" not in (r[1] or "")}
    docs = stages["near_duplicates"](spark, docs, path)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.columns == names and kept == {r[0] for r in rows if "idiot" not in (r[1] or "")} - {300, 301}
    docs = stages["pii"](spark, docs, path)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == names and text[302] == "write to [EMAIL] now" and all(text[r[0]] == r[1] for r in rows if r[0] in kept and r[0] != 302)
    size = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    mixed = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    again = stages["mixing"](spark, docs, path)
    out = again.select("doc_id", F.size(F.split("text", " ")).alias("n")).collect()
    assert again.columns == names
    for doc, taken in mixed.items():
        uses = sorted(r.n for r in out if r.doc_id == doc)
        assert sum(uses) == taken and len(uses) == -(-taken // size[doc]) if size[doc] else not uses


def test_run_ends_with_pieces_of_the_library(spark, corpus):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    path, rows = corpus
    text = {r[0]: r[1] for r in rows}
    got = corpus_pipeline.run(spark, path).collect()
    whole = [r for r in got if r.doc_id != 302 and list(r.ids) == library.encode(text[r.doc_id])]
    assert len(whole) >= 0.95 * len(got) and {r.doc_id for r in got} <= set(text)  # the others were cut at the end of a target


def test_targets_and_taken_words(spark):
    """The water level by bisection; every source's taken words meet its target."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["x"] * int(rng.integers(0, 40))), ("c", "a", None, "b", "é")[i % 5]) for i in range(200)] + [(7, "x y z", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("__mix_size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high, total = 0.0, 1e9, 1.5 * sum(size.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weight[s] * level, 2 * size[s]) for s in size) < total else (low, level)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - min(weight[s] * low, 2 * size[s])) < 1e-6 and mine[0].source_size == size[s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and all(r.taken <= 2 * r.size for r in mine)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(docs.where("false")).count() == 0


def test_reputation_falls_back(spark):
    urls = [f"http://a{i % 4}.evil.com/{i}" for i in range(400)] + [f"http://b{i % 4}.good.org/{i}" for i in range(400, 800)] + [f"http://x.shop.co.uk/{i}" for i in range(800, 900)]
    pages = [(i, u) for i, u in enumerate(urls)] + [(1000, "http://new.evil.com/x"), (1001, "http://new.good.org/x"), (1002, "http://other.co.uk/x"), (1003, None), (1004, "nothing"), (1005, "http://y.shop.co.uk/x"), (1005, "http://y.shop.co.uk/x")]
    labels = [(i, 1, int(i < 400 or i >= 800)) for i in range(900)]
    table = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("bound", F.lit(1)).withColumn("Host", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.verdict, r.bound) for r in url_filter.judged(table, marks, rules=()).collect()}
    assert got[1000][1] == "block" and got[1001][1] == "allow" and got[1005][1] == "block" and got[0][1] == "block" and got[500][1] == "allow"
    assert got[1003] == ("", "allow", None) and got[1004] == ("", "allow", None)
    found = url_filter.reputations(spark.createDataFrame([("a.x.co.uk", 1), ("b.x.co.uk", 0)], "host string, bad int"))
    assert {r.domain for r in found.domains.collect()} == {"x.co.uk"} and {r.suffix for r in found.suffixes.collect()} == {"co.uk"}
    empty = url_filter.judged(table, marks.where("false"), rules=()).collect()
    assert len(empty) == len(pages) and all(r.verdict == "allow" for r in empty)


def test_chat_digests_equal_brute_force(spark):
    marks = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 1, "assistant", "a < b"), (1, 0, "user", marks), (2, 0, "assistant", marks), (2, 1, "assistant", None), (3, 0, "user", "é<|x|>\n"), (None, 0, "user", "n")]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    want = {}
    for c in (1, 2, 3, None):
        own = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3] or ''}\n" for t in own)
        want[c] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert got == want
