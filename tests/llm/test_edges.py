"""Nulls, repeated rows, clashing names and empty tables where other tests have none."""

import hashlib

from pyspark.sql import functions as F

from strandlake.llm import chat, html_text, toxicity


def test_chat_nulls_repeats_and_clashes(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "user", "<|im_end|>"), (3, 0, "", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1)).withColumn("PART", F.lit("x"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == sha([("user", "a"), ("assistant", "b"), ("assistant", "b")]) and got[1].loss_chars == 2 and got[1].n_turns == 3
    assert got[2].turns_sha256 == sha([("assistant", ""), ("", "")]) and got[2].loss_chars == 0
    assert got[None].turns_sha256 == sha([("user", "<|im_end|>")]) and got[3].turns_sha256 == sha([("", "x")])
    assert chat.digests(chat.format_conversations(turns.where("false"))).count() == 0


def test_html_table(spark):
    """extract and fit on a table: nulls, an empty page, repeated rows, columns of clashing names, an empty table."""
    article = "<html><body><nav><a href='/'>Home</a> <a href='/b'>More</a></nav><article><h1>A long title of it</h1>" + "".join(f"<p>Paragraph {i} tells of many things &amp; more, in a sentence that goes on for a while.</p>" for i in range(5)) + "</article><footer>Imprint</footer></body></html>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (3, "v", ""), (None, "w", "<p>"), (4, "x", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("Text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = html_text.extract(pages).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert len(got) == 6 and len(by[1]) == 2 and by[1][0] == by[1][1]
    text = by[1][0].text
    assert all(f"Paragraph {i} tells of many things & more" in text for i in range(5)) and "Imprint" not in text and "Home" not in text
    assert by[2][0].text == by[3][0].text == "" and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.where("false")).count() == 0


def test_toxicity_repeats_and_clashes(spark):
    """Labels decide nothing but the training; scores of equal texts are equal, whatever else the rows hold."""
    toxic, clean = "you are a stupid worthless idiot and everybody hates you", "the garden was full of flowers and quiet birds"
    rows = [(i, toxic + f" n{i}" if i % 3 == 0 else clean + f" n{i}") for i in range(90)] + [(500, None), (501, ""), (502, toxic), (502, toxic), (None, toxic), (503, clean)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("Toxic", F.lit(9)).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (1, None)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.fit(docs, labels)
    got = [(r.doc_id, r.text, r.score) for r in toxicity.scored(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    assert len({s for _, t, s in got if t == toxic}) == 1 and len({s for i, t, s in got if not t}) == 1
    assert {s for _, t, s in got if t == toxic}.pop() > {s for _, t, s in got if t == clean}.pop()
    assert toxicity.scored(docs.where("false"), model).count() == 0
    assert toxicity.fit(docs.where("false"), labels) is not None
