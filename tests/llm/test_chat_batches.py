"""Long conversations that end with an Arrow batch."""

from strandlake.llm import chat


def test_parts_across_batches(spark):
    said = {c: [("user", f"question {c} " * 3), ("assistant", f"answer {c} " * 3)] for c in [*range(20), None]}
    said |= {c: [("user", f"{c} {i}") for i in range(5)] for c in range(20, 30)}
    turns = [(c, i, role, text) for c, ts in said.items() for i, (role, text) in enumerate(ts)]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    for size in ("1", "2", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            for part_bytes in (10, 150):
                by = {}
                for r in sorted(chat.format_conversations(frame, part_bytes).collect(), key=lambda r: r.part):
                    by.setdefault(r.conv_id, []).append(r)
                assert {c: [r.part for r in rs] for c, rs in by.items()} == {c: list(range(len(rs))) for c, rs in by.items()}
                assert {c: [t for r in rs for t in chat.parse(r.formatted)] for c, rs in by.items()} == said
                assert {r.conv_id: r.n_turns for r in chat.digests(chat.format_conversations(frame, part_bytes)).collect()} == {c: len(ts) for c, ts in said.items()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
