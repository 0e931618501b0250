"""Chat formatting by columnar byte assembly.

Turns come sorted by conversation. For a batch of turns, the lengths of all segments (header, role, text, end mark) are one numpy
array, their running sums the offsets, and one repeat of (source - target) offsets the indices at which every output byte is found;
one gather fills one preallocated buffer, which becomes the Arrow column of formatted texts without another copy.

Format of a turn: <|im_start|>role\\ntext<|im_end|>\\n. Inside roles and texts, "<", any backslashes and "|" get one backslash more
before the "|", so control strings occur only as marks; reading takes it away again.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
ASSISTANT = "assistant"
#: A conversation longer than this many bytes is given in several parts, in order.
PART_BYTES = 8 << 20

_ESCAPED = re.compile(rb"<(\\*)\|")
_UNESCAPED = re.compile(rb"<(\\+)\|")


def escape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1\\|", text) if b"<" in text else text


def unescape(text: bytes) -> bytes:
    return _UNESCAPED.sub(lambda m: b"<" + m[1][1:] + b"|", text) if b"<\\" in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes of a text column, and its offsets. Only values with a "<" become Python objects."""
    values = column.fill_null("").cast(pa.large_binary())
    has = pa.compute.match_substring(column.fill_null(""), "<")
    if pa.compute.any(has).as_py():
        values = pa.array([escape(v) for v in values.to_pylist()], pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: its bytes, each turn's offset, and the bounds of each turn's text in it."""
    n = len(roles)
    (rd, ro), (td, to) = _bytes(roles), _bytes(texts)
    fixed = np.frombuffer(START + MIDDLE + END, np.uint8)
    source = np.concatenate([fixed, rd, td])
    at = np.zeros((n, 5), np.int64)  # where the five segments of each turn lie in source
    at[:, 0], at[:, 2], at[:, 4] = 0, len(START), len(START) + len(MIDDLE)
    at[:, 1], at[:, 3] = len(fixed) + ro[:-1], len(fixed) + len(rd) + to[:-1]
    length = np.zeros((n, 5), np.int64)
    length[:, 0], length[:, 2], length[:, 4] = len(START), len(MIDDLE), len(END)
    length[:, 1], length[:, 3] = np.diff(ro), np.diff(to)
    ends = np.cumsum(length.ravel())
    begins = ends - length.ravel()
    total = int(ends[-1]) if n else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(at.ravel() - begins, length.ravel())
    out = np.empty(total, np.uint8)
    np.take(source, index, out=out)
    begins, ends = begins.reshape(n, 5), ends.reshape(n, 5)
    return out, np.append(begins[:, 0], total), begins[:, 3], ends[:, 3]


def _text(buffer: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(buffer))


def _code_points(buffer: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte."""
    return np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])


def format_conversations(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """turns: conv_id (bigint), turn, role, text. Returns conv_id, part, n_turns, formatted, loss: array of (start, stop).

    One row per conversation, or several parts in order (part 0, 1, ...) of one longer than part_bytes; a turn is never split. loss
    marks the code points of formatted that are assistant texts. Null roles and texts are empty; turns of null conv_id are one
    conversation; null turns come first; ties of turn are ordered by role, then text; repeated rows are repeated turns. Other
    columns are ignored, and an empty table gives an empty result.
    """
    sorted_turns = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sorted_turns = sorted_turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def build(batches):
        rest, part, long = None, 0, None  # turns of the conversation that the last batch did not end; its next part; the one that was cut
        for b in _with_last(batches):
            t = None if b is None else pa.Table.from_batches([b])
            t = rest if t is None else t if rest is None else pa.concat_tables([rest, t])
            if t is None or not t.num_rows:
                continue
            rest = None
            ids = t.column("conv_id").combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            v = ids.fill_null(0).to_numpy()
            if (known[0], v[0]) != long:  # the one that was cut had ended with its batch
                part = 0
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (known[1:] != known[:-1])
            begin = np.flatnonzero(new)
            done = len(v) if b is None else int(begin[-1])
            if b is not None:  # the last conversation may go on
                rest = t.slice(done)
                if rest.nbytes > part_bytes and rest.num_rows:
                    done, rest = len(v), None
            if not done:
                continue
            ended = b is None or rest is not None
            begin = begin[begin < done]
            t = t.slice(0, done)
            roles = t.column("role").combine_chunks()
            buffer, offsets, text_from, text_to = assemble(roles, t.column("text").combine_chunks())
            # Conversations of many bytes are cut between turns.
            cuts = [begin]
            for a, z in zip(begin, np.append(begin[1:], done), strict=True):
                if offsets[z] - offsets[a] > part_bytes:
                    cuts.append(a + 1 + np.flatnonzero(np.diff((offsets[a:z] - offsets[a]) // part_bytes)))
            first = np.unique(np.concatenate(cuts))
            bounds = np.append(first, done)
            parts, number = [], part
            starts = set(begin.tolist())
            for k, i in enumerate(first.tolist()):
                number = (part if k == 0 else 0) if i in starts else number + 1
                parts.append(number)
            part, long = (0, None) if ended else (parts[-1] + 1, (known[-1], v[-1]))
            spoken = pa.compute.equal(roles.fill_null(""), ASSISTANT).to_numpy(zero_copy_only=False)
            points = _code_points(buffer)
            owner = np.searchsorted(first, np.flatnonzero(spoken), "right") - 1
            shift = points[offsets[first]][owner]
            loss = pa.StructArray.from_arrays([pa.array(points[text_from[spoken]] - shift), pa.array(points[text_to[spoken]] - shift)], ["start", "stop"])
            counts = np.bincount(owner, minlength=len(first))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), loss)
            formatted = _text(buffer, offsets[bounds])
            for a in range(0, len(first), 1000):
                z = min(a + 1000, len(first))
                yield pa.RecordBatch.from_arrays(
                    [t.column("conv_id").combine_chunks().take(pa.array(first[a:z])), pa.array(parts[a:z], pa.int32()), pa.array(np.diff(bounds)[a:z], pa.int64()), formatted.slice(a, z - a).cast(pa.string()), lists.slice(a, z - a)],
                    ["conv_id", "part", "n_turns", "formatted", "loss"],
                )

    return sorted_turns.mapInArrow(build, "conv_id bigint, part int, n_turns bigint, formatted string, loss array<struct<start: bigint, stop: bigint>>")


def _with_last(batches):
    yield from batches
    yield None


_TURN = re.compile(rb"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    return [(unescape(m[1]).decode(), unescape(m[2]).decode()) for m in _TURN.finditer(formatted.encode())]


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation of format_conversations(), read back from its output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Parts of one conversation follow each other within a partition, as format_conversations() leaves them.

    Turns of null conv_id are one conversation of null conv_id; an empty table gives an empty result; other columns are ignored.
    """

    def read(batches):
        state = None

        def flush():
            turns, spoken = state["turns"].hexdigest(), state["loss"].hexdigest()
            return [state["id"], state["n"], turns, state["loss_chars"], spoken, state["chars"]]

        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["part"] == 0:
                    if state:
                        rows.append(flush())
                    state = {"id": r["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                text = r["formatted"]
                for role, said in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for span in r["loss"]:
                    masked = unescape(text[span["start"] : span["stop"]].encode())
                    state["loss"].update(masked)
                    state["loss_chars"] += len(masked.decode())
                state["chars"] += len(text)
            if rows:
                yield _table(rows)
        if state:
            yield _table([flush()])

    return formatted.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _table(rows):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
