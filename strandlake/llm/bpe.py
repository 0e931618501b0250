"""Byte-level BPE encoding and decoding.

A word (what the pre-tokeniser's pattern cuts) becomes a doubly linked list of symbols, one per byte. A priority queue holds the merges
that neighbouring symbols allow, by rank and then from the left. The best is taken off; it is stale, and skipped, if a symbol of it was
merged away or has changed since; otherwise the two symbols become one, and the new neighbours enter the queue. Decoding concatenates the
strings of the vocabulary and turns their letters back into bytes.

Each worker keeps the ids of the words it has met lately (up to CACHED of them), so that a text costs about one lookup per word. Nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import slices

VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a worker keeps (those not met for the longest time are forgotten first), and the longest that it keeps, in bytes.
CACHED, LONGEST_CACHED = 600_000, 64
#: Bytes of text that a task handles at once, unless one text has more.
SLICE_BYTES = 2 << 20
#: How the byte-level pre-tokeniser cuts texts (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Vocabulary:
    """byte_ids: the id of each byte. merges: for each left id, right id to (rank, id of both). strings: bytes of each id. added: strings that are ids of their own."""

    byte_ids: tuple
    merges: tuple
    strings: tuple
    added: dict

    @cached_property
    def known(self) -> tuple[dict, dict]:
        """Words met by this copy of the vocabulary, lately and before; a worker's tasks share it. It never travels."""
        return {}, {}

    def __reduce__(self):
        return Vocabulary, (self.byte_ids, self.merges, self.strings, self.added)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be seen, else the next free letter from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


def load(path: str) -> Vocabulary:
    """A vocabulary file of kind byte-level BPE; the file is read on the driver only."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model, before = content["model"], content.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or content.get("normalizer") or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE vocabulary")
    letters = byte_letters()
    byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
    added = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    ids = model["vocab"]
    strings = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for s, i in ids.items():
        strings[i] = b"".join(byte_of[c] for c in s)
    for s, i in added.items():
        strings[i] = s.encode()
    merges: list[dict] = [{} for _ in strings]
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[a]][ids[b]] = (rank, ids[a + b])
    return Vocabulary(tuple(ids[c] for c in letters), tuple(merges), tuple(strings), added)


def merged(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one word. An entry of the queue is rank and place in one number; rank[i] is that of the pair that begins at i now."""
    follow = vocabulary.merges
    ids = [vocabulary.byte_ids[b] for b in word]
    n = len(ids)
    found = [follow[a].get(b) for a, b in zip(ids, ids[1:])]  # noqa: B905
    queue = [m[0] << 32 | i for i, m in enumerate(found) if m]
    if not queue:
        return ids
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [m[0] if m else -1 for m in found]
    into = [m[1] if m else -1 for m in found]
    rank.append(-1)
    while queue:
        entry = pop(queue)
        i = entry & 0xFFFFFFFF
        if rank[i] != entry >> 32:  # stale: the symbol at i, or the next one, has changed since, or is gone
            continue
        j = after[i]
        both = ids[i] = into[i]
        ids[j] = rank[j] = -1
        k = after[i] = after[j]
        rank[i] = -1
        if k < n:
            before[k] = i
            if m := follow[both].get(ids[k]):
                rank[i], into[i] = m
                push(queue, m[0] << 32 | i)
        h = before[i]
        if h >= 0:
            if m := follow[ids[h]].get(both):
                rank[h], into[h] = m
                push(queue, m[0] << 32 | h)
            else:
                rank[h] = -1
    return [i for i in ids if i >= 0]


class Encoder:
    """Encodes texts to bytes of little-endian 32-bit ids; lives in one task."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.known = vocabulary, vocabulary.known
        self.words = regex.compile(PATTERN).findall
        self.added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None

    def _new(self, word: str) -> bytes:
        young, old = self.known
        ids = old.get(word)
        if ids is None:
            raw = word.encode()
            ids = np.array(merged(raw, self.vocabulary), "<u4").tobytes()
            if len(raw) > LONGEST_CACHED:
                return ids
        if len(young) >= CACHED // 2:
            old.clear()
            old.update(young)
            young.clear()
        young[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        get, new = self.known[0].get, self._new
        return b"".join([get(w) or new(w) for w in self.words(text)])

    def __call__(self, text: str) -> bytes:
        if self.added is None or not any(s in text for s in self.vocabulary.added):
            return self._plain(text)
        parts = self.added.split(text)
        return b"".join(np.array([self.vocabulary.added[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and ids (array<int>): those of the whole text, strings of added tokens being one id each.

    Null and empty texts give no ids; a null doc_id stays null; each repeated row gives a row; other columns, of any name, are ignored;
    an empty table gives an empty result. The vocabulary (as large as its file) is sent to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = Encoder(shared.value)
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                ids = [encoder(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded: ids (array<int>) and more columns, which stay. Adds text; bytes that are no UTF-8 become U+FFFD, null ids an empty text.

    An id outside the vocabulary is an error. A column text that was there is replaced.
    """
    kept = [c for c in encoded.columns if c.lower() != "text"]
    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])
    place = [c.lower() for c in kept].index("ids")
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.strings)

    def run(batches):
        strings = shared.value
        size = np.array([len(s) for s in strings], np.int64)
        begin, letters = np.cumsum(size) - size, np.frombuffer(b"".join(strings), np.uint8)
        for b in batches:
            lists = b.column(place)
            lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count else lists
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = lists.flatten().to_numpy()
            i = 0
            while i < b.num_rows:  # about SLICE_BYTES at a time
                j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES // 4, "right")) - 1)
                part = ids[at[i] : at[j]]
                n = size[part]
                ends = np.cumsum(n)
                index = np.repeat(begin[part] - (ends - n), n) + np.arange(n.sum())
                offsets = np.append(0, ends)[at[i : j + 1] - at[i]]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters[index])])
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, _text(raw)], [*kept, "text"])
                i = j

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, text string")


def _text(raw: pa.Array) -> pa.Array:
    try:
        text = raw.cast(pa.large_string())
        text.validate(full=True)
    except pa.ArrowInvalid:
        text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
    return text.cast(pa.string())


def digests(decoded: DataFrame) -> DataFrame:
    """decoded: doc_id, ids, text. doc_id, n_tokens, SHA-256 of the ids as little-endian unsigned 32-bit integers, SHA-256 of the text."""

    def run(batches):
        for b in batches:
            at, ids = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy().astype("<u4", copy=False)
            hashed = [hashlib.sha256(ids[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(hashed), b.column(2)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = decoded.select("doc_id", "ids", F.sha2("text", 256).alias("decoded_sha256"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
