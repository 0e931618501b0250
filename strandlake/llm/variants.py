"""Grouping of spelling variants by a trie over frequency vectors.

Words are arranged by their length and then by how often letters of successive groups occur in them. One inserted letter raises one count
by one, one deleted letter lowers one, one replaced letter does both (or nothing, within a group). So a search goes down the trie depth
first with a surplus and a deficit of one each to spend, and the words of the leaves that it reaches are verified.

On the cluster the trie is cut below its first levels: each cell (length and first counts) is one group of rows, in which a word stands
once as a member and once as a query for each cell that its budgets reach (every pair of cells is asked in one direction). So many
levels are used that no cell holds more than MEMBERS words; where words still can't be told apart, a cell's members are dealt to several parts,
and its queries go to each. A task reads the members of one part, builds the lower trie, and sends queries through it in batches: a
node is visited once for all queries that get there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import drop, table
from strandlake.llm.words import Words, buffers, chunks, mix

#: Words that a part of a cell holds, levels at which the trie may be cut, words at which a node is a leaf.
MEMBERS, LEVELS, LEAF = 20_000, (3, 8), 12
#: Groups of letters are code points modulo this; the order of levels (frequent letters first, the rest after them).
GROUPS, ORDER = 32, "eainrstoludmcpghbvfqkzyjxw"
#: Queries in a batch, and bytes of pairs that are verified at once.
BATCH, PAIR_BYTES = 20_000, 32 << 20
#: A word counts from so many code points and occurrences on; its form occurs at least so many times as often.
SHORTEST, LEAST, TIMES = 5, 3, 2

#: Bytes of text whose words are counted together, distinct words that a task holds, bytes of a word beyond which it is hashed alone.
CHUNK_BYTES, COUNTED, LONG = 4 << 20, 300_000, 48

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
_LEVELS = np.array([*(ord(c) % GROUPS for c in ORDER), *sorted(set(range(GROUPS)) - {ord(c) % GROUPS for c in ORDER})])


def words_of(docs: DataFrame, planted: int | None = None) -> DataFrame:
    """docs: doc_id, text. word, n: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, and how often they occur.

    planted: where crc32 of "doc_id:word" is divisible by this number, the code point at that crc32 modulo the length is deleted first (not
    where doc_id is null). Null and empty texts have no words; repeated rows count again; other columns are ignored. Tasks count their own
    words (told apart by 64-bit hashes within a chunk of text) and send each once per COUNTED distinct ones.
    """

    def count(batches):
        counts: dict[bytes, int] = {}
        for b in batches:
            ids = b.column(0).to_pylist()
            data, offsets = buffers(b.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                _counted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j], planted, counts)
                if len(counts) >= COUNTED:
                    yield _counts(counts)
                    counts.clear()
        yield _counts(counts)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _counted(data: np.ndarray, offsets: np.ndarray, ids: list, planted: int | None, counts: dict[bytes, int]) -> None:
    """Adds the words of rows between offsets to counts."""
    # Letters beyond ASCII are the byte C3 and one more.
    lead = data == 0xC3
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    w = Words(data, offsets, 0, len(offsets) - 1, letter=letter)
    if not len(w.starts):
        return
    size = w.ends - w.starts
    plain = np.ones(len(size), bool)
    raw = w.data.tobytes()
    if planted:
        known = np.array([i is not None for i in ids])
        begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        row = np.repeat(np.arange(len(ids)), np.diff(w.begin))
        h = _crc32(w.data, w.starts, size, begun[row])
        for k in np.flatnonzero((h % planted == 0) & known[row]).tolist():
            word = raw[w.starts[k] : w.ends[k]].decode()
            at = int(h[k]) % len(word)
            shorter = (word[:at] + word[at + 1 :]).encode()
            counts[shorter] = counts.get(shorter, 0) + 1
            plain[k] = False
    at = np.flatnonzero(plain)
    _, first, n = np.unique(w.hashes()[at], return_index=True, return_counts=True)
    at = at[first]
    for a, z, k in zip(w.starts[at].tolist(), w.ends[at].tolist(), n.tolist(), strict=True):
        word = raw[a:z]
        counts[word] = counts.get(word, 0) + k


def _crc32(data: np.ndarray, starts: np.ndarray, size: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, going on from what has begun; one byte of all words at a time, long words one by one."""
    state = ~begun
    open_ = np.flatnonzero(size <= LONG)
    for k in range(LONG):
        open_ = open_[size[open_] > k]
        if not len(open_):
            break
        s = state[open_]
        state[open_] = _CRC[(s ^ data[starts[open_] + k]) & 0xFF] ^ (s >> 8)
    out = ~state
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + size[k]].tobytes(), int(begun[k]))
    return out


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, filled up with 0, and their lengths."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(size.max(initial=0)) + 1), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, size


def vectors(words: list[bytes]) -> np.ndarray:
    """How often each group of letters occurs in each word (Latin-1 bytes), in the order of the trie's levels."""
    size = np.array([len(w) for w in words], np.int64)
    cell = np.repeat(np.arange(len(words)) * GROUPS, size) + np.frombuffer(b"".join(words), np.uint8) % GROUPS
    return np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS)[:, _LEVELS].astype(np.int32)


def _cell(length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number of each cell: length and first counts, hashed. Two cells with one number only share their rows."""
    h = mix(length.astype(np.uint64) + np.uint64(1))
    for k in range(counts.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + counts[:, k].astype(np.uint64) + np.uint64(1))
    return h.view(np.int64)


def _reached(length: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every way to spend the budgets within the first levels: which words can, and the cell that they reach."""
    levels = counts.shape[1]
    for up in (None, *range(levels)):
        for down in (None, *range(levels)):
            if up is not None and up == down:
                continue
            for longer in (-1, 0, 1):
                if (longer == 1 and down is not None) or (longer == -1 and up is not None) or (longer == 0 and up is None and down is None):
                    continue
                fits = np.ones(len(length), bool) if down is None else counts[:, down] > 0
                moved = counts[fits].copy()
                if up is not None:
                    moved[:, up] += 1
                if down is not None:
                    moved[:, down] -= 1
                yield np.flatnonzero(fits), _cell(length[fits] + longer, moved)


def _search(members: np.ndarray, queries: np.ndarray, longer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (member, query) that the search leads to. longer: by how many letters the query is longer than members (-1, 0, 1)."""
    # Budgets: what the member may have more in a level, and what it may have less.
    up, down = (longer <= 0).astype(np.int8), (longer >= 0).astype(np.int8)
    stack = [(0, np.arange(len(members)), np.arange(len(queries)), up, down)]
    while stack:
        level, m, q, up, down = stack.pop()
        while level < members.shape[1] and len(m) > LEAF and len(q):
            values = members[m, level]
            if (values != values[0]).any():
                break
            step = values[0] - queries[q, level]  # all members alike: the trie goes on without a branch
            keep = (step == 0) | ((step == 1) & (up > 0)) | ((step == -1) & (down > 0))
            q, up, down = q[keep], (up - (step == 1))[keep], (down - (step == -1))[keep]
            level += 1
        if not len(q):
            continue
        if level == members.shape[1] or len(m) <= LEAF:
            fits = np.clip(queries[q, level:][:, None, :] - members[m, level:][None, :, :], -2, 2) if level < members.shape[1] else np.zeros((len(q), len(m), 1), np.int64)
            good = (np.maximum(fits, 0).sum(2) <= down[:, None]) & (np.maximum(-fits, 0).sum(2) <= up[:, None])
            a, b = np.nonzero(good)
            yield m[b], q[a]
            continue
        order = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.diff(values[order])) + 1
        have = queries[q, level]
        for child in np.split(order, cuts):
            step = values[child[0]] - have
            keep = (step == 0) | ((step == 1) & (up > 0)) | ((step == -1) & (down > 0))
            if keep.any():
                stack.append((level + 1, m[child], q[keep], (up - (step == 1))[keep], (down - (step == -1))[keep]))


def near(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether the words of a and b differ by exactly one inserted, deleted or replaced code point. Rows of bytes, equally wide, ending in 0."""
    width = a.shape[1]
    swap = la < lb
    a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
    la, lb = np.maximum(la, lb), np.minimum(la, lb)
    place = np.arange(width)
    same = a == b
    replaced = (la == lb) & ((~same & (place < la[:, None])).sum(1) == 1)
    head = np.where(same, width, place).min(1)  # the first place that differs
    shifted = (a[:, 1:] == b[:, :-1]) | (place[:-1] >= lb[:, None])
    tail = np.where(shifted, -1, place[:-1]).max(1)  # the last place that differs after a deletion
    return replaced | ((la == lb + 1) & (tail < head))


def _pairs(members: list[bytes], queries: list[bytes], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (member, query) of near words. own: the queries are the members themselves, and each pair is given once."""
    codes, size = _codes(members + queries)
    counts = vectors(members + queries)
    k = len(members)
    for n in np.unique(size[:k]):  # a cell has one length, unless two cells share a number
        m = np.flatnonzero(size[:k] == n)
        q = np.flatnonzero(np.abs(size[k:] - n) <= (0 if own else 1))
        held: list = []
        amount, most = 0, max(1, PAIR_BYTES // codes.shape[1])
        for x, y in [*_search(counts[m], counts[k + q], size[k + q] - n), (None, None)]:
            if x is not None:
                x, y = m[x], q[y]
                if own:
                    x, y = x[x < y], y[x < y]
                held.append((x, y))
                amount += len(x)
            if held and (x is None or amount >= most):
                x, y = (np.concatenate(z) for z in zip(*held, strict=True))
                held, amount = [], 0
                for i in range(0, len(x), most):
                    u, v = x[i : i + most], k + y[i : i + most]
                    good = near(codes[u], size[u], codes[v], size[v])
                    yield u[good], v[good] - k


def _rows(batches, levels: int):
    """word, n in; cell, query (whether the word only asks there), word, n out."""
    for b in batches:
        words = [w.encode("latin-1") for w in b.column(0).to_pylist()]
        if not words:
            continue
        length, counts = np.array([len(w) for w in words], np.int64), vectors(words)[:, :levels]
        own = _cell(length, counts)
        places, cells, asks = [np.arange(len(words))], [own], [np.zeros(len(words), bool)]
        for at, cell in _reached(length, counts):
            one_way = own[at] < cell
            places.append(at[one_way])
            cells.append(cell[one_way])
            asks.append(np.ones(int(one_way.sum()), bool))
        place = pa.array(np.concatenate(places))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(asks)), b.column(0).take(place), b.column(1).take(place)], ["cell", "query", "word", "n"])


def _stream(batches):
    """(cell, part), query, word, n of sorted batches."""
    for b in batches:
        c = [x.to_pylist() for x in b.columns]
        yield from zip(zip(c[0], c[1], strict=True), c[2], c[3], c[4], strict=True)


def _found(batches):
    """Sorted rows of whole parts of cells in (members first, then queries); both directions of each near pair out."""
    held: list[pa.RecordBatch] = []

    def met(members, asked, own):
        (words, n), (others, other_n) = [(pa.array([w.decode("latin-1") for w in x[0]], pa.string()), pa.array(x[1], pa.int64())) for x in (members, asked)]
        for x, y in _pairs(members[0], asked[0], own):
            x, y = pa.array(x), pa.array(y)
            for w, o, k in ((words.take(x), others.take(y), other_n.take(y)), (others.take(y), words.take(x), n.take(x))):
                held.append(pa.RecordBatch.from_arrays([w, o, k], ["word", "other", "other_n"]))

    for _, rows in groupby(_stream(batches), key=lambda r: r[0]):
        members, asked = ([], []), ([], [])
        for _, query, word, n in rows:
            side = asked if query else members
            if not query or members[0]:  # cells without members have nothing to ask
                side[0].append(word.encode("latin-1"))
                side[1].append(n)
            if len(asked[0]) == BATCH:
                met(members, asked, False)
                asked = ([], [])
        if asked[0]:
            met(members, asked, False)
        if members[0]:
            met(members, members, True)
        if sum(b.num_rows for b in held) > 10_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(50_000)
            held.clear()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(50_000)


def _depth(words: DataFrame) -> tuple[int, int]:
    """At how many levels the trie is cut, and how many words the largest cell then holds."""
    low, high = LEVELS

    def count(batches):
        for b in batches:
            raw = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            if raw:
                length, counts = np.array([len(w) for w in raw], np.int64), vectors(raw)
                for k in range(low, high + 1):
                    cell, n = np.unique(_cell(length, counts[:, :k]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(n.astype(np.int64))], ["levels", "cell", "n"])

    sizes = words.select("word").mapInArrow(count, "levels int, cell bigint, n bigint").groupBy("levels", "cell").agg(F.sum("n").alias("n"))
    largest = {r.levels: r.n for r in sizes.groupBy("levels").agg(F.max("n").alias("n")).collect()}  # one row per level
    fit = [k for k in range(low, high + 1) if largest.get(k, 0) <= MEMBERS]
    k = fit[0] if fit else high
    return k, largest.get(k, 0)


def near_words(words: DataFrame) -> DataFrame:
    """words: word, n (distinct words of letters up to U+00FF). word, other, other_n: each ordered pair of words that differ by exactly one
    inserted, deleted or replaced code point."""
    levels, largest = _depth(words)
    rows = words.select("word", "n").mapInArrow(lambda batches: _rows(batches, levels), "cell bigint, query boolean, word string, n bigint")
    if largest <= MEMBERS:
        dealt = rows.select("cell", F.lit(0).alias("part"), "query", "word", "n")
    else:  # members of a large cell are dealt out; a member asks the parts after its own, a query asks all
        rows = table(rows, "cells")
        parts = rows.where("not query").groupBy("cell").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")).where("parts > 1")
        own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        all_ = rows.join(parts, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
        first = F.when(F.col("query"), F.lit(0)).otherwise(F.col("own"))
        asked = all_.withColumn("part", F.explode(F.sequence(first, F.col("parts") - 1)))
        dealt = asked.select("cell", "part", (F.col("query") | (F.col("part") != F.col("own"))).alias("query"), "word", "n")
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "query").mapInArrow(_found, "word string, other string, other_n bigint")


def variant_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words: word, n. Adds form, root, n_near and form_n.

    n_near counts near words (0 if none). form is the near word of largest n (ties: the smallest in code-point order) if that n is at least
    `times` times the word's own, else null, and form_n its n. root is where following forms ends: the word itself without a form. The n of
    forms grows at each step, so chains are short and end; they are followed by doubling. Null words are left out; words must be distinct.
    """
    words = table(words.where("word is not null").select("word", F.col("n").cast("bigint").alias("n")), "words")
    near_ = near_words(words).groupBy("word", "other_n").agg(F.count("*").alias("k"), F.min("other").alias("other"))
    best = near_.groupBy("word").agg(F.sum("k").alias("n_near"), F.max_by("other", "other_n").alias("other"), F.max("other_n").alias("form_n"))
    good = F.col("form_n") >= times * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("other")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    formed = table(formed, "forms")
    jump = table(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = jump.join(further, "root", "left")
        new = table(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(jump)
        jump = new.select("word", "root")
        jump._shared_path = new._shared_path
        if new.where("moved").isEmpty():
            break
    return formed.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
