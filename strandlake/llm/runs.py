"""Periodic runs of words, by the branching-tandem test over an enhanced suffix array.

A run is a maximal stretch of words with smallest period q. A square of period p that can't be shifted right (the words that follow its
halves differ) is a branching tandem repeat: its two suffixes lie p words apart, in two different children of an LCP interval of depth
p. So for every LCP interval the suffixes of all children but the largest look up whether ISA[i + depth] and ISA[i - depth] lie in the
interval and outside their own child; what is found is rotated left as far as words stay equal, and squares that end up with the same
bounds are one run, of the smallest period among them. Intervals are bounds in the arrays; no tree is built.

Everything runs in numpy over the words of a few documents at once (a very long one is alone). Words that can't be in a run (a run
repeats each of its short word sequences within the document) are left out before sorting; this is exact, see GRAM in gram_width().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import _BYTE, SPACE, _power_tables, buffers, chunks, mix

#: Least length in words, and least length in periods, of a run.
SHORTEST, EXPONENT = 6, 4
#: Bytes of text that are handled at once, and words in one suffix array, unless one document has more.
CHUNK_BYTES, ARRAY_WORDS = 1 << 20, 1 << 18

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def gram_width(shortest: int = SHORTEST, exponent: int = EXPONENT) -> int:
    """The longest w such that in a run of any period q every sequence of w words is found again q words before or after it."""
    least = lambda q: max(shortest, exponent * q)
    return max(1, min(least(q) - 2 * q + 1 for q in range(1, shortest + 1)))


def _doubled(s: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... items; the last ranks are all different. A rank is the place of the first of its equals.

    The last item of s must be unlike all others. Only suffixes that still have equals are sorted again.
    """
    m = len(s)
    order = np.argsort(s, kind="stable")
    new = np.ones(m, bool)
    new[1:] = s[order][1:] != s[order][:-1]
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    levels, width = [rank.astype(np.int32)], 1
    size = np.bincount(rank, minlength=m)
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        after = open_ + width
        key = rank[open_] * (m + 1) + np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, at = key[order], open_[order]
        old = rank[at]
        first = np.ones(len(at), bool)
        first[1:] = old[1:] != old[:-1]
        place = np.arange(len(at))
        place = old + place - np.maximum.accumulate(np.where(first, place, 0))
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, place, 0))
        levels.append(rank.astype(np.int32))
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = at[~alone]
        width *= 2
    return levels


def _minima(lcp: np.ndarray) -> list[np.ndarray]:
    """Minima of all windows of 1, 2, 4 ... entries."""
    out = [lcp]
    while (half := 1 << (len(out) - 1)) * 2 <= len(lcp):
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at, lb, rb: each index whose lcp is above 0, and the bounds of the LCP interval of that depth around it. lcp[0] is -1."""
    at = np.flatnonzero(lcp > 0)
    depth, m = lcp[at], len(lcp)
    left, right = at.copy(), at + 1  # lcp[left:right] is at least depth
    for k, low in reversed(list(enumerate(_minima(lcp)))):
        w = 1 << k
        go = (left >= w) & (low[np.maximum(left - w, 0)] >= depth)
        left[go] -= w
        go = (right + w <= m) & (low[np.minimum(right, len(low) - 1)] >= depth)
        right[go] += w
    return at, left - 1, right - 1


def runs_of(s: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> np.ndarray:
    """start, length, period of every run of s (numbers; the last one unlike all others), by start and length."""
    none = np.zeros((0, 3), np.int64)
    levels = _doubled(s)
    m, isa = len(s), levels[-1].astype(np.int64)
    sa = np.empty(m, np.int64)
    sa[isa] = np.arange(m)
    lcp = np.full(m, -1, np.int64)
    common = np.zeros(m - 1, np.int64)
    for k in range(len(levels) - 2, -1, -1):
        a, b = sa[:-1] + common, sa[1:] + common
        common += (levels[k][a] == levels[k][b]).astype(np.int64) << k
    lcp[1:] = common
    at, lb, rb = _intervals(lcp)
    if not len(at):
        return none
    # Children of an interval: between neighbouring indices of its own depth.
    order = np.argsort(lb * (m + 1) + rb, kind="stable")
    at, lb, rb = at[order], lb[order], rb[order]
    first = np.ones(len(at), bool)
    first[1:] = (lb[1:] != lb[:-1]) | (rb[1:] != rb[:-1])
    group = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    start = np.empty(len(at) + len(heads), np.int64)
    start[np.arange(len(at)) + group + 1] = at
    begin = heads + np.arange(len(heads))  # of each interval, the place of its first child
    start[begin] = lb[heads]
    owner = np.empty(len(start), np.int64)
    owner[np.arange(len(at)) + group + 1] = group
    owner[begin] = np.arange(len(heads))
    stop = np.append(start[1:], 0)
    stop[np.append(begin[1:], len(start)) - 1] = rb[heads] + 1
    size = stop - start
    largest = np.maximum.reduceat(size, begin)
    is_largest = size == largest[owner]
    place = np.where(is_largest, np.arange(len(size)), len(size))
    small = np.ones(len(size), bool)
    small[np.minimum.reduceat(place, begin)] = False
    found = []
    child = np.flatnonzero(small)
    ends = np.cumsum(size[child])
    low = 0
    while low < len(child):  # a few million suffixes at a time
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 22), "right")))
        c = child[low:high]
        n = size[c]
        at_ = np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        c = np.repeat(c, n)
        g = owner[c]
        x, depth = sa[at_], lcp[at[heads]][g]
        for other in (x + depth, x - depth):
            inside = (other >= 0) & (other < m)
            r = isa[np.clip(other, 0, m - 1)]
            hit = inside & (r >= lb[heads][g]) & (r <= rb[heads][g]) & ((r < start[c]) | (r >= stop[c]))
            found.append(np.stack([np.minimum(x, other)[hit], depth[hit]], 1))
        low = high
    square = np.unique(np.concatenate(found), axis=0) if found else none[:, :2]
    begin, period = square[:, 0].copy(), square[:, 1]
    end = begin + 2 * period
    for k in range(len(levels) - 2, -1, -1):
        w = 1 << k
        back = np.maximum(begin - w, 0)
        go = (begin >= w) & (levels[k][back] == levels[k][np.minimum(back + period, m - 1)])
        begin[go] -= w
    keep = end - begin >= np.maximum(shortest, exponent * period)
    begin, end, period = begin[keep], end[keep], period[keep]
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    return np.stack([begin, end - begin, period], 1)[first]


def _chunk_runs(words: np.ndarray, bounds: np.ndarray, shortest: int, exponent: int) -> np.ndarray:
    """row, start, length, period of all runs of rows whose words (hashes) lie between bounds."""
    w = gram_width(shortest, exponent)
    n = len(words)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    none = np.zeros((0, 4), np.int64)
    if n < shortest:
        return none
    grams = np.zeros(n - w + 1, np.uint64)
    for j in range(w):
        grams = mix(grams + words[j : n - w + 1 + j])
    whole = row[: n - w + 1] == row[w - 1 :]
    grams ^= mix(row[: n - w + 1].astype(np.uint64) + np.uint64(1))
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(n - w + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= whole
    # Stretches of words in repeated sequences; each is followed by an item of its own.
    held = np.zeros(n + 1, np.int64)
    held[:-w] += twice
    held[w:] -= twice
    held = np.cumsum(held)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    # Neighbouring rows do not share a stretch.
    cuts = bounds[1:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    inner = np.unique(inner[held[inner] & held[inner - 1]])
    first, last = np.sort(np.concatenate([first, inner])), np.sort(np.concatenate([last, inner]))
    long = last - first >= shortest
    first, last = first[long], last[long]
    out, i = [none], 0
    total = np.cumsum(last - first + 1)
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + ARRAY_WORDS, "right")))
        a, size = first[i:j], last[i:j] - first[i:j] + 1
        shift = np.cumsum(size) - size
        at = np.repeat(a - shift, size) + np.arange(size.sum())
        ends = shift + size - 1
        code = np.unique(words[np.minimum(at, n - 1)], return_inverse=True)[1].astype(np.int64)
        code[ends] = code.max() + 1 + np.arange(len(ends))
        r = runs_of(code, shortest, exponent)
        if len(r):
            place = at[r[:, 0]]
            out.append(np.column_stack([row[place], place - bounds[row[place]], r[:, 1:]]))
        i = j
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in the bytes, their hashes, and the first word of each row."""
    word = ~SPACE[data]
    edge = np.zeros(len(word) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(word), bool), np.ones(len(word), bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: int, row: np.ndarray) -> pa.Array:
    """One text per row: its words, joined by one space."""
    source = np.append(data, np.uint8(0x20))
    last = np.ones(len(starts), bool)
    last[:-1] = row[1:] != row[:-1]
    size = ends - starts + ~last
    total = np.cumsum(size)
    index = np.repeat(starts - (total - size), size) + np.arange(total[-1] if len(total) else 0)
    index[(total - 1)[~last]] = len(data)
    offsets = np.append(0, total)[np.searchsorted(row, np.arange(rows + 1))]
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(source[index])).cast(pa.string())


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed: the text
    without words that some run holds after its first period, the others joined by one space.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a maximal stretch of at least `shortest` words and `exponent` periods.
    Null and empty texts have no words, no runs and an empty collapsed text; a null doc_id stays null; each repeated row gives a row;
    other columns, of any name, are ignored; an empty table gives an empty result. exponent must be at least 2.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run has at least two periods and two words")

    def find(batches):
        for b in batches:
            data, offsets = buffers(b.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, hashes, bounds = _words(part, at)
                found = _chunk_runs(hashes, bounds, shortest, exponent)
                place = bounds[found[:, 0]] + found[:, 1]
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, place + found[:, 3], 1)
                np.add.at(cover, place + found[:, 2], -1)
                kept = np.cumsum(cover)[:-1] == 0
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                lists = np.searchsorted(found[:, 0], np.arange(j - i + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(lists), runs), _joined(part, starts[kept], ends[kept], j - i, row[kept])],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    asked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return asked.mapInArrow(find, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, in which every tenth text (by crc32 of doc_id) ends in a repeated passage.

    With h = crc32(decimal doc_id), g = floor(h / 10), n words: if h % 10 = 0 and n > 0, each word i >= a becomes word a + (i - a) % p,
    a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Texts of null doc_id stay as they are.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    # Each step binds its value once, as the variable of a transform over an array of one.
    bind = lambda value, then: F.transform(F.array(value), then)[0]

    def repeated(w, n, a, p):
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")

    g = F.floor(h / 10)
    text = bind(
        F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
        lambda w: F.when(F.size(w) == 0, "").otherwise(
            bind((g % F.size(w)).cast("int"), lambda a: bind((1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int"), lambda p: repeated(w, F.size(w), a, p)))
        ),
    )
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """found: what periodic_runs() gives. doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without one) with its
    exponent in thousandths, and SHA-256 of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") == 0, "").otherwise(F.concat(lines, F.lit("\n")))
    row = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * b.length) div (-b.period)")
    return row.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
