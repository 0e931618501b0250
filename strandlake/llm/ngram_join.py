"""N-gram Jaccard join by a grouped prefix join.

Two documents link when the Jaccard similarity of their sets of k-word shingles is at least `similarity`.

1. Documents of one set form a class; only one text of each class goes on.
2. Shingles are counted over all classes: each slice of texts sends its distinct shingles, packed, to buckets by hash, and learns
   which of them occur elsewhere, and how often. That gives one order of shingles: rare before frequent, those of one class first.
3. A set of n shingles can only reach the similarity with another if both share one of their n - ceil(similarity * n) + 1 first
   shingles (the prefix). Shingles of one class need no posting, so most classes have none and are done. Of the others, those with the
   same prefix and size form one group, which posts its prefix once.
4. A group's home is the longest list of postings that it is in. Classes of one home and similar size form cells of bounded size. Cells
   meet by shingle, pairs of cells pass filters of size and position, and each is expanded to its classes once and verified as a whole: the
   overlaps of all its pairs of sets are counted together, so no pair of groups or classes is ever a row.

Verification compares whole sets, and every link is counted, whatever its component. No link is lost: every pair of documents either is
verified or cannot reach the similarity. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.components import components
from strandlake.llm.shared import drop, fresh, slices, table
from strandlake.llm.words import shingle_sets

#: Shingles that one bucket holds, at most about.
BUCKET_SHINGLES = 1 << 20
#: Bytes and rows of a slice of texts that is packed at once; a longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 60_000
#: In place of a row's number: the shingle is in several rows of the slice.
_SEVERAL = 0xFFFF
_LOW = 40


def _exact(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(1000)


def _digest(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profiles(texts: DataFrame, k: int) -> DataFrame:
    """Per row: size and digest of its set (null without words)."""

    def profile(batches):
        for b in batches:
            for s in slices(b, 2, SLICE_BYTES, SLICE_ROWS):
                size, digest = [], []
                for h in shingle_sets(s.column(2), k):
                    size.append(len(h))
                    digest.append(_digest(h) if len(h) else None)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(size, pa.int32()), pa.array(digest, pa.int64())], ["doc_id", "text_hash", "n", "digest"])

    return texts.select("doc_id", "text_hash", "text").mapInArrow(profile, "doc_id bigint, text_hash bigint, n int, digest bigint")


def _planes(sorted_low: np.ndarray) -> bytes:
    """Ascending 40-bit numbers as the byte planes of their differences, which the shuffle's compression shortens."""
    return np.diff(sorted_low, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(5, -1).T
    return np.cumsum(wide.view(np.uint64).ravel())


_PACKED = "bucket int, slice bigint, tokens binary, rows binary, counts binary, docs binary"


def _packed(chosen: DataFrame, k: int, buckets: int) -> DataFrame:
    """Per slice and bucket: its distinct shingles, the row of each, and counts of those of several rows. One more row per slice (of negative
    bucket) keeps digests and sizes of its rows, and the rows of shingles of several rows."""

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for s in slices(b, 1, SLICE_BYTES, SLICE_ROWS):
                kept = [(d, h) for d, h in zip(s.column(0).to_pylist(), shingle_sets(s.column(1), k), strict=True) if len(h) and _digest(h) == d]
                if not kept:
                    continue
                number += 1
                size = np.array([len(h) for _, h in kept], np.int64)
                token = np.concatenate([h for _, h in kept])
                token = (token >> np.uint64(_LOW)) % np.uint64(buckets) << np.uint64(_LOW) | token & np.uint64((1 << _LOW) - 1)
                order = np.argsort(token, kind="stable")
                token, row = token[order], np.repeat(np.arange(len(kept)), size)[order].astype(np.uint16)
                first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                count = np.diff(np.append(first, len(token))).astype(np.uint32)
                several = count > 1
                distinct, one = token[first], np.where(several, _SEVERAL, row[first]).astype(np.uint16)
                cuts = np.searchsorted(distinct, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(_LOW))
                full = np.flatnonzero(np.diff(cuts))
                spans = [(cuts[i], cuts[i + 1]) for i in full]
                low = distinct & np.uint64((1 << _LOW) - 1)
                docs = np.stack([np.array([d for d, _ in kept], np.int64), size])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*full, -1 - number % buckets], pa.int32()), pa.array([number] * (len(full) + 1), pa.int64()),
                        pa.array([*(_planes(low[a:z]) for a, z in spans), distinct[several].tobytes()], pa.binary()), pa.array([*(one[a:z].tobytes() for a, z in spans), row[np.repeat(several, count)].tobytes()], pa.binary()),
                        pa.array([*(count[a:z][several[a:z]].tobytes() for a, z in spans), count[several].tobytes()], pa.binary()), pa.array([*[None] * len(full), docs.tobytes()], pa.binary()),
                    ],
                    ["bucket", "slice", "tokens", "rows", "counts", "docs"],
                )

    return chosen.select("digest", "text").mapInArrow(pack, _PACKED)


_ANSWER = pa.schema([("slice", pa.int64()), ("tokens", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])


def _counted(key, rows):
    """Of a bucket's shingles those that occur twice or more, back to their slices with the number of classes that have them."""
    bucket = key[0].as_py()
    if bucket < 0:
        return rows.select(_ANSWER.names)
    low = [_unplaned(x.as_buffer()) for x in rows.column("tokens")]
    own = [np.frombuffer(x.as_buffer(), np.uint16) for x in rows.column("rows")]
    count = np.ones(sum(map(len, low)), np.int64)
    count[np.concatenate(own) == _SEVERAL] = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("counts")])
    _, at = np.unique(np.concatenate(low), return_inverse=True)
    total = np.bincount(at, count).astype(np.uint32)[at]
    out, a = {c: [] for c in _ANSWER.names}, 0
    for number, tokens, row in zip(rows.column("slice").to_pylist(), low, own, strict=True):
        of = total[a : a + len(tokens)]
        a += len(tokens)
        shared = of > 1
        if shared.any():
            for c, v in zip(_ANSWER.names, (number, (tokens[shared] | np.uint64(bucket) << np.uint64(_LOW)).tobytes(), row[shared].tobytes(), of[shared].tobytes(), None), strict=True):
                out[c].append(v)
    return pa.table(out, _ANSWER)


def _assembler(t: Fraction):
    def assemble(key, rows):
        """Of a slice's classes those whose prefixes hold shared shingles: how many shingles of their own come first, the shared ones in order, the group."""
        docs = rows.column("docs").is_valid()
        own, answers = rows.filter(docs).to_pylist()[0], rows.filter(pc.invert(docs)).to_pylist()
        digest, n = np.frombuffer(own["docs"], np.int64).reshape(2, -1)
        several, copies, many = np.frombuffer(own["tokens"], np.uint64), np.frombuffer(own["counts"], np.uint32).astype(np.int64), np.frombuffer(own["rows"], np.uint16)
        join = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in answers]) if answers else np.zeros(0, kind)
        token, row, total = join("tokens", np.uint64), join("rows", np.uint16), join("counts", np.uint32)
        spread = row == _SEVERAL
        at = np.searchsorted(several, token[spread])
        token = np.concatenate([token[~spread], np.repeat(token[spread], copies[at])])
        total = np.concatenate([total[~spread], np.repeat(total[spread], copies[at])])
        first = np.cumsum(copies) - copies
        ends = np.cumsum(copies[at])
        row = np.concatenate([row[~spread], many[np.repeat(first[at] - (ends - copies[at]), copies[at]) + np.arange(ends[-1] if len(ends) else 0)]])
        order = np.lexsort((token, total, row))
        token = token[order].view(np.int64)
        shared = np.bincount(row, minlength=len(n))
        alone = n - shared
        begin = np.cumsum(shared) - shared
        out = {"digest": [], "n": [], "alone": [], "grp": [], "tokens": []}
        for i in range(len(n)):
            prefix = int(n[i]) - math.ceil(t * int(n[i])) + 1 - int(alone[i])
            if prefix > 0:
                posted = token[begin[i] : begin[i] + prefix]
                group = int(digest[i]) if alone[i] else _digest(np.append(posted, n[i]))
                for c, v in zip(out, (int(digest[i]), int(n[i]), int(alone[i]), group, posted), strict=True):
                    out[c].append(v)
        return pa.table(out, pa.schema([("digest", pa.int64()), ("n", pa.int32()), ("alone", pa.int32()), ("grp", pa.int64()), ("tokens", pa.list_(pa.int64()))]))

    return assemble


def _prefixes(chosen: DataFrame, k: int, t: Fraction, shingles: int) -> DataFrame:
    """digest, n, alone, grp, tokens of the classes that share a shingle of their prefix with another."""
    packed = _packed(chosen, k, max(64, -(-shingles // BUCKET_SHINGLES)))
    answers = packed.groupBy("bucket").applyInArrow(_counted, "slice bigint, tokens binary, rows binary, counts binary, docs binary")
    return answers.groupBy("slice").applyInArrow(_assembler(t), "digest bigint, n int, alone int, grp bigint, tokens array<bigint>")


def _overlap(na: str, nb: str, t: Fraction) -> str:
    """SQL: the least overlap at which sets of sizes na and nb reach the similarity."""
    p, q = t.numerator, t.denominator
    return f"cast(ceil(({na} + {nb}) * {p}D / {p + q}D - 1e-9) as int)"


def _sets(chosen: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """digest, shingles of the classes in wanted."""

    def build(batches):
        for b in batches:
            for s in slices(b, 1, SLICE_BYTES, SLICE_ROWS):
                kept = {d: h.tobytes() for d, h in zip(s.column(0).to_pylist(), shingle_sets(s.column(1), k), strict=True) if _digest(h) == d}
                yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.int64()), pa.array(kept.values(), pa.binary())], ["digest", "shingles"])

    return chosen.join(wanted, "digest", "left_semi").select("digest", "text").mapInArrow(build, "digest bigint, shingles binary")


#: What is verified in one task, at most about: so many pairs of sets, or cells by their cost; blocks get half of it on average.
_PAIRS_A_BLOCK = 5000
#: Classes and shingles of a cell, at most about; a larger set is a cell of its own. A pair of cells costs one and so many shingles one more.
CELL_CLASSES, CELL_SHINGLES, _SHINGLES_A_PAIR = 512, 1 << 19, 1 << 10
#: Columns of a dense product at once, pairs of rows listed at once, and how many products cost as much as one listed pair.
_COLUMNS, _LISTED, _DENSE = 4096, 1 << 20, 200


def _blocked(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with their block. An a of many pairs is dealt by (a, salt) to several blocks: its pairs, counted before, in parts
    of a sixteenth of a block. A column cost, if there is one, says how many pairs one counts for."""
    part = max(1, _PAIRS_A_BLOCK // 16)
    cost = F.sum("cost") if "cost" in pairs.columns else F.count("*")
    blocks = max(24, -(-2 * int(pairs.agg(cost).first()[0] or 0) // _PAIRS_A_BLOCK))
    hot = table(pairs.groupBy("a").agg(cost.alias("c")).where(F.col("c") > part).select("a", F.ceil(F.col("c") / part).cast("bigint").alias("salts")), "salts")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1).cast("bigint")))
    return pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("a", salt), F.lit(blocks)).cast("int").alias("block"))


def _cell(rows: pa.Table) -> tuple:
    """Of a cell's sets: digests, sizes, all shingles in order with the row of each, the distinct ones with their first place and count."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
    size = np.array([len(x) for x in sets], np.int64)
    token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    distinct, first, count = np.unique(token[order], return_index=True, return_counts=True)
    return rows.column("digest").to_numpy(), size, row[order], distinct, first, count


def _places(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places first, first + 1, ... of each shingle, and the number of the shingle."""
    of = np.repeat(np.arange(len(first)), count)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(of)), of


def _shared(x: tuple, y: tuple) -> np.ndarray:
    """How many shingles each set of cell x shares with each set of cell y. Shingles of many rows are multiplied as columns, others list their pairs of rows."""
    (_, nx, rx, dx, fx, cx), (_, ny, ry, dy, fy, cy) = x, y
    out = np.zeros(len(nx) * len(ny), np.int64)
    _, ix, iy = np.intersect1d(dx, dy, assume_unique=True, return_indices=True)
    work = cx[ix] * cy[iy]
    dense = work * _DENSE >= len(out)
    for s in range(0, np.count_nonzero(dense), _COLUMNS):
        side = []
        for n, r, f, c, i in ((nx, rx, fx, cx, ix), (ny, ry, fy, cy, iy)):
            i = i[dense][s : s + _COLUMNS]
            place, of = _places(f[i], c[i])
            m = np.zeros((len(n), len(i)), np.float32)
            m[r[place], of] = 1
            side.append(m)
        out += (side[0] @ side[1].T).astype(np.int64).ravel()
    ix, iy, work = ix[~dense], iy[~dense], work[~dense]
    step = np.cumsum(work) // _LISTED
    for i, j in zip(*(np.split(v, np.flatnonzero(np.diff(step)) + 1) for v in (ix, iy)), strict=True):
        px, of = _places(fx[i], cx[i])
        py, at = _places(fy[j][of], cy[j][of])
        out += np.bincount(rx[px][at] * len(ny) + ry[py], minlength=len(out))
    return out.reshape(len(nx), len(ny))


def _forest(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Which of the links (u, v) suffice to connect all that they connect. In each round a component hooks onto a smaller one."""
    label, open_, kept = np.arange(nodes), np.arange(len(u)), []
    while True:
        ends = np.sort(np.stack([label[u[open_]], label[v[open_]]]), axis=0)
        apart = ends[0] < ends[1]
        open_, (low, high) = open_[apart], ends[:, apart]
        if not len(open_):
            return np.concatenate(kept) if kept else open_
        top, first = np.unique(high, return_index=True)
        kept.append(open_[first])
        to = np.arange(nodes)
        to[top] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _linked(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """All links of classes in the pairs (a, b) of cells. sets: cell, digest, shingles. Returns rows (a, null, c): class a has c links in one
    block of pairs, and rows (a, b, 0): links that connect whatever links connect. Pairs come in blocks, and every cell goes once to each
    block that needs it."""
    p, q = t.numerator, t.denominator
    blocked = _blocked(pairs)
    needed = blocked.select(F.col("block").alias("part"), F.explode(F.array("a", "b")).alias("cell")).distinct()
    sent = needed.join(sets, "cell").select("part", "cell", "digest", "shingles")

    def compare(key, asked, sets):
        sets = sets.sort_by("cell")
        cell = sets.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        of = {int(cell[i]): _cell(sets.slice(i, z - i)) for i, z in zip(cuts, cuts[1:], strict=False) if z > i}
        digests = np.concatenate([c[0] for c in of.values()])
        begin = dict(zip(of, np.cumsum([0, *(len(c[0]) for c in of.values())]), strict=False))
        count, edges = np.zeros(len(digests), np.int64), [np.zeros((2, 0), np.int64)]
        for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True):
            x, y = of[a], of[b]
            both = _shared(x, y)
            link = q * both >= p * (x[1][:, None] + y[1] - both)
            u, v = np.nonzero(np.triu(link, 1) if a == b else link)
            if not len(u):
                continue
            u, v = u + begin[a], v + begin[b]
            count += np.bincount(u, minlength=len(count)) + np.bincount(v, minlength=len(count))
            few = _forest(u, v, len(count))
            edges.append(np.stack([u[few], v[few]]))
        u, v = np.concatenate(edges, axis=1)
        few = _forest(u, v, len(count))
        ends = [np.concatenate([digests[count > 0], digests[u[few]]]), pa.concat_arrays([pa.nulls(np.count_nonzero(count), pa.int64()), pa.array(digests[v[few]], pa.int64())])]
        return pa.table([*ends, np.concatenate([count[count > 0], np.zeros(len(few), np.int64)])], ["a", "b", "c"])

    return blocked.groupBy("block").cogroup(sent.groupBy("part")).applyInArrow(compare, "a bigint, b bigint, c bigint")


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) of digests whose sets (digest, shingles) reach the similarity: every class is its own cell."""
    return _linked(pairs, sets.withColumn("cell", F.col("digest")), t).where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _cells(prefixes: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Cells of the classes (digest, cell), and pairs of cells (a, b, cost) that hold all pairs of classes that can reach the similarity, each once."""
    groups = table(prefixes.groupBy("grp").agg(F.min("n").alias("n"), F.min("alone").alias("alone"), F.count("*").alias("classes"), F.any_value("tokens").alias("tokens")), "groups")
    posted = groups.select("grp", "n", "alone", "classes", F.posexplode("tokens").alias("i", "token")).select("token", "grp", "n", "classes", F.expr("n - alone - i - 1").alias("behind"))
    shared = posted.groupBy("token").agg(F.sum("classes").alias("c")).where("c > 1")
    lists = table(posted.join(shared, "token"), "lists")
    # A group's home is the longest list that it is in; a band holds sizes that differ by less than the similarity lets them.
    band = F.floor(F.log(F.col("n")) / math.log(1 / t)) if t < 1 else F.col("n").cast("bigint")
    homes = lists.groupBy("grp").agg(F.max_by("token", F.struct("c", "token")).alias("home"), F.min("n").alias("n"), F.min("classes").alias("classes")).withColumn("band", band)
    homes = table(homes, "homes")
    salts = homes.groupBy("home", "band").agg(F.ceil(F.greatest(F.sum("classes") / CELL_CLASSES, F.sum(F.col("classes") * F.col("n")) / CELL_SHINGLES)).alias("salts"))
    home = homes.join(salts, ["home", "band"]).select("grp", "home", "band", "salts")
    cell = F.xxhash64("home", "band", F.pmod(F.xxhash64("digest"), F.col("salts")))
    members = table(prefixes.select("digest", "grp", "n").join(home, "grp").select("digest", "grp", "n", cell.alias("cell")), "members")
    sizes = members.groupBy("cell").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    # Cells meet by shingle. What is true of a pair of classes at the first shingle that they share is true of the bounds of their cells.
    placed = lists.join(members.select("grp", "cell").distinct(), "grp").groupBy("token", "cell").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("behind").alias("behind"))
    several = table(placed, "placed")
    side = lambda s: several.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "low", "high", "behind")])
    p, q = t.numerator, t.denominator
    fits = f"high_a * {q} >= low_b * {p} and high_b * {q} >= low_a * {p} and 1 + least(behind_a, behind_b) >= {_overlap('low_a', 'low_b', t)}"
    met = side("a").join(side("b"), "token").where("cell_a < cell_b").where(fits).select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b")).distinct()
    own = sizes.where("classes > 1").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    of = lambda s: sizes.select(F.col("cell").alias(s), F.col("shingles").alias(f"shingles_{s}"))
    cost = F.expr(f"1 + (shingles_a + shingles_b) div {_SHINGLES_A_PAIR}")
    pairs = table(met.unionByName(own).join(of("a"), "a").join(of("b"), "b").select("a", "b", cost.alias("cost")), "pairs")
    drop(groups), drop(lists), drop(homes), drop(several)
    return members, pairs


def _links(prefixes: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """All verified links of classes, as _linked() returns them: numbers of links, and the links that components need."""
    members, pairs = _cells(prefixes, t)
    links = table(_linked(pairs, sets.join(members.select("digest", "cell"), "digest"), t), "links")
    drop(members), drop(pairs)
    return links


def _classed(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n, component (a number, null without words), component_id, n_links."""
    t = _exact(similarity)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    profiles = table(_profiles(texts, k), "profiles")
    first = profiles.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("n").alias("n"))
    classes = table(first.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "n"), "classes")
    # The text of each class: that of its smallest doc_id, told from other texts of this doc_id by its hash.
    chosen = table(texts.join(classes.select(F.col("rep").alias("doc_id"), "text_hash", "digest"), ["doc_id", "text_hash"]).select("digest", "text"), "texts")
    prefixes = table(_prefixes(chosen, k, t, classes.agg(F.sum("n")).first()[0] or 0), "prefixes")
    sets = table(_sets(chosen, prefixes.select("digest"), k), "sets")
    drop(chosen)
    links = _links(prefixes, sets, t)
    found = components(links.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("digest", "component")
    degree = links.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("c").alias("n_links"))
    linked = found.join(classes.select("digest", "rep"), "digest")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    of = linked.join(least, "component").join(degree, "digest").select("digest", "component", "least", "n_links")
    named = classes.join(of, "digest", "left").select("digest", F.coalesce("component", "digest").alias("component"), F.coalesce("least", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = profiles.join(named, "digest", "left")
    return out.select("doc_id", "text_hash", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def jaccard_components(docs: DataFrame, k: int = 5, similarity: float = 0.75) -> DataFrame:
    """docs: doc_id (bigint), text. Returns doc_id, n_shingles, component_id, n_links for every row of docs.

    component_id is the smallest doc_id that links reach, n_links the number of all other classes that the row's class of equal sets
    links with (copies are of one class and have no links of their own). Null and empty texts have no shingles and their own doc_id as component;
    repeated rows each get a row, and rows of one doc_id with different texts are told apart. Rows of null doc_id take the component of their
    copies (null without any) and link nothing themselves. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    return _classed(docs, k, similarity).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", "n_links")


def near_duplicates_removed(docs: DataFrame, k: int = 5, similarity: float = 0.75) -> DataFrame:
    """docs without the near copies: of each component one row of the smallest doc_id stays. Columns as in docs.

    Rows of null doc_id and rows without words stay, each of them. An empty table gives an empty result.
    """
    found = _classed(docs, k, similarity).where("n > 0 and doc_id is not null")
    own, hashed = fresh(docs, "id"), fresh(docs, "hash")
    winners = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("w")).select(F.col("w.doc_id").alias(own), F.col("w.text_hash").alias(hashed))
    text = F.col("text").cast("string")
    wordless = F.col("doc_id").isNull() | ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.where(~wordless).withColumns({own: F.col("doc_id").cast("bigint"), hashed: F.xxhash64(text)}).join(winners, [own, hashed], "left_semi")
    return kept.dropDuplicates([own, hashed]).select(*docs.columns).unionByName(docs.where(wordless))
