"""SentencePiece encoding and decoding over a relational lattice.

Encoding is looked up by word: no piece joins two words, so each distinct word (with the space marks before it) is segmented once.
Its substrings of bounded length are exploded and equi-joined to the piece table; the edges that remain, grouped by word, are its
lattice, which a fold by Spark's higher-order aggregate turns into one segmentation:

- fold "viterbi", for unigram models: the best sum of scores at every position, then back from the end.
- fold "merge", for BPE models, whose result is no best sum: edges in order of score (then leftmost), each applied if it joins exactly
  two present symbols. One pass is enough as every piece is reached by better ones (a test checks that of the vocabulary). Symbol
  bounds are the bits of one number.

Words are first cut between letters that stand together in no piece, which leaves far fewer distinct ones. Documents are coded by
word in compressed blocks (slices of the table). The most frequent words (a fixed number) go to every task; the others of a block fetch
their pieces by a join, and the block's documents are written out from both. Words of more than LONG characters, and those with several space marks
(pieces of equal score), take the same merges in a per-word Python helper.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.shared import drop, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 60
#: Words whose lattices one task folds, about.
WORDS_A_TASK = 20_000
#: So many words at most go to every task; the others reach blocks by a join.
FREQUENT = 200_000
#: Bytes of text (a block), and ids to decode, that a task handles at once.
SLICE_BYTES, DECODED_IDS = 4 << 20, 200_000
_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@dataclass(frozen=True)
class Pieces:
    """Ordinary pieces with ids and scores, the id of byte 0, of the unknown piece, and the kind of model."""

    ids: dict
    scores: dict
    first_byte: int | None
    unknown: int
    fold: str
    pairs: frozenset  # of letters that follow each other in some piece
    dummy_prefix: bool = True

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))


def load(model: str = MODEL, fold: str = "merge") -> Pieces:
    """Pieces of a SentencePiece model file; the file is read on the driver only."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    ids = {m.id_to_piece(i): i for i in plain}
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
        raise ValueError("pieces that go beyond a word can't be looked up by word")
    byte = [i for i in range(m.get_piece_size()) if m.is_byte(i)]
    pairs = frozenset(a + b for piece in ids for a, b in zip(piece, piece[1:], strict=False))
    return Pieces(ids, {p: m.get_score(i) for p, i in ids.items()}, min(byte) if byte else None, m.unk_id(), fold, pairs)


def cut(word: str, pairs: frozenset) -> list[str]:
    """A word in parts that no piece joins."""
    at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs), len(word)]
    return [word[a:b] for a, b in zip(at, at[1:], strict=False)]


def _one_pass(word: str, p: Pieces) -> list[int]:
    """What the fold gives for a word, to compare with merged()."""
    spans = [(i, j) for i in range(len(word)) for j in range(i + 2, min(len(word), i + p.longest) + 1) if word[i:j] in p.ids]
    bounds = set(range(len(word) + 1))
    for i, j in sorted(spans, key=lambda s: (-p.scores[word[s[0] : s[1]]], s[0])):
        if i in bounds and j in bounds and sum(x in bounds for x in range(i + 1, j)) == 1:
            bounds -= set(range(i + 1, j))
    at = sorted(bounds)
    return [x for a, b in zip(at, at[1:], strict=False) for x in ([p.ids[word[a:b]]] if word[a:b] in p.ids else _loose(p, word[a:b]))]


def units(text: str, prefix: bool = True) -> list[str]:
    """The words of a text, each with the space marks before it."""
    return _UNIT.findall((SPACE if prefix else "") + text.replace(" ", SPACE)) if text else []


def _loose(p: Pieces, char: str) -> list[int]:
    """Ids of a character that is no piece."""
    return [p.unknown] if p.first_byte is None else [p.first_byte + b for b in char.encode()]


def merged(word: str, p: Pieces) -> list[int]:
    """The merges of the fold for one long word, by a heap; time grows as n log n."""
    symbols, left, right = list(word), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i, j):
        if i >= 0 and j >= 0:
            both = symbols[i] + symbols[j]
            if both in p.ids:
                heapq.heappush(heap, (-p.scores[both], i, j, both))

    for i in range(len(word) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if right[i] != j or symbols[i] is None or symbols[j] is None or symbols[i] + symbols[j] != both:
            continue
        symbols[i], symbols[j] = both, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i], i), offer(i, right[i])
    return [x for s in symbols if s is not None for x in ([p.ids[s]] if s in p.ids else _loose(p, s))]


def _edges(words: DataFrame, p: Pieces, kept: str, singles: str = "true") -> DataFrame:
    """words: word. Adds edges: array of kept (SQL over start, size, rank, id, score), one of each substring that is a piece; those of one character only where singles (SQL over piece) holds, or first in the word."""
    spark = words.sparkSession
    place = {score: i for i, score in enumerate(sorted(set(p.scores.values()), reverse=True))}
    of = list(p.ids)
    # As large as the model's vocabulary, whatever the data: safe to broadcast.
    known = F.broadcast(spark.createDataFrame(pa.table({"of": of, "id": pa.array(p.ids.values(), pa.int64()), "rank": pa.array([place[p.scores[x]] for x in of], pa.int64()), "score": pa.array([p.scores[x] for x in of], pa.float64())})).withColumn("key", F.xxhash64("of")))
    starts = words.select("word", F.expr("explode(sequence(0, length(word) - 1))").alias("start"))
    spans = starts.select("word", "start", F.expr(f"explode(sequence(1, least({p.longest}, length(word) - start)))").alias("size"))
    # The first character always keeps a row, so that words of unknown characters stay.
    cut = spans.withColumn("piece", F.expr("substr(word, start + 1, size)")).where(f"size > 1 or start = 0 or {singles}")
    # Numbers join faster than strings; the strings are compared after.
    met = cut.withColumn("key", F.xxhash64("piece")).join(known, "key", "left").where("piece = of or size = 1")
    return met.select("word", F.expr(f"if(piece = of, {kept}, null)").alias("edge")).groupBy("word").agg(F.collect_list("edge").alias("edges"))


#: Ids of one character that no edge covers.
def _char_ids(p: Pieces, at) -> str:
    if p.first_byte is None:
        return f"array({p.unknown})"
    code = f"hex(encode(substr(word, {at} + 1, 1), 'UTF-8'))"
    return f"transform(sequence(1, length({code}), 2), h -> {p.first_byte} + cast(conv(substr({code}, h, 2), 16, 10) as int))"


#: An edge of the merge fold as one number, in order of merging: rank, start (6 bits), size (6), id (20).
_PACKED = "shiftleft(rank, 32) | shiftleft(cast(start as bigint), 26) | shiftleft(cast(size as bigint), 20) | id"
#: Characters below this code find their ids in an array instead of the lattice.
_NEAR = 1024


def _merge_fold(words: DataFrame, p: Pieces) -> DataFrame:
    if max(p.ids.values()) >= 1 << 20:
        raise ValueError("ids of more than 20 bits")
    start, size = "cast(shiftright(e, 26) & 63 as int)", "cast(shiftright(e, 20) & 63 as int)"
    bit = lambda x: f"shiftleft(1L, {x})"
    ends = f"({bit(start)} | {bit(f'{start} + {size}')})"
    span = f"(shiftleft(2L, {start} + {size}) - {bit(start)})"  # both ends and all between
    fold = f"aggregate(sort_array(edges), {bit('length(word) + 1')} - 1, (bounds, e) -> if(bit_count(bounds & {span}) = 3 and (bounds & {ends}) = {ends}, bounds & ~{span} | {ends}, bounds))"
    # What remains, from left to right: start, size, id.
    chosen = f"transform(filter(edges, e -> (bounds & {span}) = {ends}), e -> e & {(1 << 32) - 1}L)"
    near = "array(" + ",".join(str(p.ids[chr(c)]) if chr(c) in p.ids else "cast(null as int)" for c in range(_NEAR)) + ")"
    char = "ascii(substr(word, i + 1, 1))"
    alone = f"filter(sequence(1, length(word) - 1), i -> (bounds & shiftleft(3L, i)) = shiftleft(3L, i) and {char} < {_NEAR})"
    alone = f"transform({alone}, i -> shiftleft(cast(i as bigint), 26) | shiftleft(1L, 20) | {near}[{char}])"
    all_ = f"sort_array(if(size(chosen) = bit_count(bounds) - 1 or length(word) = 1, chosen, concat(chosen, array_compact({alone}))))"
    out = _edges(words, p, _PACKED, f"ascii(piece) >= {_NEAR}").withColumn("bounds", F.expr(fold)).withColumn("chosen", F.expr(chosen)).withColumn("chosen", F.expr(all_))
    plain = f"transform(chosen, e -> cast(e & {(1 << 20) - 1} as int))"
    of_start = f"map_from_entries(transform(chosen, e -> struct({start}, cast(e & {(1 << 20) - 1} as int))))"
    loose = f"flatten(transform(filter(sequence(0, length(word) - 1), i -> (bounds & {bit('i')}) <> 0), i -> if({of_start}[i] is null, {_char_ids(p, 'i')}, array({of_start}[i]))))"
    return out.select("word", F.expr(f"if(size(chosen) = bit_count(bounds) - 1, {plain}, {loose})").alias("ids"))


def _viterbi_fold(words: DataFrame, p: Pieces) -> DataFrame:
    """Unknown characters cost ten below the lowest score, as one symbol each."""
    worst = min(p.scores.values()) - 10
    every = f"array_sort(concat(edges, transform(filter(sequence(0, length(word) - 1), i -> not exists(edges, e -> e.start = i and e.stop = i + 1)), i -> struct(i as start, i + 1 as stop, -1 as id, {worst}D as score))))"
    start = "transform(sequence(0, length(word)), i -> struct(if(i = 0, 0D, cast('-Infinity' as double)) as score, -1 as back, -1 as id))"
    fold = f"aggregate(every, {start}, (best, e) -> transform(best, (x, i) -> if(i = e.stop and best[e.start].score + e.score > x.score, struct(best[e.start].score + e.score as score, e.start as back, e.id as id), x)))"
    back = "aggregate(sequence(1, length(word)), struct(length(word) as at, cast(array() as array<struct<start:int,id:int>>) as path), (s, i) -> if(s.at <= 0, s, struct(best[s.at].back as at, concat(array(struct(best[s.at].back as start, best[s.at].id as id)), s.path) as path)), s -> s.path)"
    out = _edges(words, p, "struct(start, start + size as stop, cast(id as int) as id, score)").withColumn("every", F.expr(every)).withColumn("best", F.expr(fold)).withColumn("path", F.expr(back))
    return out.select("word", F.expr(f"flatten(transform(path, s -> if(s.id < 0, {_char_ids(p, 's.start')}, array(s.id))))").alias("ids"))


def encode_words(words: DataFrame, p: Pieces) -> DataFrame:
    """words: distinct word. Returns word, ids."""
    if p.fold != "merge":
        return _viterbi_fold(words, p)
    short = f"length(word) <= {LONG} and not startswith(word, '{SPACE * 2}')"
    def long_words(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merged(w, p) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    # Dealt by word before the lattice, whose edges then need no shuffle; in as many tasks as its explosion needs, not as its words have bytes.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // WORDS_A_TASK))
    found = _merge_fold(words.where(short).select("word").repartition(tasks, "word"), p)
    return found.unionByName(words.where(f"not ({short})").select("word").mapInArrow(long_words, "word string, ids array<int>"))


class _Cutter:
    """cut() for many texts at once. Marks of spaces never follow a letter in a piece, so the words of units() part there too."""

    def __init__(self, p: Pieces):
        chars = sorted({c for pair in p.pairs for c in pair})
        self.kind = np.zeros(max(map(ord, chars), default=0) + 2, np.int16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for pair in p.pairs:
            self.joined[self.kind[ord(pair[0])], self.kind[ord(pair[1])]] = True
        self.prefix = p.dummy_prefix

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in order, and how many each text has."""
        marked = pc.replace_substring(texts, " ", SPACE)
        if self.prefix:
            marked = pc.if_else(pc.equal(marked, ""), marked, pc.binary_join_element_wise(SPACE, marked, ""))
        if not len(marked) or not pc.sum(pc.binary_length(marked)).as_py():
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        stop = np.cumsum(pc.binary_length(marked).to_numpy(), dtype=np.int32)
        data = "".join(marked.to_pylist())
        code = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        wide = np.ones(len(code), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            wide += code >= least
        after = np.cumsum(wide, dtype=np.int32)  # bytes up to each character's end
        kind = self.kind[np.minimum(code, len(self.kind) - 1)]
        ends = np.ones(len(code), bool)
        ends[:-1] = ~self.joined[kind[:-1], kind[1:]]
        ends[np.searchsorted(after, stop[stop > 0])] = True
        bounds = after[ends]
        parts = pa.StringArray.from_buffers(len(bounds), pa.py_buffer(np.append(0, bounds).astype(np.int32)), pa.py_buffer(data.encode()))
        return parts, np.diff(np.searchsorted(bounds, stop, "right"), prepend=0)


def _gather(first: np.ndarray, size: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs flat[first[c] : first[c] + size[c]] of all codes c, one after another."""
    n = size[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _runs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and size of each list, and the values of all."""
    size = lists.value_lengths().to_numpy().astype(np.int64)
    return np.cumsum(size) - size, size, lists.flatten().to_numpy().astype(np.int32)


def _frequent(counted: DataFrame) -> DataFrame:
    """Of word, n: the most frequent words, FREQUENT at most; ties that would go beyond are all left out."""
    bins = counted.where(f"length(word) <= {LONG}").groupBy(F.expr("cast(8 * log2(n) as int)").alias("bin")).count().collect()
    total, least = 0, None
    for r in sorted(bins, reverse=True):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["bin"]
    return counted.where(F.lit(False) if least is None else F.expr(f"length(word) <= {LONG} and cast(8 * log2(n) as int) >= {least}"))


def encode(docs: DataFrame, p: Pieces) -> DataFrame:
    """docs: doc_id (bigint), text. Returns doc_id, ids (array<int>), text_hash (xxhash64 of the text) for every row.

    Null and empty texts have no ids; text_hash of null is that of the empty text. Repeated rows each get a row, an empty table gives
    none. Texts are taken as they are (no normalisation), a space mark comes first. Other columns are ignored. docs is read three times
    and must come in the same order each time, as a stored table does; if it does not, the run fails.
    """
    # Texts go to Python in batches of bounded size, however long they are.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def words_of(batches):
        cutter = _Cutter(p)
        for b in batches:
            for part in slices(b, 0, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([cutter.parts(part.column(0))[0].unique()], ["word"])

    # n: in how many slices a word is; it only decides which words are sent to all tasks.
    counted = table(rows.select("text").mapInArrow(words_of, "word string").groupBy("word").agg(F.count("*").alias("n")), "words")
    found = table(encode_words(counted.select("word"), p), "word-pieces")
    top = found.join(_frequent(counted), "word").toArrow().sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    drop(counted)
    sent = docs.sparkSession.sparkContext.broadcast((top.column("word").combine_chunks(), *_runs(top.column("ids").combine_chunks())) if top.num_rows else (pa.array([], pa.string()), *[np.zeros(0, np.int64)] * 3))

    def coded(batches):
        """Blocks: number, rows, their parts as numbers (places among the frequent words, then among the block's other words), those words, parts of each text."""
        cutter, frequent = _Cutter(p), sent.value[0]
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                number += 1
                parts, counts = cutter.parts(part.column(1))
                met = parts.dictionary_encode()
                at = pc.fill_null(pc.index_in(met.dictionary, value_set=frequent), -1).to_numpy().astype(np.int64)
                rare = at < 0
                at[rare] = len(frequent) + np.arange(rare.sum())
                yield number, part, at[met.indices.to_numpy()].astype(np.uint32), met.dictionary.filter(pa.array(rare)), counts

    def rare_words(batches):
        for number, _, _, rare, _ in coded(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), number)), pa.array(np.arange(len(rare), dtype=np.int32)), rare], ["block", "place", "word"])

    def packed(batches):
        for number, part, codes, rare, counts in coded(batches):
            planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes()
            one = pa.table({"doc_id": part.column(0), "text_hash": part.column(2), "parts": pa.array(counts, pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(one.combine_chunks())
            cells = [sink.getvalue().to_pybytes(), pa.Codec("zstd").compress(planes, asbytes=True)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c], pa.binary()) for c in cells), pa.array([len(codes)], pa.int64()), pa.array([len(rare)], pa.int64())], ["block", "rows", "codes", "n", "rare"])

    # A rare word of a block is known by its place there, so that only numbers go back to the block.
    needed = rows.mapInArrow(rare_words, "block bigint, place int, word string").join(found.hint("shuffle_merge"), "word").select("block", "place", "ids")

    def write(key, texts, words):
        _, first, size, flat = sent.value
        order = np.argsort(words.column("place").to_numpy())
        own_first, own_size, own = _runs(words.column("ids").combine_chunks()) if words.num_rows else [np.zeros(0, np.int64)] * 3
        r = texts.to_pylist()
        if len(r) != 1 or r[0]["rare"] != len(order):
            raise ValueError("the documents came in another order when they were read again")
        r = r[0]
        t = pa.ipc.open_stream(r["rows"]).read_all()
        codes = np.frombuffer(pa.Codec("zstd").decompress(r["codes"], r["n"] * 4), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        sizes = np.concatenate([size, own_size[order]])
        ids = _gather(np.concatenate([first, own_first[order] + len(flat)]), sizes, np.concatenate([flat, own]).astype(np.int32), codes)
        upto = np.append(0, np.append(0, np.cumsum(sizes[codes]))[np.cumsum(t.column("parts").to_numpy())])
        return pa.table({"doc_id": t.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32())), "text_hash": t.column("text_hash")})

    sent_rows = rows.mapInArrow(packed, "block bigint, rows binary, codes binary, n bigint, rare bigint")
    return sent_rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(write, "doc_id bigint, ids array<int>, text_hash bigint")


def decode(encoded: DataFrame, p: Pieces) -> DataFrame:
    """encoded: ids and any columns. Adds text: pieces joined, bytes put together, space marks made spaces, the first one dropped. Null ids: empty text; ids that are no piece are left out."""
    names = [c for c in encoded.columns if c != "text"]
    of_id = {i: s.replace(SPACE, " ").encode() for s, i in p.ids.items()}
    if p.first_byte is not None:
        of_id |= {p.first_byte + b: bytes([b]) for b in range(256)}
    of_id[p.unknown] = " ⁇ ".encode()
    sent = encoded.sparkSession.sparkContext.broadcast([of_id.get(i, b"") for i in range(max(of_id) + 2)])  # the last: no piece
    drop = 1 if p.dummy_prefix else 0

    def run(batches):
        size = np.array([len(x) for x in sent.value], np.int64)
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(sent.value), np.uint8)
        for b in batches:
            lists = b.column(b.schema.get_field_index("ids"))
            total = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64)) // DECODED_IDS
            cuts = np.flatnonzero(np.diff(total)) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                part = b.slice(a, z - a)
                ids = part.column(part.schema.get_field_index("ids"))
                codes = pc.fill_null(ids.flatten(), -1).to_numpy().astype(np.int64)
                codes[(codes < 0) | (codes >= len(size))] = len(size) - 1
                upto = np.append(0, np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy().astype(np.int64)))
                upto = np.append(0, np.cumsum(size[codes]))[upto]
                data = _gather(first, size, flat, codes).tobytes()
                texts = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data))
                try:
                    texts.validate(full=True)
                    texts = pc.utf8_slice_codeunits(texts, drop)
                except pa.ArrowInvalid:  # ids that spell no valid text
                    texts = pa.array([data[i:j].decode("utf-8", "replace")[drop:] for i, j in zip(upto, upto[1:], strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), texts], [*names, "text"])

    return encoded.select(*names).mapInArrow(run, encoded.select(*names).schema.add("text", "string"))


def pieces_of(spark: SparkSession) -> Pieces:
    """The pieces of the model named by the session's llm.pieces.model, else of MODEL."""
    return load(spark.conf.get("llm.pieces.model", MODEL))
