"""Toxicity by weak supervision.

Voters are lexicons and patterns: words and word beginnings that training rows show to be far more frequent in toxic documents,
a short list of insults, and a few patterns of writing. A generative label model over the votes on training documents (voters fire
independently given the hidden class, but for groups of voters whose votes go together, which count as one) is fitted by
expectation-maximisation; the annotators' label is one more voter, of estimated reliability. Its posterior labels train a linear
classifier over counts and votes, which scores every document.

Fitting is bounded: at most FIT_ROWS labelled documents and MAX_VOTERS voters. Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import fresh
from strandlake.llm.words import NOT_LETTER, Words, buffers, chunks, word_hash

#: Insults that vote from the start.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: Kinds of voters: lengths in bytes of word beginnings (None: whole words), and how often a document must have one for a vote. Beginnings
#: gather the forms of a word, so that languages of few training rows have voters too.
KINDS = ((None, 1), (4, 1), (5, 1), (6, 1), (4, 2), (5, 2), (6, 2))
FIT_ROWS, MAX_VOTERS = 20_000, 256
TOXIC_AT = 0.7
_PATTERNS = 3
_SLOTS = 1 << 16


@dataclass
class Model:
    """Voter hashes by width, and the linear classifier over [votes, summaries]."""

    voters: list  # of (width index, sorted hashes, voter numbers)
    number: int
    weights: np.ndarray
    bias: float


def _hits(words: Words, width: int | None) -> np.ndarray:
    h = words.hashes(width)
    if width is not None:
        h = np.where(words.ends - words.starts >= width, h, np.uint64(0))
    return h


def _found(words: Words, voters: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows (from the chunk's first) and voters of all hits."""
    rows, found = [], []
    for k, hashes, numbers, slots in voters:
        h = _hits(words, KINDS[k][0])
        at = np.flatnonzero(slots[(h & np.uint64(_SLOTS - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
        hit = hashes[place] == h[at]
        at, place = at[hit], place[hit]
        rows.append(np.searchsorted(words.begin, at, "right") - 1)
        found.append(numbers[place])
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _features(texts: pa.Array, voters: list, number: int):
    """Of each chunk of rows: votes and summaries, one line per row."""
    need = np.ones(number, np.float32)
    for k, _, numbers, _ in voters:
        need[numbers] = KINDS[k][1]
    data, offsets = buffers(texts)
    for first, last in chunks(offsets):
        words = Words(data, offsets, first, last, NOT_LETTER)
        n = last - first
        hits = np.zeros((n, number), np.float32)
        rows, found = _found(words, voters)
        np.add.at(hits, (rows, found), 1)
        hits[hits < need] = 0
        size = np.diff(words.begin)
        raw = data[offsets[first] : offsets[last]]
        cuts = (offsets[first : last + 1] - offsets[first]).astype(np.int64)
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[cuts])
        length = np.maximum(1, np.diff(cuts))
        patterns = np.stack([count(raw == 0x21) / length > 0.01, count((raw >= 65) & (raw <= 90)) / length > 0.3, count(raw == 0x3F) / length > 0.01], 1)
        total = np.minimum(hits, 1).sum(1)
        summary = np.stack([np.log1p(hits.sum(1)), np.log1p(total), np.minimum(1, 20 * hits.sum(1) / np.maximum(1, size))], 1)
        yield np.concatenate([np.minimum(hits, 1), patterns, summary], 1).astype(np.float32)


def _tables(chosen: list[tuple[int, int]]) -> list:
    """chosen: (width index, hash) of each voter, by number."""
    out = []
    for k in range(len(KINDS)):
        own = sorted((np.int64(h).view(np.uint64), i) for i, (w, h) in enumerate(chosen) if w == k)
        if own:
            hashes = np.array([h for h, _ in own], np.uint64)
            slots = np.zeros(_SLOTS, bool)
            slots[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
            out.append((k, hashes, np.array([i for _, i in own]), slots))
    return out


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled documents, by a hash of doc_id; never those whose crc32(doc_id) mod 3 is 1."""
    order = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where("doc_id is not null and toxic is not null").where(order % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("toxic", "text")


def _mined(training: DataFrame) -> list[tuple[int, int]]:
    """Words and beginnings whose documents are toxic far beyond chance, most telling first."""

    def seen(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            toxic = b.column("toxic").to_numpy()
            keys, kinds, labels = [], [], []
            for first, last in chunks(offsets):
                words = Words(data, offsets, first, last, NOT_LETTER)
                for k, (width, need) in enumerate(KINDS):
                    h = _hits(words, width)
                    if width is None:
                        h = np.where(words.ends - words.starts >= 3, h, np.uint64(0))
                    for r in range(last - first):
                        u, n = np.unique(h[words.begin[r] : words.begin[r + 1]], return_counts=True)
                        u = u[n >= need]
                        keys.append(u)
                        kinds.append(np.full(len(u), k, np.int32))
                        labels.append(np.full(len(u), toxic[first + r], np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(labels))], ["kind", "hash", "toxic"])

    size = training.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = size.n, size.t or 0
    if not t or t == n:
        return []
    counted = training.mapInArrow(seen, "kind int, hash bigint, toxic int").where("hash <> 0").groupBy("kind", "hash").agg(F.sum("toxic").alias("a"), F.sum(F.expr("1 - toxic")).alias("b"))
    # Log-likelihood ratio of "toxic documents have it more often", at least what chance gives the best of that many.
    xlog = lambda x, e: f"(case when {x} > 0 then {x} * ln({x} / {e}) else 0 end)"
    share = t / n
    score = f"2 * ({xlog('a', f'((a + b) * {share}D)')} + {xlog('b', f'((a + b) * {1 - share}D)')})"
    best = counted.select("kind", "hash", "a", "b", F.expr(score).alias("g")).where(f"a * {n - t}D > 20 * b * {t}D and a >= 3 and g > 22")
    return [(r.kind, r.hash) for r in best.orderBy(F.desc("g"), "kind", "hash").limit(MAX_VOTERS - len(INSULTS)).collect()]


def _grouped(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """One over the number of voters that vote together with each, given the class."""
    residual = votes - np.where(posterior[:, None] > 0.5, (votes * posterior[:, None]).sum(0) / max(posterior.sum(), 1e-9), (votes * (1 - posterior)[:, None]).sum(0) / max((1 - posterior).sum(), 1e-9))
    scale = np.sqrt((residual**2).sum(0)) + 1e-9
    together = (residual.T @ residual) / np.outer(scale, scale) > 0.5
    np.fill_diagonal(together, True)
    return 1.0 / together.sum(1)


def label_model(votes: np.ndarray, noted: np.ndarray, rounds: int = 20) -> np.ndarray:
    """votes: 0/1 by document and voter; noted: the annotators' 0/1. Posterior probability of the toxic class by document.

    A voter that does not fire abstains: it says nothing of the class, as a lexicon of one language says nothing of texts in another.
    That none fires is a vote of its own, and the annotators' label speaks either way.
    """
    posterior = np.where(noted > 0, 0.95, 0.05).astype(np.float64)
    silent = votes.sum(1) == 0
    fired = np.concatenate([votes, silent[:, None], noted[:, None]], 1).astype(np.float64)
    for _ in range(rounds):
        weight = np.append(_grouped(votes, posterior), [1.0, 1.0])
        p1 = np.clip((fired.T @ posterior + 1) / (posterior.sum() + 2), 1e-3, 1 - 1e-3)
        p0 = np.clip((fired.T @ (1 - posterior) + 0.1) / ((1 - posterior).sum() + 2), 1e-4, 1 - 1e-3)
        prior = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
        logit = np.log(prior / (1 - prior)) + fired @ (weight * np.log(p1 / p0)) + (1 - noted) * np.log((1 - p1[-1]) / (1 - p0[-1]))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior


def _linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft targets, by Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    w = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-4
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - target) + ridge * w
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Voters, label model and classifier from the training rows of labels (doc_id, toxic). Without any toxic or any clean training row, every score is their share."""
    training = _training(docs, labels, rows)
    chosen = list(dict.fromkeys([*((0, word_hash(w)) for w in INSULTS), *_mined(training)]))
    voters, number = _tables(chosen), len(chosen)

    def lines(batches):
        for b in batches:
            toxic = b.column("toxic")
            got = [f for f in _features(b.column("text"), voters, number)]
            x = np.concatenate(got) if got else np.zeros((0, number + _PATTERNS + 3), np.float32)
            yield pa.RecordBatch.from_arrays([toxic.cast(pa.int32()), pa.array([line.tobytes() for line in x], pa.binary())], ["toxic", "x"])

    got = training.mapInArrow(lines, "toxic int, x binary").toPandas()
    width = number + _PATTERNS + 3
    if not len(got) or got["toxic"].nunique() < 2:
        share = (got["toxic"].sum() + 0.5) / (len(got) + 1.0)
        return Model(voters, number, np.zeros(width), float(np.log(share / (1 - share))))
    x = np.stack([np.frombuffer(bytes(v), np.float32) for v in got["x"]])
    noted = got["toxic"].to_numpy()
    order = np.lexsort((noted, *x.T))  # by all columns: sums then don't depend on the order in which rows came
    x, noted = x[order], noted[order]
    posterior = label_model(x[:, : number + _PATTERNS], noted)
    weights, bias = _linear(x, posterior)
    return Model(voters, number, weights, bias)


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (text and any columns) with the column score, 0 to 1; of docs' columns those in keep (default: all).

    Null and empty texts get a score too; repeated rows each get one; an empty table gives an empty result. A column named score is
    replaced; any other names may occur.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    # Plain values: executors need no class of this package.
    sent = docs.sparkSession.sparkContext.broadcast((model.voters, model.number, model.weights, model.bias))
    schema, text = docs.select(*keep).schema.add("score", "double"), fresh(docs, "scored_text")

    def score(batches):
        voters, number, weights, bias = sent.value
        for b in batches:
            got = [1 / (1 + np.exp(-np.clip(f @ weights + bias, -30, 30))) for f in _features(b.column(text), voters, number)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate(got) if got else np.zeros(0))], [*keep, "score"])

    return docs.select(*keep, F.col("text").cast("string").alias(text)).mapInArrow(score, schema)


def held_out():
    """Whether a document's labels are never learned from; null doc_id: they are not labelled."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
