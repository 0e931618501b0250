"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Base spans (email, ip, card, phone) are what fixed patterns and checks find; they always stay. Candidates for further spans come from
looser patterns. Labelers vote on each candidate: patterns of form, gazetteers (endings of domains, cue words of each kind) and
context (the words before it). Votes and features are counted by pattern (at most 1024 a kind), and expectation-maximisation
on these counts estimates each labeler's reliability. Its posteriors train the final span classifier, a logistic regression on the
votes and on features of the span and its context, which is applied to every candidate as one SQL expression. Base spans of the same kinds
are candidates too while reliabilities are estimated; so what the fixed patterns find teaches what the looser ones should accept.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive quantifiers and starts that no earlier start could reach find the same matches as
#: the plain patterns, without deep recursion or repeated scans of long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns of candidates, by kind of the added span.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{2,63}){1,4}",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\(?0[0-9]{1,4}\)?|\([0-9]{3}\)|[0-9]{3}(?=[-.\x20]))[-.\x20/]?[0-9]{3,4}[-.\x20/]?[0-9]{3,5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{20,}+",
}
#: Cue words of each kind before a candidate.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|correo|courriel|kontakt)[^\n]{0,30}$",
    "phone": r"(?i)(?:phone|call|tel|tél|fax|mobile|telefon|whatsapp|sms)[^\n]{0,30}$",
    "ssn": r"(?i)(?:ssn|social|security|tax)[^\n]{0,30}$",
    "iban": r"(?i)(?:iban|account|konto|bank|cuenta|compte)[^\n]{0,30}$",
    "secret": r"(?i)(?:token|secret|passw|pwd|api|key|auth|bearer|credential)[^\n]{0,20}$",
}
#: Forms that speak for a candidate, and forms that speak against one.
FORMS = {
    "email": r"(?:com|net|org|edu|gov|info|io|de|fr|es|uk)$",
    "phone": r"^(?:\(|0)|[-./]",
    "ssn": r"^(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^(?:AD|AE|AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|HU|IE|IT|LU|NL|NO|PL|PT|SE)",
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|gh[pousr]|xox[a-z]|AKIA|AIza)[0-9A-Za-z_-]{16,})$",
}
#: Second forms: what the rest of a true span looks like.
RESTS = {
    "email": r"^[A-Za-z]",
    "phone": r"^(?!.*([0-9])\1{4})",
    "ssn": r"^(?!.*([0-9])\1{3})",
    "iban": r"[0-9]{4}",
    "secret": r"^(?!.*[A-Za-z]{9})",
}
AGAINST = r"(?i)(?:no\.|nr\.|id|version|page|item|isbn|order|#)\x20?$"
#: Accepted if the classifier's probability is above this; rounds of estimation; weight of the prior beliefs, in candidates.
ACCEPT, ROUNDS, BELIEF = 0.8, 50, 20.0
#: Labelers, with prior beliefs: how often each votes on true and on false candidates.
VOTERS = {"form": (0.9, 0.3), "cue": (0.5, 0.05), "against": (0.03, 0.3), "typed": (0.9, 0.5), "rest": (0.95, 0.6), "bounded": (0.9, 0.6)}
PRIOR = 0.2
#: What the classifier sees beside the votes: a long span, mostly digits, a quote or bracket before it, an assignment or colon before it.
FEATURES = ("long", "digits", "quoted", "assigned")
SPAN = "struct<kind:string,start:int,stop:int>"


def _located(text: Column, found: Column, pattern: str) -> Column:
    """found: all matches of pattern in text. Array of (start, stop, match), in code points."""
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(found, lambda hit, i: F.struct(F.element_at(gaps, i + 1).alias("gap"), hit.alias("hit")))

    def add(state, pair):
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        return F.struct(stop.alias("at"), F.array_append(state["spans"], F.struct(start.alias("start"), stop.alias("stop"), pair["hit"].alias("match"))).alias("spans"))

    empty = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    return F.when(F.size(found) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda s: s["spans"])).otherwise(empty)


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""

    def value(i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda match: _passes(kind, match)


#: A text without this cannot match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _with_base(texts: DataFrame) -> DataFrame:
    """Adds __base: array of (kind, start, stop), by kind, then start. texts: __text (not null) and any columns."""
    none = F.array().cast("array<string>")
    found = {k: F.when(F.contains("__text", F.lit(_NEEDS[k])) if k in _NEEDS else F.lit(True), F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(none) for k, p in BASE.items()}
    # Only matches that can pass need their places: texts without one are not split.
    out = texts.withColumns({f"__{k}": v for k, v in found.items()})
    out = out.withColumns({f"__{k}": F.when(F.exists(f"__{k}", _check(k)), F.col(f"__{k}")).otherwise(none) for k in KINDS})

    def kept(kind):
        spans = F.filter(_located(F.col("__text"), F.col(f"__{kind}"), BASE[kind]), lambda s: _passes(kind, s["match"]))
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    return out.withColumn("__base", F.concat(*map(kept, KINDS))).drop(*[f"__{k}" for k in KINDS])


def _said(kind: str, s: Column) -> list[Column]:
    """Votes and features of a span (start, stop, match) as 0 and 1."""
    text, match = F.col("__text"), s["match"]
    before = F.substr(text, F.greatest(s["start"] - 39, F.lit(1)), F.least(F.lit(40), s["start"]))
    after = F.substr(text, s["stop"] + 1, F.lit(1))
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    size = F.length(match)
    typed = {"email": size <= 100, "phone": digits.between(9, 13), "ssn": digits == 9, "iban": digits >= 12, "secret": digits * 5 >= size}[kind]
    said = {
        "form": match.rlike(FORMS[kind]), "cue": before.rlike(CUES[kind]), "against": before.rlike(AGAINST), "typed": typed, "rest": match.rlike(RESTS[kind]),
        "bounded": before.rlike(r"(?:^|[\s\"'(\[<{|:;,=])$") & after.rlike(r"^(?:$|[\s\"')\]>}|;,.!?])"),
        "long": size >= 30, "digits": digits * 2 >= size, "quoted": before.rlike(r"[\"'(\[<{]$"), "assigned": before.rlike(r"[:=]\s*[\"']?$"),
    }
    return [said[name].cast("int").alias(name) for name in (*VOTERS, *FEATURES)]


def _with_candidates(texts: DataFrame) -> DataFrame:
    """Adds __more: array of (kind, start, stop, votes, features) that touch no base span. texts: __text, __base and any columns."""
    out = texts.withColumns({f"__{k}": F.regexp_extract_all("__text", F.lit(p), F.lit(0)) for k, p in LOOSE.items()})

    def apart(s):
        return ~F.exists("__base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))

    def kept(kind):
        spans = F.filter(_located(F.col("__text"), F.col(f"__{kind}"), LOOSE[kind]), apart)
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), *_said(kind, s)))

    return out.withColumn("__more", F.concat(*map(kept, LOOSE))).drop(*[f"__{k}" for k in LOOSE])


def _base_candidates(kind: str) -> Column:
    """The base spans of a kind, with votes and features."""
    spans = F.transform(F.filter("__base", lambda b: b["kind"] == kind), lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"), F.substr(F.col("__text"), b["start"] + 1, b["stop"] - b["start"]).alias("match")))
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), *_said(kind, s)))


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """counts: (votes, candidates with them) of one kind. Posterior probability of each votes pattern, by expectation-maximisation under prior beliefs."""
    beliefs = list(VOTERS.values())
    prior, p1, p0 = PRIOR, [b[0] for b in beliefs], [b[1] for b in beliefs]
    posterior: list[float] = []
    for _ in range(ROUNDS):
        posterior = []
        for votes, _n in counts:
            a = prior * math.prod(p if v else 1 - p for v, p in zip(votes, p1, strict=True))
            b = (1 - prior) * math.prod(p if v else 1 - p for v, p in zip(votes, p0, strict=True))
            posterior.append(a / (a + b))
        yes = sum(q * n for q, (_, n) in zip(posterior, counts, strict=True))
        no = sum((1 - q) * n for q, (_, n) in zip(posterior, counts, strict=True))
        prior = min(0.95, max(0.001, (yes + PRIOR * BELIEF) / (yes + no + BELIEF)))
        for j, (b1, b0) in enumerate(beliefs):
            fired1 = sum(q * n for q, (v, n) in zip(posterior, counts, strict=True) if v[j])
            fired0 = sum((1 - q) * n for q, (v, n) in zip(posterior, counts, strict=True) if v[j])
            p1[j] = min(0.999, max(0.001, (fired1 + b1 * BELIEF) / (yes + BELIEF)))
            p0[j] = min(0.999, max(0.001, (fired0 + b0 * BELIEF) / (no + BELIEF)))
    return posterior


def _believed(votes: tuple[int, ...]) -> float:
    """How likely the prior beliefs find a pattern of votes."""
    of = lambda k: math.prod(b[k] if v else 1 - b[k] for v, b in zip(votes, VOTERS.values(), strict=True))
    return PRIOR * of(0) + (1 - PRIOR) * of(1)


def classifier(rows: list[tuple[tuple[int, ...], float]], targets: list[float], steps: int = 600) -> list[float]:
    """Weights (votes, features, then bias) of a logistic regression on counted patterns with soft targets."""
    width = len(VOTERS) + len(FEATURES)
    w = [0.0] * (width + 1)
    total = sum(n for _, n in rows) or 1
    for _ in range(steps):
        slope = [0.02 * x for x in w[:-1]] + [0.0]
        for (seen, n), q in zip(rows, targets, strict=True):
            z = w[-1] + sum(x for x, v in zip(w, seen, strict=False) if v)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q) * n / total
            for j, v in enumerate((*seen, 1)):
                slope[j] += miss * v
        w = [x - 1.0 * g for x, g in zip(w, slope, strict=True)]
    return w


def fit(docs: DataFrame) -> dict[str, list[float]]:
    """The span classifier of each kind, from the votes on all candidates of docs (text)."""
    texts = _with_candidates(_with_base(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))))
    every = F.concat("__more", *[_base_candidates(k) for k in KINDS if k in LOOSE])
    seen = texts.select(F.explode(every).alias("c")).select("c.*").groupBy("kind", *VOTERS, *FEATURES).agg(F.count("*").alias("n")).collect()
    out = {}
    for kind in LOOSE:
        rows = sorted((tuple(r[v] for v in (*VOTERS, *FEATURES)), r.n) for r in seen if r.kind == kind)
        if rows:
            votes = dict.fromkeys(itertools.product((0, 1), repeat=len(VOTERS)), 0)
            for pattern, n in rows:
                votes[pattern[: len(VOTERS)]] += n
            posterior = dict(zip(votes, reliabilities(list(votes.items())), strict=True))
            # Where all candidates are alike, the beliefs say what others would be: a few pseudo-candidates of every votes pattern.
            believed = [(v + (f,) * len(FEATURES), _believed(v) * BELIEF / 2) for v in votes for f in (0, 1)]
            out[kind] = classifier(rows + believed, [posterior[pattern[: len(VOTERS)]] for pattern, _ in rows + believed])
    return out


def _found(docs: DataFrame, names: list[str], model: dict[str, list[float]] | None) -> DataFrame:
    """row (the columns named, as one, so that no name can clash), __text, base, spans."""
    model = fit(docs) if model is None else model
    texts = _with_candidates(_with_base(docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))))
    logit = math.log(ACCEPT / (1 - ACCEPT))

    def accepted(s):
        said = F.lit(False)
        for kind, w in model.items():
            z = F.lit(w[-1])
            for x, v in zip(w, (*VOTERS, *FEATURES), strict=False):
                z = z + s[v] * F.lit(x)
            said = F.when(s["kind"] == kind, z > logit).otherwise(said)
        return said

    added = F.transform(F.filter("__more", accepted), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(dict.fromkeys([*KINDS, *LOOSE])) for x in (k, i)])
    keyed = F.array_sort(F.transform(F.concat("__base", added), lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    spans = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return texts.select("row", "__text", F.col("__base").alias("base"), F.when(F.size(added) > 0, spans).otherwise(F.col("__base")).alias("spans"))


def detect(docs: DataFrame, model: dict[str, list[float]] | None = None) -> DataFrame:
    """docs (text and any columns) with base and spans: arrays of (kind, start, stop), code points, stop exclusive.

    base: spans of the fixed patterns, by kind as listed, then start. spans: these and the added ones, likewise. Null and empty texts
    have none. Columns of docs named base or spans are replaced; any other names may occur. Repeated rows each get a row with the same
    spans; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    return _found(docs, names, model).select("row.*", "base", "spans")


def redacted(docs: DataFrame, model: dict[str, list[float]] | None = None) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets. Columns as in docs.

    Spans that overlap become one, named by the first (of equal starts: the shorter). Null texts stay null. An empty table gives an empty
    result; repeated rows stay; other columns, whatever their names, pass as they are.
    """
    found = _found(docs, docs.columns, model)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def put(state, s):
        fresh = s["start"] >= state["at"]
        kept = F.substr(F.col("__text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(state["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(state["out"]).alias("out"))

    text = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda s: F.concat(s["out"], F.substr(F.col("__text"), s["at"] + 1, F.length("__text"))))
    clean = F.when(F.size("spans") > 0, text).otherwise(F.col("row").getField("text"))
    return found.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
