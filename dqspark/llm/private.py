"""Personal data by weak supervision.

Spans that look like personal data get votes from labelers: their pattern, a checksum or range, a gazetteer, the words
before them, their edges. Expectation maximisation over the counts of vote patterns estimates how reliable each labeler
is and how likely each pattern is right; a logistic classifier is trained on these and decides. Spans of the base rules
always stay; the method adds others.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import add_columns, fresh, replace_columns, sliced

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider patterns: written-out addresses, numbers without a plus sign, addresses of eight groups.
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
_LOCAL_PHONE = re.compile(r"(?<![0-9+A-Za-z.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])00[1-9][0-9]{0,2}(?:[ -]?[0-9]{2,5}){3,5}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_TOP = frozenset("at au be br ca ch cn com de dk edu es eu fi fr gov ie in info int io it jp mil mx net nl no nz org pl pt ru se uk us".split())
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel|kontakt|reach)\b", re.IGNORECASE),
    "ip": re.compile(r"\b(?:ip|host|server|address|adresse|login)\b", re.IGNORECASE),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b", re.IGNORECASE),
    "phone": re.compile(r"\b(?:call|cell|fax|mobile|phone|tel|telefon|telefono|téléphone|teléfono|whatsapp)\b", re.IGNORECASE),
}
_AGAINST = re.compile(r"\b(?:build|chapter|figure|id|isbn|issn|order|page|release|revision|section|sku|token|v|version)\b[\s.:#=\"-]*$", re.IGNORECASE)
_ANY = re.compile(r"[0-9@]")
LABELERS = ("pattern", "check", "gazetteer", "context", "edges")


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _digits(span: str) -> str:
    return re.sub(r"[^0-9]", "", span)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, ordered; leftmost, non-overlapping within a kind."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(digits := _digits(m[0])) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _wider(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base rules that touch none of their spans nor each other."""
    found = [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() <= 40 and 14 <= len(_digits(m[0])) <= 19]
    if ":" in text:
        found += [(m.start(), 1, m.end()) for m in _IPV6.finditer(text)]
    out, free = [], _free_of(base)
    for span in sorted(found):
        if free(span) and (not out or out[-1][2] <= span[0]):
            out.append(span)
    return out


def _free_of(taken: list[tuple[int, int, int]]) -> Callable[[tuple[int, int, int]], bool]:
    """Whether a span touches none of those taken: looked up among their unions, which are in order."""
    starts, ends = [], []
    for a, _, b in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(span: tuple[int, int, int]) -> bool:
        before = bisect_left(starts, span[2]) - 1
        return before < 0 or ends[before] <= span[0]

    return free


def _votes(text: str, kind: int, start: int, end: int, base: bool) -> str:
    """A vote of each labeler: + for, - against, 0 for neither."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits, name = _digits(span), KINDS[kind]
    if name == "email":
        check = all(0 < len(p) <= 63 and p[0] != "-" != p[-1] for p in re.split(r"@|\.", span)) if base else None
        listed = re.split(r"\.| |\]|\)", span)[-1].lower() in _TOP
    elif name == "ip":
        check = not re.match(r"0+\.|[0-9]\.[0-9]\.[0-9]\.[0-9]$", span)
        listed = None
    elif name == "card":
        check = _luhn(digits)
        listed = digits[0] in "23456"
    else:
        check = 10 <= len(digits) <= 15 and len(set(digits)) > 2
        listed = digits[0] != "0" if span[0] == "+" else None
    cue = True if _CUES[name].search(before) else False if _AGAINST.search(before) else None
    edges = not (before[-1:].isalnum() or text[end : end + 1].isalnum())
    return "".join("0" if v is None else "+" if v else "-" for v in (base, check, listed, cue, edges))


def candidates(text: str | None) -> list[tuple[int, int, int, bool, str]]:
    """(start, kind, end, of the base rules, votes) of a whole text, ordered."""
    if not text:
        return []
    base = base_spans(text) if _ANY.search(text) else []
    wide = _wider(text, base) if _ANY.search(text) else []
    if re.search(r"[ (\[]dot[ )\]]", text, re.IGNORECASE):
        free = _free_of(base + wide)
        wide += [span for m in _SPELT.finditer(text) if free(span := (m.start(), 0, m.end()))]
    return sorted([(a, k, b, True, _votes(text, k, a, b, True)) for a, k, b in base] + [(a, k, b, False, _votes(text, k, a, b, False)) for a, k, b in wide])


@dataclass
class Model:
    """Reliability of each labeler per kind and truth, and the classifier of a candidate's kind and votes."""

    reliability: dict[tuple[int, int], dict[str, tuple[float, float]]] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def probability(self, kind: int, votes: str) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-(_features(kind, votes) @ self.weights))))


def _features(kind: int, votes: str) -> np.ndarray:
    out = np.zeros(len(KINDS) + 2 * len(LABELERS))
    out[kind] = 1
    for n, v in enumerate(votes):
        if v != "0":
            out[len(KINDS) + 2 * n + (v == "-")] = 1
    return out


def fit_patterns(patterns: dict[tuple[int, str], int], rounds: int = 50) -> Model:
    """Expectation maximisation over (kind, votes) counts, then a logistic regression on its posteriors."""
    model = Model()
    if not patterns:
        return model
    truth = {p: (1 + sum(v == "+" for v in p[1])) / (2 + sum(v != "0" for v in p[1])) for p in patterns}
    for _ in range(rounds):
        prior = {}
        for kind in {k for k, _ in patterns}:
            own = {p: n for p, n in patterns.items() if p[0] == kind}
            right = sum(n * truth[p] for p, n in own.items())
            prior[kind] = (right + 1) / (sum(own.values()) + 2)
            for labeler in range(len(LABELERS)):
                rates = {}
                for vote in "+-0":
                    voted = {p: n for p, n in own.items() if p[1][labeler] == vote}
                    of_right = sum(n * truth[p] for p, n in voted.items())
                    of_wrong = sum(n * (1 - truth[p]) for p, n in voted.items())
                    # Pseudo-votes keep a labeler on its side where a kind has few candidates or none of one side.
                    better, worse = {"+": (8, 2), "-": (2, 8), "0": (5, 5)}[vote]
                    rates[vote] = ((of_right + better) / (right + 15), (of_wrong + worse) / (sum(own.values()) - right + 15))
                model.reliability[kind, labeler] = rates
        for kind, votes in patterns:
            odds = np.log(prior[kind] / (1 - prior[kind])) + sum(np.log(a / b) for n, v in enumerate(votes) for a, b in [model.reliability[kind, n][v]])
            truth[kind, votes] = float(1 / (1 + np.exp(-odds)))
    rows, target = np.array([_features(*p) for p in patterns]), np.array([truth[p] for p in patterns])
    weight = np.sqrt(np.array(list(patterns.values()), float))
    weight /= weight.sum()
    w = np.zeros(rows.shape[1])
    for _ in range(100):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-(rows @ w)))
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(curve, rows.T @ (weight * (target - p)) - 1e-3 * w)
    model.weights = w
    return model


def fit(docs: DataFrame) -> Model:
    """A model from the candidates of all texts. What reaches the driver is one count per kind and vote pattern."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in sliced(stream):
            for text in batch.column(0).to_pylist():
                total.update((k, votes) for _, k, _, _, votes in candidates(text))
        keys = list(total)
        columns = [pa.array([k for k, _ in keys], pa.int32()), pa.array([v for _, v in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "votes", "n"])

    counted = docs.select("text").mapInArrow(batches, "kind int, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    return fit_patterns({(r["kind"], r["votes"]): r["n"] for r in sorted(counted.collect())})


def accepted(text: str | None, model: Model, threshold: float = 0.8) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, of the base rules) of the spans that stay, ordered."""
    return [(a, k, b, base) for a, k, b, base, votes in candidates(text) if base or model.probability(k, votes) >= threshold]


def _joined(spans: list[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def personal_data(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, counts and digest of the base spans, all spans. A null text is empty and has
    none; ids and repeated rows stay as they are. Positions are code points."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kinds = [(n, T.LongType()) for n in names[:4]] + [(n, T.StringType()) for n in names[4:]]

    def compute(texts):
        spans = [accepted(t, shared.value, threshold) for t in texts.to_pylist()]
        base = [[s for s in x if s[3]] for x in spans]
        counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
        digests = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
        return [*counts, pa.array(digests, pa.string()), pa.array([_joined(x) for x in spans], pa.string())]

    return add_columns(docs.select("doc_id", "text"), ["text"], kinds, compute, drop=("text",))


def _masked(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    if not spans:
        return text
    out, last = [], 0
    for a, k, b, _ in spans:
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets and n_chars renewed; texts without spans stay as
    they are, and so does a null. Spans that overlap become one, named after the first."""
    shared, name = docs.sparkSession.sparkContext.broadcast(fit(docs)), fresh(docs, "masked")

    def compute(texts):
        made = []
        for text in texts.to_pylist():
            spans = accepted(text, shared.value, threshold)
            made.append(_masked(text, spans) if spans else None)
        return [pa.array(made, pa.string())]

    masked = add_columns(docs, ["text"], [(name, T.StringType())], compute)
    changed = {"text": F.coalesce(F.col(name), F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length(name))
    return replace_columns(masked, docs, changed)
