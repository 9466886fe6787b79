"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans follow fixed patterns and always stay. Wider candidates (written-out e-mail
addresses, national phone numbers, shorter cards, IPv6) are judged: regex, checksum, gazetteer,
context and shape labelers vote for, against, or abstain; expectation-maximisation over the
counts of all vote patterns of the whole corpus estimates each labeler's reliability for each
kind; a logistic span classifier, trained on the posteriors of at most ``most`` candidates (a
documented bound, those below a threshold of a hash), gives the final verdict. A candidate that overlaps
a base span or a likelier accepted one is left out. Labelers that abstain count as missing.

Patterns are matched, and candidates held against base spans and each other, in time linear in the text but for
sorting and bisection. Offsets count code points, end exclusive.

Defined cases: a null or empty text has no spans; repeated rows are treated separately; a null
id is kept; a byte that isn't UTF-8 counts as one code point; with no candidates the classifier is neutral and adds nothing; an empty table gives
an empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, checkpoint
from .words import lean, pieces, strings

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL_BYTE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_BYTE:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        else:
            free = at + 1  # no later match can begin before this sign
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """By kind in the order of ``KINDS``, then by start."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [*_addresses(text), *_cards(text), *_phones(text)]
    return out


_WIDE = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}", re.I), re.compile(r"\(at\)|\[at\]|\{at\}|\x20dot\x20", re.I)),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,5}(?![\w-])"), _DIGIT),
    ("card", re.compile(r"(?<![\w-])[0-9]{4}[\x20-]?[0-9]{4,6}[\x20-]?[0-9]{4,5}(?:[\x20-]?[0-9]{1,4})?(?![\w-])"), _DIGIT),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"), _DIGIT),
]


def disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order; spans may nest or overlap."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def wide_spans(text: str, base: list[Span]) -> list[Span]:
    """Further candidates, none of which overlaps a base span; those of one kind don't overlap each other."""
    starts, ends = disjoint([(a, b) for _, a, b in base])
    out = []
    for kind, pattern, needed in _WIDE:
        if needed.search(text):
            for m in pattern.finditer(text):
                at = bisect_right(ends, m.start())
                if at == len(starts) or starts[at] >= m.end():
                    out.append((kind, m.start(), m.end()))
    return out


def chosen(kind: np.ndarray, start: np.ndarray, stop: np.ndarray, p: np.ndarray, threshold: float) -> np.ndarray:
    """Which candidates stay: likelier than the threshold, and apart from all that are likelier still and stay.

    Candidates of one kind don't overlap, so those that a candidate overlaps are a stretch of each other kind's.
    """
    kept = np.zeros(len(kind), dtype=bool)
    rows = {k: np.flatnonzero(kind == k) for k in np.unique(kind).tolist()}
    rows = {k: own[np.argsort(start[own], kind="stable")] for k, own in rows.items()}
    stretch = {k: (np.searchsorted(stop[own], start, side="right").tolist(), np.searchsorted(start[own], stop, side="left").tolist()) for k, own in rows.items()}
    held = {k: np.zeros(len(own), dtype=bool) for k, own in rows.items()}
    place = np.zeros(len(kind), dtype=np.int64)
    for own in rows.values():
        place[own] = np.arange(len(own))
    for i in np.argsort(-p, kind="stable").tolist():
        if p[i] <= threshold:
            break
        if not any(held[k][lo[i] : hi[i]].any() for k, (lo, hi) in stretch.items() if lo[i] < hi[i]):
            kept[i] = held[int(kind[i])][place[i]] = True
    return kept


# Fixed lists of the gazetteer and context labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us eu nl at ch be se no dk fi pl pt ie ca au nz jp cn in br mx ru example test".split())
COUNTRY_CODES = ("1", "7", "20", "27", "3", "4", "5", "6", "8", "9")
ISSUERS = ("34", "37", "30", "36", "38", "35", "4", "51", "52", "53", "54", "55", "2", "60", "62", "64", "65", "50", "56", "57", "58", "67")
CONTEXT_FOR = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo|courriel|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|tel\b|tel\.|call|fax|mobile|cell|telefon|t[eé]l[eé]phone|tel[eé]fono|whatsapp|contact", re.I),
}
CONTEXT_AGAINST = re.compile(r"version|order|invoice|isbn|issn|serial|build|part no|ref\.|doi|sku|ticket|item|page|figure|chapter|since|year", re.I)
LABELERS = ("regex", "checksum", "gazetteer", "context_for", "context_against", "shape")
ABSTAIN = 2


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """One vote for each labeler: 1 personal, 0 not, 2 abstains."""
    kind, a, b = span
    body, digits = text[a:b], _digits(text[a:b])
    before, near = text[max(0, a - 40) : a], text[max(0, a - 40) : b + 20]
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9]+", body.rstrip(".-"))[-1].lower()
        checksum, gazetteer = ABSTAIN, int(last in TOP_DOMAINS)
    elif kind == "ip":
        parts = [p for p in body.split(".") if p]
        checksum = int(":" in body or all(len(p) == 1 or p[0] != "0" for p in parts))
        gazetteer = 0 if digits in ("0000", "1111") or body.startswith(("0.", "127.")) else ABSTAIN
    elif kind == "card":
        checksum, gazetteer = int(luhn(digits) and 13 <= len(digits) <= 19), int(digits.startswith(ISSUERS))
    else:
        checksum = int(8 <= len(digits) <= 15)
        gazetteer = int(digits.startswith(COUNTRY_CODES)) if body.startswith("+") else (ABSTAIN if body.startswith(("0", "(")) else 0)
    joined = (a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_=/")) or (b < len(text) and (text[b].isalnum() or text[b] == "_"))
    return (1 if is_base else ABSTAIN, checksum, gazetteer, 1 if CONTEXT_FOR[kind].search(near) else ABSTAIN, 0 if CONTEXT_AGAINST.search(before) else ABSTAIN, 0 if joined else (1 if is_base else ABSTAIN))


@dataclass
class Reliability:
    """A share of positives, and for each labeler that votes the chance of each vote given the truth: [truth][labeler][vote].

    An abstention says nothing about the truth: its entry is 1.
    """

    prior: float = 0.5
    table: np.ndarray = field(default_factory=lambda: np.tile([0.5, 0.5, 1.0], (2, len(LABELERS), 1)))

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        at = np.arange(pattern.shape[1])
        log = [np.log(self.table[t][at, pattern]).sum(axis=1) for t in (0, 1)]
        odds = np.log(self.prior / (1 - self.prior)) + log[1] - log[0]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, strength: float = 2.0) -> Reliability:
    """EM for one kind from the counts of its vote patterns; starts from, and leans to, labelers that are right
    4 times in 5, and checksums that what is personal passes 49 times in 50."""
    start = np.zeros((2, len(LABELERS), 3))
    for k in range(len(LABELERS)):
        start[0, k], start[1, k] = ((0.7, 0.3, 1), (0.02, 0.98, 1)) if LABELERS[k] == "checksum" else ((0.8, 0.2, 1), (0.2, 0.8, 1))
    found = Reliability(0.5, start.copy())
    for _ in range(rounds):
        p = found.posterior(patterns)
        table = strength * start.copy()
        for t, w in ((0, counts * (1 - p)), (1, counts * p)):
            for k in range(len(LABELERS)):
                table[t, k] += np.bincount(patterns[:, k], weights=w, minlength=3)
        table /= table[:, :, :ABSTAIN].sum(axis=2, keepdims=True)
        table[:, :, ABSTAIN] = 1
        prior = float((counts @ p + strength) / (counts.sum() + 2 * strength))
        moved = np.abs(table - found.table).max()
        found = Reliability(prior, table)
        if moved < 1e-9:
            break
    return found


N_FEATURES = 1 + 4 + 2 * len(LABELERS) + 5


def span_features(kind: np.ndarray, patterns: np.ndarray, length: np.ndarray, n_digits: np.ndarray) -> np.ndarray:
    out = np.zeros((len(kind), N_FEATURES))
    out[:, 0] = 1
    out[np.arange(len(kind)), 1 + kind] = 1
    out[:, 5 : 5 + len(LABELERS)] = patterns == 1
    out[:, 5 + len(LABELERS) : 5 + 2 * len(LABELERS)] = patterns == 0
    share = n_digits / np.maximum(1, length)
    out[:, -5:] = np.column_stack([np.minimum(length, 60) / 30, np.minimum(n_digits, 20) / 10, share, n_digits >= 9, n_digits >= 13])
    return out


def fit_classifier(x: np.ndarray, p: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression on the posteriors, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (q - p) + ridge * beta)
        beta -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return beta


_SPAN = "array<struct<kind:int,start:long,stop:long,base:boolean,pattern:int,n_digits:int>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32()), ("n_digits", pa.int32())]))


def _code(pattern: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(pattern))


def _decode(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(len(LABELERS))], axis=1).astype(np.int64)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in pieces(batch.column(1), 1 << 20):
            out = []
            for text in strings(batch.column(1)[first:last]):
                base = base_spans(text or "")
                spans = [(s, True) for s in base] + ([(s, False) for s in wide_spans(text, base)] if text else [])
                out.append([{"kind": KINDS.index(s[0]), "start": s[1], "stop": s[2], "base": own, "pattern": _code(votes(text, s, own)), "n_digits": len(_digits(text[s[1] : s[2]]))} for s, own in spans])
            yield pa.record_batch([batch.column(0)[first:last], pa.array(out, _SPAN_ARROW)], names=["doc_id", "spans"])


def written(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def candidates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: base and wider candidates with the labelers' votes. No shuffle."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_candidates), f"doc_id long, spans {_SPAN}")


def train(found: DataFrame, *, most: int = 20_000) -> np.ndarray:
    """The span classifier's weights from the candidates of the whole corpus.

    What comes to the driver: the counts of at most 4 * 3^6 vote patterns, and at most ``most`` candidates.
    """
    spans = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    patterns = spans.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    models = {}
    for kind in {r.kind for r in patterns}:
        own = [r for r in patterns if r.kind == kind]
        models[kind] = estimate(_decode(np.array([r.pattern for r in own])), np.array([r.n for r in own], dtype=float))
    each = spans.select("doc_id", "kind", "start", "pattern", (F.col("stop") - F.col("start")).alias("length"), "n_digits")
    sample = sorted(bounded_sample(each, most, "doc_id", "kind", "start").select("kind", "pattern", "length", "n_digits").collect())
    if not sample:
        return np.zeros(N_FEATURES)
    kind, codes, length, n_digits = (np.array([getattr(r, c) for r in sample]) for c in ("kind", "pattern", "length", "n_digits"))
    decoded = _decode(codes)
    p = np.zeros(len(sample))
    for k, model in models.items():
        p[kind == k] = model.posterior(decoded[kind == k])
    return fit_classifier(span_features(kind, decoded, length, n_digits), p)


def spans(found: DataFrame, weights: np.ndarray, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans (arrays of kind:start:end)."""
    beta = np.asarray(weights)
    schema = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_spans", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_out, all_out = [], [], []
            for row in batch.column(1).to_pylist():
                base = [(KINDS[s["kind"]], s["start"], s["stop"]) for s in row if s["base"]]
                wide = [s for s in row if not s["base"]]
                kept: list[Span] = []
                if wide:
                    kind, codes, length, n_digits = (np.array(x) for x in zip(*((s["kind"], s["pattern"], s["stop"] - s["start"], s["n_digits"]) for s in wide), strict=True))
                    p = 1 / (1 + np.exp(-np.clip(span_features(kind, _decode(codes), length, n_digits) @ beta, -30, 30)))
                    start = np.array([s["start"] for s in wide])
                    kept = [(KINDS[wide[k]["kind"]], wide[k]["start"], wide[k]["stop"]) for k in np.flatnonzero(chosen(kind, start, start + length, p, threshold))]
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                base_out.append(written(base))
                all_out.append(written(base + kept))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.record_batch([batch.column(0), *columns, pa.array(base_out, pa.string()), pa.array(all_out, pa.string())], schema=schema)

    return found.mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> DataFrame:
    """The spans of every row of ``df``; each text is read once."""
    found = checkpoint(candidates(df, id_col=id_col, text_col=text_col))
    return spans(found, train(found, most=most))
