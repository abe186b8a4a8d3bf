"""Personal data by weak supervision.

Base spans come from fixed patterns and always stay.  Beside them a looser pattern of
each kind proposes candidates (numbers without a plus, written-out addresses, odd
separators).  Every span, base or candidate, gets votes of ``LABELERS``: regex, shape,
gazetteer, context before it and context against it, each yes, no or silent.  How often
each pattern of votes occurs is counted over the whole corpus; there are at most
3 ** 5 x ``SHAPES`` patterns of a kind, so the counts are small whatever the input.  On
them, expectation-maximisation estimates each labeler's reliability without labels
(votes are independent given the truth, silence is no evidence), and a logistic regression on votes and shape,
trained on the resulting probabilities, is the span classifier.  Candidates that it
gives ``ACCEPT`` or more are added, unless they overlap a base span.

Texts are read once; spans, not texts, are settled in the shared folder.

Defined cases: a null text is an empty one, which has no spans; rows that repeat an id
are read each by their own text; an empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm import frames
from simforge.llm.words import slices, text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "shape", "gazetteer", "context", "counter")
SHAPES = 16
ACCEPT = 0.9
#: Weight of the prior, as a share of the votes, and the share of right votes it expects.
PRIOR = (0.2, 0.8)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its first digit only: no match can begin inside it.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63}){1,6}"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![\w+.,/=-])\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,4}){2,4}(?![\w/=])"),
}
# fixed values: public cues of personal data in the corpus's languages
_CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "appel", "llama"),
}
_COUNTER = ("version", "isbn", "issn", "order", "section", "figure", "page", "doi", "ref", "id", "no.", "$", "#")
_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "example")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "36", "38", "6")

_SPANS = "array<struct<kind:int,start:int,end:int,pattern:int>>"
_FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans {_SPANS}"
_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            out.append((start, floor))
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str, digits: bool = True) -> dict[str, list[tuple[int, int]]]:
    """The spans of the fixed patterns, by kind."""
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if digits:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            found = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(found) <= 19 and luhn(found):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def candidates(text: str, base: dict[str, list[tuple[int, int]]], digits: bool) -> list[tuple[int, int, int]]:
    """(kind, start, end) of loose matches that overlap no base span."""
    taken = sorted(s for spans in base.values() for s in spans)
    out = []
    for number, kind in enumerate(KINDS):
        if kind == "email":
            if not (("at" in text or "AT" in text) and ("[" in text or "(" in text)):
                continue
        elif not digits:
            continue
        for m in _LOOSE[kind].finditer(text):
            found = "".join(_DIGIT.findall(m.group()))
            if kind == "card" and not luhn(found) or kind == "phone" and not 7 <= len(found) <= 15:
                continue
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((number, *m.span()))
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[list[int], int]:
    """Each labeler's vote (1 yes, 0 no, 2 silent) and the shape of a span."""
    name, span = KINDS[kind], text[start:end]
    digits = "".join(_DIGIT.findall(span))
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 2]
    if name == "email":
        shape, known = int("." in span and len(span) <= 80), span.rsplit(".", 1)[-1].lower().strip(")] ") in _DOMAINS
        gazetteer = 1 if known else 2
    elif name == "ip":
        shape, gazetteer = int(len(digits) >= 4 and not before.endswith((".", "v"))), 0 if digits.startswith("0") else 2
    elif name == "card":
        shape, gazetteer = int(len(set(digits)) > 2), int(digits.startswith(_ISSUERS))
    else:
        shape, gazetteer = int(8 <= len(digits) <= 13 and len(set(digits)) > 2), 1 if digits.startswith(("1", "33", "34", "44", "49", "0")) else 2
    cue = 1 if any(c in before for c in _CUES[name]) else 2
    glued = bool(before[-1:].isalnum() or before[-1:] in ("_", "=", "/") or after[:1].isalnum())
    counter = 0 if glued or any(c in before[-12:] for c in _COUNTER) else 2
    code = min(3, len(digits) // 5) + 4 * min(3, len(re.findall(r"[^0-9A-Za-z]+", span)))
    return [1 if base else 2, shape, gazetteer, cue, counter], code


def _encode(found: list[int], shape: int) -> int:
    code = shape
    for v in found:
        code = code * 3 + v
    return code


def decode(pattern: int) -> tuple[list[int], int]:
    out = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1], pattern


def _has_digit(column: pa.Array) -> np.ndarray:
    data, at = text_bytes(column)
    seen = np.r_[0, np.cumsum((data >= 48) & (data <= 57), dtype=np.int64)]
    return seen[at[1:]] > seen[at[:-1]]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    spans_type = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "end", "pattern")]))
    for part in (x for batch in batches for x in slices(batch)):
        digit = _has_digit(part["text"])
        counts, digests, spans = [], [], []
        for i, value in enumerate(part["text"]):
            text = value.as_py() or ""
            base = base_spans(text, digit[i])
            counts.append([len(base[k]) for k in KINDS])
            digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k]).encode()).hexdigest())
            all_ = [(n, a, b, 0) for n, k in enumerate(KINDS) for a, b in base[k]] + [(*c, 1) for c in candidates(text, base, digit[i])]
            # a pattern's lowest bit tells a candidate from a base span
            spans.append([{"kind": n, "start": a, "end": b, "pattern": 2 * _encode(*votes(text, n, a, b, not loose)) + loose} for n, a, b, loose in all_])
        cols = [part["doc_id"], *(pa.array(x, pa.int64()) for x in zip(*counts)), pa.array(digests, pa.string()), pa.array(spans, spans_type)]
        yield pa.RecordBatch.from_arrays(cols, names)


def estimate(found: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(true) of each vote pattern, by expectation-maximisation over labeler reliabilities.

    Silence is no evidence. ``PRIOR`` holds the belief that labelers are rather right,
    without which the two classes could change their roles.
    """
    one_hot = np.eye(3)[found][:, :, :2]  # pattern, labeler, vote
    p = 1 / (1 + np.exp(-((found == 1).sum(1) - (found == 0).sum(1))))
    for _ in range(rounds):
        rates = []
        for truth, q in enumerate((1 - p, p)):
            mass = np.einsum("p,plv->lv", q * weight, one_hot)
            mass += PRIOR[0] * np.where(np.arange(2) == truth, PRIOR[1], 1 - PRIOR[1]) * (1 + mass.sum(1, keepdims=True))
            rates.append(np.log(mass / mass.sum(1, keepdims=True)))
        prior = ((p * weight).sum() + 1) / (weight.sum() + 2)
        no, yes = (np.einsum("plv,lv->p", one_hot, r) for r in rates)
        p = 1 / (1 + np.exp(np.clip(no + np.log(1 - prior) - yes - np.log(prior), -500, 500)))
    return p


def classifier(patterns: list[tuple[int, int]], counts: list[int]) -> set[tuple[int, int]]:
    """The (kind, pattern) of candidates that the trained span classifier accepts."""
    accepted = set()
    for kind in range(len(KINDS)):
        own = [(p, c) for (k, p), c in zip(patterns, counts) if k == kind]
        if not own:
            continue
        parts = [decode(p // 2) for p, _ in own]
        found, shape = np.array([x[0] for x in parts]), np.array([x[1] for x in parts])
        weight = np.array([c for _, c in own], float)
        target = estimate(found, weight)
        x = np.hstack([np.ones((len(own), 1)), np.eye(3)[found].reshape(len(own), -1), np.eye(SHAPES)[shape]])
        beta = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
            beta += np.linalg.solve(hessian, x.T @ (weight * (target - p)) - beta)
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        accepted |= {(kind, own[i][0]) for i in np.flatnonzero(p >= ACCEPT)}
    return accepted


def _finish(accepted: set[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch["spans"].to_pylist():
                kept = sorted((s["kind"], s["start"], s["end"]) for s in spans if not s["pattern"] % 2 or (s["kind"], s["pattern"]) in accepted)
                out.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in kept))
            names = [c for c in batch.schema.names if c != "spans"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out, pa.string())], [*names, "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    found = frames.settled(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find, _FOUND), "spans")
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern").count().collect()  # at most 4 * 2 * 16 * 3 ** 5
    seen.sort(key=lambda r: (r["kind"], r["pattern"]))
    accepted = classifier([(r["kind"], r["pattern"]) for r in seen], [r["count"] for r in seen])
    return found.mapInArrow(_finish(accepted), _RESULT)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(frames.documents(spark, sf_dir))
