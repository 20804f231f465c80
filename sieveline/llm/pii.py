"""Operator 3, personal data: weak supervision.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these spans stay whatever happens. Wider
candidates (obfuscated addresses, local phone shapes, IPv6, short or long card shapes) are judged by labelers of three
sorts: shapes (regex), cue words in four languages (a gazetteer compiled for this module) and neighbours (context). Each votes for,
against, or abstains. Expectation-maximisation estimates each labeler's reliability per kind from the counts of vote
patterns over the whole corpus, which gives each pattern a probability; with these as soft labels a logistic span
classifier is trained on features of the span and its surroundings. Its verdicts add spans to the base.

What the driver gathers are counts of (kind, votes, features), all of few values: a bounded table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def _is_ipv6(text: str) -> bool:
    import ipaddress

    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The base spans per kind. Leftmost non-overlapping matches of the patterns; those that fail their test are dropped.

    Each scan is linear: an address is sought from its @ outwards, not from every character before it."""
    emails, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            emails.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    ips = [m.span() for m in _IP.finditer(text) if _octets(m.group())]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


# ---- candidates beyond the base -----------------------------------------------------------------------------------

_WIDE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63}){1,4}")),
    (1, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")),  # also the compressed forms; checked
    (2, re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
)

#: The gazetteer: cue words by kind, in English, French, German and Spanish; compiled by hand from everyday use.
CUES = (
    (
        "email", "e-mail", "mail", "mailto", "contact", "write to", "reach", "inbox", "courriel", "adresse électronique", "contacter", "écrire à", "kontakt", "schreiben", "postfach",
        "correo", "correo electrónico", "escribir", "contacto", "buzón",
    ),
    (
        "ip", "ipv4", "ipv6", "host", "server", "address", "gateway", "router", "subnet", "dns", "ping", "client", "adresse", "serveur", "hôte", "passerelle", "routeur",
        "rechner", "netz", "netzwerk", "servidor", "dirección", "puerta de enlace", "red",
    ),
    (
        "card", "visa", "mastercard", "amex", "american express", "discover", "credit", "debit", "payment", "expires", "cvv", "carte", "carte bancaire", "crédit", "paiement",
        "karte", "kreditkarte", "kartennummer", "zahlung", "tarjeta", "crédito", "débito", "pago",
    ),
    (
        "phone", "tel", "telephone", "call", "dial", "fax", "mobile", "cell", "sms", "whatsapp", "hotline", "téléphone", "appeler", "portable", "télécopie",
        "telefon", "anrufen", "handy", "mobil", "rufnummer", "durchwahl", "teléfono", "llamar", "móvil", "celular",
    ),
)
_CUES = tuple(re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, c)) + r")(?!\w)", re.IGNORECASE) for c in CUES)

#: Characters around a span that cues and context may lie in.
AROUND = 40

LABELERS = ("shape", "checksum", "cue", "neighbours", "table", "variety")


def describe(text: str, kind: int, start: int, end: int, base: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of the labelers (1, -1, 0: abstain) and features (small whole numbers) of a span."""
    span, left, right = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = _DIGITS.sub("", span)
    n, seps, kinds = len(digits), len(re.findall(r"[ ().+/-]", span)), len(set(digits))
    cue = bool(_CUES[kind].search(left))
    glued = bool(left[-1:].isalnum() or left[-1:] in ("-", "/", ".") or right[:1].isalnum() or re.match(r"[-/.][0-9]", right))
    numbers = len(re.findall(r"[0-9]{2,}", left + " " + right))
    passes = luhn(digits) if kind == 2 else (8 <= n <= 15 if kind == 3 else (_octets(span) if kind == 1 and ":" not in span else True))
    shape = 1 if base else (-1 if kind == 2 and n < 13 else (1 if kind in (0, 1) else (1 if kind == 3 and n in (9, 10, 11) else 0)))
    votes = (
        shape,
        (1 if passes else -1) if kind in (2, 3) else 0,
        1 if cue else 0,
        -1 if glued else 1,
        -1 if numbers >= 4 else 0,
        -1 if n >= 6 and kinds <= 2 else (1 if kinds >= 4 else 0),
    )
    features = (min(n, 20) // 2, min(seps, 4), min(kinds, 6), int(passes), int(cue), int(glued), min(numbers, 4), int(span[0] == "+"), int("(" in span))
    return votes, features


def candidates(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of wider spans that overlap no base span of any kind, nor an earlier candidate."""
    taken = sorted(x for spans in base for x in spans)
    out: list[tuple[int, int, int]] = []
    has_digit = any(c in text for c in "0123456789")
    for kind, pattern in _WIDE:
        if kind == 0 and not ("(at" in text or "[at" in text or "( at" in text or "[ at" in text or "AT" in text) or kind and not has_digit:
            continue
        for m in pattern.finditer(text):
            if kind != 1 or _is_ipv6(m.group()):
                out.append((kind, m.start(), m.end()))
    if not out:
        return out
    out.sort(key=lambda x: (x[1], -x[2], x[0]))
    import bisect

    begins, furthest = [a for a, _ in taken], [0]
    for _, b in taken:  # the greatest end of the first spans
        furthest.append(max(furthest[-1], b))
    kept, end = [], 0
    for kind, s, e in out:
        if s >= end and furthest[bisect.bisect_left(begins, e)] <= s:
            kept.append((kind, s, e))
            end = e
    return kept


# ---- label model and classifier -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier per kind (bias last), and the labelers' estimated reliabilities for inspection."""

    weights: dict[int, list[float]] = field(default_factory=dict)
    reliability: dict[int, list[list[float]]] = field(default_factory=dict)
    threshold: float = 0.5

    def accepts(self, kind: int, features: tuple[int, ...]) -> bool:
        w = self.weights.get(kind)
        return w is not None and float(np.dot(w[:-1], _scaled(np.array(features, float))) + w[-1]) >= float(np.log(self.threshold / (1 - self.threshold)))


_SCALE = np.array([10.0, 4.0, 6.0, 1.0, 1.0, 1.0, 4.0, 1.0, 1.0])


def _scaled(f: np.ndarray) -> np.ndarray:
    return f / _SCALE


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Votes (patterns x labelers in -1, 0, 1) with counts -> P(real) of each pattern, and P(vote | class) of each
    labeler. Starts from the majority; smoothing keeps every probability inside (0, 1)."""
    p = np.clip(0.5 + 0.15 * votes.sum(axis=1), 0.05, 0.95)
    table_ = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        share = np.stack([counts * (1 - p), counts * p])
        prior = (share.sum(axis=1) + 1) / (counts.sum() + 2)
        for v in (-1, 0, 1):
            table_[:, :, v + 1] = (share @ (votes == v) + 0.5).T
        table_ /= table_.sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + sum(np.log(table_[k][:, votes[:, k] + 1]) for k in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            p = new
            break
        p = new
    return p, table_


def logistic(features: np.ndarray, target: np.ndarray, counts: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Soft-label logistic regression by Newton's method with a ridge penalty."""
    x = np.c_[_scaled(features), np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (counts * (target - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(counted: list[tuple[int, tuple[int, ...], tuple[int, ...], int]]) -> Model:
    """(kind, votes, features, count) rows -> the model. A kind without candidates gets no classifier and adds nothing."""
    weights, reliability = {}, {}
    for kind in sorted({r[0] for r in counted}):
        own = sorted(r for r in counted if r[0] == kind)
        votes, features = np.array([r[1] for r in own]), np.array([r[2] for r in own], dtype=float)
        counts = np.array([r[3] for r in own], dtype=float)
        p, told = expectation_maximisation(votes, counts)
        weights[kind] = logistic(features, p, counts).tolist()
        reliability[kind] = told.tolist()
    return Model(weights, reliability)


def fit(docs: DataFrame) -> Model:
    """Counts (kind, votes, features) of base spans and candidates in all texts; trains on the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                for kind, spans in enumerate(base):
                    for s, e in spans:
                        seen[(kind, *describe(text, kind, s, e, True))] += 1
                for kind, s, e in candidates(text, base):
                    seen[(kind, *describe(text, kind, s, e, False))] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([",".join(map(str, k[1])) for k in keys], pa.string()), pa.array([",".join(map(str, k[2])) for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())],
                names=["kind", "votes", "features", "n"],
            )

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind int, votes string, features string, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
    numbers = lambda s: tuple(map(int, s.split(",")))
    return train([(r["kind"], numbers(r["votes"]), numbers(r["features"]), r["n"]) for r in counts.collect()])


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans as (kind, start, end), by kind, then start."""
    base = base_spans(text)
    flat = [(k, s, e) for k, spans in enumerate(base) for s, e in spans]
    added = [(k, s, e) for k, s, e in candidates(text, base) if model.accepts(k, describe(text, k, s, e, False)[1])]
    return flat, sorted(flat + added) if added else flat


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per document: doc_id, counts of base spans, base_sha256, spans.

    A null text counts as empty and has no spans. Repeated rows give equal rows; an empty table gives none (and an untrained
    model, which adds nothing); other columns are not read. Nothing is shuffled but the counts of :func:`fit`."""
    import hashlib

    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, told = [[], [], [], []], [], []
            for value in batch.column(1):
                base, spans = all_spans(value.as_py() or "", model)
                of = Counter(k for k, _, _ in base)
                for k in range(4):
                    counts[k].append(of[k])
                digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
                told.append(_told(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(told, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, one mark."""
    out, at = [], 0
    for s, e, k in sorted((s, -e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, personal data in the text replaced, n_chars (where there is one) counted anew. Null and empty texts
    stay as they are; repeated rows give equal rows and count as often for the model; an empty table gives no rows and an
    untrained model; all other columns stay. Texts are taken whole, a thousand at a time, and never shuffled."""
    model = model or fit(docs)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                spans = all_spans(text, model)[1] if text else []
                texts.append(masked_text(text, spans) if spans else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = None
