"""Personal data: fixed patterns, and more spans by weak supervision.

Labelers vote on every candidate span: patterns, gazetteers (issuer and calling prefixes, domain endings), checksums and
context words. Expectation-maximisation over the counts of all vote patterns estimates how reliable each labeler is.
The labels that follow from it train the final span classifier, which decides on candidates beyond the fixed patterns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Linear, fit
from .spans import Span, digest, joined, overlaps, replaced

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. Lookbehind and possessive forms change no match: a run of digits that fails at its start fails
# further in as well.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# What every span or candidate holds one of: a digit, the sign, or a word for a sign as _SPELLED reads it.
_HINT = re.compile(r"[0-9@]|[Dd][Oo][Tt]|[Aa][Tt] ?[\])]")

# Candidates beyond them: digit groups, and addresses with words for the signs.
_DIGITS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]++(?:[ ().-]{1,2}[0-9]++)*(?![0-9A-Za-z])")
_GROUP = re.compile(r"[0-9]+")
FEWEST, MOST = 9, 19  # digits of a number
_SPELLED = re.compile(
    r"(?<![\w.])[\w.+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| at )[\w-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[\w-]{1,63}){1,4}",
    re.IGNORECASE)
_WORDED = re.compile(r"[Dd][Oo][Tt]|[Aa][Tt] ?[\])]")

# Gazetteers (fixed values).
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
_CUES = {
    "email": ("mail", "e-mail", "email", "correo", "courriel", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit", "iban", "account"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "telefono", "cell", "whatsapp"),
}
_GROUPED = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}")
LABELERS = 6
FEATURES = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield "email", start, match.end()
        # What lies before this sign cannot belong to a later match.
        last = match.end() if match else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed patterns, leftmost and not overlapping within a kind; failing matches are dropped."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def _worth(text: str, groups: list[tuple[int, int]]) -> int:
    """How well neighbouring groups read as one number: its digits, a checksum, and no sign of a cut inside."""
    sizes = [b - a for a, b in groups]
    gaps = [text[b:a] for (_, b), (a, _) in zip(groups, groups[1:], strict=False)]
    worth = 10 * sum(sizes)
    if len(groups) > 1 and max(sizes) >= FEWEST:  # a whole number by itself
        worth -= 40
    if " " in gaps and any("-" in gap or "." in gap for gap in gaps):
        worth -= 40 * gaps.count(" ")
    elif sum(sizes) >= 13 and luhn("".join(text[a:b] for a, b in groups)):
        worth += 30
    return worth - 40 * sum("(" in gap for gap in gaps)


def _numbers(text: str, groups: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(digits, start, end) of the numbers in a run of digit groups: the cut at its separators of the most worth."""
    best: list[tuple[int, int]] = [(0, 0)]  # worth of the groups so far, groups in the last number (0: none ends here)
    for end in range(1, len(groups) + 1):
        top, digits = (best[end - 1][0], 0), 0
        for first in range(end - 1, -1, -1):
            digits += groups[first][1] - groups[first][0]
            if digits > MOST:
                break
            if digits >= FEWEST:
                top = max(top, (best[first][0] + _worth(text, groups[first:end]), end - first))
        best.append(top)
    end, out = len(groups), []
    while end:
        size = best[end][1]
        if size:
            a, b = groups[end - size][0], groups[end - 1][1]
            out.append((sum(y - x for x, y in groups[end - size:end]), a - (text[a - 1:a] == "("), b))
        end -= size or 1
    yield from reversed(out)


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Further spans that look like personal data, none of them over a base span.

    A run of digit groups is one number if it can be. A longer one, one that only two numbers without a checksum can
    make up, and what a base span leaves of one are cut at their separators into numbers.
    """
    found: list[Span] = []
    for m in _DIGITS.finditer(text):
        n = sum(map(str.isdigit, m[0]))
        if n < FEWEST:
            continue
        taken = [s for s in base if overlaps(*m.span(), [s])]
        if not taken and (n < 2 * FEWEST or n <= MOST and luhn("".join(filter(str.isdigit, m[0])))):
            found.append(("card" if n >= 13 else "phone", *m.span()))
            continue
        free: list[list[tuple[int, int]]] = [[]]
        for g in _GROUP.finditer(text, *m.span()):
            if overlaps(*g.span(), taken):
                free.append([])
            else:
                free[-1].append(g.span())
        found += [("card" if k >= 13 else "phone", a, b) for part in free for k, a, b in _numbers(text, part)]
    if _WORDED.search(text):
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)
                  if re.search(r"dot|[\])]", m[0], re.IGNORECASE) and not overlaps(*m.span(), base)]
    return found


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """One vote each (1 for, -1 against, 0 abstain): pattern, grouping, gazetteer, checksum, context, surroundings."""
    kind, a, b = span
    body = text[a:b]
    digits = "".join(filter(str.isdigit, body))
    before = re.split(r"[^\w-]+", text[max(0, a - 40):a].lower())
    after = re.split(r"[^\w-]+", text[b:b + 20].lower())
    cue = any(w in _CUES[kind] for w in before + after)
    other = any(w in words for w in before for k, words in _CUES.items() if k != kind)
    gazetteer = {
        "email": body.lower().rsplit(".", 1)[-1].rsplit(" ", 1)[-1].strip("])") in _ENDINGS,
        "ip": not body.startswith("0"),
        "card": digits.startswith(_ISSUERS),
        "phone": body.startswith(("+", "(", "0")),
    }[kind]
    check = {"card": luhn(digits) if digits else False, "phone": len(set(digits)) > 3}.get(kind)
    clear = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    return (
        1 if is_base else 0,
        1 if _GROUPED.search(body) or kind == "email" else -1 if kind == "phone" else 0,
        1 if gazetteer else -1,
        0 if check is None else 1 if check else -1,
        1 if cue else -1 if other else 0,
        0 if clear else -1,
    )


def _features(text: str, span: Span) -> list[int]:
    kind, a, b = span
    body = text[a:b]
    shape = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]+", "a", body))
    words = re.findall(r"\w+", text[max(0, a - 40):a].lower())[-2:] + re.findall(r"\w+", text[b:b + 20].lower())[:1]
    digits = "".join(filter(str.isdigit, body))
    names = [f"kind {kind}", f"shape {shape[:40]}", f"start {kind} {digits[:2]}", f"size {kind} {len(digits)}",
             f"luhn {kind} {luhn(digits) if digits else None}", *(f"word {w}" for w in words)]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


@dataclass(frozen=True)
class Labelers:
    """Share of true spans, and for each labeler the chances of its votes (-1, 0, 1) on false and true spans."""

    prior: float
    chance: np.ndarray  # labeler x truth x vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.chance)
        scores = np.stack([
            np.log(p) + sum(logs[j, y, patterns[:, j] + 1] for j in range(patterns.shape[1]))
            for y, p in ((0, 1 - self.prior), (1, self.prior))])
        return 1 / (1 + np.exp(np.clip(scores[0] - scores[1], -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Labelers:
    """Expectation-maximisation from the majority vote; add-one counts keep every chance positive."""
    truth = np.clip(0.5 + patterns.sum(axis=1) / (2 * patterns.shape[1]), 0.05, 0.95)
    model = Labelers(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        chance = np.ones((patterns.shape[1], 2, 3))
        for j in range(patterns.shape[1]):
            for y, weight in ((0, counts * (1 - truth)), (1, counts * truth)):
                chance[j, y] += np.bincount(patterns[:, j] + 1, weights=weight, minlength=3)
        chance /= chance.sum(axis=2, keepdims=True)
        prior = float(np.clip((counts * truth).sum() / max(counts.sum(), 1), 0.01, 0.99))
        model = Labelers(prior, chance)
        truth = model.posterior(patterns)
    return model


def _each(batch: pa.RecordBatch) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """(text, base spans, further candidates) of every row; texts without a digit, sign or word for one have none."""
    for text in batch.column("text").to_pylist():
        text = text or ""
        if _HINT.search(text):
            base = base_spans(text)
            yield text, base, candidates(text, base)
        else:
            yield text, [], []


@dataclass(frozen=True)
class Detector:
    """The span classifier and the labelers it learned from; a new span needs both."""

    classifier: Linear
    labelers: Labelers


def _coded(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns], np.int64).reshape(len(patterns), LABELERS)


def train(docs: DataFrame, rows: int = 4000) -> Detector:
    """Estimate the labelers over all candidates of all documents, then fit the span classifier.

    The vote patterns are counted in Spark (3**LABELERS rows at most). The classifier learns from at most ``rows``
    candidates, those whose content hashes lowest. Without candidates it rejects everything.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, list[int]]] = []
            for text, base, more in _each(batch):
                for span, known in [(s, True) for s in base] + [(s, False) for s in more]:
                    pattern = "".join("-0+"[v + 1] for v in votes(text, span, known))
                    body = text[max(0, span[1] - 20):span[2] + 20].encode()
                    out.append((pattern, zlib.crc32(body), _features(text, span)))
            names = ("pattern", "rank", "features")
            types = (pa.string(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=list(names))

    seen = docs.select("text").mapInArrow(scan, "pattern string, rank bigint, features array<int>").persist()
    counted = seen.groupBy("pattern").count().collect()
    sample = seen.orderBy("rank", "pattern", "features").limit(rows).collect()
    seen.unpersist()

    labelers = estimate(_coded([r["pattern"] for r in counted]), np.array([float(r["count"]) for r in counted]))
    if not sample:
        return Detector(Linear(np.zeros(FEATURES), -40.0), labelers)
    target = labelers.posterior(_coded([r["pattern"] for r in sample]))
    sizes = [len(r["features"]) for r in sample]
    classifier = fit(np.repeat(np.arange(len(sample)), sizes),
                     np.concatenate([r["features"] for r in sample]).astype(np.int64), np.ones(sum(sizes)), target, FEATURES)
    return Detector(classifier, labelers)


def _accepted(text: str, more: list[Span], model: Detector, threshold: float) -> list[Span]:
    if not more:
        return []
    margins = np.array([model.classifier.weights[_features(text, s)].sum() for s in more])
    voted = model.labelers.posterior(np.array([votes(text, s, False) for s in more]))
    sure = (model.classifier.probability(margins) >= threshold) & (voted >= 0.5)
    return [s for s, yes in zip(more, sure, strict=True) if yes]


def find(docs: DataFrame, model: Detector, threshold: float = 0.9) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of the fixed patterns; ``spans`` holds these and the classifier's (n_added of them), as
    kind:start:end in code points. A null or empty text has none. No shuffle; repeated rows give equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: list[list[int]] = []
            hashes, lists = [], []
            for text, base, more in _each(batch):
                added = _accepted(text, more, shared.value, threshold)
                kinds = [s[0] for s in base]
                count.append([*map(kinds.count, KINDS), len(added)])
                hashes.append(digest(joined(base, KINDS)))
                lists.append(joined(base + added, KINDS))
            columns = np.array(count, np.int64).reshape(len(count), len(KINDS) + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(columns[:, k]) for k in range(len(KINDS))),
                 pa.array(hashes, pa.string()), pa.array(lists, pa.string()), pa.array(columns[:, -1])],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
              "spans string, n_added bigint")


def redact(docs: DataFrame, model: Detector, threshold: float = 0.9) -> DataFrame:
    """The same rows and columns, each span in ``text`` replaced by its kind in brackets; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for k, (text, base, more) in enumerate(_each(batch)):
                if base or more:
                    texts[k] = replaced(text, base + _accepted(text, more, shared.value, threshold))
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)
