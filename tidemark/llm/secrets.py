"""Secrets: fixed patterns, and strings that pass a battery of randomness tests.

A long token's encoding is inferred from its characters; under that alphabet it takes two chi-squared tests of uniform
frequencies (single characters, and sixths of the alphabet), a runs test and a serial-correlation test, whose p-values are
combined by Fisher's method. Ordinary text rarely looks uniform, but short strings can. So the short words of every whole
text, joined and cut into pieces of token lengths (decoys), show for each alphabet and length band how often ordinary text
reaches a value, and the Benjamini-Hochberg rule sets a limit for each from the different strings of all documents.

Tokens of digits alone are never reported: numbers of that length are ids, dates and amounts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Rolling, owners, text_slices, word_spans
from .spans import Span, digest, joined, overlaps

KINDS = ("assign", "access", "hex", "random")

# Fixed patterns.
_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs are maximal, so this is the pattern with its length filter

_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[ord(c) for c in "+/_=-"]] = True
_IN_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_IN_DECOY = _IN_TOKEN.copy()
_IN_DECOY[ord("=")] = False
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(":"), ord("=")]] = True
SHORTEST = 20

# Alphabets by size; the first that holds all characters is taken.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "letters": _LOWER + _UPPER,
    "base62": _DIGITS + _LOWER + _UPPER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
NAMES = list(ALPHABETS)
# Decoys of these alphabets are ordinary strings of the named one too.
NARROWER = {
    "hex": ("decimal",), "HEX": ("decimal",), "base32": ("upper",), "lower36": ("lower", "hex"),
    "upper36": ("upper", "HEX", "base32"), "base62": ("letters", "lower36", "upper36"),
    "base64": ("base62", "letters"), "base64url": ("base62", "letters"),
}
# Where an alphabet has fewer than ENOUGH decoys of a band (texts without digits or capitals), these count as well.
FARTHER = {"letters": ("lower", "upper"), "base62": ("lower",), "base64": ("lower",), "base64url": ("lower",)}
ENOUGH = 400
_PLACE = np.full((len(NAMES), 256), -1, np.int16)
for _k, _name in enumerate(NAMES):
    _PLACE[_k, list(ALPHABETS[_name].encode())] = range(len(ALPHABETS[_name]))
# Lengths share a band from one entry up to the next.
BANDS = (20, 24, 28, 32, 40, 48, 64, 96, 128)
# Ten levels a power of ten of the combined p-value.
LEVELS = 100
# Lengths of decoys, in turn.
PIECES = np.array([21, 25, 29, 35, 43, 55, 79, 111, 160])
SIXTHS = 6


def infer(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of the smallest alphabet that holds all characters of each row; -1: none does."""
    out = np.full(len(edges) - 1, -1)
    for k in range(len(NAMES) - 1, -1, -1):
        holds = np.add.reduceat(_PLACE[k][data] < 0, edges[:-1], dtype=np.int64) == 0 if len(out) else np.zeros(0, bool)
        out[holds] = k
    return out


def _above(z: np.ndarray) -> np.ndarray:
    """Chance that a standard normal value exceeds ``z``."""
    return 0.5 * np.fromiter(map(math.erfc, (z / math.sqrt(2)).tolist()), float, len(z))


def battery(codes: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """Combined p-value of each row of places in an alphabet: near 0 for rows that are not uniform over it."""
    length = np.diff(edges)
    n, rows = length.astype(float), len(length)
    row = np.repeat(np.arange(rows), length)
    count = np.bincount(row * size + codes, minlength=rows * size).reshape(rows, size).astype(float)
    # Single characters: mean and variance of the statistic are exact for multinomial counts, also for short strings.
    chi = (count ** 2).sum(axis=1) * size / n - n
    values = [_above((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n))]
    # Sixths of the alphabet, by Wilson and Hilferty's cube root.
    sixth = np.arange(size) * SIXTHS // size
    share = np.bincount(sixth, minlength=SIXTHS) / size
    held = np.add.reduceat(count, np.searchsorted(sixth, np.arange(SIXTHS)), axis=1)
    chi = ((held - n[:, None] * share) ** 2 / (n[:, None] * share)).sum(axis=1)
    spread = 2 / (9 * (SIXTHS - 1))
    values.append(_above((np.cbrt(chi / (SIXTHS - 1)) - 1 + spread) / math.sqrt(spread)))
    # Runs above and below the middle of the alphabet.
    inner = np.ones(len(codes), bool)
    inner[edges[:-1]] = False
    high = codes >= size // 2
    turns = np.append(False, high[1:] != high[:-1]) & inner
    p = (size - size // 2) / size
    odd = 2 * p * (1 - p)
    spread = np.sqrt((n - 1) * odd * (1 - odd) + 2 * (n - 2) * p * (1 - p) * (1 - 4 * p * (1 - p)))
    values.append(2 * _above(np.abs(np.add.reduceat(turns, edges[:-1], dtype=np.int64) - (n - 1) * odd) / spread))
    # Serial correlation of neighbours.
    d = codes - (size - 1) / 2
    product = np.append(0.0, d[1:] * d[:-1]) * inner
    values.append(2 * _above(np.abs(np.add.reduceat(product, edges[:-1])) / ((size * size - 1) / 12 * np.sqrt(n - 1))))
    t = -sum(np.log(np.maximum(v, 1e-300)) for v in values)
    # Chi-squared tail with two degrees of freedom a test.
    return np.exp(-t) * sum(t ** k / math.factorial(k) for k in range(len(values)))


def p_values(data: np.ndarray, edges: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Combined p-value of each row under the alphabet given for it; 0 for digits, unknown alphabets and short rows."""
    out = np.zeros(len(alphabet))
    length = np.diff(edges)
    for k in np.unique(alphabet):
        if k < 0 or NAMES[k] == "decimal":
            continue
        at = np.flatnonzero((alphabet == k) & (length >= SHORTEST))
        for a in range(0, len(at), 2048):
            some = at[a:a + 2048]
            inside = np.concatenate([[0], np.cumsum(length[some])])
            place = np.arange(inside[-1]) + np.repeat(edges[some] - inside[:-1], length[some])
            out[some] = battery(_PLACE[k][data[place]].astype(np.int64), inside, len(ALPHABETS[NAMES[k]]))
    return out


def levels(p: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(LEVELS + 10 * np.log10(np.maximum(p, 1e-300))), 0, LEVELS - 1).astype(np.int64)


def bands(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, length, "right") - 1


def judged(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, band, p-value) of each token, without the equals signs at its end."""
    bodies = [t.rstrip("=").encode() for t in tokens]
    length = np.array([len(b) for b in bodies], np.int64)
    edges = np.concatenate([[0], np.cumsum(length)])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    alphabet = np.full(len(bodies), -1)
    some = np.flatnonzero(length >= SHORTEST)
    if len(some):
        # Bodies that are too short may be empty, which sums over ranges cannot tell.
        place = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in some])
        alphabet[some] = infer(data[place], np.concatenate([[0], np.cumsum(length[some])]))
    return alphabet, np.maximum(bands(length), 0), p_values(data, edges, alphabet)


def randomness(token: str) -> float:
    return float(judged([token])[2][0])


def base_spans(text: str) -> list[Span]:
    """Spans of the three fixed patterns, leftmost and not overlapping within a kind; failing matches are dropped."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def tokens(text: str, base: list[Span]) -> list[Span]:
    """Long tokens outside the base spans."""
    return [("random", *m.span()) for m in _TOKEN.finditer(text) if not overlaps(*m.span(), base)]


def decoys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of the short words of each text, joined and cut into pieces of the lengths in PIECES, in turn.

    Every text is used whole; a piece never crosses texts, and long tokens, which may be secrets, are left out.
    """
    starts, stops, owner = word_spans(data, offsets, ~_IN_DECOY)
    short = np.flatnonzero(stops - starts < SHORTEST)
    length = (stops - starts)[short]
    before = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(before[-1]) + np.repeat(starts[short] - before[:-1], length)
    text = np.repeat(owner[short], length)
    first = np.searchsorted(text, text)
    turn, rest = np.divmod(np.arange(len(text)) - first, PIECES.sum())
    piece = turn * len(PIECES) + np.searchsorted(np.cumsum(PIECES), rest, "right")
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
    edges = np.append(np.flatnonzero(new), len(text))
    return data[place], edges


def _noted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a long token or one of the signs of an assignment; all others hold neither spans nor candidates."""
    starts, stops, owner = word_spans(data, offsets, ~_IN_TOKEN)
    marked = np.zeros(len(offsets) - 1, bool)
    marked[owner[stops - starts >= SHORTEST]] = True
    marked[owners(np.flatnonzero(_SIGNS[data]), offsets)] = True
    return marked


def _each(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[Span], list[Span]]]:
    """(text if it was looked into, base spans, candidates) of every row."""
    texts = batch.column("text")
    for first, stop, data, offsets in text_slices(texts):
        marked = _noted(data, offsets)
        for k in range(stop - first):
            if marked[k]:
                text = texts[first + k].as_py() or ""
                base = base_spans(text)
                yield text, base, tokens(text, base)
            else:
                yield None, [], []


def _counted(kind: int, name: np.ndarray, alphabet: np.ndarray, band: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """One row of each different string."""
    one = np.unique(np.stack([name.view(np.int64), alphabet, band, levels(p)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.full(one.shape[1], kind)), *(pa.array(c) for c in one)],
                                      names=["kind", "name", "alphabet", "band", "level"])


def calibrate(docs: DataFrame, rate: float = 0.05) -> np.ndarray:
    """Lowest level that counts as random, by alphabet and length band, at a false-discovery rate of ``rate``.

    All documents add their candidates and the decoys of their whole texts, each different string once however often it
    occurs; Spark counts them to a table of alphabets, bands and levels, whatever the number of documents. A single token
    among m candidates of its alphabet and band can be reported from 20 * m decoys on; a cell without candidates or with
    too few decoys accepts none. An empty table accepts none.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                joined_, edges = decoys(data, offsets)
                if len(edges) < 2:
                    continue
                length = np.diff(edges)
                name, own = Rolling(joined_)(edges[:-1], edges[1:]), infer(joined_, edges)
                for k, wider in enumerate(NAMES):
                    for kind, near in ((0, (wider, *NARROWER.get(wider, ()))), (2, FARTHER.get(wider, ()))):
                        fits = np.isin(own, [NAMES.index(x) for x in near]) & (length >= SHORTEST)
                        p = p_values(joined_, edges, np.where(fits, k, -1))
                        yield _counted(kind, name[fits], np.full(fits.sum(), k), bands(length[fits]), p[fits])
            found = [text[a:b] for text, _, more in _each(batch) for _, a, b in more]
            if found:
                alphabet, band, p = judged(found)
                size = np.array([len(t) for t in found])
                edges = np.concatenate([[0], np.cumsum(size)])
                name = Rolling(np.frombuffer("".join(found).encode(), np.uint8))(edges[:-1], edges[1:])
                use = alphabet >= 0
                yield _counted(1, name[use], alphabet[use], band[use], p[use])

    counted = (
        docs.select("text").mapInArrow(scan, "kind bigint, name bigint, alphabet bigint, band bigint, level bigint")
        .distinct().groupBy("kind", "alphabet", "band", "level").agg(F.count("*").alias("n")).collect()
    )
    grid = np.zeros((3, len(NAMES), len(BANDS), LEVELS))
    for r in counted:
        grid[r["kind"], r["alphabet"], r["band"], r["level"]] = r["n"]
    grid[0] += grid[2] * (grid[0].sum(axis=2, keepdims=True) < ENOUGH)
    return np.array(limits(grid[:2].reshape(2, -1, LEVELS), rate)).reshape(len(NAMES), len(BANDS))


def limits(grid: np.ndarray, rate: float) -> list[int]:
    """grid: decoys and candidates by cell and level; the Benjamini-Hochberg limit of each cell (LEVELS: none)."""
    from_top = grid[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]
    out = []
    for decoys, found in zip(from_top[0], from_top[1], strict=True):
        null = (1 + decoys) / (1 + decoys[0])
        passed = np.flatnonzero((found > 0) & (null * found[0] <= rate * found)) if decoys[0] else []
        out.append(int(passed[0]) if len(passed) else LEVELS)
    return out


def find(docs: DataFrame, limit: np.ndarray) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Counts and digest are of the fixed patterns; ``spans`` adds the tokens that pass the battery, as kind:start:end in
    code points. A null or empty text has none; texts of any length are read whole. Spans of one start are ordered by
    kind. No shuffle; repeated rows give equal results, an empty table none; other columns are not read.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, hashes, lists = [], [], []
            rows = list(_each(batch))
            alphabet, band, p = judged([text[a:b] for text, _, more in rows for _, a, b in more])
            passed = iter(((alphabet >= 0) & (p > 0) & (levels(p) >= limit[alphabet, band])).tolist())
            for _, base, more in rows:
                added = [span for span in more if next(passed)]
                kinds = [s[0] for s in base + added]
                count.append([*map(kinds.count, KINDS)])
                hashes.append(digest(joined(base, KINDS)))
                lists.append(joined(base + added, KINDS))
            columns = np.array(count, np.int64).reshape(len(count), len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(columns[:, k]) for k in range(3)), pa.array(hashes, pa.string()),
                 pa.array(lists, pa.string()), pa.array(columns[:, 3])],
                names=["doc_id", *(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
              "n_random bigint")
