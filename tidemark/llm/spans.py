"""Spans of a text as kind:start:end digests, and replacing them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

Span = tuple[str, int, int]


def joined(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then by the kind's place in ``kinds``, joined by commas."""
    order = {kind: k for k, kind in enumerate(kinds)}
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def overlaps(a: int, b: int, spans: Sequence[Span]) -> bool:
    return any(a < y and x < b for _, x, y in spans)


def replaced(text: str, spans: Sequence[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at, reach = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= reach:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = reach = max(reach, b)
    return "".join([*out, text[at:]])
