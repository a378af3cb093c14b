"""Shared by the span finders: sorting, joining and hashing spans of a text."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, str]  # start, end, kind


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end, by start and then kind as listed."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
