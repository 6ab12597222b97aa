"""Spans of matches as ``kind:start:end`` (code points, end exclusive) and their digests."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

Span = tuple[int, int, int]  # start, rank of the kind, end


class Taken:
    """Whether any of some spans touches a range, in logarithmic time."""

    def __init__(self, spans: list[Span]):
        ordered = sorted(spans)
        self.starts = [a for a, _, _ in ordered]
        self.ends = list(accumulate((b for _, _, b in ordered), max))

    def touches(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """By start, then by kind as listed."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
