"""Capacity arithmetic of the keyed containers: the one physical number that users can observe."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


def next_prime(n: int) -> int:
    """The smallest prime of ``n`` or more."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def rounded(capacity: int, bucket_size: int = 1, probing: str = "linear") -> int:
    """Slots of a table asked to hold ``capacity``: whole buckets, for double hashing a prime number of them."""
    if capacity < 0 or bucket_size < 1:
        raise ValueError("capacity must not be negative and buckets need a slot")
    if probing == "double":
        return next_prime(-(-max(capacity, 1) // bucket_size)) * bucket_size
    if probing != "linear":
        raise ValueError(f"unknown probing {probing}")
    return (-(-max(capacity, 1) // bucket_size) + (capacity == 0)) * bucket_size


#: Fixed values of growing maps: the load a segment takes (a 32-bit float's 0.6), the rows held back, the growth.
LOAD, RESERVE, GROWTH = 0.60000002384185791015625, 10_000, 2


def usable(capacity: int) -> int:
    """Rows a segment of a growing map takes before another is opened."""
    return max(0, math.floor(LOAD * capacity) - RESERVE)


def _doubled(capacity: int, need: int) -> int:
    """``capacity``, doubled until a segment of it takes ``need`` rows."""
    while usable(capacity) < need:
        capacity *= GROWTH
    return capacity


@dataclass(frozen=True)
class Growth:
    """Segments of a growing map with the rows in each; a batch goes whole into the last one.

    A segment may be made ``ready`` ahead of need, as large as was foreseen then.
    """

    segments: tuple[int, ...]
    filled: tuple[int, ...]
    following: int
    ready: int | None = None

    @classmethod
    def of(cls, initial: int) -> Growth:
        first = rounded(initial)
        return cls((first,), (0,), GROWTH * first)

    @property
    def size(self) -> int:
        return sum(self.filled)

    @property
    def room(self) -> int:
        return max(0, usable(self.segments[-1]) - self.filled[-1])

    def _opened(self, capacity: int) -> Growth:
        return Growth((*self.segments, capacity), (*self.filled, 0), GROWTH * capacity)

    def with_room(self, n: int) -> Growth:
        """The last segment takes ``n`` more rows: one is opened for them, and for twice the present size, if it would not."""
        if self.room >= n:
            return self
        need = max(GROWTH * self.size, n)
        if self.ready is not None and usable(self.ready) >= need:
            return self._opened(self.ready)
        return self._opened(_doubled(self.following, need))

    def after(self, n: int, inserted: int, prepares: str = "spread") -> Growth:
        """After a batch of ``n`` rows, ``inserted`` of them new.

        The next segment is made ready when less than ``n`` rows' room will be left: always
        (``always``), only once rows are spread over several segments (``spread``), or ``never``.
        """
        if not n:
            return self
        grown = self.with_room(n)
        if grown.ready is None and grown.room < 2 * n and (prepares == "always" or prepares == "spread" and any(grown.filled[:-1])):
            grown = replace(grown, ready=_doubled(grown.following, max(GROWTH * grown.size, n)))
        return replace(grown, filled=(*grown.filled[:-1], grown.filled[-1] + inserted))

    def erased(self, n: int) -> Growth:
        """After ``n`` rows left, from the oldest segments on; capacity stays."""
        filled = []
        for held in self.filled:
            out = min(held, n)
            filled.append(held - out)
            n -= out
        return replace(self, filled=tuple(filled))

    def cleared(self) -> Growth:
        return replace(self, filled=(0,) * len(self.filled), ready=None)

    def reserved(self, n: int) -> Growth:
        """Segments, each twice the last, until all of them together take ``n`` rows."""
        grown, left, k = self, n, 0
        while left > 0:
            if k == len(grown.segments):
                grown = replace(grown._opened(grown.following), ready=grown.ready)
            if usable(grown.segments[k]) >= left:
                break
            left -= usable(grown.segments[k])
            k += 1
        return grown
