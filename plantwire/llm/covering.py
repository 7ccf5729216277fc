"""Covering families of bit masks: two prints that differ in ``radius`` of the bits or fewer agree under one of them."""

from __future__ import annotations

from collections.abc import Iterable


def masks(bits: Iterable[int], radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks over these bit positions.

    Bits get non-zero vectors of ``radius + 1`` binary digits, and mask ``t`` keeps the bits
    whose vector has an odd product with ``t``. Any ``radius`` vectors leave some ``t`` with
    which all their products are even, so that no differing bit is kept.
    """
    tables = (1 << radius + 1) - 1
    placed = list(enumerate(bits))
    return [sum(1 << bit for n, bit in placed if (t & (1 + n % tables)).bit_count() % 2) for t in range(1, tables + 1)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask
