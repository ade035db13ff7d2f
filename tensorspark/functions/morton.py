"""Z-order (Morton) keys as column expressions.

A key may use all 64 bits of a LONG; :meth:`MortonPlan.order` gives what to sort by.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS = 64


@dataclass(frozen=True)
class MortonPlan:
    """``positions[n][b]``: the key bit that holds bit ``b`` of index ``n``.

    Key bits are dealt out from the lowest, one per mode in turn; a mode that has all its
    bits drops out.  Every mode gets at least one bit.  ``shifts[n]`` low bits of index
    ``n`` are left out of the key; a key that leaves bits out orders, but can't be decoded.
    """

    positions: tuple[tuple[int, ...], ...]
    shifts: tuple[int, ...]

    @classmethod
    def of(cls, mode_sizes: Sequence[int]) -> MortonPlan:
        """Keys of whole indices; fails where they need more than 64 bits."""
        plan = cls.leading(mode_sizes, 8 * 64)
        if plan.total_bits > KEY_BITS:
            raise ValueError(f"a {plan.total_bits}-bit key does not fit {KEY_BITS} bits")
        return plan

    @classmethod
    def leading(cls, mode_sizes: Sequence[int], limit: int) -> MortonPlan:
        """Keys of as many leading index bits as fit ``limit`` bits.

        The mode with the most bits left gives up one at a time.
        """
        whole = [max(1, (int(s) - 1).bit_length()) for s in mode_sizes]
        bits = list(whole)
        while sum(bits) > limit:
            bits[bits.index(max(bits))] -= 1
        positions: list[list[int]] = [[] for _ in bits]
        free = 0
        for level in range(max(bits)):
            for n, b in enumerate(bits):
                if level < b:
                    positions[n].append(free)
                    free += 1
        shifts = tuple(w - b for w, b in zip(whole, bits))
        return cls(tuple(tuple(p) for p in positions), shifts)

    @property
    def bits(self) -> tuple[int, ...]:
        return tuple(len(p) for p in self.positions)

    @property
    def total_bits(self) -> int:
        return sum(self.bits)

    @property
    def masks(self) -> tuple[int, ...]:
        return tuple(sum(1 << k for k in p) for p in self.positions)

    def encode(self, idx: Sequence[Column]) -> Column:
        parts = []
        for column, places, shift in zip(idx, self.positions, self.shifts, strict=True):
            wide = F.shiftright(column.cast("bigint"), shift)
            for b, place in enumerate(places):
                bit = wide.bitwiseAND(F.lit(1 << b).cast("bigint"))
                parts.append(F.shiftleft(bit, place - b) if place > b else bit)
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    def order(self, key: Column) -> Column:
        """The key, or, where it uses the sign bit, a value of the same unsigned order."""
        if self.total_bits < KEY_BITS:
            return key
        return key.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))

    def decode(self, key: Column) -> list[Column]:
        if any(self.shifts):
            raise ValueError("the key does not hold whole indices")
        out = []
        for places in self.positions:
            parts = [
                F.shiftleft(F.shiftrightunsigned(key, place).bitwiseAND(F.lit(1).cast("bigint")), b)
                for b, place in enumerate(places)
            ]
            out.append(reduce(lambda a, b: a.bitwiseOR(b), parts).cast("bigint"))
        return out
