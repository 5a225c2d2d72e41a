"""World ids: quantised coordinates interleaved to one 64-bit Morton number, and the older fixed-field code."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.geometry import Geometry, col

#: Fixed value: bits of x, y and z.
AXIS_BITS = (24, 24, 16)


def layout(bits: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """(axis, bit of the axis, bit of the code), least significant first; used-up axes are passed over."""
    out = []
    for bit in range(max(bits)):
        for axis in range(3):
            if bit < bits[axis]:
                out.append((axis, bit, len(out)))
    return out


@dataclass(frozen=True)
class WorldId:
    """How coordinates become an id: (v - offset) * scale, rounded, on so many bits."""

    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: tuple[float, float, float] = (10.0, 10.0, 10.0)
    bits: tuple[int, int, int] = AXIS_BITS

    def __post_init__(self):
        if sum(self.bits) > 64 or min(self.bits) < 1:
            raise ValueError("axes need 1 bit each and 64 together")

    @classmethod
    def from_params(cls, held: dict) -> WorldId:
        """From stored parameters; scale and bits may be one number, a list or a dict by axis."""

        def three(value, default):
            if value is None:
                return default
            if isinstance(value, dict):
                return tuple(value[a] for a in "xyz")
            return (value,) * 3 if isinstance(value, (int, float)) else tuple(value)

        scale = three(held.get("scale"), (10.0,) * 3)
        bits = three(held.get("bits_per_axis"), AXIS_BITS)
        return cls(tuple(map(float, three(held.get("offset"), (0.0,) * 3))), tuple(map(float, scale)), tuple(map(int, bits)))

    def to_params(self) -> dict:
        return {"type": "morton_zorder", "offset": dict(zip("xyz", self.offset)), "scale": dict(zip("xyz", self.scale)), "bits_per_axis": dict(zip("xyz", self.bits)), "overflow_policy": "error", "null_policy": "no_nulls"}

    @classmethod
    def for_geometry(cls, g: Geometry, scale: float = 10.0, bits: tuple[int, int, int] = AXIS_BITS) -> WorldId:
        """Offsets just below the grid's extent; grids too wide for the bits are refused."""
        low, high = g.bounds()
        offset = tuple(math.floor(v * 10) / 10 for v in low)
        for a, o, h, b in zip("xyz", offset, high, bits):
            if round((h - o) * scale) >= 2**b:
                raise ValueError(f"{a} spans more than {b} bits hold at scale {scale}")
        return cls(offset, (scale,) * 3, bits)

    def encode(self, x="x", y="y", z="z") -> Column:
        q = []
        for a, v, o, s, b in zip("xyz", (x, y, z), self.offset, self.scale, self.bits):
            steps = F.rint((col(v).cast("double") - F.lit(o)) * F.lit(s))
            bad = F.raise_error(F.lit(f"{a} is outside the world id's range")).cast("long")
            q.append(F.when((steps >= 0) & (steps < float(2**b)), steps.cast("long")).otherwise(bad))
        return _united([_looked_up(q[axis], at, table) for axis, at, table in _spread(self.bits)])

    def decode(self, code="world_id") -> tuple[Column, Column, Column]:
        code = col(code)
        out = []
        for axis in range(3):
            steps = _united([_looked_up(code, at, table) for a, at, table in _gathered(self.bits) if a == axis])
            out.append(steps.cast("double") / F.lit(self.scale[axis]) + F.lit(self.offset[axis]))
        return tuple(out)


def _table(values: list[int]) -> str:
    """An SQL array of longs; the 64th bit is the sign."""
    return f"array({','.join(f'{v - 2**64 if v >= 2**63 else v}L' for v in values)})"


def _bytes(moves: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """For bits that move from one place to another: by byte of the source, its place and what its 256 values become."""
    out = []
    for at in sorted({a // 8 * 8 for a, _ in moves}):
        mine = [(a - at, to) for a, to in moves if a // 8 * 8 == at]
        out.append((at, _table([sum(1 << to for bit, to in mine if value >> bit & 1) for value in range(256)])))
    return out


@lru_cache(16)
def _spread(bits: tuple[int, int, int]) -> list[tuple[int, int, str]]:
    """axis, place of a byte of its steps, and the code's bits for each value of the byte."""
    return [(axis, at, table) for axis in range(3) for at, table in _bytes([(bit, to) for a, bit, to in layout(bits) if a == axis])]


@lru_cache(16)
def _gathered(bits: tuple[int, int, int]) -> list[tuple[int, int, str]]:
    """axis, place of a byte of the code, and the bits of the axis' steps for each value of the byte."""
    return [(axis, at, table) for axis in range(3) for at, table in _bytes([(to, bit) for a, bit, to in layout(bits) if a == axis])]


def _looked_up(value: Column, at: int, table: str) -> Column:
    return F.get(F.expr(table), F.shiftrightunsigned(value, at).bitwiseAND(F.lit(255).cast("long")).cast("int"))


def _united(parts: list[Column]) -> Column:
    """Bitwise or, as a balanced tree: expressions stay shallow."""
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


#: Largest coordinates of the fixed-field code, in tenths.
FIELD_MOST = (2**24 - 1, 2**24 - 1, 2**16 - 1)


def encode_fields(x="x", y="y", z="z") -> Column:
    """x << 40 | y << 16 | z in tenths; more than one decimal, or out of range, is an error."""
    out = []
    for a, v, most in zip("xyz", (x, y, z), FIELD_MOST):
        tenths = col(v).cast("double") * 10
        steps = F.rint(tenths)
        ok = (F.abs(tenths - steps) <= 1e-6) & (steps >= 0) & (steps <= most)
        out.append(F.when(ok, steps.cast("long")).otherwise(F.raise_error(F.lit(f"{a} does not fit the code")).cast("long")))
    return F.shiftleft(out[0], 40).bitwiseOR(F.shiftleft(out[1], 16)).bitwiseOR(out[2])


def decode_fields(code="code") -> tuple[Column, Column, Column]:
    code = col(code)
    low = lambda c, bits: c.bitwiseAND(F.lit(2**bits - 1))
    parts = (F.shiftrightunsigned(code, 40), low(F.shiftrightunsigned(code, 16), 24), low(code, 16))
    return tuple(p.cast("double") / 10 for p in parts)
