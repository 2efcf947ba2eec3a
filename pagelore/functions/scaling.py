"""Slide-size arithmetic in exact integers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(v: Column, num: Column, den: Column) -> Column:
    """v * num / den rounded half up, exact in 38 digits."""
    v, num, den = (c.cast("decimal(19,0)") for c in (v, num, den))
    top = (v * num).cast("decimal(38,0)") + F.floor(den / 2).cast("decimal(19,0)")
    return ((top - F.pmod(top, den)) / den).cast("decimal(38,0)").cast("long")


def same_aspect(sw: Column, sh: Column, tw: Column, th: Column) -> Column:
    """Aspect ratios within a thousandth, by cross-multiplication."""
    sw, sh, tw, th = (c.cast("decimal(15,0)") for c in (sw, sh, tw, th))
    return F.abs(sw * th - tw * sh) * 1000 <= tw * sh


@dataclass(frozen=True)
class Scale:
    """A uniform scale num/den with an offset that centres what it scales."""

    num: int
    den: int
    dx: int = 0
    dy: int = 0

    def apply(self, v: int) -> int:
        return (v * self.num + self.den // 2) // self.den

    @property
    def percent(self) -> int:
        return self.num * 100 // self.den


def compute(src: tuple[int, int], dst: tuple[int, int], fill: bool = False) -> Scale:
    """Fits src inside dst, or fills dst with it; the leftover is shared by both sides."""
    (sw, sh), (dw, dh) = src, dst
    by_width = (dw * sh <= dh * sw) != fill
    s = Scale(dw, sw) if by_width else Scale(dh, sh)
    return Scale(s.num, s.den, int((dw - s.apply(sw)) / 2), int((dh - s.apply(sh)) / 2))
