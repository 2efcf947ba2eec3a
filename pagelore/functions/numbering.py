"""List numbers and colours as drawings show them."""

from __future__ import annotations

import colorsys


def alpha(n: int) -> str:
    """1 is a, 26 is z, 27 is aa."""
    out = ""
    n = max(n, 1)
    while n:
        n, digit = divmod(n - 1, 26)
        out = chr(ord("a") + digit) + out
    return out


def roman(n: int) -> str:
    out = ""
    for place, (one, five, ten) in ((100, "cdm"), (10, "xlc"), (1, "ivx")):
        digit = n % (place * 10) // place
        part = one * digit if digit < 4 else one + five if digit == 4 else five + one * (digit - 5) if digit < 9 else one + ten
        out += part
    return "m" * (n // 1000) + out or "i"


def numbered(kind: str, n: int) -> str:
    """A list number: arabic, alpha or roman, Lc or Uc, with a period or parentheses."""
    base = alpha(n) if kind.startswith("alpha") else roman(n) if kind.startswith("roman") else str(n)
    if "Uc" in kind:
        base = base.upper()
    if kind.endswith("ParenBoth"):
        return f"({base})"
    return f"{base})" if kind.endswith("ParenR") else f"{base}."


def with_luminance(rgb: str, mod: float = 1.0, off: float = 0.0) -> str:
    """A hex colour with its luminance scaled and shifted."""
    r, g, b = (int(rgb[i : i + 2], 16) / 255 for i in (0, 2, 4))
    h, lum, s = colorsys.rgb_to_hls(r, g, b)
    r, g, b = colorsys.hls_to_rgb(h, min(1.0, max(0.0, lum * mod + off)), s)
    return "".join(f"{round(x * 255):02X}" for x in (r, g, b))


def shaded(rgb: str, shade: float = 1.0, tint: float = 1.0) -> str:
    """A hex colour mixed with black (shade below 1) or white (tint below 1)."""
    out = [int(rgb[i : i + 2], 16) * shade for i in (0, 2, 4)]
    return "".join(f"{round(x * tint + 255 * (1 - tint)):02X}" for x in out)
