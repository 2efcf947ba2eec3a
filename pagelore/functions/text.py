"""String, hash and date expressions, all on the JVM side."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: The space separators (Zs), which are what SQL's trim takes off: no tabs and no line ends.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@functools.cache
def folding() -> tuple[str, str, str]:
    """Characters that fold to one other, what they fold to, and the marks that fold to nothing.

    The rule, over all code points of one plane after another: take the canonical decomposition, drop the marks, compose again.
    Hangul syllables come apart into letters that are no marks, and so stay.
    """
    single, bare, marks = [], [], []
    for point in (*range(0xD800), *range(0xE000, 0x20000)):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind[0] == "M":
            marks.append(c)
        elif kind != "Cn" and (apart := unicodedata.normalize("NFD", c)) != c:
            kept = unicodedata.normalize("NFC", "".join(x for x in apart if unicodedata.category(x)[0] != "M"))
            if len(kept) == 1 and kept != c:
                single.append(c)
                bare.append(kept)
    return "".join(single), "".join(bare), "".join(marks)


@functools.cache
def _table() -> dict[int, int | None]:
    return str.maketrans(*folding())


def folded(s: str) -> str:
    """fold() of one text, for queries and snippets."""
    if s.isascii():
        return s.lower()
    return unicodedata.normalize("NFC", s.lower().translate(_table()).lower())


@functools.cache
def raw_token() -> re.Pattern:
    """A token in a text that is not folded: letters and digits with the marks on them."""
    marks = "".join(f"\\U{ord(c):08x}" for c in folding()[2])
    return re.compile(rf"(?:[^\W_{marks}][{marks}]*)+")


def composed_hangul(c: Column) -> Column:
    """Hangul letters that follow each other as syllables, by the arithmetic of their code points."""
    leads, vowels, tails, syllables = 0x1100, 0x1161, 0x11A7, 0xAC00
    unit = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?|[\uac00-\ud7a3][\u11a8-\u11c2]|[\\s\\S]"

    def joined(u: Column) -> Column:
        first, last = F.ascii(u), F.ascii(F.substring(u, -1, 1))
        tail = F.when(last > tails, last - tails).otherwise(0)
        apart = syllables + ((first - leads) * 21 + F.ascii(F.substring(u, 2, 1)) - vowels) * 28 + tail
        point = F.when(first >= syllables, first + last - tails).otherwise(apart)
        open_syllable = (first >= syllables) & (F.pmod(first - syllables, F.lit(28)) == 0)
        whole = (F.length(u) > 1) & ((first < syllables) | open_syllable)
        return F.when(whole, F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")).otherwise(u)

    apart = c.rlike("[\u1161-\u1175\u11a8-\u11c2]")
    return F.when(apart, F.array_join(F.transform(F.regexp_extract_all(c, F.lit(unit), F.lit(0)), joined), "")).otherwise(c)


def fold(c: Column | str) -> Column:
    """Lower case without diacritics, in any script, whether marks are composed or follow their letters (ß stays)."""
    single, bare, marks = folding()
    return composed_hangul(F.lower(F.translate(F.lower(col(c)), single + marks, bare)))


def tokens(c: Column | str) -> Column:
    """Folded tokens: runs of letters and digits. Null text has none."""
    return F.regexp_extract_all(F.coalesce(fold(c), F.lit("")), F.lit(TOKEN), F.lit(0))


def html_escape(c: Column | str) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(col(c), F.lit(a), F.lit(b))
    return c


def xml_escape(c: Column | str) -> Column:
    return F.replace(F.replace(html_escape(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def xml_unescape(c: Column | str) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(col(c), F.lit(a), F.lit(b))
    return c


def strip_marks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "</?mark>", "")


def cut_snippet(c: Column | str, n: int) -> Column:
    """The first n characters, escaped after they are cut."""
    return html_escape(F.substring(F.coalesce(col(c), F.lit("")), 1, n))


def trimmed(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def space_trimmed(c: Column | str) -> Column:
    """Without spaces at either end, as SQL's trim: tabs and line ends stay, and a text of spaces is empty, not null."""
    return F.btrim(col(c), F.lit(SPACES))


def embed_text(title: Column | str, body: Column | str, notes: Column | str, trim: Callable[[Column | str], Column] = trimmed) -> Column:
    """The non-empty parts joined by newlines, null if there is none."""
    parts = [F.nullif(trim(c), F.lit("")) for c in (title, body, notes)]
    return F.nullif(F.concat_ws("\n", *parts), F.lit(""))


def sha256(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def text_hash(title: Column | str, body: Column | str, notes: Column | str) -> Column:
    return sha256(embed_text(title, body, notes))


def file_hash(modified_unix: Column | str, size: Column | str, version: int) -> Column:
    return sha256(F.concat(F.lit(f"v{version}:"), col(modified_unix).cast("string"), F.lit(":"), col(size).cast("string")))


def hash16(c: Column | str) -> Column:
    return F.substring(sha256(c), 1, 16)


def thumb_file_name(deck_path: Column, slide_index: Column, deck_hash: Column) -> Column:
    return F.concat(hash16(deck_path), F.lit("_"), slide_index.cast("string"), F.lit("_"), F.substring(deck_hash, 1, 16), F.lit(".svg"))


def deck_stem(path: Column | str) -> Column:
    """A file's name without its extension, 'deck' if nothing is left."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    return F.when(stem == "", "deck").otherwise(stem)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(col(path), r"[/\\]+$", ""), r"[^/\\]*$", 0)


def dir_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)[/\\][^/\\]*$", 1)


def display_name(file_name: Column | str) -> Column:
    return F.regexp_replace(col(file_name), r"(?i)\.pptx$", "")


def sanitized(c: Column | str) -> Column:
    """A component of a file name: reserved and control characters become '_', no dots or blanks at the ends."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r'[/\\:*?"<>|\p{Cntrl}]', "_"), r"^[\s.]+|[\s.]+$", "")
    return F.when(bare == "", "deck").otherwise(bare)


def png_name(stem: Column, slide_index: Column, repeat: Column) -> Column:
    """stem-003.png, or 'stem-003 (2).png' for a name's second use."""
    name = F.concat(sanitized(stem), F.lit("-"), F.lpad(slide_index.cast("string"), 3, "0"))
    return F.concat(name, F.when(repeat > 1, F.concat(F.lit(" ("), repeat.cast("string"), F.lit(")"))).otherwise(""), F.lit(".png"))


def human_bytes(c: Column | str) -> Column:
    """Binary units with one decimal; whole bytes below 1024."""
    v = col(c).cast("long")
    out = F.concat(col(c).cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        # In whole numbers, halves to the even tenth as C's printf does; format_string rounds them up.
        one = F.lit(1024**i).cast("long")
        rest = F.pmod(v, one) * 10
        tenth, left = F.call_function("div", rest, one), F.pmod(rest, one) * 2
        up = (left > one) | ((left == one) & (tenth % 2 == 1))
        tenths = F.call_function("div", v, one) * 10 + tenth + up.cast("long")
        shown = F.concat(F.call_function("div", tenths, F.lit(10).cast("long")).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(v >= one, shown).otherwise(out)
    return out


def pick_path(c: Column | str) -> Column:
    """The part of 'path:index' before the last colon, null without an index of 1 or more."""
    return F.when(pick_index(c).isNotNull(), F.regexp_extract(col(c), r"^(.+):0*(\d+)$", 1))


def pick_index(c: Column | str) -> Column:
    n = F.regexp_extract(col(c), r"^.+:0*(\d+)$", 1)
    return F.when((n != "") & (n != "0"), n.cast("long"))


def ymd(unix: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(unix)), "yyyy-MM-dd")


def prefix_either_way(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)


def font_fallback(family: Column | str) -> Column:
    """The generic family that stands in for a missing one."""
    f = F.lower(col(family))
    mono = f.contains("mono") | f.contains("consol") | f.contains("courier") | f.contains("code")
    sans = f.contains("sans")
    serif = ~sans & (f.contains("serif") | f.contains("times") | f.contains("georgia") | f.contains("garamond") | f.contains("cambria") | f.contains("book"))
    return F.when(mono, "monospace").when(serif, "serif").otherwise("sans-serif")


def json_field(c: Column | str, name: str, kind: str) -> Column:
    """One field of a JSON object; null where the text is no object or the field is missing or of another kind."""
    return F.from_json(col(c), f"`{name}` {kind}")[name]
