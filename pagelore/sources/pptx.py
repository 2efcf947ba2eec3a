"""What a presentation says: slide order and size, texts and notes, fonts, hashes."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

from pagelore.schema import DEFAULT_HEIGHT, DEFAULT_WIDTH
from pagelore.sources.opc import OFFICE, DeckError, Package, local, parsed, resolve

RID = f"{{{OFFICE}}}id"
#: The largest embedded font that is read.
MOST_FONT_BYTES = 5 << 20
FONT_STYLES = ("regular", "bold", "italic", "boldItalic")


@dataclass
class SlideText:
    title: str | None = None
    texts: list[str] = field(default_factory=list)
    notes: str | None = None


def texts_of(xml: bytes, part: str) -> SlideText:
    """Text of each outermost shape or frame: paragraphs and breaks are lines, the first title placeholder is the title."""
    out = SlideText()

    def said(shape: ET.Element) -> tuple[str, bool]:
        text, title, line = "", False, False
        for e in shape.iter():
            name = local(e.tag)
            if name in ("p", "br"):
                line = line or bool(text)
            elif name == "ph":
                title = title or e.get("type") in ("title", "ctrTitle")
            elif name == "t" and (got := "".join(e.itertext())):
                text += ("\n" if line else "") + got
                line = False
        return text.strip(), title

    stack = [parsed(xml, part)]
    while stack:
        e = stack.pop()
        if local(e.tag) not in ("sp", "graphicFrame"):
            stack.extend(reversed(e))
            continue
        text, title = said(e)
        if text:
            if title and out.title is None:
                out.title = text
            out.texts.append(text)
    return out


class Presentation:
    def __init__(self, package: Package):
        self.package = package
        self.part = package.main()
        root = parsed(package.require(self.part), self.part)
        rels = {r.id: r for r in package.rels(self.part)}
        self.slides: list[str] = []
        self.width, self.height = DEFAULT_WIDTH, DEFAULT_HEIGHT
        for e in root.iter():
            if local(e.tag) == "sldId":
                rel = rels.get(e.get(RID, ""))
                if rel is None:
                    raise DeckError(f"{self.part}: unknown relationship {e.get(RID)}")
                self.slides.append(resolve(self.part, rel.target))
            elif local(e.tag) == "sldSz":
                self.width, self.height = int(e.get("cx", DEFAULT_WIDTH)), int(e.get("cy", DEFAULT_HEIGHT))
        self.core: dict[str, str] = {}
        if core := package.parts.get("docProps/core.xml"):
            try:
                for e in ET.fromstring(core):
                    if local(e.tag) in ("title", "creator", "modified") and (e.text or "").strip():
                        self.core[local(e.tag)] = e.text
            except ET.ParseError:
                pass  # broken properties do not keep a deck out

    @classmethod
    def read(cls, content: bytes) -> Presentation:
        return cls(Package.read(content))

    def slide_part(self, index: int) -> str:
        if not 1 <= index <= len(self.slides):
            raise DeckError(f"slide {index} of {len(self.slides)}")
        return self.slides[index - 1]

    def content(self, index: int) -> SlideText:
        part = self.slide_part(index)
        out = texts_of(self.package.require(part), part)
        notes = self.package.target(part, "notesSlide")
        if notes and notes in self.package.parts:
            lines = "\n".join(texts_of(self.package.parts[notes], notes).texts).splitlines()
            out.notes = "\n".join(x for x in lines if x.strip() and not re.fullmatch(r"\+?\d+", x.strip(), re.ASCII)) or None
        return out

    def content_hash(self, index: int) -> str:
        """Identity of what a slide shows: its XML with references replaced by what they point to, without volatile ids, layout and master."""
        part = self.slide_part(index)
        rels = {r.id: r for r in self.package.rels(part)}
        root = parsed(self.package.require(part), part)
        media: set[str] = set()
        stack = [root]
        while stack:
            e = stack.pop()
            for child in [c for c in e if local(c.tag) in ("creationId", "modId")]:
                e.remove(child)
            for k in list(e.attrib):
                if local(k) in ("creationId", "modId"):
                    del e.attrib[k]
                elif k.startswith(f"{{{OFFICE}}}"):
                    rel = rels.get(e.attrib[k])
                    if rel is None or rel.type.endswith(("/slideLayout", "/slideMaster", "/notesSlide")):
                        del e.attrib[k]
                    elif rel.external:
                        e.attrib[k] = rel.target
                    else:
                        data = self.package.parts.get(resolve(part, rel.target), b"")
                        e.attrib[k] = digest = hashlib.sha256(data).hexdigest()
                        media.add(digest)
            stack.extend(e)
        canonical = ET.canonicalize(ET.tostring(root, encoding="unicode"))
        return hashlib.sha256(b"slide:" + canonical.encode() + b"\x1emedia:" + ",".join(sorted(media)).encode()).hexdigest()

    def embedded_fonts(self) -> tuple[dict[str, dict[str, bytes]], list[str]]:
        """family -> style -> font bytes of the fonts that may be used again, and why others may not."""
        fonts: dict[str, dict[str, bytes]] = {}
        notes: list[str] = []
        rels = {r.id: r for r in self.package.rels(self.part)}
        for e in parsed(self.package.require(self.part), self.part).iter():
            if local(e.tag) != "embeddedFont":
                continue
            family = next((c.get("typeface") for c in e if local(c.tag) == "font"), None)
            for c in e:
                if local(c.tag) not in FONT_STYLES or not family:
                    continue
                rel = rels.get(c.get(RID, ""))
                data = self.package.parts.get(resolve(self.part, rel.target)) if rel else None
                if data is None:
                    notes.append(f"{family} {local(c.tag)}: missing")
                elif len(data) > MOST_FONT_BYTES:
                    notes.append(f"{family} {local(c.tag)}: too large")
                elif not harvestable(data):
                    notes.append(f"{family} {local(c.tag)}: not usable or not allowed")
                else:
                    fonts.setdefault(family, {})[local(c.tag)] = data
        return fonts, notes

    def font_names(self) -> set[str]:
        """Families named by slides, layouts, masters and themes; references to theme fonts are skipped."""
        seen: set[str] = set()
        todo = list(self.slides)
        out: set[str] = set()
        while todo:
            part = todo.pop()
            if part in seen or part not in self.package.parts:
                continue
            seen.add(part)
            for e in parsed(self.package.parts[part], part).iter():
                face = e.get("typeface") if local(e.tag) in ("latin", "ea", "cs") else None
                if face and not face.startswith("+"):
                    out.add(face)
            todo += [t for kind in ("slideLayout", "slideMaster", "theme") if (t := self.package.target(part, kind))]
        return out


def fs_type(data: bytes) -> int | None:
    """The licence bits of an OpenType font, None if it is none."""
    if len(data) < 12 or data[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        return None
    for i in range(struct.unpack(">H", data[4:6])[0]):
        record = data[12 + 16 * i : 28 + 16 * i]
        if len(record) == 16 and record[:4] == b"OS/2":
            at = struct.unpack(">I", record[8:12])[0]
            return struct.unpack(">H", data[at + 8 : at + 10])[0] if at + 10 <= len(data) else None
    return 0


def allows_harvest(bits: int) -> bool:
    """Installable or editable embedding."""
    return bits & 0xF == 0 or bool(bits & 8)


def harvestable(data: bytes) -> bool:
    bits = fs_type(data)
    return bits is not None and allows_harvest(bits)


def classify_graphic(uri: str) -> str:
    """What a graphic frame holds that can't be drawn."""
    u = uri.lower()
    return "chart" if "chart" in u else "smartart" if "diagram" in u else "ole" if "ole" in u else "unknown-shape"


def dropped(p: Presentation, index: int) -> list[str]:
    """Kinds of content of a slide that a drawing leaves out, sorted, once each."""
    part = p.slide_part(index)
    rels = {r.id: r for r in p.package.rels(part)}
    out: set[str] = set()
    for e in parsed(p.package.require(part), part).iter():
        name = local(e.tag)
        if name == "graphicData" and "table" not in (e.get("uri") or "").lower():
            out.add(classify_graphic(e.get("uri") or ""))
        elif name == "blip":
            rel = rels.get(e.get(f"{{{OFFICE}}}embed", ""))
            if rel and not rel.target.lower().endswith((".png", ".jpg", ".jpeg", ".gif", ".svg")):
                out.add("unsupported-image")
    return sorted(out)
