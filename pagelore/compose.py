"""Composition: a new deck from picked slides of others.

Planning (which parts, in which order, which are equal) is bookkeeping over a
few packages; the parts themselves are copied as they stand, or rescaled if the
slide sizes differ.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

from pagelore.functions.scaling import Scale, compute
from pagelore.sources.opc import OFFICE, ContentTypes, DeckError, Package, Rel, local, rels_name, rels_xml, resolve
from pagelore.sources.pptx import Presentation

P = "http://schemas.openxmlformats.org/presentationml/2006/main"
KIND = f"{OFFICE}/"
#: Parts of which a deck has one of its own, never shared by content.
OWN = frozenset({"slide", "slideLayout", "slideMaster", "theme", "notesSlide", "notesMaster"})
#: Attributes in EMU by element, and in hundredths of a point.
EMU = {"off": "xy", "chOff": "xy", "ext": ("cx", "cy"), "chExt": ("cx", "cy"), "gridCol": "w", "tr": "h", "ln": "w", "pos": "xy"}
POINTS = {"rPr": ("sz",), "defRPr": ("sz",), "endParaRPr": ("sz",)}


@dataclass
class Report:
    slides: int = 0
    decks: int = 0
    warnings: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def rescaled(xml: bytes, s: Scale) -> bytes:
    """A slide part with its positions, sizes and font sizes scaled."""
    root = ET.fromstring(xml)
    for e in root.iter():
        name = local(e.tag)
        for a in EMU.get(name, ()):
            if (v := e.get(a)) and v.lstrip("-").isdigit():
                e.set(a, str(s.apply(int(v))))
        for a in POINTS.get(name, ()):
            if (v := e.get(a)) and v.isdigit():
                e.set(a, str(max(100, s.apply(int(v)))))
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def merged_styles(sources: list[Presentation]) -> bytes | None:
    """The decks' table styles, each id from the first deck that has it."""
    root: ET.Element | None = None
    seen: set[str | None] = set()
    for p in sources:
        part = p.package.target(p.part, "tableStyles")
        if not part or part not in p.package.parts:
            continue
        try:
            mine = ET.fromstring(p.package.parts[part])
        except ET.ParseError:
            continue
        if root is None:
            root = ET.Element(mine.tag, mine.attrib)
        for style in mine:
            if style.get("styleId") not in seen:
                seen.add(style.get("styleId"))
                root.append(style)
    return None if root is None else ET.tostring(root, encoding="UTF-8", xml_declaration=True)


class Composer:
    def __init__(self, width: int, height: int):
        self.size = (width, height)
        self.parts: dict[str, bytes] = {}
        self.types = ContentTypes()
        self.copied: dict[tuple[str, str, str], str] = {}  # deck, part, scale -> new name
        self.shared: dict[str, str] = {}  # bytes' hash -> new name
        self.numbers: dict[tuple[str, str], int] = {}
        self.slides: list[str] = []
        self.masters: dict[str, list[str]] = {}  # new master -> its new layouts
        self.report = Report()

    def name(self, part: str) -> str:
        folder, file = posixpath.split(part)
        stem, ext = posixpath.splitext(file)
        stem = stem.rstrip("0123456789") or "part"
        n = self.numbers[folder, stem + ext] = self.numbers.get((folder, stem + ext), 0) + 1
        return f"{folder}/{stem}{n}{ext}"

    def copy(self, deck: str, source: Package, part: str, kind: str, scale: Scale | None, fresh: bool = False) -> str | None:
        """The new name of a part, copied with all it refers to; what is missing is warned of and left out."""
        key = (deck, part, str(scale))
        if key in self.copied and not fresh:
            return self.copied[key]
        data = source.parts.get(part)
        if data is None:
            self.report.warnings.append(f"{deck}: {part} is missing")
            return None
        rels = source.rels(part)
        digest = hashlib.sha256(data).hexdigest()
        if kind not in OWN and not rels:
            if digest in self.shared:
                return self.copied.setdefault(key, self.shared[digest])
        new = self.copied[key] = self.name(part)
        if kind not in OWN and not rels:
            self.shared[digest] = new
        kinds = source.types().of(part)
        if kinds:
            self.types.overrides[new] = kinds
        out: list[Rel] = []
        for r in rels:
            what = r.type.rpartition("/")[2]
            if r.external:
                out.append(r)
            elif kind == "slideMaster" and what == "slideLayout":
                continue  # only the layouts that slides use; see finish()
            else:
                target = self.copy(deck, source, resolve(part, r.target), what, scale)
                if target:
                    out.append(Rel(r.id, r.type, posixpath.relpath(target, posixpath.dirname(new))))
        if scale and kind in ("slide", "slideLayout", "slideMaster"):
            data = rescaled(data, scale)
        self.parts[new] = data
        if kind == "slideMaster":
            self.masters.setdefault(new, [])
        if kind == "slideLayout":
            master = next((resolve(new, r.target) for r in out if r.type.endswith("/slideMaster")), None)
            if master and new not in self.masters.setdefault(master, []):
                self.masters[master].append(new)
        if out:
            self.parts[rels_name(new)] = rels_xml(out)
        return new

    def add(self, deck: str, p: Presentation, index: int, fit: str) -> None:
        scale = None
        if (p.width, p.height) != self.size:
            exact = abs(p.width * self.size[1] - self.size[0] * p.height) * 1000 <= self.size[0] * p.height
            if exact or fit in ("fit", "fill"):
                scale = compute((p.width, p.height), self.size, fit == "fill" and not exact)
                note = f"{deck}: scaled to {scale.percent}%"
                if note not in self.report.notes:
                    self.report.notes.append(note)
            else:
                note = f"{deck}: its slides have another shape"
                if note not in self.report.warnings:
                    self.report.warnings.append(note)
        new = self.copy(deck, p.package, p.slide_part(index), "slide", scale, fresh=True)
        if new:
            self.slides.append(new)
            self.report.slides += 1

    def carry(self, sources: list[Presentation]) -> list[tuple[str, str]]:
        """Parts of the presentation itself: properties of the first deck, table styles of all."""
        out = []
        first = sources[0]
        for kind in ("presProps", "viewProps"):
            part = first.package.target(first.part, kind)
            if part and part in first.package.parts:
                new = f"ppt/{kind}.xml"
                self.parts[new] = first.package.parts[part]
                out.append((kind, new))
        if styles := merged_styles(sources):
            self.parts["ppt/tableStyles.xml"] = styles
            out.append(("tableStyles", "ppt/tableStyles.xml"))
        for kind, new in out:
            self.types.overrides[new] = f"application/vnd.openxmlformats-officedocument.presentationml.{kind}+xml"
        return out

    def finish(self, title: str, sources: list[Presentation]) -> Package:
        rels, ids = [], iter(range(1, 1 << 30))
        root = ET.Element(f"{{{P}}}presentation")
        masters, slides = ET.SubElement(root, f"{{{P}}}sldMasterIdLst"), ET.SubElement(root, f"{{{P}}}sldIdLst")
        number = iter(range(2_147_483_648, 1 << 32))

        def ref(parent: ET.Element, tag: str, n: int, kind: str, part: str) -> None:
            rid = f"rId{next(ids)}"
            ET.SubElement(parent, f"{{{P}}}{tag}", {"id": str(n), f"{{{OFFICE}}}id": rid})
            rels.append(Rel(rid, KIND + kind, posixpath.relpath(part, "ppt")))

        for master, layouts in self.masters.items():
            ref(masters, "sldMasterId", next(number), "slideMaster", master)
            self._list_layouts(master, layouts, number)
        for i, s in enumerate(self.slides):
            ref(slides, "sldId", 256 + i, "slide", s)
        for kind, part in self.carry(sources):
            rels.append(Rel(f"rId{next(ids)}", KIND + kind, posixpath.relpath(part, "ppt")))
        ET.SubElement(root, f"{{{P}}}sldSz", cx=str(self.size[0]), cy=str(self.size[1]))
        ET.SubElement(root, f"{{{P}}}notesSz", cx=str(self.size[1]), cy=str(self.size[0]))
        self.parts["ppt/presentation.xml"] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
        self.parts["ppt/_rels/presentation.xml.rels"] = rels_xml(rels)
        core = ET.Element("{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}coreProperties")
        ET.SubElement(core, "{http://purl.org/dc/elements/1.1/}title").text = title
        self.parts["docProps/core.xml"] = ET.tostring(core, encoding="UTF-8", xml_declaration=True)
        self.parts["_rels/.rels"] = rels_xml([Rel("rId1", KIND + "officeDocument", "ppt/presentation.xml"), Rel("rId2", "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties", "docProps/core.xml")])
        self.types.defaults |= {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"}
        self.types.overrides |= {"ppt/presentation.xml": "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml", "docProps/core.xml": "application/vnd.openxmlformats-package.core-properties+xml"}
        self.parts["[Content_Types].xml"] = self.types.xml()
        return Package(self.parts)

    def _list_layouts(self, master: str, layouts: list[str], number) -> None:
        """A master names exactly the layouts that came with it."""
        root = ET.fromstring(self.parts[master])
        for old in [e for e in root if local(e.tag) == "sldLayoutIdLst"]:
            root.remove(old)
        lst = ET.SubElement(root, f"{{{P}}}sldLayoutIdLst")
        have = Package(self.parts).rels(master)
        for i, layout in enumerate(layouts):
            rid = f"rIdLayout{i + 1}"
            have.append(Rel(rid, KIND + "slideLayout", posixpath.relpath(layout, posixpath.dirname(master))))
            ET.SubElement(lst, f"{{{P}}}sldLayoutId", {"id": str(next(number)), f"{{{OFFICE}}}id": rid})
        self.parts[master] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
        self.parts[rels_name(master)] = rels_xml(have)


def compose(picks: list[tuple[str, int]], read: Callable[[str], bytes], title: str = "Composed", fit: str = "keep") -> tuple[bytes, Report]:
    """The new deck's bytes and a report. Each source is opened once; the first pick sets the slide size. fit: keep, fit or fill."""
    if not picks:
        raise DeckError("nothing is picked")
    decks: dict[str, Presentation] = {}
    for path, _ in picks:
        if path not in decks:
            decks[path] = Presentation.read(read(path))
    first = decks[picks[0][0]]
    c = Composer(first.width, first.height)
    for path, index in picks:
        c.add(path, decks[path], index, fit)
    c.report.decks = len(decks)
    for path, p in decks.items():
        if p.embedded_fonts()[0]:
            c.report.warnings.append(f"{path}: embedded fonts are not carried over")
    return c.finish(title, list(decks.values())).write(), c.report
