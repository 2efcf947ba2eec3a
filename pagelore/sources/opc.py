"""Office packages: a ZIP of parts with relationships and content types."""

from __future__ import annotations

import io
import posixpath
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree as ET

RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


class DeckError(ValueError):
    """A package or deck that can't be read."""


@dataclass(frozen=True)
class Rel:
    id: str
    type: str
    target: str
    external: bool = False


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parsed(xml: bytes, part: str) -> ET.Element:
    try:
        return ET.fromstring(xml)
    except ET.ParseError as e:
        raise DeckError(f"{part}: {e}") from e


def rels_name(part: str) -> str:
    head, _, name = part.rpartition("/")
    return f"{head}/_rels/{name}.rels".lstrip("/")


def resolve(part: str, target: str) -> str:
    """A relationship's target as a part name."""
    base = "" if target.startswith("/") else posixpath.dirname(part)
    out: list[str] = []
    for piece in f"{base}/{target}".split("/"):
        if piece == "..":
            out[-1:] = []
        elif piece not in ("", "."):
            out.append(piece)
    return "/".join(out)


class ContentTypes:
    def __init__(self, xml: bytes | None = None):
        self.defaults: dict[str, str] = {}
        self.overrides: dict[str, str] = {}
        for e in parsed(xml, "[Content_Types].xml") if xml else ():
            if local(e.tag) == "Default":
                self.defaults[e.get("Extension", "").lower()] = e.get("ContentType", "")
            elif local(e.tag) == "Override":
                self.overrides[e.get("PartName", "").lstrip("/")] = e.get("ContentType", "")

    def of(self, part: str) -> str | None:
        return self.overrides.get(part) or self.defaults.get(part.rpartition(".")[2].lower())

    def xml(self) -> bytes:
        root = ET.Element("Types", xmlns=TYPES)
        for k, v in sorted(self.defaults.items()):
            ET.SubElement(root, "Default", Extension=k, ContentType=v)
        for k, v in sorted(self.overrides.items()):
            ET.SubElement(root, "Override", PartName=f"/{k}", ContentType=v)
        return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


class Package:
    def __init__(self, parts: dict[str, bytes]):
        self.parts = parts
        self._rels: dict[str, list[Rel]] = {}

    @classmethod
    def read(cls, content: bytes) -> Package:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                parts = {n.lstrip("/"): z.read(n) for n in z.namelist() if not n.endswith("/")}
        except (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, NotImplementedError, RuntimeError, OSError) as e:
            raise DeckError(f"not a package: {e}") from e
        if "[Content_Types].xml" not in parts:
            raise DeckError("not a package: no [Content_Types].xml")
        return cls(parts)

    def require(self, part: str) -> bytes:
        if part not in self.parts:
            raise DeckError(f"missing part {part}")
        return self.parts[part]

    def rels(self, part: str) -> list[Rel]:
        """Relationships of a part ('' for the package); none if there is no such file."""
        if part not in self._rels:
            name = rels_name(part) if part else "_rels/.rels"
            xml = self.parts.get(name)
            self._rels[part] = [Rel(e.get("Id", ""), e.get("Type", ""), e.get("Target", ""), e.get("TargetMode") == "External") for e in parsed(xml, name) if local(e.tag) == "Relationship"] if xml else []
        return self._rels[part]

    def target(self, part: str, kind: str) -> str | None:
        """The first internal target of a kind of relationship (its last path segment)."""
        return next((resolve(part, r.target) for r in self.rels(part) if r.type.rpartition("/")[2] == kind and not r.external), None)

    def types(self) -> ContentTypes:
        return ContentTypes(self.require("[Content_Types].xml"))

    def main(self) -> str:
        part = self.target("", "officeDocument")
        if not part:
            raise DeckError("no main document")
        return part

    def write(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(self.parts, key=lambda n: (n != "[Content_Types].xml", n)):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), self.parts[name], zipfile.ZIP_DEFLATED)
        return out.getvalue()


def rels_xml(rels: list[Rel]) -> bytes:
    root = ET.Element("Relationships", xmlns=RELS)
    for r in rels:
        ET.SubElement(root, "Relationship", Id=r.id, Type=r.type, Target=r.target, **({"TargetMode": "External"} if r.external else {}))
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)
