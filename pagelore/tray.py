"""Trays of picked slides: named, ordered, undoable; and what can be told of them with DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions import scaling

UNDO_DEPTH = 100


@dataclass(frozen=True)
class Pick:
    deck_path: str
    slide_index: int
    moved: bool = False


@dataclass
class Tray:
    name: str
    items: tuple[Pick, ...] = ()
    past: list[tuple[Pick, ...]] = field(default_factory=list)
    future: list[tuple[Pick, ...]] = field(default_factory=list)

    def commit(self, items: Iterable[Pick]) -> None:
        """New items; the old can be had back, what was undone can't."""
        self.past = [*self.past, self.items][-UNDO_DEPTH:]
        self.items, self.future = tuple(items), []

    def add(self, picks: Iterable[Pick]) -> int:
        """Appends picks that are not there yet, each once; returns how many."""
        have = {(p.deck_path, p.slide_index) for p in self.items}
        new = [p for p in dict.fromkeys(picks) if (p.deck_path, p.slide_index) not in have]
        if new:
            self.commit([*self.items, *new])
        return len(new)

    def undo(self) -> None:
        if self.past:
            self.future = [self.items, *self.future][:UNDO_DEPTH]
            self.items = self.past.pop()

    def redo(self) -> None:
        if self.future:
            self.past = [*self.past, self.items][-UNDO_DEPTH:]
            self.items = self.future.pop(0)


class Trays:
    """An ordered set of trays, one of them active; there is always one."""

    def __init__(self, fresh_id: Callable[[], str]):
        self.fresh_id = fresh_id
        self.trays: dict[str, Tray] = {}  # in order
        self.active = self.create()

    def _auto_name(self) -> str:
        taken, n = {t.name for t in self.trays.values()}, len(self.trays) + 1
        while f"Tray {n}" in taken:
            n += 1
        return f"Tray {n}"

    def create(self, name: str = "") -> str:
        self.active = key = self.fresh_id()
        self.trays[key] = Tray(name.strip() or self._auto_name())
        return key

    def rename(self, key: str, name: str) -> None:
        if key in self.trays and name.strip():
            self.trays[key].name = name.strip()

    def switch(self, key: str) -> None:
        if key in self.trays:
            self.active = key

    def delete(self, key: str) -> None:
        """The active tray's place goes to its neighbour; the last tray is replaced by an empty one."""
        if key not in self.trays:
            return
        at = list(self.trays).index(key)
        del self.trays[key]
        if not self.trays:
            self.create()
        elif key == self.active:
            self.active = list(self.trays)[min(at, len(self.trays) - 1)]

    def reconcile(self, paths: set[str]) -> None:
        """Marks picks whose deck is not in the library any more. Not undoable: it is no edit."""
        for t in self.trays.values():
            t.items = tuple(Pick(p.deck_path, p.slide_index, p.deck_path not in paths) for p in t.items)

    def dump(self) -> str:
        return json.dumps({"active": self.active, "trays": [{"id": k, "name": t.name, "items": [[p.deck_path, p.slide_index] for p in t.items]} for k, t in self.trays.items()]})

    def load(self, text: str) -> None:
        """Takes over what can be read; anything else leaves the trays as they are."""
        try:
            got = json.loads(text)
            trays = {t["id"]: Tray(t.get("name") or "Tray", tuple(Pick(str(p), int(i)) for p, i in t.get("items", []))) for t in got["trays"] if isinstance(t, dict) and isinstance(t.get("id"), str)}
        except (ValueError, KeyError, TypeError):
            return
        if trays:
            self.trays, self.active = trays, got["active"] if got.get("active") in trays else next(iter(trays))


def duplicates(picks: DataFrame) -> DataFrame:
    """n: picks whose content hash another pick of the tray has (one row)."""
    return picks.where("content_hash IS NOT NULL").groupBy("tray_id", "content_hash").count().where("count > 1").groupBy("tray_id").agg(F.sum("count").alias("n"))


def mismatched(picks: DataFrame) -> DataFrame:
    """picks (tray_id, pos, width, height) with off_size and off_shape against the tray's first pick; unknown sizes never count."""
    first = Window.partitionBy("tray_id").orderBy("pos")
    w, h = F.first("width").over(first), F.first("height").over(first)
    known = F.col("width").isNotNull() & F.col("height").isNotNull() & w.isNotNull() & h.isNotNull()
    off = known & ((F.col("width") != w) | (F.col("height") != h))
    shape = known & ~scaling.same_aspect(F.col("width"), F.col("height"), w, h)
    return picks.withColumns({"off_size": F.coalesce(off, F.lit(False)), "off_shape": F.coalesce(shape, F.lit(False))})


def png_names(picks: DataFrame) -> DataFrame:
    """picks (tray_id, pos, deck_path, slide_index) with the file each is drawn to; names that repeat are numbered."""
    from pagelore.functions import text

    stem = text.sanitized(text.deck_stem("deck_path"))
    rows = picks.withColumn("__stem", stem)
    repeat = F.row_number().over(Window.partitionBy("tray_id", F.lower("__stem"), "slide_index").orderBy("pos"))
    return rows.withColumn("file_name", text.png_name(F.col("__stem"), F.col("slide_index"), repeat)).drop("__stem")
