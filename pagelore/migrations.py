"""Schema steps of a library, in order; each may run again without harm, and the log keeps how far a library is."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from pagelore.schema import SCHEMA_VERSION, TABLES, struct

if TYPE_CHECKING:
    from pagelore.library import Library


class TooNew(ValueError):
    """Written by a later version of this library."""


def from_snapshots(lib: Library) -> None:
    """Tables that lie as whole snapshots behind one pointer file become tables of the log."""
    pointer = f"{lib.path}/_current.json"
    if not lib.store.exists(pointer):
        return
    for name, snapshot in sorted(json.loads(lib.store._text(pointer)).items()):
        if name in TABLES and name not in ("lengths", "meta"):
            lib.put(name, lib.spark.read.schema(struct(name)).parquet(f"{lib.path}/{name}/{snapshot}"))


def segmented_index(lib: Library) -> None:
    """The full-text index is made of segments; it is built again from the slides where there are none."""
    slides = lib.table("slides")
    if slides.isEmpty() or not lib.table("segments").isEmpty():
        return
    named = lib.table("decks").select(F.col("id").alias("deck_id"), F.concat_ws(" ", "title", "file_name").alias("deck_title"))
    words = slides.select("deck_id", F.col("id").alias("slide_id"), "title", F.col("body_text").alias("body"), "notes")
    lib.index.add(words.join(named, "deck_id"), replaced=False)


#: The version that each step leads to. Columns that are new need no step: older files read as null.
STEPS = [(6, from_snapshots), (7, segmented_index)]


def bring_up(lib: Library) -> list[int]:
    """Runs the steps that a library has not had, each with its version in one commit; the versions reached."""
    have = lib.store.state["schema"] or 0
    if have > SCHEMA_VERSION:
        raise TooNew(f"written by a newer version ({have})")
    done = []
    for version, step in STEPS:
        if version > have:
            with lib.store.change():
                step(lib)
                lib.store.set_schema(version)
            done.append(version)
    return done
