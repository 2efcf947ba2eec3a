"""What a library lacks, made up for in two stages: content hashes, then vectors.

One run at a time: a lease in the library's own tables, taken by a commit that
fails if another took it first, and given up when it is not renewed in time. Each
slice of a stage is one commit together with the lease's renewal, so a run that
was cancelled or lost goes on where it stopped, and nothing stored is made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.library import Library, deck_id
from pagelore.operators import vectors
from pagelore.sources import scan
from pagelore.store import Conflict

NAME = "backfill"


class Busy(RuntimeError):
    """Another run holds the lease."""


class Cancelled(RuntimeError):
    pass


class Backfill:
    def __init__(self, library: Library, slices: int = 16, seconds: int = 120):
        """slices: commits of a stage; seconds: how long a slice may take before others may take over."""
        self.lib, self.slices, self.seconds = library, slices, seconds
        self.owner = uuid.uuid4().hex
        self.tag = f"pagelore-backfill-{self.owner}"

    def _lease(self):
        return self.lib.table("leases").where(F.col("name") == NAME).first()

    def _hold(self, cancelled: bool = False, owner: str | None = None, until: int | None = None) -> None:
        row = (NAME, owner or self.owner, self.lib.now() + self.seconds if until is None else until, cancelled)
        self.lib.store.replace("leases", None, self.lib.rows("leases", [row]), small=True)

    def _take(self) -> None:
        try:
            with self.lib.store.change():
                have = self._lease()
                if have is not None and have.until_unix > self.lib.now() and have.owner != self.owner:
                    raise Busy(f"held by {have.owner}")
                self._hold()
        except Conflict as e:
            raise Busy("another run was first") from e

    def _commit(self, store: Callable[[], None], done: dict, what: str, n: int) -> None:
        """One slice and the lease's renewal, counted in done. What was made is kept even if the run was cancelled meanwhile; then it ends."""
        while True:
            kept = False
            try:
                with self.lib.store.change():
                    have = self._lease()
                    mine = have is not None and have.owner == self.owner
                    if mine or have is None or have.until_unix <= self.lib.now():
                        store()
                        kept = True
                    if mine and not have.cancelled:
                        self._hold()
                break
            except Conflict:  # a cancellation or another table's change came between: look again
                continue
        done[what] += n * kept
        if not mine or have.cancelled:
            raise Cancelled

    def run(self, on_progress: Callable[[str, int], None] = lambda stage, n: None) -> dict:
        """hashed (slides), embedded (texts), cancelled. Busy if another run is on."""
        self._take()
        done = {"hashed": 0, "embedded": 0, "cancelled": False}
        spark = self.lib.spark
        spark.addTag(self.tag)
        try:
            for i in range(self.slices):
                self._hash(i, done)
                on_progress("hashed", done["hashed"])
            if self.lib.embedder is not None:
                for i in range(self.slices):
                    self._embed(i, done)
                    on_progress("embedded", done["embedded"])
        except Cancelled:
            done["cancelled"] = True
        except Exception:
            self.lib.store.refresh()
            have = self._lease()
            if have is None or not have.cancelled:
                raise
            done["cancelled"] = True  # a job was interrupted
        finally:
            spark.removeTag(self.tag)
        self._release()
        return done

    def _release(self) -> None:
        while True:
            try:
                with self.lib.store.change():
                    have = self._lease()
                    if have is not None and have.owner == self.owner:
                        self.lib.store.delete("leases", self.lib._keys("leases", (NAME,)), small=True)
                return
            except Conflict:
                continue

    def _slice(self, key: str, i: int):
        return F.pmod(F.xxhash64(key), F.lit(self.slices)) == i

    def _hash(self, i: int, done: dict) -> None:
        """Content hashes of the slides of a slice of the decks that lack some, read from their files."""
        lib = self.lib
        lib.store.refresh()
        need = vectors.work_table(lib.decks_needing_hashes().where(self._slice("path", i)), "unhashed")
        for part in scan.contents(lib.spark, "", need, 1 << 62):
            read = scan.extracted(part).where("error IS NULL").select(deck_id(F.col("path")).alias("deck_id"), F.explode("slides").alias("s"))
            found = vectors.work_table(read.select("deck_id", "s.slide_index", F.col("s.content_hash").alias("fresh")), "hashes")

            def store(found: DataFrame = found) -> None:
                rows = lib.table("slides").join(found.select("deck_id").distinct(), "deck_id", "left_semi").join(found, ["deck_id", "slide_index"], "left")
                lib.store.replace("slides", None, rows.withColumn("content_hash", F.coalesce("content_hash", "fresh")).drop("fresh"))

            if n := found.count():
                self._commit(store, done, "hashed", n)

    def _embed(self, i: int, done: dict) -> None:
        """Vectors of a slice of the texts that have none."""
        lib, e = self.lib, self.lib.embedder
        lib.store.refresh()
        new = vectors.work_table(vectors.embedded(lib.pending_texts().where(self._slice("text_hash", i)), e.embed_passages, e.id, e.dims), "vectors")
        if n := new.count():
            self._commit(lambda: lib.store.append("embeddings", new), done, "embedded", n)

    def cancel(self) -> bool:
        """Ends the run that holds the lease, whoever began it: its jobs are interrupted here, its next commit ends it elsewhere. Whether there was one."""
        while True:
            try:
                with self.lib.store.change():
                    have = self._lease()
                    if have is None or have.until_unix <= self.lib.now():
                        return False
                    self._hold(cancelled=True, owner=have.owner, until=have.until_unix)
                self.lib.spark.interruptTag(f"pagelore-backfill-{have.owner}")
                return True
            except Conflict:
                continue
