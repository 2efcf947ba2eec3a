"""A library: tables in a folder, scanned, searched and changed through one object."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from pagelore import migrations
from pagelore.functions import text
from pagelore.operators import duplicates, filters, fulltext, stats, vectors
from pagelore.operators.filters import Filters
from pagelore.operators.segments import Index
from pagelore.plans import query_parser
from pagelore.plans.query_parser import Parsed
from pagelore.schema import (
    DEFAULT_LIMIT,
    EXPORT_CAP,
    FALLBACK_SNIPPET,
    HYBRID_POOL,
    KEYS,
    NEAR_DUP_NEIGHBOURS,
    NEAR_DUP_THRESHOLD,
    REFINEMENT_SECONDS,
    SCAN_CAP,
    SEARCH_CAP,
    SEMANTIC_FLOOR,
    SIMILAR_FLOOR,
    SORTS,
    TABLES,
    struct,
)
from pagelore.sources import scan
from pagelore.store import Store


class LibraryError(ValueError):
    """A request that the library can't meet."""


def deck_id(path: F.Column) -> F.Column:
    return F.xxhash64(path)


class Library:
    """Tables of one store: a change of the library is one commit, a frame that was taken before goes on reading its version."""

    def __init__(self, spark: SparkSession, path: str, embedder: vectors.FakeEmbedder | None = None):
        self.spark, self.path, self.embedder, self.floor = spark, path.rstrip("/"), embedder, SEMANTIC_FLOOR
        #: What the parts of a text to embed lose at their ends.
        self.trim: Callable[[F.Column | str], F.Column] = text.trimmed
        self.store = Store(spark, self.path, {n: struct(n) for n in TABLES}, KEYS, SORTS)
        self.index = Index(self.store)
        self._fs, self._path = self.store.fs, self.store._hadoop
        self.now: Callable[[], int] = lambda: int(time.time())
        try:
            migrations.bring_up(self)
        except migrations.TooNew as e:
            raise LibraryError(str(e)) from e

    @staticmethod
    def present(spark: SparkSession, path: str) -> bool:
        """Whether a folder, in whatever file system, holds a library of this or an earlier version."""
        at = spark._jvm.org.apache.hadoop.fs.Path
        fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        return any(fs.exists(at(f"{path}/{x}")) for x in ("_log", "_current.json"))

    # Tables

    def table(self, name: str) -> DataFrame:
        """A table; columns that an older version did not write are null."""
        return self.store.read(name)

    def put(self, name: str, rows: DataFrame) -> None:
        self.store.put(name, rows)

    def rows(self, name: str, values: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(values, struct(name))

    def _keys(self, name: str, *values: tuple) -> DataFrame:
        """Keys of a table, as rows."""
        fields = [struct(name)[k] for k in KEYS[name]]
        return self.spark.createDataFrame(list(values), T.StructType(fields))

    def _next_id(self, name: str) -> int:
        return self.table(name).agg(F.coalesce(F.max("id") + 1, F.lit(1))).first()[0]

    # Roots

    def roots(self) -> DataFrame:
        return stats.root_counts(self.table("roots"), self.table("decks"), self.table("slides"))

    def add_root(self, path: str) -> int:
        """The id of a root; adding it again changes nothing."""
        have = self.table("roots").where(F.col("path") == path).first()
        if have:
            return have.id
        new = self._next_id("roots")
        self.store.append("roots", self.rows("roots", [(new, path, None, [])]), small=True)
        return new

    def remove_root(self, root_id: int) -> None:
        with self.store.change():
            self._drop_decks(self.table("decks").where(F.col("root_id") == root_id).select("id"))
            self.store.delete("roots", self._keys("roots", (root_id,)), small=True)

    def set_root_excludes(self, root_id: int, patterns: list[str]) -> None:
        """Trimmed, blanks dropped; all are checked before any is stored."""
        clean = [p.strip() for p in patterns if p.strip()]
        for p in clean:
            try:
                scan.glob_regex(p)
            except ValueError as e:
                raise LibraryError(str(e)) from e
        if self.table("roots").where(F.col("id") == root_id).isEmpty():
            raise LibraryError(f"no root {root_id}")
        new = F.array(*[F.lit(p) for p in clean]).cast("array<string>")
        self.store.replace("roots", None, self.table("roots").where(F.col("id") == root_id).withColumn("exclude_globs", new), small=True)

    def clear(self) -> None:
        """Drops what a scan can rebuild and the histories; keeps roots, favorites, tags, saved searches and vectors."""
        with self.store.change():
            for name in ("decks", "slides", "deck_fonts", "scan_history", "scan_issues", "search_history", "export_history", "export_picks", "render_issues"):
                self.put(name, self.table(name).limit(0))
            self.index.clear()
            self.put("roots", self.table("roots").withColumn("last_scan_unix", F.lit(None).cast("long")))

    def _drop_decks(self, ids: DataFrame) -> None:
        ids = vectors.work_table(ids.select(F.col("id").alias("deck_id")), "gone")
        with self.store.change():
            for name in ("slides", "deck_fonts"):
                self.store.delete(name, ids)
            self.index.drop(ids)
            self.store.delete("decks", ids.withColumnRenamed("deck_id", "id"))

    # Scan

    def scan(self, on_event: Callable[[dict], None] = lambda e: None) -> dict:
        """Brings the tables up to date with the roots: unchanged files are skipped, broken ones reported, vanished ones dropped unless their root is unavailable."""
        with self.store.change():
            return self._scan(on_event)

    def _scan(self, on_event: Callable[[dict], None]) -> dict:
        began, started = time.time(), self.now()
        tally = {"indexed": 0, "removed": 0, "unchanged": 0, "skipped": 0}
        issues: list[tuple[str, str]] = []
        gone: list[int] = []
        for r in sorted(self.table("roots").collect(), key=lambda r: r.id):
            if not self._fs.exists(self._path(r.path)):
                issues.append((r.path, "unavailable"))
                continue
            on_event({"kind": "started", "root": r.path})
            found = vectors.work_table(scan.listing(self.spark, r.id, r.path, list(r.exclude_globs or [])), "listing")
            mine = self.table("decks").where(F.col("root_id") == r.id)
            changed, same = scan.changes(found, mine)
            tally["unchanged"] += same.count()
            changed = vectors.work_table(changed, "changed")
            lost = vectors.work_table(scan.vanished(found, mine).select("id"), "vanished")
            tally["removed"] += (n := lost.count())
            if n:
                self._drop_decks(lost)
            for part in scan.contents(self.spark, r.path, changed, found.count()):
                read = vectors.work_table(scan.extracted(part).join(changed, "path"), "extracted")
                for e in read.where("error IS NOT NULL").select("path", "error").toLocalIterator():
                    issues.append((e.path, e.error))
                    tally["skipped"] += 1
                    on_event({"kind": "skipped", "path": e.path, "reason": e.error})
                good = read.where("error IS NULL")
                tally["indexed"] += (n := good.count())
                if n:
                    self._index(good)
            gone.append(r.id)
        self.put("roots", self.table("roots").withColumn("last_scan_unix", F.when(F.col("id").isin(gone), F.lit(self.now())).otherwise(F.col("last_scan_unix"))))
        self._record_scan(started, int((time.time() - began) * 1000), tally, issues)
        self.cleanup_orphan_embeddings()
        on_event({"kind": "finished", **tally})
        return tally | {"issues": issues}

    def _index(self, good: DataFrame) -> None:
        """Rows of these decks in place of what the tables hold of them; nothing else is rewritten."""
        old = self.table("decks").select("path", F.col("first_seen_unix").alias("seen"))
        decks = good.join(old, "path", "left").select(deck_id(F.col("path")).alias("id"), "root_id", "path", "file_name", "title", "author", F.size("slides").cast("long").alias("slide_count"), "modified_unix", "size_bytes", F.col("width").alias("slide_width_emu"), F.col("height").alias("slide_height_emu"), "file_hash", F.coalesce("seen", F.lit(self.now())).alias("first_seen_unix"))
        each = good.select(deck_id(F.col("path")).alias("deck_id"), "path", F.explode("slides").alias("s")).select("deck_id", "path", "s.*")
        slides = each.select(F.xxhash64("path", "slide_index").alias("id"), "deck_id", "slide_index", "title", "body_text", "notes", F.lit(None).cast("string").alias("thumb_path"), "content_hash", text.text_hash("title", "body_text", "notes").alias("text_hash"))
        fonts = good.select(deck_id(F.col("path")).alias("deck_id"), F.explode("fonts").alias("f")).select("deck_id", "f.*")
        new = good.select(deck_id(F.col("path")).alias("deck_id"))
        known = not self.table("decks").join(new.withColumnRenamed("deck_id", "id"), "id", "left_semi").isEmpty()
        for name, rows in (("slides", slides), ("deck_fonts", fonts)):
            self.store.replace(name, new, rows)
        named = good.select(deck_id(F.col("path")).alias("deck_id"), F.concat_ws(" ", "title", "file_name").alias("deck_title"))
        words = slides.select("deck_id", F.col("id").alias("slide_id"), "title", F.col("body_text").alias("body"), "notes").join(named, "deck_id")
        self.store.replace("decks", None, decks)
        self.index.add(words, replaced=known)

    def _record_scan(self, started: int, ms: int, tally: dict, issues: list[tuple[str, str]]) -> None:
        new = self._next_id("scan_history")
        row = (new, started, ms, tally["indexed"], tally["removed"], tally["unchanged"], tally["skipped"])
        history = stats.kept_last(self.table("scan_history").unionByName(self.rows("scan_history", [row])), SCAN_CAP)
        first = self._next_id("scan_issues")
        found = self.rows("scan_issues", [(first + i, new, p, why) for i, (p, why) in enumerate(issues)])
        with self.store.change():
            self.put("scan_history", history)
            self.put("scan_issues", self.table("scan_issues").unionByName(found).join(self.table("scan_history").select(F.col("id").alias("scan_id")), "scan_id", "left_semi"))

    # Reading

    def decks(self) -> DataFrame:
        return filters.deck_records(self.table("decks"), self.table("deck_favorites")).orderBy(F.desc("modified_unix"), "id")

    def slides_for_deck(self, deck: int) -> DataFrame:
        return self.slides().where(F.col("deck_id") == deck).orderBy("slide_index")

    def slides(self) -> DataFrame:
        return filters.slide_records(self.table("slides"), self.table("decks"), self.table("slide_favorites"))

    def slide(self, slide_id: int):
        row = self.slides().where(F.col("id") == slide_id).first()
        if row is None:
            raise LibraryError(f"no slide {slide_id}")
        return row

    def deck(self, id_: int):
        row = self.decks().where(F.col("id") == id_).first()
        if row is None:
            raise LibraryError(f"no deck {id_}")
        return row

    def stats_overview(self) -> DataFrame:
        return stats.overview({n: self.table(n) for n in TABLES})

    # Search

    def _admitted(self, f: Filters) -> DataFrame | None:
        if not f.active:
            return None
        t = self.table
        return filters.admitted(t("slides"), t("decks"), t("slide_favorites"), t("slide_tags"), f).select(F.col("id").alias("slide_id"))

    def _fulltext(self, parsed: Parsed, f: Filters, limit: int) -> DataFrame:
        return self.index.top(parsed, limit, self._admitted(f))

    def browse(self, f: Filters = Filters(), limit: int | None = None) -> DataFrame:
        t = self.table
        return filters.browse(t("slides"), t("decks"), t("slide_favorites"), t("slide_tags"), t("export_picks"), f, limit or f.limit or DEFAULT_LIMIT).select("slide_id", "score", "snippet")

    def _memo(self, name: str, stamp: str, make: Callable[[], None]) -> bool:
        """Makes a stored result anew if what it comes from has changed since, in one commit; whether it did."""
        have = self.table("memos").where(F.col("name") == name).first()
        if have is not None and have.stamp == stamp:
            return False
        with self.store.change():
            make()
            self.store.replace("memos", None, self.rows("memos", [(name, stamp)]), small=True)
        return True

    def vector_store(self) -> DataFrame:
        """slide_id, text_hash, vector of each embedded slide: stored, and brought up to date for the slides that changed only."""
        self._memo("slide_vectors", self.store.stamp("slides", "embeddings", extra=[self.embedder.id, self.embedder.dims]), self._refresh_vectors)
        return self.table("slide_vectors").select("slide_id", "text_hash", "vector")

    def _refresh_vectors(self) -> None:
        model, dims = self.embedder.id, self.embedder.dims
        e = self.table("embeddings").where((F.col("model_id") == model) & (F.size("vector") == dims))
        s = self.table("slides").where(F.col("text_hash").isNotNull()).select(F.col("id"), "text_hash")
        wanted = s.join(e.select("text_hash"), "text_hash", "left_semi").select(F.lit(model).alias("model_id"), F.col("id").alias("slide_id"), "text_hash")
        have, keys = self.table("slide_vectors").select("model_id", "slide_id", "text_hash"), ["model_id", "slide_id", "text_hash"]
        lost = vectors.work_table(have.join(wanted, keys, "left_anti").select("slide_id"), "lost")
        new = vectors.work_table(wanted.join(have, keys, "left_anti"), "new")
        self.refreshed = new.count()
        if self.refreshed or lost.count():
            fresh = vectors.store(new.select(F.col("slide_id").alias("id"), "text_hash"), e, model, dims)
            self.store.replace("slide_vectors", lost.unionByName(new.select("slide_id")), fresh.withColumn("model_id", F.lit(model)))

    def near_clusters(self, threshold: float = NEAR_DUP_THRESHOLD, top: int = NEAR_DUP_NEIGHBOURS) -> DataFrame:
        """slide_id, cluster: made once for each state of the vectors and each setting, then read."""
        store = self.vector_store()
        self._memo("clusters", self.store.stamp("slide_vectors", extra=[threshold, top]), lambda: self.put("clusters", vectors.clusters(store, threshold, top)))
        return self.table("clusters")

    def _vector_pool(self, query: str, f: Filters, limit: int, digits: int | None = None) -> DataFrame:
        v, ok = self.vector_store(), self._admitted(f)
        v = v if ok is None else v.join(ok, "slide_id", "left_semi")
        return vectors.top_k(v, self.embedder.embed_query(query), limit, self.floor, digits=digits)

    def search(self, query: str = "", f: Filters = Filters(), digits: int | None = None) -> DataFrame:
        """slide_id, score, snippet, best first. Nothing a user types is an error. With ``digits``, cosines rank as they are rounded to so many."""
        parsed = query_parser.parse(query)
        f = f.narrowed(parsed.after, parsed.before)
        limit = f.limit or DEFAULT_LIMIT
        if f.mode in ("semantic", "hybrid") and self.embedder and parsed.semantic_text:
            if f.mode == "semantic":
                return self._shown(self._vector_pool(parsed.semantic_text, f, limit, digits), None)
            words = parsed if parsed.groups else query_parser.plain(parsed.residual)
            arms = [self._vector_pool(parsed.semantic_text, f, HYBRID_POOL, digits)]
            if words.groups:
                arms.insert(0, self._fulltext(words, f, HYBRID_POOL))
            fused = fulltext.top(vectors.rrf([vectors.ranked(a) for a in arms]), limit)
            return self._shown(fused, words if words.groups else None)
        words = parsed if parsed.groups else query_parser.plain(parsed.residual)
        if not words.groups:
            return self.browse(f, limit)
        return self._shown(self._fulltext(words, f, limit), words)

    def _shown(self, found: DataFrame, parsed: Parsed | None) -> DataFrame:
        """With snippets: bodies are joined to the hits that are left."""
        body = self.table("slides").select(F.col("id").alias("slide_id"), "body_text")
        snippet = fulltext.snippet_column("body_text", parsed) if parsed else text.cut_snippet("body_text", FALLBACK_SNIPPET)
        return found.join(body, "slide_id").select("slide_id", "score", snippet.alias("snippet")).orderBy(F.desc("score"), "slide_id")

    def similar(self, slide_id: int, limit: int = 12) -> DataFrame:
        return vectors.similar(self.vector_store(), slide_id, limit, SIMILAR_FLOOR)

    def duplicate_groups(self) -> DataFrame:
        near = self.near_clusters() if self.embedder else None
        return duplicates.groups(self.table("slides"), self.table("decks"), self.vector_store() if self.embedder else None, clusters=near)

    # Vectors

    def pending_texts(self) -> DataFrame:
        """text_hash, text of each distinct text without a vector."""
        have = self.table("embeddings").where(F.col("model_id") == self.embedder.id).select("text_hash")
        rows = self.table("slides").where("text_hash IS NOT NULL").join(have, "text_hash", "left_anti")
        return rows.groupBy("text_hash").agg(F.min_by(text.embed_text("title", "body_text", "notes", self.trim), "id").alias("text"))

    def embed_missing(self) -> int:
        new = vectors.work_table(vectors.embedded(self.pending_texts(), self.embedder.embed_passages, self.embedder.id, self.embedder.dims), "vectors")
        n = new.count()
        if n:
            self.store.append("embeddings", new)
        return n

    def orphan_embeddings(self) -> DataFrame:
        """model_id and text_hash of vectors that no slide's text has."""
        return self.table("embeddings").join(self.table("slides").select("text_hash"), "text_hash", "left_anti").select("model_id", "text_hash")

    def cleanup_orphan_embeddings(self) -> int:
        lost = vectors.work_table(self.orphan_embeddings(), "orphans")
        if n := lost.count():
            self.store.delete("embeddings", lost)
        return n

    def embedding_counts(self) -> DataFrame:
        return stats.embedding_counts(self.table("slides"), self.table("embeddings"), self.embedder.id if self.embedder else "")

    # Favorites and tags (kept by path and index, so that they survive rescans)

    def _place(self, slide_id: int) -> tuple[str, int]:
        r = self.slide(slide_id)
        return r.deck_path, r.slide_index

    def toggle_all(self, name: str, keys: DataFrame, small: bool = False) -> None:
        """Of these keys of slide_favorites or deck_favorites, those that are marked are no more, the others are: in one commit."""
        cols = KEYS[name]
        keys = vectors.work_table(keys.select(cols).distinct(), "toggled")
        marked = vectors.work_table(self.table(name).select(cols).join(keys, cols, "left_semi"), "marked")
        with self.store.change():
            self.store.delete(name, marked, small)
            self.store.append(name, keys.join(marked, cols, "left_anti").withColumn("added_unix", F.lit(self.now())), small)

    def _toggle(self, name: str, key: dict) -> bool:
        self.toggle_all(name, self._keys(name, tuple(key.values())), small=True)
        return not self.table(name).join(self._keys(name, tuple(key.values())), list(key), "left_semi").isEmpty()

    def toggle_slide_favorite(self, slide_id: int) -> bool:
        path, index = self._place(slide_id)
        return self._toggle("slide_favorites", {"deck_path": path, "slide_index": index})

    def toggle_deck_favorite(self, id_: int) -> bool:
        return self._toggle("deck_favorites", {"deck_path": self.deck(id_).path})

    def tags(self) -> DataFrame:
        return stats.tag_counts(self.table("tags"), self.table("slide_tags"), self.table("decks"), self.table("slides"))

    def slide_tags(self, slide_id: int) -> DataFrame:
        path, index = self._place(slide_id)
        mine = self.table("slide_tags").where((F.col("deck_path") == path) & (F.col("slide_index") == index)).select(F.col("tag_id").alias("id"))
        return self.table("tags").join(mine, "id", "left_semi").orderBy(F.lower("name"))

    def set_slide_tags(self, slide_id: int, names: list[str]) -> None:
        """Replaces a slide's tags: names are trimmed, known ones are found whatever their case, unused ones go."""
        path, index = self._place(slide_id)
        wanted: dict[str, str] = {}
        for n in names:
            if n.strip():
                wanted.setdefault(n.strip().lower(), n.strip())
        tags = self.table("tags")
        known = {r.name.lower(): r.id for r in tags.where(F.lower("name").isin(list(wanted))).collect()} if wanted else {}
        first = self._next_id("tags")
        fresh = [(first + i, wanted[k], self.now()) for i, k in enumerate(k for k in wanted if k not in known)]
        links = [(i, path, index) for i in [*known.values(), *(x[0] for x in fresh)]]
        with self.store.change():
            self.store.replace("slide_tags", self._keys("slide_tags", (path, index)), self.rows("slide_tags", links), small=True)
            if fresh:
                self.store.append("tags", self.rows("tags", fresh), small=True)
            unused = [(r.id,) for r in self.table("tags").join(self.table("slide_tags").select(F.col("tag_id").alias("id")), "id", "left_anti").select("id").collect()]
            if unused:
                self.store.delete("tags", self._keys("tags", *unused), small=True)

    def rename_tag(self, tag_id: int, name: str) -> None:
        name, tags = name.strip(), self.table("tags")
        if not name:
            raise LibraryError("a tag needs a name")
        if not tags.where((F.lower("name") == name.lower()) & (F.col("id") != tag_id)).isEmpty():
            raise LibraryError(f"there is a tag {name}")
        if tags.where(F.col("id") == tag_id).isEmpty():
            raise LibraryError(f"no tag {tag_id}")
        self.store.replace("tags", None, tags.where(F.col("id") == tag_id).withColumn("name", F.lit(name)), small=True)

    def delete_tag(self, tag_id: int) -> None:
        with self.store.change():
            # Links are keyed by their slide: slides with the tag keep their other links.
            mine = self.table("slide_tags").where(F.col("tag_id") == tag_id).select("deck_path", "slide_index")
            kept = self.table("slide_tags").where(F.col("tag_id") != tag_id).join(mine, ["deck_path", "slide_index"], "left_semi")
            self.store.replace("slide_tags", mine, kept)
            self.store.delete("tags", self._keys("tags", (tag_id,)), small=True)

    # Saved searches and histories

    def saved_searches(self) -> DataFrame:
        return self.table("saved_searches").orderBy("position", "id")

    def save_search(self, name: str, query: str, f: Filters = Filters()) -> int:
        t, new = self.table("saved_searches"), self._next_id("saved_searches")
        place = t.agg(F.coalesce(F.max("position") + 1, F.lit(0))).first()[0]
        self.store.append("saved_searches", self.rows("saved_searches", [(new, name.strip() or query, query, tuple(asdict(f).values()), place, self.now())]), small=True)
        return new

    def rename_saved_search(self, id_: int, name: str) -> None:
        if not name.strip():
            raise LibraryError("a saved search needs a name")
        mine = self.table("saved_searches").where(F.col("id") == id_)
        self.store.replace("saved_searches", None, mine.withColumn("name", F.lit(name.strip())), small=True)

    def delete_saved_search(self, id_: int) -> None:
        self.store.delete("saved_searches", self._keys("saved_searches", (id_,)), small=True)

    def record_search(self, query: str, count: int) -> None:
        """Appends a search, or replaces the last one if this refines it."""
        query = query.strip()
        if not query:
            return
        t, now = self.table("search_history"), self.now()
        last = stats.latest(t).first()
        refines = last is not None and now - last.searched_unix <= REFINEMENT_SECONDS and (query.startswith(last.query) or last.query.startswith(query))
        new = last.id if refines else self._next_id("search_history")
        with self.store.change():
            self.store.replace("search_history", None, self.rows("search_history", [(new, query, count, now)]), small=True)
            self._trim("search_history", SEARCH_CAP)

    def record_export(self, output: str, title: str, picks: list[tuple[str, int]]) -> None:
        new, first = self._next_id("export_history"), self._next_id("export_picks")
        row = (new, output, title, len(picks), len({p for p, _ in picks}), self.now())
        with self.store.change():
            self.store.append("export_history", self.rows("export_history", [row]), small=True)
            self.store.append("export_picks", self.rows("export_picks", [(first + i, new, p, n) for i, (p, n) in enumerate(picks)]), small=True)
            gone = self._trim("export_history", EXPORT_CAP)
            if gone:
                self.store.delete("export_picks", self._keys("export_picks", *gone), small=True)

    def _trim(self, name: str, cap: int) -> list[tuple[int]]:
        """Drops all but the last ``cap`` rows of a history, which has one row more at most; the ids that went."""
        t = self.table(name)
        gone = [(r.id,) for r in t.join(stats.kept_last(t, cap).select("id"), "id", "left_anti").select("id").collect()]
        if gone:
            self.store.delete(name, self._keys(name, *gone), small=True)
        return gone

    def export_counts(self) -> DataFrame:
        return stats.export_counts(self.table("export_picks"))

    # Drawing issues, thumbnails, fonts

    def record_render_issues(self, deck_path: str, slide_index: int, content_hash: str, dropped: list[str]) -> None:
        rows = [(deck_path, slide_index, content_hash, sorted(set(dropped)), self.now())] if dropped else []
        self.store.replace("render_issues", self._keys("render_issues", (deck_path, slide_index)), self.rows("render_issues", rows), small=True)

    def render_issues_for(self, deck_path: str, slide_index: int, content_hash: str) -> list[str]:
        """None if they were found in other contents."""
        r = self.table("render_issues").where((F.col("deck_path") == deck_path) & (F.col("slide_index") == slide_index) & (F.col("content_hash") == content_hash)).first()
        return list(r.dropped or []) if r else []

    def render_drops(self) -> DataFrame:
        return stats.render_drops(self.table("render_issues"), self.table("decks"))

    def set_thumb_path(self, slide_id: int, path: str) -> None:
        t = self.table("slides")
        deck = t.where(F.col("id") == slide_id).select("deck_id")  # rows of one deck change together
        self.store.replace("slides", None, t.join(deck, "deck_id", "left_semi").withColumn("thumb_path", F.when(F.col("id") == slide_id, path).otherwise(F.col("thumb_path"))), small=True)

    def sweep_thumbs(self, folder: str) -> int:
        """Deletes the thumbnails in a local folder that no current deck claims."""
        d = stats.deck_hashes(self.table("decks"))
        names = [n for n in os.listdir(folder) if n.count("_") == 2]
        if not names:
            return 0
        have = self.spark.createDataFrame([(n, n.split("_")[0], n.split("_")[2].split(".")[0]) for n in names], "name string, p string, h string")
        dead = [r.name for r in have.join(d, ["p", "h"], "left_anti").collect()]
        for n in dead:
            os.remove(os.path.join(folder, n))
        return len(dead)

    def font_families(self) -> DataFrame:
        return stats.font_families(self.table("deck_fonts"))

    def decks_with_embedded_fonts(self) -> DataFrame:
        f = self.table("deck_fonts").where("embedded").select(F.col("deck_id").alias("id"))
        return self.table("decks").join(f, "id", "left_semi").select("path")

    def decks_needing_hashes(self) -> DataFrame:
        s = self.table("slides").where("content_hash IS NULL").select(F.col("deck_id").alias("id"))
        return self.table("decks").join(s, "id", "left_semi").select("path")
