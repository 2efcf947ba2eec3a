"""Structured filters over slides and decks, browse orders and records."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text
from pagelore.schema import BROWSE_SNIPPET


@dataclass(frozen=True)
class Filters:
    """All optional; they narrow each other. limit, sort and mode say how to answer, not what to admit."""

    deck_query: str | None = None
    path_prefix: str | None = None
    modified_from: int | None = None
    modified_to: int | None = None
    favorites_only: bool = False
    tag_id: int | None = None
    limit: int | None = None
    sort: str | None = None
    mode: str | None = None

    @property
    def active(self) -> bool:
        return bool((self.deck_query or "").strip() or self.path_prefix or self.modified_from is not None or self.modified_to is not None or self.favorites_only or self.tag_id is not None)

    def narrowed(self, after: int | None, before: int | None) -> Filters:
        """With the dates of a query, which can only narrow the filter's own."""
        low = [x for x in (self.modified_from, after) if x is not None]
        high = [x for x in (self.modified_to, before) if x is not None]
        return replace(self, modified_from=max(low, default=None), modified_to=min(high, default=None))


def deck_predicates(f: Filters) -> list[Column]:
    """Predicates on deck columns. Date bounds are bare comparisons, so they reach the scan."""
    out = []
    if (f.deck_query or "").strip():
        q = f.deck_query.strip().lower()
        out.append(F.lower("file_name").contains(q) | F.lower("title").contains(q))
    if f.path_prefix:
        out.append(F.startswith(F.lower("path"), F.lit(f.path_prefix.lower())))
    if f.modified_from is not None:
        out.append(F.col("modified_unix") >= f.modified_from)
    if f.modified_to is not None:
        out.append(F.col("modified_unix") <= f.modified_to)
    return out


def filtered_decks(decks: DataFrame, f: Filters) -> DataFrame:
    for p in deck_predicates(f):
        decks = decks.where(p)
    return decks


def slides_with_decks(slides: DataFrame, decks: DataFrame) -> DataFrame:
    """slides ⋈ decks; columns of decks that slides has too get the prefix deck_."""
    both = set(slides.columns) - {"deck_id"}
    d = decks.select(*[F.col(c).alias("deck_id" if c == "id" else f"deck_{c}" if c in both else c) for c in decks.columns])
    return slides.join(d, "deck_id")


def admitted(slides: DataFrame, decks: DataFrame, favorites: DataFrame, slide_tags: DataFrame, f: Filters) -> DataFrame:
    """id, deck_id, slide_index, path of the slides that the filters admit: decks are filtered before the join, favorites and tags are semi-joins."""
    d = filtered_decks(decks, f).select(F.col("id").alias("deck_id"), "path")
    out = slides.select("id", "deck_id", "slide_index").join(d, "deck_id")
    if f.favorites_only:
        out = out.join(favorites.select(F.col("deck_path").alias("path"), "slide_index"), ["path", "slide_index"], "left_semi")
    if f.tag_id is not None:
        out = out.join(slide_tags.where(F.col("tag_id") == f.tag_id).select(F.col("deck_path").alias("path"), "slide_index"), ["path", "slide_index"], "left_semi")
    return out.select("id", "deck_id", "slide_index", "path")


def with_flag(rows: DataFrame, marks: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """rows with a boolean: whether marks holds their key (row column -> marks column)."""
    m = marks.select(*[F.col(b).alias(f"__{b}") for b in keys.values()]).distinct().withColumn("__hit", F.lit(True))
    on = [rows[a] == m[f"__{b}"] for a, b in keys.items()]
    return rows.join(m, on, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit", *[f"__{b}" for b in keys.values()])


def deck_records(decks: DataFrame, deck_favorites: DataFrame) -> DataFrame:
    return with_flag(decks, deck_favorites, {"path": "deck_path"}, "favorite")


def slide_records(slides: DataFrame, decks: DataFrame, slide_favorites: DataFrame) -> DataFrame:
    s = slides.join(decks.select(F.col("id").alias("deck_id"), F.col("path").alias("deck_path")), "deck_id")
    return with_flag(s, slide_favorites, {"deck_path": "deck_path", "slide_index": "slide_index"}, "favorite")


def hits(slides: DataFrame, decks: DataFrame) -> DataFrame:
    """slide and deck as nested records."""
    s = slides.select(F.col("id").alias("slide_id"), F.col("deck_id"), F.struct(*slides.columns).alias("slide"))
    d = decks.select(F.col("id").alias("deck_id"), F.struct(*decks.columns).alias("deck"))
    return s.join(d, "deck_id").select("slide_id", "slide", "deck")


def browse_order(sort: str | None) -> list[Column]:
    """Orders of slides joined with decks (and n_exports for 'exported')."""
    tail = [F.col("deck_id"), F.col("slide_index")]
    return {
        "name": [F.lower("file_name"), *tail],
        "added": [F.desc("first_seen_unix"), *tail],
        "exported": [F.desc("n_exports"), F.desc("modified_unix"), *tail],
    }.get(sort or "", [F.desc("modified_unix"), *tail])


def browse(slides: DataFrame, decks: DataFrame, favorites: DataFrame, slide_tags: DataFrame, picks: DataFrame, f: Filters, limit: int) -> DataFrame:
    """slide_id, deck_id, slide_index, score 0, snippet in browse order: limit is a top-k over ids; text is joined after it."""
    order = browse_order(f.sort)
    rows = admitted(slides, decks, favorites, slide_tags, f).join(decks.select(F.col("id").alias("deck_id"), "file_name", "modified_unix", "first_seen_unix"), "deck_id")
    if f.sort == "exported":
        counts = picks.groupBy(F.col("deck_path").alias("path")).agg(F.count(F.lit(1)).alias("n_exports"))
        rows = rows.join(counts, "path", "left").withColumn("n_exports", F.coalesce("n_exports", F.lit(0)))
    top = rows.orderBy(*order).limit(limit)
    shown = top.join(slides.select("id", "body_text"), "id")
    return shown.orderBy(*order).select(F.col("id").alias("slide_id"), "deck_id", "slide_index", F.lit(0.0).alias("score"), text.cut_snippet("body_text", BROWSE_SNIPPET).alias("snippet"))
