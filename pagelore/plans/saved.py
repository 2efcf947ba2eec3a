"""What the window shows of a request: scopes, saved searches, orders, states."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text
from pagelore.operators.filters import Filters


def of_place(kind: str, value: str | int | None = None) -> Filters:
    """The filter of a place in the window: all, root, favorites, tag."""
    return {"root": Filters(path_prefix=str(value)), "favorites": Filters(favorites_only=True), "tag": Filters(tag_id=value if isinstance(value, int) else None)}.get(kind, Filters())


def as_query(query: str, f: Filters) -> str:
    """A query with the scopes of older saved filters that it can express."""
    day = lambda unix: datetime.fromtimestamp(unix, UTC).strftime("%Y-%m-%d")
    deck = (f.deck_query or "").replace('"', "").strip()
    scopes = [f'deck:"{deck}"'] if deck else []
    scopes += [f"after:{day(f.modified_from)}"] if f.modified_from is not None else []
    scopes += [f"before:{day(f.modified_to)}"] if f.modified_to is not None else []
    return " ".join([*scopes, query]).strip()


def contiguous(hits: DataFrame, sort: str, counts: DataFrame | None = None) -> DataFrame:
    """Loaded browse hits in an order that keeps each deck's slides together."""
    tail = [F.col("deck_id"), F.col("slide_index"), F.col("slide_id")]
    if sort == "exported" and counts is not None:
        hits = hits.join(counts.withColumnRenamed("deck_path", "path"), "path", "left").withColumn("n_exports", F.coalesce("n_exports", F.lit(0)))
        return hits.orderBy(F.desc("n_exports"), F.desc("modified_unix"), *tail)
    first = {"name": F.lower(text.display_name("file_name")), "added": F.desc("first_seen_unix")}.get(sort, F.desc("modified_unix"))
    return hits.orderBy(first, *tail)


def tag_suggestions(tags: DataFrame, applied: DataFrame, typed: str) -> DataFrame:
    """Tags that contain what is typed and that a slide does not have yet."""
    rest = tags.join(applied.select(F.lower("name").alias("__n")), F.lower(tags["name"]) == F.col("__n"), "left_anti")
    return rest.where(F.lower("name").contains(typed.strip().lower())).orderBy(F.lower("name"))


def embedding_state(downloading: Column, enabled: Column, downloaded: Column, error: Column) -> Column:
    return F.when(downloading, "downloading").when(~enabled, "disabled").when(~downloaded, "not_downloaded").when(error.isNotNull(), "error").otherwise("ready")
