"""Counts, inventories and recent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.functions import text
from pagelore.schema import RECENT


def counts(decks: DataFrame, slides: DataFrame) -> DataFrame:
    """decks, slides: one row."""
    return decks.agg(F.count(F.lit(1)).alias("decks")).crossJoin(slides.agg(F.count(F.lit(1)).alias("slides")))


def tag_counts(tags: DataFrame, slide_tags: DataFrame, decks: DataFrame, slides: DataFrame) -> DataFrame:
    """tags with n_slides: assignments whose slide is still in the library, by name."""
    live = slides.join(decks.select(F.col("id").alias("deck_id"), F.col("path").alias("deck_path")), "deck_id").select("deck_path", "slide_index")
    n = slide_tags.join(live, ["deck_path", "slide_index"]).groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("n_slides"))
    return tags.join(n, "id", "left").withColumn("n_slides", F.coalesce("n_slides", F.lit(0))).orderBy(F.lower("name"))


def root_counts(roots: DataFrame, decks: DataFrame, slides: DataFrame) -> DataFrame:
    """roots with n_decks and n_slides, by path."""
    per_deck = slides.groupBy("deck_id").agg(F.count(F.lit(1)).alias("n"))
    n = decks.join(per_deck, decks["id"] == per_deck["deck_id"], "left").groupBy("root_id").agg(F.count(F.lit(1)).alias("n_decks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_slides"))
    return roots.join(n, roots["id"] == n["root_id"], "left").drop("root_id").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_decks", "n_slides")}).orderBy("path")


def export_counts(picks: DataFrame) -> DataFrame:
    return picks.groupBy("deck_path").agg(F.count(F.lit(1)).alias("n_exports"))


def font_families(deck_fonts: DataFrame) -> DataFrame:
    """family, embedded: one spelling for each family whatever its case, embedded if any deck embeds it."""
    return deck_fonts.groupBy(F.lower("family").alias("folded")).agg(F.max("embedded").alias("embedded"), F.max_by("family", F.struct(F.col("embedded"), F.col("family"))).alias("family")).select("family", "embedded").orderBy(F.lower("family"))


def font_status(families: DataFrame, app: DataFrame, system: DataFrame, bundled: DataFrame, downloadable: DataFrame) -> DataFrame:
    """families with the first place that has each: app, system, bundled, downloadable, or missing."""
    out = families
    for name, have in (("app", app), ("system", system), ("bundled", bundled), ("downloadable", downloadable)):
        h = have.select(F.lower("family").alias("__f")).distinct().withColumn(f"__{name}", F.lit(True))
        out = out.join(h, F.lower(out["family"]) == h["__f"], "left").drop("__f")
    status: Column = F.lit("missing")
    for name in ("downloadable", "bundled", "system", "app"):
        status = F.when(F.col(f"__{name}"), name).otherwise(status)
    return out.withColumn("status", status).drop("__app", "__system", "__bundled", "__downloadable")


def render_drops(render_issues: DataFrame, decks: DataFrame) -> DataFrame:
    """kind, n: what current slides drop when drawn; rows of older contents and of decks that went do not count."""
    live = render_issues.join(decks.select(F.col("path").alias("deck_path"), F.col("file_hash").alias("content_hash")), ["deck_path", "content_hash"], "left_semi")
    return live.select(F.explode("dropped").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def embedding_counts(slides: DataFrame, embeddings: DataFrame, model_id: str) -> DataFrame:
    """embedded, embeddable slides: one row."""
    have = embeddings.where(F.col("model_id") == model_id).select("text_hash").distinct().withColumn("hit", F.lit(True))
    rows = slides.where(F.col("text_hash").isNotNull()).join(have, "text_hash", "left")
    return rows.agg(F.count_if("hit").alias("embedded"), F.count(F.lit(1)).alias("embeddable"))


def recent(history: DataFrame, n: int = RECENT) -> DataFrame:
    return history.orderBy(F.desc("id")).limit(n)


def kept_last(history: DataFrame, n: int) -> DataFrame:
    """Retention: the n latest rows."""
    return history.orderBy(F.desc("id")).limit(n)


def latest(history: DataFrame) -> DataFrame:
    """The last row, if there is one."""
    return history.agg(F.max_by(F.struct(*history.columns), "id").alias("x")).where("x IS NOT NULL").select("x.*")


def overview(t: dict[str, DataFrame], dropped: bool = True) -> DataFrame:
    """One row: totals, the latest scan, recent searches and exports, largest decks, issues of the last scan, drops."""
    top = lambda df, order, n, cols: df.orderBy(*order).limit(n).agg(F.collect_list(F.struct(*cols)).alias("x"))
    out = t["decks"].agg(F.count(F.lit(1)).alias("decks"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    last = latest(t["scan_history"])
    parts = {
        "slides": t["slides"].agg(F.count(F.lit(1)).alias("x")),
        "favorite_slides": t["slide_favorites"].agg(F.count(F.lit(1)).alias("x")),
        "favorite_decks": t["deck_favorites"].agg(F.count(F.lit(1)).alias("x")),
        "last_scan": last.agg(F.first(F.struct(*last.columns)).alias("x")),
        "recent_searches": top(t["search_history"], [F.desc("id")], 10, ["query", "result_count", "searched_unix"]),
        "recent_exports": top(t["export_history"], [F.desc("id")], 10, ["output_path", "title", "slide_count", "source_decks", "exported_unix"]),
        "largest_decks": top(t["decks"], [F.desc("size_bytes"), F.col("id")], 5, ["path", "title", "size_bytes", "slide_count"]),
        "issues": t["scan_issues"].join(last.select(F.col("id").alias("scan_id")), "scan_id", "left_semi").orderBy("id").limit(200).agg(F.collect_list(F.struct("path", "reason")).alias("x")),
    }
    if dropped:
        parts["drops"] = render_drops(t["render_issues"], t["decks"]).agg(F.collect_list(F.struct("kind", "n")).alias("x"))
    for name, one in parts.items():  # each is a single row
        out = out.crossJoin(F.broadcast(one.withColumnRenamed("x", name)))
    return out


def deck_hashes(decks: DataFrame) -> DataFrame:
    """p and h, distinct: what the names of a deck's thumbnails begin and end with."""
    return decks.select(text.hash16("path").alias("p"), F.substring("file_hash", 1, 16).alias("h")).distinct()


def distinct_decks(picks: DataFrame) -> DataFrame:
    """n: decks that picks come from."""
    return picks.agg(F.count_distinct("deck_path").alias("n"))


def by_deck(hits: DataFrame) -> DataFrame:
    """deck_id, first (its first place), n, slides: hits (pos, deck_id, slide_id) grouped by deck in the order in which decks come up."""
    rows = hits.groupBy("deck_id").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", "slide_id"))).alias("slides"))
    return rows.withColumn("slides", F.col("slides.slide_id")).orderBy("first")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the one that comes first: the styles of the first deck win."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
