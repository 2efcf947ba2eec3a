"""Tables of a library and the constants that are part of its semantics."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values.
BM25_WEIGHTS = {"title": 4.0, "body": 1.0, "notes": 0.6, "deck_title": 2.0}
BM25_K1, BM25_B = 1.2, 0.75
SNIPPET_TOKENS = 12
NEAR_DUP_THRESHOLD, NEAR_DUP_NEIGHBOURS = 0.92, 10
SEMANTIC_FLOOR, SIMILAR_FLOOR = 0.82, 0.86
HYBRID_POOL, RRF_K = 200, 60
DEFAULT_LIMIT, BROWSE_SNIPPET, FALLBACK_SNIPPET = 200, 120, 160
SCAN_CAP, SEARCH_CAP, EXPORT_CAP = 50, 200, 200
RECENT, LARGEST, ISSUES = 10, 5, 200
REFINEMENT_SECONDS = 120
EMBED_BATCH = 64
INDEX_VERSION, SCHEMA_VERSION = 3, 7
DEFAULT_WIDTH, DEFAULT_HEIGHT = 12_192_000, 6_858_000

FILTERS = "deck_query string, path_prefix string, modified_from long, modified_to long, favorites_only boolean, tag_id long, limit int, sort string, mode string"

#: Each table as a DDL schema. Text is never inferred; migrations only add columns.
TABLES = {
    "roots": "id long, path string, last_scan_unix long, exclude_globs array<string>",
    "decks": "id long, root_id long, path string, file_name string, title string, author string, slide_count long, modified_unix long, size_bytes long, slide_width_emu long, slide_height_emu long, file_hash string, first_seen_unix long",
    "slides": "id long, deck_id long, slide_index long, title string, body_text string, notes string, thumb_path string, content_hash string, text_hash string",
    "segments": "term string, chunk int, stamp long, n int, most double, shortest long, ids array<long>, counts array<int>, places array<int>",
    "lengths": "deck_id long, slide_id long, n_tokens long, stamp long",
    "slide_favorites": "deck_path string, slide_index long, added_unix long",
    "deck_favorites": "deck_path string, added_unix long",
    "tags": "id long, name string, created_unix long",
    "slide_tags": "tag_id long, deck_path string, slide_index long",
    "search_history": "id long, query string, result_count long, searched_unix long",
    "export_history": "id long, output_path string, title string, slide_count long, source_decks long, exported_unix long",
    "export_picks": "id long, export_id long, deck_path string, slide_index long",
    "scan_history": "id long, started_unix long, duration_ms long, indexed long, removed long, unchanged long, skipped long",
    "scan_issues": "id long, scan_id long, path string, reason string",
    "render_issues": "deck_path string, slide_index long, content_hash string, dropped array<string>, updated_unix long",
    "saved_searches": f"id long, name string, query string, filters struct<{', '.join(':'.join(c.rsplit(' ', 1)) for c in FILTERS.split(', '))}>, position long, created_unix long",
    "embeddings": "model_id string, text_hash string, dims int, vector array<float>",
    "deck_fonts": "deck_id long, family string, embedded boolean",
    "leases": "name string, owner string, until_unix long, cancelled boolean",
    "slide_vectors": "model_id string, slide_id long, text_hash string, vector array<float>",
    "clusters": "slide_id long, cluster long",
    "memos": "name string, stamp string",
    "meta": "key string, value long",
}

#: What a change of rows names: rows of one key change together.
KEYS = {
    "roots": ["id"], "decks": ["id"], "slides": ["deck_id"], "segments": ["term"], "lengths": ["deck_id"], "slide_favorites": ["deck_path", "slide_index"], "deck_favorites": ["deck_path"],
    "tags": ["id"], "slide_tags": ["deck_path", "slide_index"], "search_history": ["id"], "export_history": ["id"], "export_picks": ["export_id"], "scan_history": ["id"], "scan_issues": ["scan_id"],
    "render_issues": ["deck_path", "slide_index"], "saved_searches": ["id"], "embeddings": ["model_id", "text_hash"], "deck_fonts": ["deck_id"], "meta": ["key"],
    "leases": ["name"], "slide_vectors": ["slide_id"], "clusters": ["slide_id"], "memos": ["name"],
}

#: How the rows of a bucket are sorted where it is not by key.
SORTS = {"segments": ["term", "chunk"], "slides": ["deck_id", "slide_index"]}


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
