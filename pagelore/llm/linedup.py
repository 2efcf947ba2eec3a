"""Operator 5, line deduplication with DataFrame functions only.

Lines are split and hashed once, into a table. Its hashes are range-partitioned
and sorted by hash, document and position; the ordered stream of a range gives
the first occurrence of a hash in each document, and a hot hash spreads over as
many ranges as it fills. What a range knows of a hash is summed before one small
exchange. The result is no text but a keep bitmap per document, compressed: 64
lines a word, one bit each, and words that keep all their lines are left out.

Nulls: a null or empty text is one empty line. A row with a null doc_id has no
place in the order: its lines neither count nor go. Documents are counted by
doc_id; rows that repeat a doc_id with the same text share one bitmap, and a line
that a document repeats (a tie) is kept or dropped wherever it stands. Very long
texts are arrays of lines in one row. An empty table gives an empty one. Columns
of the table are carried in a struct, so that no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.llm.common import parts, written

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of repeated hashes (24 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos (from 0), h1, h2 of each line whose key has min_chars code points."""
    each = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    key = each.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return key.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """h1, h2, doc_id, pos: where each document first holds a hash. The window runs on the ranges as they are, in their order."""
    ranged = hashes.select("h1", "h2", "doc_id", "pos").repartitionByRange(parts(hashes.sparkSession), "h1", "h2", "doc_id")
    turn = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    return ranged.withColumn("turn", turn).where("turn = 1").drop("turn")


def repeated_hashes(hashes: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, keeper of each key in min_docs documents or more."""
    found = first_occurrences(hashes).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    return found.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_hash, keep map<int, long>: of each document that loses lines, word -> its 64 keep bits (a word not in the map keeps all)."""
    hashes = written(hashed_lines(docs, min_chars), "line-hashes")
    again = written(repeated_hashes(hashes, min_docs), "lines")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    gone = hashes.join(again, ["h1", "h2"]).where("doc_id <> keeper")
    words = gone.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def with_kept(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (the columns of docs as a struct), all_lines and kept_lines (arrays of string)."""
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").alias("whole"))
    b = bitmaps.select(F.col("doc_id").alias("bitmap_id"), F.col("text_hash").alias("bitmap_hash"), "keep")
    d = d.join(b, (d["id"] == b["bitmap_id"]) & (d["hash"] == b["bitmap_hash"]), "left").withColumn("all_lines", lines(F.col("whole")))
    # The words of a document as an array: a line's word is found by its index.
    d = d.withColumn("words", F.transform(F.sequence(F.lit(0), F.shiftright(F.size("all_lines") - 1, 6)), lambda w: F.coalesce(F.element_at("keep", w), F.lit(-1).cast("long"))))
    kept = F.expr("filter(all_lines, (x, i) -> (shiftright(element_at(words, shiftright(i, 6) + 1), i % 64) & 1L) = 1L)")
    return d.select("row", "all_lines", F.when(F.col("keep").isNull(), F.col("all_lines")).otherwise(kept).alias("kept_lines"))


def deduplicate_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with each text rebuilt from its kept lines (a null text becomes empty)."""
    out = with_kept(docs, keep_bitmaps(docs, min_chars, min_docs))
    text = F.array_join("kept_lines", "\n").alias("text")
    return out.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_kept(docs, keep_bitmaps(docs, min_chars=40, min_docs=5))
    return out.select(
        "row.doc_id",
        F.size("all_lines").cast("long").alias("n_lines"),
        (F.size("all_lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH l AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, f.keeper IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
