"""Incremental scan of folders: list, tell what changed, extract, report."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import text
from pagelore.schema import INDEX_VERSION

EXTRACTED = (
    "path string, error string, file_name string, title string, author string, width long, height long, "
    "slides array<struct<slide_index:long,title:string,body_text:string,notes:string,content_hash:string>>, "
    "fonts array<struct<family:string,embedded:boolean>>"
)


#: Changed files that one job opens.
BATCH = 5000


def is_deck(path: Column) -> Column:
    """A .pptx in any case that is no lock file and not hidden."""
    name = F.lower(text.base_name(path))
    return name.endswith(".pptx") & ~F.startswith(name, F.lit("~$")) & ~F.startswith(name, F.lit("."))


def is_pruned(relative: Column) -> Column:
    return relative.rlike(r"(^|/)(node_modules|\.git)/")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: * and ? cross separators, [..], {a,b}. Raises ValueError if it is malformed."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 2
        elif c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed alternative in {pattern!r}")
    re.compile(out)
    return f"^(?:{out})$"


def excluded(relative: Column, globs: list[str]) -> Column:
    """Whether a pattern matches a path below its root; X/** also drops what lies in any folder X names."""
    tests = [relative.rlike(glob_regex(g)) for g in globs]
    tests += [relative.rlike(glob_regex(g[:-3])[:-1] + "/.*$") for g in globs if g.endswith("/**")]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def plain(path: Column) -> Column:
    """A path of a file as it is stored: not encoded, local ones without their scheme."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:/*", "/")


def qualified(spark: SparkSession, root: str) -> str:
    """A root as the paths below it begin, whatever file system it names or leaves out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/*", "/", whole).rstrip("/")


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, relative, modified_unix, size_bytes of all files below a root. Contents are not read: only metadata columns are selected."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(plain(F.col("path")).alias("path"), F.greatest(F.unix_seconds("modificationTime"), F.lit(0)).alias("modified_unix"), F.col("length").alias("size_bytes"))
    return rows.select("path", F.substring("path", len(qualified(spark, root)) + 2, 1 << 20).alias("relative"), "modified_unix", "size_bytes")


def listing(spark: SparkSession, root_id: int, root: str, globs: list[str]) -> DataFrame:
    """root_id, path, modified_unix, size_bytes, file_hash of a root's decks."""
    rows = files(spark, root).where(is_deck(F.col("path")) & ~is_pruned(F.col("relative")) & ~excluded(F.col("relative"), globs))
    return rows.select(F.lit(root_id).cast("long").alias("root_id"), "path", "modified_unix", "size_bytes", text.file_hash("modified_unix", "size_bytes", INDEX_VERSION).alias("file_hash"))


def changes(found: DataFrame, decks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are new or changed, and files that are as stored."""
    known = decks.select("path", "file_hash")
    return found.join(known, ["path", "file_hash"], "left_anti"), found.join(known, ["path", "file_hash"], "left_semi")


def vanished(found: DataFrame, decks: DataFrame) -> DataFrame:
    """Stored decks that a listing of their root no longer has."""
    return decks.join(found, "path", "left_anti")


def extract_one(path: str, content: bytes) -> dict:
    """One deck's rows, or its error: a broken file never stops a scan."""
    from pagelore.sources.opc import DeckError
    from pagelore.sources.pptx import Presentation

    name = path.replace("\\", "/").rpartition("/")[2]
    out = {"path": path, "error": None, "file_name": name, "title": None, "author": None, "width": None, "height": None, "slides": [], "fonts": []}
    try:
        p = Presentation.read(content)
        for i in range(1, len(p.slides) + 1):
            c = p.content(i)
            out["slides"].append({"slide_index": i, "title": c.title, "body_text": "\n".join(c.texts), "notes": c.notes, "content_hash": p.content_hash(i)})
        embedded = set(p.embedded_fonts()[0])
        folded = {f.lower() for f in embedded}
        out["fonts"] = [{"family": f, "embedded": f.lower() in folded} for f in sorted(p.font_names() | embedded)]
        stem = re.sub(r"(?<=.)\.[^.]*$", "", name)
        out |= {"title": p.core.get("title") or stem, "author": p.core.get("creator"), "width": p.width, "height": p.height}
    except (DeckError, ValueError, KeyError, IndexError, RecursionError) as e:
        out |= {"error": str(e) or type(e).__name__, "slides": [], "fonts": []}
    return out


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and content of these files: the scan lists and opens no others."""
    escaped = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", p) for p in paths]
    return spark.read.format("binaryFile").load(escaped).select(plain(F.col("path")).alias("path"), "content")


def contents(spark: SparkSession, root: str, changed: DataFrame, total: int, batch: int = BATCH) -> Iterator[DataFrame]:
    """Frames of path and content that together hold the changed files.

    If most of the root's ``total`` files changed, one frame scans the root and keeps the changed ones.
    Else each frame opens a batch of the changed paths and nothing else; the driver holds one batch of paths.
    """
    if 2 * changed.count() > total:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(plain(F.col("path")).alias("path"), "content")
        yield rows.join(changed.select("path"), "path", "left_semi")
        return
    held: list[str] = []
    for r in changed.select("path").toLocalIterator():
        held.append(r.path)
        if len(held) == batch:
            yield read_paths(spark, held)
            held = []
    if held:
        yield read_paths(spark, held)


def extracted(rows: DataFrame) -> DataFrame:
    """One row for each file (path, content), parsed in Arrow batches on the executors."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            got = [extract_one(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            schema = schema or pa.schema(
                [("path", pa.string()), ("error", pa.string()), ("file_name", pa.string()), ("title", pa.string()), ("author", pa.string()), ("width", pa.int64()), ("height", pa.int64()),
                 ("slides", pa.list_(pa.struct([("slide_index", pa.int64()), ("title", pa.string()), ("body_text", pa.string()), ("notes", pa.string()), ("content_hash", pa.string())]))),
                 ("fonts", pa.list_(pa.struct([("family", pa.string()), ("embedded", pa.bool_())])))]
            )
            yield pa.RecordBatch.from_pylist(got, schema=schema)

    return rows.mapInArrow(work, EXTRACTED)
