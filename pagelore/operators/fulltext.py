"""Full-text search: postings, phrase matching, weighted BM25, snippets.

A posting is (slide_id, col, pos, term). A query reads the postings once: terms
are filtered at the scan, instances of phrases are counted by their start, and
one aggregation per slide gives every phrase's weighted frequency, from which
both the boolean condition and the score follow. Statistics (rows, average
length, document frequencies) cover the whole index, not the filtered part.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text
from pagelore.plans.query_parser import Group, Parsed, Term
from pagelore.schema import BM25_B, BM25_K1, BM25_WEIGHTS, SNIPPET_TOKENS

COLUMNS = tuple(BM25_WEIGHTS)


def postings(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "slide_id") -> DataFrame:
    """key, col, pos, term of every token: a narrow transformation of rows (key and text columns)."""
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), text.tokens(c).alias("terms")) for c in columns])).alias("x"))
    return each.select(key, F.col("x.col").alias("col"), F.posexplode("x.terms").alias("pos", "term"))


def lengths(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "slide_id") -> DataFrame:
    """key and n_tokens over all columns."""
    return rows.select(key, reduce(lambda a, b: a + b, [F.size(text.tokens(c)) for c in columns]).cast("long").alias("n_tokens"))


def _tokens(t: Term) -> list[str]:
    """A term's tokens, folded as the index folds."""
    return re.findall(r"[^\W_]+", text.folded(t.text))


def phrases(parsed: Parsed) -> list[tuple[tuple[str, ...], str | None]]:
    """Distinct phrases (tokens, column) of a query, required ones first."""
    out: list[tuple[tuple[str, ...], str | None]] = []
    for kind in ("required", "excluded"):
        for g in parsed.groups:
            for t in getattr(g, kind):
                p = (tuple(_tokens(t)), t.column)
                if p not in out:
                    out.append(p)
    return out


def term_filter(wanted: list[tuple[tuple[str, ...], str | None]]) -> Column:
    """Whether a term may be a token of some phrase."""
    whole = sorted({w for ts, _ in wanted for w in ts[:-1]})
    starts = sorted({ts[-1] for ts, _ in wanted})
    return reduce(lambda a, b: a | b, [F.col("term").isin(whole)] * bool(whole) + [F.startswith("term", F.lit(p)) for p in starts])


def frequencies(index: DataFrame, wanted: list[tuple[tuple[str, ...], str | None]], weights: dict[str, float], key: str = "slide_id") -> DataFrame:
    """key, f0, f1, ...: weighted instances of each phrase in each slide that has any."""
    found = index.where(term_filter(wanted))
    # Each posting offers itself as token i of phrase p that would start at pos - i.
    roles = []
    for p, (ts, column) in enumerate(wanted):
        for i, w in enumerate(ts):
            fits = F.startswith("term", F.lit(w)) if i == len(ts) - 1 else F.col("term") == w
            if column:
                fits = fits & (F.col("col") == column)
            roles.append(F.when(fits, F.struct(F.lit(p).alias("p"), F.lit(i).alias("i"), (F.col("pos") - i).alias("start"))))
    offers = found.select(key, "col", F.explode(F.filter(F.array(*roles), lambda x: x.isNotNull())).alias("x")).select(key, "col", "x.*")
    single = reduce(lambda a, b: a | b, [F.col("p") == p for p, (ts, _) in enumerate(wanted) if len(ts) == 1], F.lit(False))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("col"))
    parts = [offers.where(single).select(key, "p", weight.alias("w"))]
    longer = [p for p, (ts, _) in enumerate(wanted) if len(ts) > 1]
    if longer:
        need = F.element_at(F.create_map(*[F.lit(x) for p in longer for x in (p, len(wanted[p][0]))]), F.col("p"))
        whole_phrase = offers.where(F.col("p").isin(longer)).groupBy(key, "col", "p", "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == need)
        parts.append(whole_phrase.select(key, "p", weight.alias("w")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(key).agg(*[F.sum(F.when(F.col("p") == p, F.col("w")).otherwise(0.0)).alias(f"f{p}") for p in range(len(wanted))])


def condition(parsed: Parsed, wanted: list[tuple[tuple[str, ...], str | None]]) -> Column:
    def has(t: Term) -> Column:
        return F.col(f"f{wanted.index((tuple(_tokens(t)), t.column))}") > 0

    groups = []
    for g in parsed.groups:
        c = reduce(lambda a, b: a & b, map(has, g.required))
        groups.append(reduce(lambda a, b: a & ~b, map(has, g.excluded), c))
    return reduce(lambda a, b: a | b, groups)


def scored(parsed: Parsed, wanted: list[tuple[tuple[str, ...], str | None]]) -> list[int]:
    """The phrases that count for a score: excluded ones do not."""
    return sorted({wanted.index((tuple(_tokens(t)), t.column)) for g in parsed.groups for t in g.required})


def idf(n: Column, df: Column) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, 1e-6).otherwise(value)


def match(index: DataFrame, sizes: DataFrame, parsed: Parsed, weights: dict[str, float] = BM25_WEIGHTS, key: str = "slide_id", dfs: dict[int, int] | None = None, corpus=None) -> DataFrame:
    """key and score of the slides that a parsed query matches. Excluded phrases score nothing.

    index may be a part of the postings if it has whole slides and the corpus' statistics are given: rows with each
    phrase (dfs), and n and avgdl (corpus).
    """
    wanted = phrases(parsed)
    of = scored(parsed, wanted)
    f = frequencies(index, wanted, weights, key)
    hits = f.where(condition(parsed, wanted)).join(sizes.select(key, "n_tokens"), key)
    if dfs is None:
        # Both statistics are single rows.
        hits = hits.crossJoin(F.broadcast(f.agg(*[F.count_if(F.col(f"f{p}") > 0).alias(f"df{p}") for p in of])))
        hits = hits.crossJoin(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("avgdl"))))
        df, n, avgdl = {p: F.col(f"df{p}") for p in of}, F.col("n"), F.col("avgdl")
    else:
        df, n, avgdl = {p: F.lit(dfs[p]) for p in of}, F.lit(corpus.n), F.lit(corpus.avgdl)
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("n_tokens") / avgdl)
    parts = [idf(n, df[p]) * F.col(f"f{p}") * (BM25_K1 + 1) / (F.col(f"f{p}") + norm) for p in of]
    return hits.select(key, reduce(lambda a, b: a + b, parts).alias("score"))


def top(found: DataFrame, limit: int, key: str = "slide_id") -> DataFrame:
    """The best by score, ties to the smaller key."""
    return found.orderBy(F.desc("score"), key).limit(limit)


def snippet(body: str | None, wanted: list[tuple[tuple[str, ...], str | None]], n: int = SNIPPET_TOKENS, opening: str = "<mark>", closing: str = "</mark>") -> str:
    """The best window of n tokens of a body: most distinct phrases, then earliest; hits marked, cut ends shown by an ellipsis."""
    if not body:
        return ""
    spans = [(m.start(), m.end(), text.folded(m.group())) for m in text.raw_token().finditer(body)]
    words = [w for _, _, w in spans]
    found: list[tuple[int, int, int]] = []
    for p, (ts, column) in enumerate(wanted):
        if column not in (None, "body") or not ts:
            continue
        for i in range(len(words) - len(ts) + 1):
            if words[i + len(ts) - 1].startswith(ts[-1]) and tuple(words[i : i + len(ts) - 1]) == ts[:-1]:
                found.append((i, i + len(ts), p))
    found.sort()

    def worth(lo: int) -> int:
        seen, score = set(), 0
        for a, b, p in found:
            if lo <= a and b <= lo + n:
                score += 1 if p in seen else 1000
                seen.add(p)
        return score

    best = (worth(0) + 120 * bool(found), 0) if words else (0, 0)
    last = max(0, len(words) - n)
    for a, _, _ in found:
        inside = [x for x in found if a <= x[0] and x[1] <= a + n]
        spare = n - (inside[-1][1] - a if inside else n)
        for lo in {min(max(0, a - spare // 2), last)}:
            sentence = 100 if lo and re.search(r"[.:]\s*$", body[: spans[lo][0]]) else 0
            if (score := worth(lo) + sentence) > best[0]:
                best = (score, lo)
        begin = next((i for i in range(a, max(a - n, -1), -1) if i == 0 or re.search(r"[.:]\s*$", body[spans[i - 1][1] : spans[i][0]])), None)
        if begin and (score := worth(min(begin, last)) + 100) > best[0]:
            best = (score, min(begin, last))
    lo = best[1]
    hi = min(len(words), lo + n)
    at = spans[lo][0] if lo else 0
    end = spans[hi - 1][1] if hi < len(words) else len(body)
    out, pos = ["…" if lo else ""], at
    marked = -1
    for a, b, _ in found:
        if a < lo or b > hi:
            continue
        if a < marked:
            if b > marked:  # overlapping phrases share one mark
                out.pop()
                out += [body[pos : spans[b - 1][1]], closing]
                pos, marked = spans[b - 1][1], b
            continue
        out += [body[pos : spans[a][0]], opening, body[spans[a][0] : spans[b - 1][1]], closing]
        pos, marked = spans[b - 1][1], b
    return "".join([*out, body[pos:end], "…" if hi < len(words) else ""])


def snippet_column(body: Column | str, parsed: Parsed) -> Column:
    """snippet() of a column, in Arrow batches; use it on the rows that are shown only."""
    wanted = phrases(Parsed([Group(g.required) for g in parsed.groups]))

    @F.arrow_udf("string")
    def shown(b: pa.Array) -> pa.Array:
        return pa.array([snippet(x, wanted) for x in b.to_pylist()], pa.string())

    return shown(text.col(body))
