"""Operator 9, mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic); the cell weights are
raked until the marginals of source, language and topic meet their targets, and
documents are drawn by the calibrated probabilities with a hash of their id, so
a rerun draws the same ones.

Targets are given by value, or found shares are flattened by an exponent. The rake
goes on until no marginal is further than TOLERANCE from its target (relative), or
for MOST_ROUNDS: targets that exclude each other are never met. ``fit`` returns the
residual; a mix that is further off than ``within`` asks for raises Unmet, and
without ``within`` one that did not converge warns and names it. The fitted weight of a cell is its source's factor times its language's
and topic's. Only the sums by language and topic visit the driver; sources,
however many, stay in the cells' table, and a round is one aggregation over it.

The topic is a column of the table, or the form of the text: mostly capitals, many
digits, short lines, or prose.

Nulls: a null source or language is a value of its own. A null or empty text
has no tokens, weighs nothing and is kept. A null doc_id has no hash and is
kept (as often as its rate has whole parts, if the mix is drawn). Documents that
repeat an id are drawn alike, ties need no rule, and texts of any length are
profiled whole. An empty table gives an empty one. Columns of the table are carried
in a struct, so that no name can clash.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.llm.common import bounded_batches, drop_models, give_back, spans, text_buffer, word_spans, written

TOLERANCE, MOST_ROUNDS = 1e-9, 25
#: Exponents of the found shares of source, language and topic: 0 makes all alike, 1 leaves them as they are.
EXPONENTS = (0.5, 0.7, 0.7)
#: Bytes of text profiled at a time.
PIECE = 512 << 10
TOPICS = ("shouting", "figures", "lines", "prose")


class Unmet(ValueError):
    """No weights were found whose marginals are as near to their targets as was asked for."""


@F.arrow_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("topic", T.StringType())]))
def text_profile(text: pa.Array) -> pa.Array:
    """Words of a text and its topic by form: mostly capitals, many digits, short lines, or prose."""
    buffer, bounds = text_buffer(text)
    words, topics = [np.zeros(0, np.int64)], [np.zeros(0, str)]
    for i, j in spans(np.diff(bounds), PIECE):
        data, offs = buffer[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]

        def count(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])

        upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
        digits, breaks = count((data >= 48) & (data <= 57)), count(data == 10)
        size = np.diff(offs)
        words.append(np.diff(word_spans(data, offs)[2]))
        topics.append(np.select([upper > lower, 20 * digits > size, 40 * breaks > size], TOPICS[:3], TOPICS[3]))
    drop_models()  # of earlier stages
    out = pa.StructArray.from_arrays([pa.array(np.concatenate(words)), pa.array(np.concatenate(topics).tolist(), pa.string())], ["tokens", "topic"])
    give_back()
    return out


def key(c: Column) -> Column:
    """A value that tells null from every string."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def profiled(docs: DataFrame, topic: str | None) -> DataFrame:
    """row (the columns of docs as a struct), source, lang, topic (keys) and tokens."""
    bounded_batches(docs.sparkSession)
    p = docs.select(F.struct(*docs.columns).alias("row"), text_profile(F.col("text").cast("string")).alias("p"))
    return p.select("row", key(F.col("row.source")).alias("source"), key(F.col("row.lang")).alias("lang"), (key(F.col("row").getField(topic)) if topic else F.concat(F.lit("+"), F.col("p.topic"))).alias("topic"), F.col("p.tokens").alias("tokens"))


def shares(found: dict[str, float], power: float, given: dict | None) -> dict[str, float]:
    """Target shares of the found values: as given (values that are not named share nothing), or by the exponent."""
    raw = {k: float(v) ** power for k, v in found.items()} if given is None else {k: float(given.get(None if k == "-" else k[1:], 0.0)) for k in found}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in sorted(raw.items())}


def fit(cells: DataFrame, exponents: tuple[float, float, float] = EXPONENTS, targets: dict[str, dict] | None = None) -> tuple[DataFrame, float]:
    """(source, lang, topic, ratio of target weight to tokens) of each cell, and the largest relative distance of a marginal from its target."""
    targets = targets or {}
    rows = cells.where("tokens > 0").groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()
    total = float(sum(r.tokens for r in rows))

    def found(name: str) -> dict[str, float]:
        by: dict[str, float] = {}
        for r in rows:
            by[r[name]] = by.get(r[name], 0.0) + float(r.tokens)
        return by

    langs, topics = (shares(found(name), e, targets.get(name)) for name, e in zip(("lang", "topic"), exponents[1:]))
    by_source = cells.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("all"), F.sort_array(F.collect_list(F.struct("lang", "topic", "tokens"))).alias("strata"))
    if "source" in targets:
        given = [(None if k is None else str(k), float(v)) for k, v in targets["source"].items()]
        named = cells.sparkSession.createDataFrame([("-" if k is None else "+" + k, v) for k, v in given], "source string, raw double")
        by_source = by_source.join(named, "source", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    else:
        by_source = by_source.withColumn("raw", F.pow(F.col("all").cast("double"), exponents[0]))
    by_source = written(by_source, "sources")
    spread = by_source.agg(F.sum("raw")).first()[0] or 1.0
    by_source = by_source.withColumn("goal", F.col("raw") / F.lit(spread))
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def factor_of(x: Column, name: str, d: dict[str, float]) -> Column:
        pairs = F.create_map(*[F.lit(v) for kv in d.items() for v in kv]) if d else F.create_map(F.lit(""), F.lit(1.0))
        return F.element_at(pairs, x[name])

    def raked() -> DataFrame:
        """Weights whose sums by source meet their targets: a cell's share of its source's goal."""
        m = F.transform("strata", lambda x: F.struct(x["lang"].alias("lang"), x["topic"].alias("topic"), x["tokens"].alias("tokens"), (x["tokens"] * factor_of(x, "lang", b) * factor_of(x, "topic", c)).alias("m")))
        x = by_source.select("source", "goal", m.alias("strata"))
        a = F.col("goal") / F.nullif(F.aggregate("strata", F.lit(0.0), lambda t, v: t + v["m"]), F.lit(0.0))
        x = x.select("source", a.alias("a"), F.explode("strata").alias("x"))
        return x.select("source", "x.lang", "x.topic", "x.tokens", F.coalesce(F.col("a") * F.col("x.m"), F.lit(0.0)).alias("w"))

    residual = 0.0
    for _ in range(MOST_ROUNDS if total else 0):
        w = {(r.lang, r.topic): r.w for r in raked().groupBy("lang", "topic").agg(F.sum("w").alias("w")).collect()}
        residual = 0.0
        for i, (factor, goal) in enumerate(((b, langs), (c, topics))):
            mass = dict.fromkeys(goal, 0.0)
            for k, v in w.items():
                mass[k[i]] += v
            scale = {k: goal[k] / m if m > 0 else 1.0 for k, m in mass.items()}
            residual = max([residual, *(abs(mass[k] - g) / (g or 1.0) for k, g in goal.items())])
            for k, s in scale.items():
                factor[k] *= s
            w = {k: v * scale[k[i]] for k, v in w.items()}
        if residual <= TOLERANCE:
            break
    return raked().select("source", "lang", "topic", (F.col("w") * F.lit(total) / F.col("tokens")).alias("ratio")), residual


def rated(docs: DataFrame, keep: float, exponents: tuple[float, float, float], targets: dict[str, dict] | None, topic: str | None, within: float | None) -> DataFrame:
    """row, tokens, topic, rate, kept and copies.

    A document's rate is keep times its cell's ratio of target to found weight.
    Rates over one keep the document for certain; what is over is carried as
    weight, or by whole copies and a draw for the rest.
    """
    p = profiled(docs, topic)
    cells = written(p.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "cells")
    fitted, residual = fit(cells, exponents, targets)
    if residual > (TOLERANCE if within is None else within):
        said = f"a marginal is {residual:.3g} of its target away from it after {MOST_ROUNDS} rounds"
        if within is not None:
            raise Unmet(said)
        warnings.warn(said, stacklevel=3)
    ratio = written(fitted, "ratios")
    j = p.join(ratio, ["source", "lang", "topic"], "left")
    rate = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.coalesce(F.lit(keep) * F.col("ratio"), F.lit(1.0)))
    draw = F.conv(F.substring(F.md5(F.col("row.doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    whole = F.floor("rate")
    copies = F.coalesce(whole + (draw < F.col("rate") - whole).cast("long"), F.greatest(F.lit(1), whole))
    value = F.when(F.col("topic") != "-", F.expr("substring(topic, 2)"))
    return j.withColumn("rate", rate).select("row", "tokens", value.alias("topic"), "rate", F.coalesce(draw < F.least(F.lit(1.0), "rate"), F.lit(True)).alias("kept"), copies.alias("copies"))


def mixed(docs: DataFrame, keep: float = 0.6, exponents: tuple[float, float, float] = EXPONENTS, targets: dict[str, dict] | None = None, topic: str | None = None, within: float | None = None) -> DataFrame:
    """docs with tokens, topic, probability, weight and kept (in place of columns of these names).

    targets: {"source" | "lang" | "topic": {value: weight}}; topic: the name of a column, else the text's form;
    within: the largest relative distance of a marginal from its target that is accepted.
    """
    new = {"tokens": F.col("tokens"), "topic": F.col("topic"), "probability": F.least(F.lit(1.0), "rate"), "weight": F.greatest(F.lit(1.0), "rate"), "kept": F.col("kept")}
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return rated(docs, keep, exponents, targets, topic, within).select(*own, *[c.alias(k) for k, c in new.items()])


def drawn(docs: DataFrame, keep: float = 0.6, exponents: tuple[float, float, float] = EXPONENTS, targets: dict[str, dict] | None = None, topic: str | None = None, within: float | None = None) -> DataFrame:
    """The rows of docs that the mix draws, each as often as its rate asks for, so that the drawn tokens meet the targets."""
    r = rated(docs, keep, exponents, targets, topic, within).where("copies > 0")
    return r.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "tokens", "topic", F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"), "kept")


def sql(keep: float = 0.6, exponents: tuple[float, float, float] = EXPONENTS, rounds: int = MOST_ROUNDS) -> str:
    """The same in DuckDB SQL: one common table for each rake."""
    words = r"[^\x20\t-\r]+"
    out = [
        f"""WITH p AS (
  SELECT doc_id, coalesce('+' || source, '-') AS s, coalesce('+' || lang, '-') AS l, len(regexp_extract_all(coalesce(text, ''), '{words}')) AS tokens,
    strlen(coalesce(text, '')) AS size, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS up, length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) AS low,
    length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits, length(regexp_replace(coalesce(text, ''), '[^\\n]', '', 'g')) AS breaks FROM documents
), d AS (
  SELECT *, CASE WHEN up > low THEN 'shouting' WHEN 20 * digits > size THEN 'figures' WHEN 40 * breaks > size THEN 'lines' ELSE 'prose' END AS t FROM p
), w0 AS (SELECT s, l, t, sum(tokens)::DOUBLE AS n, sum(tokens)::DOUBLE AS w FROM d GROUP BY s, l, t HAVING sum(tokens) > 0)"""
    ]
    for k, e in zip("slt", exponents):
        out.append(f"g{k} AS (SELECT {k}, pow(sum(n), {e}) / sum(pow(sum(n), {e})) OVER () AS goal FROM w0 GROUP BY {k})")
    last = "w0"
    for i, k in enumerate([*"slt" * rounds, "s"], 1):
        out.append(f"w{i} AS MATERIALIZED (SELECT s, l, t, n, w * goal / sum(w) OVER (PARTITION BY {k}) AS w FROM {last} JOIN g{k} USING ({k}))")
        last = f"w{i}"
    return ", ".join(out) + f""", r AS (
  SELECT doc_id, tokens, t AS topic, CASE WHEN tokens = 0 THEN 1.0::DOUBLE ELSE {keep}::DOUBLE * w * (SELECT sum(n) FROM w0) / n END AS rate
  FROM d LEFT JOIN {last} USING (s, l, t)
)
SELECT doc_id, tokens, topic, round(least(1.0, rate), 6) AS probability, round(greatest(1.0, rate), 6) AS weight,
  coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967296.0 < least(1.0, rate), true) AS kept FROM r"""
