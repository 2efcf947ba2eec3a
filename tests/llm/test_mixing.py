import warnings

import pytest
from oracle import duck, spark_rows
from pyspark.sql import functions as F

from pagelore.llm import mixing


def test_documents(spark):
    assert spark_rows(mixing.op9(spark, "/root/testdata/sf0.01")) == duck("/root/testdata/sf0.01", mixing.sql())


def test_marginals_meet_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = mixing.mixed(docs, keep=0.01)  # no rate reaches one
    rows = m.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect()
    for name, e in (("source", 0.5), ("lang", 0.7), ("topic", 0.7)):
        n, w = {}, {}
        for r in rows:
            n[r[name]] = n.get(r[name], 0) + r.n
            w[r[name]] = w.get(r[name], 0) + r.w
        goal = {k: v**e for k, v in n.items()}
        for k in n:
            assert abs(w[k] / sum(w.values()) - goal[k] / sum(goal.values())) < 1e-6


def test_edges(spark, tmp_path):
    rows = [(1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "x y", "en", None), (4, "LOUD LOUD", None, "s"), (5, "1 2 3", "en", "-"), (5, "1 2 3", "en", "-"), (6, "w " * 50_000, "fr", "s"), (7, "a\nb\nc\n", "fr", "t")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, kept int, tokens int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert spark_rows(mixing.op9(spark, str(tmp_path))) == duck(str(tmp_path), mixing.sql())
    assert mixing.mixed(df.limit(0)).collect() == []


def test_drawn_rows_meet_raised_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = mixing.mixed(docs).collect()
    n = {r.doc_id: r["count"] for r in mixing.drawn(docs).groupBy("doc_id").count().collect()}
    assert {r.doc_id for r in rows if r.kept} == set(n) and max(n.values()) > 1
    for r in rows:
        assert int(r.weight) * r.kept <= n.get(r.doc_id, 0) <= -(-r.weight // 1)
    want = sum(r.tokens * r.weight for r in rows if r.weight > 1)
    got = sum(r.tokens * n[r.doc_id] for r in rows if r.weight > 1)
    assert abs(got / want - 1) < 0.1


def test_given_targets_are_met_by_what_is_drawn(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    targets = {"lang": {"en": 2, "fr": 3, "de": 3, "es": 2}, "topic": {"prose": 0.9, "lines": 0.04, "figures": 0.02, "shouting": 0.04}}
    form = mixing.mixed(docs).select("doc_id", "topic", "tokens")
    got = mixing.drawn(docs, targets=targets).join(form, "doc_id")
    for name in ("lang", "topic"):
        n = {r[name]: r.n for r in got.groupBy(name).agg(F.sum("tokens").alias("n")).collect()}
        for k, v in targets[name].items():
            assert abs(n[k] / sum(n.values()) - v / sum(targets[name].values())) < 0.03, (name, k)


def test_fit_converges_and_tells_what_is_out_of_reach(spark):
    cells = spark.createDataFrame([("+a", "+x", "+t", 10), ("+a", "+y", "+t", 30), ("+b", "+x", "+t", 5), ("+b", "+y", "+t", 5)], "source string, lang string, topic string, tokens long")
    ratio, residual = mixing.fit(cells, targets={"source": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 3}})
    assert residual < 1e-9
    w = {(r.source, r.lang): r.ratio for r in ratio.collect()}
    assert abs(w["+a", "+x"] * 10 + w["+a", "+y"] * 30 - 25) < 1e-6 and abs(w["+a", "+x"] * 10 + w["+b", "+x"] * 5 - 12.5) < 1e-6
    lone = spark.createDataFrame([("+a", "+x", "+t", 10), ("+b", "+y", "+t", 30)], cells.schema)
    assert mixing.fit(lone, targets={"source": {"a": 1, "b": 1}, "lang": {"x": 9, "y": 1}})[1] > 0.1


def test_topic_column_and_clashing_names(spark):
    cols = ["tokens", "topic", "rate", "kept", "copies", "row", "p", "ratio", "weight"]
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "en", f"s{i % 3}", *[f"k{i % 2}"] * 9) for i in range(60)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in cols))
    out = mixing.drawn(df, keep=1.0, topic="topic")
    assert out.columns == df.columns and out.schema == df.schema and out.count() > 0
    assert set(out.subtract(df).collect()) == set()
    assert {r.topic for r in mixing.mixed(df, topic="topic").collect()} == {"k0", "k1"}
    assert mixing.drawn(df.limit(0)).collect() == []


def test_what_is_out_of_reach_raises_or_warns(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "en" if i % 2 else "fr", "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, lang string, source string")
    apart = {"source": {"a": 1, "b": 1}, "lang": {"en": 9, "fr": 1}}
    with pytest.raises(mixing.Unmet, match="target"):
        mixing.drawn(df, targets=apart, within=0.05)
    with pytest.warns(UserWarning, match="of its target away"):
        assert mixing.mixed(df, targets=apart).count() == 40
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mixing.mixed(df, targets={"source": {"a": 1, "b": 1}, "lang": {"en": 1, "fr": 1}}, within=1e-9)
