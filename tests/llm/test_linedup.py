from oracle import duck, spark_rows

from pagelore.llm import linedup


def same(spark, sf_dir):
    assert spark_rows(linedup.op5(spark, sf_dir)) == duck(sf_dir, linedup.OP5_SQL)


def test_documents(spark):
    same(spark, "/root/testdata/sf0.01")


def cases():
    hot = "A line that is the same in very many documents, é Ä"
    rows = [(i, f"own {i}\n \t{hot.upper().replace('É', 'é').replace('Ä', 'Ä')} \r\n{hot}\nshort\nshort") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, hot), (23, hot), (24, ("x" * 39 + "\n") * 9), (25, "\n".join([hot, "y" * 40] * 5000))]
    rows += [(30 + i, "y" * 40) for i in range(4)]
    return rows


def test_edges_with_and_without_broadcast(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(d, t, "c") for d, t in cases()], "doc_id long, text string, all_lines string").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, str(tmp_path))
    monkeypatch.setattr(linedup, "BROADCAST_ROWS", -1)
    same(spark, str(tmp_path))


def test_null_ids_stay_and_empty_table(spark):
    hot = "the same line of forty characters or more, here"
    df = spark.createDataFrame([(None, hot)] * 7 + [(i, hot) for i in range(4)], "doc_id long, text string")
    assert all(r.text == hot for r in linedup.deduplicate_lines(df).collect())
    df = df.unionByName(spark.createDataFrame([(9, hot + "\nx")], df.schema))
    got = sorted((str(r.doc_id), r.text) for r in linedup.deduplicate_lines(df).collect())
    assert got == sorted([("None", hot)] * 7 + [(str(i), "") for i in range(4)] + [("9", hot + "\nx")])
    assert linedup.deduplicate_lines(df.limit(0)).collect() == []


def test_order_is_used_and_no_python_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = linedup.repeated_hashes(linedup.hashed_lines(docs, 40), 5)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("rangepartitioning(h1")]
    assert "Window [row_number()" in top and "Sort [h1" in top and top.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_bitmaps_are_compressed(spark):
    hot = "a line of forty characters or more, repeated"
    rows = [(i, "\n".join(["x"] * 200 + [hot, "y"] + ["z"] * 300)) for i in range(6)]
    got = {r.doc_id: r.keep for r in linedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: {3: ~(1 << 8)} for i in range(5)}


def test_names_may_clash(spark):
    hot = "the same line of forty characters or more, here"
    cols = ["all_lines", "kept_lines", "keep", "words", "row", "id", "hash", "whole", "pos", "line", "key", "h1", "h2", "keeper", "n_docs", "text_hash", "turn", "bits", "word"]
    df = spark.createDataFrame([(*["own"] * 5, i, hot, *["own"] * 14) for i in range(6)], ", ".join(f"{c} string" for c in cols[:5]) + ", doc_id long, text string, " + ", ".join(f"{c} string" for c in cols[5:]))
    out = linedup.deduplicate_lines(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r.text == (hot if r.doc_id == 5 else "") and all(r[c] == "own" for c in cols)
