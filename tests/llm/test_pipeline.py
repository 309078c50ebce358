from seriesloom.llm.decontaminate import find_contamination


def test_stages_on_small_tables(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        after = p.materialize(stage(spark, docs, sf))
        assert after.columns == first.columns, name
        assert after.count() <= docs.count()
        docs = after
    assert find_contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").count() == 0
    pieces = p.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_stages_on_odd_rows(spark, table, odd):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    for name, stage in p.STAGES:
        got = stage(spark, table(odd), sf)
        if name != "packing":
            assert got.columns == table(odd).columns, name
        assert got.count() > 0, name
        assert stage(spark, table([]), sf).count() == 0, name


def test_repeated_rows_leave_one_and_extra_columns_stay(spark, table):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    texts = [f"The {i} {w} of the house is in the {w} and that is how it was for all of us {i}." for i, w in enumerate(("door", "roof", "yard", "wall"))]
    rows = [(i, "\n".join([t, "and one more line of the text that stands in all of them"])) for i, t in enumerate(texts)]
    names = [*table(rows).columns[:5], "document_key", "gone_places", "kept_id", "x_key"]
    docs = table(rows).toDF(*names)
    docs = docs.union(docs)
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, sf))
        assert docs.columns == names, name
        assert docs.count() == (4 if name in ("near_dedup", "decontamination") else 8), name
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2, 3]
    assert sum("stands in all of them" in r.text for r in docs.collect()) == 1


def test_near_copies_without_doc_id_go(spark, table):
    import corpus_pipeline as p

    w = [f"v{i}" for i in range(60)]
    got = p.near_dedup(spark, table([(None, " ".join(w)), (7, " ".join(w[:-1])), (None, "x y z " * 4), (None, "x y z " * 4)]), "").collect()
    assert sorted((r.doc_id or 0, r.text[:3]) for r in got) == [(0, "x y"), (7, "v0 ")]


def test_whole_texts_go_to_workers_in_small_batches(spark, table):
    import corpus_pipeline as p
    from seriesloom.llm.common import bound_batches
    from seriesloom.llm.nearcopies import near_duplicates

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = table([(1, "a text of some words")])
    runs = [("10000", 1000, lambda: near_duplicates(docs)), ("0", 1000, lambda: p.language_id(spark, docs, "")), ("64", 64, lambda: bound_batches(spark))]
    try:
        for given, want, run in runs:
            spark.conf.set(key, given)
            run()
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.unset(key)
