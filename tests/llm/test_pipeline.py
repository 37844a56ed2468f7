"""The pipeline against a plain version of its stages, on sf0.001."""

from test_operators import lower, plain_components, plain_decontamination

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline
    from leadloom.llm import common, toxicity

    docs = common.table(spark, DATA, "documents")
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, common.table(spark, DATA, "labels")).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect() if not scored[r.doc_id]]
    last = {}
    for i, t in sorted(texts):
        last[lower(t)] = (i, t)
    kept = {k[0] for k in plain_components(sorted(last.values())) if k[3]}
    bench = [(str(r.item_id), r.text) for r in common.table(spark, DATA, "benchmark").collect()]
    left = [(i, t) for i, t in sorted(last.values()) if i in kept]
    clean = {r[0] for r in plain_decontamination(left, bench) if not r[5]}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == clean and all(r.lossless for r in out) and len(out) < docs.count()


def test_stages_keep_the_columns(spark):
    import corpus_pipeline
    from leadloom.llm import common

    docs = common.table(spark, DATA, "documents").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark):
    import corpus_pipeline
    from leadloom.llm import common

    some = common.table(spark, DATA, "documents").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "web", 0), (900, "", "en", "web", 0), (901, "same words here", None, None, 1), (901, "same words here", None, None, 1), (902, "SAME words here", "en", None, 2)], some.schema)
    docs = some.unionByName(odd)
    for c in ("score", "hit", "gone_id", "again", "items"):
        docs = docs.withColumn(c, docs["lang"])
    columns, rows = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.materialise(stage(spark, rows, DATA), "odd")
        assert rows.columns == columns
        assert stage(spark, docs.where("false"), DATA).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    out = last(spark, rows, DATA).collect()
    ids = [r.doc_id for r in out]
    assert all(r.lossless for r in out) and ids.count(901) == 0 and ids.count(902) == 1 and len(ids) == len({*ids})
    assert last(spark, docs.where("false"), DATA).count() == 0
