import corpus_pipeline


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = corpus_pipeline.settle(stage(spark, docs, ""))
        if name != "packing":
            assert out.columns == docs.columns, name
            docs = out
        assert stage(spark, no_docs, "").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_copies", "secrets", "mixture", "packing"]


def test_language_id_takes_odd_and_no_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and {2, 3, 4, 5}.isdisjoint(r.doc_id for r in out.collect())
    assert corpus_pipeline.language_id(spark, no_docs, "").count() == 0


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    from tests.llm.conftest import sentence

    rows = [(i, sentence(80, i), "en", f"src{i % 3}", 1) for i in range(30)] + [(50, sentence(80, 1), "en", "src1", 1), (51, "?!", "en", "src1", 1), (52, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    staged = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        staged = corpus_pipeline.settle(stage(spark, staged, ""))
    assert sorted(r.doc_id for r in out if r.piece == 0) == sorted(r.doc_id for r in staged.collect()) and not {50, 51, 52} & {r.doc_id for r in out}
    assert {r.offset for r in out} and all(r.length <= 2048 for r in out)


def test_pipeline_decides_as_its_operators(spark):
    from tests.llm.conftest import sentence

    rows = [(i, sentence(80, i) + (" token=abcdef123456" if i == 5 else ""), "en", f"src{i % 3}", 1) for i in range(20)]
    rows += [(50, sentence(80, 1), "en", "src1", 1), (51, "?!", "en", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 50]
    once = corpus_pipeline.near_copies(spark, kept, "")
    assert sorted(r.doc_id for r in once.collect()) == [*range(20)]
    clean = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, once, "").collect()}
    assert clean[5].endswith("[secret]") and clean[4] == rows[4][1]


def test_columns_of_the_input_come_along(spark):
    from tests.llm.conftest import sentence

    names = ["found", "score", "lang_pred", "domain", "tokens", "leaf_budget", "copies", "component_id", "_nth", "_epoch", "_key", "_cell", "_h"]
    rows = [(i, sentence(80, i) + " token=abcdef123456", "en", f"src{i % 3}", 1, *[f"{n}:{i}" for n in names]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, ""))
        got = docs.collect()
        assert got and all(r[n] == f"{n}:{r.doc_id}" for r in got for n in names), name
    assert corpus_pipeline.packed(spark, docs, "").count() == docs.count()
