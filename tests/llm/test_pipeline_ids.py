import corpus_pipeline as P


def test_near_dedup_stage_keeps_what_is_no_duplicate(spark):
    long = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(None, long("u")), (None, long("v")), (None, long("v")), (None, None), (3, long("a")), (3, long("b")), (4, long("a") + " z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(P.STAGES)["near_dedup"](spark, docs, None)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "-")[0]) for r in out.collect()) == [
        ("3", "a"), ("3", "b"), ("None", "-"), ("None", "u"), ("None", "v")]
