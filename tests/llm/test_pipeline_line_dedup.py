import corpus_pipeline


def test_a_footer_between_blank_lines_goes(spark):
    rows = [(i, f"text {i}\n\nfooter\n\nend {i}", f"s{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert got == {i: t if i == 0 else f"text {i}\n\n\nend {i}" for i, t, _ in rows}


def test_inner_lines_of_a_block_go(spark):
    rows = [(i, f"text {i}\nlicence one\nlicence two\nlicence three", f"s{i}") for i in range(5)]
    docs = spark.createDataFrame([*rows, (9, "licence four\nlicence two", "s0")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert got == {0: rows[0][1], **{i: f"text {i}" for i in range(1, 5)}, 9: "licence four"}
