import corpus_pipeline

DOCS = "doc_id long, text string, lang string, n_chars long"


def long_text(k):
    return " ".join(f"word{k}x{i}" for i in range(60))  # over 200 bytes


def test_one_row_of_each_class(spark):
    a, b, c, d = map(long_text, range(4))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (4, c + " "), (None, d), (None, d), (None, a), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], DOCS).repartition(3)
    exact = corpus_pipeline.exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in exact.collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (4, c + " "), (None, d), (5, None)], key=repr)
    # alone too, the near copies keep one row of each class; the one without a text is a class of its own
    near = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=repr)
    assert near == sorted([(1, a), (3, b), (3, c), (None, d), (5, None)], key=repr)
    # and so stage 4 leaves the repeated row's text whole
    whole = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, corpus_pipeline.near_copies(spark, exact, ""), "").collect()}
    assert whole[1] == a and whole[None] == d


def test_language_is_decided_by_row(spark):
    clean = "the rat sat near the cat " * 4
    docs = [(i, ("the cat and the rat sat on the mat near the barn " * 3)[i % 7:], "en") for i in range(60)]
    docs += [(None, clean, "en"), (None, "жшщ " * 40, None), (7, "жшщ " * 40, None), (8, docs[8][1], "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = sorted((tuple(r) for r in corpus_pipeline.language_id(spark, df, "").collect()), key=repr)
    assert got == sorted((r for r in docs if "ж" not in r[1]), key=repr)
