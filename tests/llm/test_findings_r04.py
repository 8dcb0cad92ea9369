from tallymart.llm import ngram_join


def test_pieces_of_a_block_give_the_links_of_the_whole(spark, monkeypatch):
    words = [f"w{k}" for k in range(120)]
    docs = spark.createDataFrame([(i, " ".join(words[: i % 4] + words[4:] + [f"x{i}"])) for i in range(24)], "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "PIECE", 3)
    for block in (24, 5):
        got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.jaccard_join(docs, block_docs=block).collect()}
        assert got == {i: (0, 23) for i in range(24)}
