"""op4: terms of many documents keep their weight."""

from agrolattice.llm.toxicity import toxicity_scores

LABELS = "doc_id long, quality int, toxic int"


def test_toxic_text_copied_to_a_third_of_the_rows(spark, make_docs):
    texts = ["awful nasty vile" if i % 3 == 0 else f"word{i % 7} some filler stands here number{i % 11}" for i in range(600)]
    docs = make_docs([*enumerate(texts), (1000, "this is awful and nasty")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], LABELS)
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(600))
    assert got[1000]["predicted"] == 1 and got[0]["vote"] == 1


def test_repeated_ids_count_once(spark, make_docs):
    """An id of many rows gives one example, the same one whatever the order of the rows."""
    texts = [(i, "awful nasty vile" if i % 3 == 0 else f"some filler stands here number{i % 11}") for i in range(300)]
    many = [(0, f"awful nasty vile {k}") for k in range(500)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], LABELS)
    runs = []
    for rows in (texts + many, many[::-1] + texts):
        got = toxicity_scores(make_docs(rows), labels).collect()
        assert len(got) == 800
        runs.append(sorted((r["doc_id"], r["predicted"], r["score"]) for r in got))
    assert runs[0] == runs[1]
