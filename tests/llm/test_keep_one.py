"""keep_one: exactly one row of each group, whatever the ids."""

from agrolattice.llm.simhash import keep_one

A, B, C = ("one clean text with words of its own", "quite another text that stands alone here", "a third passage nobody else has written")


def kept(df):
    return sorted((str(r["doc_id"]), r["text"]) for r in df.collect())


def test_null_ids(make_docs):
    docs = make_docs([(None, A), (None, A), (None, B), (3, C), (None, C)], extra=True)
    out = keep_one(docs)
    assert kept(out) == sorted([("None", A), ("None", B), ("3", C)]) and out.columns == docs.columns


def test_one_id_on_two_texts(make_docs):
    assert kept(keep_one(make_docs([(1, A), (1, B)]))) == [("1", A), ("1", B)]
    # 1 is the smallest of its first group and a later member of the other
    assert kept(keep_one(make_docs([(1, A), (1, B), (0, B), (2, A), (1, A)]))) == [("0", B), ("1", A)]
