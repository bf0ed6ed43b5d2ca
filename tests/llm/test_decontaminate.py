"""op2: planted items found, against brute force over all windows."""

import math
import re

from agrolattice.llm.decontaminate import contamination, without_leaks

ITEMS = "item_id long, text string"


def brute(docs, items, size=5, least=0.8):
    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    shingles = lambda w: [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    known = {i: shingles(words(t)) for i, t in items if words(t)}
    df = {}
    for s in known.values():
        for x in set(s):
            df[x] = df.get(x, 0) + 1
    weight = lambda x: math.log(1 + len(known) / df.get(x, 1))
    out = {}
    for d, t in docs:
        mine = shingles(words(t))
        for i, s in known.items():
            total = sum(map(weight, s))
            for at in range(len(mine)):
                part = mine[at:at + len(s)]
                both = sum(min(part.count(x), s.count(x)) * weight(x) for x in set(part))
                sim = both / max(total, sum(map(weight, part)))
                if sim >= least:
                    out[d, i] = max(out.get((d, i), 0), round(sim, 6))
    return out


PASSAGE = " ".join(f"w{i}" for i in range(40))
OTHER = " ".join(f"v{i}" for i in range(16)) + " shared words at the end here"


def test_matches_brute_force(make_docs, spark):
    items = [(1, PASSAGE), (2, OTHER), (3, None), (4, "too short"), (5, "other start then shared words at the end here"), (6, "")]
    docs = [(1, f"before it {PASSAGE} after it"), (2, PASSAGE.upper().replace(" ", ", ")), (3, "x " * 3000 + OTHER), (4, None), (5, ""),
            (6, PASSAGE.replace("w7 ", "changed ")), (7, PASSAGE.replace("w7 ", "changed ").replace("w20 ", "").replace("w30 ", "")),
            (8, " ".join(f"w{i}" for i in range(0, 40, 2))), (9, "Too short."), (10, " ".join(f"w{i}" for i in range(30))), (None, f"and {OTHER}"),
            (12, f"{PASSAGE} {OTHER}"), (13, "shared words at the end here")]
    got = contamination(make_docs(docs, extra=True), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == brute(docs, items)


def test_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    small = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 3000]
    want = brute(small, [(r["item_id"], r["text"]) for r in items.collect()])
    ids = {i for i, _ in small}
    got = {(r["doc_id"], r["item_id"]) for r in contamination(docs, items).collect() if r["doc_id"] in ids}
    assert got == set(want)


def test_leaks_go_and_odd_tables(make_docs, spark):
    docs = make_docs([(1, f"x {PASSAGE}"), (2, "clean"), (3, None), (None, "clean")], extra=True)
    items = spark.createDataFrame([(1, PASSAGE)], ITEMS)
    kept = without_leaks(docs, items)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"] and kept.columns == docs.columns
    assert without_leaks(docs, items.limit(0)).count() == 4
    assert contamination(make_docs([]), items).count() == 0
