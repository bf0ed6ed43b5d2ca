"""op13 against a plain run of the filters in every order."""

import random
import re
from itertools import permutations

import numpy as np

from agrolattice.llm.filter_audit import audit, subset_states


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    seen = {}
    for d, t, _ in rows:
        if d is not None:
            seen[t or ""] = min(d, seen.get(t or "", d))
    docs = []
    for d, t, s in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and seen[t] < d}
        known = [x for x in labels if x[0] == d and d is not None]
        docs.append((s or "", fails, any(q == 1 for _, q, _ in known), any(x == 1 for *_, x in known)))
    out, shapley = [], {}
    for part in {p for p, *_ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in docs if x[0] == part]
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                failing = [x for x in docs if x[0] == part and x[1][f]]
                out.append([part, order, step, len(left), len(gone), len(failing) - len(gone), sum(sum(x[1].values()) == 1 for x in failing),
                            sum(x[2] for x in gone), sum(x[3] for x in gone)])
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(11)
    text = lambda n, k: " ".join(rng.choice(["w", "W", "é", "x#", "y"]) + str(rng.randrange(k)) for _ in range(n))
    texts = [None, "", " \t\n", "a\x85b c"] + [text(rng.choice([3, 150, 199, 200, 201, 400]), rng.choice([3, 150, 2000])) for _ in range(60)]
    texts += [" ".join(f"plain{i}" for i in range(200)), "A" * 3 + "b" * 147, "same " * 150_000]
    rows = [(i, t, rng.choice(["s1", "s2", None])) for i, t in enumerate(texts)]
    rows += [(200 + i, texts[i % 9], "s1") for i in range(30)] + [(None, texts[7], "s3"), (None, texts[7], "s3"), (5, texts[5], "s2"), (5, "one more", "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 230, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as fails", "3 as digest", "'x' as good")
    got = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as part", "1 as good"))
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(make_docs([]), none).count() == 0
    rows = audit(make_docs(["some text"]), none).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and {r["shapley"] for r in rows} == {0, 120}


def test_walk_of_all_subsets():
    rng = random.Random(2)
    counts = {m: np.array([rng.randrange(50) for _ in range(3)]) for m in rng.sample(range(32), 20)}
    for subset, state in enumerate(subset_states(counts)):
        assert (state == sum((n for m, n in counts.items() if not m & subset), np.zeros(3, int))).all()
