"""op11 against the definition, score by score."""

import math
import random
import re
from collections import Counter

import pytest

from agrolattice.llm.lexical import rank_documents, terms_of

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, top=10):
    low = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(d, Counter(low(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked, found = Counter(low(text)), []
        for d, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def ranks(docs, items, **options):
    return sorted(map(tuple, rank_documents(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def items_of(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as term", "1 as score", "2 as m")


def corpus(rng, n=300):
    words = [f"w{i}" for i in range(120)] + ["Ünïcode", "straße", "naïve-é", "x1", "A", "B2B"]
    text = lambda k: " ".join(rng.choice(words[:rng.randint(5, len(words))]) + rng.choice(["", ",", "!", "\n"]) for _ in range(k))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,; "), (None, text(20)), (None, text(9)), (n + 3, text(4000))]
    docs += [(n + 10 + i, docs[3][1]) for i in range(40)] + [docs[5]] * 3  # ties and repeated rows
    items = [(i, text(rng.randint(1, 25))) for i in range(25)] + [(90, None), (91, ""), (92, "unheard ofthis"), (93, docs[3][1]), (93, docs[3][1]), (94, "w1 w1 W1")]
    return docs, items


def test_matches_brute_force(make_docs, items_of):
    docs, items = corpus(random.Random(5))
    want = brute(docs, items)
    assert ranks(make_docs(docs, extra=True), items_of(items)) == want
    # small strata, shelves and blocks of items do not change the result
    assert ranks(make_docs(docs), items_of(items), stratum_docs=4, shelf_docs=7, shelf_postings=50, block_items=9) == want


def test_empty_tables(make_docs, items_of):
    assert ranks(make_docs([]), items_of([(1, "a")])) == []
    assert ranks(make_docs(["a b"]), items_of([])) == []
    assert ranks(make_docs([None, ""]), items_of([(1, "a")])) == []


def test_terms():
    text = "Ab-c_D9 Été x y \x00z\x1cq\x85"
    assert [t.decode() for t in terms_of(text)] == TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text))


def test_very_long_text(make_docs, items_of):
    docs = [(1, "needle " + "hay " * 1_000_000), (2, "needle hay"), (3, "other words " * 5)]
    assert ranks(make_docs(docs), items_of([(1, "needle other")])) == brute(docs, [(1, "needle other")])
