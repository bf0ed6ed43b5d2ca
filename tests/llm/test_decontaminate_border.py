"""op2: pairs near the least similarity, and items of a few words, against all windows."""

import math
import random
from collections import Counter

from agrolattice.llm.decontaminate import contamination

from .test_decontaminate import ITEMS


def all_windows(docs, items, size=5, least=0.8):
    """Like the brute force beside it, for items of ``size`` words or more; pairs without a common
    shingle are left out early."""
    shingles = lambda t: [tuple(t.split()[i:i + size]) for i in range(len(t.split()) - size + 1)]
    known = {i: shingles(t) for i, t in items}
    df = Counter(x for s in known.values() for x in set(s))
    weight = {x: math.log(1 + len(known) / n) for x, n in df.items()}
    unknown = math.log(1 + len(known))
    out = {}
    for d, t in docs:
        mine = shingles(t)
        for i, s in known.items():
            if set(s).isdisjoint(mine):
                continue
            own, total = Counter(s), sum(weight[x] for x in s)
            for at in range(len(mine)):
                part = Counter(mine[at:at + len(s)])
                both = sum(min(n, own[x]) * weight[x] for x, n in part.items() if x in own)
                sim = both / max(total, sum(n * weight.get(x, unknown) for x, n in part.items()))
                if sim >= least:
                    out[d, i] = max(out.get((d, i), 0), round(sim, 6))
    return out


def test_pairs_from_080_to_085(make_docs, spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]  # a passage that half of the items share
    items, docs = [], []
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(rng.randint(14, 90))]
        items.append((i, " ".join(words[:len(words) // 2] + (common[:rng.randint(8, 40)] if i % 2 else []) + words[len(words) // 2:])))
        for _ in range(12):
            text = items[-1][1].split()
            for at in rng.sample(range(len(text)), rng.randint(1, max(1, len(text) // 15))):
                text[at] = f"new{rng.randrange(10 ** 9)}"
            docs.append((len(docs), " ".join(["before", "it", *text, "after", "it"])))
    want = all_windows(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contamination(make_docs(docs), spark.createDataFrame(items, ITEMS)).collect()}
    assert sum(0.8 <= s <= 0.85 for s in want.values()) >= 100
    assert got == want


def test_short_items_inside_documents(make_docs, spark):
    items = spark.createDataFrame([(1, "too short"), (2, "Answer"), (3, "four words stand here"), (4, "never found anywhere")], ITEMS)
    docs = make_docs([(1, "this is Too, short for it, too short"), (2, "the answer"), (3, "four words stand there"), (4, "so four words stand here now"), (5, "short")])
    got = sorted((r["doc_id"], r["item_id"], r["similarity"], r["first_word"], r["n_words"]) for r in contamination(docs, items).collect())
    assert got == [(1, 1, 1.0, 2, 2), (2, 2, 1.0, 1, 1), (4, 3, 1.0, 1, 4)]
