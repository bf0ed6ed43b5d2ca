"""op10 against brute force: fingerprints from the definition, links by all pairs."""

import re

import xxhash

from agrolattice.llm.components import components
from agrolattice.llm.simhash import fingerprint, keep_one, near_duplicates


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, bits=3):
    fps = [brute_fingerprint(t) for _, t in items]
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, fps[i], low.get(find(i))) for i, (d, _) in enumerate(items)), key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in df.collect()), key=repr)


def test_whole_table_matches_brute_force(sf_docs):
    items = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    assert rows_of(near_duplicates(sf_docs)) == brute_components(items)


def test_chains_hot_groups_and_odd_rows(make_docs):
    base = " ".join(f"word{i}" for i in range(400))
    near = [base.replace(f"word{i} ", f"other{i} ", 1) for i in range(0, 390, 13)]
    items = [(5, None), (6, ""), (7, " \t\n"), (None, base), (8, base), (8, base), (9, base.upper()), (10, "one two"), (11, "a b c"),
             (12, "ſtraße K x"), *[(100 + i, t) for i, t in enumerate(near)]]
    assert rows_of(near_duplicates(make_docs(items, extra=True))) == brute_components(items)


def test_empty_table_and_keep_one(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    kept = keep_one(make_docs(["a b c d e", "A B C D E", "quite other words stand here", "", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_long_text_is_whole():
    text = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    assert fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0
