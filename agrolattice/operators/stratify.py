"""M4, M6: exact stratified parts by order statistics of a row hash.

Each row's hash is md5(salt | key), which other engines compute alike.  A class's cut for a rank
is found by counting rows by a hash prefix, then within the prefix that holds the rank, and so
on until few rows are left: no window and no sort over a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(key: str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")))


def rank_cuts(df: DataFrame, group: str, hashed: str, ranks: dict, most: int = 10_000) -> dict:
    """(group, rank) -> the hash of that rank (1 is the smallest) in the group; ``ranks`` has the
    wanted ranks of each group.  At most ``most`` hashes of a prefix reach the driver."""
    wanted = {(g, r): ("", r) for g, rs in ranks.items() for r in rs if r > 0}
    out = {}
    while wanted:
        length = len(next(iter(wanted.values()))[0])
        open_prefixes = sorted({(g, p) for (g, _), (p, _) in wanted.items()}, key=repr)
        inside = F.lit(False)
        for g, p in open_prefixes:
            inside = inside | (F.col(group).eqNullSafe(F.lit(g)) & F.col(hashed).startswith(p))
        rows = df.where(inside)
        if length >= 32 or rows.count() <= most * len(open_prefixes):
            found: dict = {}
            counted = rows.groupBy(group, hashed).count().collect()
            for r in counted:
                found.setdefault(r[group], []).append((r[hashed], r["count"]))
            for (g, rank), (p, left) in wanted.items():
                for h, n in sorted(x for x in found.get(g, []) if x[0].startswith(p)):
                    left -= n
                    if left <= 0:
                        out[g, rank] = h
                        break
            return out
        counts: dict = {}
        for r in rows.groupBy(group, F.substring(hashed, 1, length + 4).alias("p")).count().collect():
            counts.setdefault(r[group], []).append((r["p"], r["count"]))
        for (g, rank), (p, left) in list(wanted.items()):
            for q, n in sorted(x for x in counts[g] if x[0].startswith(p)):
                if left <= n:
                    wanted[g, rank] = (q, left)
                    break
                left -= n
    return out


def _cut_column(group: str, cuts: dict, which) -> Column:
    """The cut of a row's group (null without one)."""
    out = F.lit(None).cast("string")
    for (g, r), h in cuts.items():
        if which(g, r):
            out = F.when(F.col(group).eqNullSafe(F.lit(g)), h).otherwise(out)
    return out


def stratified(df: DataFrame, key: str, group: str, test_share: float = 0.2, folds: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``part`` ('test' or 'train') and ``fold`` (0 to ``folds`` - 1).

    Of each class of ``group`` the round(``test_share`` * n) rows with the smallest hashes are the test
    part, and the rows of each (part, class) are dealt to folds of equal size (to one row) in the order
    of a second hash.  ``key`` identifies rows; rows with one key go together.
    """
    h = df.withColumn("_h", row_hash(key, f"split{seed}"))
    sizes = {r[group]: r["count"] for r in h.groupBy(group).count().collect()}
    tests = {g: [int(test_share * n + 0.5)] for g, n in sizes.items()}
    cuts = rank_cuts(h, group, "_h", tests)
    h = h.withColumn("part", F.when(F.col("_h") <= _cut_column(group, cuts, lambda g, r: True), "test").otherwise("train"))
    h = h.withColumn("_g", F.concat_ws("|", "part", F.col(group).cast("string"))).withColumn("_h", row_hash(key, f"fold{seed}"))
    sizes = {r["_g"]: r["count"] for r in h.groupBy("_g").count().collect()}
    # fold f has the ranks over f * n / folds, rounded down, to (f + 1) * n / folds
    edges = {g: sorted({f * n // folds for f in range(1, folds)} - {0}) for g, n in sizes.items()}
    cuts = rank_cuts(h, "_g", "_h", edges)
    fold = F.lit(0)
    for f in range(1, folds):
        edge = F.lit(None).cast("string")
        for g, n in sizes.items():
            hash_ = cuts.get((g, f * n // folds), "")
            edge = F.when(F.col("_g") == g, hash_).otherwise(edge)
        fold = fold + (F.col("_h") > edge).cast("int")
    return h.withColumn("fold", fold).drop("_h", "_g")
