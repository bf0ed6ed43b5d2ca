"""Links between 64-bit fingerprints within a Hamming radius, through block tables.

The 64 bits are cut into blocks.  Two fingerprints within radius r differ in at most r
blocks, so among any r + c blocks they agree on c: each choice of c of those blocks is a
table, keyed by the chosen blocks, and no pair within the radius is missed.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


#: One bit in each lane: adding (hash >> k) & mask counts the bits k, k + step, ... at once.
_LANES = {8: "72340172838076673L", 32: "4294967297L"}  # 0x0101010101010101, 0x0000000100000001
_NARROW_MOST = 127


def _majority(hashes: str, count: str, step: int) -> str:
    zero = ", ".join(f"0L as s{k}" for k in range(step))
    add = ", ".join(f"a.s{k} + (shiftrightunsigned(x, {k}) & {_LANES[step]}) as s{k}" for k in range(step))
    bits = " | ".join(
        f"shiftleft(cast(2 * (shiftrightunsigned(a.s{k}, {lane * step}) & {(1 << step) - 1}L) > {count} as bigint), {lane * step + k})"
        for k in range(step) for lane in range(64 // step))
    return f"aggregate({hashes}, struct({zero}), (a, x) -> struct({add}), a -> {bits})"


def simhash_sql(hashes: str, count: str) -> str:
    """SQL of the 64-bit SimHash of an array of hashes, repeats included: the bits set in over
    half of them.  Counts are kept in lanes of 8 bits for up to 127 hashes, of 32 beyond."""
    return (f"case when {count} <= {_NARROW_MOST} then {_majority(hashes, count, 8)} "
            f"else {_majority(hashes, count, 32)} end")


def byte_blocks() -> list[tuple[int, int]]:
    """(shift, width) of the eight bytes, the leading byte first."""
    return [(56 - 8 * i, 8) for i in range(8)]


def even_blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` blocks of nearly equal width that cover 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _block(value: str, block: tuple[int, int]) -> str:
    return f"(shiftrightunsigned({value}, {block[0]}) & {(1 << block[1]) - 1}L)"


def _key(value: str, table: int, chosen: list[tuple[int, int]]) -> str:
    """The chosen blocks side by side, and the table's number in the top byte."""
    out = "0L"
    for b in chosen:
        out = f"(shiftleft({out}, {b[1]}) | {_block(value, b)})"
    return f"({out} | {table << 56}L)"


def buckets(nodes: DataFrame, radius: int, blocks: list[tuple[int, int]], together: int,
            also: str = "true") -> DataFrame:
    """The index: id, fp, key, the leader ``lead`` (a struct like the node) and ``tied`` of every
    node in a bucket that it shares; written out, as several joins read it.

    ``nodes`` has a distinct long ``id``, a long ``fp``, a ``weight`` and any further columns;
    ``also`` is a condition on ``a.`` and ``b.`` columns that linked nodes must hold too.  The
    first ``radius + together`` blocks index a node, ``together`` of them to a key.  A bucket's
    leader is its heaviest node; nodes within the radius of it are tied to it.
    """
    tables = _tables(radius, blocks, together)
    extra = [c for c in nodes.columns if c not in ("id", "fp", "weight")]
    keys = F.array(*[F.expr(_key("fp", t, [blocks[i] for i in c])) for t, c in enumerate(tables)])
    rows = nodes.select("id", "fp", "weight", *extra, F.explode(keys).alias("key"))
    whole = (Window.partitionBy("key").orderBy(F.desc("weight"), "id")
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = (rows.withColumn("n", F.count(F.lit(1)).over(whole))
           .withColumn("lead", F.first(F.struct("id", "fp", *extra)).over(whole)).where("n > 1"))
    tied = _near(radius, also).replace("b.", "lead.").replace("a.", "")
    return materialize(met.withColumn("tied", F.expr(f"id = lead.id or ({tied})")).drop("weight", "n"), "buckets")


def linked_pairs(met: DataFrame, radius: int, blocks: list[tuple[int, int]], together: int,
                 also: str = "true", loose: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of ids whose components are those of all pairs within ``radius`` bits.

    Nodes tied to one leader are connected through it, so a pair of two of them says nothing
    new and is not emitted: a dense group yields about one pair a node.  Any other pair comes
    out once, in the first table where its nodes meet.

    With ``loose`` (ids whose tie to a leader did not stand a later check) the result is the
    pairs of those ids with all others in their buckets instead.
    """
    tables = _tables(radius, blocks, together)
    first = " or ".join(
        "(a.t = {} and {})".format(t, " and ".join(
            [f"{_block('(a.fp ^ b.fp)', blocks[i])} <> 0" for i in range(c[-1]) if i not in c] or ["true"]))
        for t, c in enumerate(tables))
    slim = met.drop("lead").withColumn("t", F.expr("shiftrightunsigned(key, 56)"))
    if loose is not None:
        left = slim.join(loose.select("id").distinct(), "id", "left_semi").alias("a")
        pairs = left.join(slim.alias("b"), F.expr(f"a.key = b.key and a.id <> b.id and {_near(radius, also)} and ({first})"))
        return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    stars = met.where("tied and id <> lead.id").select(F.col("lead.id").alias("a"), F.col("id").alias("b"))
    a, b = slim.alias("a"), slim.alias("b")
    pairs = a.join(b, F.expr(f"a.key = b.key and a.id < b.id and not (a.tied and b.tied) and {_near(radius, also)} and ({first})"))
    return stars.union(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))).distinct()


def _tables(radius: int, blocks: list[tuple[int, int]], together: int) -> list[tuple[int, ...]]:
    return list(combinations(range(min(len(blocks), radius + together)), together))


def _near(radius: int, also: str) -> str:
    return f"a.id <> b.id and bit_count(a.fp ^ b.fp) <= {radius} and ({also})"
