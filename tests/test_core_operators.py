"""Hand-computed cases for the core operators (nulls, ties, empty groups, hot groups)."""

from pyspark.sql import functions as F

from agrolattice.operators.dedup import dedup_keep_first, duplicate_report
from agrolattice.operators.gapfill import gap_fill_linear
from agrolattice.operators.impute import global_mean_impute, group_mean_impute
from agrolattice.operators.profile import column_profile
from agrolattice.operators.topk import top_n_per_group


def test_gap_fill_interior_edges_and_empty_group(spark):
    rows = [("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, None), ("a", 5, 4.0), ("a", 6, None),
            ("b", 1, None), ("b", 2, None)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    # chunk every two positions: values must flow across chunk boundaries
    out = gap_fill_linear(df, ["g"], ["t"], ["v"], chunk=F.floor((F.col("t") - 1) / 2))
    got = {(r.g, r.t): r.v for r in out.collect()}
    assert got[("a", 1)] == 1.0          # back-filled from the first value
    assert got[("a", 3)] == 2.0          # linear between positions 2 and 5
    assert got[("a", 4)] == 3.0
    assert got[("a", 6)] == 4.0          # forward-filled after the last value
    assert got[("b", 1)] is None and got[("b", 2)] is None  # all-null group stays null


def test_gap_fill_single_chunk_equals_multi_chunk(spark):
    import random
    random.seed(7)
    rows = [("g", i, None if random.random() < 0.4 else float(random.randint(0, 100))) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    one = {r.t: r.v for r in gap_fill_linear(df, ["g"], ["t"], ["v"], chunk=F.lit(0)).collect()}
    many = {r.t: r.v for r in gap_fill_linear(df, ["g"], ["t"], ["v"], chunk=F.floor(F.col("t") / 7)).collect()}
    assert one.keys() == many.keys()
    for k in one:
        assert (one[k] is None and many[k] is None) or abs(one[k] - many[k]) < 1e-9


def test_dedup_keep_first_nulls_last(spark):
    rows = [("u1", "b", "x"), ("u1", "a", None), ("u1", "a", "z"), ("u2", None, "y"), ("u2", "c", None)]
    df = spark.createDataFrame(rows, "UID string, t string, d string")
    got = {r.UID: (r.t, r.d) for r in dedup_keep_first(df, "UID").collect()}
    assert got == {"u1": ("a", "z"), "u2": ("c", None)}
    filled = {r.UID: (r.t, r.d) for r in dedup_keep_first(df, "UID", prefer="filled").collect()}
    assert filled["u1"] == ("a", "z") and filled["u2"] == ("c", None)


def test_duplicate_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "k int, v string")
    r = duplicate_report(df).first()
    assert (r.n_rows, r.n_distinct, r.n_duplicates) == (4, 2, 2)


def test_group_and_global_mean_impute(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("x", 3.0), ("y", None), (None, None)],
                               "c string, v double")
    got = sorted((r.c or "", r.v) for r in group_mean_impute(df, "c", ["v"]).collect())
    assert got == [("", None), ("x", 1.0), ("x", 2.0), ("x", 3.0), ("y", None)]
    g = sorted(r.v for r in global_mean_impute(df, "v").collect())
    assert g == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_column_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "a")], "a int, b string")
    got = {r.column_name: (r.n_nulls, r.null_pct) for r in column_profile(df).collect()}
    assert got == {"a": (1, 33.33), "b": (2, 66.67)}


def test_top_n_per_group_hot_group(spark):
    rows = [("hot", i) for i in range(1000)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, k int")
    out = top_n_per_group(df, ["g"], [F.col("k").desc()], 5, ["k"], buckets=16)
    got = sorted((r.g, r.rank, r.k) for r in out.collect())
    assert [x[2] for x in got if x[0] == "hot"] == [999, 998, 997, 996, 995]
    assert [x[2] for x in got if x[0] == "cold"] == [2, 1, 0]


def test_auto_chunks_split_hot_group_and_keep_results(spark):
    import random

    from agrolattice.operators.gapfill import auto_chunks
    random.seed(3)
    rows = [("hot", i, None if random.random() < 0.5 else float(i % 17)) for i in range(400)]
    rows += [("cold", i, None if i % 2 else float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    sizes = {(r.g, r["_chunk"]): r["count"] for r in auto_chunks(df, ["g"], ["t"], 50).groupBy("g", "_chunk").count().collect()}
    assert sum(sizes.values()) == 405 and max(sizes.values()) <= 100
    assert sum(g == "hot" for g, _ in sizes) >= 8 and sum(g == "cold" for g, _ in sizes) <= 2
    auto = {(r.g, r.t): r.v for r in gap_fill_linear(df, ["g"], ["t"], ["v"], target_rows=50).collect()}
    one = {(r.g, r.t): r.v for r in gap_fill_linear(df, ["g"], ["t"], ["v"], chunk=F.lit(0)).collect()}
    assert auto.keys() == one.keys()
    assert all((one[k] is None and auto[k] is None) or abs(one[k] - auto[k]) < 1e-9 for k in one)


def test_gap_fill_spreads_a_burst_at_one_instant(spark):
    """Rows that agree in the order column are cut by the tie-break; results are those of one chunk."""
    import random

    from agrolattice.operators.gapfill import auto_chunks
    random.seed(4)
    rows = [("burst", 7, i, None if random.random() < 0.6 else float(i % 23)) for i in range(1000)]
    rows += [(g, t, 0, float(t) if t % 5 == 0 else None) for g in ("a", None) for t in range(40)] + [("void", t, 0, None) for t in range(30)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, seq int, v double")
    sizes = auto_chunks(df, ["g"], ["t", "seq"], 50).groupBy("g", "_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 100 and sum(r.g == "burst" for r in sizes) >= 15
    key = lambda r: (str(r.g), r.t, r.seq)
    many, one = (sorted(gap_fill_linear(df, ["g"], ["t", "seq"], ["v"], target_rows=n).collect(), key=key) for n in (50, 10_000))
    assert [key(r) for r in many] == [key(r) for r in one] and len(one) == len(rows)
    assert all((x.v is None) == (y.v is None) and (x.v is None or abs(x.v - y.v) < 1e-9) for x, y in zip(many, one))


def test_exact_quantiles_match_numpy_with_hot_group(spark):
    import numpy as np

    from agrolattice.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(5)
    hot = [("hot", float(x)) for x in rng.normal(10, 3, 3000).round(3)]
    small = [("one", 7.0), ("two", 1.0), ("two", 4.0), ("ties", 2.0), ("ties", 2.0), ("ties", 5.0), ("nul", None)]
    df = spark.createDataFrame(hot + small, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75], num_partitions=7).collect()}
    for g in ("hot", "one", "two", "ties"):
        vals = np.array([v for k, v in hot + small if k == g and v is not None])
        want = np.quantile(vals, [0.25, 0.5, 0.75])
        assert got[g].n == len(vals)
        assert all(abs(a - b) < 1e-9 for a, b in zip((got[g].q0, got[g].q1, got[g].q2), want))
    assert "nul" not in got                                     # only-null group has no quantiles


def test_box_stats_methods_agree(spark):
    import random

    from agrolattice.operators.summaries import box_stats
    random.seed(11)
    rows = [(("A" if i % 10 else "B"), "D", float(random.randint(0, 500)) / 7) for i in range(600)]
    df = spark.createDataFrame(rows, "cultivo string, departamento string, rendimiento_ton_ha double")
    a = {r.cultivo: r for r in box_stats(df, method="sort").collect()}
    b = {r.cultivo: r for r in box_stats(df, method="count_map").collect()}
    c = {r.cultivo: r for r in box_stats(df, method="approx").collect()}
    for k in a:
        for f in ("q1", "median", "q3", "lower_fence", "upper_fence", "min", "max"):
            assert abs(a[k][f] - b[k][f]) < 1e-9
        assert abs(a[k].median - c[k].median) < 2.0               # approximate: close, from the data


def test_table_profile(spark):
    from agrolattice.operators.profile import table_profile
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "a"), (None, None), (1, None), (2, "a")]
    got = table_profile(spark.createDataFrame(rows, "x int, `y.z` string")).first()
    assert (got["rows"], got["cells"], got["nulls"], got["duplicates"]) == (7, 14, 5, 2) and abs(got["null_share"] - 5 / 14) < 1e-12
    assert tuple(table_profile(spark.createDataFrame([], "x int")).first()) == (0, 0, 0, 0.0, 0)
