"""Sums of clipped windows against windows with all their members, for windows within a segment and over many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.operators import intervals, windows


def plain(rows, anchor, half, k):
    """Each window and filter by its members; rows are (stem, seconds, filter, score)."""
    out = {}
    for a in {(r[0], r[1]) for r in rows if r[2] == anchor and r[1] is not None}:
        for name in {r[2] for r in rows}:
            own = sorted((r for r in rows if r[2] == name and r[1] is not None and r[3] is not None and r[3] == r[3] and abs(r[1] - a[1]) <= half), key=lambda r: (r[1], r[0]))
            if not own:
                continue
            v = np.array([r[3] for r in own])
            keep = v >= (v.mean() - k * v.std() if v.max() > v.min() else -np.inf)
            if not keep.any():
                keep[v.argmax()] = True
            out[a[0], a[1], name] = (len(v), v.mean(), v.std(), int(keep.sum()), v[keep].mean(), v[keep].std(), own[int(np.flatnonzero(keep)[0])][1], own[int(np.flatnonzero(keep)[-1])][1])
    return out


def captures(spark, rows):
    df = spark.createDataFrame([(s, t, f, v) for s, t, f, v in rows], "stem string, t double, filter string, norm_score double")
    return df.select("stem", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "filter", "norm_score", F.lit("x").alias("seg"), F.lit(1).alias("c")).repartition(3)


def found(df, k):
    rows = intervals.clipped_windows(df, "IR", 10.0, k).collect()
    assert sorted(rows) == sorted(intervals.clipped_windows(df, df.where("filter = 'IR'"), 10.0, k).collect())
    assert len({(r["window_id"], r["c"], r["filter"]) for r in rows}) == len(rows)
    root = lambda r, s, n: (r[s] / r[n]) ** 0.5
    return {(r["window_id"], r["c"] / 1e6, r["filter"]): (r["n"], r["mean"], root(r, "squares", "n"), r["n_in"], r["mean_in"], root(r, "squares_in", "n_in"), r["first_t"] / 1e6, r["last_t"] / 1e6) for r in rows}


def equal(got, want):
    assert got.keys() == want.keys() and want
    for key, w in want.items():
        assert np.allclose(got[key], w, rtol=1e-9, atol=1e-9), (key, got[key], w)


@pytest.mark.parametrize("bits", [2, 5, 16])
@pytest.mark.parametrize("k", [0.0, 0.5, 1.5])
def test_windows_equal_members(spark, monkeypatch, bits, k):
    monkeypatch.setattr(intervals, "SEGMENT_BITS", bits)
    r = np.random.default_rng(bits + int(10 * k))
    rows = [(f"s{i}", float(r.integers(0, 4000)) + 0.25 * float(r.integers(4)), "IR R G".split()[int(r.integers(3))], float(np.round(r.random() ** 3, 2))) for i in range(150)]
    rows += [(f"d{i}", 5000.0 + (i % 3), "IR" if i % 20 == 0 else "R", 0.5) for i in range(60)]  # dense and equal
    rows += [(f"e{i}", 9000.0 + 600.0 * i, "IR", 0.1 * i) for i in range(4)]  # windows that end on other captures
    rows += [("n0", 7000.0, "IR", None), ("n4", 7100.0, "R", 0.3), ("n1", None, "IR", 0.4), ("n2", 100.0, "R", None), ("n3", 120.0, "R", float("nan"))]
    equal(found(captures(spark, rows), k), plain(rows, "IR", 300.0, k))


def test_repeated_anchors_count_once_and_empty_tables(spark):
    rows = [("a", 10.0, "IR", 0.3), ("a", 10.0, "IR", 0.3), ("b", 20.0, "R", 0.2)]
    got = found(captures(spark, rows), 1.5)
    assert got["a", 10.0, "IR"][0] == 2 and len(got) == 2
    none = captures(spark, rows).limit(0)
    assert intervals.clipped_windows(none, none, 10.0, 1.5).count() == 0
    only = captures(spark, rows)
    assert intervals.clipped_windows(only, none, 10.0, 1.5).count() == 0


def test_rated_windows_equal_the_way_over_members(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SEGMENT_BITS", 4)
    r = np.random.default_rng(3)
    rows = [(f"s{i}", float(i * 20 + r.integers(20)), "IR R G".split()[i % 3], float(r.random())) for i in range(200)]
    df = captures(spark, rows)
    got = windows.rated_windows(df, 10.0, 5.0, 1.0).toPandas()
    want = windows.filter_quality(windows.sigma_clip(windows.anchor_windows(df, 10.0), 1.0), 5.0).toPandas()
    order = ["window_id", "filter"]
    got, want = (x.sort_values(order, ignore_index=True)[want.columns] for x in (got, want))
    assert got.select_dtypes(exclude="number").equals(want.select_dtypes(exclude="number"))
    assert np.allclose(got.select_dtypes("number"), want.select_dtypes("number"), atol=1e-9)


def test_no_row_for_each_window_and_member(spark):
    """Ten thousand captures within one window of each other: rows stay linear."""
    df = spark.range(10_000).select(F.col("id").cast("string").alias("stem"), F.timestamp_millis(F.col("id")).alias("ts"), F.when(F.col("id") % 2 == 0, "IR").otherwise("R").alias("filter"), F.rand(1).alias("norm_score"))
    rows = intervals.clipped_windows(df, df.where("filter = 'IR'"), 10.0, 1.5)
    assert rows.count() == 10_000 and {r["n"] for r in rows.select("n").distinct().collect()} == {5000}


def test_ranges_of_scores():
    r = np.random.default_rng(9)
    v, t = np.round(r.random(777), 2), np.sort(r.integers(0, 500, 777))
    held = intervals.ScoresInTime(t, v)
    i = r.integers(0, 777, 300)
    j = np.minimum(777, i + r.integers(0, 400, 300))
    x = np.round(r.random(300), 2)
    n, mean, squares = held.above(i, j, x)
    for k in range(300):
        own = v[i[k] : j[k]]
        kept = own[own >= x[k]]
        assert n[k] == len(kept) and (not len(kept) or np.allclose((mean[k], squares[k]), (kept.mean(), kept.var() * len(kept))))
        at = i[k] + np.flatnonzero(own >= x[k])
        assert held.first(i, j, x)[k] == (at[0] if len(at) else j[k]) and held.last(i, j, x)[k] == (at[-1] if len(at) else i[k] - 1)
        assert intervals.greatest(held.high, i, j)[k] == (own.max() if len(own) else -np.inf)


def many(spark):
    r = np.random.default_rng(5)
    rows = [(f"s{i}", float(r.integers(0, 4000)) + 0.5 * float(r.integers(2)), ["IR", "R", None][int(r.integers(3))], float(np.round(1 - r.random() ** 3, 2))) for i in range(200)]
    rows += [(f"d{i}", 5000.0 + 300.0 * (i % 3), "IR" if i % 20 == 0 else "R", 0.5) for i in range(60)]
    return captures(spark, [*rows, ("n1", None, "IR", 0.4)])


@pytest.mark.parametrize("k", [0.55, 1.5])
def test_clipped_and_nested_windows_equal_the_way_over_members(spark, monkeypatch, k):
    monkeypatch.setattr(intervals, "SEGMENT_BITS", 4)
    df = many(spark)
    want = windows.sigma_clip(windows.anchor_windows(df, 10.0), k)
    plain_rows = lambda d: sorted(map(str, d.select("window_id", "center_ts", "filter", "stem", "ts", "norm_score", "included").collect()))
    got = windows.clipped_members(df, 10.0, k)
    assert plain_rows(got) == plain_rows(want) and got.where("not included").count() > 0
    named = df.where("filter IS NOT NULL")
    members = windows.sigma_clip(windows.anchor_windows(named, 10.0), k)
    a = {r["window_id"]: r for r in windows.nested(windows.filter_quality(members, 5.0), members).collect()}
    b = {r["window_id"]: r for r in windows.nested_windows(named, 10.0, 5.0, k).collect()}
    assert a.keys() == b.keys()
    for w, r in a.items():
        assert r["center_ts"] == b[w]["center_ts"] and list(r["per_filter"]) == list(b[w]["per_filter"])
        for f, one in r["per_filter"].items():
            two = b[w]["per_filter"][f].asDict()
            assert one["included"] == two.pop("included") and one["excluded"] == two.pop("excluded")
            assert all(np.isclose(one[n], v, atol=1e-4) for n, v in two.items())


def test_members_are_not_dealt_by_window(spark):
    df = many(spark)
    assert "Window [" not in windows.clipped_members(df, 10.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    plan = windows.nested_windows(df, 10.0, 5.0, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 3 and "collect_list(struct(stem" in plan


def test_members_are_looked_up_by_many_tasks(spark):
    """What a task makes of its rows, not their size, is its work: no task has a large part of the members."""
    df = spark.range(4000).select(F.col("id").cast("string").alias("stem"), F.timestamp_seconds(F.col("id") * 6).alias("ts"), F.when(F.col("id") % 2 == 0, "IR").otherwise("R").alias("filter"), F.rand(1).alias("norm_score"))
    for found in (windows.anchor_windows(df, 10.0), windows.clipped_members(df, 10.0, 1.5)):
        shares = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("part")).count().collect()]
        assert max(shares) < 0.1 * sum(shares) and sum(shares) > 100 * 2000 * 0.9


def test_nested_windows_are_made_by_many_tasks(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("stem"), F.timestamp_seconds(F.col("id") * 6).alias("ts"), F.when(F.col("id") % 2 == 0, "IR").otherwise("R").alias("filter"), F.rand(1).alias("norm_score"))
    shares = [r["count"] for r in windows.nested_windows(df, 10.0, 5.0).groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert max(shares) < 0.1 * sum(shares) and sum(shares) == 2000
