"""Steps whose time or memory must not outgrow the rows, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbena.all import arrange, cume_dist, dense_rank, desc, f, fill, group_by, inner_join, left_join, min_rank, percent_rank, rank, right_join, row_number, slice_, slice_head, slice_sample, transmute, ungroup
from verbena.frame import Frame
from verbena.functions import math as math_functions


def plan(frame: Frame) -> str:
    return frame.df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(8)
    rows = [(k, r.choice([None, None, *range(50)]), r.choice(["p", "q", None]), r.choice([None, None, None, 0, 1])) for k in range(9000)]
    path = str(tmp_path_factory.mktemp("scale") / "t.parquet")
    spark.createDataFrame(rows, "id bigint, k bigint, s string, v bigint").repartition(5).write.parquet(path)
    return path, rows


@pytest.mark.parametrize("groups", [(), ("s",)])
@pytest.mark.parametrize("way", ["up", "downup", "updown"])
def test_fill_from_behind_reads_each_row_once(spark, table, groups, way):
    path, rows = table
    frame = Frame(spark.read.parquet(path)) >> arrange(f.id) >> group_by(*[f[g] for g in groups])
    out = frame >> fill(f.v, _direction=way) >> ungroup()
    assert "unboundedfollowing" not in plan(out).lower().replace("unboundedpreceding$(), unboundedfollowing$()", "")  # which is read again for every row
    want = {}
    for key in {x[2] for x in rows} if groups else [None]:
        part = [x for x in rows if not groups or x[2] == key]
        down, up = {}, {}
        for side, order in ((down, part), (up, part[::-1])):
            seen = None
            for x in order:
                seen = x[3] if x[3] is not None else seen
                side[x[0]] = seen
        for x in part:
            both = (up,) if way == "up" else (down, up) if way == "downup" else (up, down)
            want[x[0]] = next((s[x[0]] for s in both if s[x[0]] is not None), None)
    assert {r["id"]: r["v"] for r in out.df.select("id", "v").collect()} == want


@pytest.mark.parametrize("join", [inner_join, left_join, right_join])
def test_rows_with_many_matches_are_dealt_evenly(spark, tmp_path, join):
    """One file is read by one task, which would make all pairs alone."""
    sides = {"x": [(i, i % 4 or None) for i in range(400)], "y": [(i, i % 5 or None) for i in range(300)]}
    for name, rows in sides.items():
        spark.createDataFrame(rows, f"{name} bigint, k bigint").coalesce(1).write.parquet(str(tmp_path / name))
    x, y = (Frame(spark.read.parquet(str(tmp_path / name))) for name in sides)
    out = join(x, y, by="k", na_matches="never").df
    want = Counter((a, b) for a, p in sides["x"] for b, q in sides["y"] if p is not None and p == q)
    if join is left_join:
        want.update((a, None) for a, p in sides["x"] if p is None)
    if join is right_join:
        want.update((None, b) for b, q in sides["y"] if q in (None, 4))
    assert Counter((r["x"], r["y"]) for r in out.select("x", "y").collect()) == want
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(shares) >= 4 and max(shares) < sum(want.values()) / 2


def test_bessel_functions_compute_each_pair_once(monkeypatch):
    calls = []
    plain = math_functions.quadrature
    monkeypatch.setattr(math_functions, "quadrature", lambda *args: calls.append(1) or plain(*args))
    x, nu = [0.5, 2.0, 0.5, -0.0, 0.0, 2.0] * 200, [0.0, 1.5, 0.5, 0.0, 0.0, 1.5] * 200
    for fn in (math_functions.bessel_j_values, math_functions.bessel_i_values, math_functions.bessel_y_values, math_functions.bessel_k_values):
        calls.clear()
        got = fn(np.array(x), np.array(nu))
        assert len(calls) <= 10  # two for each of five pairs
        assert got.tolist() == [fn([a], [b])[0] for a, b in zip(x[:6], nu[:6], strict=True)] * 200
    assert math_functions.bessel_j_values(np.array([[1.0, 2.0], [2.0, 1.0]]), 0).shape == (2, 2) and math_functions.bessel_k_values(np.array([]), np.array([])).shape == (0,)


@pytest.mark.parametrize("values", [30, 6000])
@pytest.mark.parametrize("missing", ["keep", "top", "bottom"])
def test_ranks_in_large_groups(spark, tmp_path, values, missing):
    """Rows of one group are not sorted by one task: with few values they are counted, with many
    their values are numbered by ranges."""
    r = random.Random(values)
    rows = [(i, r.choice(["p", "p", "q", None]), r.choice([None, *[r.randrange(values) / 2 for _ in range(9)], -0.0])) for i in range(9000)]
    spark.createDataFrame(rows, "id bigint, s string, v double").repartition(5).write.parquet(str(tmp_path / "t"))
    frame = Frame(spark.read.parquet(str(tmp_path / "t"))) >> group_by(f.s)
    held = {"na_last": missing}
    out = frame >> transmute(id=f.id, lo=min_rank(f.v, **held), de=dense_rank(f.v, **held), cu=cume_dist(f.v, **held), pe=percent_rank(f.v, **held), down=min_rank(desc(f.v), **held), av=rank(f.v, na_last={"keep": "keep", "top": False, "bottom": True}[missing]))
    assert "Window [rank(" not in plan(out)
    want = {}
    for key in ("p", "q", None):
        part = [x for x in rows if x[1] == key and (missing != "keep" or x[2] is not None)]
        place = {}
        for down in (False, True):
            order = sorted({x[2] for x in part if x[2] is not None}, reverse=down)
            order = [None, *order] if missing == "top" else [*order, None]
            counts = Counter(x[2] for x in part)
            before, dense = 0, 0
            for v in order:
                if counts[v]:
                    dense += 1
                    place[v, down] = (before + 1, dense, before + counts[v])
                    before += counts[v]
        for x in part:
            lo, de, upto = place[x[2], False]
            want[x[0]] = (lo, de, upto / len(part), (lo - 1) / (len(part) - 1), place[x[2], True][0], (lo + upto) / 2)
    got = {x["id"]: (x["lo"], x["de"], x["cu"], x["pe"], x["down"], x["av"]) for x in out.df.collect()}
    assert got == {i: want.get(i, (None,) * 6) for i in range(9000)}


def test_ties_in_large_groups(spark, table):
    path, rows = table
    out = Frame(spark.read.parquet(path)) >> group_by(f.s) >> transmute(id=f.id, lo=rank(f.k, ties_method="min", na_last="keep"), hi=rank(f.k, ties_method="max", na_last="keep"), av=rank(f.k, na_last="keep"))
    assert "windowspecdefinition(s#" not in plan(out)
    known = [(x[2], x[1]) for x in rows if x[1] is not None]
    for x in out.df.collect():
        s, k = rows[x["id"]][2], rows[x["id"]][1]
        lo, hi = sum(a == s and b < k for a, b in known) + 1 if k is not None else None, sum(a == s and b <= k for a, b in known) if k is not None else None
        assert (x["lo"], x["hi"], x["av"]) == (lo, hi, None if k is None else (lo + hi) / 2)


@pytest.mark.parametrize("keys", [(), ("k", "id"), ("-k", "id")])
def test_positions_in_large_groups(spark, table, keys):
    path, rows = table
    frame = Frame(spark.read.parquet(path))
    if keys:
        frame = frame >> arrange(*[desc(f[k[1:]]) if k[0] == "-" else f[k] for k in keys])
        sign = -1 if keys[0] == "-k" else 1
        order = sorted(rows, key=lambda x: (x[1] is None, sign * (x[1] or 0), x[0]))
    else:
        order = [rows[r["id"]] for r in frame.ordinal("at").df.orderBy("at").collect()]
    want, seen = {}, Counter()
    for x in order:
        seen[x[2]] += 1
        want[x[0]] = seen[x[2]]
    grouped = frame >> group_by(f.s)
    out = grouped >> transmute(id=f.id, rn=row_number())
    assert "windowspecdefinition(s#" not in plan(out)
    assert {r["id"]: r["rn"] for r in out.df.collect()} == want
    head, some = grouped >> slice_head(n=7), grouped >> slice_(3, 1200)
    assert "windowspecdefinition(s#" not in plan(head)
    assert {r["id"] for r in head.df.collect()} == {i for i, at in want.items() if at <= 7}
    assert {r["id"] for r in some.df.collect()} == {i for i, at in want.items() if at in (4, 1201)}


def test_draws_in_large_groups(spark, table):
    path, rows = table
    frame = Frame(spark.read.parquet(path)) >> group_by(f.s)
    sizes = Counter(x[2] for x in rows)
    for n, prop in ((25_000, None), (None, 1.5)):
        out = frame >> slice_sample(n=n, prop=prop, replace=True, random_state=3)
        assert "windowspecdefinition(s#" not in plan(out) and "rightHint=(strategy=merge)" in plan(out)  # draws are not broadcast
        got = out.df.collect()
        assert Counter(r["s"] for r in got) == {k: n or int(c * prop) for k, c in sizes.items()}
        assert all(rows[r["id"]] == (r["id"], r["k"], r["s"], r["v"]) for r in got)
        for k, c in sizes.items():  # as many rows are never drawn as chance has it
            missed = (1 - len({r["id"] for r in got if r["s"] == k}) / c) - (1 - 1 / c) ** (n or int(c * prop))
            assert abs(missed) < 0.05
    again = [sorted(r["id"] for r in (frame >> slice_sample(n=500, replace=True, random_state=s)).df.collect()) for s in (1, 1, 2)]
    assert again[0] == again[1] != again[2]
