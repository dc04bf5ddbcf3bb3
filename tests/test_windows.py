"""Positions and windows over whole tables by ranges, against plain Python."""

import random

import pytest

from verbena.all import arrange, cumsum, desc, distinct, f, fill, group_by, if_else, lag, lead, min_rank, mutate, row_number, slice_sample, transmute
from verbena.frame import Frame


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(6)
    rows = [(k, r.choice([None, *range(40)]), r.choice("pqr"), r.randrange(1000)) for k in range(9000)]
    path = str(tmp_path_factory.mktemp("windows") / "t.parquet")
    spark.createDataFrame(rows, "id bigint, k bigint, s string, v bigint").repartition(5).write.parquet(path)
    return path, rows


def by(rows, *keys):
    """Rows in the order of (column, descending) keys, missing ones last."""
    out = list(rows)
    for column, down in reversed(keys):
        have = sorted((x for x in out if x[column] is not None), key=lambda x: x[column], reverse=down)
        out = have + [x for x in out if x[column] is None]
    return out


ORDERS = [((3, False), (0, False)), ((1, True), (2, True), (0, False)), ((2, False), (1, False), (0, True))]


@pytest.mark.parametrize("keys", ORDERS)
def test_positions_agree_between_branches(spark, table, keys):
    path, rows = table
    names = ("id", "k", "s", "v")
    frame = Frame(spark.read.parquet(path)) >> arrange(*[desc(f[names[c]]) if d else f[names[c]] for c, d in keys])
    got = {r["id"]: (r["pos"], r["v"]) for r in frame.ordinal("pos").df.select("id", "pos", "v", "k").collect()}
    assert got == {x[0]: (i, x[3]) for i, x in enumerate(by(rows, *keys))}


@pytest.mark.parametrize("keys", ORDERS[:2])
def test_windows_over_the_table(spark, table, keys):
    path, rows = table
    names = ("id", "k", "s", "v")
    frame = Frame(spark.read.parquet(path)) >> arrange(*[desc(f[names[c]]) if d else f[names[c]] for c, d in keys])
    out = frame >> transmute(id=f.id, cs=cumsum(f.v), p=lag(f.id), n=lead(f.id, 900, default=-1), k=f.k, rn=row_number())
    out = out >> fill(f.k)
    assert "__pid" in out.df._jdf.queryExecution().optimizedPlan().toString()  # by ranges
    got = {r["id"]: (r["cs"], r["p"], r["n"], r["k"], r["rn"]) for r in out.df.collect()}
    want, total, seen = {}, 0, None
    ordered = by(rows, *keys)
    for i, x in enumerate(ordered):
        total += x[3]
        seen = x[1] if x[1] is not None else seen
        want[x[0]] = (total, ordered[i - 1][0] if i else None, ordered[i + 900][0] if i + 900 < len(ordered) else -1, seen, i + 1)
    assert got == want


def test_ranks_of_a_table(spark, table):
    path, rows = table
    out = Frame(spark.read.parquet(path)) >> transmute(id=f.id, up=min_rank(f.k), down=min_rank(desc(f.k)))
    known = [x[1] for x in rows if x[1] is not None]
    for r in out.df.collect():
        k = rows[r["id"]][1]
        assert (r["up"], r["down"]) == ((None, None) if k is None else (1 + sum(x < k for x in known), 1 + sum(x > k for x in known)))


def test_positions_behind_a_shuffle(spark, table):
    frame = Frame(spark.read.parquet(table[0])) >> distinct(f.id, f.v)
    got = sorted(r["pos"] for r in frame.ordinal("pos").df.select("pos", "v", "id").collect())
    assert got == list(range(9000))


def test_samples_are_repeatable(spark, table):
    frame = Frame(spark.read.parquet(table[0]))
    draw = lambda **kw: sorted(r["id"] for r in (frame >> slice_sample(random_state=4, **kw)).df.select("id", "v").collect())
    assert len(draw(prop=0.1)) == 900 and draw(prop=0.1) == draw(prop=0.1)
    assert len(draw(n=50, replace=True)) == 50
    assert len(set(draw(n=9000, replace=True))) < 7000
    assert (frame >> mutate(z=1) >> slice_sample(n=7)).df.count() == 7


def test_weighted_draws(spark, table):
    frame = Frame(spark.read.parquet(table[0])) >> mutate(w=if_else(f.v < 10, 100.0, if_else(f.v < 500, 1.0, 0.0)))
    drawn = (frame >> slice_sample(n=4000, weight_by=f.w, replace=True, random_state=2)).df.collect()
    heavy = sum(r["v"] < 10 for r in drawn) / 4000
    rows = table[1]
    share = 100 * sum(x[3] < 10 for x in rows) / (100 * sum(x[3] < 10 for x in rows) + sum(10 <= x[3] < 500 for x in rows))
    assert len(drawn) == 4000 and abs(heavy - share) < 0.04 and all(r["v"] < 500 for r in drawn)
    per = (frame >> group_by(f.s) >> slice_sample(n=30, weight_by=f.w, replace=True, random_state=2)).df.groupBy("s").count().collect()
    assert sorted((r["s"], r["count"]) for r in per) == [("p", 30), ("q", 30), ("r", 30)]
