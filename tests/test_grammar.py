"""Verbs and functions on small frames; expected values by hand."""

import datetime

import numpy as np
import pytest

from verbena.all import *  # noqa: F403
from verbena.all import c, f
from verbena.frame import ColumnNotExistingError
from verbena.names import NameNonUniqueError


@pytest.fixture(scope="module")
def df(spark):
    return tibble(x=[1, 2, 3, 4, None], g=["a", "b", "a", "b", "a"], y=[1.5, 2.5, 3.5, 4.5, 0.5])


def rows(frame):
    return frame.collect()


def test_mutate_sequential_and_keep(df):
    out = df >> mutate(z=f.x + 1, w=f.z * 2, _t=f.w, g=None)
    assert out.columns == ["x", "y", "z", "w"]
    assert [r[3] for r in rows(out)] == [4, 6, 8, 10, None]
    base = tibble(x=1, y=2, a="a", b="b")
    assert (base >> mutate(z=f.x + f.y, _keep="used")).columns == ["x", "y", "z"]
    assert (base >> mutate(z=f.x + f.y, _keep="unused")).columns == ["a", "b", "z"]
    assert (base >> mutate(z=f.x + f.y, _keep="none")).columns == ["z"]
    assert (base >> mutate(z=1, _before=1)).columns == ["x", "z", "y", "a", "b"]


def test_division_and_modulo(spark):
    out = tibble(x=[1, 0, -1, -7]) >> mutate(d=f.x / 0, m=f.x % 3, q=f.x // 2)
    assert rows(out) == [(1, float("inf"), 1, 0), (0, None, 0, 0), (-1, float("-inf"), 2, -1), (-7, float("-inf"), 2, -4)]


def test_expression_has_no_truth_value(df):
    with pytest.raises(TypeError):
        df >> filter_(1 < f.x < 3)


def test_grouped_mutate_and_filter(df):
    out = df >> group_by(f.g) >> mutate(s=sum_(f.x, na_rm=True), n=n(), r=f.y / sum_(f.y))
    assert [r[3] for r in rows(out)] == [4, 6, 4, 6, 4]
    assert [round(r[5], 4) for r in rows(out)] == [0.2727, 0.3571, 0.6364, 0.6429, 0.0909]
    assert [r[2] for r in rows(df >> group_by(f.g) >> filter_(f.y > mean(f.y)))] == [3.5, 4.5]


def test_summarise(df):
    out = df >> group_by(f.g) >> summarise(y=mean(f.y), top=max_(f.y), s=sum_(f.x), k=f.y * 2)
    assert rows(out)[0] == ("a", pytest.approx(11 / 6), 3.5, None, pytest.approx(11 / 3))
    assert [r[3] for r in rows(out)] == [None, 6]
    assert out.groups == []
    many = df >> group_by(f.g) >> summarise(q=quantile(f.y, [0, 1]), p=[0, 1])
    assert rows(many) == [("a", 0.5, 0), ("a", 3.5, 1), ("b", 2.5, 0), ("b", 4.5, 1)]


def test_empty_aggregates(spark):
    out = tibble(x=[1]) >> filter_(f.x > 5) >> summarise(s=sum_(f.x), p=prod(f.x), n=n(), m=mean(f.x))
    assert rows(out) == [(0, 1.0, 0, None)]


def test_na_rm(df):
    out = df >> summarise(a=mean(f.x), b=mean(f.x, na_rm=True), d=any_na(f.x), e=n_distinct(f.x), h=n_distinct(f.x, na_rm=False))
    assert rows(out) == [(None, 2.5, True, 4, 5)]


def test_count(df):
    assert rows(df >> count(f.g, sort=True)) == [("a", 3), ("b", 2)]
    assert rows(df >> count(f.g, wt=f.y, name="w")) == [("a", 5.5), ("b", 7.0)]
    assert [r[-1] for r in rows(df >> add_count(f.g))] == [3, 2, 3, 2, 3]
    assert rows(df >> tally()) == [(5,)]


def test_across(df):
    out = df >> group_by(f.g) >> summarise(across(c(f.x, f.y), {"m": mean, "t": max_}, na_rm=True))
    assert out.columns == ["g", "x_m", "x_t", "y_m", "y_t"]
    out = df >> mutate(across(where(is_double), lambda v: v * 10, _names="{_col}_10"))
    assert out.columns == ["x", "g", "y", "y_10"]
    assert [r[0] for r in rows(df >> filter_(if_all(c(f.x, f.y), lambda v: v > 2)))] == [3, 4]
    assert len(rows(df >> filter_(if_any(c(f.x, f.y), lambda v: v > 3)))) == 2


def test_selection(df):
    assert (df >> select(f.y, f.x)).columns == ["y", "x"]
    assert (df >> select(~f.x)).columns == ["g", "y"]
    assert (df >> select(c[f.x : f.y])).columns == ["x", "g"]
    assert (df >> select(c[f.x : f.y : 1])).columns == ["x", "g", "y"]
    assert (df >> select(-1)).columns == ["y"]
    assert (df >> select(k=f.g)).columns == ["k"]
    assert (df >> group_by(f.g) >> select(f.x)).columns == ["g", "x"]
    assert (df >> select(where(is_character))).columns == ["g"]
    assert (df >> select(any_of(["y", "zz"]))).columns == ["y"]
    assert (df >> select(starts_with("X") | contains("y"))).columns == ["x", "y"]
    with pytest.raises(ColumnNotExistingError):
        df >> select(all_of(["zz"]))
    with pytest.raises(ColumnNotExistingError):
        df >> select(f.zz)
    assert (df >> relocate(f.y)).columns == ["y", "x", "g"]
    assert (df >> relocate(f.x, _after=f.g)).columns == ["g", "x", "y"]
    assert (df >> rename(k=f.g, v=0)).columns == ["v", "k", "y"]
    assert (df >> rename_with(str.upper)).columns == ["X", "G", "Y"]
    assert (df >> pull(f.g)) == ["a", "b", "a", "b", "a"]
    assert num_range("wk", range(1, 3), width=2) == ["wk01", "wk02"]


def test_arrange_missing_last(df):
    assert [r[0] for r in rows(df >> arrange(f.x))] == [1, 2, 3, 4, None]
    assert [r[0] for r in rows(df >> arrange(desc(f.x)))] == [4, 3, 2, 1, None]
    assert [r[2] for r in rows(df >> arrange(f.g, desc(f.y)))] == [3.5, 1.5, 0.5, 4.5, 2.5]
    assert [r[2] for r in rows(df >> arrange(desc(f.y)) >> head(2))] == [4.5, 3.5]
    assert [r[2] for r in rows(df >> tail(2))] == [4.5, 0.5]


def test_slices(df):
    assert [r[2] for r in rows(df >> slice_(0, -1))] == [1.5, 0.5]
    assert [r[2] for r in rows(df >> slice_(c[1:3]))] == [2.5, 3.5]
    assert [r[2] for r in rows(df >> slice_(~c[1:3]))] == [1.5, 4.5, 0.5]
    assert [r[2] for r in rows(df >> slice_(n() - 1))] == [0.5]
    assert [r[2] for r in rows(df >> group_by(f.g) >> slice_head(n=1))] == [1.5, 2.5]
    assert sorted(r[2] for r in rows(df >> group_by(f.g) >> slice_tail(prop=0.5))) == [0.5, 4.5]
    assert sorted(r[2] for r in rows(df >> group_by(f.g) >> slice_max(f.y))) == [3.5, 4.5]
    ties = tibble(k=[1, 1, 2], v=["p", "q", "r"])
    assert [r[1] for r in rows(ties >> slice_min(f.k))] == ["p", "q"]
    assert [r[1] for r in rows(ties >> slice_min(f.k, with_ties=False))] == ["p"]
    assert [r[1] for r in rows(ties >> slice_min(f.k, with_ties="last"))] == ["q"]
    assert len(rows(df >> slice_sample(n=3, random_state=1))) == 3
    assert len(rows(df >> group_by(f.g) >> slice_sample(n=4, replace=True, random_state=1))) == 8


def test_distinct(df):
    assert rows(df >> distinct(f.g)) == [("a",), ("b",)]
    assert [r[2] for r in rows(df >> distinct(f.g, keep_all=True))] == [1.5, 2.5]
    assert rows(tibble(a=[2, 1, 2]) >> distinct()) == [(2,), (1,)]


def test_joins(df):
    right = tibble(g=["a", "z"], v=[9, 8])
    assert [r[3] for r in rows(df >> left_join(right, f.g))] == [9, None, 9, None, 9]
    assert len(rows(df >> inner_join(right))) == 3
    assert rows(df >> right_join(right))[-1] == (None, "z", None, 8)
    assert len(rows(df >> full_join(right))) == 6
    assert len(rows(df >> semi_join(right))) == 3
    assert len(rows(df >> anti_join(right, by={"g": "g"}))) == 2
    assert [len(r[3]) for r in rows(df >> nest_join(right))] == [1, 0, 1, 0, 1]
    gaps, more = tibble(k=[1.0, None], a=[1, 2]), tibble(k=[None, 1.0], b=[3, 4])
    assert rows(gaps >> left_join(more)) == [(1.0, 1, 4), (None, 2, 3)]
    assert rows(gaps >> left_join(more, na_matches="never")) == [(1.0, 1, 4), (None, 2, None)]
    twice = tibble(g=["a", "a"], v=[1, 2])
    assert len(rows(df >> inner_join(twice, multiple="first"))) == 3
    with pytest.raises(ValueError):
        df >> left_join(twice, relationship="many-to-one")
    assert (tibble(k=1, v=1) >> inner_join(tibble(k=1, v=2), "k")).columns == ["k", "v_x", "v_y"]
    assert (tibble(k=1) >> full_join(tibble(k=2), keep=True)).columns == ["k_x", "k_y"]
    assert len(rows(tibble(a=[1, 2]) >> cross_join(tibble(b=[1, 2])))) == 4


def test_rows_verbs(spark):
    x = tibble(a=[1, 2, 3], b=["p", "q", None], k=[0.5, 1.5, 2.5])
    assert rows(x >> rows_insert(tibble(a=4, b="z")))[-1] == (4, "z", None)
    with pytest.raises(ValueError):
        x >> rows_insert(tibble(a=3, b="z"))
    assert len(rows(x >> rows_insert(tibble(a=3, b="z"), conflict="ignore"))) == 3
    assert rows(x >> rows_update(tibble(a=[2, 3], b="z")))[1:] == [(2, "z", 1.5), (3, "z", 2.5)]
    assert rows(x >> rows_patch(tibble(a=[2, 3], b="z")))[1:] == [(2, "q", 1.5), (3, "z", 2.5)]
    assert len(rows(x >> rows_upsert(tibble(a=[2, 4], b="z")))) == 4
    assert rows(x >> rows_delete(tibble(a=[2, 3]))) == [(1, "p", 0.5)]
    with pytest.raises(ValueError):
        x >> rows_delete(tibble(a=9))
    assert len(rows(x >> rows_append(tibble(a=1)))) == 4


def test_sets_and_bind(spark):
    x, y = tibble(k=[1, 2, 2, 3]), tibble(k=[2, 4])
    assert rows(union(x, y)) == [(1,), (2,), (3,), (4,)]
    assert rows(x >> intersect(y)) == [(2,)]
    assert rows(setdiff(x, y)) == [(1,), (3,)]
    assert sorted(rows(symdiff(x, y))) == [(1,), (3,), (4,)]
    assert len(rows(union_all(x, y))) == 6
    assert setequal(x, tibble(k=[3, 2, 1])) and not setequal(x, y)
    assert union([1, 2], [2, 3]) == [1, 2, 3] and intersect([1, 2], [2]) == [2]
    out = bind_rows(tibble(a=1), tibble(b=2), _id="i")
    assert out.columns == ["i", "a", "b"] and rows(out) == [(0, 1, None), (1, None, 2)]
    assert rows(bind_cols(tibble(a=[1, 2]), tibble(a=[3]))) == [(1, 3), (2, None)]
    assert bind_cols(tibble(a=[1]), tibble(a=[3])).columns == ["a__0", "a__1"]


def test_windows(spark):
    x = tibble(v=[5, 1, 3, 2, 2, None])
    out = x >> mutate(mr=min_rank(f.v), dr=dense_rank(f.v), rn=row_number(), d=min_rank(desc(f.v)), nt=ntile(f.v, n=2))
    assert [r[1] for r in rows(out)] == [5, 1, 4, 2, 2, None]
    assert [r[2] for r in rows(out)] == [4, 1, 3, 2, 2, None]
    assert [r[3] for r in rows(out)] == [1, 2, 3, 4, 5, 6]
    assert [r[4] for r in rows(out)] == [1, 5, 2, 3, 3, None]
    assert min_rank([3, 1, 1]) == [3, 1, 1]
    assert rank([10, 20, 20]) == [1.0, 2.5, 2.5]
    out = x >> mutate(l=lag(f.v), k=lead(f.v, 2, default=0), cs=cumsum(f.v), cm=cummax(f.v), ci=consecutive_id(f.v))
    assert [r[1] for r in rows(out)] == [None, 5, 1, 3, 2, 2]
    assert [r[2] for r in rows(out)] == [3, 2, 2, None, 0, 0]
    assert [r[3] for r in rows(out)] == [5, 6, 9, 11, 13, None]
    assert [r[5] for r in rows(out)] == [1, 2, 3, 4, 4, 5]
    out = tibble(d=[1, 2, 3], v=[10, -20, 5]) >> mutate(a=cumall(f.v > 0), o=cumany(f.v < 0), r=order_by(desc(f.d), cumsum(f.v)))
    assert rows(out) == [(1, 10, True, False, -5), (2, -20, False, True, -15), (3, 5, False, True, 5)]
    assert diff([1, 4, 9]) == [3, 5]
    assert cumsum([1, 2, 3]) == [1, 3, 6]


def test_rowwise(df):
    out = df >> rowwise() >> mutate(m=mean(c_across(c(f.x, f.y)), na_rm=True), s=sum_(c_across(c(f.x, f.y))), t=max_(c_across(c(f.x, f.y))))
    assert rows(out)[0][3:] == (1.25, 2.5, 1.5)
    assert rows(out)[4][3:] == (0.5, None, None)
    assert rows(tibble(a=[1, 5], b=[3, 2]) >> mutate(lo=pmin(f.a, f.b), hi=pmax(f.a, f.b))) == [(1, 3, 1, 3), (5, 2, 2, 5)]


def test_context(df):
    gf = df >> group_by(f.g)
    assert [r[3] for r in rows(gf >> mutate(i=cur_group_id()))] == [0, 1, 0, 1, 0]
    assert rows(gf >> summarise(r=cur_group_rows())) == [("a", 0), ("a", 2), ("a", 4), ("b", 1), ("b", 3)]
    assert (gf >> group_keys()).collect() == [("a",), ("b",)]
    assert (gf >> group_size()) == [3, 2]
    assert (gf >> n_groups()) == 2 and (gf >> group_vars()) == ["g"]
    assert (gf >> group_rows()) == [[0, 2, 4], [1, 3]]
    assert (gf >> group_indices()) == [0, 1, 0, 1, 0]
    assert [nrow(x) for x in gf >> group_split()] == [3, 2]
    assert list(gf >> group_map(lambda x: nrow(x))) == [3, 2]
    out = gf >> group_modify(lambda x: x >> summarise(m=max_(f.y)))
    assert sorted(rows(out)) == [("a", 3.5), ("b", 4.5)]
    assert rows(df >> with_groups(f.g, summarise, n=n())) == [("a", 3), ("b", 2)]


def test_pivots(spark):
    long = tibble(id=[1, 1, 2], k=["p", "q", "p"], v=[1.0, 2.0, 3.0])
    wide = long >> pivot_wider(names_from=f.k, values_from=f.v)
    assert wide.columns == ["id", "p", "q"] and rows(wide) == [(1, 1.0, 2.0), (2, 3.0, None)]
    assert rows(long >> pivot_wider(names_from=f.k, values_from=f.v, values_fill=0))[1] == (2, 3.0, 0.0)
    back = wide >> pivot_longer(c(f.p, f.q), names_to="k", values_to="v", values_drop_na=True)
    assert sorted(rows(back)) == sorted(rows(long))
    two = tibble(x1=1, x2=2, y1=3, y2=4) >> pivot_longer(everything(), names_to=c(".value", "set"), names_pattern="(.)(.)")
    assert two.columns == ["set", "x", "y"] and rows(two) == [("1", 1, 3), ("2", 2, 4)]
    many = tibble(id=[1, 1], k=["p", "q"], a=[1, 2], b=[3, 4]) >> pivot_wider(names_from=f.k, values_from=c(f.a, f.b))
    assert many.columns == ["id", "a_p", "a_q", "b_p", "b_q"]


def test_nest_and_pack(spark):
    x = tibble(x=[1, 1, 2], y=[1, 2, 3], z=[6, 5, 4])
    assert rows(x >> nest(data=c(f.y, f.z)) >> unnest(f.data)) == rows(x)
    assert rows(x >> chop(c(f.y, f.z))) == [(1, [1, 2], [6, 5]), (2, [3], [4])]
    assert rows(x >> chop(c(f.y, f.z)) >> unchop(c(f.y, f.z))) == rows(x)
    assert rows(x >> pack(p=c(f.y, f.z)) >> unpack(f.p)) == rows(x)
    lists = tibble(a=[1, 2], b=[[], [1, 2]])
    assert rows(lists >> unchop(f.b)) == [(2, 1), (2, 2)]
    assert rows(lists >> unchop(f.b, keep_empty=True)) == [(1, None), (2, 1), (2, 2)]


def test_expand_and_complete(spark):
    fruits = tibble(kind=["apple", "pear", "pear"], year=[2010, 2010, 2012], size=factor(["S", "M", "S"], levels=["S", "M", "L"]))
    assert len(rows(fruits >> expand(f.kind, f.size))) == 6
    assert len(rows(fruits >> expand(nesting(f.kind, f.size)))) == 3
    assert [r[0] for r in rows(fruits >> expand(full_seq(f.year, 1)))] == [2010, 2011, 2012]
    out = tibble(g=[1, 2], i=["a", "b"], v=[5, None]) >> complete(f.g, f.i, fill={"v": 0})
    assert sorted(rows(out)) == [(1, "a", 5), (1, "b", 0), (2, "a", 0), (2, "b", 0)]
    assert rows(crossing(a=[2, 1, 2], b=["x"])) == [(1, "x"), (2, "x")]
    assert rows(expand_grid(a=[1, 2], b=[3, 4])) == [(1, 3), (1, 4), (2, 3), (2, 4)]
    with pytest.raises(ValueError):
        full_seq([1, 2.5], 1)


def test_missing_values(spark):
    x = tibble(g=["a", "a", "b"], v=[1.0, None, None])
    assert [r[1] for r in rows(x >> fill(f.v))] == [1.0, 1.0, 1.0]
    assert [r[1] for r in rows(x >> group_by(f.g) >> fill(f.v))] == [1.0, 1.0, None]
    assert rows(x >> drop_na()) == [("a", 1.0)]
    assert [r[1] for r in rows(x >> replace_na({"v": 0}))] == [1.0, 0.0, 0.0]
    assert replace_na([1, None], 0) == [1, 0]
    assert rows(tibble(n=[2, 0, 1], x=["p", "q", "r"]) >> uncount(f.n, _id="i")) == [("p", 0), ("p", 1), ("r", 0)]


def test_separate(spark):
    x = tibble(x=[None, "a.b", "a.d", "b.c"])
    assert rows(x >> separate(f.x, ["p", "q"]))[1:] == [("a", "b"), ("a", "d"), ("b", "c")]
    assert rows(tibble(x=["a", "a b", "a b c"]) >> separate(f.x, ["p", "q"], extra="merge", fill="left")) == [(None, "a"), ("a", "b"), ("a", "b c")]
    assert rows(tibble(x=["k: 1"]) >> separate(f.x, ["key", "v"], convert=True)) == [("k", 1)]
    assert rows(tibble(x=[1, 2], y=["a", "d,e"]) >> separate_rows(f.y)) == [(1, "a"), (2, "d"), (2, "e")]
    assert rows(tibble(x=["a-b", "zz"]) >> extract(f.x, ["p", "q"], regex=r"(\w)-(\w)")) == [("a", "b"), (None, None)]
    assert rows(tibble(x=["a", None], y=["b", None]) >> unite("z", f.x, f.y)) == [("a_b",), ("",)]


def test_conditions(spark):
    x = tibble(v=[1, 2, None])
    out = x >> mutate(a=if_else(f.v > 1, "hi", "lo", missing="na"), b=case_when(f.v == 1, "one", f.v == 2, "two"), k=coalesce(f.v, 0), m=na_if(f.v, 2))
    assert rows(out) == [(1, "lo", "one", 1, 1), (2, "hi", "two", 2, None), (None, "na", None, 0, None)]
    assert recode(["a", "b"], a="x") == ["x", "b"]
    assert recode([0, 4, 2], "a", "b", "c", "d", _default="nothing") == ["a", "nothing", "c"]
    assert between([1, 2, 3], 2, 3) == [False, True, True]
    assert case_match(["a", "b", "c"], ["a", "b"], 1, "c", 2) == [1, 1, 2]


def test_strings(spark):
    x = tibble(s=["apple", None, "Banana"])
    out = x >> mutate(a=toupper(f.s), b=sub("a", "_", f.s), d=gsub("a", "_", f.s), e=grepl("^a", f.s), h=nchar(f.s), i=paste0(f.s, "!"), j=f.s.str.lower())
    assert rows(out)[0] == ("apple", "APPLE", "_pple", "_pple", True, 5, "apple!", "apple")
    assert rows(out)[1][1:] == (None, None, None, False, 2, "NA!", None)
    assert rows(out)[2][2:4] == ("B_nana", "B_n_n_")
    assert substr("abcde", 1, 3) == "bc" and trimws([" a "]) == ["a"] and strtoi(["0x1f", "077"]) == [31, 63]
    assert nchar(["你", "a"]) == [2, 1] and sprintf("%d|%.1f", [3], [2.25])[0].startswith("3|2.")
    assert rows(tibble(s=["b", "a"]) >> summarise(p=paste(f.s, collapse="+"))) == [("b+a",)]
    assert sub("(a)(b)", r"\2\1", ["xab"]) == ["xba"] and strsplit(["a.b"], ".", fixed=True) == [["a", "b"]]


def test_numbers(spark):
    assert round_([0.5, 1.5, 2.675], 0)[:2] == [0.0, 2.0]
    assert signif([123456.0], 2) == [120000.0] and trunc([-1.7]) == [-1.0]
    assert log([0.0])[0] == float("-inf") and np.isnan(log([-1.0])[0]) and log([8], 2) == [3.0]
    assert gamma([5.0])[0] == 24.0 and factorial([25])[0] == pytest.approx(1.5511210043330986e25)
    assert lgamma([0.5, -0.5]) == pytest.approx([0.5723649429247001, 1.2655121234846454])
    assert beta([2.0], [3.0]) == pytest.approx([1 / 12]) and choose([5], [2]) == [10.0]
    assert digamma([1.0]) == pytest.approx([-0.5772156649015329]) and trigamma([1.0]) == pytest.approx([1.6449340668482264])
    assert psigamma([2.0], 2) == pytest.approx([-0.4041138063191885])
    assert bessel_j([1.0], [0]) == pytest.approx([0.7651976865579666]) and bessel_y([1.0], [0]) == pytest.approx([0.08825696421567698], rel=1e-5)
    assert bessel_i([1.0], [0]) == pytest.approx([1.2660658777520082]) and bessel_k([1.0], [0]) == pytest.approx([0.42102443824070834], rel=1e-6)
    assert quantile([1, 2, 4, 8]) == [1.0, 1.75, 3.0, 5.0, 8.0]
    for kind, want in {1: 1.0, 2: 1.5, 4: 1.0, 5: 1.5, 6: 1.25, 8: 1.4166666666666667}.items():
        assert quantile([1, 2, 4, 8], 0.25, type_=kind) == pytest.approx(want)
    assert weighted_mean([1, 2], [1, 3]) == 1.75 and sd([1, 2, 3]) == 1.0 and var([1, 2, 3], ddof=0) == pytest.approx(2 / 3)
    assert mod([3 + 4j]) == [5.0] and conj([1 + 2j]) == [1 - 2j] and re_([1 + 2j]) == [1.0]
    out = tibble(x=[4.0]) >> mutate(a=np.sqrt(f.x), b=np.add(f.x, 1))
    assert rows(out) == [(4.0, 2.0, 5.0)]


def test_dates(spark):
    assert as_date(["2020-01-31", "31/01/2020"], format=["%Y-%m-%d", "%d/%m/%Y"]) == [datetime.date(2020, 1, 31)] * 2
    assert as_date([32], origin=datetime.date(2020, 1, 1)) == [datetime.date(2020, 2, 2)]
    assert as_date(["no"]) == [None]


def test_casts(spark):
    assert as_integer(["2.7", "x"]) == [2, None] and as_character([1]) == ["1"] and as_logical([0, 1]) == [False, True]
    assert is_numeric([1, 2]) and not is_character([1]) and is_na([1, None]) == [False, True]
    assert as_numeric(["1.5"]) == [1.5] and is_finite([1.0, float("inf")]) == [True, False]


def test_vectors(spark):
    assert seq(1, 5, 2) == [1, 3, 5] and seq(0, 1, length_out=3) == [0, 0.5, 1] and seq_len(3) == [1, 2, 3] and seq_along("ab") == [1]
    assert rep([1, 2], 2) == [1, 2, 1, 2] and rep([1, 2], each=2) == [1, 1, 2, 2] and rep([1, 2], length=3) == [1, 2, 1]
    assert c(1, c(2, 3)) == [1, 2, 3] and list(c[1:4]) == [1, 2, 3] and list(c[1:4:1]) == [1, 2, 3, 4]
    assert sort([3, 1, None]) == [1, 3, None] and order([3, 1, 2]) == [1, 2, 0] and rev([1, 2]) == [2, 1] and unique([2, 1, 2]) == [2, 1]
    assert append([1, 2], [9], after=0) == [1, 9, 2] and match([1, 2], [2]) == [-1, 0] and duplicated([1, 1]) == [False, True]
    assert which([True, False, True]) == [0, 2] and which_max([1, 3, 3]) == 1 and which_min([2, 1]) == 1
    assert tabulate([1, 2, 2, 5], 3) == [1, 2, 0]
    set_seed(4)
    first = rnorm(3)
    set_seed(4)
    assert rnorm(3) == first and len(sample([1, 2, 3], 2)) == 2


def test_factors(spark):
    x = factor(["b", "a", None, "b"], levels=["a", "b", "c"])
    assert levels(x) == ["a", "b", "c"] and nlevels(x) == 3 and is_factor(x) and not is_ordered(x)
    assert levels(fct_infreq(x))[0] == "b" and levels(fct_rev(x)) == ["c", "b", "a"] and levels(fct_drop(x)) == ["a", "b"]
    assert levels(fct_relevel(x, "c")) == ["c", "a", "b"] and levels(fct_relevel(x, "a", after=1)) == ["b", "c", "a"]
    assert list(fct_recode(x, Z="b")) == ["Z", "a", None, "Z"] and list(fct_collapse(x, n=["a", "b"])) == ["n", "n", None, "n"]
    assert levels(fct_explicit_na(x)) == ["a", "b", "c", "(Missing)"] and levels(fct_expand(x, "d"))[-1] == "d"
    assert levels(fct_inorder(x)) == ["b", "a", "c"] and levels(fct_shift(x)) == ["b", "c", "a"]
    y = factor(["A"] * 40 + ["B"] * 10 + ["C"] * 5 + ["D"] * 27 + list("EFGHI"))
    assert levels(fct_lump_n(y, 3)) == ["A", "B", "D", "Other"] and levels(fct_lump_min(y, 5)) == ["A", "B", "C", "D", "Other"]
    assert levels(fct_lump_prop(y, 0.1)) == ["A", "B", "D", "Other"] and levels(fct_lump_lowfreq(y)) == ["A", "D", "Other"]
    assert rows(fct_count(x)) == [("a", 1), ("b", 2), ("c", 0), (None, 1)]
    assert levels(fct_c(factor(["a"]), factor(["b"]))) == ["a", "b"] and fct_match(x, "a") == [False, True, False, False]
    with pytest.raises(ValueError):
        fct_match(x, "zz")
    assert levels(fct_reorder(factor(["a", "b", "a"]), [3, 1, 5])) == ["b", "a"] and levels(lvls_reorder(x, [2, 1, 0])) == ["c", "b", "a"]
    assert list(recode_factor(["a", "b"], b="z", a="y")) == ["y", "z"] and levels(recode_factor(["a", "b"], b="z", a="y")) == ["z", "y"]
    assert cut([1, 5, 10], [0, 5, 10]) == ["(0,5]", "(0,5]", "(5,10]"]


def test_factor_columns(spark):
    x = tibble(k=factor(["b", "a", "b"], levels=["b", "a", "z"]), v=[1, 2, 3])
    assert [r[0] for r in rows(x >> arrange(f.k))] == ["b", "b", "a"]
    assert rows(x >> count(f.k, _drop=False)) and {r[0]: r[1] for r in rows(x >> count(f.k, _drop=False))} == {"b": 2, "a": 1, "z": 0}
    assert [r[2] for r in rows(x >> mutate(i=as_integer(f.k)))] == [0, 1, 0]
    assert [r[0] for r in rows(x >> mutate(k=fct_recode(f.k, B="b")))] == ["B", "a", "B"]
    assert (x >> select(where(is_factor))).columns == ["k"]


def test_tibbles(spark):
    x = tibble(a=[1, 2], b=f.a * 2, d="k")
    assert rows(x) == [(1, 2, "k"), (2, 4, "k")]
    with pytest.raises(ValueError):
        tibble(a=[1, 2], b=[1, 2, 3])
    with pytest.raises(NameNonUniqueError):
        tibble({"x": 1}, x=2)
    assert rows(tribble(f.x, f.y, 1, "a", 2, "b")) == [(1, "a"), (2, "b")]
    assert deframe(enframe({"a": 1, "b": 2})) == {"a": 1, "b": 2}
    assert rows(x >> add_row(a=9, _before=0))[0] == (9, None, None)
    assert rows(x >> add_column(z=[7, 8], _after=0)) == [(1, 7, 2, "k"), (2, 8, 4, "k")]
    with pytest.raises(NameNonUniqueError):
        x >> add_column(a=1)
    named = x >> column_to_rownames("d")
    assert named.columns == ["a", "b"] and (named >> has_rownames()) and rownames(named) == ["k", "k"]
    assert (named >> rownames_to_column("r")).columns == ["r", "a", "b"]
    assert rows(x >> rowid_to_column()) == [(0, 1, 2, "k"), (1, 2, 4, "k")]
    assert dim(x) == (2, 3) and colnames(x) == ["a", "b", "d"]
    assert rows(t(tibble(a=[1, 2], b=[3, 4]))) == [(1, 2), (3, 4)] and diag(tibble(a=[1, 2], b=[3, 4])) == [1, 4]
    assert rows(table(tibble(a=["x", "y", "x"]))) and rows(col_sums(tibble(a=[1, 2]))) == [(3,)]
