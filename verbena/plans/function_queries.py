"""Queries of single functions and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math

import numpy as np

from verbena import all as v
from verbena.all import c, f
from verbena.frame import Frame
from verbena.plans.registry import query, rounded

#: Of every event type: its rows, first event and place in the alphabet, as factors count it.
KINDS = "(select event_type as k, count(*) as n, min(event_id) as first_id, row_number() over (order by event_type) - 1 as c0, count(*) over () as m from events group by 1)"


def plain(**columns) -> Frame:
    """Results of functions that give plain values, as a frame."""
    return v.tibble(**columns)


# ---------------------------------------------------------------- constructors and row names
@query("tibble", "select * from (values (1::bigint, 2::bigint, 'k'), (2, 4, 'k'), (3, 6, 'k')) t(x, y, z)")
def _(t):
    t("region")
    return v.tibble(x=[1, 2, 3], y=f.x * 2, z="k")


@query("tribble", "select * from (values (1::bigint, 'a', null::double), (2, 'b', 1.5)) t(x, y, z)")
def _(t):
    t("region")
    return v.tribble(f.x, f.y, f.z, 1, "a", None, 2, "b", 1.5)


@query("tibble_row", "select 1::bigint as a, 2::bigint as b, 'z' as d")
def _(t):
    t("region")
    return v.tibble_row(a=1, b=[1, 2], d="z") >> v.mutate(b=v.lengths(f.b))


@query("as_tibble", "select r_regionkey, r_name from region where r_regionkey > 1")
def _(t):
    return v.as_tibble(t("region").df) >> v.filter_(f.r_regionkey > 1) >> v.select(f.r_regionkey, f.r_name)


@query("enframe_deframe", "select n_name as name, n_nationkey::bigint as value from nation")
def _(t):
    pairs = v.deframe(t("nation") >> v.select(f.n_name, f.n_nationkey))
    return v.enframe(pairs) >> v.mutate(value=v.as_integer(f.value))


@query("tibble_packed", "select n_nationkey, n_nationkey * 2::bigint as twice, lower(n_name) as name from nation")
def _(t):
    return t("nation") >> v.transmute(n_nationkey=f.n_nationkey, p=v.tibble_(twice=f.n_nationkey * 2, name=v.tolower(f.n_name))) >> v.unpack(f.p)


@query("expand_grid", "select a, b from (values (1::bigint), (2)) x(a) cross join (select r_name as b from region)")
def _(t):
    return v.expand_grid(a=[1, 2], b=v.pull(t("region"), f.r_name))


@query("crossing", "select a, b from (values ('x'), ('y')) x(a) cross join (values (1::bigint), (3)) y(b)")
def _(t):
    t("region")
    return v.crossing(a=["y", "x", "y"], b=[3, 1, 3])


@query("add_column", "select r_regionkey, r_name, (r_regionkey + 1) * 10::bigint as z, r_regionkey * 2::bigint as w from region")
def _(t):
    return t("region") >> v.select(f.r_regionkey, f.r_name) >> v.arrange(f.r_regionkey) >> v.add_column(z=[10, 20, 30, 40, 50]) >> v.add_column(w=f.r_regionkey * 2, _after=0)


@query("add_row", "select r_regionkey::bigint as r_regionkey, r_name from region union all select 90, 'last' union all select 91, null")
def _(t):
    return t("region") >> v.transmute(r_regionkey=v.as_integer(f.r_regionkey), r_name=f.r_name) >> v.arrange(f.r_regionkey) >> v.add_row(r_regionkey=[90, 91], r_name=["last", None])


@query("rownames", "select n_name as who, n_regionkey, n_nationkey::bigint as at from nation")
def _(t):
    named = t("nation") >> v.arrange(f.n_nationkey) >> v.select(f.n_name, f.n_regionkey) >> v.column_to_rownames("n_name")
    assert v.has_rownames(named) and named.columns == ["n_regionkey"]
    back = named >> v.rownames_to_column("who")
    return back >> v.rowid_to_column("at") >> v.relocate(f.at, _after=v.last_col())


@query("set_rownames", "select 'row ' || r_regionkey as rowname, r_name from region")
def _(t):
    region = t("region") >> v.arrange(f.r_regionkey) >> v.select(f.r_name)
    named = v.set_rownames(region, [f"row {k}" for k in v.rownames(region)])
    assert not v.has_rownames(v.remove_rownames(named))
    return v.rownames_to_column(named)


# ---------------------------------------------------------------- selection
@query("select_helpers", "select l_shipdate, l_linenumber, l_orderkey, l_tax, l_linestatus from lineitem")
def _(t):
    return t("lineitem") >> v.select(v.starts_with("L_SHIP"), v.ends_with("number"), v.contains("orderk"), v.matches("^l_t.x$"), v.last_col(1))


@query("select_everything", "select r_name, r_regionkey from region")
def _(t):
    return t("region") >> v.select(f.r_name, v.everything())


@query("select_names", "select n_name, n_regionkey, n_nationkey as x1, n_nationkey + 1::bigint as x2 from nation")
def _(t):
    wide = t("nation") >> v.mutate(x1=f.n_nationkey, x2=f.n_nationkey + 1, x9=0)
    return wide >> v.select(v.all_of(["n_name", "n_regionkey"]), v.any_of(["nothing"]), v.all_of(v.num_range("x", range(1, 3))))


@query("rename", "select r_regionkey as key, r_name as \"R_NAME\" from region")
def _(t):
    return t("region") >> v.rename(key=f.r_regionkey) >> v.rename_with(str.upper, f.r_name)


@query("set_colnames", "select r_regionkey as a, r_name as b from region")
def _(t):
    return v.set_colnames(t("region"), ["a", "b"])


@query("pick", "select n_nationkey, n_name, n_regionkey from nation")
def _(t):
    return t("nation") >> v.transmute(n_nationkey=f.n_nationkey, p=v.pick(f.n_name, f.n_regionkey)) >> v.unpack(f.p)


@query("if_all", "select l_orderkey, l_tax, l_discount from lineitem where l_tax > 0.04 and l_discount > 0.04")
def _(t):
    return t("lineitem") >> v.filter_(v.if_all(c(f.l_tax, f.l_discount), lambda x: x > 0.04)) >> v.select(f.l_orderkey, f.l_tax, f.l_discount)


@query("shape", "select 3::bigint as columns_, (select count(*) from nation) as rows_, 'n_nationkey n_name n_regionkey' as names, (select count(*) from nation) as dim0, 3::bigint as dim1")
def _(t):
    nation = t("nation")
    rows, columns = v.dim(nation)
    return plain(columns_=[v.ncol(nation)], rows_=[v.nrow(nation)], names=[" ".join(v.colnames(nation))], dim0=[rows], dim1=[columns])


@query("pull", "select r_name as name, r_regionkey::bigint as key from region")
def _(t):
    region = t("region") >> v.arrange(f.r_regionkey)
    return plain(name=v.pull(region), key=v.pull(region, f.r_regionkey))


@query("glimpse", "select r_regionkey, r_name from region")
def _(t):
    region = t("region")
    v.glimpse(region)
    return region


# ---------------------------------------------------------------- tests of values
@query("near_and_element", "select l_orderkey, l_linenumber, abs(l_discount - 0.05) < 1e-8 as near, l_linenumber in (1, 3) as element, coalesce(list_position([3, 5, 1], l_linenumber) - 1, -1)::bigint as at from lineitem")
def _(t):
    return t("lineitem") >> v.transmute(l_orderkey=f.l_orderkey, l_linenumber=f.l_linenumber, near=v.near(f.l_discount, 0.05), element=v.is_element(f.l_linenumber, [1, 3]), at=v.match(f.l_linenumber, [3, 5, 1]))


@query("missing_tests", "select p_partkey, s is null as na, s is null as null_, s is not null as whole, p_size <> 10 as finite, p_size = 10 as infinite from (select *, nullif(p_type, 'STANDARD') as s from part)")
def _(t):
    gaps = t("part") >> v.mutate(s=v.na_if(f.p_type, "STANDARD"), q=f.p_retailprice / (f.p_size - 10))
    return gaps >> v.transmute(p_partkey=f.p_partkey, na=v.is_na(f.s), null_=v.is_null(f.s), whole=v.complete_cases(v.pick(f.s, f.p_size)), finite=v.is_finite(f.q), infinite=v.is_infinite(f.q))


@query("plain_tests", "select true as a, false as b, true as d, false as e")
def _(t):
    t("region")
    return plain(a=[v.is_true(True)], b=[v.is_true(1 == 2)], d=[v.is_false(False)], e=[v.is_false(None)])


@query("type_tests", "select true as chr, true as int_, true as dbl, true as num, true as atom, false as lgl, false as cplx, true as cplx2 from region")
def _(t):
    part = t("region") >> v.mutate(x=1.5, z=v.as_complex(f.r_regionkey))
    return part >> v.transmute(chr=v.is_character(f.r_name), int_=v.is_integer(f.r_regionkey), dbl=v.is_double(f.x), num=v.is_numeric(f.x), atom=v.is_atomic(f.r_name), lgl=v.is_logical(f.r_name), cplx=v.is_complex(f.x), cplx2=v.is_complex(f.z))


@query("which", "select n_regionkey, (row_number() over (partition by n_regionkey order by n_nationkey) - 1) as w from nation qualify n_nationkey % 2 = 0")
def _(t):
    return t("nation") >> v.arrange(f.n_nationkey) >> v.group_by(f.n_regionkey) >> v.summarise(w=v.which(f.n_nationkey % 2 == 0))


@query("which_extremes", "select user_id, arg_max(i, value) as hi, arg_min(i, value) as lo from (select *, row_number() over (partition by user_id order by event_id) - 1 as i from events) group by 1")
def _(t):
    return t("events") >> v.arrange(f.event_id) >> v.group_by(f.user_id) >> v.summarise(hi=v.which_max(f.value), lo=v.which_min(f.value))


# ---------------------------------------------------------------- rows of two frames
NATION = "(select n_nationkey, n_name, n_regionkey from nation)"


@query("rows_insert", "select n_nationkey::bigint as n_nationkey, n_name from nation union all select n_nationkey + 100, 'new' from nation where n_nationkey < 3")
def _(t):
    nation = t("nation") >> v.transmute(n_nationkey=v.as_integer(f.n_nationkey), n_name=f.n_name)
    fresh = nation >> v.filter_(f.n_nationkey < 3) >> v.mutate(n_nationkey=f.n_nationkey + 100, n_name="new")
    return nation >> v.rows_insert(fresh, by="n_nationkey") >> v.rows_insert(fresh >> v.mutate(n_name="again"), by="n_nationkey", conflict="ignore")


@query("rows_update", "select n_nationkey, case when n_nationkey < 3 then 'new' else n_name end as n_name from nation")
def _(t):
    nation = t("nation") >> v.select(f.n_nationkey, f.n_name)
    return nation >> v.rows_update(nation >> v.filter_(f.n_nationkey < 3) >> v.mutate(n_name="new"), by="n_nationkey")


@query("rows_patch", "select n_nationkey, case when n_regionkey = 1 and n_nationkey < 10 then 'patch' when n_regionkey = 1 then null else n_name end as n_name from nation")
def _(t):
    nation = t("nation") >> v.transmute(n_nationkey=f.n_nationkey, n_name=v.if_else(f.n_regionkey == 1, None, f.n_name))
    return nation >> v.rows_patch(nation >> v.filter_(f.n_nationkey < 10) >> v.mutate(n_name="patch"), by="n_nationkey")


@query("rows_append", "select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_regionkey = 2")
def _(t):
    nation = t("nation") >> v.select(f.n_nationkey, f.n_name)
    return nation >> v.rows_append(t("nation") >> v.filter_(f.n_regionkey == 2) >> v.select(f.n_nationkey, f.n_name))


@query("join_missing_keys", "select c_custkey, s_suppkey from (select c_custkey, nullif(c_nationkey, 3) as k from customer) left join (select s_suppkey, nullif(s_nationkey, 3) as k2 from supplier where s_suppkey <= 50) on k is not distinct from k2")
def _(t):
    left = t("customer") >> v.transmute(c_custkey=f.c_custkey, k=v.na_if(f.c_nationkey, 3))
    right = t("supplier") >> v.filter_(f.s_suppkey <= 50) >> v.transmute(s_suppkey=f.s_suppkey, k=v.na_if(f.s_nationkey, 3))
    return left >> v.left_join(right, by="k", relationship="many-to-many") >> v.select(f.c_custkey, f.s_suppkey)


@query("join_missing_never", "select c_custkey, s_suppkey from (select c_custkey, nullif(c_nationkey, 3) as k from customer) join (select s_suppkey, nullif(s_nationkey, 3) as k2 from supplier) on k = k2")
def _(t):
    left = t("customer") >> v.transmute(c_custkey=f.c_custkey, k=v.na_if(f.c_nationkey, 3))
    right = t("supplier") >> v.transmute(s_suppkey=f.s_suppkey, k=v.na_if(f.s_nationkey, 3))
    return left >> v.inner_join(right, by="k", na_matches="never") >> v.select(f.c_custkey, f.s_suppkey)


@query("join_multiple", "select c_custkey, first_order from customer left join (select o_custkey, min(o_orderkey) as first_order from orders group by 1) on o_custkey = c_custkey")
def _(t):
    orders = t("orders") >> v.transmute(o_custkey=f.o_custkey, first_order=f.o_orderkey) >> v.arrange(f.first_order)
    return t("customer") >> v.select(f.c_custkey) >> v.left_join(orders, by={"c_custkey": "o_custkey"}, multiple="first")


@query("union_all", "select c_nationkey as k from customer union all select s_nationkey from supplier")
def _(t):
    return v.union_all(t("customer") >> v.select(k=f.c_nationkey), t("supplier") >> v.select(k=f.s_nationkey))


@query("setequal", "select true as same, false as other")
def _(t):
    keys = t("nation") >> v.select(k=f.n_regionkey)
    return plain(same=[v.setequal(keys, t("region") >> v.select(k=f.r_regionkey))], other=[v.setequal(keys, t("nation") >> v.select(k=f.n_nationkey))])


@query("unique", "select distinct l_returnflag from lineitem")
def _(t):
    return v.unique(t("lineitem") >> v.select(f.l_returnflag))


@query("bind_cols", "select r_name, n_name from (select n_name, n_nationkey as i from nation where n_nationkey < 5) join (select r_name, r_regionkey as i from region) using (i)")
def _(t):
    nation = t("nation") >> v.arrange(f.n_nationkey) >> v.slice_head(n=5) >> v.select(f.n_name)
    return v.bind_cols(t("region") >> v.arrange(f.r_regionkey) >> v.select(f.r_name), nation)


# ---------------------------------------------------------------- groups
@query("group_tools", "select 'n_regionkey' as vars, 2::bigint as cols, 5::bigint as groups, true as dropped, (select string_agg(n, ',' order by k) from (select n_regionkey k, count(*)::varchar n from nation group by 1)) as sizes")
def _(t):
    grouped = t("nation") >> v.arrange(f.n_regionkey, f.n_nationkey) >> v.group_by(f.n_regionkey)
    return plain(vars=[",".join(v.group_vars(grouped))], cols=v.group_cols(grouped), groups=[v.n_groups(grouped)], dropped=[v.group_by_drop_default(grouped)], sizes=[",".join(map(str, v.group_size(grouped)))])


@query("group_keys", "select distinct n_regionkey from nation")
def _(t):
    return t("nation") >> v.group_by(f.n_regionkey) >> v.group_keys()


@query("group_data", "select n_regionkey, count(*) as n, min(i) as low, max(i) as top from (select n_regionkey, row_number() over (order by n_nationkey) - 1 as i from nation) group by 1")
def _(t):
    return t("nation") >> v.arrange(f.n_nationkey) >> v.group_by(f.n_regionkey) >> v.group_data() >> v.ungroup() >> v.select(n_regionkey=f.n_regionkey, at=f._rows) >> v.rowwise() >> v.transmute(n_regionkey=f.n_regionkey, n=v.lengths(f.at), low=v.min_(f.at), top=v.max_(f.at))


@query("group_rows_indices", "select (select count(*) from nation) as n, (select string_agg(g, ',' order by n_nationkey) from (select n_nationkey, (dense_rank() over (order by first) - 1)::varchar as g from (select n_nationkey, min(n_nationkey) over (partition by n_regionkey) as first from nation))) as idx")
def _(t):
    grouped = t("nation") >> v.arrange(f.n_nationkey) >> v.group_by(f.n_regionkey)
    return plain(n=[sum(map(len, v.group_rows(grouped)))], idx=[",".join(map(str, v.group_indices(grouped)))])


@query("group_map_split_walk", "select n_regionkey::bigint as key, count(*) as n, min(n_name) as low from nation group by 1")
def _(t):
    grouped = t("nation") >> v.arrange(f.n_regionkey) >> v.group_by(f.n_regionkey)
    seen: list = []
    v.group_walk(grouped, lambda rows, key: seen.append(key["n_regionkey"]))
    sizes = [v.nrow(x) for x in v.group_split(grouped)]
    return plain(key=seen, n=sizes, low=list(v.group_map(grouped, lambda rows: min(v.pull(rows, f.n_name)))))


@query("group_trim", "select event_type as k, count(*) as n from events group by 1")
def _(t):
    events = t("events") >> v.mutate(k=v.fct_expand(v.factor(f.event_type), "never")) >> v.group_by(f.k, _drop=False)
    return events >> v.group_trim() >> v.summarise(n=v.n())


@query("with_groups", "select n_regionkey, count(*) as n from nation group by 1")
def _(t):
    return t("nation") >> v.with_groups(f.n_regionkey, v.summarise, n=v.n())


@query("cur_group", "select n_regionkey, count(*) as n, max(n_nationkey) as top from nation group by 1")
def _(t):
    told = t("nation") >> v.group_by(f.n_regionkey) >> v.summarise(g=v.cur_group(), d=v.cur_data(), a=v.cur_data_all())
    return told >> v.ungroup() >> v.select(f.g, f.d, f.a) >> v.unpack(f.g) >> v.transmute(n_regionkey=f.n_regionkey, n=v.lengths(f.d), top=v.lengths(f.a)) >> v.left_join(t("nation") >> v.group_by(f.n_regionkey) >> v.summarise(most=v.max_(f.n_nationkey)), by="n_regionkey") >> v.transmute(n_regionkey=f.n_regionkey, n=f.n, top=f.most)


@query("cur_group_id", "select n_nationkey, dense_rank() over (order by first) - 1 as id from (select n_nationkey, min(n_nationkey) over (partition by n_regionkey) as first from nation)")
def _(t):
    return t("nation") >> v.arrange(f.n_nationkey) >> v.group_by(f.n_regionkey) >> v.mutate(id=v.cur_group_id()) >> v.ungroup() >> v.select(f.n_nationkey, f.id)


@query("cur_group_rows", "select n_regionkey, row_number() over (order by n_nationkey) - 1 as at from nation")
def _(t):
    return t("nation") >> v.arrange(f.n_nationkey) >> v.group_by(f.n_regionkey) >> v.summarise(at=v.cur_group_rows())


@query("cur_column", "select n_nationkey, 'n_name' as n_name, 'n_regionkey' as n_regionkey from nation")
def _(t):
    return t("nation") >> v.mutate(v.across(c(f.n_name, f.n_regionkey), lambda x: v.paste0(v.cur_column(), v.substr(v.as_character(x), 0, 0))))


# ---------------------------------------------------------------- counts and statistics
@query("tally", "select n_regionkey, count(*) as n from nation group by 1")
def _(t):
    return t("nation") >> v.group_by(f.n_regionkey) >> v.tally()


@query("add_tally", "select n_nationkey, (select count(*) from nation) as n from nation")
def _(t):
    return t("nation") >> v.add_tally() >> v.select(f.n_nationkey, f.n)


@query("tabulate", "select i as k, (select count(*) from part where p_size = i) as n from range(1, 6) r(i)")
def _(t):
    return plain(k=list(range(1, 6)), n=v.tabulate(t("part") >> v.select(f.p_size), 5))


@query("proportions", "select n_nationkey, round(n_nationkey / sum(n_nationkey) over (partition by n_regionkey), 8) as p from nation")
def _(t):
    return rounded(t("nation") >> v.group_by(f.n_regionkey) >> v.mutate(p=v.proportions(f.n_nationkey)) >> v.ungroup() >> v.select(f.n_nationkey, f.p), p=8)


@query("fct_count", f"select k as f, n, round(n / sum(n) over (), 8) as p from {KINDS}")
def _(t):
    return rounded(v.fct_count(t("events") >> v.transmute(k=v.factor(f.event_type)), sort=True, prop=True), p=8)


@query("prod", "select n_regionkey, product(n_nationkey + 1) as p from nation group by 1")
def _(t):
    return rounded(t("nation") >> v.group_by(f.n_regionkey) >> v.summarise(p=v.prod(f.n_nationkey + 1.0)), p=0)


@query("na_rm", "select k, any_value(g) as gaps, case when any_value(g) then null else sum(x)::bigint end as s, sum(x)::bigint as s2, case when any_value(g) then null else max(x) end as m, max(x) as m2, round(avg(x), 8) as a2, count(*) as n from (select n_regionkey as k, nullif(n_nationkey, 3) as x, bool_or(n_nationkey = 3) over (partition by n_regionkey) as g from nation) group by 1")
def _(t):
    gaps = t("nation") >> v.transmute(k=f.n_regionkey, x=v.na_if(f.n_nationkey, 3)) >> v.group_by(f.k)
    out = gaps >> v.summarise(gaps=v.any_na(f.x), s=v.sum_(f.x), s2=v.sum_(f.x, na_rm=True), m=v.max_(f.x), m2=v.max_(f.x, na_rm=True), a2=v.mean(f.x, na_rm=True), n=v.length(f.x))
    return rounded(out, a2=8)


@query("nth", "select user_id, max(value) filter (i = 2) as third, max(value) filter (back = 2) as before_last, arg_min(value, event_id) as low, arg_max(value, event_id) as high from (select *, row_number() over (partition by user_id order by event_id) - 1 as i, row_number() over (partition by user_id order by event_id desc) as back from events) group by 1")
def _(t):
    events = t("events") >> v.group_by(f.user_id)
    return events >> v.summarise(third=v.nth(f.value, 2, order_by=f.event_id), before_last=v.nth(f.value, -2, order_by=f.event_id), low=v.first2(f.event_id, f.value), high=v.last2(f.event_id, f.value))


@query("col_statistics", "select 'sum' as kind, round(sum(l_tax), 6) as l_tax, round(sum(l_discount), 6) as l_discount from lineitem union all select 'mean', round(avg(l_tax), 6), round(avg(l_discount), 6) from lineitem union all select 'sd', round(stddev_samp(l_tax), 6), round(stddev_samp(l_discount), 6) from lineitem union all select 'median', round(median(l_tax), 6), round(median(l_discount), 6) from lineitem")
def _(t):
    own = t("lineitem") >> v.select(f.l_tax, f.l_discount)
    parts = [fn(own) >> v.mutate(kind=kind, _before=0) for kind, fn in (("sum", v.col_sums), ("mean", v.col_means), ("sd", v.col_sds), ("median", v.col_medians))]
    return rounded(v.bind_rows(*parts), l_tax=6, l_discount=6)


@query("row_statistics", "select l_orderkey, l_linenumber, round(l_tax + l_discount + l_quantity, 6) as s, round((l_tax + l_discount + l_quantity) / 3, 6) as m, round(list_stddev_samp([l_tax, l_discount, l_quantity]), 6) as d, list_median([l_tax, l_discount, l_quantity]) as med, 2::bigint as top, greatest(l_tax, l_discount) as hi from lineitem")
def _(t):
    own = v.pick(f.l_tax, f.l_discount, f.l_quantity)
    out = t("lineitem") >> v.transmute(l_orderkey=f.l_orderkey, l_linenumber=f.l_linenumber, s=v.row_sums(own), m=v.row_means(own), d=v.row_sds(own), med=v.row_medians(own), top=v.max_col(own, "first"), hi=v.pmax(f.l_tax, f.l_discount))
    return rounded(out, s=6, m=6, d=6)


# ---------------------------------------------------------------- rows by position
@query("slice", "select event_id from (select event_id, row_number() over (partition by user_id order by event_id) as i, count(*) over (partition by user_id) as n from events) where i in (1, 3) or i = n")
def _(t):
    return t("events") >> v.arrange(f.event_id) >> v.group_by(f.user_id) >> v.slice_(0, 2, -1) >> v.ungroup() >> v.select(f.event_id)


@query("slice_tail", "select event_id, user_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 2")
def _(t):
    return t("events") >> v.select(f.event_id, f.user_id) >> v.arrange(f.event_id) >> v.group_by(f.user_id) >> v.slice_tail(n=2)


@query("slice_min", "select p_brand, p_partkey, p_size from part qualify rank() over (partition by p_brand order by p_size) <= 1")
def _(t):
    return t("part") >> v.group_by(f.p_brand) >> v.slice_min(f.p_size) >> v.ungroup() >> v.select(f.p_brand, f.p_partkey, f.p_size)


@query("tail", "select o_orderkey from orders order by o_orderkey desc limit 7")
def _(t):
    return t("orders") >> v.select(f.o_orderkey) >> v.arrange(f.o_orderkey) >> v.tail(7)


@query("slice_sample", "select event_type, 5::bigint as n, 5::bigint as ids from events group by 1")
def _(t):
    return t("events") >> v.group_by(f.event_type) >> v.slice_sample(n=5, random_state=7) >> v.summarise(n=v.n(), ids=v.n_distinct(f.event_id))


@query("slice_sample_replace", "select event_type, count(*) + 3 as n, true as known from events group by 1")
def _(t):
    events = t("events") >> v.group_by(f.event_type)
    sizes = events >> v.summarise(want=v.n() + 3)
    most = v.pull(sizes >> v.ungroup() >> v.summarise(m=v.max_(f.want)), f.m)[0]
    drawn = events >> v.slice_sample(n=most, replace=True, random_state=7) >> v.summarise(got=v.n(), ids=v.n_distinct(f.event_id))
    return drawn >> v.left_join(sizes, by="event_type") >> v.transmute(event_type=f.event_type, n=f.want, known=(f.got == most) & (f.ids < f.want) & (f.ids > 1))


@query("vector_orders", "select * from (values (1::bigint, 0::bigint, 3::bigint, 9::bigint), (2, 1, 2, 1), (3, 2, 1, 2)) t(s, o, r, a)")
def _(t):
    t("region")
    return plain(s=v.sort([3, 1, 2]), o=[v.order([1, 2, 3])[k] for k in range(3)], r=v.rev([1, 2, 3]), a=v.append([1, 2], [9], after=0)[1:2] + [1, 2])


# ---------------------------------------------------------------- missing values and recoding
@query("replace_na", "select p_partkey, coalesce(nullif(p_size, 7), -1) as p_size, coalesce(nullif(p_type, 'STANDARD'), 'none') as p_type from part")
def _(t):
    gaps = t("part") >> v.transmute(p_partkey=f.p_partkey, p_size=v.na_if(f.p_size, 7), p_type=v.na_if(f.p_type, "STANDARD"))
    return gaps >> v.replace_na({"p_size": -1, "p_type": "none"})


@query("full_seq", "select unnest(range(min(n_nationkey), max(n_nationkey) + 1, 4)) as k from nation where n_nationkey % 4 = 0")
def _(t):
    return t("nation") >> v.filter_(f.n_nationkey % 4 == 0) >> v.filter_(f.n_nationkey != 8) >> v.transmute(k=v.as_integer(f.n_nationkey)) >> v.expand(k=v.full_seq(f.k, 4))


@query("recode_factor", "select distinct o_orderstatus as was, case o_orderstatus when 'P' then 'part' when 'F' then 'final' else o_orderstatus end as k, case o_orderstatus when 'P' then 0 when 'F' then 1 else 2 end::bigint as code from orders")
def _(t):
    return t("orders") >> v.mutate(k=v.recode_factor(f.o_orderstatus, P="part", F="final")) >> v.transmute(was=f.o_orderstatus, k=f.k, code=v.as_integer(f.k)) >> v.distinct(f.was, f.k, f.code)


@query("identity", "select r_name as a, null::double as b from region")
def _(t):
    return t("region") >> v.transmute(a=v.identity(f.r_name), b=v.as_double(v.as_null(f.r_name)))


# ---------------------------------------------------------------- factors
def coded(t, make, column="event_type"):
    """The values of a factor of the events and their codes."""
    return t("events") >> v.mutate(k=make(f[column])) >> v.transmute(k=f.k, code=v.as_integer(f.k)) >> v.distinct(f.k, f.code)


@query("factor", f"select k, c0 as code from {KINDS}")
def _(t):
    return coded(t, v.factor)


@query("factor_labels", f"select k as was, upper(k) as k, c0 as code from {KINDS}")
def _(t):
    kinds = sorted(v.pull(t("events") >> v.distinct(f.event_type), f.event_type))
    return t("events") >> v.mutate(k=v.factor(f.event_type, levels=kinds, labels=[x.upper() for x in kinds])) >> v.transmute(was=f.event_type, k=f.k, code=v.as_integer(f.k)) >> v.distinct(f.was, f.k, f.code)


@query("as_factor", f"select k, row_number() over (order by first_id) - 1 as code, true as is_f, false as is_o, true as is_o2 from {KINDS}")
def _(t):
    events = t("events") >> v.arrange(f.event_id) >> v.mutate(k=v.as_factor(f.event_type), o=v.as_ordered(f.event_type))
    return events >> v.transmute(k=f.k, code=v.as_integer(f.k), is_f=v.is_factor(f.k), is_o=v.is_ordered(f.k), is_o2=v.is_ordered(f.o)) >> v.distinct()


@query("ordered", f"select k, m - 1 - c0 as code, true as is_o from {KINDS}")
def _(t):
    kinds = sorted(v.pull(t("events") >> v.distinct(f.event_type), f.event_type), reverse=True)
    return t("events") >> v.mutate(k=v.ordered(f.event_type, levels=kinds)) >> v.transmute(k=f.k, code=v.as_integer(f.k), is_o=v.is_ordered(f.k)) >> v.distinct()


@query("levels", "select * from (values ('b', 0::bigint, 3::bigint), ('a', 1, 3), ('z', 2, 3)) t(level, code, n)")
def _(t):
    t("region")
    x = v.factor(["a", "b", "a"], levels=["b", "a", "z"])
    return plain(level=v.levels(x), code=[0, 1, 2], n=[v.nlevels(x)] * 3)


@query("set_levels", f"select 'L' || c0 as k, c0 as code from {KINDS}")
def _(t):
    return coded(t, lambda x: v.set_levels(v.factor(x), [f"L{k}" for k in range(len(v.pull(t("events") >> v.distinct(f.event_type), f.event_type)))]))


@query("fct_relevel", f"select k, case when k = 'view' then 0 else row_number() over (partition by k = 'view' order by k) end as code from {KINDS}")
def _(t):
    return coded(t, lambda x: v.fct_relevel(v.factor(x), "view"))


@query("fct_relevel_after", f"select k, case when k = 'view' then 1 when r = 1 then 0 else r end as code from (select *, row_number() over (partition by k = 'view' order by k) as r from {KINDS})")
def _(t):
    return coded(t, lambda x: v.fct_relevel(v.factor(x), "view", after=0))


@query("fct_inorder", f"select k, row_number() over (order by first_id) - 1 as code from {KINDS}")
def _(t):
    return t("events") >> v.arrange(f.event_id) >> v.mutate(k=v.fct_inorder(v.factor(f.event_type))) >> v.transmute(k=f.k, code=v.as_integer(f.k)) >> v.distinct()


@query("fct_inseq", "select p_size::varchar as k, dense_rank() over (order by p_size) - 1 as code from (select distinct p_size from part)")
def _(t):
    return t("part") >> v.mutate(k=v.fct_inseq(v.factor(v.as_character(f.p_size)))) >> v.transmute(k=f.k, code=v.as_integer(f.k)) >> v.distinct()


@query("fct_reorder", "select event_type as k, row_number() over (order by median(value), event_type) - 1 as code from events group by 1")
def _(t):
    return coded(t, lambda x: v.fct_reorder(v.factor(x), f.value))


@query("fct_reorder2", "select event_type as k, row_number() over (order by max_by(value, event_id) desc, event_type) - 1 as code from events group by 1")
def _(t):
    return coded(t, lambda x: v.fct_reorder2(v.factor(x), f.event_id, f.value))


@query("fct_shuffle", f"select c0 as code from {KINDS}")
def _(t):
    v.set_seed(5)
    return coded(t, lambda x: v.fct_shuffle(v.factor(x))) >> v.select(f.code)


@query("fct_anon", f"select 'k' || c0 as k, c0 as code from {KINDS}")
def _(t):
    v.set_seed(5)
    return coded(t, lambda x: v.fct_anon(v.factor(x), "k"))


@query("fct_rev", f"select k, m - 1 - c0 as code from {KINDS}")
def _(t):
    return coded(t, lambda x: v.fct_rev(v.factor(x)))


@query("fct_shift", f"select k, (c0 - 2 + m) % m as code from {KINDS}")
def _(t):
    return coded(t, lambda x: v.fct_shift(v.factor(x), 2))


@query("lvls_reorder", f"select k, m - 1 - c0 as code from {KINDS}")
def _(t):
    return coded(t, lambda x: v.lvls_reorder(v.factor(x), list(reversed(range(len(v.pull(t("events") >> v.distinct(f.event_type), f.event_type)))))))


@query("fct_recode", f"select case k when 'view' then 'seen' else k end as k, c0 as code from {KINDS}")
def _(t):
    return coded(t, lambda x: v.fct_recode(v.factor(x), seen="view"))


@query("fct_collapse", "select case when event_type in ('view', 'click') then 'used' else 'rest' end as k, count(*) as n from events group by 1")
def _(t):
    return t("events") >> v.mutate(k=v.fct_collapse(v.factor(f.event_type), other_level="rest", used=["view", "click"])) >> v.count(f.k)


@query("fct_lump_min", f"select case when n >= (select median(n) from {KINDS}) then k else 'Other' end as k, sum(n)::bigint as n from {KINDS} group by 1")
def _(t):
    middle = sorted(v.pull(t("events") >> v.count(f.event_type), f.n))
    return t("events") >> v.mutate(k=v.fct_lump_min(v.factor(f.event_type), middle[len(middle) // 2])) >> v.count(f.k)


@query("fct_lump_prop", f"select case when n / (select sum(n) from {KINDS}) > 0.2 then k else 'Other' end as k, sum(n)::bigint as n from {KINDS} group by 1")
def _(t):
    return t("events") >> v.mutate(k=v.fct_lump_prop(v.factor(f.event_type), 0.2)) >> v.count(f.k)


@query("fct_lump_lowfreq", "select * from (values ('A', 40::bigint), ('D', 27), ('Other', 20)) t(k, n)")
def _(t):
    t("region")
    x = v.tibble(k=["A"] * 40 + ["B"] * 10 + ["C"] * 5 + ["D"] * 27 + list("EFGHI"))
    return x >> v.mutate(k=v.fct_lump_lowfreq(v.factor(f.k))) >> v.count(f.k)


@query("fct_lump_rules", f"select case when rank() over (order by n desc) <= 3 then k else 'Rest' end as k from {KINDS}")
def _(t):
    return t("events") >> v.distinct(f.event_type) >> v.left_join(t("events") >> v.count(f.event_type), by="event_type") >> v.transmute(k=v.as_character(v.fct_lump(v.factor(f.event_type), n=3, w=f.n, other_level="Rest")))


@query("fct_other", "select case when event_type in ('view', 'click') then event_type else 'Other' end as k, count(*) as n from events group by 1")
def _(t):
    return t("events") >> v.mutate(k=v.fct_other(v.factor(f.event_type), keep=["view", "click"])) >> v.count(f.k)


@query("fct_relabel", f"select upper(k) as k, c0 as code from {KINDS}")
def _(t):
    return coded(t, lambda x: v.fct_relabel(v.factor(x), str.upper))


@query("lvls_revalue", f"select 'v' || c0 as k, c0 as code from {KINDS}")
def _(t):
    return coded(t, lambda x: v.lvls_revalue(v.factor(x), [f"v{k}" for k in range(len(v.pull(t("events") >> v.distinct(f.event_type), f.event_type)))]))


@query("fct_expand_drop", f"select k, n from {KINDS} union all select 'never', 0")
def _(t):
    events = t("events") >> v.mutate(k=v.fct_expand(v.factor(f.event_type), "never", "gone"))
    return events >> v.mutate(k=v.fct_drop(f.k, "gone")) >> v.count(f.k, _drop=False)


@query("droplevels", f"select k, n from {KINDS}")
def _(t):
    return t("events") >> v.mutate(k=v.droplevels(v.fct_expand(v.factor(f.event_type), "never"))) >> v.count(f.k, _drop=False)


@query("lvls_expand", f"select k, c0 + 1 as code from {KINDS}")
def _(t):
    kinds = sorted(v.pull(t("events") >> v.distinct(f.event_type), f.event_type))
    return coded(t, lambda x: v.lvls_expand(v.factor(x), ["zero", *kinds]))


@query("fct_explicit_na", "select coalesce(nullif(event_type, 'view'), '(Missing)') as k, count(*) as n from events group by 1")
def _(t):
    return t("events") >> v.mutate(k=v.fct_explicit_na(v.factor(v.na_if(f.event_type, "view")))) >> v.count(f.k)


@query("fct_vectors", "select * from (values ('a', 'a b c', 'a b', 'b', 'a b c'), ('c', 'a b c', 'a b', 'a', 'a b c'), ('b', 'a b c', 'a b', 'b', 'a b c')) t(value, whole, left_, was, unified)")
def _(t):
    t("region")
    x, y = v.factor(["b", "a", "b"]), v.factor(["c"])
    joined = v.fct_c(v.factor(["a"]), y, v.factor(["b"], levels=["b"]))
    union = " ".join(sorted(v.lvls_union([x, y])))
    return plain(value=list(joined), whole=[union] * 3, left_=[" ".join(v.fct_unique(x))] * 3, was=list(x), unified=[" ".join(v.levels(v.fct_unify([x, y])[1]))] * 3)


@query("fct_cross", "select l_returnflag || ':' || l_linestatus as k, count(*) as n from lineitem group by 1")
def _(t):
    return t("lineitem") >> v.mutate(k=v.fct_cross(v.factor(f.l_returnflag), v.factor(f.l_linestatus))) >> v.count(f.k)


@query("fct_match", "select event_id from events where event_type in ('view', 'click')")
def _(t):
    return t("events") >> v.filter_(v.fct_match(v.factor(f.event_type), ["view", "click"])) >> v.select(f.event_id)


@query("fct_levels_count", f"select count(*) as n, string_agg(k, ',' order by k) as names from {KINDS}")
def _(t):
    counted = v.fct_count(t("events") >> v.transmute(k=v.factor(f.event_type)))
    return plain(n=[v.nrow(counted)], names=[",".join(v.pull(counted, f.f))])


# ---------------------------------------------------------------- numbers
@query("rounding", "select l_orderkey, l_linenumber, ceil(l_tax * 10) as ce, trunc(l_discount * 100 - 5)::double as tr, abs(l_tax - 0.04) as ab, sign(l_tax - 0.04)::double as sg from lineitem")
def _(t):
    return t("lineitem") >> v.transmute(l_orderkey=f.l_orderkey, l_linenumber=f.l_linenumber, ce=v.as_double(v.ceiling(f.l_tax * 10)), tr=v.as_double(v.trunc(f.l_discount * 100 - 5)), ab=v.abs_(f.l_tax - 0.04), sg=v.as_double(v.sign(f.l_tax - 0.04)))


@query("signif", "select n_nationkey, case when n_nationkey < 10 then n_nationkey when n_nationkey in (15, 25) then 20 else round(n_nationkey / 10.0, 0) * 10 end::double as s from nation")
def _(t):
    return t("nation") >> v.transmute(n_nationkey=f.n_nationkey, s=v.as_double(v.signif(f.n_nationkey + 0.0, 1)))


@query("logs", "select l_orderkey, l_linenumber, round(log2(l_quantity), 8) as l2, round(log10(l_quantity), 8) as l10, round(ln(1 + l_tax), 8) as lp from lineitem")
def _(t):
    return rounded(t("lineitem") >> v.transmute(l_orderkey=f.l_orderkey, l_linenumber=f.l_linenumber, l2=v.log2(f.l_quantity), l10=v.log10(f.l_quantity), lp=v.log1p(f.l_tax)), l2=8, l10=8, lp=8)


@query("trigonometry", "select p_partkey, round(cos(p_size), 8) as c, round(tan(p_size), 6) as t, round(acos(x), 8) as ac, round(asin(x), 8) as asn, round(atan(p_size), 8) as at, round(atan2(p_size, 3), 8) as at2, round(cos(pi() * x), 8) as cp, round(sin(pi() * x), 8) as sp, round(tan(pi() * x / 4), 8) as tp from (select *, p_size / 60.0 as x from part)")
def _(t):
    part = t("part") >> v.mutate(x=f.p_size / 60.0)
    out = part >> v.transmute(p_partkey=f.p_partkey, c=v.cos(f.p_size), t=v.tan(f.p_size), ac=v.acos(f.x), asn=v.asin(f.x), at=v.atan(f.p_size), at2=v.atan2(f.p_size, 3), cp=v.cospi(f.x), sp=v.sinpi(f.x), tp=v.tanpi(f.x / 4))
    return rounded(out, c=8, t=6, ac=8, asn=8, at=8, at2=8, cp=8, sp=8, tp=8)


@query("hyperbolic", "select p_partkey, round((exp(x) + exp(-x)) / 2, 8) as ch, round((exp(x) - exp(-x)) / 2, 8) as sh, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 8) as th, round(ln(p_size + sqrt(p_size * p_size - 1)), 8) as ach, round(ln(x + sqrt(x * x + 1)), 8) as ash, round(0.5 * ln((1 + x) / (1 - x)), 8) as ath from (select *, p_size / 60.0 as x from part)")
def _(t):
    part = t("part") >> v.mutate(x=f.p_size / 60.0)
    out = part >> v.transmute(p_partkey=f.p_partkey, ch=v.cosh(f.x), sh=v.sinh(f.x), th=v.tanh(f.x), ach=v.acosh(f.p_size), ash=v.asinh(f.x), ath=v.atanh(f.x))
    return rounded(out, ch=8, sh=8, th=8, ach=8, ash=8, ath=8)


def series(term: str, terms: int = 40) -> str:
    """SQL: the sum of a term of k."""
    return f"list_sum(list_transform(range({terms}), lambda k: {term}))"


EULER = 0.5772156649015329
_J0 = series("pow(-1, k) * pow(x / 2, 2 * k) / pow(gamma(k + 1), 2)")
_I0 = series("pow(x / 2, 2 * k) / pow(gamma(k + 1), 2)")
_H = "coalesce(list_sum(list_transform(range(1, k + 1), lambda j: 1.0 / j)), 0)"
_Y0 = f"2 / pi() * ((ln(x / 2) + {EULER}) * {_J0} + {series(f'pow(-1, k + 1) * {_H} * pow(x / 2, 2 * k) / pow(gamma(k + 1), 2)')})"
_K0 = f"-(ln(x / 2) + {EULER}) * {_I0} + {series(f'{_H} * pow(x / 2, 2 * k) / pow(gamma(k + 1), 2)')}"


@query("bessel", f"select p_partkey, round({_J0}, 6) as j, round({_I0}, 6) as i, round({_Y0}, 5) as y, round({_K0}, 5) as kk from (select p_partkey, p_size / 10.0 as x from part where p_size <= 40)")
def _(t):
    part = t("part") >> v.filter_(f.p_size <= 40) >> v.mutate(x=f.p_size / 10.0)
    return rounded(part >> v.transmute(p_partkey=f.p_partkey, j=v.bessel_j(f.x, 0), i=v.bessel_i(f.x, 0), y=v.bessel_y(f.x, 0), kk=v.bessel_k(f.x, 0)), j=6, i=6, y=5, kk=5)


@query(
    "special_functions",
    f"select p_partkey, round(-{EULER} + coalesce(list_sum(list_transform(range(1, s), lambda k: 1.0 / k)), 0), 8) as a, round({math.pi**2 / 6!r} - coalesce(list_sum(list_transform(range(1, s), lambda k: 1.0 / (k * k))), 0), 8) as b, round(-2 * (1.2020569031595942 - coalesce(list_sum(list_transform(range(1, s), lambda k: 1.0 / (k * k * k))), 0)), 8) as d, round(gamma(s), 4) as g, round(s * (s - 1) / 2, 4) as ch, round(lgamma(s + 1), 8) as lf, round(gamma(s + 1), 4) as fa from (select p_partkey, p_size % 12 + 1 as s from part)",
)
def _(t):
    part = t("part") >> v.mutate(s=f.p_size % 12 + 1)
    out = part >> v.transmute(p_partkey=f.p_partkey, a=v.digamma(f.s), b=v.trigamma(f.s), d=v.psigamma(f.s, 2), g=v.gamma(f.s), ch=v.choose(f.s, 2), lf=v.lfactorial(f.s), fa=v.factorial(f.s))
    return rounded(out, a=8, b=8, d=8, g=4, ch=4, lf=8, fa=4)


@query("beta", "select p_partkey, round(exp(lgamma(s) + lgamma(3) - lgamma(s + 3)), 10) as b, round(lgamma(s) + lgamma(3) - lgamma(s + 3), 8) as lb, round(ln(s), 8) as lc from (select p_partkey, p_size % 12 + 1 as s from part)")
def _(t):
    part = t("part") >> v.mutate(s=f.p_size % 12 + 1)
    return rounded(part >> v.transmute(p_partkey=f.p_partkey, b=v.beta(f.s, 3), lb=v.lbeta(f.s, 3), lc=v.lchoose(f.s, 1)), b=10, lb=8, lc=8)


@query("complex", "select n_nationkey, n_nationkey::double as re, round(sqrt(n_nationkey * n_nationkey + 0), 8) as md, 0::double as im, n_nationkey::double as cre, 0::double as ar from nation")
def _(t):
    nation = t("nation") >> v.mutate(z=v.as_complex(f.n_nationkey))
    return rounded(nation >> v.transmute(n_nationkey=f.n_nationkey, re=v.re_(f.z), md=v.mod(f.z), im=v.im(f.z), cre=v.re_(v.conj(f.z)), ar=v.arg(f.z)), md=8)


@query("array_ufunc", "select p_partkey, round(sqrt(p_retailprice), 8) as s, p_size + 1::bigint as a from part")
def _(t):
    return rounded(t("part") >> v.transmute(p_partkey=f.p_partkey, s=np.sqrt(f.p_retailprice), a=np.add(f.p_size, 1)), s=8)


@query("matrices", "select * from (values (1::bigint, 2::bigint, 1::bigint, 4::bigint), (3, 4, 4, 8)) t(a, b, d, o)")
def _(t):
    t("region")
    x = v.tibble(a=[1, 3], b=[2, 4])
    flipped = v.t(v.t(x)).to_dict()
    return plain(a=list(flipped.values())[0], b=list(flipped.values())[1], d=v.diag(x), o=v.pull(v.outer([1, 2], [3, 4]), 1))


@query("random_columns", "select (select count(*) from nation) as n, true as again, true as uniform, true as positive, true as whole, true as bounded, true as finite")
def _(t):
    def drawn():
        v.set_seed(1)
        return t("nation") >> v.mutate(z=f.n_regionkey * 0) >> v.mutate(a=v.rnorm(1, f.z), b=v.runif(1, f.z + 2, 3), d=v.rexp(1, f.z + 2), e=v.rpois(1, f.z + 3), g=v.rbinom(1, f.z + 4, 0.5), h=v.rcauchy(1, f.z), i=v.rchisq(1, f.z + 3))

    first, second = drawn(), drawn() >> v.transmute(n_nationkey=f.n_nationkey, a2=f.a, b2=f.b, d2=f.d, h2=f.h)
    told = first >> v.left_join(second, by="n_nationkey")
    return told >> v.summarise(
        n=v.n_distinct(f.a), again=v.all_((f.a == f.a2) & (f.b == f.b2) & (f.d == f.d2) & (f.h == f.h2)), uniform=v.all_((f.b >= 2) & (f.b < 3)), positive=v.all_((f.d > 0) & (f.i > 0)), whole=v.all_((f.e >= 0) & (f.e == v.floor(f.e))), bounded=v.all_((f.g >= 0) & (f.g <= 4)), finite=v.all_(v.is_finite(f.h))
    )


@query("sample", "select 3::bigint as n, true as known, true as again, 8::bigint as replaced")
def _(t):
    t("region")
    v.set_seed(3)
    first = v.sample([1, 2, 3, 4, 5], 3)
    v.set_seed(3)
    return plain(n=[len(set(first))], known=[set(first) <= {1, 2, 3, 4, 5}], again=[v.sample([1, 2, 3, 4, 5], 3) == first], replaced=[len(v.sample([1, 2], 8, replace=True))])


# ---------------------------------------------------------------- text
@query("text", "select p_partkey, lower(p_type) as lo, ends_with(p_name, 'e') as en, substr(p_name, 3) as su, trim(' ' || p_name || ' ') as tr, p_brand || p_size::varchar as pa, p_name <> '' as nz, printf('%s-%03d', p_brand, p_size) as sp from part")
def _(t):
    return t("part") >> v.transmute(
        p_partkey=f.p_partkey, lo=v.tolower(f.p_type), en=v.endswith(f.p_name, "e"), su=v.substring(f.p_name, 2), tr=v.trimws(v.paste0(" ", f.p_name, " ")), pa=v.paste0(f.p_brand, f.p_size), nz=v.nzchar(f.p_name), sp=v.sprintf("%s-%03d", f.p_brand, f.p_size)
    )


@query("strsplit", "select p_partkey, len(string_split(p_name, ' ')) as n, split_part(p_name, ' ', 1) as head from part")
def _(t):
    words = t("part") >> v.transmute(p_partkey=f.p_partkey, words=v.strsplit(f.p_name, " ", fixed=True))
    return words >> v.rowwise() >> v.transmute(p_partkey=f.p_partkey, n=v.lengths(f.words), head=v.first(f.words))


@query("strtoi", "select p_partkey, p_size::bigint as d, (p_size // 10 * 16 + p_size % 10)::bigint as h from part")
def _(t):
    return t("part") >> v.transmute(p_partkey=f.p_partkey, d=v.strtoi(v.as_character(f.p_size), 10), h=v.strtoi(v.as_character(f.p_size), 16))


@query("grep", "select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as at from nation qualify regexp_matches(n_name, '[02468]$')")
def _(t):
    return t("nation") >> v.arrange(f.n_nationkey) >> v.group_by(f.n_regionkey) >> v.summarise(at=v.grep("[02468]$", f.n_name))


@query("make_names", "select * from (values ('a_b', 'x__0'), ('_1', 'y'), ('z', 'x__2')) t(valid, once)")
def _(t):
    t("region")
    return plain(valid=v.make_names(["a b", 1, "z"]), once=v.make_unique(["x", "y", "x"]))


# ---------------------------------------------------------------- casts and vectors
@query("casts", "select o_orderkey, o_totalprice > 0 as lg, o_orderkey::double as nu, o_orderkey::varchar as ch, null::bigint as bad from orders")
def _(t):
    return t("orders") >> v.transmute(o_orderkey=f.o_orderkey, lg=v.as_logical(f.o_totalprice > 0), nu=v.as_double(v.as_numeric(v.as_character(f.o_orderkey))), ch=v.as_character(f.o_orderkey), bad=v.as_integer(f.o_orderstatus))


@query("sequences", "select * from (values (1::bigint, 2::bigint, 1::bigint, 7::bigint, 1::bigint), (3, 4, 2, 7, 1), (5, 6, 3, 8, 2), (7, 8, 4, 8, 2)) t(a, b, d, e, g)")
def _(t):
    t("region")
    return plain(a=v.seq(1, 7, 2), b=v.seq(2, 8, by=2), d=v.seq_len(4), e=v.rep([7, 8], each=2), g=[x for k in v.seq_along(["x", "y"]) for x in (k, k)])


@query("vectors", "select n_nationkey, greatest(n_nationkey, n_regionkey) as top, 2::bigint as size from nation")
def _(t):
    both = t("nation") >> v.transmute(n_nationkey=f.n_nationkey, both=v.c_(f.n_nationkey, f.n_regionkey))
    return both >> v.rowwise() >> v.transmute(n_nationkey=f.n_nationkey, top=v.max_(f.both), size=v.lengths(f.both))


# ---------------------------------------------------------------- shapes in between
@query("chop", "select o_custkey, count(*) as n, min(o_orderkey) as head, max(o_orderkey) as foot from orders group by 1")
def _(t):
    return t("orders") >> v.select(f.o_custkey, f.o_orderkey) >> v.arrange(f.o_orderkey) >> v.chop(f.o_orderkey) >> v.rowwise() >> v.transmute(o_custkey=f.o_custkey, n=v.lengths(f.o_orderkey), head=v.first(f.o_orderkey), foot=v.last(f.o_orderkey))


@query("nest", "select c_nationkey, count(*) as n from customer group by 1")
def _(t):
    return t("customer") >> v.select(f.c_nationkey, f.c_custkey, f.c_name) >> v.nest(data=c(f.c_custkey, f.c_name)) >> v.transmute(c_nationkey=f.c_nationkey, n=v.lengths(f.data))


@query("pack", "select n_nationkey, n_name as a, n_regionkey as b, 'n_nationkey p$n_name p$n_regionkey' as names from nation")
def _(t):
    packed = t("nation") >> v.pack(p=c(f.n_name, f.n_regionkey))
    return packed >> v.transmute(n_nationkey=f.n_nationkey, a=f.p["n_name"], b=f.p["n_regionkey"], names=" ".join(v.colnames(packed)))


@query("expand", "select a.r, b.s from (select distinct l_returnflag r from lineitem) a cross join (select distinct l_linestatus s from lineitem) b")
def _(t):
    return t("lineitem") >> v.expand(r=f.l_returnflag, s=f.l_linestatus)


@query("unite", "select p_partkey, p_brand || '/' || p_type as u from part")
def _(t):
    return t("part") >> v.select(f.p_partkey, f.p_brand, f.p_type) >> v.unite("u", f.p_brand, f.p_type, sep="/")
