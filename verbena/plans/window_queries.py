"""Queries of ranking, offset and cumulative functions, in groups and over whole tables."""

from __future__ import annotations

from verbena import all as v
from verbena.all import f
from verbena.plans.registry import query, rounded


@query("cumulative_more", "select event_id, round(product(1 + value / 10000) over w, 8) as cp, min(value) over w as cn, round(avg(value / 7) over w, 6) as ca, bool_or(value > 90) over w as cy from events window w as (partition by user_id order by event_id rows unbounded preceding)")
def _(t):
    out = t("events") >> v.arrange(f.event_id) >> v.group_by(f.user_id) >> v.mutate(cp=v.cumprod(1 + f.value / 10000), cn=v.cummin(f.value), ca=v.cummean(f.value / 7), cy=v.cumany(f.value > 90))
    return rounded(out >> v.ungroup() >> v.select(f.event_id, f.cp, f.cn, f.ca, f.cy), cp=8, ca=6)


@query("ranks_of_ties", "select l_orderkey, l_linenumber, l_quantity, rank() over w as lo, rank() over w + c - 1 as hi, rank() over w + (c - 1) / 2.0::double as av from (select *, count(*) over (partition by l_returnflag, l_quantity) as c from lineitem) window w as (partition by l_returnflag order by l_quantity)")
def _(t):
    ranked = t("lineitem") >> v.group_by(f.l_returnflag) >> v.mutate(lo=v.rank(f.l_quantity, ties_method="min"), hi=v.rank(f.l_quantity, ties_method="max"), av=v.rank(f.l_quantity))
    return ranked >> v.ungroup() >> v.select(f.l_orderkey, f.l_linenumber, f.l_quantity, f.lo, f.hi, f.av)


@query("rank_functions", "select event_id, row_number() over w as rn, rank() over w as mr, dense_rank() over w as dr, percent_rank() over w as pr, cume_dist() over w as cd, ntile(3) over w as nt from events window w as (partition by user_id order by event_id)")
def _(t):
    ranked = t("events") >> v.group_by(f.user_id) >> v.mutate(rn=v.row_number_(f.event_id), mr=v.min_rank_(f.event_id), dr=v.dense_rank_(f.event_id), pr=v.percent_rank_(f.event_id), cd=v.cume_dist_(f.event_id), nt=v.ntile_(f.event_id, n=3))
    return ranked >> v.ungroup() >> v.select(f.event_id, f.rn, f.mr, f.dr, f.pr, f.cd, f.nt)


@query("diff", "select event_id, value - lag(value) over w as d, value - 2 * lag(value) over w + lag(value, 2) over w as dd from (select event_id, user_id, round(value * 100)::bigint as value from events) window w as (partition by user_id order by event_id)")
def _(t):
    events = t("events") >> v.mutate(value=v.as_integer(v.round_(f.value * 100))) >> v.arrange(f.event_id) >> v.group_by(f.user_id)
    return events >> v.mutate(d=v.diff(f.value), dd=v.diff(f.value, differences=2)) >> v.ungroup() >> v.select(f.event_id, f.d, f.dd)


@query("order_by", "select event_id, round(sum(value) over (partition by user_id order by event_id desc rows unbounded preceding), 6) as s, lead(value) over (partition by user_id order by event_id desc) as nx from events")
def _(t):
    out = t("events") >> v.group_by(f.user_id) >> v.mutate(s=v.order_by(v.desc(f.event_id), v.cumsum(f.value)), nx=v.with_order(v.desc(f.event_id), v.lead, f.value))
    return rounded(out >> v.ungroup() >> v.select(f.event_id, f.s, f.nx), s=6)


@query("cumulative_table", "select event_id, (sum(v) over w)::bigint as cs, min(v) over w as cn, max(v) over w as cm, round(sum(v) over w / count(v) over w, 6) as ca, bool_and(v < 9900) over w as cl, bool_or(v > 9900) over w as cy from (select event_id, round(value * 100)::bigint as v from events) window w as (order by event_id rows unbounded preceding)")
def _(t):
    events = t("events") >> v.transmute(event_id=f.event_id, v=v.as_integer(v.round_(f.value * 100))) >> v.arrange(f.event_id)
    out = events >> v.transmute(event_id=f.event_id, cs=v.cumsum(f.v), cn=v.cummin(f.v), cm=v.cummax(f.v), ca=v.cummean(f.v), cl=v.cumall(f.v < 9900), cy=v.cumany(f.v > 9900))
    return rounded(out, ca=6)


@query("cumprod_table", "select event_id, round(sum(ln(1 + value / 1000000)) over (order by event_id rows unbounded preceding), 8) as lp from events")
def _(t):
    return rounded(t("events") >> v.arrange(f.event_id) >> v.transmute(event_id=f.event_id, lp=v.log(v.cumprod(1 + f.value / 1000000))), lp=8)


@query("lead_lag_table", "select event_id, lag(value) over w as pv, lead(value, 3, -1) over w as nv, lag(value, 700) over w as far, value - lag(value) over w as d from (select event_id, round(value * 100)::bigint as value from events) window w as (order by event_id)")
def _(t):
    events = t("events") >> v.transmute(event_id=f.event_id, value=v.as_integer(v.round_(f.value * 100))) >> v.arrange(f.event_id)
    return events >> v.transmute(event_id=f.event_id, pv=v.lag(f.value), nv=v.lead(f.value, 3, default=-1), far=v.lag(f.value, 700), d=v.diff(f.value))


@query("lead_lag_by_key", "select event_id, lag(event_id) over w as p, lead(event_id) over w as n from events window w as (order by value desc, event_id)")
def _(t):
    events = t("events") >> v.arrange(v.desc(f.value), f.event_id)
    return events >> v.transmute(event_id=f.event_id, p=v.lag(f.event_id), n=v.lead(f.event_id))


@query("fill_table", "select event_id, last_value(v ignore nulls) over (order by event_id rows unbounded preceding) as d, first_value(v ignore nulls) over (order by event_id rows between current row and unbounded following) as u from (select event_id, case when value > 99 then value end as v from events)")
def _(t):
    gaps = t("events") >> v.arrange(f.event_id) >> v.transmute(event_id=f.event_id, d=v.if_else(f.value > 99, f.value, None), u=f.d)
    return gaps >> v.fill(f.d) >> v.fill(f.u, _direction="up")


@query("ranks_table", "select event_id, rank() over w as mr, dense_rank() over w as dr, percent_rank() over w as pr, cume_dist() over w as cd, row_number() over (order by event_id desc) as rn, ntile(7) over (order by event_id) as nt, rank() over (order by k desc) as dn from (select event_id, floor(value) as k from events) window w as (order by k)")
def _(t):
    events = t("events") >> v.transmute(event_id=f.event_id, k=v.floor(f.value))
    return events >> v.transmute(event_id=f.event_id, mr=v.min_rank(f.k), dr=v.dense_rank(f.k), pr=v.percent_rank(f.k), cd=v.cume_dist(f.k), rn=v.row_number(v.desc(f.event_id)), nt=v.ntile(f.event_id, n=7), dn=v.min_rank(v.desc(f.k)))


@query("ranks_missing", "select event_id, case when k is not null then rank() over (order by k nulls last) end as keep, rank() over (order by k nulls last) as bottom, rank() over (order by k nulls first) as top, case when k is not null then (rank() over (order by k nulls last) - 1) / ((select count(k) from g) - 1)::double end as pr from (select event_id, case when value < 90 then floor(value) end as k from events) g".replace("from g)", "from (select case when value < 90 then value end as k from events))"))
def _(t):
    events = t("events") >> v.transmute(event_id=f.event_id, k=v.if_else(f.value < 90, v.floor(f.value), None))
    return events >> v.transmute(event_id=f.event_id, keep=v.min_rank(f.k), bottom=v.min_rank(f.k, na_last="bottom"), top=v.min_rank(f.k, na_last="top"), pr=v.percent_rank(f.k))


@query("ranks_missing_grouped", "select event_id, case when k is not null then rank() over w end as keep, rank() over w as bottom, case when k is not null then (count(k) over (w range unbounded preceding)) / (count(k) over (partition by event_type))::double end as cd from (select event_id, event_type, case when value < 90 then floor(value) end as k from events) window w as (partition by event_type order by k nulls last)")
def _(t):
    events = t("events") >> v.transmute(event_id=f.event_id, event_type=f.event_type, k=v.if_else(f.value < 90, v.floor(f.value), None)) >> v.group_by(f.event_type)
    return events >> v.mutate(keep=v.min_rank(f.k), bottom=v.min_rank(f.k, na_last="bottom"), cd=v.cume_dist(f.k)) >> v.ungroup() >> v.select(f.event_id, f.keep, f.bottom, f.cd)


@query("rank_table", "select event_id, (2 * rank() over w + c - 1) / 2.0::double as av, rank() over w + c - 1 as hi, row_number() over (order by k, event_id) as one from (select event_id, floor(value) as k, count(*) over (partition by floor(value)) as c from events) window w as (order by k)")
def _(t):
    events = t("events") >> v.transmute(event_id=f.event_id, k=v.floor(f.value)) >> v.arrange(f.event_id)
    return events >> v.transmute(event_id=f.event_id, av=v.rank(f.k), hi=v.rank(f.k, ties_method="max"), one=v.rank(f.k, ties_method="first"))


@query("runs_table", "select event_id, (1 + sum(ch) over (order by event_id rows unbounded preceding))::bigint as cid from (select event_id, case when event_type is distinct from lag(event_type) over (order by event_id) and row_number() over (order by event_id) > 1 then 1 else 0 end as ch from events)")
def _(t):
    return t("events") >> v.arrange(f.event_id) >> v.transmute(event_id=f.event_id, cid=v.consecutive_id(f.event_type))


@query("positions_table", "select event_id, row_number() over (order by value, event_id) as rn from events")
def _(t):
    return t("events") >> v.arrange(f.value, f.event_id) >> v.transmute(event_id=f.event_id, rn=v.row_number())


@query("slice_max_table", "select event_id, value from events qualify rank() over (order by floor(value) desc) <= 20")
def _(t):
    return t("events") >> v.mutate(k=v.floor(f.value)) >> v.slice_max(f.k, n=20) >> v.select(f.event_id, f.value)
