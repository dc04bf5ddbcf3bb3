"""Registered queries of the grammar and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from verbena import all as v
from verbena.all import f
from verbena.plans.registry import ORACLE_SQL, QUERIES, query, rounded

# ---------------------------------------------------------------- filter and projection
@query("filter_basic", "select l_orderkey, l_quantity from lineitem where l_quantity > 45 and l_returnflag = 'R'")
def _(t):
    return t("lineitem") >> v.filter_(f.l_quantity > 45, f.l_returnflag == "R") >> v.select(f.l_orderkey, f.l_quantity)


@query("filter_group_mean", "select l_suppkey, l_quantity from lineitem qualify l_quantity > avg(l_quantity) over (partition by l_suppkey)")
def _(t):
    return t("lineitem") >> v.select(f.l_suppkey, f.l_quantity) >> v.group_by(f.l_suppkey) >> v.filter_(f.l_quantity > v.mean(f.l_quantity, na_rm=True))


@query("mutate_seq", "select l_orderkey, round(l_extendedprice*(1-l_discount),4) as net, case when l_extendedprice*(1-l_discount) > 50000 then 'big' else 'small' end as size from lineitem")
def _(t):
    return rounded(t("lineitem") >> v.transmute(l_orderkey=f.l_orderkey, net=f.l_extendedprice * (1 - f.l_discount), size=v.if_else(f.net > 50000, "big", "small")), net=4)


@query("mutate_share", "select o_orderkey, round(o_totalprice/sum(o_totalprice) over (partition by o_custkey), 6) as share from orders")
def _(t):
    return rounded(t("orders") >> v.group_by(f.o_custkey) >> v.mutate(share=f.o_totalprice / v.sum_(f.o_totalprice)) >> v.ungroup() >> v.select(f.o_orderkey, f.share), share=6)


@query("case_when", "select o_orderkey, case when o_totalprice between 1000 and 100000 then 'mid' when o_totalprice > 100000 then 'high' else 'low' end as band from orders")
def _(t):
    return t("orders") >> v.transmute(o_orderkey=f.o_orderkey, band=v.case_when(v.between(f.o_totalprice, 1000, 100000), "mid", f.o_totalprice > 100000, "high", True, "low"))


@query("case_match", "select o_orderkey, case when o_orderpriority in ('1-URGENT','2-HIGH') then 'up' when o_orderpriority = '5-LOW' then 'down' else 'mid' end as level from orders")
def _(t):
    return t("orders") >> v.transmute(o_orderkey=f.o_orderkey, level=v.case_match(f.o_orderpriority, ["1-URGENT", "2-HIGH"], "up", "5-LOW", "down", _default="mid"))


@query("recode", "select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else 'other' end as st from orders")
def _(t):
    return t("orders") >> v.transmute(o_orderkey=f.o_orderkey, st=v.recode(f.o_orderstatus, F="final", O="open", _default="other"))


@query("coalesce_na_if", "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg from customer")
def _(t):
    return t("customer") >> v.transmute(c_custkey=f.c_custkey, seg=v.coalesce(v.na_if(f.c_mktsegment, "BUILDING"), "none"))


@query("select_relocate", "select n_name as name, n_regionkey, n_nationkey from nation")
def _(t):
    return t("nation") >> v.relocate(v.where(v.is_character)) >> v.select(name=f.n_name, n_regionkey=f.n_regionkey, n_nationkey=f.n_nationkey)


# ---------------------------------------------------------------- aggregates
@query("summarise", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity),2) as qty, round(avg(l_extendedprice),4) as avg_price from lineitem where l_quantity > 10 group by all")
def _(t):
    grouped = t("lineitem") >> v.filter_(f.l_quantity > 10) >> v.group_by(f.l_returnflag, f.l_linestatus)
    out = grouped >> v.summarise(n=v.n(), qty=v.sum_(f.l_quantity), avg_price=v.mean(f.l_extendedprice), _groups="drop") >> v.arrange(f.l_returnflag, f.l_linestatus)
    return rounded(out, qty=2, avg_price=4)


@query("summarise_stats", "select l_returnflag, round(stddev_samp(l_tax),8) as sd, round(var_samp(l_tax),8) as va, median(l_quantity) as med, min(l_tax) as mn, max(l_tax) as mx from lineitem group by 1")
def _(t):
    out = t("lineitem") >> v.group_by(f.l_returnflag) >> v.summarise(sd=v.sd(f.l_tax), va=v.var(f.l_tax), med=v.median(f.l_quantity), mn=v.min_(f.l_tax), mx=v.max_(f.l_tax))
    return rounded(out, sd=8, va=8)


@query("quantile", "select l_returnflag, unnest([0.25::double,0.75::double]) as prob, unnest(quantile_cont(l_quantity,[0.25,0.75])) as q from lineitem group by 1")
def _(t):
    return t("lineitem") >> v.group_by(f.l_returnflag) >> v.summarise(prob=[0.25, 0.75], q=v.quantile(f.l_quantity, [0.25, 0.75]))


@query("cov", "select l_returnflag, round(covar_samp(l_quantity, l_discount),8) as cv from lineitem group by 1")
def _(t):
    return rounded(t("lineitem") >> v.group_by(f.l_returnflag) >> v.summarise(cv=v.cov(f.l_quantity, f.l_discount)), cv=8)


@query("weighted_mean", "select l_returnflag, round(sum(l_extendedprice*l_quantity)/sum(l_quantity),4) as wm from lineitem group by 1")
def _(t):
    return rounded(t("lineitem") >> v.group_by(f.l_returnflag) >> v.summarise(wm=v.weighted_mean(f.l_extendedprice, f.l_quantity)), wm=4)


@query("n_distinct", "select l_returnflag, count(distinct l_suppkey) as nd from lineitem group by 1")
def _(t):
    return t("lineitem") >> v.group_by(f.l_returnflag) >> v.summarise(nd=v.n_distinct(f.l_suppkey))


@query("count_wt", "select o_orderpriority, round(sum(o_totalprice),2) as n from orders group by 1")
def _(t):
    return rounded(t("orders") >> v.count(f.o_orderpriority, wt=f.o_totalprice, sort=True), n=2)


@query("add_count", "select o_orderkey, count(*) over (partition by o_custkey) as n from orders")
def _(t):
    return t("orders") >> v.add_count(f.o_custkey) >> v.select(f.o_orderkey, f.n)


@query("across", "select round(avg(l_quantity),6) as l_quantity, round(avg(l_extendedprice),4) as l_extendedprice, round(avg(l_discount),8) as l_discount, round(avg(l_tax),8) as l_tax from lineitem")
def _(t):
    out = t("lineitem") >> v.summarise(v.across(v.where(v.is_double), v.mean))
    return rounded(out, l_quantity=6, l_extendedprice=4, l_discount=8, l_tax=8)


@query("first_last", "select user_id, min_by(value, event_id) as first, max_by(value, event_id) as last from events group by 1")
def _(t):
    return t("events") >> v.group_by(f.user_id) >> v.summarise(first=v.first(f.value, order_by=f.event_id), last=v.last(f.value, order_by=f.event_id))


@query("any_all", "select o_custkey, bool_or(o_totalprice > 400000) as a, bool_and(o_totalprice > 1000) as b from orders group by 1")
def _(t):
    return t("orders") >> v.group_by(f.o_custkey) >> v.summarise(a=v.any_(f.o_totalprice > 400000), b=v.all_(f.o_totalprice > 1000))


@query("if_any", "select l_orderkey, l_tax, l_discount from lineitem where l_tax > 0.07 or l_discount > 0.07")
def _(t):
    return t("lineitem") >> v.filter_(v.if_any(v.c(f.l_tax, f.l_discount), lambda x: x > 0.07)) >> v.select(f.l_orderkey, f.l_tax, f.l_discount)


@query("rowwise_pmax", "select l_orderkey, greatest(l_tax,l_discount) as mx, least(l_tax,l_discount) as mn from lineitem")
def _(t):
    return t("lineitem") >> v.rowwise() >> v.transmute(l_orderkey=f.l_orderkey, mx=v.max_(v.c_across(v.c(f.l_tax, f.l_discount))), mn=v.pmin(f.l_tax, f.l_discount))


# ---------------------------------------------------------------- distinct, joins, sets
@query("distinct", "select distinct l_returnflag, l_linestatus from lineitem")
def _(t):
    return t("lineitem") >> v.distinct(f.l_returnflag, f.l_linestatus)


@query("distinct_keep_all", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def _(t):
    return t("orders") >> v.select(f.o_custkey, f.o_orderkey, f.o_totalprice) >> v.arrange(f.o_orderkey) >> v.distinct(f.o_custkey, keep_all=True)


@query("inner_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def _(t):
    return t("orders") >> v.inner_join(t("customer"), by={"o_custkey": "c_custkey"}) >> v.select(f.o_orderkey, f.c_name)


@query("left_join", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")
def _(t):
    return t("customer") >> v.left_join(t("orders"), by={"c_custkey": "o_custkey"}) >> v.select(f.c_custkey, f.o_orderkey)


@query("right_join", "select o_custkey as c_custkey, o_orderkey, c_name from customer right join orders on o_custkey = c_custkey")
def _(t):
    return t("customer") >> v.right_join(t("orders"), by={"c_custkey": "o_custkey"}) >> v.select(f.c_custkey, f.o_orderkey, f.c_name)


@query("full_join", "select coalesce(c_custkey, s_suppkey) as k, c_name, s_name from customer full join supplier on c_custkey = s_suppkey")
def _(t):
    return t("customer") >> v.full_join(t("supplier"), by={"c_custkey": "s_suppkey"}) >> v.select(k=f.c_custkey, c_name=f.c_name, s_name=f.s_name)


@query("semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def _(t):
    return t("customer") >> v.semi_join(t("orders"), by={"c_custkey": "o_custkey"}) >> v.select(f.c_custkey)


@query("anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def _(t):
    return t("customer") >> v.anti_join(t("orders") >> v.filter_(f.o_orderpriority == "1-URGENT"), by={"c_custkey": "o_custkey"}) >> v.select(f.c_custkey)


@query("cross_join", "select r_name, n_name from region cross join nation")
def _(t):
    return t("region") >> v.cross_join(t("nation")) >> v.select(f.r_name, f.n_name)


@query("nest_join", "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1")
def _(t):
    return t("customer") >> v.nest_join(t("orders"), by={"c_custkey": "o_custkey"}, name="orders") >> v.transmute(c_custkey=f.c_custkey, n=v.lengths(f.orders))


@query("union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def _(t):
    return v.union(t("customer") >> v.select(k=f.c_nationkey), t("supplier") >> v.select(k=f.s_nationkey))


@query("intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def _(t):
    return v.intersect(t("customer") >> v.select(k=f.c_nationkey), t("supplier") >> v.select(k=f.s_nationkey))


@query("setdiff", "select p_size as k from part except select c_nationkey from customer")
def _(t):
    return v.setdiff(t("part") >> v.select(k=f.p_size), t("customer") >> v.select(k=f.c_nationkey))


@query("symdiff", "(select p_size as k from part except select c_nationkey from customer) union all (select c_nationkey from customer except select p_size from part)")
def _(t):
    return v.symdiff(t("part") >> v.select(k=f.p_size), t("customer") >> v.select(k=f.c_nationkey))


@query("bind_rows", "select '0' as src, c_custkey as k from customer union all select '1', s_suppkey from supplier")
def _(t):
    return v.bind_rows(t("customer") >> v.select(k=f.c_custkey), t("supplier") >> v.select(k=f.s_suppkey), _id="src") >> v.mutate(src=v.as_character(f.src))


@query("rows_upsert", "select n_nationkey, case when n_nationkey < 5 then 'X' else n_name end as n_name from nation")
def _(t):
    nation = t("nation") >> v.select(f.n_nationkey, f.n_name)
    return nation >> v.rows_upsert(nation >> v.filter_(f.n_nationkey < 5) >> v.mutate(n_name="X"), by="n_nationkey")


@query("rows_delete", "select n_nationkey, n_name from nation where n_nationkey >= 5")
def _(t):
    nation = t("nation") >> v.select(f.n_nationkey, f.n_name)
    return nation >> v.rows_delete(nation >> v.filter_(f.n_nationkey < 5), by="n_nationkey")


# ---------------------------------------------------------------- windows
@query("ranks", "select l_orderkey, l_linenumber, l_quantity, rank() over w as mr, dense_rank() over w as dr, percent_rank() over w as pr, cume_dist() over w as cd from lineitem window w as (partition by l_returnflag order by l_quantity)")
def _(t):
    ranked = t("lineitem") >> v.group_by(f.l_returnflag) >> v.mutate(mr=v.min_rank(f.l_quantity), dr=v.dense_rank(f.l_quantity), pr=v.percent_rank(f.l_quantity), cd=v.cume_dist(f.l_quantity))
    return ranked >> v.ungroup() >> v.select(f.l_orderkey, f.l_linenumber, f.l_quantity, f.mr, f.dr, f.pr, f.cd)


@query("row_number_ntile", "select event_id, row_number() over w as rn, ntile(4) over w as nt from events window w as (partition by event_type order by event_id)")
def _(t):
    return t("events") >> v.group_by(f.event_type) >> v.mutate(rn=v.row_number(f.event_id), nt=v.ntile(f.event_id, n=4)) >> v.ungroup() >> v.select(f.event_id, f.rn, f.nt)


@query("lead_lag", "select event_id, lag(value) over w as pv, lead(value, 2, 0.0) over w as nv from events window w as (partition by user_id order by event_id)")
def _(t):
    return t("events") >> v.group_by(f.user_id) >> v.mutate(pv=v.lag(f.value, order_by=f.event_id), nv=v.lead(f.value, 2, default=0.0, order_by=f.event_id)) >> v.ungroup() >> v.select(f.event_id, f.pv, f.nv)


@query("cumulative", "select event_id, round(sum(value) over w,6) as cs, max(value) over w as cm, bool_and(value < 50) over w as ca from events window w as (partition by user_id order by event_id rows unbounded preceding)")
def _(t):
    out = t("events") >> v.arrange(f.event_id) >> v.group_by(f.user_id) >> v.mutate(cs=v.cumsum(f.value), cm=v.cummax(f.value), ca=v.cumall(f.value < 50))
    return rounded(out >> v.ungroup() >> v.select(f.event_id, f.cs, f.cm, f.ca), cs=6)


@query(
    "consecutive_id",
    "select event_id, (1 + sum(ch) over (partition by user_id order by event_id rows unbounded preceding))::bigint as cid from (select event_id, user_id, case when event_type is distinct from lag(event_type) over w and row_number() over w > 1 then 1 else 0 end as ch from events window w as (partition by user_id order by event_id))",
)
def _(t):
    return t("events") >> v.arrange(f.event_id) >> v.group_by(f.user_id) >> v.mutate(cid=v.consecutive_id(f.event_type)) >> v.ungroup() >> v.select(f.event_id, f.cid)


@query("fill", "select event_id, last_value(v ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as v from (select *, nullif(event_type,'error') as v from events)")
def _(t):
    return t("events") >> v.arrange(f.event_id) >> v.mutate(v=v.na_if(f.event_type, "error")) >> v.group_by(f.user_id) >> v.fill(f.v) >> v.ungroup() >> v.select(f.event_id, f.v)


@query("slice_max", "select p_brand, p_partkey, p_retailprice from part qualify rank() over (partition by p_brand order by p_retailprice desc) <= 2")
def _(t):
    return t("part") >> v.group_by(f.p_brand) >> v.slice_max(f.p_retailprice, n=2) >> v.ungroup() >> v.select(f.p_brand, f.p_partkey, f.p_retailprice)


@query("slice_head_grouped", "select event_id, user_id from events qualify row_number() over (partition by user_id order by event_id) <= 3")
def _(t):
    return t("events") >> v.select(f.event_id, f.user_id) >> v.arrange(f.event_id) >> v.group_by(f.user_id) >> v.slice_head(n=3)


@query("arrange_head", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def _(t):
    return t("orders") >> v.select(f.o_orderkey, f.o_totalprice) >> v.arrange(v.desc(f.o_totalprice), f.o_orderkey) >> v.head(10)


@query("duplicated", "select event_id, row_number() over (partition by user_id order by event_id) > 1 as dup from events")
def _(t):
    return t("events") >> v.arrange(f.event_id) >> v.transmute(event_id=f.event_id, dup=v.duplicated(f.user_id))


@query("scale", "select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over w) / stddev_samp(l_quantity) over w, 6) as z from lineitem window w as (partition by l_suppkey)")
def _(t):
    out = t("lineitem") >> v.group_by(f.l_suppkey) >> v.mutate(z=v.scale(f.l_quantity)) >> v.ungroup() >> v.select(f.l_orderkey, f.l_linenumber, f.z)
    return rounded(out, z=6)


# ---------------------------------------------------------------- reshaping
@query("pivot_longer", "unpivot (select event_id, value, cast(user_id as double) as uid from events) on value, uid into name name value val")
def _(t):
    wide = t("events") >> v.transmute(event_id=f.event_id, value=f.value, uid=v.as_double(f.user_id))
    return wide >> v.pivot_longer(v.c(f.value, f.uid), names_to="name", values_to="val")


@query("pivot_wider", "select user_id, avg(value) filter (event_type='click') as click, avg(value) filter (event_type='view') as view from events group by 1")
def _(t):
    out = t("events") >> v.select(f.user_id, f.event_type, f.value) >> v.pivot_wider(id_cols=f.user_id, names_from=f.event_type, values_from=f.value, values_fn=v.mean)
    return out >> v.select(f.user_id, f.click, f.view)


@query("unite_separate", "select p_partkey, split_part(p_name,' ',1) as a, split_part(p_name,' ',2) as b from part")
def _(t):
    return t("part") >> v.select(f.p_partkey, f.p_name) >> v.separate(f.p_name, ["a", "b"], sep=" ", extra="drop") >> v.unite("u", f.a, f.b, sep="\t") >> v.separate(f.u, ["a", "b"], sep="\t")


@query("extract", "select p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]+)', 1) as word, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]+)', 2) as num from part where regexp_matches(p_brand, '([A-Za-z]+)#?([0-9]+)')")
def _(t):
    return t("part") >> v.select(f.p_partkey, f.p_brand) >> v.extract(f.p_brand, ["word", "num"], regex="([A-Za-z]+)#?([0-9]+)") >> v.drop_na()


@query("separate_rows", "select p_partkey, unnest(string_split(p_name,' ')) as w from part")
def _(t):
    return t("part") >> v.select(p_partkey=f.p_partkey, w=f.p_name) >> v.separate_rows(f.w, sep=" ")


@query("uncount", "select p_partkey, unnest(range(p_size)) as id from part where p_size <= 5")
def _(t):
    return t("part") >> v.select(f.p_partkey, f.p_size) >> v.filter_(f.p_size <= 5) >> v.uncount(f.p_size, _id="id")


@query("complete", "select a.r, b.s, coalesce(c.n,0) as n from (select distinct l_returnflag r from lineitem) a cross join (select distinct l_linestatus s from lineitem) b left join (select l_returnflag, l_linestatus, count(*) n from lineitem group by all) c on a.r=c.l_returnflag and b.s=c.l_linestatus")
def _(t):
    return t("lineitem") >> v.count(r=f.l_returnflag, s=f.l_linestatus) >> v.complete(f.r, f.s, fill={"n": 0})


@query("expand_nesting", "select distinct l_returnflag, l_linestatus from lineitem")
def _(t):
    return t("lineitem") >> v.expand(v.nesting(f.l_returnflag, f.l_linestatus))


@query("nest_chop", "select o_custkey, o_orderkey from orders")
def _(t):
    return t("orders") >> v.select(f.o_custkey, f.o_orderkey) >> v.chop(f.o_orderkey) >> v.unchop(f.o_orderkey)


@query("nest_unnest", "select c_nationkey, c_custkey, c_name from customer")
def _(t):
    return t("customer") >> v.select(f.c_nationkey, f.c_custkey, f.c_name) >> v.nest(data=v.c(f.c_custkey, f.c_name)) >> v.unnest(f.data)


@query("pack_unpack", "select n_nationkey, n_name as p_n_name, n_regionkey as p_n_regionkey from nation")
def _(t):
    return t("nation") >> v.pack(p=v.c(f.n_name, f.n_regionkey)) >> v.unpack(f.p, names_sep="_")


# ---------------------------------------------------------------- scalars
@query("strings", "select p_partkey, upper(p_name) as u, regexp_replace(p_name,'[aeiou]','_','g') as g, regexp_replace(p_name,'[aeiou]','_') as s, concat_ws('-',p_brand,p_type) as p, length(p_name) as n, substr(p_name, 2, 3) as sub, translate(p_name, 'abc', 'xyz') as tr from part")
def _(t):
    return t("part") >> v.transmute(
        p_partkey=f.p_partkey, u=v.toupper(f.p_name), g=v.gsub("[aeiou]", "_", f.p_name), s=v.sub("[aeiou]", "_", f.p_name), p=v.paste(f.p_brand, f.p_type, sep="-"), n=v.nchar(f.p_name), sub=v.substr(f.p_name, 1, 4), tr=v.chartr("abc", "xyz", f.p_name)
    )


@query("grepl", "select p_partkey from part where regexp_matches(p_name,'^s.*g$') or starts_with(p_type,'ECO')")
def _(t):
    return t("part") >> v.filter_(v.grepl("^s.*g$", f.p_name) | v.startswith(f.p_type, "ECO")) >> v.select(f.p_partkey)


@query("math", "select l_orderkey, l_linenumber, round(ln(l_extendedprice),6) as lg, round(sqrt(l_quantity),6) as sq, floor(l_tax*100)::bigint as fl, round(sin(l_quantity),6) as sn, round(exp(l_discount),6) as ex, round(lgamma(l_quantity),6) as lgam from lineitem")
def _(t):
    out = t("lineitem") >> v.transmute(l_orderkey=f.l_orderkey, l_linenumber=f.l_linenumber, lg=v.log(f.l_extendedprice), sq=v.sqrt(f.l_quantity), fl=v.floor(f.l_tax * 100), sn=v.sin(f.l_quantity), ex=v.exp(f.l_discount), lgam=v.lgamma(f.l_quantity))
    return rounded(out, lg=6, sq=6, sn=6, ex=6, lgam=6)


@query("round_even", "select l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) as r from lineitem")
def _(t):
    return t("lineitem") >> v.transmute(l_orderkey=f.l_orderkey, l_linenumber=f.l_linenumber, r=v.round_(f.l_quantity / 2))


@query("cut", "select p_partkey, case when p_size > 0 and p_size <= 10 then '(0,10]' when p_size > 10 and p_size <= 50 then '(10,50]' end as b from part")
def _(t):
    return t("part") >> v.transmute(p_partkey=f.p_partkey, b=v.cut(f.p_size, [0, 10, 50]))


@query("as_date", "select o_orderkey, cast(o_orderdate as date) as d, cast(trunc(o_totalprice) as bigint) as i from orders")
def _(t):
    return t("orders") >> v.transmute(o_orderkey=f.o_orderkey, d=v.as_date(f.o_orderdate), i=v.as_integer(f.o_totalprice))


# ---------------------------------------------------------------- factors
@query("fct_lump", "select case when event_type in (select event_type from events group by 1 order by count(*) desc limit 2) then event_type else 'Other' end as f, count(*) as n from events group by 1")
def _(t):
    return t("events") >> v.mutate(f=v.fct_lump_n(f.event_type, 2)) >> v.count(f.f)


@query("fct_infreq", "select event_type, row_number() over (order by n desc, event_type) - 1 as code from (select event_type, count(*) n from events group by 1)")
def _(t):
    return t("events") >> v.mutate(event_type=v.fct_infreq(f.event_type)) >> v.transmute(event_type=f.event_type, code=v.as_integer(f.event_type)) >> v.distinct(f.event_type, f.code)


@query("table", "select l_returnflag, count(*) filter (l_linestatus='F') as \"F\", count(*) filter (l_linestatus='O') as \"O\" from lineitem group by 1")
def _(t):
    return v.table(t("lineitem"), f.l_returnflag, f.l_linestatus)


# ---------------------------------------------------------------- group functions and sampling
@query("group_modify", "select o_orderstatus, max(o_totalprice) as top from orders group by 1")
def _(t):
    orders = t("orders") >> v.select(f.o_orderstatus, f.o_totalprice) >> v.group_by(f.o_orderstatus)
    return orders >> v.group_modify(lambda rows: rows[["o_totalprice"]].max().to_frame().T.rename(columns={"o_totalprice": "top"}), _schema="top double")


# the queries of single functions register themselves
from verbena.plans import function_queries, window_queries  # noqa: E402

__all__ = ["ORACLE_SQL", "QUERIES", "function_queries", "window_queries"]
