"""Queries of statistics, on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators import features as E
from corpusmill.operators import stats as S
from corpusmill.plans.common import table
from corpusmill.plans.registry import query

_SQL_CUST = "oc as (select o.*, c_mktsegment, c_acctbal, n_name from orders o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"


def _orders(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


@query("pearson_by_config", "select l_returnflag, l_linestatus, count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r, round(corr(l_discount, l_tax), 6) as r2 from lineitem group by 1, 2")
def pearson_by_config(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(S.pearson("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(S.pearson("l_discount", "l_tax"), 6).alias("r2"))


_SQL_RANK = "rank() over (partition by {g} order by {x}) + (count(*) over (partition by {g}, {x}) - 1) / 2.0"


@query("spearman_by_flag", f"with r as (select l_returnflag, {_SQL_RANK.format(g='l_returnflag', x='l_quantity')} as a, {_SQL_RANK.format(g='l_returnflag', x='l_extendedprice')} as b from lineitem) select l_returnflag, count(*) as n, round(corr(a, b), 6) as rho from r group by 1")
def spearman_by_flag(spark, sf_dir):
    return S.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").withColumn("rho", F.round("rho", 6))


@query("spearman_within", f"with {_SQL_CUST}, r as (select c_mktsegment, {_SQL_RANK.format(g='c_mktsegment', x='o_totalprice')} as a, {_SQL_RANK.format(g='c_mktsegment', x='c_acctbal')} as b from oc), s as (select c_mktsegment, count(*) as n, corr(a, b) as rho from r group by 1) select round(sum(rho * n) / sum(n), 6) as rho from s")
def spearman_within(spark, sf_dir):
    per = S.spearman(_orders(spark, sf_dir), "o_totalprice", "c_acctbal", "c_mktsegment")
    return S.size_weighted(per, "rho", "n").withColumn("rho", F.round("rho", 6))


@query("partial_corr", "with c as (select corr(l_quantity, l_extendedprice) xy, corr(l_quantity, l_discount) xz, corr(l_extendedprice, l_discount) yz from lineitem) select round((xy - xz*yz) / sqrt((1 - xz*xz) * (1 - yz*yz)), 6) as r from c")
def partial_corr(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").agg(S.pearson("l_quantity", "l_extendedprice").alias("xy"), S.pearson("l_quantity", "l_discount").alias("xz"), S.pearson("l_extendedprice", "l_discount").alias("yz"))
    return c.select(F.round(S.partial_r(F.col("xy"), F.col("xz"), F.col("yz")), 6).alias("r"))


_SQL_D = f"""with {_SQL_CUST}, k as (select o_orderpriority as st, n_name as g, count(*) n, sum(o_totalprice) s, sum(o_totalprice * o_totalprice) q from oc group by 1, 2),
m as (select *, sum(n) over w - n as n2, sum(s) over w - s as s2, sum(q) over w - q as q2 from k window w as (partition by st)),
d as (select st, g, n, (s/n - s2/n2) / sqrt(((q - s*s/n) + (q2 - s2*s2/n2)) / (n + n2 - 2)) as d from m where n >= 2 and n2 >= 2), e as (select g as n_name, sum(d*n)/sum(n) as d from d group by 1)"""


def _d(spark, sf_dir):
    return S.weighted_d(_orders(spark, sf_dir), "o_totalprice", "o_orderpriority", "n_name")


@query("weighted_cohens_d", _SQL_D + " select n_name, round(d, 6) as d from e")
def weighted_cohens_d(spark, sf_dir):
    return _d(spark, sf_dir).select("n_name", F.round("d", 6).alias("d"))


@query("fairness_flags", _SQL_D + " select round(max(abs(d)), 6) as max_d, (select n_name from e order by abs(d) desc, n_name limit 1) as worst, count(*) filter (abs(d) >= 0.02) as flagged from e")
def fairness_flags(spark, sf_dir):
    return S.fairness(_d(spark, sf_dir), "n_name", [], 0.02).withColumn("max_d", F.round("max_d", 6))


@query("pareto_front", "with p as (select c_mktsegment || '/' || n_name as config, round(avg(c_acctbal), 4) as high, round(stddev_samp(c_acctbal), 4) as low from customer join nation on c_nationkey = n_nationkey group by 1) select config, high, low from p where not exists (select 1 from p o where o.high >= p.high and o.low <= p.low and (o.high > p.high or o.low < p.low)) and high is not null and low is not null")
def pareto_front(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.groupBy(F.concat_ws("/", "c_mktsegment", "n_name").alias("config")).agg(F.round(F.avg("c_acctbal"), 4).alias("high"), F.round(F.stddev_samp("c_acctbal"), 4).alias("low"))
    return S.pareto_front(p.where("high is not null and low is not null"), "config", "high", "low")


@query("residualize_group_mean", "select p_partkey, round(p_retailprice - avg(p_retailprice) over (partition by p_brand), 6) as residual from part")
def residualize_group_mean(spark, sf_dir):
    return S.residualize(table(spark, sf_dir, "part"), "p_retailprice", "p_brand").select("p_partkey", F.round("residual", 6).alias("residual"))


@query("factor_r2", "with l as (select p_brand, unnest(['size', 'price']) as variable, unnest([p_size::double, p_retailprice]) as x from part), g as (select *, avg(x) over (partition by variable, p_brand) as m, avg(x) over (partition by variable) as t from l) select variable, round(1 - sum((x-m)*(x-m)) / sum((x-t)*(x-t)), 6) as r2 from g group by 1")
def factor_r2(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return S.factor_r2(p, ["size", "price"], "p_brand").withColumn("r2", F.round("r2", 6))


_SQL_P = "p as (select p_brand, (p_partkey * 7919 % 1000 + 0.5) / 1000.0 * (p_partkey % 10 + 1) / 10.0 as p, p_partkey from part)"


def _p(spark, sf_dir):
    p = (F.col("p_partkey") * 7919 % 1000 + F.lit(0.5)) / F.lit(1000.0) * (F.col("p_partkey") % 10 + 1) / F.lit(10.0)
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", p.cast("double").alias("p"))


@query("bh_adjust", f"with {_SQL_P}, r as (select *, row_number() over (partition by p_brand order by p) as r, count(*) over (partition by p_brand) as n from p) select p_brand, p_partkey, round(least(1, min(p * n / r) over (partition by p_brand order by r desc)), 6)::double as bh from r")
def bh_adjust(spark, sf_dir):
    return S.bh_adjust(_p(spark, sf_dir), "p", "p_brand").select("p_brand", "p_partkey", F.round("bh", 6).alias("bh"))


@query("holm_adjust", f"with {_SQL_P}, r as (select *, row_number() over (partition by p_brand order by p) as r, count(*) over (partition by p_brand) as n from p) select p_brand, p_partkey, round(least(1, max((n - r + 1) * p) over (partition by p_brand order by r)), 6)::double as holm from r")
def holm_adjust(spark, sf_dir):
    return S.holm_adjust(_p(spark, sf_dir), "p", "p_brand").select("p_brand", "p_partkey", F.round("holm", 6).alias("holm"))


_Z = "1.959963984540054"


@query("zou_interval", f"""with c as (select l_returnflag, count(*) n, corr(l_quantity, l_extendedprice) r1, corr(l_discount, l_extendedprice) r2, corr(l_quantity, l_discount) r12 from lineitem group by 1),
f as (select *, tanh(atanh(r1) - {_Z}/sqrt(n-3)) l1, tanh(atanh(r1) + {_Z}/sqrt(n-3)) u1, tanh(atanh(r2) - {_Z}/sqrt(n-3)) l2, tanh(atanh(r2) + {_Z}/sqrt(n-3)) u2, ((r12 - 0.5*r1*r2)*(1 - r1*r1 - r2*r2 - r12*r12) + r12*r12*r12) / ((1 - r1*r1)*(1 - r2*r2)) k from c)
select l_returnflag, round(r1 - r2 - sqrt(greatest(0, (r1-l1)*(r1-l1) + (u2-r2)*(u2-r2) - 2*k*(r1-l1)*(u2-r2))), 6) as low, round(r1 - r2 + sqrt(greatest(0, (u1-r1)*(u1-r1) + (r2-l2)*(r2-l2) - 2*k*(u1-r1)*(r2-l2))), 6) as high from f""")
def zou_interval(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), S.pearson("l_quantity", "l_extendedprice").alias("r1"), S.pearson("l_discount", "l_extendedprice").alias("r2"), S.pearson("l_quantity", "l_discount").alias("r12"))
    low, high = S.zou_interval(F.col("r1"), F.col("r2"), F.col("r12"), F.col("n"))
    return c.select("l_returnflag", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_TYPES = ("click", "view", "purchase", "signup", "error")


@query("crosstab_rates", "select user_id, " + ", ".join(f"round(count(*) filter (event_type = '{t}') / count(*), 6) as \"{t}\"" for t in _TYPES) + " from events group by 1")
def crosstab_rates(spark, sf_dir):
    r = S.crosstab_rates(table(spark, sf_dir, "events"), "user_id", "event_type", list(_TYPES))
    return r.select("user_id", *[F.round(t, 6).alias(t) for t in _TYPES])


@query("cell_table", "select o_orderpriority, count(*) as n, round(avg((o_orderstatus = 'O')::int), 6) as share_open, round(count(*) filter (o_orderstatus = 'F') / (select count(*) from orders where o_orderstatus = 'F'), 6) as share_of_f from orders group by 1")
def cell_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "O").cast("int")), 6).alias("share_open"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    total = o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("t"))
    return c.crossJoin(F.broadcast(total)).select("o_orderpriority", "n", "share_open", F.round(F.try_divide("f", "t"), 6).alias("share_of_f"))


@query("argmax_per_group", "select c_mktsegment, c_custkey, c_acctbal from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) r from customer) where r = 1")
def argmax_per_group(spark, sf_dir):
    return S.argmax_rows(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], "c_acctbal", "c_custkey")


@query("share_within_group", "select l_returnflag, l_linestatus, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_returnflag), 6) as share from lineitem group by 1, 2")
def share_within_group(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 6))


@query("qcut_bands", "with r as (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) - 1 as r, count(*) over (partition by c_mktsegment) - 1 as n from customer) select c_custkey, case when 3*r < n then 0 when 3*r < 2*n then 1 else 2 end as band from r")
def qcut_bands(spark, sf_dir):
    return S.qcut(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", 3, "c_mktsegment").select("c_custkey", "band")


@query("cut_bands", "select case when n_chars < 0 then null when n_chars < 1000 then 'short' when n_chars < 3000 then 'middle' when n_chars < 1000000 then 'long' end as band, count(*) as n, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars) / sqrt(count(*)), 6) as se, median(n_chars) as median from documents group by 1")
def cut_bands(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    band = S.cut(F.col("n_chars"), [0, 1000, 3000, 1_000_000], ["short", "middle", "long"])
    return d.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars") / F.sqrt(F.count("*")), 6).alias("se"), F.median("n_chars").alias("median"))


@query("quantiles", "select l_returnflag, quantile_cont(l_extendedprice, 0.05) as p5, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.95) as p95 from lineitem group by 1")
def quantiles(spark, sf_dir):
    p = lambda q: F.percentile("l_extendedprice", q)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("describe", "select l_returnflag, count(l_tax) as n, round(avg(l_tax), 6) as mean, round(stddev_samp(l_tax), 6) as sd, min(l_tax) as least, max(l_tax) as most from lineitem group by 1")
def describe(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("l_tax").alias("n"), F.round(F.avg("l_tax"), 6).alias("mean"), F.round(F.stddev_samp("l_tax"), 6).alias("sd"), F.min("l_tax").alias("least"), F.max("l_tax").alias("most"))


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = S.bootstrap_mean(c, "c_custkey", "c_acctbal", ["c_mktsegment"], 200)
    return b.select("c_mktsegment", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_SQL_E = "e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings)"


@query("vector_mean", f"with {_SQL_E} select label, dim, round(avg(x), 6) as mean from e group by 1, 2")
def vector_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("vector_between_r2", f"with {_SQL_E}, g as (select x, avg(x) over (partition by dim, label) as m, avg(x) over (partition by dim) as t from e) select round(sum((m-t)*(m-t)) / sum((x-t)*(x-t)), 6) as r2 from g")
def vector_between_r2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    cells = e.groupBy("dim", "label").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = cells.groupBy("dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("t"))
    c = cells.join(F.broadcast(total), "dim")
    b, w = F.sum(F.col("n") * F.pow(F.col("m") - F.col("t"), F.lit(2))), F.sum(F.col("n") * F.col("v"))
    return c.agg(F.round(F.try_divide(b, b + w), 6).alias("r2"))


@query("adjacent_cosine", "with p as (select vec_id, embedding as a, lead(embedding) over (partition by label order by vec_id) as b from embeddings) select vec_id, round(list_cosine_similarity(list_transform(a, lambda x: x::double), list_transform(b, lambda x: x::double)), 6) as cosine from p where b is not null")
def adjacent_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("next is not null")
    return e.select("vec_id", F.round(E.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("trace_covariance", f"with {_SQL_E} select label, round(sum(v), 6) as trace from (select label, dim, var_samp(x) as v from e group by 1, 2) group by 1")
def trace_covariance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    v = e.groupBy("label", "dim").agg(F.var_samp(F.col("x").cast("double")).alias("v"))
    return v.groupBy("label").agg(F.round(F.sum("v"), 6).alias("trace"))
