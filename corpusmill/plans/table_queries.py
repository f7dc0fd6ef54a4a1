"""Queries that join, reshape and stream tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators import network as N
from corpusmill.operators import reshape as R
from corpusmill.operators import scoring as S
from corpusmill.operators import stats
from corpusmill.plans.common import table
from corpusmill.plans.registry import query
from corpusmill.streaming import ingest


@query("left_join_labels", "select doc_id, source, quality from documents left join labels using (doc_id)")
def left_join_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "quality")


@query("reproduction_check", "with a as (select l_orderkey as k, sum(l_quantity) as x from lineitem group by 1), b as (select o_orderkey as k, o_totalprice as y from orders where o_orderkey % 10 <> 0) select count(*) as n, count(*) filter (a.k is null) as only_right, count(*) filter (b.k is null) as only_left, round(max(abs(x - y)), 4) as max_abs_diff from a full join b on a.k = b.k")
def reproduction_check(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("x"))
    b = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("y"))
    return R.compare(a, b, "k", "x", "y").withColumn("max_abs_diff", F.round("max_abs_diff", 4))


@query("semi_join_pairs", "select distinct l_partkey, l_suppkey from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT')")
def semi_join_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey", "left_semi").select("l_partkey", "l_suppkey").distinct()


@query("config_grid", "select m as model, w as window, case w when 'full' then 1024 - case when m like 'masked%' then 2 else 0 end else try_cast(w as int) end as tokens from (values ('masked-a'), ('causal-b'), ('masked-c')) a(m), (values ('8'), ('64'), ('full')) b(w)")
def config_grid(spark, sf_dir):
    m = spark.createDataFrame([("masked-a",), ("causal-b",), ("masked-c",)], "model string")
    w = spark.createDataFrame([("8",), ("64",), ("full",)], "window string")
    return m.crossJoin(F.broadcast(w)).withColumn("tokens", S.window_tokens(F.col("window"), F.lit(1024), F.startswith("model", F.lit("masked"))))


@query("group_replay", "select g.model, d.lang, d.docs from (select lang, count(*) as docs, case when lang = 'en' then 'A' else 'B' end as grp from documents group by 1) d join (values ('m1','A'), ('m2','A'), ('m3','B')) g(model, grp) using (grp)")
def group_replay(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs")).withColumn("grp", F.when(F.col("lang") == "en", "A").otherwise("B"))
    g = spark.createDataFrame([("m1", "A"), ("m2", "A"), ("m3", "B")], "model string, grp string")
    return d.join(F.broadcast(g), "grp").select("model", "lang", "docs")


@query("pivot_wide", "select o_orderpriority, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as \"F\", round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as \"O\", round(avg(o_totalprice) filter (o_orderstatus = 'P'), 4) as \"P\" from orders group by 1")
def pivot_wide(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))
    return p


@query("pivot_long", "select l_orderkey, l_linenumber, unnest(['discount', 'tax']) as policy, unnest([l_discount, l_tax]) as bits from lineitem")
def pivot_long(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "policy", "bits")


@query("union_backfill", "select c_custkey as key, c_mktsegment as segment, c_acctbal as balance from customer union all select s_suppkey, null, s_acctbal from supplier")
def union_backfill(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("keep_first", "select l_orderkey, l_partkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) r from lineitem) where r = 1")
def keep_first(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query("set_difference", "select n_nationkey as k from nation except select c_nationkey from customer where c_acctbal < 0")
def set_difference(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return a.subtract(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_nationkey"))


@query("set_intersection", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("split_unite", "select c_custkey, c_mktsegment || '/' || c_nationkey as config, split_part(c_name, '#', 2) as number from customer")
def split_unite(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("config"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("number"))


@query("reindex_complete", "select p_brand, s as size, coalesce(n, 0) as n from (select distinct p_brand from part) b cross join unnest(range(1, 6)) t(s) left join (select p_brand, p_size, count(*) n from part group by 1, 2) c on c.p_brand = b.p_brand and c.p_size = s".replace("select p_brand, s as", "select b.p_brand, s::int as"))
def reindex_complete(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    domain = p.select("p_brand").distinct().withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(5))))
    counts = p.groupBy("p_brand", F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    return R.reindex(counts, domain, ["p_brand", "size"], {"n": 0})


@query("cumulative_cut", "with c as (select p_size, count(*) as n, sum(count(*)) over (order by p_size) / sum(count(*)) over () as share from part group by 1), r as (select *, row_number() over (order by abs(share - 1/3.0), p_size) as a, row_number() over (order by abs(share - 2/3.0), p_size) as b from c) select max(p_size) filter (a = 1) as low, max(p_size) filter (b = 1) as high from r")
def cumulative_cut(spark, sf_dir):
    return R.third_cuts(table(spark, sf_dir, "part"), "p_size")


@query("coverage_half", "with t as (select p_brand, count(*) as n from part group by 1), r as (select *, row_number() over (order by n desc, p_brand) as pos, sum(n) over (order by n desc, p_brand) as cum from t) select min(pos) as needed from r where cum >= (select sum(n) from t) / 2")
def coverage_half(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return R.coverage(n, "p_brand", "n", 0.5).select(F.col("needed").cast("long").alias("needed"))


@query("top_n_per_group", "select c_mktsegment, c_custkey, rank::int as rank from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 5")
def top_n_per_group(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("value_counts", "select event_type, count(*) as n, round(count(*) / (select count(*) from events), 6) as share from events group by 1")
def value_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(e.agg(F.count("*").alias("t")))).select("event_type", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("cube_means", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_discount::decimal(12, 4))::double / count(*), 8) as mean from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_means(spark, sf_dir):
    total = F.sum(F.col("l_discount").cast("decimal(12, 4)")).cast("double")  # exact, so no order of rows moves a digit
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(total / F.count("*"), 8).alias("mean"))


@query("selection_rule", "with c as (select c_mktsegment as cls, n_name as model, avg(c_acctbal) as r from customer join nation on c_nationkey = n_nationkey group by 1, 2), b as (select cls from c group by 1 order by avg(abs(r)) desc, cls limit 1) select cls, model from c semi join b using (cls) order by length(model), model limit 1")
def selection_rule(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("cls"), F.col("n_name").alias("model")).agg(F.avg("c_acctbal").alias("r"))
    best = c.groupBy("cls").agg(F.avg(F.abs("r")).alias("m")).orderBy(F.desc("m"), "cls").limit(1)
    return c.join(best, "cls", "left_semi").orderBy(F.length("model"), "model").select("cls", "model").limit(1)


@query("node_strength", "with e as (select s_nationkey as a, n_regionkey as b, s_acctbal / 10000 as w from supplier join nation on s_nationkey = n_nationkey), u as (select 'n' || a as node, w from e union all select 'r' || b, w from e) select node, round(sum(abs(w)), 6) as strength, round(sum(w), 6) as influence from u group by 1")
def node_strength(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    e = s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("b"), (F.col("s_acctbal") / 10000).alias("w"))
    return N.strength(e).select("node", F.round("strength", 6).alias("strength"), F.round("influence", 6).alias("influence"))


@query("correlation_network")
def correlation_network(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return N.network(spark, N.spearman_matrix(li), li.count()).select("a", "b", F.round("w", 4).alias("w"))


@query("relative_importance")
def relative_importance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return N.relative_importance(spark, N.spearman_matrix(li), "l_extendedprice").select("variable", F.round("lmg", 6).alias("lmg"), F.round("last", 6).alias("last"))


@query("nmf_loadings")
def nmf_loadings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("x"))
    return N.nmf_transform(e, "vec_id", "x", N.nmf_fit(e, "x", 4), keep=1)


@query("spearman_matrix", "with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part) select 'p_size' as a, 'p_retailprice' as b, round(corr(a, b), 6) as rho from r")
def spearman_matrix(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_size", "p_retailprice")
    s = stats.spearman(p.withColumn("all", F.lit(1)), "p_size", "p_retailprice", "all")
    return s.select(F.lit("p_size").alias("a"), F.lit("p_retailprice").alias("b"), F.round("rho", 6).alias("rho"))


@query("events_incremental", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def events_incremental(spark, sf_dir):
    """Files taken one at a time from a stream, keyed appends made once, and the counts of what was taken."""
    taken = ingest.ingest_once(spark, f"{sf_dir}/events.parquet", ["event_id"])
    return taken.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows: beyond what is asked, as the same call serves streams."""
    w = ingest.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type")
    return w.select("start", "event_type", "n")
