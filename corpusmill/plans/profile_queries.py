"""Queries on profiles, alignment, policies and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators import features as E
from corpusmill.operators import poisson_draws as B
from corpusmill.operators import profiles as P
from corpusmill.operators import stats as S
from corpusmill.operators import tokens as K
from corpusmill.plans.common import SQL_TOKS, WORD, table
from corpusmill.plans.registry import query


def _six(*names):
    return [F.round(n, 6).alias(n) for n in names]


# Lines of an order stand for a text's tokens: quantities over 40 for high surprisal, returned ones for errors.
_SQL_TOKENS = """t as (select l_orderkey as k, o_orderpriority as level, l_quantity as x, l_discount as y, l_quantity >= 40 as high, l_returnflag = 'R' as err,
  coalesce(lag(l_returnflag = 'R') over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice), false) as post from lineitem join orders on l_orderkey = o_orderkey)"""


def _tokens(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("level"))
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    err = F.col("l_returnflag") == "R"
    return li.select(F.col("l_orderkey").alias("k"), "level", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), (F.col("l_quantity") >= 40).alias("high"), err.alias("err"), F.coalesce(F.lag(err).over(w), F.lit(False)).alias("post"))


@query("conditional_rates", f"""with {_SQL_TOKENS} select k, count(*) as n, round(avg(high::int), 6) as high, round(avg(err::int), 6) as err, round(avg(err::int) filter (high), 6) as err_of_high,
round(avg(post::int) filter (high), 6) as post_of_high, round(avg(high::int) filter (err), 6) as high_of_err from t group by 1""")
def conditional_rates(spark, sf_dir):
    r = P.conditional_rates(_tokens(spark, sf_dir), "k", F.col("high"), F.col("err"), F.col("post"))
    return r.select("k", "n", *_six("high", "err", "err_of_high", "post_of_high", "high_of_err"))


@query("threshold_table", f"with {_SQL_TOKENS} select level, count(*) as n, round(avg(err::int) filter (high), 6) as p_err_high, round(avg(err::int) filter (not high), 6) as p_err_low, round(avg(high::int) filter (err), 6) as p_high_err, round(avg(high::int) filter (not err), 6) as p_high_ok from t group by 1")
def threshold_table(spark, sf_dir):
    r = P.threshold_table(_tokens(spark, sf_dir), "level", F.col("high"), F.col("err"))
    return r.select("level", "n", *_six("p_err_high", "p_err_low", "p_high_err", "p_high_ok"))


@query("level_rates", f"with {_SQL_TOKENS}, e as (select k, level, avg(err::int) as r from t group by 1, 2) select level, left(level, 1)::int as place, round(1000 * avg(r), 5) as per_1000 from e group by 1")
def level_rates(spark, sf_dir):
    e = _tokens(spark, sf_dir).groupBy("k", "level").agg(F.avg(F.col("err").cast("int")).alias("r"))
    return e.groupBy("level").agg(F.round(1000 * F.avg("r"), 5).alias("per_1000")).withColumn("place", F.substring("level", 1, 1).cast("int"))


@query("truncation_rate", "select source, round(avg((n_chars > 2000)::int), 6) as truncated from documents group by 1")
def truncation_rate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg((F.col("n_chars") > 2000).cast("int")), 6).alias("truncated"))


@query("form_gap", f"""with {SQL_TOKS}, o as (select *, row_number() over (partition by doc_id, tok order by i) as occurrence from toks where tok in ('the', 'of')),
f as (select doc_id % 3 as win, case tok when 'the' then 'target' else 'standard' end as form, i % 97 as score from o where not (tok = 'the' and occurrence = 1)),
g as (select win, avg(score) filter (form = 'target') as target, avg(score) filter (form = 'standard') as standard from f group by 1)
select win, round(target, 6) as target, round(standard, 6) as standard, round(target - standard, 6) as gap, round(target - standard - lag(target - standard) over (order by win), 6) as change from g""")
def form_gap(spark, sf_dir):
    t = K.tokens(table(spark, sf_dir, "documents")).where(F.col("tok").isin("the", "of"))
    o = t.withColumn("occurrence", F.row_number().over(Window.partitionBy("doc_id", "tok").orderBy("i")))
    f = o.where("not (tok = 'the' and occurrence = 1)").select((F.col("doc_id") % 3).alias("win"), F.when(F.col("tok") == "the", "target").otherwise("standard").alias("form"), (F.col("i") % 97).alias("score"))
    g = f.groupBy("win").pivot("form", ["target", "standard"]).agg(F.avg("score")).withColumn("gap", F.col("target") - F.col("standard"))
    g = g.withColumn("change", F.col("gap") - F.lag("gap").over(Window.orderBy("win")))  # a row a window size
    return g.select("win", *_six("target", "standard", "gap", "change"))


@query("band_gap", """with b as (select l_linestatus as tokenizer, l_quantity as v, l_extendedprice as score, case when l_discount < 0.03 then 'low' when l_discount < 0.07 then 'medium' else 'high' end as band from lineitem)
select tokenizer, round(avg(v), 6) as mean, round(corr(v, score), 6) as r, round(avg(v) filter (band = 'low'), 6) as low, round(avg(v) filter (band = 'medium'), 6) as medium, round(avg(v) filter (band = 'high'), 6) as high,
round((avg(v) filter (band = 'low') - avg(v) filter (band = 'high')) / stddev_samp(v), 6) as gap from b group by 1""")
def band_gap(spark, sf_dir):
    band = F.when(F.col("l_discount") < 0.03, "low").when(F.col("l_discount") < 0.07, "medium").otherwise("high")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("tokenizer"), F.col("l_quantity").alias("v"), F.col("l_extendedprice").alias("score"), band.alias("band"))
    of = lambda x: F.avg(F.when(F.col("band") == x, F.col("v")))
    g = b.groupBy("tokenizer").agg(F.avg("v").alias("mean"), S.pearson("v", "score").alias("r"), of("low").alias("low"), of("medium").alias("medium"), of("high").alias("high"), ((of("low") - of("high")) / F.stddev_samp("v")).alias("gap"))
    return g.select("tokenizer", *_six("mean", "r", "low", "medium", "high", "gap"))


@query("band_means", "select c_mktsegment, c_nationkey, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) as se from customer group by 1, 2")
def band_means(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("mean"), P.standard_error("c_acctbal").alias("se"))
    return g.select("c_mktsegment", "c_nationkey", *_six("mean", "se"))


@query("proficiency_profile", """with u as (select user_id, event_type as label, count(*) as n from events group by 1, 2), a as (select user_id, sum(n) as total from u group by 1),
l as (select distinct event_type as label from events), g as (select a.user_id, l.label, coalesce(n, 0) / total as rate, total from a cross join l left join u on u.user_id = a.user_id and u.label = l.label),
r as (select label, rate, total, rank() over (partition by label order by rate) + (count(*) over (partition by label, rate) - 1) / 2.0 as rx, rank() over (partition by label order by total) + (count(*) over (partition by label, total) - 1) / 2.0 as ry from g)
select label, round(sum(rate * total) / sum(total), 6) as share, round(corr(rx, ry), 5) as rho, round(1000 * avg(rate) filter (total < 10), 5) as low_1000, round(1000 * avg(rate) filter (total >= 10), 5) as high_1000 from r group by 1""")
def proficiency_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = ("click", "view", "purchase", "signup", "error")
    per = e.groupBy("user_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    pairs = ", ".join(f"'{k}', `{k}`" for k in kinds)
    g = per.select("user_id", "total", F.expr(f"stack({len(kinds)}, {pairs}) as (label, n)")).withColumn("rate", F.col("n") / F.col("total"))
    rho = S.spearman(g, "rate", "total", "label").select("label", F.round("rho", 5).alias("rho"))
    of = lambda c: F.round(1000 * F.avg(F.when(c, F.col("rate"))), 5)
    s = g.groupBy("label").agg(F.round(F.sum(F.col("rate") * F.col("total")) / F.sum("total"), 6).alias("share"), of(F.col("total") < 10).alias("low_1000"), of(F.col("total") >= 10).alias("high_1000"))
    return s.join(rho, "label")


@query("policy_divergence", """with p as (select l_suppkey as model, l_quantity as joint, l_extendedprice / 1000 as density from lineitem), m as (select model, avg(joint) as joint, avg(density) as density, avg(joint - density) as difference, avg(joint) / avg(density) as ratio, corr(joint, density) as r from p group by 1)
select model, round(difference, 6) as difference, round(ratio, 6) as ratio, round(r, 6) as r, rank() over (order by joint desc) as rank_joint, rank() over (order by density desc) as rank_density, rank() over (order by joint desc) - rank() over (order by density desc) as moved from m""")
def policy_divergence(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_quantity").alias("joint"), (F.col("l_extendedprice") / 1000).alias("density"))
    mean = P.ordered_mean
    m = p.groupBy("model").agg(mean("joint").alias("joint"), mean("density").alias("density"), mean(F.col("joint") - F.col("density")).alias("difference"), (mean("joint") / mean("density")).alias("ratio"), S.pearson("joint", "density").alias("r"))
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c))).cast("long")  # noqa: E731  a row a model
    m = m.withColumns({"rank_joint": rank("joint"), "rank_density": rank("density")})
    return m.select("model", *_six("difference", "ratio", "r"), "rank_joint", "rank_density", (F.col("rank_joint") - F.col("rank_density")).alias("moved"))


@query("policy_relabel", "select l_orderkey, l_linenumber, l_partkey, policy, value from (select l_orderkey, l_linenumber, l_partkey, 'joint' as policy, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, l_partkey, 'joint', l_tax from lineitem union all select l_orderkey, l_linenumber, l_partkey, 'density', l_discount from lineitem)")
def policy_relabel(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return P.relabel_policies(li, ["l_orderkey", "l_linenumber", "l_partkey"], {"l_quantity": "joint", "l_tax": "joint", "l_discount": "density"})


@query("signature_groups", "with s as (select doc_id, md5(text) as signature from documents) select doc_id, min(doc_id) over (partition by signature) as \"group\" from s")
def signature_groups(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("signature"))
    return P.signature_groups(s, "doc_id", "signature").select("doc_id", "group")


@query("topk_position", """with e as (select vec_id, unnest(embedding)::double as s, generate_subscripts(embedding, 1) - 1 as id from embeddings), m as (select vec_id, id, exp(s) / sum(exp(s)) over (partition by vec_id) as p from e),
k as (select *, row_number() over (partition by vec_id order by p desc, id) as rank from m) select vec_id, coalesce(max(rank - 1) filter (id = vec_id % 64 and rank <= 10), -1)::int as place, round(sum(p) filter (rank <= 10), 6) as mass from k group by 1""")
def topk_position(spark, sf_dir):
    from corpusmill.operators import sequences as Q

    best = table(spark, sf_dir, "embeddings").select("vec_id", Q.topk(Q.softmax(F.transform("embedding", lambda x: x.cast("double"))), 10).alias("best"))
    return best.select("vec_id", P.place_in_topk(F.col("best.id"), (F.col("vec_id") % 64).cast("int")).alias("place"), F.round(P.topk_mass(F.col("best.p")), 6).alias("mass"))


@query("model_family", "select p_brand as name, case when regexp_matches(lower(n), '^gpt2|distilgpt') then 'GPT-2' when regexp_matches(lower(n), 'pythia') then 'Pythia' when regexp_matches(lower(n), 'olmo') then 'OLMo' when regexp_matches(lower(n), 'bert') then 'BERT' else 'other' end as family, count(*) as n from (select p_brand, case p_partkey % 5 when 0 then 'gpt2-large' when 1 then 'Pythia-410m' when 2 then 'OLMo-2' when 3 then 'bert-base' else 'x' end as n from part) group by 1, 2")
def model_family(spark, sf_dir):
    names = F.array(*map(F.lit, ("gpt2-large", "Pythia-410m", "OLMo-2", "bert-base", "x")))
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.get(names, (F.col("p_partkey") % 5).cast("int")).alias("m"))
    return p.groupBy("name", P.model_family(F.col("m")).alias("family")).agg(F.count("*").alias("n"))


@query("window_rows", "select l_orderkey, l_linenumber, l_partkey, round(l_quantity * 1.4426950408889634, 6) as mean, round(l_tax * 1.4426950408889634 * 1.4426950408889634, 6) as variance from lineitem where l_returnflag = 'R' and l_linestatus = 'F'")
def window_rows(spark, sf_dir):
    rows = P.window_rows(table(spark, sf_dir, "lineitem"), l_returnflag="R", l_linestatus="F").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("mean"), F.col("l_tax").alias("variance"))
    return P.unit_change(rows, "mean", "variance").select("l_orderkey", "l_linenumber", "l_partkey", *_six("mean", "variance"))


@query("net_gain", "with c as (select l_orderkey, l_quantity - 10 * (l_linenumber - 1) as net, l_returnflag || l_linenumber || '-' || l_partkey as label from lineitem), b as (select l_orderkey, net, label, row_number() over (partition by l_orderkey order by net desc, label desc) as r from c) select l_orderkey, net, case when net > 20 then label else 'NONE' end as label from b where r = 1")
def net_gain(spark, sf_dir):
    label = F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") - 20).alias("gain"), (10.0 * (F.col("l_linenumber") - 1)).alias("distance"), label.alias("label"))
    return P.net_gain(c, ["l_orderkey"], "gain", "distance", "label").withColumn("net", F.col("net") + 20)


_GAIN_KINDS = [f"{r}{k}" for r in "ANR" for k in range(1, 8)]


@query("gain_matrix", "select l_orderkey, " + ", ".join(f"least(greatest(coalesce(max(l_quantity - 5) filter (l_returnflag || l_linenumber = '{k}'), 0), 0), 40)::double as \"{k}\"" for k in _GAIN_KINDS) + " from lineitem group by 1")
def gain_matrix(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("kind"), (F.col("l_quantity") - 5).alias("gain"))
    return P.gain_matrix(c, "l_orderkey", "kind", "gain", _GAIN_KINDS)


# Pieces of seven characters over a text's words, which begin at each word's place in the text joined by single spaces.
_SQL_ALIGN = f"""w0 as (select item_id, unnest(a) as tok, generate_subscripts(a, 1) - 1 as word_i from (select item_id, regexp_extract_all(lower(text), '{WORD}') as a from benchmark)),
w as (select item_id, word_i, sum(length(tok) + 1) over (partition by item_id order by word_i) - length(tok) - 1 as start, sum(length(tok) + 1) over (partition by item_id order by word_i) - 1 as stop from w0),
n as (select item_id, max(stop) as n from w group by 1), p as (select item_id, unnest(range(0, n::bigint, 7)) as first, n from n),
q as (select item_id, first // 7 as piece_i, first, least(first + 6, n - 1) as last from p),
x as (select q.item_id, piece_i, max(w.word_i) filter (q.first >= w.start and q.first < w.stop) as word_i, max(w.word_i) filter (q.last >= w.start and q.last < w.stop) as last_word from q join w on w.item_id = q.item_id group by 1, 2)"""


def _aligned(spark, sf_dir):
    t = K.tokens(table(spark, sf_dir, "benchmark"), "item_id")
    upto = F.sum(F.length("tok") + 1).over(Window.partitionBy("item_id").orderBy("i"))
    w = t.select("item_id", F.col("i").cast("long").alias("word_i"), (upto - F.length("tok") - 1).alias("start"), (upto - 1).alias("stop"))
    n = w.groupBy("item_id").agg(F.max("stop").alias("n"))
    p = n.select("item_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(7).cast("long"))).alias("first"))
    pieces = p.select("item_id", F.expr("first div 7").alias("piece_i"), "first", F.least(F.col("first") + 6, F.col("n") - 1).alias("last"))
    return P.align_pieces(w, pieces, "item_id")


@query("align_pieces", f"with {_SQL_ALIGN} select item_id, piece_i, coalesce(word_i, -1) as word_i, word_i is distinct from last_word as straddles from x")
def align_pieces(spark, sf_dir):
    return _aligned(spark, sf_dir).withColumn("word_i", F.coalesce("word_i", F.lit(-1)))


@query("alignment_counts", f"with {_SQL_ALIGN} select item_id, count(*) as pieces, count(*) filter (word_i is null) as unaligned, count(*) filter (word_i is distinct from last_word) as straddling, round(count(*) / count(distinct word_i), 6) as fertility from x group by 1")
def alignment_counts(spark, sf_dir):
    return _aligned(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("pieces"), F.count_if(F.col("word_i").isNull()).alias("unaligned"), F.count_if("straddles").alias("straddling"), F.round(F.try_divide(F.count("*"), F.countDistinct("word_i")), 6).alias("fertility"))


@query("contiguous_pieces", f"with {_SQL_ALIGN}, y as (select * from x where piece_i % 5 <> 3 and word_i is not null) select item_id, word_i, count(*) as n_pieces, max(piece_i) - min(piece_i) + 1 = count(*) as whole from y group by 1, 2")
def contiguous_pieces(spark, sf_dir):
    return P.contiguous(_aligned(spark, sf_dir).where("piece_i % 5 <> 3"), "item_id")


@query("word_start_join", f"with {_SQL_ALIGN} select q.item_id, w.word_i, q.piece_i from w join q on q.item_id = w.item_id and q.first = w.start")
def word_start_join(spark, sf_dir):
    t = K.tokens(table(spark, sf_dir, "benchmark"), "item_id")
    upto = F.sum(F.length("tok") + 1).over(Window.partitionBy("item_id").orderBy("i"))
    w = t.select("item_id", F.col("i").cast("long").alias("word_i"), (upto - F.length("tok") - 1).alias("start"), (upto - 1).alias("stop"))
    n = w.groupBy("item_id").agg(F.max("stop").alias("n"))
    p = n.select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(7).cast("long"))).alias("start")).withColumn("piece_i", F.expr("start div 7"))
    return w.join(p, ["item_id", "start"]).select("item_id", "word_i", "piece_i")


@query("moments", "select l_returnflag, count(*) as n, round(avg(l_extendedprice), 6) as mean, round(stddev_samp(l_extendedprice), 6) as sd, min(l_extendedprice) as low, max(l_extendedprice) as high, round(avg(z * z * z) / pow(avg(z * z), 1.5), 5) as skew, round(avg(z * z * z * z) / pow(avg(z * z), 2) - 3, 5) as kurtosis from (select *, l_extendedprice - avg(l_extendedprice) over (partition by l_returnflag) as z from lineitem) group by 1")
def moments(spark, sf_dir):
    x = "l_extendedprice"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.skewness(x), 5).alias("skew"), F.round(F.kurtosis(x), 5).alias("kurtosis"))


@query("partial_spearman", """with g as (select o_orderpriority as grp, o_totalprice as x, o_custkey::double as z, o_orderkey::double as y from orders), f as (select grp, regr_slope(x, z) bx, regr_intercept(x, z) ax, regr_slope(y, z) by_, regr_intercept(y, z) ay from g group by 1),
e as (select grp, round(x - ax - bx * z, 4) as ex, round(y - ay - by_ * z, 4) as ey from g join f using (grp)), r as (select grp, rank() over (partition by grp order by ex) + (count(*) over (partition by grp, ex) - 1) / 2.0 as rx, rank() over (partition by grp order by ey) + (count(*) over (partition by grp, ey) - 1) / 2.0 as ry from e)
select grp, count(*) as n, round(corr(rx, ry), 4) as rho from r group by 1""")
def partial_spearman(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("z"), F.col("o_orderkey").cast("double").alias("y"))
    f = g.groupBy("grp").agg(*[e.alias(k) for k, e in (("bx", F.regr_slope("x", "z")), ("ax", F.regr_intercept("x", "z")), ("by", F.regr_slope("y", "z")), ("ay", F.regr_intercept("y", "z")))])
    e = g.join(f, "grp").select("grp", F.round(F.expr("x - ax - bx * z"), 4).alias("ex"), F.round(F.expr("y - ay - by * z"), 4).alias("ey"))
    return S.spearman(e, "ex", "ey", "grp").select("grp", "n", F.round("rho", 4).alias("rho"))


_POISSON = " + ".join(f"(u >= {p!r})::int" for p in P.POISSON)


def _sql_draws(rows: str, key: str, draws: int, seed: str) -> str:
    return f"z as (select *, {_POISSON} as w from (select *, ('0x' || substr(md5({key}::varchar || '|' || draw::varchar || '|{seed}'), 1, 8))::bigint / 4294967296.0::double as u from ({rows}) r, unnest(range(0, {draws})) t(draw)))"


@query("bootstrap_correlation", f"""with {_sql_draws("select c_custkey, c_mktsegment, c_acctbal as x, c_nationkey::double as y from customer", "c_custkey", 2000, "b1")},
d as (select c_mktsegment, draw, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / sqrt((sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) * (sum(w) * sum(w * y * y) - sum(w * y) * sum(w * y))) as r from z group by 1, 2)
select c_mktsegment, round(quantile_cont(r, 0.025), 6) as low, round(quantile_cont(r, 0.975), 6) as high from d group by 1""")
def bootstrap_correlation(spark, sf_dir):
    """Intervals of a correlation by strata, from 2,000 draws."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    terms = {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    d = B.bootstrap_sums(c, "c_custkey", "c_mktsegment", 2000, terms, "b1").withColumn("r", B.correlation_of_sums())
    return P.percentile_interval(d, "r", "c_mktsegment").select("c_mktsegment", *_six("low", "high"))


@query("bootstrap_difference", f"""with {_sql_draws("select doc_id, quality, toxic from labels", "doc_id", 2000, "b2")},
d as (select draw, sum(w * toxic) filter (quality = 1) / sum(w) filter (quality = 1) - sum(w * toxic) filter (quality = 0) / sum(w) filter (quality = 0) as r from z group by 1)
select round(avg(r), 6) as mean, round(quantile_cont(r, 0.025), 6) as low, round(quantile_cont(r, 0.975), 6) as high, round(avg((r > 0)::int), 6) as above from d""")
def bootstrap_difference(spark, sf_dir):
    """The interval of a difference of two groups' means, and how often it is above 0."""
    of = lambda q: F.try_divide(F.sum(F.when(F.col("quality") == q, F.col("w") * F.col("toxic"))), F.sum(F.when(F.col("quality") == q, F.col("w"))))
    d = P.bootstrap(table(spark, sf_dir, "labels"), "doc_id", [], 2000, {"r": of(1) - of(0)}, "b2")
    return d.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.percentile("r", 0.025), 6).alias("low"), F.round(F.percentile("r", 0.975), 6).alias("high"), F.round(F.avg((F.col("r") > 0).cast("int")), 6).alias("above"))


@query("permutation_test", """with n as (select count(*) filter (quality = 1) as size, avg(toxic) filter (quality = 1) - avg(toxic) filter (quality = 0) as difference from labels),
r as (select draw, toxic, row_number() over (partition by draw order by md5(doc_id::varchar || '|' || draw::varchar || '|p1'), doc_id) as place from labels, unnest(range(0, 999)) t(draw)),
d as (select draw, avg(toxic) filter (place <= size) - avg(toxic) filter (place > size) as d from r, n group by 1)
select round(any_value(difference), 6) as difference, round((count(*) filter (abs(d) >= abs(difference) - 1e-12) + 1) / 1000, 6)::double as p from d, n""")
def permutation_test(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("good", F.col("quality") == 1)
    return P.permutation_test(rows, "doc_id", "good", "toxic", 999, "p1").select(*_six("difference", "p"))


# A fixed annotation in place of a parser's: sentences are lines, and a word's place and length give its relations.
_POS = ("NOUN", "VERB", "ADJ", "ADV", "AUX", "PROPN", "PRON")
_DEP = ("nsubj", "conj", "ROOT", "advcl", "amod", "aux", "mark", "ccomp", "dobj", "punct", "relcl")


def _annotated(spark, sf_dir):
    from corpusmill.functions import text as T

    s = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    t = s.select("doc_id", "sent_id", F.posexplode(T.words(F.col("line"))).alias("p", "tok"))
    pick = lambda xs, at: F.get(F.array(*map(F.lit, xs)), at.cast("int"))
    i = F.col("sent_id") * 1000 + F.col("p")
    head = F.col("sent_id") * 1000 + F.greatest(F.col("p") - 1 - F.length("tok") % 3, F.lit(0))
    t = t.select("doc_id", "sent_id", i.alias("i"), head.alias("head_i"), pick(_POS, (F.length("tok") * 5 + F.col("p")) % 7).alias("pos"), pick(_DEP, (F.length("tok") * 3 + F.col("p") * 7) % 11).alias("dep"), "tok", "p")
    return t.select("doc_id", "sent_id", "i", "head_i", "pos", "dep", F.when(F.col("p") % 4 == 0, "VB").otherwise("VBD").alias("tag"), (F.length("tok") % 2 == 0).alias("finite"), (F.col("dep") == "punct").alias("is_punct"), F.lit(False).alias("is_space"), F.col("tok").rlike(r"^\p{L}+$").alias("is_alpha"))


_list = lambda xs: ", ".join(repr(x) for x in xs)

_SQL_SYNTAX = f"""with recursive s0 as (select conv_id::varchar || '-' || turn::varchar as doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as sent_id from conversations),
w0 as (select doc_id, sent_id, unnest(a) as tok, generate_subscripts(a, 1) - 1 as p from (select *, regexp_extract_all(lower(line), '{WORD}') as a from s0)),
t0 as (select doc_id, sent_id, sent_id * 1000 + p as i, sent_id * 1000 + greatest(p - 1 - length(tok) % 3, 0) as head_i, [{_list(_POS)}][(length(tok) * 5 + p) % 7 + 1] as pos, [{_list(_DEP)}][(length(tok) * 3 + p * 7) % 11 + 1] as dep,
  case when p % 4 = 0 then 'VB' else 'VBD' end as tag, length(tok) % 2 = 0 as finite, regexp_full_match(tok, '\\p{{L}}+') as is_alpha from w0),
k as (select doc_id, head_i as i, bool_or(dep in ({_list(E.SUBJECT)})) as subj, bool_or(dep in ({_list(E.AUXILIARY)}) and finite) as aux, bool_or(dep = 'mark') as mark, bool_or(dep in ({_list(E.MODIFIERS)})) as modified, count(*) filter (dep <> 'punct') as kids from t0 where head_i <> i group by 1, 2),
t1 as (select t0.*, coalesce(subj, false) as subj, coalesce(aux, false) as aux, coalesce(mark, false) as mark, coalesce(modified, false) as modified, coalesce(kids, 0) as kids from t0 left join k using (doc_id, i)),
t as (select *, pos in ('VERB', 'AUX') and dep not in ({_list(E.AUXILIARY)}) and ((tag = 'VB' and dep = 'ROOT' and not subj) or ((finite or aux) and (subj or dep in ({_list(E.SUBJECTLESS)})))) as clause from t1),
c as (select *, dep = 'ROOT' or dep not in ({_list(E.SUBORDINATING)}) or (dep = 'ccomp' and i < head_i and not mark) as seed from t where clause),
u as (select doc_id, sent_id, i from c where seed union select c.doc_id, c.sent_id, c.i from c join u on u.doc_id = c.doc_id and u.sent_id = c.sent_id and u.i = c.head_i where c.dep = 'conj'),
un as (select doc_id, sum(greatest(n, 1)) as t_units from (select c.doc_id, c.sent_id, count(distinct u.i) as n from c left join u on u.doc_id = c.doc_id and u.sent_id = c.sent_id group by 1, 2) group by 1),
f as (select doc_id, count(*) filter (dep <> 'punct') as n_words, count(*) filter (clause) as clauses, count(*) filter ((pos in ({_list(E.NOMINAL)}) and modified) or dep in ({_list(E.NOMINAL_CLAUSE)})) as cn, count(*) filter (dep = 'conj' and pos in ({_list(E.COORDINATED)}) and not clause) as cp,
  avg(kids) filter (clause) as deps_per_clause, avg(kids) filter (pos in ({_list(E.NOMINAL)})) as deps_per_nominal, count(*) filter (pos in ({_list(E.CONTENT_POS)}) and is_alpha) / nullif(count(*) filter (is_alpha), 0) as lexical_density from t group by 1)
select doc_id, n_words, clauses, coalesce(t_units, 0)::bigint as t_units, round(clauses / nullif(t_units, 0), 6)::double as clauses_per_tunit, round(n_words / nullif(clauses, 0), 6) as mean_length_of_clause, round(cn / nullif(clauses, 0), 6) as complex_nominals_per_clause, round(cp / nullif(clauses, 0), 6) as coord_phrases_per_clause,
round(deps_per_clause, 6) as deps_per_clause, round(deps_per_nominal, 6) as deps_per_nominal, round(lexical_density, 6) as lexical_density from f left join un using (doc_id)"""


@query("syntactic_features", _SQL_SYNTAX)
def syntactic_features(spark, sf_dir):
    s = E.syntactic(_annotated(spark, sf_dir))
    return s.select("doc_id", "n_words", "clauses", "t_units", *_six("clauses_per_tunit", "mean_length_of_clause", "complex_nominals_per_clause", "coord_phrases_per_clause", "deps_per_clause", "deps_per_nominal", "lexical_density"))


_SQL_POINTS = """p as (select o_orderpriority as level, l_returnflag || '/' || year(l_shipdate) as config, avg(l_quantity) as high, avg(l_linenumber) as low from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""


@query("front_by_level", f"with {_SQL_POINTS} select level, config, not exists (select 1 from p o where o.level = p.level and o.high >= p.high and o.low <= p.low and (o.high > p.high or o.low < p.low)) as front from p")
def front_by_level(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("level"))
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    p = li.groupBy("level", F.concat_ws("/", "l_returnflag", F.year("l_shipdate").cast("string")).alias("config")).agg(F.avg("l_quantity").alias("high"), F.avg("l_linenumber").alias("low"))
    front = S.pareto_front(p, "config", "high", "low", "level").select("level", "config", F.lit(True).alias("front"))
    return p.select("level", "config").join(front, ["level", "config"], "left").withColumn("front", F.coalesce("front", F.lit(False)))


_PAIRS = [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax")]


def _sql_contrast(a, b):
    return f"select '{a}' as first, '{b}' as second, count(*) as n, corr(l_extendedprice, {a}) as x, corr(l_extendedprice, {b}) as y, corr({a}, {b}) as xy from lineitem where l_extendedprice is not null and {a} is not null and {b} is not null"


@query("contrasts", f"""with c as ({' union all '.join(_sql_contrast(a, b) for a, b in _PAIRS)}),
s as (select first, second, n, abs(x) as x, abs(y) as y, xy * sign(x) * sign(y) as xy, 1.959963984540054 / sqrt(n - 3) as h from c),
i as (select *, tanh(atanh(x) - h) as xl, tanh(atanh(x) + h) as xu, tanh(atanh(y) - h) as yl, tanh(atanh(y) + h) as yu, ((xy - 0.5 * x * y) * (1 - x * x - y * y - xy * xy) + xy ** 3) / ((1 - x * x) * (1 - y * y)) as k from s),
r as (select first, second, n, x - y as d, x - y - sqrt(greatest(0, (x - xl) ** 2 + (yu - y) ** 2 - 2 * k * (x - xl) * (yu - y))) as lo, x - y + sqrt(greatest(0, (xu - x) ** 2 + (y - yl) ** 2 - 2 * k * (xu - x) * (y - yl))) as hi from i)
select first, second, n, round(d, 6) as difference, round(lo, 6) as low, round(hi, 6) as high, lo > 0 or hi < 0 as excludes_0 from r""")
def contrasts(spark, sf_dir):
    c = S.contrasts(table(spark, sf_dir, "lineitem"), "l_extendedprice", _PAIRS)
    return c.select("first", "second", "n", *_six("difference", "low", "high"), "excludes_0")


_SQL_D = """select g, sum(d * n) / sum(n) as d from (select {s} as st, g, n, (m - m2) / sqrt((ss + ss2) / (n + n2 - 2)) as d from (
  select *, q - s * s / n as ss, q2 - s2 * s2 / n2 as ss2, s / n as m, s2 / n2 as m2 from (select *, sum(n) over (partition by {s}) - n as n2, sum(s) over (partition by {s}) - s as s2, sum(q) over (partition by {s}) - q as q2
  from (select {s}, g, count(*) as n, sum(x) as s, sum(x * x) as q from b group by all)) where n >= 2 and n2 >= 2)) group by 1"""


@query("confound_bound", f"""with b as (select l_returnflag as g, l_linenumber as st, 1 as one, l_quantity as x from lineitem where l_quantity is not null),
p as ({_SQL_D.format(s='one')}), w as ({_SQL_D.format(s='st')})
select g as l_returnflag, round(p.d, 6) as d_plain, round(w.d, 6) as d_within, round(w.d / p.d, 4) as kept from p left join w using (g)""")
def confound_bound(spark, sf_dir):
    c = S.confound_bound(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", "l_returnflag")
    return c.select("l_returnflag", *_six("d_plain", "d_within"), F.round("kept", 4).alias("kept"))


@query("rank_ties", """select p_partkey, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as average,
row_number() over (partition by p_brand order by p_size, p_partkey) as first, rank() over (partition by p_brand order by p_size desc) as from_top, round(cume_dist() over (partition by p_brand order by p_size), 6) as share from part""")
def rank_ties(spark, sf_dir):
    r = S.ranks("p_size", ["p_partkey"], "p_brand")
    return table(spark, sf_dir, "part").withColumns(r).select("p_partkey", "average", *[F.col(c).cast("long").alias(c) for c in ("first", "from_top")], F.round("share", 6).alias("share"))


@query("delta_vectors", """with e as (select vec_id, unnest(embedding)::double as s, generate_subscripts(embedding, 1) - 1 as id from embeddings), m as (select vec_id, id, exp(s) / sum(exp(s)) over (partition by vec_id) as p from e),
k as (select *, row_number() over (partition by vec_id order by p desc, id) as rank from m), t as (select vec_id, id, p / sum(p) over (partition by vec_id) as p from k where rank <= 10 union all select vec_id, vec_id % 64, -1 from embeddings),
v as (select vec_id as id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) select vec_id, dim, round(sum(p * x), 6) + 0.0 as delta from t join v using (id) group by 1, 2""")
def delta_vectors(spark, sf_dir):
    from corpusmill.operators import sequences as Q

    e = table(spark, sf_dir, "embeddings")
    best = e.select("vec_id", Q.topk(Q.softmax(F.transform("embedding", lambda x: x.cast("double"))), 10).alias("best"), (F.col("vec_id") % 64).alias("obs"))
    d = P.delta_vectors(best.select("vec_id", F.col("best.id").alias("ids"), F.col("best.p").alias("p"), "obs"), "vec_id", "obs", e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return d.select("vec_id", F.posexplode("delta").alias("dim", "delta")).select("vec_id", F.col("dim").cast("long").alias("dim"), (F.round("delta", 6) + 0.0).alias("delta"))


_SQL_MIX = ", ".join(f"sum(w) filter (b = '{b}') / sum(w) as mix_{b}, sum(w) filter (b = '{b}') / sum(w) - count(*) filter (b = '{b}') / count(b) as mix_{b}_minus_base" for b in ("low", "mid", "high"))
_MIX = [f"mix_{b}{x}" for b in ("low", "mid", "high") for x in ("", "_minus_base")]


@query("component_summary", f"""with r as (select vec_id, component, greatest(x, 0) as w, vec_id % 101 as v, case label % 3 when 0 then 'low' when 1 then 'mid' else 'high' end as b, label as t
  from (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as component from embeddings)),
s as (select component, sum(w) / (select sum(w) from r) as loading_share, count(*) filter (w > 0) as n_nonzero, sum(w * v) / sum(w) as mean_value, {_SQL_MIX} from r group by 1),
k as (select component, t, count(*) as n from (select *, row_number() over (partition by component order by w desc, vec_id) as place from r) where place <= 100 group by 1, 2),
a as (select *, row_number() over (partition by component order by n desc, t) as nth, sum(n) over (partition by component order by n desc, t rows unbounded preceding) as c, sum(n) over (partition by component) as total from k),
h as (select component, min(t) filter (nth = 1) as top_word, max(n / total) as top_word_share, min(nth) filter (2 * c >= total) as words_to_half from a group by 1)
select component, n_nonzero, top_word, words_to_half, {', '.join(f'round({c}, 6) as {c}' for c in ['loading_share', 'mean_value', 'top_word_share', *_MIX])} from s left join h using (component)""")
def component_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("component", "x"))
    band = F.when(F.col("label") % 3 == 0, "low").when(F.col("label") % 3 == 1, "mid").otherwise("high")
    r = e.select("vec_id", F.col("component").cast("long").alias("component"), F.greatest(F.col("x").cast("double"), F.lit(0.0)).alias("w"), (F.col("vec_id") % 101).alias("v"), band.alias("b"), F.col("label").alias("t"))
    c = P.component_summary(r, "component", "vec_id", "w", "v", "b", "t", ["low", "mid", "high"], 100)
    return c.select("component", "n_nonzero", "top_word", F.col("words_to_half").cast("long").alias("words_to_half"), *_six("loading_share", "mean_value", "top_word_share", *_MIX))
