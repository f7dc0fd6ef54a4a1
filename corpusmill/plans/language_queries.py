"""Queries on words: features, context, attestation, scores, repair."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import lexicon as L
from corpusmill.functions import text as T
from corpusmill.operators import features as E
from corpusmill.operators import scoring as S
from corpusmill.operators import sequences as Q
from corpusmill.operators import tokens as K
from corpusmill.operators import trigrams as G
from corpusmill.plans.common import SQL_GRAMS, SQL_PAIRS, SQL_SENTS, SQL_TOKS, WORD, table
from corpusmill.plans.registry import query


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _toks(spark, sf_dir):
    return K.tokens(_docs(spark, sf_dir))


def _turns(spark, sf_dir):
    """Words of conversations, numbered through each."""
    c = table(spark, sf_dir, "conversations")
    t = c.select("conv_id", "turn", F.posexplode(T.words(F.col("text"))).alias("p", "tok"))
    return t.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "p")) - 1).select("conv_id", "i", "tok")


_SQL_TURNS = f"""turns as (select conv_id, row_number() over (partition by conv_id order by turn, p) - 1 as i, tok from (
  select conv_id, turn, unnest(a) as tok, generate_subscripts(a, 1) as p from (select *, regexp_extract_all(lower(text), '{WORD}') as a from conversations)))"""


@query("lexical_features", f"""with {SQL_TOKS}, f as (select tok, count(*) as c from toks group by 1), n as (select count(*)::double as n from toks)
select doc_id, count(*) as n_tokens, round(avg(length(tok)), 6) as mean_word_length, round(avg(log10(c / n)), 6) as log_mean_token_freq, round(count(distinct tok) / count(*), 6) as type_token_ratio from toks join f using (tok) cross join n group by 1""")
def lexical_features(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    freq = _toks(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("count"))
    total = docs.agg(F.sum(F.size(T.words(F.col("text"))))).first()[0] or 1
    f = E.lexical(docs, freq, F.lit(float(total)))
    return f.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "log_mean_token_freq", "type_token_ratio")])


@query("adjacent_jaccard", f"""with {SQL_SENTS}, p as (select *, lead(words) over (partition by doc_id order by sent) as nxt from sents)
select doc_id, count(*) as n_sents, round(avg(len(list_intersect(words, nxt)) / len(list_distinct(words || nxt))) filter (nxt is not null), 6) as overlap from p group by 1""")
def adjacent_jaccard(spark, sf_dir):
    return E.adjacent_overlap(_docs(spark, sf_dir)).withColumn("overlap", F.round("overlap", 6))


@query("connective_density", f"with {SQL_SENTS} select doc_id, round(sum(len(list_filter(words, lambda w: list_contains([{', '.join(repr(w) for w in L.CONNECTIVES)}], w)))) / count(*), 6)::double as connective_density from sents group by 1")
def connective_density(spark, sf_dir):
    return E.connective_density(_docs(spark, sf_dir)).withColumn("connective_density", F.round("connective_density", 6))


@query("relation_mi", f"""with {SQL_PAIRS}, h as (select head_lemma, sum(count)::double f1 from pairs group by 1), d as (select dependent_lemma, sum(count)::double f2 from pairs group by 1), n as (select sum(count)::double n from pairs),
a as (select head_lemma, relation, dependent_lemma, log2(count * n / (f1 * f2)) as pmi from pairs join h using (head_lemma) join d using (dependent_lemma) cross join n),
o as (select doc_id, h as head_lemma, tok as dependent_lemma, case when tok like '%ly' then 'advmod' when tok like '%ed' then 'dobj' when tok like '%ing' then 'amod' end as relation from (select doc_id, lag(tok) over (partition by doc_id order by i) as h, tok from toks) where h is not null)
select doc_id, round(avg(pmi) filter (relation = 'amod'), 6) as amod, round(avg(pmi) filter (relation = 'dobj'), 6) as dobj, round(avg(pmi) filter (relation = 'advmod'), 6) as advmod from o join a using (head_lemma, relation, dependent_lemma) group by 1""")
def relation_mi(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    own = K.with_neighbours(_toks(spark, sf_dir), "doc_id").where("prev <> '#'").select("doc_id", F.col("prev").alias("head_lemma"), K.relation(F.col("tok")).alias("relation"), F.col("tok").alias("dependent_lemma"))
    names = ("amod", "dobj", "advmod")
    return E.phraseological(own, K.association(K.dependency_pairs(docs)), names).select("doc_id", *[F.round(c, 6).alias(c) for c in names])


@query("mtld")
def mtld(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(E.mtld(T.words(F.col("text"))), 6).alias("mtld"))


@query("lead_lag_context", f"with {_SQL_TURNS} select conv_id, i, tok, lag(tok, 1, '#') over w as prev, lead(tok, 1, '#') over w as next from turns window w as (partition by conv_id order by i)")
def lead_lag_context(spark, sf_dir):
    return K.with_neighbours(_turns(spark, sf_dir), "conv_id").withColumn("i", F.col("i").cast("long"))


@query("left_window_8", f"with {_SQL_TURNS} select conv_id, i, array_to_string(list(tok) over (partition by conv_id order by i rows between 7 preceding and current row), ' ') as context from turns")
def left_window_8(spark, sf_dir):
    c = Q.left_context(_turns(spark, sf_dir), "conv_id", 8)
    return c.select("conv_id", F.col("i").cast("long").alias("i"), F.array_join("context", " ").alias("context"))


@query("centred_window", f"with {_SQL_TURNS}, n as (select conv_id, count(*) as n from turns group by 1) select conv_id, i, greatest(least(i - 4, n - 9), 0) as start, least(greatest(least(i - 4, n - 9), 0) + 9, n) as stop from turns join n using (conv_id)")
def centred_window(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    start, stop = Q.centred_window(F.col("n"), F.col("i"), 9)
    return t.select("conv_id", F.col("i").cast("long").alias("i"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))


@query("occurrence_index", f"with {_SQL_TURNS} select conv_id, i, tok, row_number() over (partition by conv_id, tok order by i) as occurrence from turns")
def occurrence_index(spark, sf_dir):
    o = Q.occurrence(_turns(spark, sf_dir), "conv_id")
    return o.select("conv_id", F.col("i").cast("long").alias("i"), "tok", F.col("occurrence").cast("long").alias("occurrence"))


@query("global_row_id", f"with {_SQL_TURNS} select conv_id, i, row_number() over (order by conv_id, i) - 1 as row_id from turns")
def global_row_id(spark, sf_dir):
    t = _turns(spark, sf_dir).select("conv_id", F.col("i").cast("long").alias("i"))
    return Q.row_ids(t, "conv_id", "i")


@query("word_class_case", f"with {SQL_TOKS} select cls, count(*) as n from (select case " + " ".join(f"when tok in ({', '.join(repr(w) for w in ws.split())}) then '{c}'" for c, ws in L.WORD_CLASSES.items()) + " else 'CONTENT' end as cls from toks) group by 1")
def word_class_case(spark, sf_dir):
    return _toks(spark, sf_dir).select(L.word_class(F.col("tok")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("label_group", "select label, case when label = 'NONE' then 'none' when label like '%\\_CONTENT' escape '\\' then 'lexical' else 'grammatical' end as label_group, count(*) as n from (select case doc_id % 5 when 0 then 'NONE' when 1 then 'PRED_CONTENT' when 2 then 'INS_DET' when 3 then 'MORPH_S' else 'DEL_CONTENT' end as label from documents) group by 1, 2")
def label_group(spark, sf_dir):
    names = F.array(*map(F.lit, ("NONE", "PRED_CONTENT", "INS_DET", "MORPH_S", "DEL_CONTENT")))
    d = _docs(spark, sf_dir).select(F.get(names, (F.col("doc_id") % 5).cast("int")).alias("label"))
    return d.groupBy("label", L.label_group(F.col("label")).alias("label_group")).agg(F.count("*").alias("n"))


_SQL_REL = """case when {p} then 'IRREG'
 when (lo like '%s' and (left(lo, length(lo)-1) = sh or left(lo, length(lo)-1) || 'y' = sh or left(lo, length(lo)-1) = left(sh, greatest(length(sh)-1, 0))))
   or (lo like '%es' and (left(lo, length(lo)-2) = sh or left(lo, length(lo)-2) || 'y' = sh or left(lo, length(lo)-2) = left(sh, greatest(length(sh)-1, 0))))
   or (lo like '%ies' and (left(lo, length(lo)-3) = sh or left(lo, length(lo)-3) || 'y' = sh or left(lo, length(lo)-3) = left(sh, greatest(length(sh)-1, 0)))) then 'S'
 when lo like '%d' then 'ED' when lo like '%ing' or sh like '%ing' then 'ING' else 'OTHER' end"""


@query("morph_relation", f"with {SQL_TOKS}, p as (select distinct lag(tok) over (partition by doc_id order by i) as a, tok as b from toks), q as (select a, b, case when length(a) > length(b) then b else a end as sh, case when length(a) > length(b) then a else b end as lo from p where a is not null) select a, b, " + _SQL_REL.format(p="a = 'is' and b = 'was'") + " as relation from q")
def morph_relation(spark, sf_dir):
    p = K.with_neighbours(_toks(spark, sf_dir), "doc_id").where("prev <> '#'").select(F.col("prev").alias("a"), F.col("tok").alias("b")).distinct()
    same = (F.col("a") == "is") & (F.col("b") == "was")
    return p.select("a", "b", L.morph_relation(F.col("a"), F.col("b"), same).alias("relation"))


@query("attestation_lookup", f"""with {SQL_GRAMS}, u as (select token_2 as tok, sum(count) as u from grams group by 1), b as (select token_1, token_2, sum(count) as c from grams group by 1, 2),
c0 as (select item_id, unnest(a) as tok, generate_subscripts(a, 1) - 1 as i from (select item_id, regexp_extract_all(lower(text), '{WORD}') as a from benchmark)),
c as (select *, lag(tok, 1, '#') over w as prev, lead(tok, 1, '#') over w as next from c0 window w as (partition by item_id order by i))
select item_id, i, c.tok, round(ln(1 + coalesce(u.u, 0)), 6) as a_log_uni, (u.u is null)::int::double as a_unseen_uni, (l.c is null)::int::double as a_unseen_bi_left, (r.c is null)::int::double as a_unseen_bi_right
from c left join u on u.tok = c.tok left join b l on l.token_1 = c.prev and l.token_2 = c.tok left join b r on r.token_1 = c.tok and r.token_2 = c.next""")
def attestation_lookup(spark, sf_dir):
    ctx = K.with_neighbours(K.tokens(table(spark, sf_dir, "benchmark"), "item_id"), "item_id")
    a = K.attestation(ctx, K.ngrams(_docs(spark, sf_dir), 2).withColumnsRenamed({"token_1": "token_2", "token_0": "token_1"}), "item_id", "a")
    return a.select("item_id", F.col("i").cast("long").alias("i"), "tok", F.round("a_log_uni", 6).alias("a_log_uni"), "a_unseen_uni", "a_unseen_bi_left", "a_unseen_bi_right")


@query("token_types", f"""with {SQL_GRAMS}, u as (select token_2 as tok, sum(count) as u from grams group by 1)
select type, count(*) as n from (select case when regexp_full_match(tok, '[0-9]+') then 'number' when u = 1 then 'rare' when u < 10 then 'uncommon' else 'common' end as type from u) group by 1""")
def token_types(spark, sf_dir):
    u = K.marginal(K.ngrams(_docs(spark, sf_dir)), "token_2")
    kind = F.when(F.col("token_2").rlike("^[0-9]+$"), "number").when(F.col("count") == 1, "rare").when(F.col("count") < 10, "uncommon").otherwise("common")
    return u.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


_SQL_SURPRISAL = f"""{SQL_GRAMS}, ctx as (select token_0, token_1, sum(count) as c2 from grams group by 1, 2), v as (select count(distinct token_2) as v from grams),
s as (select token_0, token_1, token_2, -log2((count + 0.1) / (c2 + 0.1 * v)) as bits from grams join ctx using (token_0, token_1) cross join v),
tri as (select doc_id, i, coalesce(lag(tok, 2) over w, '#') as token_0, coalesce(lag(tok) over w, '#') as token_1, tok as token_2 from toks window w as (partition by doc_id order by i)),
scored as (select doc_id, i, token_2 as tok, bits from tri join s using (token_0, token_1, token_2))"""


def _vocabulary(docs):
    """The number of different words, as one row."""
    return docs.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("tok")).distinct().agg(F.count("*").alias("v"))


@query("ngram_surprisal", f"with {_SQL_SURPRISAL} select doc_id, i, round(bits, 6)::double as surprisal_bits from scored")
def ngram_surprisal(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    at = G.trigram_counts_at(docs).crossJoin(F.broadcast(_vocabulary(docs)))
    bits = F.floor(S.add_k_bits("c3", "c2", "v") * 1e6 + 0.5) / 1e6  # as SQL rounds what is not below 0; decimals of each word take longer than the rest
    return at.select("doc_id", F.col("i").cast("long").alias("i"), bits.alias("surprisal_bits"))


@query("essay_surprisal_summary", f"with {_SQL_SURPRISAL} select doc_id, count(*) as n_scored, round(avg(bits), 6)::double as mean_surprisal, round(coalesce(var_samp(bits), 0), 6)::double as var_surprisal, count(*) filter (bits >= 12) as n_high from scored group by 1")
def essay_surprisal_summary(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    e = G.text_summaries(docs, _vocabulary(docs), 0.1, 12.0)
    return e.select("doc_id", "n_scored", F.round("mean_surprisal", 6).alias("mean_surprisal"), F.round("var_surprisal", 6).alias("var_surprisal"), "n_high")


@query("tau_threshold", f"with {_SQL_SURPRISAL}, q as (select quantile_cont(n_chars, 0.6667) as cutoff from documents) select round(quantile_cont(bits, 0.9), 6)::double as tau, count(*) as n from scored join documents using (doc_id), q where n_chars >= cutoff")
def tau_threshold(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    cutoff = docs.agg(F.percentile("n_chars", 0.6667).alias("cutoff"))
    classes = G.trigram_count_classes(docs.crossJoin(F.broadcast(cutoff)), F.col("n_chars") >= F.col("cutoff"))
    scored = classes.crossJoin(F.broadcast(_vocabulary(docs))).withColumn("bits", S.add_k_bits("c3", "c2", "v"))
    return scored.agg(F.round(F.percentile("bits", 0.9, F.col("n")), 6).alias("tau"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("sufficient_stat_update", """with r as (select l_orderkey as k, count(*) as n, avg(l_quantity) as mean, coalesce(var_samp(l_quantity), 0) as var from lineitem group by 1),
d as (select l_orderkey as k, sum(l_discount) as d1, sum(2 * l_quantity * l_discount + l_discount * l_discount) as d2 from lineitem where l_linenumber <= 2 group by 1),
u as (select r.k, n, n*mean + coalesce(d1, 0) as s1, var*(n-1) + n*mean*mean + coalesce(d2, 0) as s2 from r left join d using (k))
select k, n, round(s1/n, 6) as mean, round(case when n > 1 then greatest(0, (s2 - s1*s1/n)/(n-1)) else 0 end, 6)::double as var from u""")
def sufficient_stat_update(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity", "l_discount", "l_linenumber")
    rows = li.groupBy("k").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.coalesce(F.var_samp("l_quantity"), F.lit(0.0)).alias("var"))
    deltas = li.where("l_linenumber <= 2").groupBy("k").agg(F.sum("l_discount").alias("d1"), F.sum(2 * F.col("l_quantity") * F.col("l_discount") + F.col("l_discount") * F.col("l_discount")).alias("d2"))
    u = S.apply_deltas(rows, deltas, "k")
    return u.select("k", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("policy_aggregation", "select l_orderkey, round(avg(first), 6) as first, round(avg(s), 6) as sum, round(avg(m), 6) as mean, round(avg(s) filter (k >= 2), 6) as sum_split from (select l_orderkey, l_partkey % 3 as g, list(l_tax order by l_linenumber, l_tax)[1] as first, sum(l_tax) as s, avg(l_tax) as m, count(*) as k from lineitem group by all) group by 1")
def policy_aggregation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = li.groupBy("l_orderkey", (F.col("l_partkey") % 3).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_tax"))), lambda x: x["l_tax"]).alias("losses"))
    p = S.policies(F.col("losses"))
    return w.groupBy("l_orderkey").agg(*[F.round(F.avg(v), 6).alias(k) for k, v in p.items()], F.round(F.avg(F.when(F.size("losses") >= 2, p["sum"])), 6).alias("sum_split"))


@query("fertility", f"with {SQL_TOKS} select doc_id, count(*) as n_words, sum(n)::bigint as n_subwords, round(sum(n) / count(*), 6) as fertility, count(*) filter (n >= 2) as split2, count(*) filter (n >= 3) as split3 from (select doc_id, ceil(length(tok) / 4)::bigint as n from toks) group by 1")
def fertility(spark, sf_dir):
    p = _toks(spark, sf_dir).select("doc_id", F.col("i").alias("word_i"), F.col("tok").rlike(r"^\p{L}+$").alias("is_alpha"), F.ceil(F.length("tok") / 4).alias("n"))
    return S.fertility(p, "doc_id").select("doc_id", "n_words", "n_subwords", F.round("fertility", 6).alias("fertility"), "split2", "split3")


@query("span_overlap_labels", f"""with t as (select item_id, i, st as start, st + length(tok) as stop from (select item_id, i, tok, sum(length(tok) + 1) over (partition by item_id order by i) - length(tok) - 1 as st from (
 select item_id, unnest(a) as tok, generate_subscripts(a, 1) - 1 as i from (select item_id, regexp_extract_all(lower(text), '{WORD}') as a from benchmark)))),
s as (select item_id, start as s, case when i % 14 = 0 then start else stop end as e from t where i % 7 = 0), g as (select *, coalesce(lag(stop) over (partition by item_id order by i), 0) as gap from t),
m as (select g.item_id, g.i, max((s.s < s.e and s.s < g.stop and s.e > g.start)::int) as err, max((s.s = s.e and g.gap <= s.s and s.s <= g.start)::int) as ins from g left join s on s.item_id = g.item_id group by all),
n as (select *, lag(err = 1 or ins = 1) over (partition by item_id order by i) as prev from m)
select item_id, i, case when err = 1 then 'ERR_TOK' when ins = 1 then 'ERR_INS' when prev then 'POST' else 'OK' end as gold from n""")
def span_overlap_labels(spark, sf_dir):
    t = K.tokens(table(spark, sf_dir, "benchmark"), "item_id")
    before = F.sum(F.length("tok") + 1).over(Window.partitionBy("item_id").orderBy("i")) - F.length("tok") - 1
    t = t.withColumn("start", before).withColumn("end", F.col("start") + F.length("tok")).withColumn("is_space", F.lit(False))
    spans = t.where("i % 7 = 0").select("item_id", F.col("start").alias("s"), F.when(F.col("i") % 14 == 0, F.col("start")).otherwise(F.col("end")).alias("e"))
    return Q.gold_labels(t, spans, "item_id").select("item_id", F.col("i").cast("long").alias("i"), "gold")


@query("similar_words")
def similar_words(spark, sf_dir):
    """Every word of the corpus with its eight nearest ones."""
    counts = _toks(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("c"))
    return L.similar_words(counts, "tok", "c", 8)


@query("line_wrap")
def line_wrap(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("words"))
    return b.select("item_id", F.explode(F.arrays_zip("words", Q.wrap_lines(F.col("words"), 60).alias("line"))).alias("x")).select("item_id", F.col("x.line").alias("line"), F.col("x.words").alias("word"))


@query("topk_probabilities", "with e as (select vec_id, unnest(embedding)::double as s, generate_subscripts(embedding, 1) - 1 as id from embeddings), m as (select vec_id, id, exp(s) / sum(exp(s)) over (partition by vec_id) as p from e) select vec_id, rank::int as rank, id, round(p, 6) as p from (select *, row_number() over (partition by vec_id order by p desc, id) as rank from m) where rank <= 5")
def topk_probabilities(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = Q.softmax(F.transform("embedding", lambda x: x.cast("double")))
    t = e.select("vec_id", F.posexplode(Q.topk(p, 5)).alias("r", "x"))
    return t.select("vec_id", (F.col("r") + 1).alias("rank"), F.col("x.id").cast("long").alias("id"), F.round("x.p", 6).alias("p"))


@query("entropy_bits", "with e as (select vec_id, unnest(embedding)::double as s from embeddings), m as (select vec_id, exp(s) / sum(exp(s)) over (partition by vec_id) as p from e) select vec_id, round(-sum(p * log2(p)), 6) as bits from m group by 1")
def entropy_bits(spark, sf_dir):
    p = Q.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(Q.entropy_bits(p), 6).alias("bits"))
