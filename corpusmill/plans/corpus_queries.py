"""Queries on document collections: counting, filtering, sampling, checking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import corpus as C
from corpusmill.operators import tokens as K
from corpusmill.plans.common import SQL_COUNT, SQL_GRAMS, SQL_PAIRS, SQL_TOKS, sql_bucket, table
from corpusmill.plans.registry import query


def _grams(spark, sf_dir):
    return K.ngrams(table(spark, sf_dir, "documents"))


def _pairs(spark, sf_dir):
    return K.dependency_pairs(table(spark, sf_dir, "documents"))


def _counted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("tokens", T.token_count(F.col("text")))


_SQL_COUNTED = f"counted as (select *, {SQL_COUNT} as tokens from documents)"


@query("top_trigrams", f"with {SQL_GRAMS} select * from grams where count >= 2 order by count desc, token_0, token_1, token_2 limit 20")
def top_trigrams(spark, sf_dir):
    return K.top(K.at_least(_grams(spark, sf_dir), 2), 20, F.desc("count"), "token_0", "token_1", "token_2")


@query("trigram_counts", f"with {SQL_GRAMS} select * from grams where count >= 2")
def trigram_counts(spark, sf_dir):
    return K.at_least(_grams(spark, sf_dir), 2)


@query("unigram_marginal", f"with {SQL_GRAMS} select token_2, sum(count)::bigint as count from grams group by 1")
def unigram_marginal(spark, sf_dir):
    return K.marginal(_grams(spark, sf_dir), "token_2")


@query("bigram_marginal", f"with {SQL_GRAMS} select token_1, token_2, sum(count)::bigint as count from grams group by 1, 2")
def bigram_marginal(spark, sf_dir):
    return K.marginal(_grams(spark, sf_dir), "token_1", "token_2")


@query("gram_invariant", f"with {SQL_GRAMS} select (select sum(count) from grams)::bigint as gram_total, (select count(*) from toks) as token_total")
def gram_invariant(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.sum(F.size(T.words(F.col("text")))).cast("long").alias("token_total"))
    return _grams(spark, sf_dir).agg(F.sum("count").alias("gram_total")).crossJoin(total)


@query("depgram_counts", f"with {SQL_PAIRS} select head_lemma, case when regexp_full_match(head_lemma, '[0-9]+') then 'NUM' else 'WORD' end as head_tag, relation, dependent_lemma, case when regexp_full_match(dependent_lemma, '[0-9]+') then 'NUM' else 'WORD' end as dependent_tag, count from pairs where count >= 2")
def depgram_counts(spark, sf_dir):
    return K.at_least(_pairs(spark, sf_dir), 2)


_SQL_ASSOC = f"""with {SQL_PAIRS}, h as (select head_lemma, sum(count)::double f1 from pairs group by 1), d as (select dependent_lemma, sum(count)::double f2 from pairs group by 1),
n as (select sum(count)::double n from pairs), j as (select *, count::double f from pairs join h using (head_lemma) join d using (dependent_lemma) cross join n where count >= 2)"""


@query("pmi_pairs", _SQL_ASSOC + " select head_lemma, relation, dependent_lemma, f, f1, f2, round(log2(f*n/(f1*f2)), 6) as pmi, round(log2(f*f*n/(f1*f2)), 6) as mi2, round(log2(f*f*f*n/(f1*f2)), 6) as mi3 from j")
def pmi_pairs(spark, sf_dir):
    a = K.association(_pairs(spark, sf_dir)).where("f >= 2")
    return a.select("head_lemma", "relation", "dependent_lemma", "f", "f1", "f2", *[F.round(c, 6).alias(c) for c in ("pmi", "mi2", "mi3")])


@query("logdice_pairs", _SQL_ASSOC + " select head_lemma, relation, dependent_lemma, round(14 + log2(2*f/(f1+f2)), 6) as log_dice, round(f/f1 - case when n = f1 then null else (f2-f)/(n-f1) end, 6) as delta_p from j")
def logdice_pairs(spark, sf_dir):
    a = K.association(_pairs(spark, sf_dir)).where("f >= 2")
    return a.select("head_lemma", "relation", "dependent_lemma", F.round("log_dice", 6).alias("log_dice"), F.round("delta_p", 6).alias("delta_p"))


@query("marginals_grouping_sets", f"with {SQL_PAIRS} select head_lemma, dependent_lemma, relation, sum(count)::bigint as count from pairs group by grouping sets ((head_lemma, relation), (dependent_lemma), (relation), ())")
def marginals_grouping_sets(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    sets = [[p.head_lemma, p.relation], [p.dependent_lemma], [p.relation], []]
    return p.groupingSets(sets, "head_lemma", "dependent_lemma", "relation").agg(F.sum("count").alias("count"))


@query("merge_corpora_counts", f"""with {SQL_TOKS}, b as (select unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as tok from conversations)
select tok, sum(c)::bigint as count from (select tok, count(*) c from toks group by 1 union all select tok, count(*) c from b group by 1) group by 1 having sum(c) >= 2""")
def merge_corpora_counts(spark, sf_dir):
    count = lambda t: table(spark, sf_dir, t).select(F.explode(T.words(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("count"))
    return K.at_least(count("documents").unionByName(count("conversations")).groupBy("tok").agg(F.sum("count").alias("count")), 2)


@query("vocabulary_ranks", f"with {SQL_TOKS} select tok, count(*) as count, row_number() over (order by count(*) desc, tok) as rank from toks group by 1 order by 3 limit 1000")
def vocabulary_ranks(spark, sf_dir):
    counts = K.marginal(_grams(spark, sf_dir), "token_2").withColumnRenamed("token_2", "tok")
    from pyspark.sql.window import Window

    best = K.top(counts, 1000, F.desc("count"), "tok")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "tok")))


@query("clean_token_count", f"select doc_id, {SQL_COUNT}::int as tokens, length(nfc_normalize(text))::int as composed_chars from documents")
def clean_token_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.token_count(F.col("text")).alias("tokens"), F.length(T.nfc(F.col("text"))).alias("composed_chars"))


@query("clean_text", r"""select doc_id, regexp_replace(list_aggregate(list_transform(string_split(regexp_replace(nfc_normalize(text), '[\t\r\x0b\x0c\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), 'string_agg', chr(10)), '^[ \n]+|[ \n]+$', '', 'g') as clean from documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("pii_replace", """select doc_id, replace(replace(replace(text || ' |||EMAIL_ADDRESS||| or |||PHONE_NUMBER||| at |||IP_ADDRESS|||', '|||EMAIL_ADDRESS|||', 'email@example.com'), '|||PHONE_NUMBER|||', '555-0100'), '|||IP_ADDRESS|||', '0.0.0.0') as clean from documents""")
def pii_replace(spark, sf_dir):
    marked = F.concat(F.col("text"), F.lit(" |||EMAIL_ADDRESS||| or |||PHONE_NUMBER||| at |||IP_ADDRESS|||"))
    return table(spark, sf_dir, "documents").select("doc_id", T.replace_pii(marked).alias("clean"))


@query("length_filter", f"with {_SQL_COUNTED} select doc_id, source, tokens::int as tokens from counted where tokens >= case when source in ('src0','src1','src2','src3','src4') then 100 else 50 end")
def length_filter(spark, sf_dir):
    least = F.when(F.col("source").isin("src0", "src1", "src2", "src3", "src4"), 100).otherwise(50)
    return _counted(spark, sf_dir).where(F.col("tokens") >= least).select("doc_id", "source", "tokens")


_CODE = " or ".join(f"starts_with(s, '{x}')" for x in T.CODE_STARTS)


@query("code_fraction", rf"""with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) as x from (select doc_id, case when doc_id % 3 = 0 then 'def f(x):' || chr(10) || '    return x' || chr(10) else '' end || text as text from documents)),
m as (select doc_id, x, regexp_replace(x, '^[\s\x1c-\x1f\x{{a0}}]+|[\s\x1c-\x1f\x{{a0}}]+$', '', 'g') as s from l)
select doc_id, round(sum(case when starts_with(x, '    ') or starts_with(x, chr(9)) or {_CODE} then length(s) else 0 end) / nullif(sum(length(s)), 0), 6) as fraction from m group by 1""")
def code_fraction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "def f(x):\n    return x\n").otherwise(""), F.col("text"))
    return docs.select("doc_id", F.round(T.code_fraction(text), 6).alias("fraction"))


@query("domain_filter", "select page_id, url from pages where contains(url, 'example1') or contains(url, 'site2') or contains(url, '.org')")
def domain_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    domain = F.parse_url("url", F.lit("HOST"))
    return pages.where(T.passes_domain_filter(domain, F.col("url"), ["example1", "site2", ".org"])).select("page_id", "url")


@query("hash_accept", f"select doc_id, {sql_bucket('doc_id', 's42')} as bucket from documents where {sql_bucket('doc_id', 's42')} < 2500")
def hash_accept(spark, sf_dir):
    docs = C.accept_by_hash(table(spark, sf_dir, "documents"), "doc_id", "s42", 2500)
    return docs.select("doc_id", T.hash_bucket(F.col("doc_id"), "s42").alias("bucket"))


@query("hash_split", "select doc_id, lang, case when row_number() over (partition by lang order by md5(doc_id::varchar || 'split'), doc_id) <= floor(count(*) over (partition by lang) * 0.7 + 0.5) then 'dev' else 'test' end as split from documents")
def hash_split(spark, sf_dir):
    return C.hash_split(table(spark, sf_dir, "documents"), "lang", "doc_id", "split").select("doc_id", "lang", "split")


@query("group_hash_sample", "select source, doc_id, pick from (select source, doc_id, row_number() over (partition by source order by md5(doc_id::varchar || 'v'), doc_id)::int as pick from documents) where pick <= 10")
def group_hash_sample(spark, sf_dir):
    return C.hash_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", "v", 10)


@query("stratified_hash_sample", "with q as (select lang, greatest(floor(200 * count(*) / (select count(*) from documents) + 0.5), 1) as quota from documents group by 1) select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5(doc_id::varchar || 'q'), doc_id) as r from documents) join q using (lang) where r <= quota")
def stratified_hash_sample(spark, sf_dir):
    return C.proportional_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", "q", 200).select("lang", "doc_id")


@query("balanced_draws", "with l as (select min(n) as least from (select count(*) n from labels group by quality)) select draw::int as draw, quality, doc_id from (select *, row_number() over (partition by quality, draw order by md5(doc_id || '|' || draw), doc_id) r from labels, unnest(range(0, 200)) t(draw)), l where r <= least")
def balanced_draws(spark, sf_dir):
    return C.balanced_draws(table(spark, sf_dir, "labels").select("quality", "doc_id"), "quality", "doc_id", 200).select("draw", "quality", "doc_id")


@query("shuffle_order", "select source, md5(source || 'shuffle') as key, row_number() over (order by md5(source || 'shuffle'))::int as place from (select distinct source from documents)")
def shuffle_order(spark, sf_dir):
    from pyspark.sql.window import Window

    key = T.hash_order(F.col("source"), "shuffle")
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", key.alias("key"), F.row_number().over(Window.orderBy(key)).alias("place"))


@query("stride_partition", "select doc_id % 8 as worker, count(*) as docs, min(doc_id) as first, max(doc_id) as last from documents group by 1")
def stride_partition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.pmod("doc_id", F.lit(8)).alias("worker")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("token_budget", f"with {_SQL_COUNTED} select source, doc_id, tokens::int as tokens, before::bigint as tokens_before from (select *, coalesce(sum(tokens) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from counted) where before < 5250")
def token_budget(spark, sf_dir):
    return C.token_budget(_counted(spark, sf_dir).select("source", "doc_id", "tokens"), "source", [F.col("doc_id")], "tokens", 5000)


@query("token_shards", f"with {_SQL_COUNTED} select doc_id, floor(coalesce(sum(tokens) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) / 2000)::bigint as shard from counted")
def token_shards(spark, sf_dir):
    from pyspark.sql.window import Window

    before = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return _counted(spark, sf_dir).select("doc_id", F.floor(F.coalesce(F.sum("tokens").over(before), F.lit(0)) / 2000).alias("shard"))


@query("verify_by_source", f"""with {_SQL_COUNTED} select source, count(*) as docs, sum(tokens)::bigint as tokens, round(sum(tokens) * 100.0 / 20000, 6)::double as pct_of_target, round(avg(tokens), 6) as mean_tokens, median(tokens) as median_tokens,
list_sort(list(tokens))[floor(count(*) * 0.05)::int + 1]::int as p5, list_sort(list(tokens))[floor(count(*) * 0.95)::int + 1]::int as p95, count(*) filter (tokens < 100) as short_docs, abs(sum(tokens) - 20000) <= 1000 as within_5pct from counted group by 1""")
def verify_by_source(spark, sf_dir):
    found = C.verify_by_source(_counted(spark, sf_dir), "source", "tokens", 20_000, 100)
    return found.withColumn("pct_of_target", F.col("pct_of_target").cast("double"))


@query("corpus_checks", "select count(*) as total_docs, count(*) filter (contains(text, '|||EMAIL_ADDRESS|||') or contains(text, '|||PHONE_NUMBER|||') or contains(text, '|||IP_ADDRESS|||')) as pii_remaining, count(*) filter (trim(coalesce(text, '')) = '') as empty_docs, count(*) - count(distinct doc_id) as duplicate_ids from documents")
def corpus_checks(spark, sf_dir):
    return C.corpus_checks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("preprocess_summary", f"with {_SQL_COUNTED} select source, count(*) filter (tokens >= 100) as docs, coalesce(sum(tokens) filter (tokens >= 100), 0)::bigint as tokens, count(*) filter (tokens < 100) as dropped from counted group by rollup (source)")
def preprocess_summary(spark, sf_dir):
    keep = F.col("tokens") >= 100
    return _counted(spark, sf_dir).rollup("source").agg(F.count_if(keep).alias("docs"), F.coalesce(F.sum(F.when(keep, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if(~keep).alias("dropped"))


@query("missing_labels_anti", "select doc_id from documents anti join labels using (doc_id)")
def missing_labels_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("resume_not_done", "select doc_id, w as window from documents, (values ('8'), ('64'), ('full')) t(w) where not (w = '8' and doc_id % 2 = 0)")
def resume_not_done(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    jobs = docs.withColumn("window", F.explode(F.array(*map(F.lit, ("8", "64", "full")))))
    done = docs.where("doc_id % 2 = 0").withColumn("window", F.lit("8"))
    return C.not_done(jobs, done, ["doc_id", "window"])


@query("manifest_upsert", "select lang, count(*) as docs, case when lang = 'en' then 'rerun' else 'first' end as run from documents group by 1 union all select 'xx', 0, 'rerun'")
def manifest_upsert(spark, sf_dir):
    now = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs")).withColumn("run", F.lit("first"))
    entry = now.where("lang = 'en'").withColumn("run", F.lit("rerun")).union(spark.sql("select 'xx', 0L, 'rerun'"))
    return C.upsert(now, entry, ["lang"])


@query("null_audit", "select * from (select 'doc_id' as column, count(*) - count(doc_id) as nulls, round(100.0 * (count(*) - count(doc_id)) / count(*), 6)::double as pct from j union all select 'quality', count(*) - count(quality), round(100.0 * (count(*) - count(quality)) / count(*), 6)::double from j union all select 'toxic', count(*) - count(toxic), round(100.0 * (count(*) - count(toxic)) / count(*), 6)::double from j)".replace("from j", "from (select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id))"))
def null_audit(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    found = C.null_audit(joined.select("doc_id", "quality", "toxic"))
    return found.withColumn("pct", F.col("pct").cast("double"))


@query("preview", "select doc_id, replace(substr(text, 1, 200), chr(10), ' ') as preview from documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("json_props", "select event_id, (props->>'$.k')::int as k from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("keyword_cards", r"select doc_id, lpad(replace(substr(text, greatest(p - 55, 1), p - greatest(p - 55, 1)), chr(10), ' '), 55, ' ') || '[[the]]' || replace(substr(text, p + 3, 40), chr(10), ' ') as card from (select doc_id, text, instr(text, 'the') as p from documents) where p > 0")
def keyword_cards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("p", F.instr("text", "the")).where("p > 0")
    return docs.select("doc_id", T.kwic(F.col("text"), F.col("p") - 1, F.lit("the"), 55, 40).alias("card"))
