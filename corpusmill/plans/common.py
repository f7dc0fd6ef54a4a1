"""Tables, and SQL that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents are dealt to all cores if the files have fewer splits than there are, as small files may be one split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


WORD = r"[\p{L}\p{N}]+"

#: toks(doc_id, i, tok): words of documents from 0.
SQL_TOKS = f"""toks as (select doc_id, unnest(a) as tok, generate_subscripts(a, 1) - 1 as i
  from (select doc_id, regexp_extract_all(lower(text), '{WORD}') as a from documents))"""

#: grams(token_0, token_1, token_2, count): padded trigrams of documents.
SQL_GRAMS = f"""{SQL_TOKS},
grams as (select token_0, token_1, token_2, count(*) as count from (
  select coalesce(lag(tok, 2) over w, '#') as token_0, coalesce(lag(tok, 1) over w, '#') as token_1, tok as token_2
  from toks window w as (partition by doc_id order by i)) group by all)"""

#: pairs(head_lemma, relation, dependent_lemma, count): neighbouring words.
SQL_PAIRS = f"""{SQL_TOKS},
pairs as (select h as head_lemma, case when d like '%ly' then 'advmod' when d like '%ed' then 'dobj' when d like '%ing' then 'amod' else 'dep' end as relation,
  d as dependent_lemma, count(*) as count from (select lag(tok) over (partition by doc_id order by i) as h, tok as d from toks) where h is not null group by all)"""

#: sents(doc_id, sent, words): lines with words.
SQL_SENTS = f"""sents as (select * from (select doc_id, sent, regexp_extract_all(lower(line), '{WORD}') as words from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as sent from documents)) where len(words) > 0)"""

#: Number of pieces between Unicode white space.
SQL_COUNT = r"""len(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+'), lambda x: x <> ''))"""


def sql_bucket(key: str, seed: str, buckets: int = 10_000) -> str:
    h = f"md5({key}::varchar || '{seed}')"
    part = lambda j: f"('0x' || substr({h}, {1 + 8 * j}, 8))::bigint"
    step = (1 << 32) % buckets
    out = f"({part(0)} % {buckets})"
    for j in range(1, 4):
        out = f"(({out} * {step} + {part(j)}) % {buckets})"
    return out
