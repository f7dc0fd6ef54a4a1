"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import require, small, written

#: Sketch size: a sketch has at most 2**LG_K registers, and a standard error of 3 per cent.
LG_K = 10

#: Estimates off the threshold by this share are not trusted either way (six standard errors).
BAND = 0.2

_LAST = (1 << 63) - 1


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``id, fp, site, line`` for each distinct line of a row that is long enough to count."""
    hashes = F.expr(f"array_distinct(transform(filter(split(text, '\\n'), x -> length(trim(x)) >= {min_chars}), x -> xxhash64(trim(x))))")
    return docs.select("id", "fp", "site", F.explode(hashes).alias("line"))


def line_spread(docs: DataFrame, min_sites: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Lines on at least ``min_sites`` sites, and the rows that hold them.

    HyperLogLog sketches of sites are merged by line, before and after the shuffle. An estimate far
    above the threshold decides; one near it is settled by an exact distinct count; others are out.
    Returns ``(line, first)`` with the least id that holds the line, and ``(id, fp, site, line)``.
    """
    sketches = _lines(docs, min_chars).groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("s"), F.min("id").alias("first"))
    near = sketches.select("line", "first", F.hll_sketch_estimate("s").alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND))
    near = written(near, "spread")
    holds = written(_lines(docs, min_chars).join(small(near.select("line")), "line"), "holders")
    doubtful = near.where(F.col("sites") <= min_sites * (1 + BAND)).select("line")
    exact = holds.join(doubtful, "line").groupBy("line", "site").agg(F.lit(1)).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line")
    sure = near.where(F.col("sites") > min_sites * (1 + BAND)).select("line")
    return written(near.select("line", "first").join(sure.union(exact), "line"), "boilerplate"), holds


def drop_boilerplate(docs: DataFrame, min_sites: int = 5, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Take lines that stand on ``min_sites`` sites or more out of all documents but the first.

    Lines are compared without the spaces around them; shorter ones than ``min_chars`` are not
    judged. The document of the least id that holds a line keeps it, so no passage leaves the corpus
    whole. Returns the columns of ``docs`` with the text that is left, and ``n_lines, n_removed``.

    A null text stays null, with 0 lines; an empty one has one, empty line; a null site is a site of
    its own; a null id counts as the greatest; rows that repeat are treated alike; an empty table
    gives no rows; other columns go through, whatever their names but for the two added.
    """
    require(docs, id=id_col, text=text_col, site=site_col)
    if {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError("n_lines and n_removed are added, and may not exist")
    ident = F.coalesce(F.col(id_col), F.lit(_LAST))
    text = F.col(text_col)
    print_of = F.xxhash64(text)
    base = docs.select(ident.alias("id"), print_of.alias("fp"), F.xxhash64(F.lit(3), F.col(site_col)).alias("site"), text.alias("text"))
    lines, holds = line_spread(base, min_sites, min_chars)
    gone = holds.join(small(lines), "line").where("id <> first").groupBy("id", "fp").agg(F.collect_set("line").alias("gone"))
    gone = written(gone, "gone")
    # a row is carried as one struct, so that no name of its columns clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), ident.alias("id"), print_of.alias("fp"))
    rows = rows.join(small(gone, F.size("gone") + 2), ["id", "fp"], "left")
    all_lines = F.split("text", "\n")
    left = F.when(F.col("gone").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(F.trim(x)))))
    rows = rows.withColumn("left", left)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    n_removed = F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines) - F.size("left")).cast("long")
    rows = rows.withColumns({"n_lines": n_lines, "n_removed": n_removed})
    new_text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join("left", "\n"))
    return rows.select(*[new_text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns], "n_lines", "n_removed")


def boilerplate_sql(min_sites: int = 5, min_chars: int = 20) -> str:
    """The same over ``documents``, with exact counts, for DuckDB."""
    return f"""
with d as (select doc_id, source, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, coalesce(source, chr(0)) as source, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
b as (select trim(line, ' ') as t, min(doc_id) as first from l where length(trim(line, ' ')) >= {min_chars}
      group by 1 having count(distinct source) >= {min_sites}),
k as (select l.doc_id, pos, line, (b.t is not null and l.doc_id <> b.first) as gone from l left join b on trim(l.line, ' ') = b.t)
select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text,
       count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed
from k group by doc_id"""
