"""Token counts of documents: a broadcast table of frequent pre-token lengths, and worker caches for the rest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import as_texts, batch_of, require, small_batches
from corpusmill.llm.tokenizing import PreTokens, frequent_lengths

#: One table a worker process and tokenizer; tasks that the process runs later find it warm.
_TABLES: dict[str, PreTokens] = {}


def _table(path: str, frequent: dict[str, int]) -> PreTokens:
    if path not in _TABLES:
        _TABLES[path] = PreTokens(path, len, sum, frequent)
    return _TABLES[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text, as the library gives them without added special tokens.

    The first tier is a broadcast table of the lengths of frequent pre-tokens, bounded by the
    vocabulary; the second is each worker's cache of those it has encoded. Pre-tokens never leave
    their task: there is no shuffle.

    Returns ``id_col, n_bytes, n_tokens, over_limit``, one row for each row of ``docs``. A null or
    empty text has 0 bytes and 0 tokens; ids may be null or repeat; other columns are not read.
    """
    require(docs, id=id_col, text=text_col)
    small_batches(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer))
    kinds = dict(docs.select(id_col, text_col).dtypes)

    def count(batches):
        table = _table(tokenizer, frequent.value)
        for batch in batches:
            texts = as_texts(batch.column(1))
            tokens = [table.of(t) for t in texts]
            n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield batch_of(
                (id_col, "n_bytes", "n_tokens", "over_limit"),
                (batch.column(0).type, pa.int64(), pa.int64(), pa.bool_()),
                (batch.column(0), n_bytes, tokens, [n > limit for n in tokens]),
            )

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kinds[id_col]}, n_bytes long, n_tokens long, over_limit boolean")
