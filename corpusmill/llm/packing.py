"""Packing of token sequences: first-fit decreasing in randomised groups, by a tournament tree of free room."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_texts, batch_of, require, small_batches
from corpusmill.llm.tokenizing import PreTokens

#: Pieces that a randomised group has on average. A group costs at most about one part-filled sequence.
GROUP_PIECES = 8192

_TABLES: dict[str, PreTokens] = {}


def _ids(found: list[int]) -> bytes:
    return np.asarray(found, "<u4").tobytes()


def _table(path: str) -> PreTokens:
    if path not in _TABLES:
        _TABLES[path] = PreTokens(path, _ids, b"".join)
    return _TABLES[path]


class TournamentTree:
    """Bins' free room in the leaves, the larger of two children in each node; finds the first bin that fits in O(log bins)."""

    def __init__(self, capacity: int, bins: int = 1024):
        self.capacity, self.size, self.used = capacity, 1, 0
        while self.size < bins:
            self.size *= 2
        self.room = [0] * (2 * self.size)

    def _grow(self) -> None:
        leaves = self.room[self.size :]
        self.size *= 2
        self.room = [0] * self.size + leaves + [0] * len(leaves)
        for k in range(self.size - 1, 0, -1):
            self.room[k] = max(self.room[2 * k], self.room[2 * k + 1])

    def place(self, need: int) -> tuple[int, int]:
        """The first bin with room for ``need``, a new one where none has it, and the offset there."""
        room = self.room
        if need > self.capacity:
            raise ValueError("a piece is longer than a sequence")
        if room[1] >= need:
            k = 1
            while k < self.size:
                k = 2 * k if room[2 * k] >= need else 2 * k + 1
        else:
            if self.used == self.size:
                self._grow()
                room = self.room
            k = self.size + self.used
            room[k] = self.capacity
            self.used += 1
        offset = self.capacity - room[k]
        found, room[k] = k - self.size, room[k] - need
        while k > 1:
            k //= 2
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
        return found, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first; ties in the order given."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree = TournamentTree(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], offsets[i] = tree.place(int(lengths[i]))
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every whole text, end it with ``end_id``, and cut it at multiples of ``capacity``.

    Returns ``id_col, start, length, ids_crc32, doc_tokens``, a row for each piece; only these few
    numbers are shuffled later, never ids or texts.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    end = _ids([end_id])

    def cut(batches):
        table = _table(tokenizer)
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for row, text in enumerate(as_texts(batch.column(1))):
                ids = table.of(text) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
            yield batch_of(
                (id_col, "start", "length", "ids_crc32", "doc_tokens"),
                (batch.column(0).type, *[pa.int64()] * 4),
                (batch.column(0).take(pa.array(rows, pa.int64())), starts, lengths, sums, totals),
            )

    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Texts are cut only at multiples of ``capacity``. The pieces are dealt into groups by a hash of
    what they hold (so that a long text and a group of copies spread over many groups), about
    ``GROUP_PIECES`` to a group, and each group is packed alone by first-fit decreasing. Their number
    follows the number of rows and the bytes of long texts, so groups stay of about one size at any size of the corpus.

    Returns ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row a piece.
    A null or empty text is its end token alone; ids may be null or repeat; an empty table gives no
    rows; other columns are not read.
    """
    require(docs, id=id_col, text=text_col)
    if id_col in {"start", "length", "ids_crc32", "doc_tokens", "pack_group", "sequence_id", "offset"}:
        raise ValueError(f"the id column may not be named {id_col}")
    # a token of these vocabularies has over two bytes on average, so this counts about the pieces, or some more
    about = docs.agg(F.sum(1 + F.floor(F.coalesce(F.octet_length(text_col), F.lit(0)) / (2 * capacity)))).first()[0] or 0
    groups = max(1, -(-about // GROUP_PIECES))
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    pieces = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), id_col, "start", "ids_crc32", "doc_tokens"), F.lit(groups)))
    kind = dict(docs.dtypes)[id_col]

    def place(key, rows):
        lengths, starts, sums = (rows[c].to_numpy() for c in ("length", "start", "ids_crc32"))
        order = np.lexsort((sums, starts, -lengths))
        bins, offsets = np.empty_like(lengths), np.empty_like(lengths)
        bins[order], offsets[order] = first_fit_decreasing(lengths[order], capacity)
        rows = rows.drop_columns("pack_group")
        return rows.append_column("sequence_id", pa.array(bins * groups + key[0].as_py())).append_column("offset", pa.array(offsets))

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.groupBy("pack_group").applyInArrow(place, schema)
