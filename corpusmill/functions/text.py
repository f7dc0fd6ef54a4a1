"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as a word, in patterns that Java and DuckDB read alike.
WORD = r"[\p{L}\p{N}]+"

#: Placeholders of removed personal data, and what stands for them.
PII_REPLACEMENTS = {
    "|||EMAIL_ADDRESS|||": "email@example.com",
    "|||PHONE_NUMBER|||": "555-0100",
    "|||IP_ADDRESS|||": "0.0.0.0",
}

#: Beginnings of lines that are taken for code.
CODE_STARTS = ("{", "}", "<", "//", "/*", "#include", "import ", "def ", "class ", "function ", "var ", "let ", "const ", "return ", "if (", "for (", "while (")

#: White space as Python's str.split has it, and without the line feed.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_FLAT_SPACE = r"(?U)[\s\x1c-\x1f&&[^\n]]+"
_LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"


def words(text: Column) -> Column:
    """Lower-case words of a text, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of pieces between Unicode white space; 0 for an empty text."""
    return F.size(F.filter(F.split(text, _SPACE), lambda x: x != ""))


def replace_pii(text: Column) -> Column:
    for marker, value in PII_REPLACEMENTS.items():
        text = F.replace(text, F.lit(marker), F.lit(value))
    return text


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; Spark has no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space other than line feeds to one space."""
    return F.regexp_replace(text, _FLAT_SPACE, " ")


def strip_lines(text: Column) -> Column:
    """Take spaces off the ends of each line, then white space off the whole."""
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(lines, r"^[ \n]+|[ \n]+$", "")


def clean_text(text: Column, compose: bool = True) -> Column:
    """Placeholders replaced, composed, spaces collapsed, lines stripped."""
    text = replace_pii(text)
    return strip_lines(collapse_spaces(nfc(text) if compose else text))


def code_fraction(text: Column) -> Column:
    """Share of the stripped lines' characters that stand in lines that look like code; null where there are none."""
    stripped = lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")

    def is_code(x: Column) -> Column:
        found = F.startswith(x, F.lit("    ")) | F.startswith(x, F.lit("\t"))
        for start in CODE_STARTS:
            found = found | F.startswith(stripped(x), F.lit(start))
        return found

    lines = F.split(text, _LINE_END)
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(stripped(x)))
    code = F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(is_code(x), F.length(stripped(x))).otherwise(0))
    return F.try_divide(code.cast("double"), total.cast("double"))


def passes_code_filter(text: Column, most: float | None) -> Column:
    """Whether the code fraction is at most ``most``; a text without characters fails, no bound passes all."""
    return F.lit(True) if most is None else F.coalesce(code_fraction(text) <= most, F.lit(False))


def passes_domain_filter(domain: Column, url: Column, domains: Iterable[str]) -> Column:
    """Whether any of the domains is part of the domain or the url; no list passes all."""
    found, some = F.lit(False), False
    for d in domains:
        found, some = found | F.coalesce(F.contains(domain, F.lit(d)), F.lit(False)) | F.coalesce(F.contains(url, F.lit(d)), F.lit(False)), True
    return found if some else F.lit(True)


def hash_bucket(key: Column, seed: str, buckets: int = 10_000) -> Column:
    """The 128-bit md5 of key and seed modulo ``buckets``, exactly, in four parts of 32 bits."""
    h = F.md5(F.concat(key.cast("string"), F.lit(seed)))
    step = (1 << 32) % buckets
    out = F.lit(0).cast("long")
    for j in range(4):
        part = F.conv(F.substring(h, 1 + 8 * j, 8), 16, 10).cast("long")
        out = (out * step + part) % buckets
    return out


def hash_order(key: Column, seed: str) -> Column:
    """A random-looking order that any engine can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def preview(text: Column, size: int = 200) -> Column:
    return F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" "))


def kwic(text: Column, start: Column, word: Column, left: int = 55, right: int = 55) -> Column:
    """A word in context: the left side padded, the word in brackets, the right side; line feeds as spaces. ``start`` counts from 0."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    begin = F.greatest(start - left, F.lit(0))
    before = F.substring(flat, begin + 1, start - begin)
    after = F.substring(flat, start + F.length(word) + 1, F.lit(right))
    return F.concat(F.lpad(before, left, " "), F.lit("[["), word, F.lit("]]"), after)


def match_case(new: Column, old: Column) -> Column:
    """Capitalise the first letter where the other word has it so."""
    first = F.substring(old, 1, 1)
    is_upper = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(is_upper, F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)


def duration(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds, without leading parts that are 0."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))
