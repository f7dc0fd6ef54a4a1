"""License scans: a positional index of the rarest words of licence templates."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, batch_of, require, small_batches

#: A-Z to a-z; bytes that are no part of a word to a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
)
_MIT = _MIT_GRANT + (
    " and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
    "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
    "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
    "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
    "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
    "performance of this software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
    "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = (
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
)
_BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
    "software even if advised of the possibility of such damage"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
    "following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a "
    "product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be "
    "misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
    "source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
_BOOST = (
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the "
    "software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
    "software is furnished to do so all subject to the following"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http "
    "www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)


def _gnu(name: str, version: str) -> str:
    """The notice that the licences of one family ask authors to put into their files."""
    return (
        f"this program is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either "
        f"version {version} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        f"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details"
    )


#: Well-known licences as published, whole where they are short, else the notice that they ask files to carry, and
#: short forms: label, text, phrases that must stand in the file. Fixed values.
TEMPLATES = (
    ("mit", _MIT, ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    ("mit", _MIT_GRANT, ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    ("isc", _ISC, ("with or without fee is hereby granted",)),
    ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL, ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL, ("redistribution and use in source and binary forms", "endorse or promote products derived from this software")),
    ("bsd-2-clause", _BSD_HEAD.strip(), ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", _BSD_NAMES.strip(), ("endorse or promote products derived from this software",)),
    ("zlib", _ZLIB, ("the origin of this software must not be misrepresented",)),
    ("unlicense", _UNLICENSE, ("unencumbered software released into the public domain",)),
    ("bsl-1.0", _BOOST, ("to use reproduce display distribute execute and transmit the software",)),
    ("apache-2.0", _APACHE, ("licensed under the apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", _gnu("general public license", "2"), ("gnu general public license", "version 2 of the license")),
    ("gpl-3.0", _gnu("general public license", "3"), ("gnu general public license", "version 3 of the license")),
    ("lgpl-2.1", _gnu("lesser general public license", "2 1"), ("gnu lesser general public license", "version 2 1 of the license")),
    ("lgpl-3.0", _gnu("lesser general public license", "3"), ("gnu lesser general public license", "version 3 of the license")),
    ("agpl-3.0", _gnu("affero general public license", "3"), ("gnu affero general public license", "version 3 of the license")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", ("dedicated the work to the public domain",)),
)


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    anchors: list[int] = field(default_factory=list)
    base: bool = False


class RareWordIndex:
    """Rarest words of each template -> (template, place in it).

    How rare a word is, is its inverse document frequency: of ``frequency``, the number of files that
    hold each, out of ``files``; among words that as many files hold, by how few templates have it.
    """

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, anchors: int = 12, share: float = 0.6, slack: int = 6, frequency: dict[bytes, int] | None = None, files: int = 0):
        """anchors: places of rarest words kept of a template. share: of its words that must be met. slack: words that may be put in or left out."""
        self.share, self.slack = share, slack
        self.templates = [Template(label, text.encode().split(), [k.encode().split() for k in keys]) for label, text, keys in templates]
        self.templates += [Template(label, text.encode().split(), [text.encode().split()], base=True) for text, label in phrases]
        found: dict[bytes, set[int]] = defaultdict(set)
        for i, t in enumerate(self.templates):
            for w in t.words:
                found[w].add(i)
        frequency = frequency or {}
        self.idf = {w: math.log((files + 1) / (frequency.get(w, 0) + 1)) + math.log(len(self.templates) / len(s)) / (files + len(self.templates)) for w, s in found.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            order = sorted(range(len(t.words)), key=lambda p: (-self.idf[t.words[p]], p))
            t.anchors = sorted(order if t.base else order[:anchors])
            for p in t.anchors:
                self.postings[t.words[p]].append((i, p))
        self.postings = dict(self.postings)

    @staticmethod
    def _stands(words: list[bytes], phrase: list[bytes], at: list[int]) -> bool:
        n = len(phrase)
        return any(words[p : p + n] == phrase for p in at)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """(first word, label) of each phrase; (first word, words, label, share of the template met) of each verified template."""
        get = self.postings.get
        votes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        where: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if (hits := get(word)) is not None:
                where[word].append(at)
                for i, p in hits:
                    votes[i][at - p].append(p)
        phrases, found = [], []
        for i, diagonals in votes.items():
            t = self.templates[i]
            if t.base:
                phrases += [(start, t.label) for start, met in diagonals.items() if len(met) == len(t.words)]
                continue
            starts = sorted(diagonals)
            k = 0
            while k < len(starts):
                # diagonals within the slack are one placement with words put in or left out
                end = k
                while end + 1 < len(starts) and starts[end + 1] - starts[k] <= self.slack:
                    end += 1
                met = {p for s in starts[k : end + 1] for p in diagonals[s]}
                if len(met) >= self.share * len(t.anchors):
                    best = max(starts[k : end + 1], key=lambda s: (len(diagonals[s]), -s))
                    lo, hi = max(0, best - self.slack), best + len(t.words) + self.slack
                    window = words[lo:hi]
                    if all(self._stands(window, key, [p for p, w in enumerate(window) if w == key[0]]) for key in t.keys):
                        offsets = range(-self.slack, self.slack + 1)
                        n = sum(any(0 <= best + p + o < len(words) and words[best + p + o] == w for o in offsets) for p, w in enumerate(t.words))
                        if n >= self.share * len(t.words):
                            found.append((max(0, best), len(t.words), t.label, n / len(t.words)))
                    k = end + 1
                else:
                    k += 1
        return sorted(phrases), sorted(found)


def word_files(docs: DataFrame, words, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many files each of the templates' words stands, and the number of files; added up in tasks, so a row a word and task crosses."""
    wanted = frozenset(words)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.update(wanted.intersection(text.translate(_FOLD).split()))
                held[b""] += 1
        yield batch_of(("word", "n"), (pa.binary(), pa.int64()), (list(held.keys()), list(held.values())))

    found = {bytes(r.word): r.n for r in docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """Find licence phrases and templates in every whole text.

    A first pass counts in how many files each of the templates' words stands, as the rarest of these are
    what a template is looked for by. Each word of a file is looked up in the index of them; the file's place
    less the template's is the same for all words of one occurrence, so what agrees on it is a
    placement; a placement counts once the template's mandatory phrases stand there and enough of
    its words do. Rows are independent: no text is shuffled, and the index is of fixed size.

    Returns ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.
    A null or empty text has no words, null places, empty labels and score 0; ids may be null or
    repeat; other columns are not read. ``score`` is the largest share of a template that was met.
    """
    require(docs, id=id_col, text=text_col)
    small_batches(docs.sparkSession)
    frequency, files = word_files(docs, RareWordIndex(templates, phrases).idf, text_col)
    index = RareWordIndex(templates, phrases, frequency=frequency, files=files)
    kind = dict(docs.dtypes)[id_col]
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
    names = (id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

    def scan(batches):
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                words = text.translate(_FOLD).split()
                base, found = index.scan(words)
                of_base = {label for _, label in base}
                spans = [dict(zip(("first_word", "n_words", "label", "share"), x, strict=True)) for x in found]
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(of_base)), ",".join(sorted(of_base | {x[2] for x in found})), max([1.0] * bool(base) + [x[3] for x in found], default=0.0), spans))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = (batch.column(0).type, *[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span)
            yield batch_of(names, types, [batch.column(0), *map(list, columns)])

    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word: long, n_words: long, label: string, share: double>>"
    return docs.select(id_col, text_col).mapInArrow(scan, schema)
