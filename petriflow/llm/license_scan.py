"""License scans: fuzzy search for short notices.

Each notice may be met with a bounded number of edits. By the pigeonhole principle, of ``errors + 1`` pieces of a notice one
is left whole by ``errors`` edits, so an Aho-Corasick automaton over all pieces finds every place to look at; the regex
library then matches the notice there with that many errors at most and gives the span. Words that tell one notice from another (a
licence's name, a version's digits) must stand in the span whole and in order; edits belong to the rest. Exact base phrases are
found apart, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm import textvec as tv
from petriflow.llm.textvec import quoted

#: Phrases that count where their words stand in a row.
BASE: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices (words in lower case; those after a star must be met exactly) and their labels.
NOTICES: tuple[tuple[str, str], ...] = (
    ("licensed under the *apache license version *2 *0", "apache-2.0"),
    ("*apache license version *2 *0", "apache-2.0"),
    ("licensed under the *apache license version *1 *1", "apache-1.1"),
    ("apache software license version *1 *1", "apache-1.1"),
    ("licensed under the *mit license", "mit"),
    ("released under the *mit license", "mit"),
    ("the *mit *license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the *isc license", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the *gnu *general public license", "gpl"),
    ("*gnu *general public license version", "gpl"),
    ("*gnu *general public license version *2", "gpl-2.0"),
    ("*gnu *general public license version *3", "gpl-3.0"),
    ("gnu *lesser general public license", "lgpl"),
    ("gnu *library general public license", "lgpl"),
    ("gnu *affero general public license", "agpl"),
    ("gnu free *documentation license", "gfdl"),
    ("*mozilla public license version *2 *0", "mpl-2.0"),
    ("*mozilla public license v *2 *0", "mpl-2.0"),
    ("*mozilla public license version *1 *1", "mpl-1.1"),
    ("released under the *mpl license", "mpl"),
    ("*eclipse public license version *1 *0", "epl-1.0"),
    ("*eclipse public license v *1 *0", "epl-1.0"),
    ("*eclipse public license version *2 *0", "epl-2.0"),
    ("*eclipse public license v *2 *0", "epl-2.0"),
    ("common *development and *distribution license", "cddl"),
    ("*boost software license version *1 *0", "bsl-1.0"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under the *bsd license", "bsd"),
    ("released under the *bsd license", "bsd"),
    ("the *artistic license *2 *0", "artistic-2.0"),
    ("licensed under the *zlib license", "zlib"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("sil open *font license", "ofl"),
    ("creative commons *attribution", "cc"),
    ("creative commons *zero", "cc0"),
    ("licensed under *cc *by *nc", "cc-by-nc"),
    ("licensed under *cc *by *nd", "cc-by-nd"),
    ("licensed under *cc *by *sa", "cc-by-sa"),
    ("licensed under *cc *by *nc *nd", "cc-by-nc-nd"),
    ("licensed under *cc *by *nc *sa", "cc-by-nc-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
    ("spdx *license *identifier *mit", "mit"),
    ("spdx *license *identifier *isc", "isc"),
    ("spdx *license *identifier *apache *2 *0", "apache-2.0"),
    ("spdx *license *identifier *gpl *2 *0", "gpl-2.0"),
    ("spdx *license *identifier *gpl *3 *0", "gpl-3.0"),
    ("spdx *license *identifier *lgpl", "lgpl"),
    ("spdx *license *identifier *agpl", "agpl"),
    ("spdx *license *identifier *mpl *2 *0", "mpl-2.0"),
    ("spdx *license *identifier *bsd", "bsd"),
)
#: Headers that a file begins with and identifiers as they stand alone: exact words, at the start of a line or of the text, that make up all of it.
HEADERS: dict[str, str] = {"mit license": "mit", "the mit license": "mit", "isc license": "isc", "apache 2 0": "apache-2.0", "mpl 2 0": "mpl-2.0", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "epl 2 0": "epl-2.0", "bsd 3 clause license": "bsd", "bsd 2 clause license": "bsd"}
#: One edit for so many characters, rounded down, at most ``MOST_ERRORS``; notices shorter than that allow one.
PER_ERROR, MOST_ERRORS = 12, 4

#: To lower case, and anything but letters, digits and non-ASCII to a space.
_FOLD = bytes((0x20 if not tv.ALNUM[b] else int(tv.LOWER[b])) for b in range(256))


def errors_for(notice: str) -> int:
    return min(MOST_ERRORS, max(1, len(notice) // PER_ERROR))


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors + 1`` parts of the notice of nearly equal length."""
    n = errors + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...]):
        self.notices = tuple((n.replace("*", ""), label) for n, label in notices)
        self.exact = [tuple(w[1:] for w in n.split() if w[0] == "*") for n, _ in notices]
        self.errors = [errors_for(n) for n, _ in self.notices]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n, special_only=True)}){{e<={e}}}") for (n, _), e in zip(self.notices, self.errors, strict=True)]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _) in enumerate(self.notices):
            for offset, piece in pieces(n, self.errors[i]):
                where.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), tuple(places)))
        self.automaton.make_automaton()

    def _told_apart(self, i: int, text: str, start: int, end: int) -> bool:
        """Whether the words that the span touches have the notice's exact ones, in order."""
        if not self.exact[i]:
            return True
        left, right = text.rfind(" ", 0, start + 1) + 1, text.find(" ", max(end - 1, 0))
        words = iter(text[left : right if right >= 0 else len(text)].split())
        return all(any(w == x for w in words) for x in self.exact[i])

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of the notices in a folded text; of overlapping ones of one notice the first."""
        found, until = [], {}
        looks = sorted({(i, max(0, end + 1 - size - offset - self.errors[i])) for end, (size, places) in self.automaton.iter(text) for i, offset in places})
        for i, start in looks:
            e = self.errors[i]
            stop = min(len(text), start + len(self.notices[i][0]) + 3 * e)
            start = max(start, until.get(i, 0))  # a look may begin before the end of the match before it
            hit = self.patterns[i].search(text, start, stop) if start < stop else None
            if hit and self._told_apart(i, text, hit.start(), hit.end()):
                found.append((i, hit.start(), hit.end(), sum(hit.fuzzy_counts)))
                until[i] = hit.end()
        return found


@lru_cache(maxsize=2)
def _scanner(notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(notices)


def _places(words: str, phrase: str) -> list[int]:
    """Character starts of a phrase in words that stand between single spaces; places may overlap."""
    out, at = [], words.find(f" {phrase} ")
    while at >= 0:
        out.append(at + 1)
        at = words.find(f" {phrase} ", at + 1)
    return out


def _scanning(notices: tuple[tuple[str, str], ...], base: dict[str, str], kept: list[str]):
    kind = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, longest = _scanner(notices), max(map(len, HEADERS))
        for batch in batches:
            counts, exact, fuzzy, scores = [], [], [], []
            for raw in batch.column(len(kept)).cast(pa.large_binary()).to_pylist():
                parts: list[bytes] = []
                heads = []
                for line in (raw or b"").split(b"\n"):  # words never go on in the next line
                    own = line.translate(_FOLD).split()
                    if 0 < len(own) <= 4 and sum(map(len, own)) < longest and (label := HEADERS.get(b" ".join(own).decode())):
                        heads.append((label, len(parts), len(parts) + len(own)))
                    parts += own
                counts.append(len(parts))
                joined = b" ".join(parts).decode()
                text = f" {joined} "
                starts = np.cumsum([1, *(len(w) + 1 for w in joined.split(" "))])[:-1] if parts else np.empty(0, np.int64)
                word = lambda at, starts=starts: int(np.searchsorted(starts, at, "right")) - 1
                exact.append([{"label": label, "start_word": word(at), "end_word": word(at) + phrase.count(" ") + 1, "errors": 0} for phrase, label in base.items() for at in _places(text, phrase)])
                near, best = [{"label": label, "start_word": i, "end_word": j, "errors": 0} for label, i, j in heads], 1.0 if exact[-1] or heads else 0.0
                for i, a, b, e in scanner.matches(text):
                    while text[a] == " ":
                        a += 1
                    while text[b - 1] == " ":
                        b -= 1
                    near.append({"label": scanner.notices[i][1], "start_word": word(a), "end_word": word(b - 1) + 1, "errors": e})
                    best = max(best, 1 - e / len(scanner.notices[i][0]))
                fuzzy.append(near)
                scores.append(best)
            made = [pa.array(counts, pa.int64()), pa.array(exact, kind), pa.array(fuzzy, kind), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *made], [*kept, "n_words", "phrases", "notices", "score"])

    return run


def scan(docs: DataFrame, text: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES, base: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with n_words, phrases and notices (arrays of label, start_word, end_word, errors) and score.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII; null and empty texts have none. phrases are
    exact; notices may differ by insertions, deletions and substitutions, one for each ``PER_ERROR`` characters; words are counted
    from 0 and end_word is past the last. A line that is one of `HEADERS` and nothing else is a notice too. score: the best match's share of characters without an error, 0 without a match.
    Notices of one label or of several may overlap; equal places of one notice count once. Columns named like the results are
    replaced, all others kept. A text of n bytes costs about 10 n bytes of memory.
    """
    base = BASE if base is None else base
    kept = [c for c in docs.columns if c == text or c.lower() not in ("n_words", "phrases", "notices", "score")]
    spans = "array<struct<label:string,start_word:bigint,end_word:bigint,errors:int>>"
    made = {"n_words": "long", "phrases": spans, "notices": spans, "score": "double"}
    return tv.beside(docs, kept, [F.col(quoted(text))], lambda names: _scanning(notices, base, names), made)


def license_digest(docs: DataFrame) -> DataFrame:
    """The registered query: base phrases and all labels of every document."""
    out = scan(docs.select("doc_id", "text"))
    starts, label = F.col("phrases.start_word"), lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), label(F.col("phrases.label")).alias("base_labels"), label(F.concat("phrases.label", "notices.label")).alias("labels"), "score", F.size("notices").alias("n_notices"))
