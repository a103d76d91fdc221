"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, ``://``, ``mailto:`` and words that announce an identifier. A
deterministic parser of the anchor's kind then grows the span to its left and right, and a check of its own accepts or drops it. A parser never looks
again at what an earlier one of its kind has passed, so a text costs time in proportion to its length, whatever is in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petriflow.llm import textvec as tv
from petriflow.llm.textvec import quoted

#: In order: those of equal start are listed so. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Words that announce an identifier, and which identifier.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "passport": "passport", "account": "account", "acct": "account"}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_SCHEME = _LOCAL.replace("_", "").replace("%", "")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_PARTS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_DIALLED = re.compile(r"[ ().0-9-]++")
_LOGIN = re.compile(r"[^\s/?#@<>\"]++@([A-Za-z0-9.-]++)(?::[0-9]{1,5})?")
_AFTER_CUE = re.compile(r"(?:[ \t]*(?:number|num|no|nr|id)\b)?+[.:#= \t-]++", re.IGNORECASE)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_IDENTIFIER = {
    "ssn": re.compile(r"([0-9]{3})[ -]?([0-9]{2})[ -]?([0-9]{4})(?![0-9A-Za-z])"),
    "passport": re.compile(r"[A-Za-z]{0,2}[0-9]{6,9}(?![0-9A-Za-z])"),
    "account": re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9A-Za-z])"),
}
_LOWER = bytes(tv.LOWER)
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _in_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _iban_end(text: str, start: int) -> int:
    """The end of the longest account number from ``start`` whose check digits hold, or -1."""
    m = _IBAN.match(text, start)
    end = m.end() if m else start
    while end - start >= 15:
        if end == len(text) or not (text[end].isascii() and text[end].isalnum()):
            plain = text[start:end].replace(" ", "").upper()
            if len(plain) >= 15 and text[end - 1] != " " and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                return end
        end -= 1
    return -1


class Finder:
    def __init__(self, cues: dict[str, str]):
        self.cues = cues
        self.automaton = ahocorasick.Automaton()
        for anchor in ["@", "+", "://", "mailto:", *cues, *"0123456789"]:
            self.automaton.add_word(anchor, anchor)
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, index in `KINDS`, end), in order; end is past the last code point."""
        found: list[tuple[int, int, int]] = []
        mail = card = ip = url = 0  # what a kind's parser has passed
        for last, anchor in self.automaton.iter(text.encode().translate(_LOWER).decode()):
            if anchor.isdigit():
                if last >= card:
                    m = _CARD.match(text, last)
                    card = m.end()
                    if 14 <= card - last <= 37:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            found.append((last, 2, card))
                if last >= ip:
                    ip = _PARTS.match(text, last).end()
                    if ip - last >= 7:
                        found += self._addresses(text, last, ip)
            elif anchor == "@":
                start = mail + len(text[mail:last]) - len(self._tail(text[mail:last], _LOCAL))
                mail, m = last + 1, _DOMAIN.match(text, last + 1)
                if start < last and m:
                    mail = m.end()
                    found.append((start, 0, mail))
            elif anchor == "+":
                if text[last + 1 : last + 2] in tuple("0123456789"):
                    m = _DIALLED.match(text, last + 2)
                    rest = m[0].rstrip(" ().-") if m else ""
                    if len(rest) >= 2 and 10 <= 1 + len(_DIGITS.findall(rest)) <= 15:
                        found.append((last, 3, last + 2 + len(rest)))
            elif anchor == "://":
                at = last - 2
                scheme = self._tail(text[url:at], _SCHEME).lstrip("0123456789.+-")
                url, m = last + 1, _LOGIN.match(text, last + 1)
                if scheme and m and m[1].strip(".-"):
                    host = m.end() - len(m[0]) + len(m[0].rstrip(".-:"))
                    found.append((at - len(scheme), 4, host))
                    url = host
            elif anchor == "mailto:":
                if m := _ADDRESS.match(text, last + 1):
                    found.append((last - 6, 4, m.end()))
            else:
                found += self._announced(text, last + 1 - len(anchor), last + 1, self.cues[anchor])
        return sorted(set(found))

    @staticmethod
    def _tail(text: str, allowed: str) -> str:
        return text[len(text.rstrip(allowed)) :]

    @staticmethod
    def _addresses(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Of parts between dots every four in a row."""
        parts = text[start:end].split(".")
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(map(_in_byte, parts[i : i + 4])):
                yield start, 1, start + size
            start += size + 1

    @staticmethod
    def _announced(text: str, cue: int, end: int, kind: str) -> Iterator[tuple[int, int, int]]:
        if cue and text[cue - 1].isalnum() or not (m := _AFTER_CUE.match(text, end)):
            return
        start = m.end()
        if kind == "iban":
            stop = _iban_end(text, start)
            if stop > 0:
                yield start, 5, stop
        elif m := _IDENTIFIER[kind].match(text, start):
            if kind != "ssn" or m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                yield start, 5, m.end()


@lru_cache(maxsize=2)
def _finder(cues: tuple[tuple[str, str], ...]) -> Finder:
    return Finder(dict(cues))


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans that overlap become one mark, of the kind of the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _finding(cues: dict[str, str], kept: list[str]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(tuple(cues.items()))
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(len(kept)).to_pylist():
                found = finder.spans(text or "")
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
                texts.append(_redacted(text, found) if found else text)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(spans, kind), pa.array(texts, pa.string())], [*kept, "pii", "redacted"])

    return run


def find(docs: DataFrame, text: str = "text", cues: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``pii`` (array of kind, start, end in code points, end exclusive; by start, then kind as in `KINDS`) and ``redacted`` (the text with
    each stretch of spans replaced by its first kind in brackets).

    email, ip, card and phone are of one kind each leftmost and never overlap; a candidate that fails its check is dropped whole. url: an address
    with a login before its host, or ``mailto:``. account: a number after one of ``cues`` (word in lower case to iban, ssn, passport or account) with valid
    check digits or of the right form. Spans of different kinds may overlap. A null text has no spans and stays null, and so does an empty one. Each row is
    judged by itself, so repeated rows and ids have equal results; columns named like the results are replaced, all others kept. A
    text of n bytes costs about 10 n bytes of memory.
    """
    cues = CUES if cues is None else cues
    kept = [c for c in docs.columns if c == text or c.lower() not in ("pii", "redacted")]
    made = {"pii": "array<struct<kind:string,start:bigint,end:bigint>>", "redacted": "string"}
    return tv.beside(docs, kept, [F.col(quoted(text))], lambda names: _finding(cues, names), made)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_digest(docs: DataFrame) -> DataFrame:
    """The registered query: how many spans of each base kind, a digest of these, and all spans, of every document."""
    out = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
