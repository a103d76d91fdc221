"""Personal data against the base patterns of the re module, candidate by candidate."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from petriflow.llm import personal_data

DOCS = "doc_id long, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if passes(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


HARD = [
    "a@b.c", "a@b.c.d@e.f", "@b.c", "a@b", "a@b.", "x a@b..c", "a.b+c%d-@x-y.co.uk.", "a@@b.c d@e.f", "é.a@b.c", "mailto:joe@x.org?", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "1.1.1.0255", "000000255.1.2.3",
    "1..2.3.4.5", "1.2.3.", ".1.2.3.4.", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "41111111111111111111111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 (499) 555-6503%%", "+1(4) ", "+12", "+123", "++1 23 456 789 01 ()",
    "+1 234 567 890 123 456", "+44 20 7946 0958+44 20 7946 0959", "5.5.5.5@1.1.1.1", "12345678901234.1.2.3", "日本 a@b.c 🙂 1.2.3.4 +1 234 567 8901", "", "no data here",
]


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice("0123456789" * 2 + "....@@++--  ()ab_%é🙂\n") for _ in range(400))


@pytest.fixture(scope="module")
def rows():
    return [*enumerate([*HARD, *(noise(i) for i in range(300)), None]), (3, "a@b."), (None, "z@y.x")]


def test_base_kinds_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("pii", "redacted", "kind", "spans", "a`b")}).repartition(3)
    assert personal_data.find(docs).columns == ["doc_id", "text", "kind", "spans", "a`b", "pii", "redacted"]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in personal_data.personal_digest(docs).collect()]
    want = []
    for d, t in rows:
        found = brute(t or "")
        want.append((d, *(sum(x[0] == k for x in found) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] + r[2] + r[3] + r[4] for r in want) > 300


def test_base_kinds_of_the_given_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in personal_data.personal_digest(docs).collect():
        base = [x for x in r.spans.split(",") if x and x.split(":")[0] in PATTERNS]
        assert base == [f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id] or "")]


def test_added_kinds_and_redaction(spark):
    texts = [
        "IBAN: GB82 WEST 1234 5698 7654 32 and more", "iban GB82 WEST 1234 5698 7654 33", "SSN 123-45-6789, ssn 000-45-6789", "Passport no. X1234567.", "account number: 12345678 and accountable 12345678", "see ftp://joe:pw@host.example.org:21/x",
        "http://example.org/a@b", "mailto:joe@x.org now", "my account is old", "passports 1234567", "Social Security #: 123456789",
    ]
    got = {r.doc_id: r for r in personal_data.find(spark.createDataFrame([*enumerate(texts)], DOCS)).collect()}
    found = lambda i: [(s.kind, texts[i][s.start : s.end]) for s in got[i].pii if s.kind in ("url", "account")]
    want = [
        [("account", "GB82 WEST 1234 5698 7654 32")], [], [("account", "123-45-6789")], [("account", "X1234567")], [("account", "12345678")], [("url", "ftp://joe:pw@host.example.org:21")],
        [], [("url", "mailto:joe@x.org")], [], [], [("account", "123456789")],
    ]
    assert [found(i) for i in range(len(texts))] == want
    assert got[2].redacted == "SSN [account], ssn 000-45-6789"
    assert got[7].redacted == "[url] now" and got[8].redacted == texts[8]


def test_empty_table(spark):
    assert personal_data.personal_digest(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("unit", ["1", "1.", "1 ", "a@", "@", "+1", "+1 ", "a://", "iban ", "x", "1.2.3.4.", "mailto:", "+.", "account 1 ", "://a"])
def test_long_texts_cost_in_proportion(unit):
    finder = personal_data.Finder(personal_data.CUES)
    took = []
    for n in (200_000, 800_000):
        text = unit * (n // len(unit))
        began = time.perf_counter()
        finder.spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.05)
