"""Ranked search against a plain loop, with classes of copies, ties at the edge of the list and items in several passes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from petriflow.llm import lexical_search
from petriflow.llm.lexical_search import search

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    out = []
    for i, t in items:
        scores = Counter()
        for w in set(terms(t)):
            df = sum(w in b for _, b, _ in bags)
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for row, (_, b, n) in enumerate(bags):
                if w in b:
                    scores[row] += weight * ((10**9 * b[w]) // (1000 * b[w] + 20 * (50 + 50 * n * n_docs // n_words)))
        best = sorted((-s, bags[r][0] is None, bags[r][0] or 0) for r, s in scores.items() if s > 0)[:k]
        out += [(i, rank + 1, None if none else d, -s) for rank, (s, none, d) in enumerate(best)]
    return out


def rows():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "Été", "zz9"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.randint(1, 40))) for i in range(200)]
    docs += [(1000 + i, "W1 w2,w2 rare") for i in range(70)] + [(500 + i, "w2 w1 rare! W2") for i in range(20)]  # a class larger than the list, twice over
    docs += [(7, "w1 w2 w2 rare"), (7, "w1 w2 w2 rare"), (None, "w1 w2 w2 rare"), (None, text(5)), (2000, None), (2001, ""), (2002, " \n!?"), (2003, "w3 " * 70_000 + "w4 w5"), (2004, "w3 " * 300)]
    items = [(f"i{i}", text(r.randint(1, 12))) for i in range(15)] + [("copies", "rare w1"), ("copies", "rare w2"), (None, "w3"), ("none", None), ("empty", ""), ("unknown", "nowhere"), ("long", " ".join(vocabulary))]
    return docs, items


def listed(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if isinstance(x, int) else str(x)) for x in r))


@pytest.mark.parametrize("most_terms", [lexical_search.MOST_TERMS, 30])
def test_search_against_brute_force(spark, most_terms, monkeypatch):
    docs, items = rows()
    monkeypatch.setattr(lexical_search, "CELLS", 300)
    d = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("item_id", "score", "rank", "n", "bag", "a`b")}).repartition(5)
    i = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("x") for c in ("doc_id", "score", "no", "key")})
    got = [tuple(r) for r in search(d, i, 50, most_terms=most_terms).collect()]
    assert listed(got) == listed(brute(docs, items, 50))
    assert max(r[1] for r in got if r[0] == "copies") == 50


def test_columns_by_name(spark):
    d = spark.createDataFrame([(5, "a b"), (6, "b")], "`the id` long, `te.xt` string")
    i = spark.createDataFrame([(1, "B")], "`no` int, q string")
    assert [tuple(r) for r in search(d, i, 1, "te.xt", "the id", "q", "no").collect()] == brute([(5, "a b"), (6, "b")], [(1, "B")], 1)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([("i", "a")], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (spark.createDataFrame([(1, None)], DOCS), items)):
        out = search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_bags_are_equal_bytes_for_equal_counts():
    for most in (3, 300, 70_000):
        words, times = np.array([1, 5, 9]), np.array([1, most, 2])
        bag = lexical_search._pack("<u2", words, times)
        assert bag == lexical_search._pack("<u2", words.copy(), times.copy())
        w, t = lexical_search._unpack("<u2", bag)
        assert w.tolist() == [1, 5, 9] and t.tolist() == [1, most, 2]
