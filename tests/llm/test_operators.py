"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from petriflow.llm import decontaminate, language_id, license_scan, ngram_join, piece_transducer, quality_rules, quality_svm, range_coder, shuffle_shards, substring_dedup, token_files

DOCS = "doc_id long, text string"
#: Every operator's result columns, to clash with.
CLASH = ("n_words", "kept_text", "spans", "items", "score", "failed", "shard", "slot", "ids", "lang_pred", "class_id", "_text", "_key", "_w", "labels", "ordinal", "n_removed")


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) for _ in range(n))


def corpus():
    base, shared = words(1, 80), words(99, 30)
    near = base.split()
    near[40] = "changed"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one two three"), (7, words(2, 60) + " " + shared),
        (8, shared + "\n" + words(3, 50)), (9, "é ü 日本 🙂 " + words(4, 40)), (10, words(5, 3000)), (11, "a b c a b c a b c\nx\nx\n\nx"), (11, "a b c a b c a b c\nx\nx\n\nx"), (12, "one two three"), (None, base), (13, "#*$ %&|<> word"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


# --- quality rules


def test_rules_against_brute_force(docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_digest(docs).collect())
    want = []
    for d, t in corpus():
        w, places, covered = spaced(t), {}, set()
        for i in range(len(w) - 2):
            places.setdefault(tuple(w[i : i + 3]), []).append(i)
        for p in places.values():
            if len(p) > 1:
                covered |= {i + j for i in p for j in range(3)}
        lines = [x for x in (t or "").split("\n") if spaced(x)]
        want.append((d if d is not None else -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want)


def test_policies_and_ablations(docs, none):
    led = quality_rules.ledger(docs)
    assert set(docs.columns) - {"n_words", "failed", "_text", "_w"} <= set(led.columns)
    kept = {p: quality_rules.apply_policy(led, p).where("kept").count() for p in quality_rules.POLICIES}
    assert kept["base"] >= kept["v1"] >= kept["v2"]
    for r in quality_rules.ablations(led).collect():
        assert r.n_docs == 16 and r.n_kept == kept[r.policy] and r.n_kept_without >= r.n_kept
        rest = tuple(b for b in quality_rules.POLICIES[r.policy] if quality_rules.RULES[b][0] != r.rule)
        assert quality_rules.apply_policy(led, rest).where("kept").count() == r.n_kept_without
    assert quality_rules.quality_digest(none).count() == 0


def test_ablations_of_own_rules(docs):
    rules = {0: ("short", "n_words < 3"), 3: ("loud", "n_upper > 0")}
    led = quality_rules.ledger(docs, rules=rules).withColumn("n", F.lit(1))
    rows = {x.rule: x for x in quality_rules.ablations(led, {"p": (0, 3)}, rules).collect()}
    masks = [x.failed for x in led.collect()]
    for bit, (name, _) in rules.items():
        hit = [m for m in masks if m >> bit & 1]
        both = None
        for m in hit:
            both = m if both is None else both & m
        x = rows[name]
        assert (x.n_docs, x.n_failed, x.always_with) == (len(masks), len(hit), both)
        assert (x.n_kept, x.n_kept_without) == (masks.count(0), sum(m & ~(1 << bit) == 0 for m in masks))


def test_a_filter_on_the_ledger_keeps_a_small_plan(docs):
    plan = quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 3


# --- near duplicates


def test_near_duplicates_against_all_pairs(docs, none):
    rows = corpus()
    sets = [{tuple(spaced(t)[i : i + 5]) for i in range(max(1, len(spaced(t)) - 4))} if spaced(t) else set() for _, t in rows]
    links = [sum(1 for j in range(len(rows)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect())
    assert got == sorted((-1 if d is None else d, n) for (d, _), n in zip(rows, links, strict=True))
    by = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    assert by[0].class_id == by[1].class_id == by[2].class_id == by[None].class_id == 0
    assert (by[1].copy_of, by[2].copy_of, by[12].class_id, by[3].class_id, by[4].n_links) == (0, 2, 6, 3, 0)
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect())
    assert kept == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13]
    assert ngram_join.near_duplicates(none).count() == 0


def _near(word):
    w = words(41, 90).split()
    return " ".join([f"{x}{word}" for x in w]), " ".join([f"{x}{word}" for x in w[:-1]] + ["changed"])


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    (a, a2), (b, b2), (c, c2) = _near("a"), _near("b"), _near("c")
    d = spark.createDataFrame([(1, a), (1, b), (2, a2), (3, b2), (None, c), (None, c2), (None, c)], DOCS)
    got = sorted(((r.doc_id or 0), r.class_id or 0, r.n_links, r.n_linked_texts, r.n_copies) for r in ngram_join.near_duplicates(d).collect())
    assert got == [(0, 0, 2, 1, 1), (0, 0, 2, 1, 2), (0, 0, 2, 1, 2), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (2, 1, 1, 1, 1), (3, 1, 1, 1, 1)]
    left = sorted((r.doc_id or 0, r.text) for r in ngram_join.one_of_each(d).collect())
    assert [x for x in left if x[0]] == sorted([(1, a), (1, b)]) and len(left) == 3


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    (a, a2), (b, _) = _near("a"), _near("b")
    d = spark.createDataFrame([(1, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "z"), (1, a2, "x"), (7, "", "e"), (7, None, "e")], DOCS + ", `o.k` string")
    kept = ngram_join.one_of_each(d)
    assert kept.columns == ["doc_id", "text", "o.k"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, a if (1, a) in got else a2), (5, b), (7, ""), (7, None)]))


def test_every_near_pair_of_the_given_tables_is_found():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the given tables are not here")
    import pyarrow as pa

    from petriflow.llm import textvec as tv

    t = pq.read_table(path, columns=["doc_id", "text"])
    bands, rows = ngram_join.bands_for(ngram_join.THRESHOLD, ngram_join.RECALL)
    batch = pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("doc_id").combine_chunks(), t.column("text").combine_chunks()], ["id", "key", "text"])
    signed = [r for b in ngram_join._signatures(5, bands, rows)(iter([batch])) for r in b.to_pylist()]
    sets = []
    for _, data, offsets in tv.blocks(t.column("text")):
        owner, grams = ngram_join.gram_sets(data, offsets, 5)
        sets += [set(grams[owner == i].tolist()) for i in range(len(offsets) - 1)]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = {}
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                shared[h[y], h[x]] = shared.get((h[y], h[x]), 0) + 1
    near = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    assert len(near) > 50 and all(set(signed[i]["bands"]) & set(signed[j]["bands"]) for i, j in near)


def test_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    base = words(7, 120).split()
    texts = []
    for i in range(40):
        w = list(base)
        w[3 * i % 117] = f"odd{i}"
        texts.append((i, " ".join(w)))
    got = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(texts, DOCS)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in texts]
    for i in range(40):
        assert got[i].n_links == sum(1 for j in range(40) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
        assert got[i].class_id == 0


@pytest.mark.parametrize("block_grams", [20, 60, 150])
def test_links_count_once_when_a_block_is_empty(spark, monkeypatch, block_grams):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block_grams)
    base = words(17, 104).split()
    rows = []
    for pair in range(4):
        w = [f"{x}{pair}" for x in base]
        rows += [(2 * pair, " ".join(w)), (2 * pair + 1, " ".join([*w[:-1], "changed"]))]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_linked_texts) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (i - i % 2, 1, 1) for i in range(8)}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.9, 0.99)):
        b, r = ngram_join.bands_for(threshold, recall)
        assert b * r <= ngram_join.MOST_HASHES and 1 - (1 - threshold**r) ** b >= recall


# --- decontamination


def hits(rows, items):
    out = []
    for d, t in rows:
        w, hit, found = alnum(t), set(), set()
        for i, x in items:
            y = alnum(x)
            n = min(10, len(y))
            for j in range(len(y) - n + 1) if y else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == y[j : j + n]:
                        hit.update(range(k, k + n))
                        found.add(i)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((-1 if d is None else d, len(w), len(hit), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_decontamination_against_brute_force(spark, docs, none, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST", most)
    shared = words(99, 30)
    items = [(100, shared), (7, shared.upper()), (3, "One, two three!"), (4, None), (5, ""), (None, "zeta"), (100, shared), (8, words(98, 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs, bench).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, sum(b - a for a, b in r.spans), decontaminate.sha_of(list(r["items"]))) for r in out)
    assert got == hits(corpus(), items)
    assert decontaminate.contamination_digest(none, bench).count() == 0
    assert decontaminate.contamination_digest(docs, bench.where("item_id = 0")).where("contaminated").count() == 0
    long_only = bench.where("item_id = 100")
    assert {r.doc_id for r in decontaminate.clean(docs, long_only).collect()} == {d for d, _ in corpus()} - {7, 8}


def test_winnowing_finds_every_shared_span(spark):
    for seed in range(40):
        r = random.Random(seed)
        shared = words(1000 + seed, 10)
        doc = words(seed, r.randint(0, 30)) + " " + shared + " " + words(seed + 500, r.randint(0, 30))
        item = words(seed + 900, r.randint(0, 30)) + " " + shared + " " + words(seed + 700, r.randint(0, 30))
        got = decontaminate.contamination(spark.createDataFrame([(1, doc)], DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")).first() if seed < 3 else None
        prints = []
        for t in (doc, item):
            raw = np.frombuffer(t.encode(), np.uint8)
            h, text, _ = decontaminate._split(raw, np.array([0, len(raw)]))
            prints.append({*decontaminate.fingerprints(h, text, 10, 5, ())[1].tolist()})
        assert prints[0] & prints[1]
        assert got is None or got.spans


def test_a_phrase_below_a_window_makes_no_pairs(spark, monkeypatch):
    made = []
    met = decontaminate._met
    monkeypatch.setattr(decontaminate, "_met", lambda *a: (lambda out: (made.append(out.count()), out)[1])(met(*a)))
    phrase, passage = words(99, 9), words(98, 14)
    rows = [(i, f"d{i} {phrase} e{i} {words(i, 6)} f{i}" + f" {passage}" * (i < 3)) for i in range(400)]
    items = [(i, f"a{i} {phrase} b{i} c{i}" + f" {passage}" * (i < 2)) for i in range(300)]
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), decontaminate.sha_of(list(r["items"]))) for r in got) == hits(rows, items)
    # Fingerprints that an item has, windows that an item has, and sets of items: none by document and item.
    assert made[0] <= 400 * 10 and made[1:] == [3 * 5, 3]


def test_a_passage_in_every_document_is_compared_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    shared = words(99, 14)
    rows = [(i, f"{words(i, 20)} {shared} {words(i + 500, 5)}") for i in range(200)]
    items = [(1, shared), (2, words(3, 4) + " " + shared)]
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), decontaminate.sha_of(list(r["items"]))) for r in got) == hits(rows, items)


def test_rows_of_one_id_are_decontaminated_by_their_own_texts(spark):
    shared = words(99, 14)
    d = spark.createDataFrame([(1, shared, 5), (1, words(4, 20), 6), (None, shared, 7), (1, shared, 8)], DOCS + ", `spans.x` int")
    bench = spark.createDataFrame([(1, shared)], "item_id long, text string")
    kept = decontaminate.clean(d, bench)
    assert kept.columns == ["doc_id", "text", "spans.x"] and [r["spans.x"] for r in kept.collect()] == [6]
    assert sorted((r["spans.x"], len(r.spans)) for r in decontaminate.contamination(d, bench).collect()) == [(5, 1), (6, 0), (7, 1), (8, 1)]


# --- substrings


def test_substrings_against_brute_force(docs, none):
    rows = corpus()
    least = {}
    for d, t in rows:
        w = spaced(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, 1 << 70), d if d is not None else 1 << 69)
    want = []
    for d, t in rows:
        w, gone = spaced(t), set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < (d if d is not None else 1 << 69):
                gone.update(range(i, i + 13))
        want.append((-1 if d is None else d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated(docs).collect())
    assert got == sorted(want)
    assert substring_dedup.substring_digest(none).count() == 0
    assert substring_dedup.substring_digest(docs.where("doc_id in (0, 10)")).where("n_removed > 0").count() == 0


def test_substrings_do_not_depend_on_flushes(spark, docs, monkeypatch):
    one = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_digest(docs.where("doc_id is not null")).collect()}
    again = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_digest(docs.where("doc_id is not null").repartition(7)).collect()}
    assert one == again


def test_substrings_of_many_copies_meet_as_one_entry_a_group(spark, monkeypatch):
    judge, n = substring_dedup._repeated, 2000
    text = words(8, 20)

    def watched(*args):
        inner = judge(*args)

        def run(bucket):
            held = sum(len(x) for x in bucket.hashes) // 8
            assert held < 100, f"{held} occurrences in one bucket"
            return inner(bucket)

        return run

    monkeypatch.setattr(substring_dedup, "_repeated", watched)
    rows = [(i, text) for i in range(n)] + [(n, words(9, 15) + " " + text)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeated(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: (20, 0), **{i: (20, 20) for i in range(1, n)}, n: (35, 20)}


# --- sharding


def test_shards_are_exact_and_stable(docs, none):
    out = shuffle_shards.shuffle_shards(docs.withColumn("_r", F.monotonically_increasing_id()), 5, ["doc_id"], bucket_rows=3).collect()
    assert len(out) == 16
    sizes = sorted(sum(r.shard == s for r in out) for s in range(5))
    assert sizes == [3, 3, 3, 3, 4]
    for s in range(5):
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))
    a, b = ({(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in shuffle_shards.shard_digest(d.where("doc_id <> 11")).collect()} for d in (docs, docs.repartition(1)))
    assert a == b
    assert shuffle_shards.shard_digest(none).count() == 0
    crc = {r.doc_id: (r.size, r.text_crc32) for r in shuffle_shards.shard_digest(docs).collect()}
    assert crc[3] == (1, 0) and crc[6] == (14, zlib.crc32(b"one two three"))


def test_the_query_shards_whole_documents(docs, monkeypatch):
    given, shuffle = [], shuffle_shards.shuffle_shards

    def watched(df, *args, **more):
        given.append({*df.columns})
        return shuffle(df, *args, **more)

    monkeypatch.setattr(shuffle_shards, "shuffle_shards", watched)
    out = shuffle_shards.shard_digest(docs)
    assert given == [{"doc_id", "text"}]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert all("crc32" not in x for x in plan[1:] if "Window" in x or "Sort" in x)
    assert sum("crc32" in x for x in plan) == 1 and "crc32" in plan[0]  # above both permutations


def test_communication_matrix_has_its_sums_and_the_right_mean():
    rows, shards = np.array([5, 0, 7, 8]), np.array([10, 6, 4])
    total = np.zeros((4, 3))
    for seed in range(400):
        m = shuffle_shards.communication_matrix(rows, shards, seed)
        assert (m.sum(1) == rows).all() and (m.sum(0) == shards).all()
        total += m
    assert np.abs(total / 400 - np.outer(rows, shards) / 20).max() < 0.3


def test_shards_replayed_by_plain_loops(spark):
    rows = [(i % 7 if i % 3 else None, f"text {i % 5}", i % 4) for i in range(60)]
    d = spark.createDataFrame(rows, DOCS + ", `odd.name` int").repartition(4)
    seed, buckets, n_shards = 7, 60 // 9 + 1, 4
    place = lambda n, k: F.pmod(F.xxhash64(F.lit(seed + n), "doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in d.columns])), F.lit(k)).cast("int")
    order = lambda n: F.xxhash64(F.lit(seed + n), "doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in d.columns]))
    subs = 60 // n_shards // 9 + 1
    keyed = [(*r[:3], r.b, r.first, r.sub, r.second, r.h) for r in d.withColumns({"b": place(0, buckets), "first": order(1), "sub": place(2, subs), "second": order(3), "h": F.xxhash64(*[F.col(f"`{c}`") for c in d.columns])}).collect()]
    counts = np.bincount([k[3] for k in keyed], minlength=buckets)
    sizes = np.array([60 // n_shards + (s < 60 % n_shards) for s in range(n_shards)])
    matrix, shards = shuffle_shards.communication_matrix(counts, sizes, seed), {s: [] for s in range(n_shards)}
    for b in range(buckets):
        mine = sorted((k for k in keyed if k[3] == b), key=lambda k: (k[4], k[7]))
        for s in range(n_shards):
            taken, mine = mine[: matrix[b, s]], mine[matrix[b, s] :]
            shards[s] += taken
    want = sorted((str(k[:3]), s, slot) for s, ks in shards.items() for slot, k in enumerate(sorted(ks, key=lambda k: (k[5], k[6], k[7]))))
    out = shuffle_shards.shuffle_shards(d, n_shards, ["doc_id"], bucket_rows=9)
    assert out.columns == ["doc_id", "text", "odd.name", "shard", "slot"]
    assert sorted((str(tuple(r[:3])), r.shard, r.slot) for r in out.collect()) == want


# --- language and quality


def _loops(text, sizes, buckets, fold):
    """Buckets of a text's byte n-grams by plain loops."""
    out = []
    raw = [fold(b) for b in text.encode()]
    for size in sizes:
        for i in range(len(raw) - size + 1):
            h = 0
            for b in raw[i : i + size]:
                h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            out.append((h ^ h >> 13) & buckets - 1)
    return out


def test_language_decoding_against_plain_loops(spark, monkeypatch):
    r = np.random.default_rng(5)
    names = ["aa", "bb", "cc", "dd", "ee"]
    code = language_id.codewords(5)
    bits = code.shape[1]
    weight = r.random(bits)
    model = language_id.Model(names, code, r.normal(size=(language_id.BUCKETS, bits)).astype(np.float32), r.normal(size=bits), weight / weight.sum(), 1 + r.random(bits))
    monkeypatch.setattr(language_id, "AT_ONCE", 50)
    texts = ["Some plain words, 12 of 34!", "é日本\tx", "a", "ab " * 40, "12 !?", "", None, words(3, 30)]

    def fold(b):
        b = b + 32 if 65 <= b <= 90 else b
        return 48 if 48 <= b <= 57 else 32 if b in (9, 10, 11, 12, 13, 32) else b

    got = {x.doc_id: x for x in language_id.predict(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0.0, True)
            continue
        grams = _loops(t, language_id.SIZES, language_id.BUCKETS, fold)
        margin = [(sum(float(model.odds[g, b]) for g in grams) / len(grams) + model.bias[b]) / model.scale[b] for b in range(bits)]
        loss = [sum(model.weight[b] * np.log1p(np.exp(-4 * margin[b] * word[b])) for b in range(bits)) for word in code]
        likely = np.exp(-4 * (np.array(loss) - min(loss)))
        best = int(np.argmin(loss))
        assert got[i].lang_pred == names[best] and abs(got[i].score - likely[best] / likely.sum()) < 1e-6
        assert got[i].ambiguous == (got[i].score < language_id.AMBIGUOUS)


def test_quality_scores_against_plain_loops(spark):
    from petriflow.llm import textvec as tv

    r = np.random.default_rng(6)
    model = quality_svm.Model(r.normal(size=quality_svm.BUCKETS), 0.3, 1.7, -0.2)
    texts = ["Some plain words, 12 of 34 words!", "", None, "x", "é日本 x", words(3, 60)]
    got = {x.doc_id: x.score for x in quality_svm.score(spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("a.b", F.lit(1)), model).collect()}
    for i, t in enumerate(texts):
        grams = {*_loops(t or "", quality_svm.BYTE_SIZES, quality_svm.BUCKETS, lambda b: 48 if 48 <= b <= 57 else b)}
        raw = np.frombuffer((t or "").encode(), np.uint8)
        a, b, _ = tv.words(raw, np.array([0, len(raw)]), tv.SPACED)
        h = tv.word_hashes(raw, a, b)
        for size in quality_svm.WORD_SIZES:
            for j in range(len(h) - size + 1):
                whole = tv.windows(h[j : j + size], np.zeros(size, np.int64), size)[1]
                grams.add(int(tv.mix(whole + np.uint64(size))[0] & np.uint64(quality_svm.BUCKETS - 1)))
        z = 1.7 * (sum(model.weight[g] for g in grams) / max(len(grams) ** 0.5, 1) + 0.3) - 0.2
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_ties_and_equal_texts_are_judged_alike(spark):
    d = spark.createDataFrame([(1, "same words here", "bb"), (2, "same words here", "aa"), (3, "same words here", "bb"), (4, "same words here", "aa")], DOCS + ", lang string")
    out = language_id.predict(d, language_id.train(d)).collect()
    assert {(x.lang_pred, round(x.score, 9), x.ambiguous) for x in out} == {("aa", 0.5, True)}



def test_language_is_learnt_from_the_text_alone(spark, none):
    vocab = {"en": "the of and to with that house water", "de": "der und die nicht wasser haus über straße", "fr": "le de la une été maison eau où"}
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(vocab[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "fr"), (903, "the house", None), (0, rows[0][1], "en")]
    d = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("score", F.lit(1))
    out = language_id.language_digest(d).collect()
    truth = {i: lang for i, _, lang in rows}
    tested = [x for x in out if x.held_out and x.doc_id < 900]
    assert len(tested) > 20 and all(x.lang_pred == truth[x.doc_id] and 0 <= x.score <= 1 for x in tested)
    und = {x.doc_id: (x.lang_pred, x.score) for x in out if x.doc_id >= 900}
    assert und[900] == und[901] == und[902] == ("und", 0.0) and und[903][0] == "en"
    assert language_id.language_digest(none.withColumn("lang", F.lit("en"))).count() == 0
    assert {x.lang_pred for x in language_id.language_digest(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    wrong = d.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert {x.doc_id: x.lang_pred for x in language_id.language_digest(wrong).collect()} == {x.doc_id: x.lang_pred for x in out}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12])
def test_codewords_differ_in_several_bits(n):
    code = language_id.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 4)
    assert (np.abs(code.sum(0)) < n).all()


def test_quality_classifier(spark, none):
    r = random.Random(6)
    good, bad = "the house stands near a river and people walk there".split(), "!!! BUY NOW &&& $$$ CLICK *** free".split()
    rows = [(i, " ".join(r.choice(good if i % 3 else bad) for _ in range(30))) for i in range(300)]
    d = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1, rows[1][1])], DOCS).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(2, None), (None, 1), (5000, 0), (3, 7)], "doc_id long, quality int")
    out = quality_svm.quality_scores(d, labels).collect()
    assert len(out) == 303 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out)
    tested = [x for x in out if x.held_out and x.doc_id < 300]
    assert np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in tested]) > 0.95
    assert quality_svm.quality_scores(none, labels).count() == 0
    assert {x.score for x in quality_svm.quality_scores(d, labels.where("quality < 0")).collect()} == {0.5}


def test_dual_descent_separates_what_can_be_separated():
    rows = [np.array([0, 2], np.int32), np.array([1, 2], np.int32)] * 10
    sign = np.array([1.0, -1.0] * 10)
    w, b = quality_svm.dual_descent(rows, [np.ones(2)] * 20, sign, np.ones(20))
    assert all(np.sign(w[x].sum() + b) == s for x, s in zip(rows, sign, strict=True))


# --- licenses


def test_license_phrases_and_fuzzy_notices(spark, docs, none):
    rows = [
        (1, "All rights\nreserved. CC-BY and General Public License; all rights reserved"),
        (2, words(1, 30) + " Lisensed under the MIT licence " + words(2, 30)),
        (3, "nothing to see"), (4, None), (5, "cc bye all rights reservedx"),
        (6, "Licensed under the Apache License, Version 2.0."), (7, "permision is hereby grantd, free of charge, to any persn obtaining a copy"),
    ]
    got = {r.doc_id: r for r in license_scan.license_digest(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(2))).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (4, 0, 9, "cc-by,gpl,reserved", 1.0)
    assert (got[2].labels, got[2].base_labels, got[2].n_base, got[2].first_word) == ("mit", "", 0, None) and 0 < got[2].score < 1
    assert (got[3].labels, got[3].score, got[4].n_words, got[5].n_base) == ("", 0.0, 0, 0)
    assert got[6].labels == "apache-2.0" and got[7].labels == "mit"
    spans = license_scan.scan(spark.createDataFrame(rows, DOCS)).where("doc_id = 2").first().notices
    assert [(s.start_word, s.end_word, s.errors > 0) for s in spans] == [(30, 35, True)]
    assert license_scan.license_digest(docs).count() == 16 and license_scan.license_digest(none).count() == 0


def test_words_that_tell_notices_apart_are_exact():
    s = license_scan.Scanner(license_scan.NOTICES)
    found = lambda t: {s.notices[m[0]][1] for m in s.matches(f" {t} ")}
    assert found("mozilla public license version 1 1") == {"mpl-1.1"} and found("licensed under the apache license version 1 1") == {"apache-1.1"}
    assert found("licensed under the isc license") == {"isc"} and found("released under the mpl license") == {"mpl"}
    assert found("licensed under cc by nd") == {"cc-by-nd"} and found("licensed undr the apache licence version 2 0") == {"apache-2.0"}
    assert found("licensed under the mitt license") == set()


def test_a_repeated_notice_is_found_at_every_place():
    s = license_scan.Scanner(license_scan.NOTICES)
    text = " " + "licensed under the mit license " * 4
    assert sum(s.notices[m[0]][1] == "mit" and text[m[1] : m[2]] == "licensed under the mit license" for m in s.matches(text)) == 4


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_pigeonhole_pieces_find_every_bounded_edit():
    r = random.Random(9)
    s = license_scan.Scanner(license_scan.NOTICES)
    for (notice, label), exact in zip(s.notices, s.exact, strict=True):
        free = [i for i in range(1, len(notice) - 1) if not any(a - 1 <= i <= a + len(w) for w in exact for a in [f" {notice} ".find(f" {w} ")])]
        for _ in range(10):
            t = list(notice)
            for i in sorted(r.sample(free, min(len(free), license_scan.errors_for(notice))), reverse=True):
                t[i : i + r.randint(0, 1)] = r.choice(["q", "", "z"])
            text = f" {''.join(t)} "
            places = s.matches(text)
            assert label in {s.notices[m[0]][1] for m in places}, text
            # Every span is what its notice allows: so many edits and no more.
            for i, a, b, errors in places:
                assert _edits(text[a:b], s.notices[i][0]) <= errors <= s.errors[i]


def test_base_phrases_against_brute_force(docs, spark):
    r = random.Random(5)
    parts = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC-BY", "x"]
    rows = [(i, r.choice(["", None, *[" ".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(6)]])) for i in range(200)]
    want = {}
    for d, t in rows:
        w = alnum(t)
        hit = sorted((i, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p)
        want[d] = (len(w), len(hit), hit[0][0] if hit else None, hit[-1][0] if hit else None, ",".join(sorted({x for _, x in hit})))
    got = license_scan.license_digest(spark.createDataFrame(rows, DOCS)).collect()
    assert {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got} == want
    assert all({*x.base_labels.split(",")} <= {*x.labels.split(","), ""} and 0 <= x.score <= 1 for x in got)


# --- SentencePiece


def test_encoding_equals_the_library(spark, docs, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = piece_transducer.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [t or "" for _, t in corpus()] + ["  a  b   ", " " * 70 + "x", "▁x y", "\x00\t\r\n", "日本語テスト🙂", "<s> hi </s>", "x" * 5000, "12:30 isn't (he's) “ok”…"]
    d = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit(1))
    out = piece_transducer.encode(d)
    for r in piece_transducer.decode(out).collect():
        want = sp.encode(texts[r.doc_id])
        assert list(r["ids"]) == want and r.n_tokens == len(want) and r.decoded == sp.decode(want)
        assert r.round_trip == (r.decoded == texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    assert piece_transducer.encoding_digest(docs).count() == 16 and piece_transducer.encoding_digest(none).count() == 0


def test_the_encoding_query_returns_ids_and_texts(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.default_model())
    for r in piece_transducer.encoding_digest(docs).collect():
        want = sp.encode(r.text or "")
        assert r["ids"] == want and r.n_tokens == len(want) and r.decoded == sp.decode(want)


def test_unigram_models_take_the_lightest_path():
    def field(n, raw):
        return bytes([n << 3 | 2, len(raw)]) + raw

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("▁a", -4.5, 1), ("b▁", -9.0, 1)]
    model = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in pieces)
    fst = piece_transducer.Transducer(model + field(2, bytes([0x18, 1])) + field(3, bytes([0x18, 1, 0x20, 0, 0x28, 1])))
    assert [fst.pieces[i] for i in fst.encode("ab")] == ["▁", "ab"]
    assert [fst.pieces[i] for i in fst.encode("aab")] == ["▁a", "ab"]
    assert [fst.pieces[i] for i in fst.encode("ac")] == ["▁a", "<unk>"]


# --- token files


def test_coder_round_trip_and_damage():
    r = np.random.default_rng(0)
    blocks = [r.integers(0, 65536, n) for n in (0, 1, 7, 300)] + [np.zeros(900, int), np.tile([5, 9, 9, 70], 200), np.full(3, 65535)]
    coded = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert len(coded[5]) < 300
    assert range_coder.encode([blocks[3]])[0] == coded[3]  # no block looks at another
    bad = bytearray(coded[3])
    bad[40] ^= 1
    with pytest.raises(range_coder.ChecksumError):
        range_coder.decode([bytes(bad)])
    with pytest.raises(ValueError, match="65,535"):
        range_coder.encode([np.array([70000])])
    for cut in (0, 3, 19, len(coded[3]) - 2):
        with pytest.raises(range_coder.ChecksumError):
            range_coder.decode([coded[3][:cut]])
    assert range_coder.encode([]) == [] and range_coder.decode([]) == []


def test_any_damage_is_found():
    r = np.random.default_rng(1)
    whole = range_coder.encode_block(r.integers(0, 500, 4_000))
    for at in r.integers(0, len(whole), 60).tolist():
        bad = bytearray(whole)
        bad[at] ^= 1 << int(r.integers(8))
        try:
            assert len(range_coder.decode_block(bytes(bad))) == 4_000 and at in range(4, 20)
        except range_coder.ChecksumError:
            pass


def test_the_coder_is_tighter_than_zlib_on_the_same_blocks(sf_dir):
    import pyarrow.parquet as pq

    encoder = token_files._encoder(open(token_files.default_tokenizer()).read())
    ids = np.concatenate(encoder(pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()))
    for size in (2_048, 65_536, len(ids)):
        blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
        coded = range_coder.encode(blocks)
        assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(coded), strict=True))
        assert sum(map(len, coded)) < sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_token_ids_are_the_librarys_on_odd_words():
    import public_tokenizers
    import tokenizers

    path = token_files.default_tokenizer()
    t = tokenizers.Tokenizer.from_file(path)
    odd = ["", None, " ", "\n", "Hello, World. it's I'll, A.B, <|endoftext|>. <|ENDOFTEXT|>, É. Éé, ǅ. x\ty 123,4 日本, 🙂. ŉ, İ. Straße, ΣΑΣ. 'S, a,. ..,", "H\u0331, I\u0307. e\u0301, \u0301x ﬁ, Ω.", "don't, DON'T.  x y", "a" * 3_000]
    for text, ids in zip(odd, token_files.Encoder(open(path).read())(odd), strict=True):
        assert ids.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2], text
    with pytest.raises(ValueError, match="across white space"):
        token_files.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())


def test_token_files(spark, docs, none, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(token_files.default_tokenizer())
    token_files.write(docs, str(tmp_path / "ids"), block_ids=2_048)
    got = sorted(token_files.read(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in corpus()), key=lambda d: (d is not None, d))
    texts, at = {d: x for d, x in corpus()}, 0
    for r in got:
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    pieces = sorted(token_files.ids(spark, str(tmp_path / "ids")).where("doc_id = 10").collect(), key=lambda r: r.begin)
    assert len(pieces) > 1 and [i for p in pieces for i in p["ids"]] == [*t.encode(texts[10], add_special_tokens=False).ids, 2]
    token_files.write(none, str(tmp_path / "empty"))
    assert token_files.read(spark, str(tmp_path / "empty")).count() == 0


def test_checksums_of_pieces_join():
    a, b = b"some bytes", bytes(range(200)) * 3
    assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# --- very long texts


def test_texts_over_a_block_pass_every_operator(spark, tmp_path):
    import sentencepiece
    import tokenizers

    from petriflow.llm import textvec as tv

    long = words(77, 130_000)
    assert len(long) > tv.BLOCK
    notice = " licensed under the mit license "
    near = long + " one more"
    rows = [(1, long), (2, near), (3, "alpha beta " + words(78, 60)), (4, None), (5, words(79, 70) + notice + long)]
    d = spark.createDataFrame(rows, DOCS)
    texts = dict(rows)
    links = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(d).collect()}
    sets = {i: {tuple(w[j : j + 5]) for w in [spaced(t)] for j in range(max(1, len(w) - 4))} if spaced(t) else set() for i, t in rows}
    assert links == {i: sum(1 for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in sets}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_digest(d).collect()}
    assert removed[2] == (130_002, 130_000) and removed[1] == (130_000, 0) and removed[5] == (130_000 + 75, 130_000)
    bench = spark.createDataFrame([(9, " ".join(spaced(long)[64_000:64_040]))], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontaminate.contamination_digest(d, bench).collect()}
    assert hit[1] >= 40 and hit[2] >= 40 and hit[5] >= 40 and hit[4] == 0
    scan = {r.doc_id: r for r in license_scan.license_digest(d).collect()}
    assert scan[5].labels == "mit" and scan[5].n_words == 130_000 + 75 and scan[1].labels == ""
    r = np.random.default_rng(1)
    svm = quality_svm.Model(r.normal(size=quality_svm.BUCKETS), 0.0, 1.0, 0.0)
    raw = np.frombuffer(long.encode(), np.uint8)
    one = next(quality_svm.features(raw, np.array([0, len(raw)])))
    assert abs({x.doc_id: x.score for x in quality_svm.score(d, svm).collect()}[1] - 1 / (1 + np.exp(-svm.weight[one].sum() / len(one) ** 0.5))) < 1e-9
    model = language_id.Model(["a", "b"], language_id.codewords(2), r.normal(size=(language_id.BUCKETS, 1)).astype(np.float32), np.zeros(1), np.ones(1), np.ones(1))
    parts = [model.odds[bucket].sum(dtype=np.float64) for _, bucket in language_id.ngrams(raw, np.array([0, len(raw)]))]
    n = sum(len(raw) - k + 1 for k in language_id.SIZES)
    assert abs(language_id.margins(raw, np.array([0, len(raw)]), model)[0, 0] - sum(parts) / n) < 1e-6
    assert {x.doc_id: x.lang_pred in ("a", "b") for x in language_id.predict(d, model).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.default_model())
    assert all(x["ids"] == sp.encode(texts[x.doc_id] or "") for x in piece_transducer.encode(d).collect())
    t = tokenizers.Tokenizer.from_file(token_files.default_tokenizer())
    token_files.write(d, str(tmp_path / "ids"), block_ids=50_000)
    for x in token_files.read(spark, str(tmp_path / "ids")).collect():
        ids = np.array([*t.encode(texts[x.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (x.n_tokens, x.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    led = {x.doc_id: x.n_words for x in quality_rules.quality_digest(d).collect()}
    assert led == {i: len(spaced(t)) for i, t in rows}
    assert shuffle_shards.shard_digest(d).count() == 5


def test_a_models_character_map_is_applied():
    sentencepiece = pytest.importorskip("sentencepiece")
    import struct

    def field(n, raw):
        return bytes([n << 3 | 2]) + (bytes([len(raw)]) if len(raw) < 128 else bytes([len(raw) & 127 | 128, len(raw) >> 7 & 127 | 128, len(raw) >> 14])) + raw

    rules = {"ä": "ae", "äb": "X", "ﬁ": "fi", "\t": " "}
    # A double array in which every node has 256 places of its own.
    nodes, targets = [{}], b""
    for source, to in rules.items():
        at = 0
        for byte in source.encode():
            at = nodes[at].setdefault(byte, len(nodes))
            if at == len(nodes):
                nodes.append({})
        nodes[at]["value"] = len(targets)
        targets += to.encode() + b"\0"
    units = np.zeros(256 * (len(nodes) + 1), np.uint32)
    units[0] = (256 ^ 0) << 10
    for i, node in enumerate(nodes):
        base = 256 * (i + 1)
        for byte, child in node.items():
            if byte == "value":
                units[base] = np.uint32(1 << 31 | child)
                continue
            place = base ^ byte
            units[place] = (place ^ 256 * (child + 1)) << 10 | byte | (1 << 8 if "value" in nodes[child] else 0)
    charsmap = struct.pack("<I", units.nbytes) + units.astype("<u4").tobytes() + targets
    assert piece_transducer.rewrite_rules(charsmap) == rules
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(c, -3.0, 1) for c in "▁abefiX"] + [("fi", -3.5, 1), ("▁a", -4.0, 1), ("ae", -4.0, 1)]
    model = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in pieces)
    model += field(2, bytes([0x18, 1])) + field(3, field(1, b"own") + field(2, charsmap) + bytes([0x18, 1, 0x20, 1, 0x28, 1]))
    sp, fst = sentencepiece.SentencePieceProcessor(model_proto=model), piece_transducer.Transducer(model)
    for text in ("ä", "äb a", "aﬁ\tb", "  ä  äa ", "ab fi", "q qq aq", ""):
        assert fst.encode(text) == sp.encode(text), text
