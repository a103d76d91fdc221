"""The pipeline's stages against brute force, and the registered queries against SQL."""

import re

import pytest

import corpus_pipeline
from petriflow.functions.lineage import checkpointed
from petriflow.llm import piece_transducer, registry
from tests.compare import database, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir).toPandas(), database(sf_dir).sql(registry.oracle_sql()[name]).df())


def _grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _brute(name, rows, items):
    """What a stage leaves of {id: text}, by plain loops."""
    if name == "quality_rules":
        out = {}
        for d, t in rows.items():
            w, seen, covered = re.findall(r"[^\x20\x09-\x0D]+", t or ""), {}, set()
            for i in range(len(w) - 2):
                seen.setdefault(tuple(w[i : i + 3]), []).append(i)
            for places in seen.values():
                if len(places) > 1:
                    covered |= {p + j for p in places for j in range(3)}
            lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            chars, n = sum(map(len, w)), len(w)
            bad = n < 50 or 100 * len(covered) > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", t or "")) > 3 * n or len(lines) >= 4 and 10 * (len(lines) - len({*lines})) > 5 * len(lines) or chars > 40 * n or 2 * chars < 3 * n
            if not bad:
                out[d] = t
        return out
    if name == "substring_dedup":
        first = {}
        split = {d: (t or "").split() for d, t in rows.items()}
        for d in sorted(split):
            for i in range(len(split[d]) - 12):
                first.setdefault(tuple(split[d][i : i + 13]), d)
        out = {}
        for d, w in split.items():
            gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(13)}
            if not gone or len(gone) < len(w):
                out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else rows[d]
        return out
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for t in items:
        y = words(t)
        n = min(10, len(y))
        for j in range(len(y) - n + 1) if y else ():
            windows.setdefault(n, set()).add(tuple(y[j : j + n]))
    clean = lambda w: not any(tuple(w[i : i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1))
    return {d: t for d, t in rows.items() if clean(words(t))}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        kept[name] = (before, docs)
    before, after = kept["ngram_jaccard_join"]
    left = {r.doc_id for r in after.select("doc_id").collect()}
    sets = {d: _grams(t) for d, t in before.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = sorted(sets)
    assert not any(near(a, b) for i, a in enumerate(ids) for b in ids[:i] if a in left and b in left)
    gone = set(ids) - left
    assert all(any(near(g, b) for b in ids if b != g) for g in gone)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name in ("quality_rules", "substring_dedup", "benchmark_decontamination"):
        before, after = kept[name]
        assert {r.doc_id: r.text for r in after.select("doc_id", "text").collect()} == _brute(name, before, items)
    before, after = kept["sentencepiece_encoding"]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.default_model())
    assert {r.doc_id: r["ids"] for r in after.collect()} == {d: sp.encode(t) for d, t in before.items()}
    last = kept["sentencepiece_encoding"][1]
    assert last.where("n_tokens <> size(ids) or not round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").count() == last.count()


def test_clashing_columns_nulls_and_empty_tables_pass_every_stage(spark, sf_dir):
    from pyspark.sql import functions as F

    spec = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, " ".join(f"w{i}" for i in range(80)), "en", None, 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, " ".join(f"v{i}" for i in range(70)), None, "s", 9)]
    docs = spark.createDataFrame(rows, spec).withColumns({"n_words": F.lit("x"), "failed": F.lit("y"), "kept": F.lit(2), "spans": F.lit("z"), "a.b": F.lit("d"), "we`ird": F.lit("e"), "doc": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert sorted(r.doc_id for r in docs.where("doc_id is not null").collect()) == [1, 3]
    assert {(r.n_words, r.failed, r.kept, r.spans) for r in docs.collect()} == {("x", "y", 2, "z")}
    assert {(r["a.b"], r["we`ird"], r.doc) for r in docs.collect()} == {("d", "e", 1)}
    assert corpus_pipeline.encoding(spark, docs.drop("lang", "source"), sf_dir).columns == ["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"]
    none = spark.createDataFrame([], spec)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
    assert none.count() == 0


def test_every_stage_is_computed_once(spark, sf_dir, monkeypatch):
    passed = {name: spark.sparkContext.accumulator(0) for name, _ in corpus_pipeline.STAGES}

    def counted(name, stage):
        def through(batches):
            for b in batches:
                passed[name].add(b.num_rows)
                yield b

        return lambda *a: (lambda out: out.mapInArrow(through, out.schema))(stage(*a))

    want = {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
        want[name] = docs.count()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(n, f)) for n, f in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, sf_dir)
    out.write.format("noop").mode("overwrite").save()
    assert {n: a.value for n, a in passed.items()} == want
