"""The manifest against a recursive plain version, with small blocks so that several levels of blocks are met."""

import hashlib

import pytest
from pyspark.sql import functions as F

from petriflow.llm import merkle_manifest as mm

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes, fan):
    """(root, witnesses) of digests."""
    witnesses, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        for leaf, at in enumerate(spots):
            run = runs[at // fan]
            witnesses[leaf].append((at % fan, "".join(run[: at % fan] + run[at % fan + 1 :])))
        spots, nodes = [at // fan for at in spots], [sha("".join(r)) for r in runs]
    return nodes[0], witnesses


def brute(rows, fan):
    leaves, out = {}, []
    for r in rows:
        leaves.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(field, r)))))
    groups = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(leaves[g])], fan) for g in groups}
    root, above = tree([trees[g][0] for g in groups], fan)
    for g, up in zip(groups, above, strict=True):
        subroot, below = trees[g]
        for (there, k, leaf), w in zip(sorted(leaves[g]), below, strict=True):
            out.append((k if there else None, g, leaf, subroot, root, tuple(w + up)))
    return out


def rows():
    out = [(i, "src0", "en", i % 7, f"Text {i} É" * (i % 5)) for i in range(600)]
    out += [(i, f"s{i % 37}", None, None, "x") for i in range(600, 720)] + [(i, None, "de", 1, "No source") for i in range(720, 740)]
    return out + [(900, "alone", "en", 3, None), (901, "é", "en", 0, ""), (None, "src0", None, None, None), (3, "src0", "en", 3, "again"), (3, "src0", "en", 3, "again"), (905, "", "x", 2, "long " * 100_000), (906, "Z", "x", 2, "1:2")]


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.mark.parametrize(("levels", "fan"), [(1, 4), (2, 4), (3, 16)])
def test_manifest_against_brute_force(spark, levels, fan):
    docs = spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit("x") for c in ("g", "k", "d", "n", "leaf", "witness", "top", "a`b")}).repartition(3)
    out = mm.manifest(docs, levels=levels, fan=fan)
    assert out.columns == ["doc_id", "source", "leaf", "subroot", "root", "witness"]
    got = [(*r[:5], tuple((w.place, w.siblings) for w in r.witness)) for r in out.collect()]
    assert sorted(got, key=key) == sorted(brute(rows(), fan), key=key)
    proofs = out.select("leaf", "root", mm.proof_digest(F.col("witness")).alias("p"), mm.folded(F.col("leaf"), F.col("witness")).alias("f"), "witness").collect()
    assert all(r.p == sha("".join(w.siblings for w in r.witness)) and r.f == r.root for r in proofs)


def test_tampered_texts_are_found(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    out = mm.manifest_digest(docs).collect()
    from zlib import crc32

    text = {r[0]: r[4] or "" for r in rows()}
    assert len(out) == len(rows()) and len({r.root for r in out}) == 1
    for r in out:
        changed = r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text[r.doc_id])
        assert r.verified == (r.folded_root == r.root) == (not changed)
    assert 50 < sum(not r.verified for r in out) < 200


def test_empty_table_and_one_row(spark):
    docs = spark.createDataFrame([(1, "s", None, None, None)], DOCS)
    assert mm.manifest_digest(docs.limit(0)).count() == 0
    r = mm.manifest_digest(docs).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified


def test_witnesses_grow_with_appends():
    leaves = [sha(str(i)) for i in range(70)]
    frontier = mm.Frontier(4)
    for i, x in enumerate(leaves):
        frontier.append(x)
        _, final = tree(leaves, 4)
        # What is known so far is the beginning of what will be true in the end.
        assert all(w == f[: len(w)] for w, f in zip(frontier.witnesses, final, strict=False))
        assert len(frontier.witnesses[0]) == sum(i + 1 >= 4**k for k in (1, 2, 3))
    assert frontier.root() == tree(leaves, 4)[0] and frontier.witnesses == tree(leaves, 4)[1]
