"""Merkle manifest of a dataset, built by appends that carry each leaf's witness along.

Leaves of a group (a source) are appended in order to a `Frontier`: it keeps the open run of every level and, for each leaf, the witness as far
as it is known. When a run completes, its nodes are each other's siblings, so the leaves below them have their witnesses extended and the run's
hash is appended one level up. Spark deals a group into aligned blocks of ``16 ** LEVELS`` leaves: an aligned block is a whole
subtree whatever comes after it, so blocks are built apart, and their roots are appended to further blocks in the same way, up to the group's subroot; the
subroots are then appended to the tree of groups. A block's row keeps its leaves; once its later siblings are known, its appends are
replayed and every witness gets their part.

Shuffles: only ids and 32-byte digests, three times (order, positions, blocks). No group is ever in one task: positions come from a range
partitioning over all groups and from the counts of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed, partitions
from petriflow.llm.textvec import quoted

#: Nodes of a run, and levels of a block: 4,096 leaves.
FAN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WITNESS = "array<struct<place:int,siblings:string>>"
_PARTS = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


class Frontier:
    """A tree that only grows at its end. ``witnesses[i]`` holds what is known of leaf i's: (place in its run, the run's other digests) a level."""

    def __init__(self, fan: int = FAN):
        self.fan = fan
        self.open: list[list[tuple[str, int, int]]] = [[]]
        self.witnesses: list[list[tuple[int, str]]] = []

    def append(self, digest: str) -> None:
        n = len(self.witnesses)
        self.witnesses.append([])
        self._put(0, (digest, n, n + 1))

    def _put(self, level: int, node: tuple[str, int, int]) -> None:
        """A node (digest, first leaf, past its last leaf) at the end of a level; the run that it fills is closed."""
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == self.fan:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        text = "".join(digest for digest, _, _ in run)
        for place, (_, first, until) in enumerate(run):
            part = (place, text[: 64 * place] + text[64 * (place + 1) :])
            for i in range(first, until):
                self.witnesses[i].append(part)
        self._put(level + 1, (hashlib.sha256(text.encode()).hexdigest(), run[0][1], run[-1][2]))

    def root(self, levels: int | None = None) -> str:
        """Closes all open runs up to ``levels`` levels (None: until one node remains) and gives the node that is left."""
        level = 0
        while True:
            last = level == len(self.open) - 1 or not any(self.open[level + 1 :])
            if last and len(self.open[level]) == 1 and levels in (None, level):
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
            level += 1


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(columns: list[Column]) -> Column:
    """The digest (hex) of a row's fields: each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    return F.sha2(F.concat(*(_field(c) for c in columns)).cast("binary"), 256)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (g, k, d, ...) with n, the position in their group by k (null first), d, and size, the group's number of rows.

    A range partitioning orders all rows; a group's rows before a partition are counted from one number a partition and group.
    """
    by = [F.asc_nulls_first("g"), F.asc_nulls_first("k"), F.asc("d"), F.asc("o")]
    fixed = checkpointed(rows.withColumn("o", F.monotonically_increasing_id()))
    ordered = checkpointed(fixed.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = ordered.groupBy("g", part.alias("p")).agg(F.count("*").alias("c"), F.min("at").alias("least"))
    whole = Window.partitionBy("g")
    counts = counts.select("g", "p", "least", (F.sum("c").over(whole.orderBy("p")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("size")).withColumnsRenamed({"g": "_g", "p": "_p"})
    joined = ordered.join(counts, (part == F.col("_p")) & F.col("g").eqNullSafe(F.col("_g")))
    return joined.withColumn("n", F.col("before") + F.col("at") - F.col("least")).drop("o", "at", "least", "before", "_g", "_p")


def _replayed(leaves: list[bytes], size: int, levels: int, fan: int) -> tuple[Frontier, str]:
    """A block's frontier and root: a block of a larger tree is closed to its full height."""
    tree = Frontier(fan)
    for x in leaves:
        tree.append(x.hex())
    return tree, tree.root(levels if size > fan**levels else None)


def _building(levels: int, fan: int):
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        leaves = rows.column("d").to_pylist()
        size = rows.column("size")[0].as_py()
        _, root = _replayed(leaves, size, levels, fan)
        more = [c for c in rows.column_names if c not in ("g", "b", "n", "size", "d")]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks()) for c in more]
        return pa.Table.from_arrays([rows.column("g")[:1], rows.column("b")[:1], rows.column("size")[:1], pa.array([leaves], pa.list_(pa.binary())), pa.array([bytes.fromhex(root)], pa.binary()), *lists], ["g", "b", "size", "leaves", "root", *more])

    return build


def _expanding(levels: int, fan: int, more: list[str]):
    """Block rows to rows (g, n, d, top, witness, ...): the block's own part of the witness, then what came from above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                get = {c: one.column(c)[0].as_py() for c in ("b", "size", "leaves", "top", "up")}
                tree, _ = _replayed(get["leaves"], get["size"], levels, fan)
                above = [(u["place"], u["siblings"]) for u in get["up"]]
                flat = [part for w in tree.witnesses for part in (*w, *above)]
                n = len(get["leaves"])
                ends = [0]
                for w in tree.witnesses:
                    ends.append(ends[-1] + len(w) + len(above))
                parts = pa.StructArray.from_arrays([pa.array([p for p, _ in flat], pa.int32()), pa.array([s for _, s in flat], pa.string())], ["place", "siblings"])
                witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
                lists = [one.column(c).flatten() for c in more]
                g = pa.concat_arrays([one.column("g")] * n)
                n0 = get["b"] * fan**levels
                yield pa.RecordBatch.from_arrays([g, pa.array(range(n0, n0 + n), pa.int64()), pa.array(get["leaves"], pa.binary()), pa.array([get["top"]] * n, pa.binary()), witness, *lists], ["g", "n", "d", "top", "witness", *more])

    return run


def _grown(nodes: DataFrame, most: int, levels: int, fan: int) -> DataFrame:
    """Rows (g, n, size, d, ...), ``most`` in a group at most, to block rows (g, b, size, leaves, lists of the other columns, top, up): the root of
    the group's tree, and the part of the witness that lies above the block."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    more = [c for c in nodes.columns if c not in ("g", "n", "size", "d")]
    schema = f"g {kinds['g']}, b long, size long, leaves array<binary>, root binary" + "".join(f", {c} array<{kinds[c]}>" for c in more)
    dealt = nodes.withColumn("b", F.floor(F.col("n") / F.lit(fan**levels)).cast("long"))
    blocks = checkpointed(dealt.groupBy("g", "b").applyInArrow(_building(levels, fan), schema))
    if most <= fan**levels:
        return blocks.withColumn("top", F.col("root")).withColumn("up", F.array().cast(_WITNESS)).drop("root")
    # Block roots are appended in turn.
    roots = blocks.select("g", F.col("b").alias("n"), F.ceil(F.col("size") / F.lit(fan**levels)).cast("long").alias("size"), F.col("root").alias("d"))
    above = _expanded(_grown(roots, -(-most // fan**levels), levels, fan), levels, fan).select(F.col("g").alias("_g"), F.col("n").alias("_n"), "top", F.col("witness").alias("up"))
    return blocks.join(above, (F.col("b") == F.col("_n")) & F.col("g").eqNullSafe(F.col("_g"))).drop("_g", "_n", "root")


def _expanded(blocks: DataFrame, levels: int, fan: int) -> DataFrame:
    more = [c for c in blocks.columns if c not in ("g", "b", "size", "leaves", "top", "up")]
    kinds = {f.name: f.dataType for f in blocks.schema}
    schema = f"g {kinds['g'].simpleString()}, n long, d binary, top binary, witness {_WITNESS}" + "".join(f", {c} {kinds[c].elementType.simpleString()}" for c in more)
    return blocks.select("g", "b", "size", "leaves", "top", "up", *more).mapInArrow(_expanding(levels, fan, more), schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", extra: dict[str, Column] | None = None, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """A row for each row of ``docs``: its ``order`` and ``group`` columns, leaf, subroot and root (hex), witness (array of place, siblings as one hex
    string; level by level from the leaf to the root) and the columns ``extra`` (made from those of ``docs``).

    leaf is the digest of ``fields``. Per group, leaves ascend by ``order`` (null first; equal ones by digest); while several nodes remain, every ``fan``
    consecutive ones, or the fewer last, become the digest of their hex digests joined. What remains is subroot; the subroots, ordered by group (null
    first, UTF-8 bytewise), give root likewise. A lone node has no level above it. Null fields, groups and ids count as such; repeated rows are
    leaves of their own; an empty table gives no rows. Text is hashed where it is read and goes no further. Other columns, whatever their names, are left
    out. A task holds a block of ``fan ** levels`` leaves with their witnesses (some 20 MB).
    """
    extra = extra or {}
    inner = {name: f"x{i}" for i, name in enumerate(extra)}
    digest = F.unhex(leaf([F.col(quoted(c)) for c in fields]))
    rows = docs.select(F.col(quoted(group)).alias("g"), F.col(quoted(order)).alias("k"), digest.alias("d"), *(c.alias(inner[name]) for name, c in extra.items()))
    numbered = _numbered(rows)
    most = lambda d: d.agg(F.max("size")).first()[0] or 0
    numbered = checkpointed(numbered)
    blocks = _grown(numbered, most(numbered), levels, fan)
    # The tree of groups: a subroot is on every block of its group; the first block gives it.
    subroots = checkpointed(blocks.where("b = 0").select(F.lit(0).alias("g"), F.col("g").alias("k"), F.col("top").alias("d")))
    ranked = checkpointed(_numbered(subroots))
    whole = _expanded(_grown(ranked, most(ranked), levels, fan), levels, fan).select(F.col("k").alias("_g"), F.col("top").alias("root"), F.col("witness").alias("_up"))
    joined = blocks.join(whole, F.col("g").eqNullSafe(F.col("_g"))).withColumn("up", F.concat("up", "_up"))
    # Subroot and root travel with the block: its subroot as a list of one, as every other column of a block row.
    out = _expanded(_repeated(joined, {"subroot": F.col("top"), "root": F.col("root")}).drop("_g", "_up"), levels, fan)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(F.col("k").alias(order), F.col("g").alias(group), F.lower(F.hex("d")).alias("leaf"), hexed("subroot"), hexed("root"), "witness", *(F.col(i).alias(name) for name, i in inner.items()))


def _repeated(blocks: DataFrame, values: dict[str, Column]) -> DataFrame:
    return blocks.withColumns({name: F.array_repeat(c, F.size("leaves")) for name, c in values.items()})


def proof_digest(witness: Column) -> Column:
    """The digest of a witness's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(witness, lambda w: w["siblings"]), "").cast("binary"), 256)


def folded(digest: Column, witness: Column) -> Column:
    """The root that a leaf's digest (hex) and its siblings give."""

    def up(below: Column, w: Column) -> Column:
        size, cut = F.length(w["siblings"]), w["place"] * 64
        return F.sha2(F.concat(F.substring(w["siblings"], F.lit(1), cut), below, F.substring(w["siblings"], cut + 1, size)).cast("binary"), 256)

    return F.aggregate(witness, digest, up)


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The registered query: every document's proof, and what it folds to when texts of a fifth of the documents lose their capitals."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(picked, F.unhex(leaf([lowered if c == "text" else F.col(c) for c in FIELDS])))
    out = manifest(docs.select(*FIELDS), extra={"tampered": tampered})
    out = out.withColumn("folded_root", folded(F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")), F.col("witness")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("witness")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
