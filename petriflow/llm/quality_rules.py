"""Rule ledger: every quality rule is evaluated once per document and kept as one bit beside its measurements.

A policy is only a bit mask over the ledger, so changing a policy, comparing versions or taking a rule out (ablation)
reads the narrow ledger and never a text again. All of it is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petriflow.functions.grid import with_each

#: A word is a run of anything but ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: bit: (name, fails when). Written over the measurements of `measured`.
RULES: dict[int, tuple[str, str]] = {
    0: ("too_few_words", "n_words < 50"),
    1: ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    3: ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    4: ("long_words", "word_chars > 40 * n_words"),
    5: ("short_words", "2 * word_chars < 3 * n_words"),
    6: ("shouting", "2 * n_upper > word_chars"),
    7: ("too_many_words", "n_words > 1000000"),
}
#: Policies by version, as sets of rules.
POLICIES: dict[str, tuple[int, ...]] = {
    "base": (0, 1),
    "v1": (0, 1, 2, 3, 4, 5),
    "v2": (0, 1, 2, 3, 4, 5, 6, 7),
}


def mask(policy: str | tuple[int, ...]) -> int:
    return sum(1 << bit for bit in (POLICIES[policy] if isinstance(policy, str) else policy))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines and n_repeat_words (long).

    Null and empty texts have no words and all measurements 0. n_repeat_words counts the words covered by 3-word windows
    that occur twice or more in the text: window hashes are sorted together with their positions, neighbours with equal
    hashes are compared word by word, and the surviving starts are merged into covered stretches.
    """
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_w", F.filter(F.split("_t", GAP), lambda w: w != ""))
    out = out.withColumn("_n", F.size("_w")).withColumn("_joined", F.array_join("_w", ""))
    # The hash keeps its upper bits and gets the position in its lower 24 (a text of more words takes the exact way below).
    starts = F.expr("if(_n >= 3, sequence(0, _n - 3), cast(array() as array<int>))")
    packed = F.transform(starts, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(i.cast("long")))
    out = out.withColumn("_p", F.when(F.col("_n") < (1 << 24), F.sort_array(packed)))
    same = lambda x, y: F.shiftright(x, 24) == F.shiftright(y, 24)
    near = F.filter("_p", lambda x, i: same(x, F.get("_p", i - 1)) | same(x, F.get("_p", i + 1)))
    near = F.transform(F.filter(near, lambda x: x.isNotNull()), lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))
    out = out.withColumn("_c", F.when(F.col("_n") < (1 << 24), near).otherwise(starts)).drop("_p")
    exact = F.transform("_c", lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c"), i.alias("i")))
    out = out.withColumn("_e", F.when(F.size("_c") > 0, F.sort_array(exact)))
    alike = lambda x, y: (x.a == y.a) & (x.b == y.b) & (x.c == y.c)
    hits = F.filter("_e", lambda x, k: F.coalesce(alike(x, F.get("_e", k - 1)), F.lit(False)) | F.coalesce(alike(x, F.get("_e", k + 1)), F.lit(False)))
    out = out.withColumn("_h", F.sort_array(F.transform(hits, lambda x: x.i)))
    covered = F.aggregate(F.transform("_h", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_h", k + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_l", lines)
    row = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        _count(F.col("_joined"), SYMBOLS).alias("n_symbols"),
        _count(F.col("_joined"), "[A-Z]").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # As a generator's output the measurements are computed once: a filter on them is not pushed below, where the
    # optimizer would copy the whole expression tree into it.
    return out.select(*docs.columns, F.inline(F.array(row)))


def ledger(docs: DataFrame, text: str = "text", rules: dict[int, tuple[str, str]] | None = None) -> DataFrame:
    """`measured` plus ``failed`` (long): bit b is set if rule b fails. One row per input row, columns kept.

    Columns of ``docs`` that share a result's name are replaced by it, all others kept, whatever their names. A text is held a few times over in
    its row while it is measured.
    """
    rules = RULES if rules is None else rules
    made = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    inner = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c == text or c.lower() not in (*made, "failed")}
    named = docs.select(*(F.col(quoted(c)).alias(i) for c, i in inner.items()))
    bits = [F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, (_, test) in sorted(rules.items())]
    return measured(named, inner[text]).select(*(F.col(i).alias(c) for c, i in inner.items()), *made, reduce(Column.bitwiseOR, bits).alias("failed"))


def apply_policy(led: DataFrame, policy: str | tuple[int, ...] = "v1") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(led: DataFrame, policies: dict[str, tuple[int, ...]] | None = None, rules: dict[int, tuple[str, str]] | None = None) -> DataFrame:
    """How many documents each policy keeps, and how many it would keep without each of its rules.

    The ledger is first folded to one row per distinct failure mask (2^rules rows at most), so everything after that is
    independent of the corpus size. ``always_with`` is the mask of the policy's rules that every document failing the rule fails, the
    rule's own bit included (null without such a document). ``rules`` are the ones that the ledger was made with.
    """
    policies = POLICIES if policies is None else policies
    known = RULES if rules is None else rules
    folded = led.groupBy("failed").agg(F.count("*").alias("n"))
    grid = [(name, mask(chosen), bit, known[bit][0]) for name, chosen in policies.items() for bit in chosen]
    one = F.expr("shiftleft(1L, bit)")
    failed = F.col("failed").bitwiseAND(F.col("mask").cast("long"))
    both = with_each(folded, ["policy", "mask", "bit", "rule"], grid)
    return both.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(failed.bitwiseAND(F.bitwise_not(one)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.sum(F.when(failed.bitwiseAND(one) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.bit_and(F.when(failed.bitwiseAND(one) != 0, failed)).alias("always_with"),
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    """The registered query: the ledger of every document with base_failed and the verdict of policy v1."""
    led = apply_policy(ledger(docs.select("doc_id", "text")), "v1")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0).alias("base_failed"), "kept", "failed", "n_upper", "n_lines")
