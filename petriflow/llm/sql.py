"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from petriflow.llm.license_scan import BASE
from petriflow.llm.quality_rules import POLICIES, RULES, mask

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM s) WHERE n > 1),
v AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(0, 3)) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, coalesce(l.n_lines, 0)::BIGINT AS n_lines
  FROM t LEFT JOIN v USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines)::BIGINT
  + 16 * (word_chars > 40 * n_words)::BIGINT + 32 * (2 * word_chars < 3 * n_words)::BIGINT + 64 * (2 * n_upper > word_chars)::BIGINT + 128 * (n_words > 1000000)::BIGINT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, failed, n_upper, n_lines FROM f
"""

_POLICIES = ", ".join(f"('{name}', {mask(rules)}::BIGINT, {bit}, '{RULES[bit][0]}')" for name, rules in POLICIES.items() for bit in rules)
ABLATIONS = QUALITY[: QUALITY.rindex("SELECT doc_id")].rstrip() + f""",
p AS (SELECT * FROM (VALUES {_POLICIES}) t(policy, mask, bit, rule)), x AS (SELECT policy, rule, failed & mask AS failed, (1::BIGINT << bit) AS one FROM f CROSS JOIN p)
SELECT policy, rule, count(*) AS n_docs, sum((failed = 0)::INT)::BIGINT AS n_kept, sum((failed & ~one = 0)::INT)::BIGINT AS n_kept_without, sum((failed & one <> 0)::INT)::BIGINT AS n_failed, bit_and(failed) FILTER (WHERE failed & one <> 0) AS always_with FROM x GROUP BY policy, rule
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
g AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
s AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n)),
h AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(e.n_items, 0)::BIGINT AS n_items, sha256(coalesce(e.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 13)) AS p FROM x JOIN m USING (k) WHERE m.least < x.doc_id),
t AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM t ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

SEARCH = rf"""
WITH t AS (SELECT doc_id, unnest({_ALNUM}) AS word FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM n),
q AS (SELECT DISTINCT item_id, unnest({_ALNUM}) AS word FROM benchmark),
f AS (SELECT doc_id, word, count(*) AS tf FROM t WHERE word IN (SELECT word FROM q) GROUP BY doc_id, word),
w AS (SELECT word, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT word, count(*)::BIGINT AS df FROM f GROUP BY word), c),
s AS (SELECT q.item_id, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * n.n * c.n_docs) // c.n_words))))::BIGINT AS score
  FROM q JOIN f USING (word) JOIN w USING (word) JOIN n USING (doc_id), c GROUP BY q.item_id, f.doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""



def _tree(name: str, levels: int, key: str) -> str:
    """CTEs of a tree of 16-fold runs over ``{name}0`` (key, i, h), level by level, for `_paths`."""
    out = [f"{name}0c AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {key}) AS c FROM {name}0)"]
    for k in range(levels):
        out.append(f"""{name}{k + 1}c AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {key}) AS c FROM (
  SELECT {key}, i // 16 AS i, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k}c GROUP BY {key}, i // 16))""")
    return ",\n".join(out)


def _paths(name: str, levels: int, key: str, start: str, tag: str) -> str:
    """CTEs from ``start`` (doc_id, key, i, acc, proof) up the tree ``name``: each level's siblings are added to the proof and folded into acc."""
    out, before = [], start
    for k in range(levels):
        here = f"{tag}{k + 1}"
        out.append(f"""{here} AS MATERIALIZED (SELECT p.doc_id, p.{key}, p.i // 16 AS i,
  CASE WHEN any_value(n.c) > 1 THEN sha256(string_agg(CASE WHEN n.i = p.i THEN p.acc ELSE n.h END, '' ORDER BY n.i)) ELSE any_value(p.acc) END AS acc,
  any_value(p.proof) || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> p.i), '') AS proof
  FROM {before} p JOIN {name}{k}c n ON n.{key} = p.{key} AND n.i // 16 = p.i // 16 GROUP BY p.doc_id, p.{key}, p.i)""")
        before = here
    return ",\n".join(out)


_LEVELS, _UPPER = 5, "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in fields) + ")"


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
MANIFEST = f"""
WITH RECURSIVE r AS (SELECT b::BIGINT AS b, b::BIGINT AS c, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, {_STEP}, k + 1 FROM r WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM r WHERE k = 8),
d AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM documents),
l AS MATERIALIZED (SELECT doc_id, s, {_leaf("text")} AS leaf, {_leaf(f"translate(text, {_UPPER}, lower({_UPPER}))")} AS low,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 5 = 0 AS picked FROM d, crc),
a0 AS MATERIALIZED (SELECT s, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS i, leaf AS h, doc_id FROM l),
{_tree("a", _LEVELS, "s")},
b0 AS MATERIALIZED (SELECT 0 AS z, s AS i, h FROM a{_LEVELS}c),
{_tree("b", _LEVELS, "z")},
p0 AS MATERIALIZED (SELECT a.doc_id, a.s, a.i, CASE WHEN picked THEN low ELSE leaf END AS acc, '' AS proof FROM a0 a JOIN l USING (doc_id)),
{_paths("a", _LEVELS, "s", "p0", "p")},
q0 AS MATERIALIZED (SELECT doc_id, 0 AS z, s AS i, acc, proof FROM p{_LEVELS}),
{_paths("b", _LEVELS, "z", "q0", "q")}
SELECT l.doc_id, l.leaf, b0.h AS subroot, t.h AS root, sha256(q.proof) AS proof_sha256, q.acc AS folded_root, q.acc = t.h AS verified
FROM l JOIN b0 ON b0.i = l.s JOIN q{_LEVELS} q USING (doc_id), b{_LEVELS}c t
"""

_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS o, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s FROM d" for i, (k, p) in enumerate(_KINDS.items()))
#: Base kinds of personal data: a match starts after what is between the matches before it and these.
PERSONAL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({_FOUND}),
u AS (SELECT doc_id, kind, o, m[i] AS x, (coalesce(list_sum(list_transform(s[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
n AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS g FROM u),
v AS (SELECT * FROM n WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')) = 0
  WHEN 'card' THEN length(g) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(g)), lambda j: CASE WHEN j % 2 = 0 THEN g[length(g) - j]::INT ELSE 2 * g[length(g) - j]::INT - CASE WHEN g[length(g) - j]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  ELSE length(g) BETWEEN 10 AND 15 END),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _KINDS)}, string_agg(kind || ':' || a || ':' || (a + length(x)), ',' ORDER BY a, o) AS l FROM v GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in _KINDS)}, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

_PHRASES = ", ".join(f"('{p}', '{label}', {p.count(' ') + 1})" for p, label in BASE.items())
LICENSES = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), p(phrase, label, k) AS (VALUES {_PHRASES}),
t AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, label, i FROM x JOIN p ON a = string_split(phrase, ' ')[1] AND CASE k WHEN 2 THEN a || ' ' || b ELSE a || ' ' || b || ' ' || c END = phrase),
g AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op5_quality_rules": QUALITY,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op9_substring_dedup": SUBSTRINGS,
    "op11_lexical_search": SEARCH,
    "op12_merkle_manifest": MANIFEST,
    "license_phrases": LICENSES,
    "personal_base": PERSONAL,
    "rule_ablations": ABLATIONS,
}
