"""SQL for the queries that it can express on whole tables."""

from __future__ import annotations

from .rule_ledger import BASE, RULES, mask

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

METRIC_JOIN = """WITH RECURSIVE v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
links AS (SELECT a.vec_id AS p, b.vec_id AS q FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9::double),
reach AS (SELECT vec_id AS p, vec_id AS q FROM v UNION SELECT reach.p, links.q FROM reach JOIN links ON reach.q = links.p),
parts AS (SELECT p, min(q) AS component_id FROM reach GROUP BY p), counts AS (SELECT p, count(*) AS n FROM links GROUP BY p)
SELECT vec_id, coalesce(counts.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN parts ON parts.p = vec_id LEFT JOIN counts ON counts.p = vec_id"""


def quality_rules(policy: str) -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    base = " OR ".join(r.fails for r in RULES if r.name in BASE)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM d),
t AS (SELECT doc_id, k, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
often AS (SELECT doc_id, k, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS again FROM t),
covered AS (SELECT doc_id, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS hit FROM often WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, count(*) AS n FROM covered WHERE hit GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words)::bigint AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines)::bigint AS n_lines,
  len(list_filter(words, lambda x: upper(x) = x AND lower(x) <> x))::bigint AS n_upper_words, (length(text) - length(replace(text, '!', '')))::bigint AS n_exclaims FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, ({bits})::bigint AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, (failures & {mask(policy)}) = 0 AS kept, failures FROM f"""


REPEATED_PASSAGES = f"""WITH d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS words FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, words, unnest(range(len(words) - 49)) AS s FROM d WHERE len(words) >= 50),
w AS (SELECT doc_id, s, sha256(array_to_string(words[s + 1:s + 50], ' ')) AS h FROM p),
g AS (SELECT h, min(doc_id) AS first_doc_id, arg_min(s, (doc_id, s)) AS first_s FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, s, first_doc_id, doc_id = first_doc_id AND s = first_s AS first FROM w JOIN g USING (h)),
n AS (SELECT *, CASE WHEN lag(s) OVER o = s - 1 AND lag(first_doc_id) OVER o = first_doc_id AND lag(first) OVER o = first THEN 0 ELSE 1 END AS new FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM n)
SELECT doc_id, min(s) AS start, max(s) - min(s) + 50 AS n_words, any_value(first_doc_id) AS first_doc_id, any_value(first) AS first FROM r GROUP BY doc_id, run"""
