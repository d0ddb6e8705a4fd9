"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op7_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""

_LEAF = r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){1,8}|[\x20\x09-\x0D]+"


def _tree(text: str, name: str) -> str:
    """CTEs of one text's tree, level by level; the last is ``name``."""
    return f"""
{name}_l AS (
  SELECT doc_id, list_transform(string_split({text}, chr(10)), lambda p: list_transform(
           regexp_extract_all(p, '{_LEAF}'), lambda x: sha256('leaf:' || x))) AS leaves
  FROM edited),
{name}_p AS (
  SELECT doc_id, flatten(leaves) AS leaves, list_transform(leaves, lambda h:
           sha256('paragraph:' || coalesce(array_to_string(h, ''), ''))) AS paragraphs
  FROM {name}_l),
{name} AS (
  SELECT doc_id, list_distinct(leaves) AS leaves, paragraphs,
         sha256('root:' || array_to_string(list_transform(list_filter(string_split(array_to_string(
           list_transform(paragraphs, lambda h: CASE WHEN h < '2' THEN h || '|' ELSE h END), ''), '|'),
           lambda run: run <> ''), lambda run: sha256('section:' || run)), '')) AS root
  FROM {name}_p)"""


def _alike(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}.leaves) + len({b}.leaves) = 0 THEN 1.0 ELSE "
            f"len(list_intersect({a}.leaves, {b}.leaves)) * 2.0 / (len({a}.leaves) + len({b}.leaves)) END")


SQL["op2_merkle_fingerprint"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (
           ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text
  FROM d),
edited AS (
  SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
{_tree('text', 'own')},
{_tree('edited', 'changed')},
{_tree('next_text', 'other')}
SELECT doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, own.root AS fingerprint,
       changed.root AS edited_fingerprint, CAST({_alike('own', 'changed')} AS DOUBLE) AS near_edited,
       CAST({_alike('own', 'other')} AS DOUBLE) AS near_next,
       CASE WHEN own.root <> changed.root THEN CAST(list_position(list_transform(
         range(1, greatest(len(own.paragraphs), len(changed.paragraphs)) + 1),
         lambda i: own.paragraphs[i] IS NOT DISTINCT FROM changed.paragraphs[i]), false) - 1 AS BIGINT) END
         AS edit_paragraph
FROM edited e JOIN own USING (doc_id) JOIN changed USING (doc_id) JOIN other USING (doc_id)
"""

SQL["op10_chat_rotation"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                            coalesce(text, '')) AS nth
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
seen AS (
  SELECT t.conv_id, speaker, nth, (nth - 1) // 64 AS part, role = speaker AS own,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY nth
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS body_at
  FROM seen),
parts AS (
  SELECT conv_id, speaker, part, string_agg(head || body, '' ORDER BY nth) AS rendered, count(*) AS n_turns,
         coalesce(string_agg(body_at || ':' || (body_at + length(body)), ',' ORDER BY nth) FILTER (own), '') AS mask
  FROM placed GROUP BY ALL)
SELECT conv_id, speaker, part, rendered, n_turns, mask,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, speaker ORDER BY part
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM parts
"""

_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_P = "1 + ({c} + 5) * 1000000000::HUGEINT // ({n} + 5 * v)"
SQL["op12_source_divergence"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '{_LETTERS}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS q_count FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(q_count)::HUGEINT AS q_n FROM k GROUP BY lang),
g AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         {_P.format(c="coalesce(c.c, 0)", n="coalesce(g.n, 0)")} AS p, {_P.format(c="k.q_count", n="l.q_n")} AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s a JOIN s b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM u QUALIFY part = 'pair' OR rank <= 50
"""
