"""DuckDB SQL for the corpus queries that SQL can express on whole tables; the rest is tested against brute force."""

from __future__ import annotations

from loomset.llm import secret_ledger, url_filter

_URL = r"""
WITH r(verdict, host, path) AS (VALUES {rules}),
p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
m AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM m WHERE place = 1
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    """Spans per rule from the pieces between the matches and the matches, then all in order."""
    parts = []
    for rank, rule in enumerate(secret_ledger.RULES, 1):
        p = _quoted(rule.pattern)
        parts.append(f"""
        SELECT doc_id, {rank} AS rank, '{rule.name}' AS kind, i,
          list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s,
          length(hits[i]) AS n, length(vals[i]) AS v, {rule.least} AS least
        FROM (SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {rule.group}) AS vals
          FROM d WHERE regexp_matches(t, {p})) a) b""")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({' UNION ALL '.join(parts)}),
    k AS (SELECT doc_id, rank, kind, s::BIGINT AS s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM f WHERE v >= least),
    g AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY s, rank) FILTER (rank <= 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
      FROM k GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN g USING (doc_id)"""


_MIX = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, coalesce(text, '') AS t FROM documents
),
q AS (
  SELECT doc_id, k, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
    -ln((('0x' || substr(md5('0-' || coalesce(doc_id::VARCHAR, 'none')), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)
      / (1.0::DOUBLE / (1.0 + 10.0 * (length(t) - length(translate(t, '#*$%&|<>', '')))::DOUBLE / greatest(length(t), 1))) AS key
  FROM d
),
s AS (
  SELECT k, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS w FROM q GROUP BY k
),
l AS (
  SELECT *, 3 * source_size AS most,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
    sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shares
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, k)
),
c AS (SELECT *, (words * w)::DOUBLE / shares::DOUBLE > most AS stopped FROM l),
a AS (SELECT arg_min(words, (most / w, k)) AS words, arg_min(shares, (most / w, k)) AS shares FROM c WHERE NOT stopped),
b AS (
  SELECT c.k, source_size, CASE WHEN stopped THEN most::DOUBLE ELSE (a.words * w)::DOUBLE / a.shares::DOUBLE END AS target FROM c, a
),
e AS (
  SELECT q.*, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY q.k ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q JOIN b ON q.k = b.k
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM e
"""

_SEARCH = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {term}) AS w FROM documents
),
iw AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {term})) AS term FROM benchmark
),
asked AS (SELECT item_id, term, count(*) AS k FROM iw GROUP BY ALL),
counted AS (SELECT doc_id, len(w)::BIGINT AS n FROM dw WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM counted),
held AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM dw) t SEMI JOIN asked USING (term) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * n_docs + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*) AS n_docs FROM held GROUP BY term) h, whole
),
norms AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // words AS m FROM counted, whole),
found AS (
  SELECT item_id, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN norms USING (doc_id) GROUP BY ALL
)
SELECT item_id, place::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM found WHERE score > 0) f
WHERE place <= 20
""".replace("{term}", r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'")

ORACLES: dict[str, str] = {
    "op11_lexical_search": _SEARCH.strip(),
    "op1_secret_ledger": _secrets(),
    "op2_url_filter": _URL.format(
        rules=", ".join(f"({', '.join(map(_quoted, r))})" for r in url_filter.RULES), default=url_filter.DEFAULT
    ).strip(),
    "op5_source_mixing": _MIX.strip(),
}
