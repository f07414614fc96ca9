"""SQL of the licence query, for the comparison with another engine: the same templates as tables, every placement counted without a lookup."""

from __future__ import annotations

from .license_index import NOTICES, PHRASES, SHARE, SLACK, templates


def license_sql() -> str:
    known = templates(PHRASES, NOTICES, SHARE)
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    shapes = values((n, t.label, t.length, t.needed, len(t.words), n < len(PHRASES), not t.keys) for n, t in enumerate(known))
    postings = values((n, p, w) for n, t in enumerate(known) for p, w in t.words)
    keys = values((n, k) for n, t in enumerate(known) for k in t.keys)
    return rf"""
        WITH t(t, label, length, needed, n, base, phrase) AS (VALUES {shapes}),
        p(t, p, word) AS (VALUES {postings}),
        k(t, key) AS (VALUES {keys}),
        d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents
        ),
        u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
        v AS (SELECT u.r, p.t, p.p, u.i, u.i - p.p AS start FROM u JOIN p ON u.word = p.word),
        q AS (
          SELECT b.r, b.t, b.start, least(count(DISTINCT v.p), count(DISTINCT v.i)) AS votes
          FROM (SELECT DISTINCT v.r, v.t, v.start, CASE WHEN t.phrase THEN 0 ELSE {SLACK} END AS band FROM v JOIN t ON v.t = t.t) b
          JOIN v ON v.r = b.r AND v.t = b.t AND v.start BETWEEN b.start AND b.start + b.band GROUP BY ALL
        ),
        e AS (SELECT q.*, t.label, t.length, t.n, t.base, t.phrase FROM q JOIN t ON q.t = t.t WHERE q.votes >= t.needed),
        m AS (
          SELECT * FROM e WHERE phrase OR EXISTS (
            SELECT 1 FROM k JOIN e f ON f.t = k.key WHERE k.t = e.t AND f.r = e.r AND f.start >= e.start AND f.start < e.start + e.length + {SLACK})
        ),
        s AS (
          SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR NOT phrase) AS labels,
                 greatest(coalesce(max(votes / n) FILTER (NOT phrase), 0.0), CASE WHEN count(*) FILTER (base) > 0 THEN 0.5 ELSE 0.0 END) AS score
          FROM m GROUP BY r
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(s.n_base, 0) AS n_base, s.first_word, s.last_word,
               coalesce(s.base_labels, '') AS base_labels, coalesce(s.labels, '') AS labels, CAST(coalesce(s.score, 0.0) AS DOUBLE) AS score
        FROM d LEFT JOIN s ON d.r = s.r
    """
