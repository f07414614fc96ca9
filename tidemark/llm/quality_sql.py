"""SQL of the quality query, for the comparison with another engine: measures, sketches, quantiles and fences written out."""

from __future__ import annotations


def quality_sql() -> str:
    """Independent of the operator's code but for its fixed numbers, which stand here as text."""
    measures = {"symbol_share": ("n_symbols", "n_words", 2), "repeat_share": ("n_repeat_words", "n_words", 18), "dup_line_share": ("n_dup_lines", "n_lines", 2), "word_length": ("word_chars", "n_words", 0)}
    values = " UNION ALL ".join([f"SELECT lang, source, '{m}' AS measure, {n} * 65536 // greatest({d}, 1) AS v FROM b" for m, (n, d, _) in measures.items()] + [f"SELECT lang, source, '{s}', {s} * 65536 FROM b" for s in ("n_words", "n_lines")])
    found = ", ".join(f"min(bin) FILTER (upto * 100 >= every * {p}) / 65536.0 AS q{p}" for p in (25, 50, 75, 80, 95))
    level = lambda name, keys: f"""
        {name} AS (
          SELECT {keys}{', ' if keys else ''}measure, max(every) AS n, {found} FROM (
            SELECT *, sum(n) OVER (PARTITION BY {keys}{', ' if keys else ''}measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}{', ' if keys else ''}measure) AS every
            FROM (SELECT {keys}{', ' if keys else ''}measure, bin, sum(n) AS n FROM c GROUP BY ALL)
          ) GROUP BY ALL
        )"""  # noqa: E731
    high = lambda m, d, unit: f"(SELECT high FROM f WHERE f.measure = '{m}' AND f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source) + {unit} / greatest(least({d}, (SELECT q50 FROM f WHERE f.measure = '{d}' AND f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source)), 1.0)"
    broken = ", ".join(f"CASE WHEN {n} / greatest({d}, 1) > {high(m, d, unit)} THEN '{m}' END" for m, (n, d, unit) in measures.items() if unit)
    fence = lambda side: f"(SELECT {side} FROM f WHERE f.measure = 'word_length' AND f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source)"
    broken += f", CASE WHEN word_chars / greatest(n_words, 1) > {fence('high')} THEN 'word_length' END, CASE WHEN word_chars / greatest(n_words, 1) < {fence('low')} THEN 'word_length_low' END"
    return rf"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM documents
        ),
        win AS (SELECT r, i, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x, y, z) > 1),
        covered AS (SELECT r, sum(least(3, i - before)) AS n FROM (SELECT r, i, lag(i, 1, i - 3) OVER (PARTITION BY r ORDER BY i) AS before FROM twice) GROUP BY r),
        b AS (
          SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
          FROM d LEFT JOIN covered ON covered.r = d.r
        ),
        v AS ({values}),
        c AS (
          SELECT lang, source, measure, (v >> CAST(greatest(length(bin(v)) - 9, 0) AS BIGINT)) << CAST(greatest(length(bin(v)) - 9, 0) AS BIGINT) AS bin, count(*) AS n
          FROM v GROUP BY ALL
        ),
        {level('s', 'lang, source')}, {level('l', 'lang')}, {level('e', '')},
        g AS (
          SELECT s.lang, s.source, s.measure, CASE WHEN s.n >= 200 THEN 'source' WHEN l.n >= 200 THEN 'lang' ELSE 'all' END AS level,
                 {', '.join(f'CASE WHEN s.n >= 200 THEN s.q{p} WHEN l.n >= 200 THEN l.q{p} ELSE e.q{p} END AS q{p}' for p in (25, 50, 75, 80))},
                 CASE WHEN l.n >= 200 THEN l.q80 ELSE e.q80 END AS l80, CASE WHEN l.n >= 200 THEN l.q95 ELSE e.q95 END AS l95, e.q80 AS e80, e.q95 AS e95
          FROM s JOIN l ON s.measure = l.measure AND s.lang IS NOT DISTINCT FROM l.lang JOIN e ON s.measure = e.measure
        ),
        f AS (
          SELECT lang, source, measure, level, q50, CASE WHEN measure = 'word_length' THEN q25 - 3.0 * (q75 - q25) END AS low,
                 CASE WHEN measure = 'word_length' THEN q75 + 3.0 * (q75 - q25)
                      ELSE greatest(least(q50 + 7.0 * (q50 - q25), greatest(l95, e95)), least(q80, l80, e80)) END AS high
          FROM g
        ),
        j AS (
          SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ',') AS failed,
                 (SELECT any_value(level) FROM f WHERE f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source) AS level
          FROM b
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND failed = '') AS kept, failed, level FROM j
    """
