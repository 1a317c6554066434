"""SQL counterparts of the corpus queries, for DuckDB over the same tables."""

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
             - coalesce(sum(source_size * CAST(2 AS DOUBLE)) OVER (ORDER BY source_size * CAST(2 AS DOUBLE) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size * CAST(2 AS DOUBLE) / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM w
), g AS (
  SELECT *, first_value(CASE WHEN weight * lv < source_size * CAST(2 AS DOUBLE) THEN lv END IGNORE NULLS)
            OVER (ORDER BY source_size * CAST(2 AS DOUBLE) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open
  FROM f
), t AS (
  SELECT source, source_size, coalesce(least(source_size * CAST(2 AS DOUBLE), weight * open), source_size * CAST(2 AS DOUBLE)) AS target,
         CAST(('0x' || substr(md5(coalesce(source, '')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM g
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY length(CAST(d.size AS VARCHAR)) * 100 + CAST(substr(CAST(d.size AS VARCHAR), 1, 2) AS INT),
                            md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate * (k + 1) + u) - floor(rate * k + u)) * size AS BIGINT) AS taken FROM p
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) = 1 THEN a
                      ELSE list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) END AS x
  FROM w
), n AS (
  SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles FROM s
), t AS (
  SELECT doc_id, unnest(x) AS g FROM s
), l AS (
  SELECT p.doc_id AS u, q.doc_id AS v
  FROM (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS m FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2) c
  JOIN n p ON p.doc_id = c.i JOIN n q ON q.doc_id = c.j
  WHERE 100 * m >= 80 * (p.n_shingles + q.n_shingles - m)
), e AS (
  SELECT u, v FROM l UNION SELECT v, u FROM l
), r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT e.v, r.seen FROM r JOIN e ON e.u = r.doc_id WHERE r.seen < e.v
), k AS (
  SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id
)
SELECT n.doc_id, n.n_shingles, k.component_id, n.doc_id = k.component_id AS kept FROM n JOIN k ON k.doc_id = n.doc_id
"""

DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS a FROM documents WHERE text IS NOT NULL
), bw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS b FROM benchmark WHERE text IS NOT NULL
), d AS (
  SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) - 1 AS p FROM dw
), i AS (
  SELECT item_id, len(b) AS n, unnest(b) AS w, generate_subscripts(b, 1) - 1 AS j FROM bw
), m AS (
  SELECT DISTINCT doc_id, item_id, n, p - j AS g, j FROM d JOIN i USING (w)
), r AS (
  SELECT doc_id, item_id, n, g, count(*) OVER (PARTITION BY doc_id, item_id, g) AS agreeing,
         count(*) OVER (PARTITION BY doc_id, item_id, g ORDER BY j RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS here
  FROM m
), o AS (
  SELECT doc_id, item_id, n, g, max(agreeing) AS agreeing FROM r GROUP BY doc_id, item_id, n, g
  HAVING max(here) >= CASE WHEN n >= 16 THEN 13 WHEN n >= 12 THEN n - 2 WHEN n >= 8 THEN n - 1 ELSE n END
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, greatest(g, 0)) AS k FROM o
)
SELECT doc_id, item_id, CAST(greatest(g, 0) AS BIGINT) AS first_word, agreeing, CAST(n AS BIGINT) AS item_words FROM b WHERE k = 1
"""

#: Label, words of a notice, words that must be there, words that must not.
_T = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache 2", ""),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4", "nc nd sa"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4", "nd sa"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4", "nc nd"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", "waived", ""),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu 3", "lesser affero"),
    ("gnu-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu", "lesser affero"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted", ""),
    ("mit", "under the mit license", "mit", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", ""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", ""),
    ("no-reuse", "no part of this publication may be reproduced without prior written permission", "reproduced", ""),
]

LICENCES = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t,
         regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents
), p(label, ws) AS (
  VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])
), h AS (
  SELECT r, label, i FROM (SELECT r, a, label, ws, unnest(range(0, len(a))) AS i FROM w, p WHERE list_has_all(a, ws))
  WHERE a[i + 1 : i + len(ws)] = ws
), b AS (
  SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS ls FROM h GROUP BY r
), m AS (
  SELECT row_number() OVER () AS k, label, list_distinct(string_split(txt, ' ')) AS ws, len(string_split(txt, ' ')) AS span, string_split(yes, ' ') AS must, string_split(no, ' ') AS other
  FROM (VALUES %s) AS v(label, txt, yes, no)
), q AS (
  -- Every run of as many words as the notice has, in the texts that hold its words somewhere.
  SELECT r, label, ws, must, other, a[s + 1 : s + span] AS b
  FROM (SELECT r, a, label, ws, span, must, other, unnest(range(0, greatest(1, len(a) - span + 1))) AS s FROM w, m WHERE list_has_all(a, must) AND 10 * len(list_intersect(list_distinct(a), ws)) >= 8 * len(ws))
), c AS (
  SELECT r, list(DISTINCT label) AS own, max(n / CAST(len(ws) AS DOUBLE)) AS shared
  FROM (SELECT *, len(list_intersect(list_distinct(b), ws)) AS n FROM q WHERE list_has_all(b, must) AND NOT list_has_any(b, other))
  WHERE 10 * n >= 8 * len(ws) GROUP BY r
)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word,
       coalesce(array_to_string(list_sort(ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(own, [])))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(shared, 0) END AS score
FROM w LEFT JOIN b ON b.r = w.r LEFT JOIN c ON c.r = w.r
""" % ", ".join(f"({', '.join(map(repr, row))})" for row in _T)

FILTER_AUDIT = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails
  FROM t
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), k AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k
), o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order
  FROM k a JOIN k b ON b.k <> a.k JOIN k c ON c.k NOT IN (a.k, b.k) JOIN k d ON d.k NOT IN (a.k, b.k, c.k) JOIN k e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), s AS (
  SELECT filter_order, step, filter_order[step] AS letter, left(filter_order, step - 1) AS earlier FROM o, range(1, 6) r(step)
), m AS (
  SELECT part, filter_order, step, letter, n, n_good, n_toxic, contains(fails, letter) AS now,
         translate(fails, earlier, '') <> fails AS before, fails = letter AS alone
  FROM c, s
), g AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, letter,
         CAST(coalesce(sum(n) FILTER (WHERE NOT now AND NOT before), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE now AND NOT before), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE now AND before), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n_good) FILTER (WHERE now AND NOT before), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n_toxic) FILTER (WHERE now AND NOT before), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM g
"""
