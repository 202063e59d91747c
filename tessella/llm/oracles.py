"""Oracle SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from tessella.llm.license_rules import CONFIDENCE, rules
from tessella.llm.licenses import BASE, wrapped

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM f)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(n_spans + 1), lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1,
          2 * (CASE WHEN j = n_spans THEN length(h) // 2 ELSE starts[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE ends[j] END))), '') END AS kept
      FROM d LEFT JOIN n ON d.doc_id = n.doc_id)
SELECT doc_id, n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""

_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"

OP5 = f"""
WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_append(regexp_extract_all({LOWER}, '{SPACE}'), ' end') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_concat([' start', ' start'], w)[:-3]) AS o, unnest(list_prepend(' start', w)[:-2]) AS p, unnest(w) AS w FROM d),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
b AS (SELECT p, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY p, w),
g AS (SELECT o, p, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY o, p, w),
x AS (SELECT p, sum(c) AS c FROM b GROUP BY p),
y AS (SELECT o, p, sum(c) AS c FROM g GROUP BY o, p),
n AS (SELECT sum(c) AS n, count(*) AS v FROM u),
s AS (SELECT doc_id, held_out, coalesce(u.c, 0) AS c, coalesce(b.c, 0) AS cb, coalesce(g.c, 0) AS cg, coalesce(x.c, 0) AS cx, coalesce(y.c, 0) AS cy, n.n, (coalesce(u.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)) AS pu
      FROM t LEFT JOIN u ON t.w = u.w LEFT JOIN b ON t.p = b.p AND t.w = b.w LEFT JOIN g ON t.o = g.o AND t.p = g.p AND t.w = g.w LEFT JOIN x ON t.p = x.p LEFT JOIN y ON t.o = y.o AND t.p = y.p, n)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens,
       round(sum(log10(pu)), 6) AS base_score, round(sum(log10((cg + 50 * (cb + 50 * pu) / (cx + 50)) / (cy + 50))), 6) AS score FROM s GROUP BY doc_id, held_out
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w FROM documents),
n AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END AS n_shingles, w FROM d),
s AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(n_shingles)) AS i FROM n)) GROUP BY ALL),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS common FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE common >= 0.8 * (p.n_shingles + q.n_shingles - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.seen = e.a),
m AS (SELECT doc_id, min(seen) AS class_id FROM c GROUP BY doc_id)
SELECT n.doc_id, coalesce(m.class_id, n.doc_id) AS class_id, n_shingles FROM n LEFT JOIN m ON n.doc_id = m.doc_id
"""


def _op8() -> str:
    table = ", ".join(f"({_quoted(r.gate)}, {_quoted(r.pattern)}, {r.priority}, {_quoted(r.label)}, {r.confidence})" for r in rules())
    base = ", ".join(f"({_quoted(wrapped(p))}, {_quoted(label)}, {len(p.split())})" for p, label in BASE.items())
    return f"""
WITH v AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM documents),
t AS (SELECT doc_id, words, CASE WHEN len(words) = 0 THEN '' ELSE ' ' || array_to_string(words, '  ') || ' ' END AS s, len(words) AS n_words FROM v),
p(phrase, label, size) AS (VALUES {base}),
b AS (SELECT doc_id, label, (length(s) - length(replace(s, phrase, ''))) // length(phrase) AS k,
      (length(string_split(s, phrase)[1]) - length(replace(string_split(s, phrase)[1], ' ', ''))) // 2 AS lo,
      n_words - (length(string_split(s, phrase)[-1]) - length(replace(string_split(s, phrase)[-1], ' ', ''))) // 2 - size AS hi
      FROM t, p WHERE contains(s, phrase)),
bs AS (SELECT doc_id, sum(k) AS n_base, min(lo) AS first_word, max(hi) AS last_word, list(label) AS names FROM b GROUP BY doc_id),
r(gate, pattern, priority, label, confidence) AS (VALUES {table}),
h AS (SELECT doc_id, s, r.* FROM t, r WHERE list_contains(words, gate) AND regexp_matches(s, pattern)),
m AS (SELECT doc_id, priority, label, confidence, regexp_split_to_array(s, pattern) AS gaps, regexp_extract_all(s, pattern) AS found FROM h),
q AS (SELECT doc_id, priority, label, confidence, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS a, length(found[i]) AS n
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, a + n DESC, priority, label, confidence) AS k FROM q),
kept AS (SELECT * FROM z AS x WHERE NOT EXISTS (SELECT 1 FROM z AS y WHERE y.doc_id = x.doc_id AND y.k < x.k AND y.priority <= x.priority AND y.a <= x.a AND y.a + y.n >= x.a + x.n)),
ks AS (SELECT doc_id, list(label) AS names, max(confidence) AS best FROM kept GROUP BY doc_id)
SELECT t.doc_id, n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(list_distinct(bs.names)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.names, []), coalesce(ks.names, [])))), ','), '') AS labels,
       greatest(CAST(coalesce(best, 0) AS DOUBLE), CASE WHEN n_base > 0 THEN {CONFIDENCE[3]} ELSE 0 END) AS score
FROM t LEFT JOIN bs ON t.doc_id = bs.doc_id LEFT JOIN ks ON t.doc_id = ks.doc_id
"""


OP9 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACE}')) AS size, md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), concat(':', md5(coalesce(text, '')))))) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () - sum(w) OVER x AS later, sum(most) OVER x AS upto FROM r WINDOW x AS (ORDER BY most / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, upto + most / w * later <= budget AS is_full FROM o),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, coalesce(CASE WHEN is_full THEN most ELSE (budget - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END, 0) AS target FROM f),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS quota, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(quota - epochs * source_size - a, 0), size) AS BIGINT) AS taken FROM q
"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 8) AS n, array_to_string(w[i + 1 : i + 8], ' ') AS s FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, z)),
m AS (SELECT doc_id, i, x.n, item_id FROM x JOIN g ON x.s = g.s AND x.n = g.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id),
y AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s, n) AS win, s, n FROM (SELECT DISTINCT s, n FROM g)),
e AS (SELECT win, n, unnest(string_split(s, ' ')) AS word, unnest(range(n)) AS k FROM y),
c AS (SELECT DISTINCT doc_id, win, n, k, pos - k + shift AS p FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d) JOIN e USING (word), range(-2, 3) AS t(shift)),
f AS (SELECT DISTINCT doc_id, win FROM (SELECT doc_id, win FROM c GROUP BY doc_id, win, n, p HAVING count(*) = n)),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM f JOIN y USING (win) JOIN g ON g.s = y.s AND g.n = y.n GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN j ON d.doc_id = j.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
"""

ORACLES = {name: " ".join(sql.split("\n")) for name, sql in {"op2_suffix_dedup": OP2, "op5_lm_score": OP5, "op6_near_duplicates": OP6, "op8_license_scan": _op8(), "op9_source_mixing": OP9, "op10_benchmark_decontamination": OP10}.items()}
