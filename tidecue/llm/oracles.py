"""DuckDB SQL that gives the same rows as the queries of the same name."""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(k: int, percent: int, docs: str = "documents") -> str:
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM {docs}),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2)::BIGINT)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS low FROM {docs} UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.low) AS component_id, d.doc_id = min(r.low) AS kept
FROM {docs} d LEFT JOIN n USING (doc_id) JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""


def repeated_substrings(k: int, docs: str = "documents") -> str:
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM {docs}),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k})),
low AS MATERIALIZED (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS p FROM win JOIN low USING (s) WHERE doc_id > low),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = w.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def licenses(templates: dict[str, str], word: str, k: int, percent: int, docs: str = "documents") -> str:
    values = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in templates.items())
    shingles = f"list_distinct(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))"
    return f"""
WITH t AS (SELECT license, {shingles} AS s FROM (SELECT license, regexp_extract_all(lower(x), '{word}') AS w FROM (VALUES {values}) v(license, x))),
tt AS (SELECT license, s, len(s) AS n, greatest(4, 2 ** ceil(log2(2 * len(s))))::BIGINT AS l FROM t WHERE len(s) > 0),
ts AS (SELECT license, n, l, unnest(s) AS x FROM tt),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM {docs}),
p AS MATERIALIZED (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + {k - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})),
hit AS (SELECT doc_id, license, n, l, i, x FROM p JOIN ts USING (x)),
win AS (SELECT doc_id, license, n, l, x, unnest(CASE WHEN i // (l // 2) > 0 THEN [i // (l // 2) - 1, i // (l // 2)] ELSE [0] END) AS win FROM hit),
found AS (SELECT doc_id, license, l, win FROM win GROUP BY doc_id, license, n, l, win HAVING 100 * count(DISTINCT x) >= {percent} * n)
SELECT doc_id, coalesce((SELECT string_agg(DISTINCT license, ',' ORDER BY license) FROM found f WHERE f.doc_id = d.doc_id), '') AS licenses,
  (SELECT count(DISTINCT (l, win)) FROM found f WHERE f.doc_id = d.doc_id) AS n_windows
FROM {docs} d
"""


def nearest(k: int, step: int, table: str = "embeddings") -> str:
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {table} WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS MATERIALIZED (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, max(list_inner_product(q.e, d.e)) AS score FROM ok q JOIN ok d ON d.vec_id <> q.vec_id AND len(d.e) = len(q.e) WHERE q.vec_id % {step} = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= {k}
"""


def divergence(min_docs: int, terms: int, docs: str = "documents") -> str:
    f = "((({0} - {1}) * ({0} - {1})) // ({0} + {1}))"
    return rf"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {docs}),
kept AS MATERIALIZED (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL HAVING count(*) >= {min_docs}),
c AS MATERIALIZED (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN kept USING (lang, t) GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
v AS MATERIALIZED (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
x AS MATERIALIZED (
  SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM (SELECT lang, source, t, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, t)) JOIN v USING (lang)),
q AS MATERIALIZED (
  SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, t, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum({f.format("a.p", "b.p")}) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, {f.format("p", "q")} AS value FROM x JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= {terms}
"""


def collocations(max_words: int, min_count: int, covered: int, rows: int, docs: str = "documents") -> str:
    return rf"""
WITH p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM {docs})),
n AS MATERIALIZED (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, w[i:i + m - 1] AS w, count(*)::HUGEINT AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest(range(1, {max_words + 1})) AS m FROM p) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= {min_count}),
c AS MATERIALIZED (SELECT lang, w, f AS a FROM f WHERE len(w) > 1),
cut AS (SELECT x.lang, x.w, x.a, k, l.f AS l, r.f AS r, (2000000 * a) // (l.f + r.f) AS score
  FROM (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM c) x JOIN f l ON l.lang = x.lang AND l.w = x.w[:k] JOIN f r ON r.lang = x.lang AND r.w = x.w[k + 1:]),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS o FROM cut) WHERE o = 1),
inside AS (SELECT lang, w[i:i + m - 1] AS w, max(a) AS longer FROM (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, a, unnest(range(2, len(w))) AS m FROM c)) GROUP BY lang, w[i:i + m - 1]),
kept AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM best LEFT JOIN inside USING (lang, w) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < {covered} * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {rows}
"""
