"""SQL of the queries that SQL can express."""

from __future__ import annotations

from .licenses import BASE, COVERAGE, GAP, NOTICES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def nearest(k: int = 20, every: int = 20) -> str:
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 u AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {k}"""


def licenses() -> str:
    rows = []
    for tid, (text, label, base) in enumerate([(t, n, True) for t, n in BASE] + [(t, n, False) for t, n in NOTICES]):
        w = text.split()
        rows += [f"({tid}, '{label}', {str(base).lower()}, {i}, {len(w) - 1}, '{w[i]}', '{w[i + 1]}')" for i in range(len(w) - 1)]
    return f"""WITH t(tid, label, base, place, grams, u, v) AS (VALUES {', '.join(rows)}),
 d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
 g AS (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM d),
 h AS (SELECT doc_id, tid, label, base, grams, i - 1 - place AS diagonal, place FROM g JOIN t ON ws[i] = u AND ws[i + 1] = v),
 a AS (SELECT doc_id, tid, label, base, grams, diagonal, bit_or(1::BIGINT << place) AS mask FROM h GROUP BY ALL),
 b AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {GAP} OR lag(diagonal) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM a WHERE NOT base WINDOW w AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS run FROM b),
 n AS (SELECT doc_id, label, base, NULL::BIGINT AS s, bit_count(bit_or(mask))::DOUBLE / any_value(grams) AS share FROM c GROUP BY doc_id, tid, label, base, run),
 f AS (SELECT doc_id, label, base, diagonal AS s, 1.0::DOUBLE AS share FROM a WHERE base AND bit_count(mask) = grams UNION ALL SELECT * FROM n WHERE share >= {COVERAGE}),
 x AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY 1)
 SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN x ON d.doc_id = x.doc_id"""


def neardup(words: int = 3, percent: int = 85) -> str:
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(words))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {words - 2})) AS i FROM d WHERE len(ws) >= {words}) UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {words - 1}),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r(id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
 m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id"""


def variants(odd: int = 97, length: int = 5, count: int = 3, ratio: int = 2) -> str:
    crc = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    utf8 = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))"
    return f"""WITH RECURSIVE t AS (SELECT list({crc} ORDER BY i) AS t FROM range(256) r(i)),
 r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
 d AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS s, count(*) AS n FROM r GROUP BY 1, 2),
 h AS (SELECT w, n, xor(list_reduce([4294967295::BIGINT] || {utf8}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS h FROM d, t),
 f AS (SELECT CASE WHEN h % {odd} = 0 THEN substr(w, 1, (h % len(w))::BIGINT) || substr(w, (h % len(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
 v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM f GROUP BY 1 HAVING len(word) >= {length} AND sum(n) >= {count}),
 x AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS p FROM v)),
 y AS (SELECT DISTINCT a.word AS word, b.word AS o, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
 z AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, o) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM y),
 g AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {ratio} * v.n THEN o END AS form, CASE WHEN m >= {ratio} * v.n THEN m END AS form_n FROM v LEFT JOIN z ON z.word = v.word AND k = 1),
 l(word, root, form) AS (SELECT word, word, form FROM g UNION ALL SELECT l.word, g.word, g.form FROM l JOIN g ON l.form = g.word)
 SELECT g.word, g.form, l.root, g.n, g.n_near, g.form_n FROM g JOIN l ON l.word = g.word AND l.form IS NULL"""


def clusters(k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    near = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2])::HUGEINT * (z[1] - z[2])))"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT id, vec_id, any_value(e.v) AS v, min({near} * {k} + c.c) AS m FROM e, c{n} c GROUP BY id, vec_id)")
        if n < rounds:
            steps.append(
                f"s{n} AS (SELECT m % {k} AS c, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m, unnest(v) AS x, unnest(range({dims})) AS p FROM a{n}) GROUP BY 1, 2),"
                f" c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(q.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS v FROM s{n} GROUP BY 1) q ON q.c = c.c)"
            )
    good = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {good}),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM e QUALIFY c < {k}),
 {', '.join(steps)}
 SELECT vec_id, (m % {k})::INTEGER AS cluster, (m // {k})::BIGINT AS distance, (sum(m // {k}) OVER (PARTITION BY m % {k}))::BIGINT AS cluster_inertia, (sum(m // {k}) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = m % {k}"""
