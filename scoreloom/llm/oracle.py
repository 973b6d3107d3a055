"""SQL for DuckDB beside the queries that SQL can express.

The others are tested against brute-force versions or on held-out rows (``tests/llm``).
"""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bp AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
     bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win FROM bp),
     dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS l WHERE len(w) >= n),
     hit AS (SELECT dp.doc_id, dp.i, dp.n, bw.item FROM dp JOIN bw ON bw.n = dp.n AND array_to_string(dp.w[dp.i:dp.i + dp.n - 1], ' ') = bw.win),
     hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) AS p GROUP BY doc_id),
     hi AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) AS i GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id"""

_OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
     l AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
     m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m.y, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id"""

_OP8 = rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
     u AS (SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
     r AS (SELECT *, CASE
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
         WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
         WHEN rule IS NOT NULL THEN 'allow'
         WHEN host LIKE '%casino%' OR host LIKE '%free-bets%' OR host LIKE '%porn%' OR host LIKE '%viagra%' THEN 'block'
         WHEN path LIKE '%/wp-login%' THEN 'block'
         ELSE 'allow' END AS verdict
FROM r"""

_OP11 = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_LOWER}) AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)"""

_OP12 = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     h AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
     p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                        ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


def _op13(rounds: int = 5, k: int = 40) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT v.id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM e AS v JOIN c{i} AS c USING (i) GROUP BY v.id, c.c),
     a{i} AS MATERIALIZED (SELECT id, min(struct_pack(d := d, c := c)) AS m FROM d{i} GROUP BY id)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT m.c AS c, i, sum(x) AS s, count(*) AS n FROM a{i} JOIN e USING (id) GROUP BY m.c, i),
     c{i + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} LEFT JOIN s{i} USING (c, i))""")
    between = ",\n     ".join(steps)
    return f"""
WITH k AS (SELECT row_number() OVER () AS id, vec_id, embedding AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     q AS MATERIALIZED (SELECT id, vec_id, list_transform(v, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM k),
     e AS MATERIALIZED (SELECT id, unnest(v) AS x, unnest(range(1, 65)) AS i FROM q),
     f AS (SELECT id, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM q),
     c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN e USING (id) WHERE c < {k}),
     {between},
     t AS (SELECT id, m.c AS c, m.d AS d FROM a{rounds}),
     w AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM t JOIN q USING (id) JOIN w USING (c)"""


ORACLE: dict[str, str] = {
    "op1_decontamination": _OP1,
    "op5_near_dedup": _OP5,
    "op8_url_filter": _OP8,
    "op11_exact_dedup": _OP11,
    "op12_fill_in_middle": _OP12,
    "op13_centroids": _op13(),
}
