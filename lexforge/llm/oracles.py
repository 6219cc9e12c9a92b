"""SQL for the queries of this package that SQL can express, for DuckDB."""

from __future__ import annotations

from lexforge.llm.quality_rules import HOST_LIMITS, LARGEST_PRIOR

_WORDS = r"[^\x20\x09-\x0D]+"


#: From nodes(id) and links(a, b), reach(id, root) with the smallest id that each reaches.
_REACH = """reach(id, root) USING KEY (id) AS (
        SELECT id, id FROM nodes
        UNION
        SELECT l.b, min(r.root) FROM reach r JOIN links l ON l.a = r.id JOIN recurring.reach o ON o.id = l.b WHERE r.root < o.root GROUP BY l.b)"""

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    nodes AS (SELECT DISTINCT vec_id AS id FROM v),
    links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),
    {_REACH}
SELECT v.vec_id, coalesce(n, 0) AS n_links, root AS component_id, v.vec_id = root AS kept
FROM v JOIN reach ON reach.id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = v.vec_id"""

OP5 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS t FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i : i + 2], ' ')) END)) AS x FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    nodes AS (SELECT DISTINCT doc_id AS id FROM documents),
    links AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
    {_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def _op3() -> str:
    rules = {"base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words", "lines": "20 * n_dup_lines > n_words"}
    rate = lambda r: f"(sum({r}) + m_{r} * k_{r}) / (count(*) + k_{r})"
    weight = lambda r: f"CASE WHEN var_pop({r}) > 0 THEN greatest(0, least({LARGEST_PRIOR}, avg({r}) * (1 - avg({r})) / var_pop({r}) - 1)) ELSE {LARGEST_PRIOR} END AS k_{r}, avg({r}) AS m_{r}"
    return rf"""WITH t AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
    lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORDS}')) AS l, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: hash(w[i : i + 2])) AS g FROM t),
    places AS (SELECT doc_id, unnest(g) AS h, unnest(range(1, len(g) + 1)) AS i FROM lines),
    again AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
    covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
    m AS (SELECT lines.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM lines LEFT JOIN covered USING (doc_id)),
    f AS (SELECT *, {', '.join(f'CAST({x} AS INT) AS {r}' for r, x in rules.items())} FROM m),
    prior AS (SELECT {', '.join(weight(r) for r in rules)} FROM (SELECT {', '.join(f'avg({r}) AS {r}' for r in rules)} FROM f GROUP BY host)),
    bad AS (SELECT host, {' OR '.join(f'{rate(r)} >= {HOST_LIMITS[r]}' for r in rules)} AS bad FROM f, prior GROUP BY host, {', '.join(f'm_{r}, k_{r}' for r in rules)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base = 1 AS base_failed, base = 0 AND NOT bad AS kept FROM f JOIN bad USING (host)"""


OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h"""

OP12 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
    a AS (SELECT DISTINCT * FROM e WHERE vec_id % 50 = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id AS id, CAST(list_dot_product(a.x, e.x) AS BIGINT) AS score FROM a JOIN e ON len(a.x) = len(e.x) AND a.vec_id <> e.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree_dedup": OP1, "op3_host_rules": _op3(), "op5_jaccard_join": OP5, "op8_warc_transactions": OP8, "op12_hard_negatives": OP12}
