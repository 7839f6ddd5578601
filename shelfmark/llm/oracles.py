"""SQL that gives the same rows as the queries, where SQL can express them. Dialect: DuckDB."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, HEX, LOOSE, MIN_ASSIGN

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BASE32 = """list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31) AS BIGINT), 1)),
    lambda a, b: a || b)), lambda a, b: a || b)"""

OP1 = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m"""

OP3 = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""

OP4 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) = 1 THEN ws
        ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
    SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, w.doc_id = min(r.b) AS kept
    FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""

#: Rates of at most 200, which is where a draw is one inversion.
OP6 = """WITH d AS (SELECT *, coalesce(source, '') AS k, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13) AS BIGINT) / CAST(1::BIGINT << 52 AS DOUBLE) AS u FROM documents),
    r AS (SELECT k, 1.0 / (count(*) OVER ()) * (sum(n) OVER ()) / n AS rate FROM (SELECT k, count(*) AS n FROM d GROUP BY 1)),
    c AS (SELECT k, x, sum(exp(-rate + x * ln(rate) - lgamma(x + 1))) OVER (PARTITION BY k ORDER BY x) AS cum
        FROM r, range(0, 500) AS t(x) WHERE x <= ceil(rate + 12 * sqrt(rate) + 24)),
    n AS (SELECT d.*, (SELECT count(*) FROM c WHERE c.k = d.k AND c.cum <= d.u) AS n FROM d)
    SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, CAST(n AS INTEGER) AS n_copies,
    md5('mix-1-order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key FROM (SELECT *, unnest(range(0, n)) AS copy FROM n)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: int, pattern: str, group: int, keep: str) -> str:
    p = _quoted(pattern)
    return f"""SELECT rid, {kind} AS kind, s, e, v FROM (SELECT rid, e - length(alls[i]) AS s, e, vals[i] AS v FROM (SELECT *,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(alls[1:i], lambda x: length(x))) AS e
        FROM (SELECT *, unnest(range(1, len(alls) + 1)) AS i FROM (SELECT rid, string_split_regex(t, {p}) AS gaps,
        regexp_extract_all(t, {p}, 0) AS alls, regexp_extract_all(t, {p}, {group}) AS vals FROM d WHERE regexp_matches(t, {p}))))) WHERE {keep}"""


_SPAN = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'loose' END || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"

OP8 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o,
        coalesce(source, '') || chr(31) || coalesce(lang, '') AS repo FROM documents),
    base AS ({_matches(0, ASSIGN, 2, f"length(v) >= {MIN_ASSIGN}")} UNION ALL {_matches(1, ACCESS, 0, "true")} UNION ALL {_matches(2, HEX, 0, "true")}),
    loose AS ({_matches(3, LOOSE, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")}),
    c AS (SELECT * FROM base UNION ALL SELECT * FROM loose x WHERE NOT EXISTS
        (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s < x.e AND x.s < b.e)),
    f AS (SELECT v, CASE WHEN count(DISTINCT o) >= 3 OR count(DISTINCT repo) >= 4 THEN 'example' WHEN count(DISTINCT o) = 1 THEN 'live' ELSE 'shared' END AS class
        FROM c JOIN d USING (rid) GROUP BY 1),
    k AS (SELECT c.*, class FROM c JOIN f USING (v) WHERE kind < 3 OR class = 'live'),
    a AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
        coalesce(string_agg({_SPAN}, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3), '') AS base, string_agg({_SPAN}, ',' ORDER BY s, kind, e) AS spans,
        count(*) FILTER (WHERE class = 'live') AS n_live, count(*) FILTER (WHERE class = 'example') AS n_example FROM k GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM d LEFT JOIN a USING (rid)"""

OP10 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM benchmark),
    p AS (SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
        FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
    x AS (SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win FROM
        (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM p) WHERE len(ws) >= size)),
    h AS (SELECT x.rid, x.i, x.size, p.item FROM x JOIN p USING (size, win)),
    t AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM h) GROUP BY 1),
    j AS (SELECT rid, count(DISTINCT item) AS n_items, coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '') AS items FROM h GROUP BY 1)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN t USING (rid) LEFT JOIN j USING (rid)"""

OP12 = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
    t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
    o AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM
        (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) AS s(k) WHERE len(ws) >= k)),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    x AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
    s AS (SELECT x.lang, x.phrase, x.a, cut, p.a AS l, q.a AS r, CAST(CAST(x.a AS HUGEINT) * 2000000 // (CAST(p.a AS HUGEINT) + q.a) AS BIGINT) AS score
        FROM x JOIN f p ON p.lang = x.lang AND p.phrase = lp JOIN f q ON q.lang = x.lang AND q.phrase = rp),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    e AS (SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a AS longer FROM
        (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
    z AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = b.lang AND e.phrase = b.phrase AND CAST(longer AS HUGEINT) * 100 >= CAST(b.a AS HUGEINT) * 80))
    SELECT lang, rank, phrase, a, l, r, n, score FROM
    (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) JOIN t USING (lang) WHERE rank <= 2000"""


def _lloyd(rounds: int) -> str:
    """Tables b0 to b<rounds>: codebooks; n0 to n<rounds>: each part's nearest entry and its distance."""

    def assigned(r: int) -> str:
        return f"""n{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM
        (SELECT p.rid, p.part, b.entry, CAST(p.sq - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) AS d
            FROM p JOIN b{r} b USING (part)) GROUP BY 1, 2)"""

    out = [assigned(0)]
    for r in range(1, rounds + 1):
        out += [
            f"""b{r} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r - 1} b LEFT JOIN
        (SELECT part, entry, list(x ORDER BY place) AS v FROM (SELECT n.part, n.entry, place, floor(sum(p.v[place]) / count(*)) AS x
            FROM n{r - 1} n JOIN p USING (rid, part), range(1, 17) AS t(place) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry))""",
            assigned(r),
        ]
    return ",\n    ".join(out)


#: For vectors of 64 components, as the tables have them.
OP13 = f"""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v
        FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT rid, part, v, list_dot_product(v, v) AS sq FROM
        (SELECT rid, part, v[part * 16 + 1:part * 16 + 16] AS v FROM e, range(0, 4) AS t(part))),
    b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= 256),
    {_lloyd(4)},
    h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM
        (SELECT part, entry, unnest(range(1, 17)) AS place, unnest(v) AS x FROM b4)),
    c AS (SELECT rid, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n4 GROUP BY 1)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN c USING (rid), h"""

ORACLE_SQL = {
    "op1_warc": OP1,
    "op3_vptree": OP3,
    "op4_minhash": OP4,
    "op6_mixing": OP6,
    "op8_secrets": OP8,
    "op10_decontamination": OP10,
    "op12_phrases": OP12,
    "op13_codes": OP13,
}
