"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: Exact: all pairs of documents that share a shingle, then the smallest document reachable.
OP2 = """
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
two AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT walk.a, two.b FROM walk JOIN two ON two.a = walk.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM walk GROUP BY a) m USING (doc_id)
"""

#: Every document's score for every item, then the first ten.
OP12 = """
WITH t AS MATERIALIZED (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents),
q AS MATERIALIZED (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM benchmark) GROUP BY item_id, term),
all_of AS (SELECT count(DISTINCT doc_id) AS big_n, count(*) AS big_l FROM t),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, all_of GROUP BY term, big_n),
s AS (
    SELECT q.item_id, tf.doc_id, CAST(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + ((75 * d.n * big_n) // big_l))))) AS BIGINT) AS score
    FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN d ON d.doc_id = tf.doc_id, all_of
    GROUP BY q.item_id, tf.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


#: One part of an address, at most 255.
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, CAST(len({_DIGITS}) AS BIGINT) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER)
         ELSE 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) - CASE WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
#: Kind, pattern, and what a match ``m`` of it must pass; fixed by the contract of the operators.
_PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_full_match(m, '{_PART}(\\.{_PART}){{3}}')"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN len({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15"),
]
_NAMES = "|".join(
    "".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in name) for name in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = [
    ("assign", _ASSIGN, f"len(regexp_extract(m, '{_ASSIGN}', 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "len(m) >= 16"),
    ("hex", "[0-9a-f]+", "len(m) >= 32"),
]


def _base_spans(kinds: list[tuple[str, str, str]], order: str) -> str:
    """Counts by kind and the hash of all spans of every document; a match starts after the texts between matches and the matches before it."""
    each = " UNION ALL ".join(
        f"""SELECT r, {number} AS kind, '{name}' AS name, m, first, first + len(m) AS last FROM (
            SELECT r, m, sum(len(g)) OVER w + coalesce(sum(len(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
            FROM (SELECT r, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS i
                  FROM (SELECT r, regexp_extract_all(x, '{pattern}') AS ms, string_split_regex(x, '{pattern}') AS gs FROM t) WHERE len(ms) > 0)
            WINDOW w AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {test}"""
        for number, (name, pattern, test) in enumerate(kinds)
    )
    counts = ", ".join(f"count(*) FILTER (name = '{name}') AS n_{name}" for name, _, _ in kinds)
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
s AS ({each})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(CASE WHEN name IS NOT NULL THEN concat(name, ':', first, ':', last) END, ',' ORDER BY {order}), '')) AS base_sha256
FROM t LEFT JOIN s USING (r) GROUP BY r, doc_id
"""


PERSONAL_DATA = _base_spans(_PERSONAL, "kind, first")
SECRETS = _base_spans(_SECRETS, "first, kind")

#: Sizes from the texts; balance and gapless slots hold for any table.
RING = """
SELECT count(*) AS documents, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes, least(count(*), 16) AS shards, true AS even, true AS gapless
FROM documents
"""

#: Every document is packed whole: its pieces follow each other, and so do those of a sequence.
PACKING = """
SELECT count(*) AS documents, count(*) AS begun, CAST(0 AS BIGINT) AS cut_without_need, true AS whole, true AS gapless, true AS fit FROM documents
"""


#: Exact: every 100-byte string of every text, as hexadecimal digits; all but the first of equal ones are removed.
OP10 = """
WITH d AS MATERIALIZED (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(greatest(n - 99, 0))) AS pos FROM d)),
r AS MATERIALIZED (SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1),
i AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
    SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS new FROM r)),
p AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM i GROUP BY doc_id, island),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
g AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
    FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

#: The whole numbers of op11: different vectors, and every vector's squared distance from their mean, times n * n.
WHITENING = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT DISTINCT x FROM e),
m AS (SELECT dim, sum(v) AS s FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS dim FROM f) GROUP BY dim),
c AS (SELECT count(*) AS n FROM f),
t AS (SELECT c.n, list(s ORDER BY dim) AS s FROM m, c GROUP BY c.n)
SELECT vec_id, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS BIGINT) AS deviation FROM e, t
"""

#: Edited texts of op7: the last third gives way to the beginning of the next document.
EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
t AS (SELECT doc_id, x, coalesce(lead(x) OVER (ORDER BY doc_id DESC), first_value(x) OVER (ORDER BY doc_id DESC)) AS y FROM d)
SELECT doc_id, length(x) AS n_chars, sha256(concat(substr(x, 1, length(x) - length(x) // 3), substr(y, 1, length(x) // 3))) AS edited_sha256 FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minmax": OP2,
        "op10_repeats": OP10,
        "op12_lexical": OP12,
        "text_edited_documents": EDITED,
        "text_whitening_totals": WHITENING,
        "text_personal_data_base": PERSONAL_DATA,
        "text_secrets_base": SECRETS,
        "text_ring_balance": RING,
        "text_packing_balance": PACKING,
    }
