"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dedup import op5_near_duplicates
from .html import op4_main_text
from .media import op1_media
from .mixing import op10_mixing
from .neighbours import op7_neighbours
from .packing import op2_packing
from .quality import op9_quality
from .repeats import op6_repeats
from .secrets import op3_secrets
from .warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_main_text": op4_main_text,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_repeats": op6_repeats,
    "op7_neighbours": op7_neighbours,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Plain definitions, by all pairs and all windows, where SQL can express an operator: fit for small tables.
ORACLE_SQL: dict[str, str] = {
    # sets of runs of words, all pairs that share one, and what can be reached by links
    "op5_near_duplicates": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) t(i)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.doc_id WHERE r.c < e.x)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM (SELECT doc_id, n, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) USING (doc_id))""",
    # each window of 50 bytes (as hexadecimal, in pieces of 500 windows), covered runs, and what lies between them
    "op6_repeats": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    p AS (SELECT doc_id, k * 500 AS base, substring(x, (1000 * k + 1)::INT, 1098) AS x FROM d, unnest(range(0, len(x) // 1000 + 1)) t(k)),
    w AS (SELECT doc_id, base + i AS i, substring(x, (2 * i + 1)::INT, 100) AS s FROM p, unnest(range(0, least(500, greatest(len(x) // 2 - 49, 0)))) t(i)),
    f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
    c AS (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE first < w.doc_id),
    g AS (SELECT *, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
    n AS (SELECT *, sum((before IS NULL OR before < i)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
    r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, span),
    k AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM r GROUP BY doc_id)
    SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda j: b[j] - a[j])), 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN a IS NULL THEN x ELSE list_aggregate(list_transform(range(0, len(a) + 1), lambda j: substring(x, (2 * CASE WHEN j = 0 THEN 0 ELSE b[j] END + 1)::INT, (2 * (CASE WHEN j = len(a) THEN len(x) // 2 ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE b[j] END))::INT)), 'string_agg', '') END)) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)""",
    # base 32 by five bits of the hexadecimal digest at a time
    "op8_warc": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
    b AS (SELECT page_id, url, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substring(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) % 32 + 1, 1)), 'string_agg', '') AS payload_digest FROM d),
    r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM r""",
}
