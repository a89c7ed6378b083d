"""SQL of the operators that SQL can say as a whole."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_components(shingle: int, percent: int, more: str) -> str:
    """All pairs that share a shingle, and components by a recursive search."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= {percent} * (p.n + q.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id{more}
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""


OP2 = jaccard_components(3, 90, "")
OP11 = jaccard_components(2, 80, ", d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept")

#: Operator 12. The CRC of each distinct word is worked out bit by bit.
OP12 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
word AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
crc AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h) + 1, 2), lambda i: CAST(('0x' || substr(h, i, 2)) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, _z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM word
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)
), f AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY doc_id),
v AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (doc_id)
), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM v WHERE n_features >= 20)
SELECT v.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM v LEFT JOIN k USING (doc_id)
"""


def _op13(k: int, rounds: int) -> str:
    """Operator 13, one pair of tables for each round."""
    parts = [
        """
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS no, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, x AS c FROM kept QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT no, vec_id, x, cluster, d FROM (SELECT no, vec_id, x, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r}) QUALIFY row_number() OVER (PARTITION BY no ORDER BY d, cluster) = 1)"
        )
        if r < rounds:
            parts.append(f"u{r} AS (SELECT cluster, i, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS v, unnest(range(64)) AS i FROM a{r}) GROUP BY cluster, i)")
            parts.append(f"m{r} AS (SELECT cluster, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM u{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))")
    last = f"a{rounds}"
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (cluster)
"""
    )


OP13 = _op13(8, 10)

ORACLE_SQL = {"op2_ngram_jaccard_join": OP2, "op11_setsketch": OP11, "op12_importance": OP12, "op13_centroids": OP13}
