"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
        newest AS (SELECT payload_digest, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN newest IS NULL OR page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN newest IS NULL OR page_id IS NOT DISTINCT FROM newest THEN NULL ELSE newest END AS refers_to
        FROM p LEFT JOIN newest USING (payload_digest)
    """,
    "op8_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
        windows AS (
            SELECT k, s, sha256(array_to_string(w[s : s + 34], ' ')) AS h
            FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 33, 1))) AS s FROM d)
        ),
        twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
        covered AS (SELECT DISTINCT k, s + o AS i FROM windows JOIN twice USING (h), range(0, 35) AS r(o)),
        gone AS (SELECT k, count(*) AS n, list(i) AS at FROM covered GROUP BY k),
        words AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (
            SELECT k, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN covered USING (k, i) GROUP BY k
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (k) LEFT JOIN kept USING (k)
    """,
}
