"""Queries of the subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import embeddings, jaccard, mixing, packing, quality, secrets, suffixes, tokens, warc, windows

QUERIES = {
    "op1_window_dedup": windows.op1_window_dedup,
    "op2_secret_ledger": secrets.op2_secret_ledger,
    "op3_token_files": tokens.op3_token_files,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_embedding_dedup": embeddings.op6_embedding_dedup,
    "op7_best_fit_pack": packing.op7_best_fit_pack,
    "op8_pareto_mix": mixing.op8_pareto_mix,
    "op9_zip_warc": warc.op9_zip_warc,
    "op10_quality_rules": quality.op10_quality_rules,
}


def _secrets_sql() -> str:
    """Matches from extraction, places from the gaps between them; letters of both cases spelled out."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    rules = (("assign", rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", "(AKIA[A-Z0-9]+)", 16), ("hex", "([0-9a-f]+)", 32))
    found = []
    for k, (kind, pattern, least) in enumerate(rules):
        p = pattern.replace("'", "''")
        found.append(f"SELECT doc_id, '{kind}' AS kind, {k} AS ord, {least} AS least, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', 1) AS vs FROM d")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(found)}),
      u AS (SELECT doc_id, kind, ord, least, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
      e AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
      s AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
        string_agg(concat(kind, ':', stop - length(m), ':', stop), ',' ORDER BY stop - length(m), ord) AS spans FROM e WHERE length(v) >= least GROUP BY 1)
      SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
      FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


ORACLE: dict[str, str] = {
    "op2_secret_ledger": _secrets_sql(),
    "op9_zip_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), f AS (SELECT t, min(page_id) AS first FROM p GROUP BY 1),
      h AS (SELECT page_id, octet_length(encode(p.t)) AS n, sha1(p.t) AS h, first FROM p JOIN f ON p.t = f.t)
      SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1) FOR k IN range(32)], '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h""",
    "op6_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
      reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT reach.n, links.b FROM reach JOIN links ON reach.r = links.a),
      counts AS (SELECT a, count(*) AS k FROM links GROUP BY 1)
      SELECT vec_id, CAST(coalesce(max(k), 0) AS BIGINT) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM v JOIN reach ON n = vec_id LEFT JOIN counts ON a = vec_id GROUP BY vec_id""",
    "op5_ngram_jaccard": """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS t FROM k),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
      links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
      reach AS (SELECT doc_id AS m, doc_id AS r FROM d UNION SELECT reach.m, links.b FROM reach JOIN links ON reach.r = links.a)
      SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM d JOIN reach ON m = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""",
    "op1_window_dedup": """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      k AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
      s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM k),
      f AS (SELECT t, min(doc_id) AS first FROM s GROUP BY 1),
      g AS (SELECT DISTINCT s.doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f ON s.t = f.t WHERE s.doc_id > first),
      gl AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY 1),
      a AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gl ON d.doc_id = gl.doc_id)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
        sha256(coalesce(array_to_string(CASE WHEN len(ps) = 0 THEN w ELSE [x FOR x, i IN w IF NOT list_contains(ps, i)] END, ' '), '')) AS kept_sha256 FROM a""",
}
