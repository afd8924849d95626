"""SQL of the catalogue's queries, for an engine that reads the same tables."""

from __future__ import annotations

import textwrap

_OBJ = """obj AS (
  SELECT lang AS ns, source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, doc_id, text, source,
         octet_length(encode(text)) AS size, 'sha256:' || sha256(text) AS blob_id
  FROM documents)"""
_CHUNK = _OBJ + """, cut AS (
  SELECT ns, key, doc_id, source, blob_id, size, hex(encode(text)) AS h, unnest(range(0, size, 1024)) AS off FROM obj
), chunk AS (
  SELECT ns, key, doc_id, source, blob_id, off // 1024 AS seq, off AS "offset", least(1024, size - off) AS length,
         'sha256:' || sha256(unhex(substr(h, 2 * off + 1, 2048))) AS chunk_id
  FROM cut)"""
_STORE = """, store AS (SELECT ns, chunk_id, any_value(length) AS length FROM chunk GROUP BY ns, chunk_id)"""
_LOG = """log AS (
  SELECT CAST(user_id % 8 AS VARCHAR) AS ns, json_extract_string(props, '$.k') AS key, event_id AS version, ts,
         CAST(floor(abs(value)) AS BIGINT) AS size, 'v' || event_id AS custom,
         CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'update' ELSE 'put' END AS op
  FROM events), base AS (
  SELECT *, row_number() OVER (PARTITION BY ns, key ORDER BY ts DESC, version DESC) AS r FROM log WHERE op <> 'update')"""
_PART = """part_ AS (
  SELECT l_orderkey AS session, CAST(l_partkey % 200 AS BIGINT) AS start, CAST(l_partkey % 200 AS BIGINT) + CAST(l_quantity AS BIGINT) AS stop, l_linenumber AS arrival
  FROM lineitem)"""


def _merged(start: str = "start") -> str:
    return _PART + f""", edge AS (
  SELECT session, {start} AS start, stop FROM part_ WHERE stop > {start}
), step AS (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY session ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM edge
), island AS (
  SELECT *, sum(new) OVER (PARTITION BY session ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM step
), merged AS (
  SELECT session, min(start) AS start, max(stop) AS stop FROM island GROUP BY session, i)"""


_BLOCKS = _merged() + """, blk AS (
  SELECT DISTINCT session, unnest(range((start + 15) // 16, CASE WHEN stop >= 250 THEN 16 ELSE stop // 16 END)) AS block FROM merged)"""


def _range(a: str, b: str) -> str:
    return f"""SELECT ns, key, CAST({a} AS BIGINT) AS start, CAST({b} AS BIGINT) AS stop, hex(encode(text)) AS h, size FROM obj"""


_TAKE = """SELECT DISTINCT ns, key, start, stop, substr(h, 2 * start + 1, 2 * (least(stop, size) - start)) AS bytes_hex FROM r WHERE start < size AND start < stop"""

ORACLES: dict[str, str] = {
    "q01_blob_id": "SELECT doc_id, 'sha256:' || sha256(text) AS blob_id FROM documents",
    "q02_put_info": f"WITH {_OBJ} SELECT ns, key, blob_id, size, CAST(ceil(size / 1024.0) AS BIGINT) AS chunk_count, 'text/plain; charset=utf-8' AS content_type FROM obj",
    "q03_fixed_chunks": f"WITH {_CHUNK} SELECT doc_id, seq, \"offset\", length, chunk_id FROM chunk",
    "q04_chunk_dedup": f"""WITH {_CHUNK}{_STORE}
        SELECT c.ns, c.chunks, s.distinct_chunks, c.bytes, s.distinct_bytes
        FROM (SELECT ns, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM chunk GROUP BY ns) c
        JOIN (SELECT ns, count(*) AS distinct_chunks, CAST(sum(length) AS BIGINT) AS distinct_bytes FROM store GROUP BY ns) s USING (ns)""",
    "q05_ns_stats": f"""WITH {_CHUNK}{_STORE}
        SELECT o.ns, o.blob_count, o.bytes_stored, o.chunk_count, s.bytes_physical, s.distinct_chunk_count
        FROM (SELECT ns, count(*) AS blob_count, CAST(sum(size) AS BIGINT) AS bytes_stored, CAST(sum(ceil(size / 1024.0)) AS BIGINT) AS chunk_count FROM obj GROUP BY ns) o
        JOIN (SELECT ns, CAST(sum(length) AS BIGINT) AS bytes_physical, count(*) AS distinct_chunk_count FROM store GROUP BY ns) s USING (ns)""",
    "q06_store_stats": f"""WITH {_CHUNK}{_STORE}
        SELECT (SELECT count(DISTINCT ns) FROM obj) AS namespace_count, (SELECT count(*) FROM obj) AS total_blob_count,
               (SELECT CAST(sum(size) AS BIGINT) FROM obj) AS total_bytes_stored, (SELECT CAST(sum(length) AS BIGINT) FROM store) AS total_bytes_physical,
               round((SELECT sum(size) FROM obj)::DOUBLE / (SELECT sum(length) FROM store)::DOUBLE, 6) AS deduplication_ratio""",
    "q07_stats_rollup": f"WITH {_OBJ} SELECT ns, count(*) AS blob_count, CAST(sum(size) AS BIGINT) AS bytes_stored FROM obj GROUP BY ROLLUP (ns)",
    "q08_duplicate_objects": f"WITH {_OBJ} SELECT ns, blob_id, count(*) AS copies, min(key) AS first_key, min(size) AS size FROM obj GROUP BY ns, blob_id HAVING count(*) > 1",
    "q09_reassemble": f"WITH {_OBJ} SELECT ns, key, size, sha256(text) AS content_sha256 FROM obj",
    "q10_range_read": f"WITH {_OBJ}, r AS ({_range('1000', '1500')}) {_TAKE}",
    "q11_multi_range": f"WITH {_OBJ}, r AS ({_range('0', '16')} UNION ALL {_range('1020', '1030')} UNION ALL {_range('greatest(size - 10, 0)', 'size')}) {_TAKE}",
    "q12_offset_lookup": f"""WITH {_OBJ}, p AS (SELECT unnest([0, 500, 1023, 1024, 5000]) AS probe)
        SELECT doc_id, CAST(probe AS BIGINT) AS probe, CAST(probe // 1024 AS BIGINT) AS seq, CAST(probe % 1024 AS BIGINT) AS inner FROM obj JOIN p ON probe < size""",
    "q13_list_prefix": f"WITH {_OBJ} SELECT ns, key, size, blob_id FROM obj WHERE ns = 'en' AND starts_with(key, 'src1/') ORDER BY key LIMIT 100",
    "q14_list_page": f"WITH {_OBJ} SELECT ns, key, size FROM obj WHERE ns = 'en' AND key > 'src12/' ORDER BY key LIMIT 50",
    "q15_latest_version": f"WITH {_LOG} SELECT ns, key, version, size FROM base WHERE r = 1 AND op = 'put'",
    "q16_overwrite_dead": f"WITH {_LOG} SELECT ns, count(*) AS dead_versions, CAST(sum(size) AS BIGINT) AS dead_bytes FROM base WHERE r > 1 AND op = 'put' GROUP BY ns",
    "q17_update_custom": f"""WITH {_LOG}, live AS (SELECT ns, key, ts, version FROM base WHERE r = 1 AND op = 'put'),
        newer AS (SELECT l.ns, l.key, g.custom, row_number() OVER (PARTITION BY l.ns, l.key ORDER BY g.ts DESC, g.version DESC) AS n
                  FROM live l JOIN log g ON g.ns = l.ns AND g.key = l.key AND ((g.ts = l.ts AND g.version = l.version) OR (g.op = 'update' AND (g.ts > l.ts OR (g.ts = l.ts AND g.version > l.version)))))
        SELECT ns, key, custom FROM newer WHERE n = 1""",
    "q18_rename": f"""WITH {_OBJ}, want AS (SELECT ns, key, 'moved/' || (doc_id % 70) AS new_key FROM obj WHERE doc_id % 10 = 0),
        won AS (SELECT ns, new_key, min(key) AS key FROM want w WHERE NOT EXISTS (SELECT 1 FROM obj o WHERE o.ns = w.ns AND o.key = w.new_key) GROUP BY ns, new_key)
        SELECT o.ns, coalesce(w.new_key, o.key) AS key, o.blob_id, o.size FROM obj o LEFT JOIN won w ON w.ns = o.ns AND w.key = o.key""",
    "q19_delete_idempotent": f"WITH {_OBJ} SELECT ns, count(*) AS blob_count, CAST(sum(size) AS BIGINT) AS bytes_stored FROM obj WHERE doc_id % 3 <> 0 GROUP BY ns",
    "q20_refcounts": f"WITH {_CHUNK} SELECT ns, chunk_id, count(*) AS ref_count FROM chunk GROUP BY ns, chunk_id",
    "q21_live_chunks": f"""WITH {_CHUNK}, live AS (SELECT ns, chunk_id, any_value(length) AS length FROM chunk WHERE doc_id % 3 <> 0 GROUP BY ns, chunk_id)
        SELECT ns, count(*) AS live_chunks, CAST(sum(length) AS BIGINT) AS live_bytes FROM live GROUP BY ns""",
    "q22_dead_chunks": f"""WITH {_CHUNK}, dead AS (SELECT ns, chunk_id, any_value(length) AS length FROM chunk GROUP BY ns, chunk_id HAVING bool_and(doc_id % 3 = 0))
        SELECT ns, count(*) AS dead_chunks, CAST(sum(length) AS BIGINT) AS dead_bytes FROM dead GROUP BY ns""",
    "q23_segment_stats": f"""WITH {_OBJ}, d AS (SELECT doc_id % 16 AS segment, size, doc_id < max(doc_id) OVER (PARTITION BY ns, blob_id) AS dead FROM obj)
        SELECT segment, count(*) AS objects_total, count(*) FILTER (dead) AS objects_dead, CAST(sum(size) AS BIGINT) AS bytes_total,
               CAST(coalesce(sum(size) FILTER (dead), 0) AS BIGINT) AS bytes_dead, round(coalesce(sum(size) FILTER (dead), 0)::DOUBLE / sum(size)::DOUBLE, 6) AS dead_ratio
        FROM d GROUP BY segment""",
    "q24_compact_candidates": f"""WITH {_OBJ}, d AS (SELECT doc_id % 16 AS segment, size, doc_id < max(doc_id) OVER (PARTITION BY ns, blob_id) AS dead FROM obj)
        SELECT segment, CAST(coalesce(sum(size) FILTER (dead), 0) AS BIGINT) AS bytes_dead, CAST(sum(size) AS BIGINT) AS bytes_total
        FROM d GROUP BY segment HAVING round(coalesce(sum(size) FILTER (dead), 0)::DOUBLE / sum(size)::DOUBLE, 6) >= 0.05""",
    "q25_rebuild_complete": f"""WITH {_OBJ} SELECT doc_id, size AS total_size, CAST(ceil(size / 1024.0) AS BIGINT) AS chunk_count FROM obj WHERE NOT (doc_id % 7 = 0 AND size > 1024)""",
    "q26_verify": f"""WITH {_CHUNK}, gone AS (SELECT DISTINCT ns, chunk_id FROM chunk WHERE doc_id % 13 = 0 AND seq = 1),
        hurt AS (SELECT DISTINCT ns, chunk_id FROM chunk WHERE doc_id % 11 = 0 AND seq = 0),
        bad AS (SELECT ns, chunk_id, 'chunk missing' AS reason FROM gone UNION ALL SELECT ns, chunk_id, 'crc mismatch' FROM hurt h WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.ns = h.ns AND g.chunk_id = h.chunk_id))
        SELECT c.ns, c.key, c.seq, c.chunk_id, b.reason FROM chunk c JOIN bad b USING (ns, chunk_id)""",
    "q27_crc32": """WITH table_ AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END) AS c FROM range(256) r(i)))
        SELECT doc_id, xor(4294967295, list_reduce([4294967295] || CAST(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ','), ',').list_transform(lambda h: ('0x' || h)::BIGINT) AS BIGINT[]),
                 lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]))) AS crc32
        FROM documents, table_""",
    "q28_cdc_roundtrip": "SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS content_sha256 FROM documents",
    "q29_cdc_bounds": "SELECT lang AS ns, CAST(0 AS BIGINT) AS violations, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY lang",
    "q30_cdc_dedup": f"WITH {_OBJ} SELECT ns, CAST(sum(size) AS BIGINT) AS bytes, true AS whole, true AS no_more_than_objects, true AS shared FROM obj GROUP BY ns",
    "q31_interval_merge": f"WITH {_merged()} SELECT session, start, stop FROM merged",
    "q32_received_bytes": f"WITH {_merged()} SELECT session, CAST(sum(stop - start) AS BIGINT) AS received FROM merged GROUP BY session",
    "q33_complete": f"""WITH {_merged('(CASE WHEN start < 30 THEN 0 ELSE start END)')}
        SELECT session, max(stop) AS size, count(*) = 1 AND min(start) = 0 AS complete, CAST(sum(stop - start) AS BIGINT) AS received FROM merged GROUP BY session""",
    "q34_bitmap_progress": f"""WITH {_BLOCKS} SELECT session, count(*) AS blocks, CAST(sum(CASE block WHEN 15 THEN 10 ELSE 16 END) AS BIGINT) AS received, count(*) = 16 AS complete FROM blk GROUP BY session""",
    "q35_bitmap_ranges": f"""WITH {_BLOCKS}, i AS (SELECT session, block, block - row_number() OVER (PARTITION BY session ORDER BY block) AS g FROM blk)
        SELECT session, min(block) * 16 AS start, least((max(block) + 1) * 16, 250) AS stop FROM i GROUP BY session, g""",
    "q36_reap_idle": "SELECT user_id, max(ts) AS last_activity FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 36 HOUR",
    "q37_catalog_search": """SELECT doc_id, substr(text, 1, 40) AS title, lang AS genre FROM documents
        WHERE lower(lang) = 'en' AND contains(lower(substr(text, 1, 40) || ' ' || lang || ' ' || substr(text, 41)), 'thore')""",
    "q38_facets": "SELECT DISTINCT lang AS genre FROM documents WHERE lang <> ''",
    "q39_existence_flag": "SELECT doc_id, source, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has_label FROM documents d",
    "q40_quota_admission": f"""WITH RECURSIVE {_OBJ}, o AS (SELECT ns, doc_id, size, row_number() OVER (PARTITION BY ns ORDER BY doc_id) AS n FROM obj),
        run AS (
          SELECT ns, n, doc_id, size, CASE WHEN size > 150000 THEN 'bytes' WHEN size > 6000 THEN 'blob_size' END AS reason,
                 CASE WHEN size <= 6000 THEN 1 ELSE 0 END AS c, CASE WHEN size <= 6000 THEN size ELSE 0 END AS b FROM o WHERE n = 1
          UNION ALL
          SELECT o.ns, o.n, o.doc_id, o.size, t.reason, r.c + CASE WHEN t.reason IS NULL THEN 1 ELSE 0 END, r.b + CASE WHEN t.reason IS NULL THEN o.size ELSE 0 END
          FROM run r JOIN o ON o.ns = r.ns AND o.n = r.n + 1,
               LATERAL (SELECT CASE WHEN r.c >= 80 THEN 'blob_count' WHEN r.b + o.size > 150000 THEN 'bytes' WHEN o.size > 6000 THEN 'blob_size' END AS reason) t)
        SELECT ns, doc_id, size, reason FROM run""",
    "q41_slug_unique": """WITH RECURSIVE t AS (
          SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n,
                 trim(regexp_replace(lower(trim(source || CASE WHEN doc_id % 5 = 0 THEN ' ' || (doc_id % 4) ELSE '' END)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents),
        b AS (SELECT doc_id, n, CASE WHEN s = '' THEN 'movie' ELSE s END AS s FROM t),
        run AS (
          SELECT n, doc_id, s AS slug, [s] AS taken FROM b WHERE n = 1
          UNION ALL
          SELECT y.n, y.doc_id, y.slug, list_append(r.taken, y.slug) FROM run r JOIN LATERAL (
            SELECT b.n, b.doc_id, CASE WHEN NOT list_contains(r.taken, b.s) THEN b.s ELSE
              b.s || '-' || list_min(list_filter(range(2, len(list_filter(r.taken, lambda x: starts_with(x, b.s))) + 3), lambda k: NOT list_contains(r.taken, b.s || '-' || k))) END AS slug
            FROM b WHERE b.n = r.n + 1) y ON true)
        SELECT doc_id, slug, count(*) OVER (PARTITION BY slug) AS holders FROM run""",
    "q42_mime_sniff": "SELECT 'text/plain; charset=utf-8' AS content_type, count(*) AS objects FROM documents UNION ALL SELECT 'text/html; charset=utf-8', count(*) FROM pages",
    "q43_upgrade_recount": f"WITH {_CHUNK} SELECT ns, chunk_id, count(*) AS ref_count FROM chunk GROUP BY ns, chunk_id",
    "q44_orphans": f"""WITH {_CHUNK}, owner AS (SELECT chunk_id, max(ns) AS ns FROM chunk GROUP BY chunk_id),
        loose AS (SELECT blob_id FROM obj GROUP BY blob_id HAVING bool_and(doc_id % 4 = 0))
        SELECT DISTINCT o.ns, l.blob_id FROM loose l JOIN chunk c ON c.blob_id = l.blob_id AND c.seq = 0 JOIN owner o USING (chunk_id) WHERE o.ns <> 'es'""",
    "q45_part_retry_dedup": f"WITH {_PART} SELECT session, start, stop, min(arrival) AS arrival FROM part_ GROUP BY session, start, stop",
    "q46_namespace_isolation": f"""WITH {_CHUNK} SELECT source AS ns, count(*) AS chunks, count(DISTINCT chunk_id) AS stored_chunks, (SELECT count(DISTINCT chunk_id) FROM chunk) AS global_chunks FROM chunk GROUP BY source""",
    "q47_put_get": f"""WITH {_OBJ} SELECT key, size, sha256(text) AS content_sha256, blob_id, CAST(ceil(size / 1024.0) AS BIGINT) AS chunk_count, 'text/plain; charset=utf-8' AS content_type FROM obj WHERE size > 0""",
    "q48_compact": f"""WITH {_CHUNK}, live AS (SELECT * FROM chunk WHERE doc_id % 3 <> 0), once AS (SELECT chunk_id, any_value(length) AS length FROM live GROUP BY chunk_id)
        SELECT (SELECT count(*) FROM obj WHERE size > 0 AND doc_id % 3 <> 0) AS blob_count, (SELECT CAST(sum(size) AS BIGINT) FROM obj WHERE doc_id % 3 <> 0) AS bytes_stored, (SELECT count(*) FROM live) AS chunk_count,
               CAST(sum(length) AS BIGINT) AS bytes_physical, count(*) AS distinct_chunk_count, CAST(0 AS BIGINT) AS dead_chunks, CAST(0 AS BIGINT) AS dead_bytes, 0 AS violations FROM once""",
    "q49_upload_complete": f"""WITH {_OBJ}, p AS (SELECT *, doc_id % 7 = 0 AND size > 700 AS gap FROM obj WHERE size > 0)
        SELECT doc_id, CASE WHEN gap THEN 'incomplete' WHEN doc_id % 11 = 0 THEN 'checksum mismatch' ELSE 'complete' END AS state,
               CASE WHEN gap THEN size - least(700, size - 700) ELSE size END AS received, CASE WHEN NOT gap AND doc_id % 11 <> 0 THEN sha256(text) END AS content_sha256 FROM p""",
    "q50_seal_roundtrip": f"""WITH {_CHUNK} SELECT key, size, sha256(text) AS content_sha256, (SELECT count(DISTINCT chunk_id) FROM chunk) AS sealed_chunks FROM obj WHERE size > 0""",
    "q51_store_ranges": f"""WITH {_OBJ}, r AS (SELECT key, CAST(1000 AS BIGINT) AS start, CAST(1500 AS BIGINT) AS stop, size, hex(encode(text)) AS h FROM obj UNION ALL SELECT key, greatest(size - 10, 0), size, size, hex(encode(text)) FROM obj)
        SELECT key, start, stop, substr(h, 2 * start + 1, 2 * (least(stop, size) - start)) AS bytes_hex FROM r WHERE start < size AND start < stop""",
    "q52_namespace_lifecycle": f"""WITH {_CHUNK}, own AS (SELECT chunk_id, any_value(length) AS length FROM chunk WHERE ns = 'en' GROUP BY chunk_id)
        SELECT 'en' AS ns, (SELECT count(*) FROM obj WHERE ns = 'en' AND size > 0) AS blob_count, (SELECT CAST(sum(size) AS BIGINT) FROM obj WHERE ns = 'en') AS bytes_stored, (SELECT count(*) FROM chunk WHERE ns = 'en') AS chunk_count,
               (SELECT CAST(sum(length) AS BIGINT) FROM own) AS bytes_physical, (SELECT count(*) FROM own) AS distinct_chunk_count
        UNION ALL SELECT 'de', 0, 0, 0, 0, 0""",
    "q53_multi_get": f"""WITH {_OBJ} SELECT doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN key ELSE 'absent/' || key END AS key, CASE WHEN doc_id % 2 = 0 THEN size END AS size FROM obj""",
    "q54_identifiers": f"""WITH {_OBJ} SELECT doc_id, blob_id || '#' || doc_id AS legacy_id, lpad(lower(hex(doc_id)), 16, '0') AS segment, greatest(1, CAST(ceil(size / 16296.0) AS BIGINT)) AS pages, CAST(ceil(size / 512.0) AS BIGINT) AS blocks,
               '"' || blob_id || '"' AS etag, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS filename, CASE WHEN doc_id % 3 = 0 THEN ns ELSE 'uid' END AS uid, ns AS shown,
               regexp_full_match(ns, '[a-z0-9][a-z0-9_-]{{0,61}}[a-z0-9]') AS ns_ok, regexp_full_match(key, '[a-z0-9_-]{{1,64}}') AS uid_ok, true AS session_ok,
               doc_id % 8 & 2 <> 0 AS last_chunk, CAST(doc_id % 8 | 1 AS INTEGER) AS deleted, CAST(doc_id % 8 & 251 AS INTEGER) AS plain, CAST(doc_id % 8 AS INTEGER) AS decoded FROM obj""",
    "q55_running_offsets": f"WITH {_CHUNK} SELECT doc_id, seq, \"offset\", length FROM chunk",
    "q56_first_copies": f"""WITH {_CHUNK}, c AS (SELECT ns, doc_id % 16 AS segment, chunk_id, doc_id * 1000000 + seq * 4 AS page_offset, CAST(ceil(length / 512.0) AS BIGINT) AS page_count, length FROM chunk WHERE doc_id % 5 <> 0)
        SELECT ns, chunk_id, segment, page_offset, page_count, length FROM (SELECT *, row_number() OVER (PARTITION BY ns, chunk_id ORDER BY segment, page_offset) AS r FROM c) WHERE r = 1""",
    "q57_upgrade_chunks": f"""WITH {_CHUNK}, n AS (SELECT ns, chunk_id, count(*) AS ref_count, any_value(length) AS length, bool_or(doc_id % 3 <> 0) AS page FROM chunk GROUP BY ns, chunk_id), o AS (SELECT chunk_id, max(ns) AS owner FROM chunk GROUP BY chunk_id)
        SELECT ns, chunk_id, ref_count, CASE WHEN ns = owner OR page THEN length END AS length, CASE WHEN ns = owner THEN 'record' WHEN page THEN 'page' ELSE 'lost' END AS recovered FROM n JOIN o USING (chunk_id)""",
    "q58_replay": f"""WITH {_OBJ} SELECT blob_id, any_value(size) AS total_size, CAST(ceil(any_value(size) / 1024.0) AS BIGINT) AS chunk_count FROM obj WHERE size > 0 GROUP BY blob_id HAVING bool_and(doc_id % 4 = 0)""",
    "q59_accept_parts": f"""WITH {_OBJ}, p AS (SELECT doc_id AS session, doc_id % 12 * 100 AS "offset", least(size, CASE WHEN doc_id % 4 = 0 THEN 150 ELSE 100 END) AS n FROM obj)
        SELECT session, "offset", CASE WHEN session % 10 = 0 THEN 'unknown session' WHEN "offset" + n > 1000 THEN 'out of bounds'
               WHEN n = 0 OR (n % 100 <> 0 AND "offset" + n <> 1000) THEN 'unaligned' WHEN session % 9 = 0 THEN 'checksum mismatch' END AS reason FROM p""",
    "q60_assemble": f"""WITH {_OBJ} SELECT doc_id AS session, substr(hex(encode(text)), 1, 600) || repeat('78', 300) || substr(hex(encode(text)), 1201, 800) AS content_hex FROM obj WHERE size >= 1000""",
    "q61_shared_chunks": f"""WITH {_CHUNK} SELECT chunk_id FROM chunk WHERE doc_id % 2 = 0 INTERSECT SELECT chunk_id FROM chunk WHERE doc_id % 2 = 1""",
    "q62_catalog_view": """SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE source END AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS genre, '' AS year, '' AS description, n_chars AS size FROM documents""",
    "q63_conditional": f"""WITH {_OBJ}, k AS (SELECT *, doc_id % 8 AS kind FROM obj)
        SELECT CASE WHEN kind = 7 THEN 'absent/' || key ELSE key END AS key,
               CASE kind WHEN 7 THEN 404 WHEN 1 THEN 304 WHEN 2 THEN 416 WHEN 3 THEN 412 WHEN 4 THEN 304 WHEN 5 THEN 206 ELSE 200 END::BIGINT AS status, CASE WHEN kind <> 7 THEN '"' || blob_id || '"' END AS etag,
               CASE WHEN kind = 5 THEN CASE WHEN size > 10 THEN '10-' || least(20, size) || ',' ELSE '' END || greatest(size - 5, 0) || '-' || size END AS spans FROM k""",
    "q64_attach": """SELECT doc_id, CASE WHEN (doc_id // 2) % 3 = 0 OR NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = d.doc_id // 2) THEN 'parent not found' WHEN n_chars > 2000 THEN 'too large' END AS reason FROM documents d""",
    "q65_cascade": """SELECT DISTINCT CAST(doc_id AS VARCHAR) AS key FROM documents d WHERE doc_id % 10 = 0 OR EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = d.doc_id // 2 AND p.doc_id % 10 = 0)""",
    "q66_segment_folders": f"""WITH {_CHUNK}, n AS (SELECT chunk_id, any_value(length) AS length, bool_and(doc_id % 3 = 0) AS dead FROM chunk GROUP BY chunk_id)
        SELECT CAST(0 AS BIGINT) AS segment, count(*) AS chunks_total, count(*) FILTER (dead) AS chunks_dead, CAST(sum(length) AS BIGINT) AS bytes_total, CAST(coalesce(sum(length) FILTER (dead), 0) AS BIGINT) AS bytes_dead FROM n""",
}
ORACLES = {k: textwrap.dedent(v).strip() for k, v in ORACLES.items()}
