"""The derived fixtures as common table expressions of the oracle's SQL; a query names those it needs."""

from __future__ import annotations

import re

CTES = {
    "files": """SELECT doc_id, lang AS folder, source || '/' || lang || '/d' || (doc_id % 7) || '/doc' || doc_id || '.txt' AS name, doc_id + 1 AS sequence,
        doc_id % 17 = 0 AS deleted, CAST(strlen(text) AS BIGINT) AS size, 1700000000 + doc_id AS modified_s, CAST(doc_id * 37 % 1000 - 3 AS INTEGER) AS modified_ns,
        1 + doc_id % 5 AS l1, doc_id % 3 AS l2, 0 AS l3, doc_id % 6 AS type_code, text FROM documents""",
    "chunks": """SELECT *, substring(text, block_no * 1024 + 1, 1024) AS chunk FROM
        (SELECT *, CAST(unnest(range(CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS INTEGER) AS block_no FROM files)""",
    "blocks": """SELECT folder, name, doc_id, deleted, size AS file_size, block_no, chunk, sha256(chunk) AS hash, CAST(strlen(chunk) AS BIGINT) AS size,
        CAST(sum(strlen(chunk)) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) - strlen(chunk) AS BIGINT) AS start FROM chunks""",
    "updates": """SELECT folder, CASE WHEN doc_id % 11 = 0 THEN name || '.new' ELSE name END AS name, doc_id, size, deleted, 1 + doc_id * 3 % 5 AS r1, doc_id * 7 % 3 AS r2,
        CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS r3, doc_id % 3 = 0 AS changed, doc_id % 12 AS device FROM files WHERE doc_id % 2 = 0""",
    "pairs": """SELECT f.folder, f.name, f.deleted, l1 + l2 + l3 AS lt, r1 + r2 + r3 AS rt, u.deleted AS rdeleted, u.device, u.changed, u.doc_id, u.size AS rsize,
        CASE WHEN (l1 > r1 OR l2 > r2 OR l3 > r3) AND (l1 < r1 OR l2 < r2 OR l3 < r3) THEN 'Concurrent' WHEN l1 > r1 OR l2 > r2 OR l3 > r3 THEN 'Greater'
        WHEN l1 < r1 OR l2 < r2 OR l3 < r3 THEN 'Less' ELSE 'Equal' END AS relation FROM files f JOIN updates u ON f.folder = u.folder AND f.name = u.name""",
    "peers": """SELECT CASE user_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS folder, user_id % 12 AS device,
        CASE WHEN user_id % 12 = 6 THEN 0 ELSE max(event_id) END AS max_sequence FROM events GROUP BY user_id % 4, user_id % 12""",
    "floors": "SELECT folder, nullif(min(max_sequence), 0) AS floor FROM peers GROUP BY folder",
    "inbox": "SELECT folder, 1 + doc_id % 3 AS epoch, name, sequence, size, doc_id * 7919 % 1009 AS arrival, doc_id % 2 AS missing, doc_id, l1, l2 FROM files WHERE doc_id % 13 = 0",
    "seqs": """SELECT folder, sequence + CASE WHEN doc_id % 83 = 0 THEN 1000000 ELSE 0 END AS seq,
        CASE WHEN doc_id % 89 = 0 THEN name || '.gone' ELSE name END AS name FROM files WHERE doc_id % 97 <> 0""",
    "stored": "SELECT *, regexp_extract(name, '^(.*)/[^/]*$', 1) AS dir FROM blocks WHERE size >= 512",
    "numbers": "SELECT folder, hash, 1023 + row_number() OVER (PARTITION BY folder ORDER BY hash) AS blockseq FROM (SELECT DISTINCT folder, hash FROM stored)",
    "ptrs": "SELECT DISTINCT s.folder, s.dir, s.hash, n.blockseq FROM stored s JOIN numbers n ON s.folder = n.folder AND s.hash = n.hash",
    "refs": "SELECT DISTINCT folder, hash, name, dir FROM stored WHERE hash NOT LIKE '00%'",
    "payloads": """SELECT n.folder, n.blockseq, n.hash, min(s.chunk || CASE WHEN n.hash LIKE 'ab%' THEN 'x' ELSE '' END) AS data
        FROM stored s JOIN numbers n ON s.folder = n.folder AND s.hash = n.hash WHERE n.hash NOT LIKE 'ff%' GROUP BY n.folder, n.blockseq, n.hash""",
    "canonical": """SELECT folder, hash, name, blockseq FROM (SELECT r.folder, r.hash, r.name, p.blockseq, row_number() OVER (PARTITION BY r.folder, r.hash
        ORDER BY r.dir || '//' || regexp_extract(r.name, '([^/]*)$', 1)) AS place FROM refs r JOIN ptrs p ON r.folder = p.folder AND r.dir = p.dir AND r.hash = p.hash
        JOIN payloads d ON p.folder = d.folder AND p.blockseq = d.blockseq) WHERE place = 1""",
    "fileblocks": """SELECT b.folder, b.name, b.doc_id, b.block_no, b.hash, b.size, b.start, b.file_size, b.deleted,
        CASE WHEN b.size < 512 AND b.hash NOT LIKE 'b2%' THEN b.chunk || CASE WHEN b.hash LIKE 'b1%' THEN '!' ELSE '' END END AS inline_data,
        CASE WHEN b.size < 512 THEN NULL WHEN b.hash LIKE 'd8%' THEN 7 WHEN b.hash LIKE 'd7%' THEN n.blockseq + 10000000 ELSE n.blockseq END AS blockseq
        FROM blocks b LEFT JOIN numbers n ON b.folder = n.folder AND b.hash = n.hash""",
    "resolved": """SELECT b.folder, b.name, b.block_no, b.hash, b.size, b.deleted, b.inline_data IS NOT NULL AS is_inline,
        CASE WHEN b.inline_data IS NOT NULL THEN 'inline' WHEN b.blockseq < 1024 THEN 'invalid' WHEN d.data IS NOT NULL THEN 'stored' ELSE 'dangling' END AS source,
        CASE WHEN b.inline_data IS NOT NULL THEN strlen(b.inline_data) WHEN b.blockseq >= 1024 THEN strlen(d.data) END AS stored_size,
        CASE WHEN b.inline_data IS NOT NULL THEN sha256(b.inline_data) WHEN b.blockseq >= 1024 THEN sha256(d.data) END AS stored_hash
        FROM fileblocks b LEFT JOIN payloads d ON b.folder = d.folder AND b.blockseq = d.blockseq""",
    "meta": "SELECT folder, max(sequence) AS max_sequence FROM files WHERE folder <> 'fr' GROUP BY folder",
    "incoming": """SELECT folder, name, block_no, CASE WHEN doc_id % 5 = 0 THEN sha256(hash || '!') ELSE hash END AS hash, CASE WHEN doc_id % 5 = 0 THEN hash || '!' ELSE chunk END AS data,
        regexp_extract(name, '^(.*)/[^/]*$', 1) AS dir FROM blocks""",
    "fresh": """SELECT folder, hash, first + row_number() OVER (PARTITION BY folder ORDER BY hash) - 1 AS blockseq FROM (SELECT DISTINCT folder, hash, CASE WHEN folder = 'en' THEN 5000 ELSE 1024 END AS first
        FROM incoming i WHERE strlen(data) >= 512 AND NOT EXISTS (SELECT 1 FROM canonical c WHERE c.folder = i.folder AND c.hash = i.hash))""",
    "given": "SELECT folder, hash, blockseq FROM canonical UNION ALL SELECT folder, hash, blockseq FROM fresh",
    "highs": "SELECT folder, max(sequence) AS high FROM files GROUP BY folder",
    "ready": """SELECT i.* FROM inbox i JOIN files f ON i.folder = f.folder AND i.name = f.name WHERE i.doc_id % 3 <> 1 AND (f.deleted OR NOT EXISTS
        (SELECT 1 FROM fileblocks b WHERE b.folder = i.folder AND b.name = i.name AND b.inline_data IS NULL AND b.blockseq IS NULL))""",
    "keptfiles": "SELECT s.* FROM files s LEFT JOIN floors f ON s.folder = f.folder WHERE NOT s.deleted OR f.floor IS NULL OR s.sequence >= f.floor // 20",
    "keptblocks": """SELECT * FROM fileblocks b WHERE EXISTS (SELECT 1 FROM keptfiles k WHERE k.doc_id = b.doc_id) OR EXISTS (SELECT 1 FROM inbox i WHERE i.doc_id = b.doc_id AND i.epoch >= 3)""",
    "live": """SELECT DISTINCT b.folder, b.hash, p.blockseq FROM blocks b JOIN ptrs p ON b.folder = p.folder AND b.hash = p.hash
        WHERE NOT (b.deleted AND b.doc_id % 2 = 0)""",
    "checkpoints": """SELECT CASE user_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS folder, '1h' AS name, max(ts) AS create_time,
        max(ts) + INTERVAL 24 HOUR AS expire_time FROM events GROUP BY user_id % 4, date_trunc('hour', ts)
        UNION ALL SELECT CASE user_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END, '1day', max(ts), max(ts) + INTERVAL 168 HOUR
        FROM events GROUP BY user_id % 4, date_trunc('day', ts)""",
    "clock": "SELECT max(ts) AS now FROM events",
    "schedules": "SELECT * FROM (VALUES ('1h', 3600), ('1day', 86400), ('5m', 300), ('7days', 604800)) AS t(name, interval_s)",
    "leases": """SELECT CASE user_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END || '@' || strftime(ts, '%Y-%m-%d %H') AS lock,
        event_id AS epoch, 'h' || (user_id % 5) AS holder, user_id % 3 AS priority, 60 * (1 + event_id % 5) AS duration_s,
        ts + CASE WHEN event_id % 11 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS modified,
        ts + CASE WHEN event_id % 11 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END + to_seconds(60 * (1 + event_id % 5)) AS until FROM events""",
    "scavenged": """SELECT m.lock, m.epoch, l.epoch AS low_epoch, l.priority AS low_priority, CASE WHEN l.until <= m.modified OR l.holder = m.holder THEN 'removed'
        WHEN l.modified > m.modified THEN 'regression' ELSE 'survives' END AS state FROM leases m JOIN leases l ON l.lock = m.lock AND l.epoch < m.epoch""",
    "lockclock": "SELECT lock, max(modified) - INTERVAL 1 MINUTE AS now FROM leases GROUP BY lock",
}


def with_fixtures(sql: str) -> str:
    """The query after the common table expressions it mentions, directly or through others."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in wanted:
                visit(body)
                wanted.append(name)

    visit(sql)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in wanted) + " " + sql if wanted else sql
