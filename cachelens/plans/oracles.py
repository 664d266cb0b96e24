"""DuckDB SQL for the queries: written on its own, not derived from the DataFrame code."""

from __future__ import annotations

from cachelens.functions.signing import signing_key
from cachelens.operators.telemetry import BOUNDS

M = 2**64 - 1
#: Primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def u(x: object) -> str:
    return f"CAST({x} AS UHUGEINT)"


def mask(x: str) -> str:
    return f"(({x}) & {u(M)})"


def rotl(x: str, r: int) -> str:
    return f"({mask(f'{x} * {u(2**r)}')} + {x} // {u(2 ** (64 - r))})"


def hashed(source: str, key: str) -> str:
    """CTEs up to h5, which has the columns of source and h, the hash of the non-negative long `key`."""
    return f"""
    h0 AS (SELECT *, {mask(f'{u(key)} * {u(P2)}')} AS v FROM {source}),
    h1 AS (SELECT * REPLACE ({mask(f'{rotl("v", 31)} * {u(P1)}')} AS v) FROM h0),
    h2 AS (SELECT * REPLACE (xor({u(P5 + 8)}, v) AS v) FROM h1),
    h3 AS (SELECT * REPLACE ({mask(f'{mask(f"{rotl('v', 27)} * {u(P1)}")} + {u(P4)}')} AS v) FROM h2),
    h4 AS (SELECT * REPLACE ({mask(f'xor(v, v // {u(2**33)}) * {u(P2)}')} AS v) FROM h3),
    h4b AS (SELECT * REPLACE ({mask(f'xor(v, v // {u(2**29)}) * {u(P3)}')} AS v) FROM h4),
    h5 AS (SELECT * EXCLUDE (v), xor(v, v // {u(2**32)}) AS h FROM h4b)"""


def weights(modulus: int = 4) -> str:
    return f"""SELECT row_number() OVER (ORDER BY host, port) AS ord, host || ':' || port AS peer, weight FROM
        (SELECT 'cache-' || s_suppkey AS host, 23456 + s_suppkey AS port, s_nationkey % {modulus} AS weight FROM supplier)"""


def ring(w: str) -> str:
    return f"""SELECT unnest(range(CAST(first AS BIGINT), CAST(first + weight AS BIGINT))) AS slot, peer FROM
        (SELECT peer, weight, coalesce(sum(weight) OVER (ORDER BY ord, peer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM ({w}) WHERE weight > 0)"""


RING = ring(weights())
EDITS = """SELECT s_suppkey AS ord, CASE WHEN s_suppkey <= 3 THEN 'new-' || s_suppkey || ':1' ELSE 'cache-' || s_suppkey || ':' || (23456 + s_suppkey) END AS peer, s_suppkey % 5 AS vnodes
    FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey <= 3"""


def edited(weight: str) -> str:
    return ring(f"""SELECT coalesce(w.ord, (SELECT max(ord) FROM ({weights()})) + 1 + e.ord) AS ord, coalesce(w.peer, e.peer) AS peer, {weight} AS weight
        FROM ({weights()}) w FULL JOIN ({EDITS}) e ON w.peer = e.peer""")


def routed(source: str, key: str, name: str = "peer", modulus: int = 4) -> str:
    """source with the owner of each key."""
    r = ring(weights(modulus))
    return f"""WITH src AS ({source}), ring AS ({r}), n AS (SELECT {u('count(*)')} AS n FROM ring), {hashed('src', key)},
    placed AS (SELECT h5.*, CAST(least(h // ({u(M)} // n), n - {u(1)}) AS BIGINT) AS slot FROM h5, n)
    SELECT placed.* EXCLUDE (slot, h), ring.peer AS {name} FROM placed LEFT JOIN ring USING (slot)"""


REQUESTS = """SELECT event_id AS req_id, ts, user_id AS key, 'node-' || (user_id % 8) AS node, 'GetObject' AS operation,
    CASE WHEN event_type = 'error' THEN 'err' ELSE 'ok' END AS status,
    CASE event_type WHEN 'view' THEN 'cached' WHEN 'click' THEN 'fetched' WHEN 'purchase' THEN 'proxied' WHEN 'error' THEN 's3' ELSE 'none' END AS extra,
    CAST(floor(value * 100) AS BIGINT) AS bytes, value / 50 AS duration_s FROM events"""
OUTCOME = "CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY ts, req_id) = 1 THEN 'fetched' ELSE 'cached' END"
NOW, TIMEOUT = "(SELECT max(ts) FROM events)", "INTERVAL 12 HOURS"


def view(side: int, sides: int = 2) -> str:
    return f"""SELECT 'node-' || user_id AS host, CAST(23456 AS INTEGER) AS port, ts AS last_seen, CAST(floor(value) AS BIGINT) AS weight FROM events
        WHERE event_id % {sides} = {side} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def merged(views: list[str]) -> str:
    every = " UNION ALL ".join(f"SELECT *, {i} AS side FROM ({v})" for i, v in enumerate(views))
    return f"""SELECT host, port, last_seen, weight FROM ({every}) WHERE last_seen >= {NOW} - {TIMEOUT}
        QUALIFY row_number() OVER (PARTITION BY host, port ORDER BY last_seen DESC, side) = 1"""


OWN = f"SELECT 'node-1' AS host, CAST(23456 AS INTEGER) AS port, {NOW} AS last_seen, CAST(5 AS BIGINT) AS weight"


def with_own(v: str) -> str:
    return f"SELECT * FROM ({v}) WHERE NOT (host = 'node-1' AND port = 23456) UNION ALL {OWN}"


def gauge(old: str, new: str) -> str:
    return f"""SELECT coalesce(n.host, o.host) AS host, coalesce(n.port, o.port) AS port, CAST(CASE WHEN n.host IS NULL THEN -1 ELSE n.weight END AS BIGINT) AS value
        FROM ({old}) o FULL JOIN ({new}) n ON o.host = n.host AND o.port = n.port"""


SAMPLED = f"""SELECT * FROM ({view(0)}) WHERE host <> 'node-1' ORDER BY md5(host || ':' || port || '#0'), host, port LIMIT 3"""
HTTP = r"""SELECT page_id AS req_id, CASE WHEN page_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN page_id % 11 = 0 THEN '/api' ELSE '' END || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
    regexp_extract(url, '\?([^#]*)', 1) || CASE WHEN page_id % 7 = 0 THEN '&partNumber=1' ELSE '' END AS query,
    CASE WHEN page_id % 8 = 3 THEN 'bytes=abc' WHEN page_id % 4 = 1 THEN 'bytes=0-99' WHEN page_id % 4 = 2 THEN 'bytes=-50' WHEN page_id % 4 = 3 THEN 'bytes=10-,20-30' END AS range_spec FROM pages"""
PAIRS = f"""SELECT req_id, split_part(x, '=', 1) AS key, CASE WHEN contains(x, '=') THEN substr(x, strpos(x, '=') + 1) ELSE '' END AS value
    FROM (SELECT req_id, unnest(string_split(query, '&')) AS x FROM ({HTTP})) WHERE x <> ''"""
CLASSIFIED = f"""SELECT *, CASE WHEN path = '/api' OR starts_with(path, '/api/') THEN 'api'
        WHEN method = 'GET' AND length(path) > 1 AND req_id IN (SELECT req_id FROM ({PAIRS}) WHERE key = 'partNumber') THEN 'other'
        WHEN method = 'GET' AND length(path) > 1 AND range_spec = 'bytes=abc' THEN 'error'
        WHEN method = 'GET' AND length(path) > 1 AND regexp_matches(path, '^/[^/]*/') THEN 'get_object' ELSE 'other' END AS category FROM ({HTTP})"""
WINDOWED = "date_trunc('hour', ts) AS start"
SERIES = "SELECT date_trunc('hour', ts) AS start, node AS peer, operation, extra, status"
GAUGES = """SELECT user_id % 8 AS peer, 'node-' || user_id AS target, ts, event_id AS seq, CAST(CASE WHEN event_id % 7 = 0 THEN -1 ELSE floor(value) END AS BIGINT) AS value FROM events"""
PANEL = f"""SELECT peer, target, value AS weight FROM ({GAUGES}) QUALIFY row_number() OVER (PARTITION BY peer, target ORDER BY ts DESC, seq DESC) = 1"""
BUCKETS = ", ".join(f"({b})" for b in BOUNDS)
HISTOGRAM = f"""SELECT operation, extra, status, le, CAST(count(*) FILTER (WHERE duration_s <= le) AS BIGINT) AS cumulative_count
    FROM ({REQUESTS}), (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {BUCKETS}) t(b) UNION ALL SELECT CAST('inf' AS DOUBLE)) GROUP BY ALL"""
QUANTILES = f"""WITH hist AS ({HISTOGRAM}),
    steps AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cumulative_count) OVER w, 0) AS below, max(cumulative_count) OVER (PARTITION BY operation, extra, status) AS total
        FROM hist WINDOW w AS (PARTITION BY operation, extra, status ORDER BY le)),
    asked AS (SELECT *, q * total AS rank FROM steps, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) t(q))
    SELECT operation, extra, status, q, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - below) / (cumulative_count - below) END, 9) AS seconds
    FROM asked WHERE cumulative_count >= rank QUALIFY row_number() OVER (PARTITION BY operation, extra, status, q ORDER BY le) = 1"""


def encoded(x: str) -> str:
    """application/x-www-form-urlencoded."""
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"


CANONICAL_QUERY = f"""SELECT req_id, string_agg(k || '=' || v, '&' ORDER BY k) AS cq FROM
    (SELECT req_id, {encoded('key')} AS k, last({encoded('value')} ORDER BY i) AS v FROM (SELECT *, row_number() OVER () AS i FROM ({PAIRS})) GROUP BY ALL) GROUP BY req_id"""
NAMES = "content-type;host;x-amz-content-sha256;x-amz-date;x-amz-meta-n"
REQUEST = f"""SELECT h.req_id, method || chr(10) || array_to_string(list_transform(string_split(path, '/'), lambda x: {encoded('x')}), '/') || chr(10) || coalesce(cq, '') || chr(10)
    || 'content-type:text/plain' || chr(10) || 'host:store.example.org' || chr(10) || 'x-amz-content-sha256:UNSIGNED-PAYLOAD' || chr(10) || 'x-amz-date:20240115T103000Z' || chr(10)
    || 'x-amz-meta-n:' || h.req_id || chr(10) || chr(10) || '{NAMES}' || chr(10) || 'UNSIGNED-PAYLOAD' AS request
    FROM ({HTTP}) h LEFT JOIN ({CANONICAL_QUERY}) USING (req_id)"""
SCOPE = "20240115/us-east-1/s3/aws4_request"
_KEY = signing_key("example-secret", "20240115", "us-east-1").ljust(64, b"\0")
INNER, OUTER = (bytes(b ^ x for b in _KEY).hex() for x in (0x36, 0x5C))
SIGNED = f"""SELECT req_id, 'AWS4-HMAC-SHA256 Credential=EXAMPLEKEY/{SCOPE}, SignedHeaders={NAMES}, Signature='
    || sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode('AWS4-HMAC-SHA256' || chr(10) || '20240115T103000Z' || chr(10) || '{SCOPE}' || chr(10) || sha256(request))))) AS authorization
    FROM ({REQUEST})"""
SLICED = """SELECT doc_id, n, CASE doc_id % 5 WHEN 1 THEN 4 WHEN 2 THEN greatest(n - 20, 0) WHEN 3 THEN CASE WHEN n > 100000 THEN 100000 ELSE 0 END WHEN 4 THEN 5 ELSE 0 END AS a,
    CASE doc_id % 5 WHEN 1 THEN least(14, n) WHEN 3 THEN CASE WHEN n > 100000 THEN n ELSE least(10, n) END ELSE n END AS b, hex(encode(text)) AS hx FROM (SELECT *, octet_length(encode(text)) AS n FROM documents)"""

SQL = {
    "route_outcome_qps": f"""WITH r AS ({routed(REQUESTS, "key")}), o AS (SELECT *, {OUTCOME.format(by="peer, key")} AS outcome FROM r)
        SELECT {WINDOWED}, peer, operation, outcome AS extra, status, count(*) / 3600.0::DOUBLE AS qps FROM o GROUP BY ALL""",
    "hash_keys": f"WITH {hashed('orders', 'o_orderkey')} SELECT o_orderkey, CAST(CASE WHEN h >= {u(2**63)} THEN CAST(h AS HUGEINT) - CAST({2**64} AS HUGEINT) ELSE CAST(h AS HUGEINT) END AS BIGINT) AS h FROM h5",
    "route_orders": f"SELECT peer, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM ({routed('SELECT o_orderkey FROM orders', 'o_orderkey')}) GROUP BY peer",
    "route_lineitem": f"SELECT peer, count(*) AS n FROM ({routed('SELECT l_partkey FROM lineitem', 'l_partkey')}) GROUP BY peer",
    "ring_slots": RING,
    "ring_bounds": f"SELECT peer, min(slot) AS lpos, max(slot) AS rpos FROM ({RING}) GROUP BY peer",
    "ring_nodes": f"SELECT count(DISTINCT peer) AS n FROM ({RING})",
    "ring_vnodes": f"SELECT count(*) AS n FROM ({RING})",
    "ring_vnodes_by": f"SELECT w.peer, CAST(w.weight AS BIGINT) AS n FROM ({weights()}) w",
    "ring_add": edited("coalesce(weight, 0) + coalesce(vnodes, 0)"),
    "ring_sub": edited("greatest(coalesce(weight, 0) - coalesce(vnodes, 0), 0)"),
    "ring_insert": edited("coalesce(vnodes, weight)"),
    "ring_update": edited("coalesce(vnodes, weight)"),
    "ring_remove": ring(f"SELECT * FROM ({weights()}) WHERE peer NOT IN (SELECT peer FROM ({EDITS}))"),
    "ring_load_by_peer": f"SELECT peer, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT key) AS n_keys FROM ({routed(REQUESTS, 'key')}) GROUP BY peer",
    "reshard_movement": f"""SELECT from_peer, to_peer, count(*) AS n FROM ({routed('SELECT o_orderkey FROM orders', 'o_orderkey', 'from_peer', 4)})
        JOIN ({routed('SELECT o_orderkey FROM orders', 'o_orderkey', 'to_peer', 3)}) USING (o_orderkey) GROUP BY ALL""",
    "member_bootstrap": with_own(f"SELECT host, port, {NOW} AS last_seen, CAST(0 AS BIGINT) AS weight FROM ({view(0)})"),
    "member_members": view(0),
    "member_merge": with_own(merged([view(0), view(1)])),
    "member_replace": view(1),
    "member_evicted": f"SELECT * FROM ({view(0)}) WHERE last_seen < {NOW} - {TIMEOUT}",
    "member_sync_candidates": f"SELECT * FROM ({view(0)}) WHERE host <> 'node-1' AND last_seen > {NOW} - {TIMEOUT}",
    "member_sampled": f"SELECT host, port FROM ({SAMPLED})",
    "member_health_refresh": with_own(f"SELECT host, port, CASE WHEN host IN (SELECT host FROM ({SAMPLED}) WHERE weight % 2 = 0) THEN {NOW} ELSE last_seen END AS last_seen, weight FROM ({view(0)})"),
    "member_sync_nway": merged([view(i, 4) for i in range(4)]),
    "member_diff_gauge": gauge(view(0), merged([view(0), view(1)])),
    "member_shutdown_gauge": f"SELECT host, port, CAST(-1 AS BIGINT) AS value FROM ({view(0)})",
    "member_json_roundtrip": view(0),
    "member_ring": ring(f"SELECT row_number() OVER (ORDER BY host, port) AS ord, host || ':' || port AS peer, weight FROM ({merged([view(0), view(1)])})"),
    "parse_peer": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 'h' WHEN 2 THEN CASE WHEN s_suppkey * 7000 <= 65535 THEN 'h' END WHEN 4 THEN '' END AS host,
        CAST(CASE s_suppkey % 5 WHEN 1 THEN s_suppkey WHEN 2 THEN CASE WHEN s_suppkey * 7000 <= 65535 THEN s_suppkey * 7000 END WHEN 4 THEN 80 END AS INTEGER) AS port,
        s_suppkey % 5 IN (0, 3) OR (s_suppkey % 5 = 2 AND s_suppkey * 7000 > 65535) AS failed FROM supplier""",
    "form_encoding": f"SELECT p_partkey, {encoded('p_name || chr(32) || chr(42) || chr(126) || chr(43) || chr(47) || p_type')} AS encoded, true AS same FROM part",
    "query_params": PAIRS,
    "settings_units": "SELECT p_partkey, CAST(61 * p_size AS DOUBLE) AS seconds, CAST(p_size AS BIGINT) * 1048576 AS bytes FROM part",
    "endpoints": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, CAST(CASE WHEN starts_with(url, 'https') THEN 443 ELSE 80 END AS INTEGER) AS port, starts_with(url, 'https') AS tls FROM pages",
    "payloads": "SELECT p_partkey, md5(array_to_string(list_transform(range(p_size), lambda i: printf('%016x', i)), '')) AS digest FROM part",
    "log_files": "SELECT strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%SZ') AS file, count(*) AS n FROM events GROUP BY ALL",
    "classify_requests": f"""SELECT req_id, category, CASE WHEN category = 'get_object' THEN regexp_extract(path, '^/([^/]*)/(.*)$', 1) END AS bucket,
        CASE WHEN category = 'get_object' THEN regexp_extract(path, '^/([^/]*)/(.*)$', 2) END AS key, CASE WHEN category = 'get_object' THEN range_spec END AS range_spec FROM ({CLASSIFIED})""",
    "bucket_filter": f"SELECT req_id, category = 'get_object' AND coalesce(regexp_extract(path, '^/([^/]*)/(.*)$', 1), '') = 'en' AS handled FROM ({CLASSIFIED})",
    "route_decision": f"""WITH r AS ({routed(REQUESTS, "key")}), o AS (SELECT peer AS own FROM ({weights()}) WHERE weight > 0 ORDER BY weight DESC, ord LIMIT 1)
        SELECT CASE WHEN peer IS NULL THEN 's3' WHEN peer <> own THEN 'proxied' ELSE 'cache' END AS as_cache, CASE WHEN peer IS NULL OR peer = own THEN 's3' ELSE 'proxied' END AS as_agent, count(*) AS n FROM r, o GROUP BY ALL""",
    "cache_outcome": f"WITH r AS ({routed(REQUESTS, 'key')}), o AS (SELECT *, {OUTCOME.format(by='peer, key')} AS outcome FROM r) SELECT peer, outcome, count(*) AS n FROM o GROUP BY ALL",
    "range_slice": f"SELECT doc_id, CAST(greatest(b - a, 0) AS BIGINT) AS length, md5(substr(hx, 2 * a + 1, 2 * greatest(b - a, 0))) AS digest, CAST(200 AS INTEGER) AS status FROM ({SLICED})",
    "entry_weight": "SELECT doc_id, CAST(octet_length(encode(source || '/' || lang || '/' || doc_id)) + octet_length(encode(text)) AS BIGINT) AS weight FROM documents",
    "upstreams": f"""SELECT req_id, CASE extra WHEN 's3' THEN 'store.example.org:9000' WHEN 'proxied' THEN node || ':23456' END AS address,
        CASE extra WHEN 's3' THEN true WHEN 'proxied' THEN false END AS tls, CASE WHEN extra NOT IN ('s3', 'proxied') THEN 'no upstream' END AS error FROM ({REQUESTS})""",
    "stale_route_hint": f"""SELECT o_orderkey, agent_peer, cache_peer FROM ({routed('SELECT o_orderkey FROM orders', 'o_orderkey', 'agent_peer', 4)})
        JOIN ({routed('SELECT o_orderkey FROM orders', 'o_orderkey', 'cache_peer', 3)}) USING (o_orderkey) WHERE agent_peer <> cache_peer""",
    "stale_reads": f"""WITH r AS (SELECT *, CASE WHEN extra = 'proxied' THEN 'PUT' ELSE 'GET' END AS method FROM ({REQUESTS})),
        o AS (SELECT *, CASE WHEN method = 'GET' THEN CASE WHEN row_number() OVER (PARTITION BY method, key ORDER BY ts, req_id) = 1 THEN 'fetched' ELSE 'cached' END END AS outcome FROM r),
        w AS (SELECT *, max(CASE WHEN method = 'PUT' THEN ts END) OVER before AS put, max(CASE WHEN outcome = 'fetched' THEN ts END) OVER before AS got FROM o
            WINDOW before AS (PARTITION BY key ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT req_id, key FROM w WHERE outcome = 'cached' AND put > got""",
    "counters": f"SELECT operation, status, extra, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(duration_s), 4) AS seconds FROM ({REQUESTS}) GROUP BY ALL",
    "qps": f"{SERIES}, count(*) / 3600.0::DOUBLE AS qps FROM ({REQUESTS}) GROUP BY ALL",
    "throughput": f"{SERIES}, CAST(sum(bytes) AS BIGINT) / 3600.0::DOUBLE AS bytes_per_s FROM ({REQUESTS}) GROUP BY ALL",
    "latency_histogram": HISTOGRAM,
    "latency_quantiles": QUANTILES,
    "counter_rate_from_samples": """WITH c AS (SELECT user_id % 8 AS peer, event_type, ts, event_id AS seq,
            CAST(count(*) OVER (PARTITION BY user_id % 8, event_type, event_id // 1000 ORDER BY ts, event_id) AS DOUBLE) AS value FROM events),
        d AS (SELECT *, lag(value) OVER (PARTITION BY peer, event_type ORDER BY ts, seq) AS last FROM c)
        SELECT date_trunc('hour', ts) AS start, peer, event_type, sum(CASE WHEN last IS NULL THEN 0 WHEN value < last THEN value ELSE value - last END) / 3600.0::DOUBLE AS rate FROM d GROUP BY ALL""",
    "members_panel": f"SELECT * FROM ({PANEL}) WHERE weight >= 0",
    "members_panel_table": f"SELECT target, weight FROM ({PANEL}) WHERE weight >= 0 AND peer = 1",
    "up_gauge": f"SELECT peer, value FROM ({GAUGES}) QUALIFY row_number() OVER (PARTITION BY peer ORDER BY ts DESC, seq DESC) = 1",
    "logs_panel": """SELECT make_timestamp((1700000000 + conv_id * 1000 + turn) * 1000000) AS ts, 'node-1' AS peer,
        CASE role WHEN 'user' THEN 'info' WHEN 'assistant' THEN 'warn' ELSE 'error' END AS level, md5(text) AS message FROM conversations WHERE conv_id % 8 = 1""",
    "label_values": "SELECT DISTINCT user_id % 8 AS peer FROM events",
    "label_match": f"SELECT node, count(*) AS n FROM ({REQUESTS}) WHERE node IN ('node-1', 'node-5', 'node-6', 'node-7') GROUP BY node",
    "series_mean": f"SELECT peer, operation, extra, status, round(avg(qps), 9) AS mean FROM ({SERIES}, count(*) / 3600.0::DOUBLE AS qps FROM ({REQUESTS}) GROUP BY ALL) GROUP BY ALL",
    "sigv4_canonical": REQUEST,
    "sigv4_signature": SIGNED,
    "object_store": """SELECT * FROM (VALUES ('north', CAST(14 AS BIGINT), ''), ('maps/south', 40, ''), ('east', 15, ''), ('east#2-9', 7, 'the sun')) t(path, length, part)""",
    "objects_by_key": "SELECT * FROM (VALUES ('a.(x)/k 1', CAST(3 AS BIGINT), 'one'), ('b+c', 12, 'twelve bytes'), ('none', NULL, NULL)) t(path, length, text)",
    "streaming_qps": f"{SERIES}, count(*) / 3600.0::DOUBLE AS qps FROM ({REQUESTS}) GROUP BY ALL",
    "streaming_throughput": f"{SERIES}, CAST(sum(bytes) AS BIGINT) / 3600.0::DOUBLE AS bytes_per_s FROM ({REQUESTS}) GROUP BY ALL",
    "cache_outcome_warm": f"""WITH r AS ({routed(REQUESTS, 'key')}), o AS (SELECT *, CASE WHEN key % 3 = 0 THEN 'cached' ELSE {OUTCOME.format(by='peer, key')} END AS outcome FROM r)
        SELECT peer, outcome, count(*) AS n FROM o GROUP BY ALL""",
    "emitted_facts": f"""WITH c AS (SELECT *, regexp_extract(path, '^/([^/]*)/(.*)$', 1) AS bucket FROM ({CLASSIFIED}) WHERE category = 'get_object'),
        o AS (SELECT req_id, CASE WHEN req_id % 13 = 0 THEN 'err' ELSE 'ok' END AS status, CASE WHEN bucket <> 'en' THEN 'none'
            WHEN row_number() OVER (PARTITION BY bucket, regexp_extract(path, '^/([^/]*)/(.*)$', 2) ORDER BY req_id) = 1 THEN 'fetched' ELSE 'cached' END AS extra FROM c)
        SELECT 'GetObject' AS operation, status, extra, count(*) AS count, CAST(sum(req_id * 10) AS BIGINT) AS bytes, round(sum((req_id % 4) / 100), 4) AS seconds FROM o GROUP BY ALL""",
    "api_counts": "SELECT 'members' AS api, 'get' AS method, 'ok' AS status, count(*) AS count FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 0 HAVING count(*) > 0",
    "health_checks": f"""SELECT ord, CASE WHEN ord % 5 <> 0 AND weight <= 0 THEN 400 ELSE 200 END AS status,
        CASE WHEN ord % 5 <> 0 AND weight <= 0 THEN 'cannot reach peer ' || peer ELSE '' END AS message FROM ({weights()})""",
    "locate_bodies": f"SELECT peer, count(*) AS n FROM ({routed('SELECT o_orderkey FROM orders', 'o_orderkey')}) GROUP BY peer",
    "observer_turn": f"""WITH v AS ({view(0)}), asked AS (SELECT host FROM v ORDER BY md5(host || ':' || port || ':7') LIMIT 1),
        heard AS (SELECT CAST(substr(host, 6) AS BIGINT) % 2 = 0 AS h FROM asked)
        SELECT v.* FROM v, heard WHERE NOT h UNION ALL SELECT w.* FROM ({view(1)}) w, heard WHERE h""",
    "logs_table": """SELECT 'node-' || (conv_id % 8) AS peer, CASE role WHEN 'user' THEN 'info' WHEN 'assistant' THEN 'warn' ELSE 'error' END AS detected_level, count(*) AS n,
        min(make_timestamp((1700000000 + conv_id * 1000 + turn) * 1000000)) AS first_ts FROM conversations
        WHERE make_timestamp((1700000000 + conv_id * 1000 + turn) * 1000000) >= TIMESTAMP '2023-11-15 06:00:00' GROUP BY ALL""",
    "samples_table": f"SELECT 'duration' AS metric, node, count(*) AS n, max(duration_s) AS most, max(ts) AS last_ts FROM ({REQUESTS}) GROUP BY ALL",
}
