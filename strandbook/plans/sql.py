"""DuckDB SQL for the queries of ``catalog``. The fold is a recursive CTE, so that the check is independent of windows."""

from __future__ import annotations

OPS = """ops AS (
  SELECT user_id AS entity_key, event_id AS tx_hash, CAST(0 AS BIGINT) AS tx_index, CAST(0 AS BIGINT) AS op_index,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' WHEN 'view' THEN 'extend' WHEN 'click' THEN 'changeowner' ELSE 'delete' END AS operation,
    CAST((epoch_us(ts) - 1704067200000000) // 2000000 AS BIGINT) AS block_number, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS block_seconds,
    (user_id * 31 + event_id) % 97 AS sender, event_id % 3 = 0 AS to_system,
    CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS data,
    CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN CAST(round(value * 100) AS BIGINT) END AS btl,
    CASE WHEN event_type = 'click' THEN event_id % 97 END AS new_owner, CAST(round(value * 100) AS BIGINT) AS cost
  FROM events {where})"""

HIST = """nth AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY block_number, tx_index, tx_hash, op_index) AS rn FROM ops),
hist AS (
  SELECT entity_key, tx_hash, tx_index, op_index, operation, block_number, block_seconds, sender, to_system, btl, new_owner, cost, rn,
    CASE WHEN operation = 'delete' AND to_system THEN 'expired' WHEN operation = 'delete' THEN 'deleted' ELSE 'active' END AS status,
    CASE WHEN operation = 'delete' AND to_system THEN NULL WHEN operation = 'changeowner' THEN new_owner ELSE sender END AS owner,
    CAST(coalesce(cost, 0) AS BIGINT) AS total_cost, data,
    CASE WHEN operation IN ('create', 'update') THEN block_number + btl WHEN operation = 'delete' THEN block_number END AS expires_at_block,
    CAST(NULL AS BIGINT) AS prev_owner, CAST(NULL AS VARCHAR) AS prev_status, CAST(NULL AS BIGINT) AS prev_expires_at_block, CAST(NULL AS VARCHAR) AS prev_data
  FROM nth WHERE rn = 1
  UNION ALL
  SELECT n.entity_key, n.tx_hash, n.tx_index, n.op_index, n.operation, n.block_number, n.block_seconds, n.sender, n.to_system, n.btl, n.new_owner, n.cost, n.rn,
    CASE WHEN n.operation = 'delete' AND n.to_system THEN 'expired' WHEN n.operation = 'delete' THEN 'deleted' ELSE 'active' END,
    CASE WHEN n.operation = 'delete' AND n.to_system THEN h.owner WHEN n.operation = 'changeowner' THEN n.new_owner ELSE n.sender END,
    CAST(h.total_cost + coalesce(n.cost, 0) AS BIGINT),
    CASE WHEN n.operation IN ('create', 'update') THEN n.data WHEN n.operation = 'delete' THEN NULL ELSE h.data END,
    CASE WHEN n.operation IN ('create', 'update') THEN n.block_number + n.btl WHEN n.operation = 'delete' THEN n.block_number WHEN n.operation = 'extend' THEN h.expires_at_block + n.btl ELSE h.expires_at_block END,
    h.owner, h.status, h.expires_at_block, h.data
  FROM hist h JOIN nth n ON n.entity_key = h.entity_key AND n.rn = h.rn + 1)"""

LAST = """last_row AS (SELECT h.* FROM hist h JOIN (SELECT entity_key, max(rn) AS rn FROM hist GROUP BY entity_key) m USING (entity_key, rn)),
made AS (SELECT c.entity_key, c.sender AS creator, c.tx_hash AS created_tx FROM hist c JOIN (SELECT entity_key, min(rn) AS rn FROM hist WHERE operation = 'create' GROUP BY entity_key) f USING (entity_key, rn)),
snap AS (SELECT entity_key, data, status, owner, expires_at_block, l.tx_hash AS last_tx, total_cost AS cost, creator, created_tx FROM last_row l LEFT JOIN made USING (entity_key))"""

BLOCKS = "blocks AS (SELECT block_number, min(block_seconds) AS block_seconds, CAST(sum(cost) AS BIGINT) AS gas_used, count(*) * 1000 AS gas_limit FROM ops GROUP BY block_number)"
DIFFS = """diffs AS (SELECT b.block_number, CAST(coalesce(sum(coalesce(octet_length(encode(h.data)), 0) - coalesce(octet_length(encode(h.prev_data)), 0)), 0) AS BIGINT) AS diff
  FROM blocks b LEFT JOIN hist h ON h.block_number = b.block_number GROUP BY b.block_number),
usage AS (SELECT block_number, greatest(CAST(sum(diff) OVER (ORDER BY block_number) AS BIGINT), 0) AS storage_usage FROM diffs)"""
COUNTS = """counts AS (SELECT block_number, count(*) FILTER (operation = 'create') AS n_create, count(*) FILTER (operation = 'update') AS n_update, count(*) FILTER (operation = 'extend') AS n_extend,
  count(*) FILTER (operation = 'changeowner') AS n_changeowner, count(*) FILTER (operation = 'delete' AND NOT to_system) AS n_deleted, count(*) FILTER (operation = 'delete' AND to_system) AS n_expired FROM ops GROUP BY block_number)"""
FRESH = "fresh AS (SELECT block_number, CAST(sum(coalesce(octet_length(encode(data)), 0)) AS BIGINT) AS new_bytes FROM hist WHERE status = 'active' AND operation IN ('create', 'update') GROUP BY block_number)"
STATE = """heads AS (SELECT max(block_number) - 1000 AS finalized, max(block_number) - 100 AS safe, max(block_number) - 10 AS latest, max(block_seconds) AS safe_seconds FROM blocks),
state AS (SELECT block_number, CASE WHEN block_number <= finalized THEN 'finalized' WHEN block_number <= safe THEN 'safe' WHEN block_number <= latest THEN 'unsafe' ELSE 'unknown' END AS consensus_status,
  CASE WHEN block_number > safe AND block_number <= latest THEN safe_seconds + 1200 END AS expected_safe_seconds FROM blocks, heads)"""
ENT = """ent AS (SELECT doc_id AS entity_key, source AS owner, lang AS content_type, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id AS created_block, doc_id + n_chars AS expires_at_block,
  CASE WHEN doc_id % 10 = 0 THEN 'deleted' WHEN doc_id % 10 = 1 THEN 'expired' ELSE 'active' END AS status FROM documents)"""
ATTR = """attr AS (SELECT doc_id AS entity_key, doc_id % 10 > 1 AS active, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, doc_id % 10 > 1, 'source', source FROM documents)"""
TX = """tx AS (SELECT o_orderkey AS hash, o_custkey AS from_address, o_orderkey % 7 AS to_address, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS block_number, o_orderkey AS tx_index,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS status, o_orderstatus <> 'P' AS block_consensus, CAST(round(o_totalprice) AS BIGINT) AS gas_price, o_orderkey % 1000 AS cumulative_gas_used FROM orders)"""
INNER = """inner_tx AS (SELECT l_suppkey AS from_address, l_partkey AS to_address, CASE WHEN l_returnflag = 'A' THEN 'call' ELSE 'create' END AS type, l_linenumber AS idx,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS block_number FROM lineitem)"""
ADDR = "addr AS (SELECT c_custkey AS hash, CASE WHEN c_custkey % 50 <> 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS balance FROM customer)"
HOURS = """usage_h AS (SELECT block_seconds // 3600 * 3600 AS hour, CAST(sum(CASE operation WHEN 'create' THEN coalesce(octet_length(encode(data)), 0)
    WHEN 'update' THEN coalesce(octet_length(encode(data)), 0) - coalesce(octet_length(encode(prev_data)), 0) ELSE 0 END) AS BIGINT) AS change FROM hist GROUP BY 1),
usage_v AS (SELECT hour, change, greatest(CAST(sum(change) OVER (ORDER BY hour) AS BIGINT), 0) AS data_usage FROM usage_h),
count_h AS (SELECT block_seconds // 3600 * 3600 AS hour, count(*) FILTER (operation = 'create') AS created, count(*) FILTER (operation = 'delete' AND status <> 'expired') AS deleted, count(*) FILTER (operation = 'delete' AND status = 'expired') AS expired FROM hist GROUP BY 1),
count_v AS (SELECT hour, created, deleted, expired, greatest(CAST(sum(created - deleted - expired) OVER (ORDER BY hour) AS BIGINT), 0) AS total FROM count_h)"""
FORECAST = """clock AS (SELECT max(block_seconds) // 3600 * 3600 AS now FROM hist),
ends AS (SELECT (block_seconds + btl * 2 + 3600) // 3600 * 3600 AS hour, octet_length(encode(data)) AS bytes FROM hist WHERE btl IS NOT NULL AND data IS NOT NULL),
fc AS (SELECT e.hour, CAST((SELECT coalesce(sum(l.bytes), 0) FROM ends l WHERE l.hour > e.hour) AS BIGINT) AS live FROM (SELECT DISTINCT hour FROM ends, clock WHERE hour > now) e
  UNION ALL SELECT now, CAST((SELECT coalesce(sum(l.bytes), 0) FROM ends l WHERE l.hour > now) AS BIGINT) FROM clock)"""


def query(body: str, *parts: str, where: str = "") -> str:
    return "WITH RECURSIVE " + ",\n".join(p.replace("{where}", where) for p in parts) + "\n" + body


def board(value: str, ties: str, inner: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {value} DESC NULLS FIRST, {ties}) AS rank FROM ({inner})"


FOLD = (OPS, HIST)
SNAP = (OPS, HIST, LAST)
KINDS = ", ".join(f"count(*) FILTER (operation = '{k}') AS n_{k}" for k in ("create", "update", "extend", "changeowner", "delete"))
SPENT = "SELECT from_address AS address, CAST(sum(cumulative_gas_used * gas_price) AS BIGINT) AS total FROM tx WHERE cumulative_gas_used > 0 AND gas_price > 0 GROUP BY 1"
CREATED = "SELECT sender AS address, count(*) AS n_created, min(tx_hash) AS first_tx FROM ops WHERE operation = 'create' GROUP BY 1"
OWNED_SNAP = "SELECT owner AS address, count(*) AS n_owned FROM snap WHERE status = 'active' GROUP BY 1"
BYTES_SNAP = "SELECT owner AS address, CAST(coalesce(sum(octet_length(encode(data))), 0) AS BIGINT) AS data_size FROM snap WHERE status = 'active' GROUP BY 1"
HIST_COLUMNS = "entity_key, tx_hash, operation, block_number, status, owner, prev_owner, prev_status, data, prev_data, expires_at_block, prev_expires_at_block, total_cost"
SNAP_COLUMNS = "entity_key, data, status, owner, expires_at_block, last_tx, cost, creator, created_tx"


def _filled(view: str, time: str, value: str, step: int) -> str:
    return (
        f"SELECT g.t AS {time}, CAST((SELECT v.{value} FROM ({view}) v WHERE v.{time} <= g.t ORDER BY v.{time} DESC LIMIT 1) AS BIGINT) AS {value} "
        f"FROM (SELECT unnest(range((SELECT min({time}) FROM ({view})), (SELECT max({time}) FROM ({view})) + 1, {step})) AS t) g"
    )


DAY_USAGE = "SELECT hour // 86400 * 86400 AS day, max(data_usage) AS data_usage FROM usage_v GROUP BY 1"
DAY_COUNT = "SELECT hour // 86400 * 86400 AS day, max(total) AS total FROM count_v GROUP BY 1"
DAY_OPS = "SELECT block_seconds // 86400 * 86400 AS day, count(*) AS n FROM ops GROUP BY 1"
WEEK = "SELECT (SELECT min(hour) FROM fc) + (hour - (SELECT min(hour) FROM fc)) // 604800 * 604800 AS period, arg_max(live, hour) AS live FROM fc GROUP BY 1"

ORACLES = {
    "history_fold": query(f"SELECT {HIST_COLUMNS} FROM hist", *FOLD),
    "entity_snapshot": query(f"SELECT {SNAP_COLUMNS} FROM snap", *SNAP),
    "fold_expiry": query("SELECT entity_key, tx_hash, expires_at_block, block_seconds + (expires_at_block - block_number) * 2 AS expires_at_seconds, block_seconds + greatest((expires_at_block - block_number) * 2, CASE WHEN expires_at_block IS NULL THEN NULL ELSE 0 END) AS expires_at_seconds_sat FROM hist", *FOLD),
    "fold_total_cost": query("SELECT entity_key, tx_hash, total_cost FROM hist", *FOLD),
    "active_attribute_source": query("SELECT entity_key, tx_hash AS source_tx, op_index AS source_index FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY block_number DESC, tx_hash DESC) AS n FROM ops WHERE operation <> 'extend') WHERE n = 1 AND operation <> 'delete'", OPS),
    "refold_affected": query(f"SELECT {HIST_COLUMNS} FROM hist WHERE entity_key IN (SELECT user_id FROM events WHERE event_type = 'error')", *FOLD),
    "reorg_cleanup": query(f"SELECT {SNAP_COLUMNS} FROM snap WHERE entity_key IN (SELECT user_id FROM events WHERE value > 100)", *SNAP, where="WHERE NOT coalesce(value > 100, false)"),
    "storage_diff_by_block": query("SELECT block_number, diff FROM diffs", *FOLD, BLOCKS, DIFFS),
    "storage_usage_running": query("SELECT block_number, storage_usage FROM usage", *FOLD, BLOCKS, DIFFS),
    "block_entity_counts": query("SELECT * FROM counts", OPS, COUNTS),
    "new_data_by_block": query("SELECT * FROM fresh", *FOLD, FRESH),
    "block_consensus_status": query("SELECT * FROM state", OPS, BLOCKS, STATE),
    "block_stats": query("SELECT c.*, coalesce(new_bytes, 0) AS new_bytes, storage_usage, consensus_status, expected_safe_seconds FROM counts c LEFT JOIN fresh USING (block_number) JOIN usage USING (block_number) JOIN state USING (block_number)", *FOLD, BLOCKS, DIFFS, COUNTS, FRESH, STATE),
    "list_entities_by_attribute": query("SELECT * FROM ent WHERE status = 'active' AND content_type = 'en' AND entity_key IN (SELECT doc_id FROM documents WHERE n_chars // 1000 = 2)", ENT),
    "count_entities": query("SELECT count(*) AS n FROM ent WHERE status = 'active' AND owner = 'src1'", ENT),
    "list_operations_page": query("SELECT o.entity_key, o.tx_hash, o.operation, o.block_number, b.block_seconds, o.block_number + coalesce(btl, 0) AS expires_at_block, (SELECT count(*) FROM ops) AS total_items, CAST(ceil((SELECT count(*) FROM ops) / 100) AS BIGINT) AS total_pages FROM ops o JOIN blocks b USING (block_number) ORDER BY block_number, tx_hash LIMIT 100 OFFSET 100", OPS, BLOCKS),
    "count_operations_by_type": query(f"SELECT {KINDS} FROM ops", OPS),
    "entity_histories": query("SELECT entity_key, tx_hash, operation, status, owner, expires_at_block FROM hist", *FOLD),
    "entity_history": query("SELECT entity_key, tx_hash, operation, status, owner, expires_at_block FROM hist WHERE entity_key = (SELECT min(user_id) FROM events)", *FOLD),
    "history_before": query("SELECT n.entity_key, n.tx_hash, b.tx_hash AS before_tx, a.tx_hash AS after_tx FROM nth n LEFT JOIN nth b ON b.entity_key = n.entity_key AND b.rn = n.rn - 1 LEFT JOIN nth a ON a.entity_key = n.entity_key AND a.rn = n.rn + 1", *FOLD),
    "latest_operation": query("SELECT entity_key, operation, tx_hash, block_number FROM nth n WHERE rn = (SELECT max(rn) FROM nth m WHERE m.entity_key = n.entity_key)", *FOLD),
    "latest_update": query("SELECT entity_key, operation, tx_hash, op_index FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY rn DESC) AS k FROM nth WHERE operation IN ('create', 'update')) WHERE k = 1", *FOLD),
    "create_operation": query("SELECT entity_key, tx_hash, sender, block_number FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY rn) AS k FROM nth WHERE operation = 'create') WHERE k = 1", *FOLD),
    "entities_by_tx": query(f"SELECT {SNAP_COLUMNS} FROM snap s WHERE EXISTS (SELECT 1 FROM ops o WHERE o.entity_key = s.entity_key AND o.operation = 'create')", *SNAP),
    "custom_contract_transactions": query("SELECT * FROM tx WHERE to_address <> 1 AND to_address <> 2 AND from_address <> 0", TX),
    "attributes_with_relations": query("SELECT a.entity_key, key, value, count(*) AS related FROM attr a JOIN attr b USING (key, value) WHERE a.active AND b.active GROUP BY a.entity_key, key, value", ATTR),
    "list_deposits": query("SELECT hash AS tx_hash, hash AS source_hash, block_number, tx_index, CASE WHEN hash % 3 = 0 THEN hash + 1000000 END AS l3_tx, CASE WHEN hash % 3 = 0 THEN hash % 2 = 0 END AS l3_success FROM tx", TX),
    "list_withdrawals": query("SELECT hash AS withdrawal_hash, CASE WHEN hash % 2 = 0 THEN hash END AS proven_tx, CASE WHEN hash % 2 = 0 THEN block_number END AS proven_block, CASE WHEN hash % 4 = 0 THEN hash END AS finalized_tx, CASE WHEN hash % 4 = 0 THEN block_number END AS finalized_block FROM tx", TX),
    "leaderboard_biggest_spenders": query(board("total", "address", SPENT), TX),
    "leaderboard_data_owned": query(board("data_size", "address", "SELECT owner AS address, CAST(sum(size) AS BIGINT) AS data_size FROM ent WHERE status = 'active' GROUP BY 1"), ENT),
    "leaderboard_effectively_largest_entities": query(board("effective_size", "entity_key", "SELECT entity_key, size, coalesce(expires_at_block - created_block, 0) AS lifespan, size * coalesce(expires_at_block - created_block, 0) AS effective_size FROM ent WHERE status = 'active'"), ENT),
    "leaderboard_entities_created": query(board("n_created", "first_tx", CREATED), OPS),
    "leaderboard_entities_owned": query(board("n_owned", "address", "SELECT owner AS address, count(*) AS n_owned FROM ent WHERE status = 'active' GROUP BY 1"), ENT),
    "leaderboard_largest_entities": query(board("size", "entity_key", "SELECT entity_key, size FROM ent WHERE status = 'active'"), ENT),
    "leaderboard_top_accounts": query("SELECT hash AS address, balance, row_number() OVER (ORDER BY balance DESC NULLS FIRST, hash) AS rank, (SELECT count(*) FROM tx WHERE from_address = addr.hash) AS tx_count FROM addr", ADDR, TX),
    "leaderboard_entities_by_btl": query("SELECT entity_key, expires_at_block, row_number() OVER (ORDER BY expires_at_block DESC NULLS FIRST, entity_key) AS rank, (SELECT max(block_seconds) FROM blocks WHERE block_number = (SELECT max(block_number) FROM blocks)) + 2 * (expires_at_block - (SELECT max(block_number) FROM blocks)) AS expires_at_seconds FROM snap WHERE status = 'active'", *SNAP, BLOCKS),
    "address_leaderboard_ranks": query(
        "SELECT address, " + ", ".join(f"coalesce((SELECT rank FROM {b} x WHERE x.address = a.address), 0) AS rank_{b}" for b in ("spent", "top", "created", "owned", "bytes")) + " FROM (SELECT address FROM spent UNION SELECT address FROM top UNION SELECT address FROM created UNION SELECT address FROM owned UNION SELECT address FROM bytes) a",
        *SNAP, TX, ADDR, f"spent AS ({board('total', 'address', SPENT)})", f"top AS ({board('balance', 'address', 'SELECT hash AS address, balance FROM addr')})", f"created AS ({board('n_created', 'first_tx', CREATED)})", f"owned AS ({board('n_owned', 'address', OWNED_SNAP)})", f"bytes AS ({board('data_size', 'address', BYTES_SNAP)})",
    ),
    "address_stats": query(
        """SELECT address, CAST((SELECT count(*) FROM snap WHERE creator = address) AS BIGINT) AS n_created, (SELECT count(*) FROM snap WHERE owner = address) AS n_owned, (SELECT count(*) FROM snap WHERE owner = address AND status = 'active') AS n_active,
  CAST((SELECT coalesce(sum(octet_length(encode(data))), 0) FROM snap WHERE owner = address AND status = 'active') AS BIGINT) AS active_bytes, (SELECT count(*) FROM tx WHERE from_address = address AND block_consensus) AS n_txs,
  (SELECT count(*) FROM tx WHERE from_address = address AND block_consensus AND status = 0) AS n_failed, (SELECT count(*) FROM ops WHERE sender = address) AS n_ops
  FROM (SELECT creator AS address FROM snap UNION SELECT owner FROM snap UNION SELECT from_address FROM tx WHERE block_consensus UNION SELECT sender FROM ops) WHERE address IS NOT NULL""", *SNAP, TX),
    "address_activity": query("SELECT address, min(b) AS first_block, max(b) AS last_block FROM (SELECT from_address AS address, block_number AS b FROM inner_tx WHERE NOT (type = 'call' AND idx = 1) UNION ALL SELECT to_address, block_number FROM inner_tx WHERE NOT (type = 'call' AND idx = 1) UNION ALL SELECT from_address, block_number FROM tx) GROUP BY 1", TX, INNER),
    "entities_averages": query("SELECT CAST(round(avg(size)) AS BIGINT) AS avg_size, CAST(round(avg(expires_at_block) - (SELECT max(created_block) FROM ent)) AS BIGINT) AS avg_btl FROM ent WHERE status = 'active'", ENT),
    "entity_data_size_histogram": query("SELECT bin, lo + (bin - 1) * step AS low, CASE WHEN bin = 10 THEN hi ELSE lo + bin * step - 1 END AS high, (SELECT count(*) FROM ent WHERE status = 'active' AND least((size - lo) // step + 1, 10) = bin) AS n FROM (SELECT min(size) AS lo, max(size) AS hi, CAST(ceil((max(size) - min(size) + 1) / 10) AS BIGINT) AS step FROM ent WHERE status = 'active'), (SELECT unnest(range(1, 11)) AS bin)", ENT),
    "view_data_usage": query("SELECT * FROM usage_v", *FOLD, HOURS),
    "view_entity_count": query("SELECT * FROM count_v", *FOLD, HOURS),
    "view_operation_count": query("SELECT block_seconds // 3600 * 3600 AS hour, operation, count(*) AS n FROM ops GROUP BY 1, 2", OPS),
    "view_storage_forecast": query("SELECT * FROM fc", *FOLD, FORECAST),
    "chart_data_usage_daily": query(_filled(DAY_USAGE, "day", "data_usage", 86400), *FOLD, HOURS),
    "chart_entity_count": query(_filled(DAY_COUNT, "day", "total", 86400), *FOLD, HOURS),
    "chart_operation_count": query(_filled(DAY_OPS, "day", "n", 86400), OPS),
    "chart_storage_forecast_weekly": query(_filled(WEEK, "period", "live", 604800), *FOLD, FORECAST),
    "chart_block_transactions": query("SELECT block_number, count(*) AS n_txs FROM tx WHERE block_consensus GROUP BY 1 ORDER BY 1 DESC LIMIT 300", TX),
    "chart_block_operations": query(f"SELECT g.b AS block_number, {', '.join(f'count(*) FILTER (o.operation = {chr(39)}{k}{chr(39)}) AS n_{k}' for k in ('create', 'update', 'extend', 'changeowner', 'delete'))} FROM (SELECT unnest(range(greatest((SELECT max(block_number) FROM ops) - 99, 1), (SELECT max(block_number) FROM ops) + 1)) AS b) g LEFT JOIN ops o ON o.block_number = g.b GROUP BY 1", OPS),
    "chart_block_gas_usage_limit": query("SELECT block_number, gas_used, gas_limit, CASE WHEN gas_limit > 0 THEN round(gas_used / gas_limit * 100, 2) ELSE 0.0 END AS gas_percent FROM blocks ORDER BY block_number DESC LIMIT 1800", OPS, BLOCKS),
    "align_cost_events": "SELECT entity_key, log_index, op_index, cost FROM (SELECT user_id AS entity_key, event_id AS log_index, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS op_index, CAST(round(value * 100) AS BIGINT) AS cost, event_type FROM events) WHERE event_type <> 'error'",
    "plan_block_range": "SELECT s_suppkey AS chain_id, CASE WHEN l + 1 < h THEN l + 1 END AS from_block, CASE WHEN l + 1 < h THEN least(h, l + 1 + 100) END AS to_block FROM (SELECT s_suppkey, s_suppkey * 7 % 1000 AS l, s_suppkey * 13 % 1000 AS h FROM supplier WHERE s_suppkey % 5 <> 0)",
    "paginate": query("SELECT *, (SELECT count(*) FROM tx) AS total_items, CAST(ceil((SELECT count(*) FROM tx) / 50) AS BIGINT) AS total_pages FROM tx ORDER BY hash LIMIT 50 OFFSET 100", TX),
    "paginate_with_next": query("SELECT *, (SELECT count(*) FROM tx) AS total_items, CAST(ceil((SELECT count(*) FROM tx) / 50) AS BIGINT) AS total_pages, CASE WHEN (SELECT count(*) FROM tx) > 100 THEN CAST(3 AS BIGINT) END AS next_page, least(greatest((SELECT count(*) FROM tx) - 100, 0), 50) AS remaining FROM tx ORDER BY hash LIMIT 50 OFFSET 50", TX),
}
