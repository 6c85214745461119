"""Domain tables as plain projections of the given tables.

The SQL is common to Spark and DuckDB, so jobs and their oracles read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The given tables that each domain table reads, then its SQL.
EDGES_RAW = """
SELECT l_orderkey AS doc_id, l_linenumber AS pos,
       'BT_' || CAST(l_suppkey AS STRING) AS from_id, 'VT_' || CAST(l_partkey AS STRING) AS to_id,
       CASE l_returnflag WHEN 'N' THEN 'BAO_GOM_VI_THUOC' WHEN 'R' THEN 'CHU_TRI_BENH' ELSE 'CO_CONG_NANG' END AS relation_type,
       CASE WHEN l_linestatus = 'F' THEN 'CT_VT_VN_F' ELSE 'BOOK_O' END AS source_id,
       l_linestatus || CAST(l_linenumber AS STRING) AS description,
       CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) || 'g' END AS dosage,
       CASE WHEN l_tax = 0 THEN NULL ELSE 1 - l_discount END AS confidence,
       l_extendedprice AS price, l_shipdate AS seen_at
FROM lineitem
"""
EDGES = """
SELECT 'VT_' || CAST(p_partkey AS STRING) AS from_id, 'CO_TINH' AS relation_type, 'T_' || p_type AS to_id FROM part
UNION ALL SELECT 'VT_' || CAST(p_partkey AS STRING), 'CO_VI', 'V_' || replace(p_brand, '#', '_') FROM part
UNION ALL SELECT 'VT_' || CAST(p_partkey AS STRING), 'QUY_KINH', 'K_' || CAST(p_size % 12 AS STRING) FROM part
UNION ALL SELECT 'VT_' || CAST(p_partkey AS STRING), 'CO_CHUA_HOAT_CHAT', 'HC_' || split_part(p_name, ' ', 1) FROM part
UNION ALL SELECT 'VT_' || CAST(p_partkey AS STRING), 'CO_CHUA_HOAT_CHAT', 'HC_' || split_part(p_name, ' ', 2) FROM part
UNION ALL SELECT DISTINCT 'BT_' || CAST(l_suppkey AS STRING), 'BAO_GOM_VI_THUOC', 'VT_' || CAST(l_partkey AS STRING) FROM lineitem
UNION ALL SELECT 'BT_' || CAST(s_suppkey AS STRING), 'CHU_TRI_BENH', 'B_' || CAST(s_nationkey AS STRING) FROM supplier
UNION ALL SELECT 'B_' || CAST(n_nationkey AS STRING), 'THUOC_NHOM_BENH', 'NB_' || CAST(n_regionkey AS STRING) FROM nation
UNION ALL SELECT DISTINCT 'VT_NHAN_SAM_' || CAST(p_size AS STRING), 'CO_TINH', 'T_' || p_type FROM part
UNION ALL SELECT 'BT_' || CAST(s_suppkey AS STRING), 'BAO_GOM_VI_THUOC', 'VT_NHAN_SAM_' || CAST(s_suppkey % 50 + 1 AS STRING) FROM supplier
"""
#: The same rows with repeats left in, for jobs that their number means nothing to: what is distinct is sorted out in the job's own exchange.
EDGES_REPEATED = EDGES.replace("SELECT DISTINCT", "SELECT")
NODES = """
SELECT 'VT_' || CAST(p_partkey AS STRING) AS id, 'ViThuoc' AS label, lower(p_name) AS name, lower(p_type) AS alias FROM part
UNION ALL SELECT 'BT_' || CAST(s_suppkey AS STRING), 'BaiThuoc', lower(s_name), 'remedy ' || CAST(s_suppkey AS STRING) FROM supplier
UNION ALL SELECT 'B_' || CAST(n_nationkey AS STRING), 'Benh', lower(n_name), 'illness ' || CAST(n_regionkey AS STRING) FROM nation
UNION ALL SELECT 'NB_' || CAST(r_regionkey AS STRING), 'NhomBenh', lower(r_name), '' FROM region
UNION ALL SELECT DISTINCT 'T_' || p_type, 'TinhVi', lower(p_type), '' FROM part
UNION ALL SELECT DISTINCT 'V_' || replace(p_brand, '#', '_'), 'TinhVi', lower(p_brand), '' FROM part
UNION ALL SELECT DISTINCT 'K_' || CAST(p_size % 12 AS STRING), 'KinhMach', 'meridian ' || CAST(p_size % 12 AS STRING), '' FROM part
UNION ALL SELECT DISTINCT 'VT_NHAN_SAM_' || CAST(p_size AS STRING), 'ViThuoc', 'ginseng ' || CAST(p_size AS STRING), '' FROM part
UNION ALL SELECT DISTINCT 'HC_' || w, 'HoatChat', w, '' FROM (SELECT split_part(p_name, ' ', 1) AS w FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part) AS words
"""
NODES_GAPPY = """
SELECT 'VT_' || CAST(p_partkey AS STRING) AS id, 'ViThuoc' AS label, lower(p_name) AS name FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT 'VT_9' || CAST(p_partkey AS STRING) || '9', 'ViThuoc', lower(p_name) FROM part WHERE p_size = 7
UNION ALL SELECT 'BT_' || CAST(s_suppkey AS STRING), 'BaiThuoc', lower(s_name) FROM supplier WHERE s_nationkey <> 3
"""
EDGES_CYCLIC = """
SELECT l_orderkey % 500 AS doc_id, 'N' || CAST(l_suppkey % 20 AS STRING) AS from_id, 'N' || CAST(l_partkey % 20 AS STRING) AS to_id,
       CASE WHEN l_returnflag = 'N' THEN 'contains' ELSE 'TREATS' END AS relation_type,
       row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pos
FROM lineitem
"""
QUESTIONS = """
SELECT dense_rank() OVER (ORDER BY kind, kw1, kw2) AS question_id, kind, kw1, kw2 FROM (
  SELECT DISTINCT 'phrase' AS kind, lower(p_name) AS kw1, lower(p_type) AS kw2 FROM part
  UNION SELECT DISTINCT 'word', split_part(lower(p_name), ' ', 2), lower(p_brand) FROM part
  UNION SELECT DISTINCT 'remedy', lower(s_name), lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT DISTINCT 'disease', lower(n_name), '' FROM nation
  UNION SELECT DISTINCT 'accent', 'nhân sâm ' || CAST(p_size AS STRING), lower(p_type) FROM part
  UNION SELECT DISTINCT 'herb_id', 'vt_' || CAST(p_partkey AS STRING), 'hc_' || split_part(lower(p_name), ' ', 1) FROM part
) AS q
"""
PAYMENTS = """
SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS amount_vnd, round(o_totalprice / 1000, 2) AS token_amount,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'admin' ELSE 'sepay' END AS transaction_type, o_orderdate AS created_at
FROM orders
"""
USERS = """
SELECT c_custkey AS id, lower(c_name) AS username, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' AS email,
       c_acctbal AS token_balance, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role
FROM customer
"""
INVOICES = """
SELECT event_id AS id, user_id, value AS amount, ts AS created_at FROM events WHERE event_type = 'signup'
"""
TRANSFERS = """
SELECT event_id AS tx_id, event_id - event_id % 8 AS paid_id, value * 2 AS amount, ts AS paid_at FROM events WHERE event_type = 'purchase'
"""
LEDGER = """
SELECT event_id AS id, user_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'in' ELSE 'out' END AS type,
       value AS amount, event_type = 'error' AS forced, ts AS created_at
FROM events
"""
SQL = {
    "edges_raw": (("lineitem",), EDGES_RAW),
    "edges": (("part", "lineitem", "supplier", "nation"), EDGES),
    "edges_repeated": (("part", "lineitem", "supplier", "nation"), EDGES_REPEATED),
    "nodes": (("part", "supplier", "nation", "region"), NODES),
    "nodes_gappy": (("part", "supplier"), NODES_GAPPY),
    "edges_cyclic": (("lineitem",), EDGES_CYCLIC),
    "questions": (("part", "supplier", "nation"), QUESTIONS),
    "payments": (("orders",), PAYMENTS),
    "users": (("customer",), USERS),
    "invoices": (("events",), INVOICES),
    "transfers": (("events",), TRANSFERS),
    "ledger": (("events",), LEDGER),
}
#: Given tables that jobs read as they are.
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a domain table over the given ones."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources, sql = SQL[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sources}
    with_names = f"WITH {', '.join(f'{t} AS (SELECT * FROM {{{t}}})' for t in sources)} {sql}"
    return spark.sql(with_names, **frames)


def oracle(names: tuple[str, ...], query: str) -> str:
    """A DuckDB query over domain tables."""
    own = [f"{n} AS ({SQL[n][1].strip()})" for n in names if n not in GIVEN]
    if not own:
        return query
    rest = query.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(own)}, {rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {', '.join(own)}, {rest[5:]}"
    return f"WITH {', '.join(own)} {rest}"
