"""Registered ledger, payment and chat queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import ledger as L

from .tables import load, oracle

KEY = 0x5EED
#: Chat tables: one message each half hour, from the start of 2024.
CHAT_SQL = """chat AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id % 10 AS user_id, role, text AS content,
  make_timestamp(2024, 1, 1, 0, 0, 0.0) + to_minutes(CAST((conv_id * 60 + turn) * 3 AS INT)) AS at FROM conversations)"""


def chat_table(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    minutes = (F.col("conv_id") * 60 + F.col("turn")) * 3
    at = F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), (F.col("conv_id") % 10).alias("user_id"), "role", F.col("text").alias("content"), at.alias("at"))


def transfer_text(paid_id):
    """What a bank says of a transfer that pays an invoice."""
    return F.concat(F.lit("CT DEN:0123 "), F.lower(L.encode_payment_id(paid_id, KEY)), F.lit(" GD 77"))


def payment_code(spark, sf_dir):
    p = load(spark, sf_dir, "payments").select("id", L.encode_payment_id(F.col("id"), KEY).alias("code"))
    text = F.concat(F.lit("transfer "), F.lower("code"), F.lit(" thank you"))
    return p.withColumn("back", L.decode_payment_id(text, KEY))


def quote_tokens(spark, sf_dir):
    return L.quote_tokens(load(spark, sf_dir, "payments"), 1.5).select("id", "quoted_tokens")


def search_substring(spark, sf_dir):
    return L.search_substring(load(spark, sf_dir, "users"), ["username", "email"], "MACHINERY").select("id", "email")


def payments_with_users(spark, sf_dir):
    return L.payments_with_users(load(spark, sf_dir, "payments"), load(spark, sf_dir, "users"))


def recent_transactions(spark, sf_dir):
    return L.recent_transactions(load(spark, sf_dir, "payments")).select("id", "user_id", "amount_vnd", "created_at")


def users_newest_first(spark, sf_dir):
    return L.users_newest_first(load(spark, sf_dir, "users")).select("id", "email", "role", "is_root")


def match_bank_transactions(spark, sf_dir):
    return L.match_bank_transactions(load(spark, sf_dir, "invoices"), load(spark, sf_dir, "transfers").withColumn("content", transfer_text(F.col("paid_id"))), KEY)


def dashboard_totals(spark, sf_dir):
    return L.dashboard_totals(load(spark, sf_dir, "payments"), load(spark, sf_dir, "users"), chat_table(spark, sf_dir), load(spark, sf_dir, "nodes"))


def revenue_by_type(spark, sf_dir):
    return L.revenue_by_type(load(spark, sf_dir, "payments"))


def daily_queries(spark, sf_dir):
    return L.daily_queries(chat_table(spark, sf_dir), "2024-01-12", 30)


def ledger_balance(spark, sf_dir):
    return L.ledger_balance(load(spark, sf_dir, "ledger"), load(spark, sf_dir, "users"))


def apply_ledger(spark, sf_dir):
    out = L.apply_ledger(load(spark, sf_dir, "ledger"))
    return out.select("id", "user_id", F.round("applied", 4).alias("applied"), F.round("balance", 4).alias("balance"), "refused")


def session_titles(spark, sf_dir):
    return L.session_titles(chat_table(spark, sf_dir))


def conversation_detail(spark, sf_dir):
    return L.conversation_detail(chat_table(spark, sf_dir), 7, 7).select("id", "role", "content")


def metric_means(spark, sf_dir):
    return L.metric_means(load(spark, sf_dir, "labels").select(F.col("quality").cast("double"), F.col("toxic").cast("double")), ["quality", "toxic"])


def cascade_delete(spark, sf_dir):
    users, payments = load(spark, sf_dir, "users"), load(spark, sf_dir, "payments")
    gone = users.where("token_balance < 0").select(F.col("id").alias("user_id"))
    left = L.cascade_delete({"users": users, "payments": payments}, gone, {"users": "id", "payments": "user_id"})
    rows = [df.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).withColumn("name", F.lit(name)) for name, df in left.items()]
    return rows[0].unionByName(rows[1])


def deletion_status(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("event_type = 'error'")
    return L.deletion_status(e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at")))


ORACLE = {
    "payment_code": oracle(("payments",), f"SELECT id, 'NAPTOKEN' || upper(to_hex(xor(id, {KEY}))) AS code, id AS back FROM payments"),
    "quote_tokens": oracle(("payments",), "SELECT id, round(floor(amount_vnd / 1000) * 1.5, 4) AS quoted_tokens FROM payments"),
    "search_substring": oracle(("users",), "SELECT id, email FROM users WHERE username ILIKE '%machinery%' OR email ILIKE '%machinery%'"),
    "payments_with_users": oracle(("payments", "users"), "SELECT p.id, p.user_id, u.email, p.amount_vnd, p.status, p.created_at FROM payments p JOIN users u ON u.id = p.user_id"),
    "recent_transactions": oracle(("payments",), "SELECT id, user_id, amount_vnd, created_at FROM payments ORDER BY created_at DESC, id DESC LIMIT 5"),
    "users_newest_first": oracle(("users",), "SELECT id, email, role, role = 'admin' AND email = (SELECT min_by(email, id) FROM users WHERE role = 'admin') AS is_root FROM users ORDER BY id DESC"),
    "match_bank_transactions": oracle(("invoices", "transfers"), """SELECT id, tx_id, paid_at, paid FROM (SELECT i.id, t.tx_id, t.paid_at, t.amount AS paid, row_number() OVER (PARTITION BY i.id ORDER BY t.paid_at, t.tx_id) AS place
      FROM invoices i JOIN transfers t ON t.paid_id = i.id AND t.amount >= i.amount AND epoch_us(t.paid_at) - epoch_us(i.created_at) BETWEEN -600000000 AND 86400000000) WHERE place = 1"""),
    "dashboard_totals": oracle(("payments", "users", "nodes"), f"WITH {CHAT_SQL} SELECT (SELECT round(sum(amount_vnd), 2) FROM payments WHERE status = 'completed') AS revenue, (SELECT count(*) FROM users) AS n_users, (SELECT count(*) FROM chat WHERE role = 'user') AS n_queries, (SELECT count(*) FROM nodes) AS n_nodes"),
    "revenue_by_type": oracle(("payments",), "SELECT status, transaction_type, round(sum(amount_vnd), 2) AS revenue, count(*) AS n FROM payments WHERE status = 'completed' AND transaction_type <> 'admin' GROUP BY CUBE (status, transaction_type)"),
    "daily_queries": oracle((), f"WITH {CHAT_SQL} SELECT d::DATE AS day, count(c.id) AS n FROM generate_series(DATE '2023-12-14', DATE '2024-01-12', INTERVAL 1 DAY) g(d) LEFT JOIN chat c ON c.at::DATE = d::DATE AND c.role = 'user' GROUP BY 1"),
    "ledger_balance": oracle(("ledger", "users"), """SELECT u.id AS user_id, token_balance, coalesce(round(sum(CASE WHEN type = 'in' THEN amount ELSE -amount END), 4), 0.0) AS balance, count(l.id) AS n_rows
      FROM users u LEFT JOIN ledger l ON l.user_id = u.id GROUP BY 1, 2"""),
    "session_titles": oracle((), f"""WITH {CHAT_SQL}, s AS (SELECT user_id, session_id, min_by(content, id) FILTER (WHERE role = 'user') AS title, max(id) AS last_id FROM chat GROUP BY 1, 2)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_id DESC)::INT AS place FROM s) WHERE place <= 100"""),
    "conversation_detail": oracle((), f"WITH {CHAT_SQL} SELECT id, role, content FROM chat WHERE session_id = 7 AND user_id = 7"),
    "metric_means": "SELECT 'quality' AS metric, round(avg(quality), 4) AS mean, count(quality) AS n FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 4), count(toxic) FROM labels",
    "cascade_delete": oracle(("users", "payments"), """SELECT 'users' AS name, count(*) AS n, sum(id)::BIGINT AS ids FROM users WHERE token_balance >= 0
      UNION ALL SELECT 'payments', count(*), sum(id)::BIGINT FROM payments WHERE user_id NOT IN (SELECT id FROM users WHERE token_balance < 0)"""),
    "deletion_status": """SELECT event_id AS id, user_id, least(ts + INTERVAL 1 DAY, coalesce(nxt, ts + INTERVAL 1 DAY)) AS expires_at, coalesce(nxt < ts + INTERVAL 1 DAY, false) AS superseded
      FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'error')""",
    "apply_ledger": oracle(("ledger",), """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS k FROM ledger),
      walk AS (
        SELECT id, user_id, k, CASE WHEN type = 'in' THEN amount ELSE 0.0 END AS applied, CASE WHEN type = 'in' THEN amount ELSE 0.0 END AS balance, type = 'out' AND amount > 0 AND NOT forced AS refused FROM numbered WHERE k = 1
        UNION ALL
        SELECT n.id, n.user_id, n.k,
          CASE WHEN type = 'in' OR w.balance >= n.amount THEN n.amount WHEN forced THEN w.balance ELSE 0.0 END,
          CASE WHEN type = 'in' THEN w.balance + n.amount WHEN w.balance >= n.amount THEN w.balance - n.amount WHEN forced THEN 0.0 ELSE w.balance END,
          type = 'out' AND w.balance < n.amount AND NOT forced
        FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.k = w.k + 1)
      SELECT id, user_id, round(applied, 4) AS applied, round(balance, 4) AS balance, refused FROM walk"""),
}
QUERIES = {
    f.__name__: f
    for f in (payment_code, quote_tokens, search_substring, payments_with_users, recent_transactions, users_newest_first, match_bank_transactions, dashboard_totals, revenue_by_type, daily_queries, ledger_balance, apply_ledger, session_titles, conversation_detail, metric_means, cascade_delete, deletion_status)
}
