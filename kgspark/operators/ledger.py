"""Users, payments, the token ledger and chat analytics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE_PREFIX = "NAPTOKEN"
EARLY_SECONDS, LATE_SECONDS = 600, 86_400


def encode_payment_id(payment_id: Column, key: int) -> Column:
    """Payment code of an invoice id: prefix and the hex form of id XOR key."""
    return F.concat(F.lit(CODE_PREFIX), F.hex(payment_id.cast("long").bitwiseXOR(F.lit(key).cast("long"))))


def decode_payment_id(content: Column, key: int) -> Column:
    """Invoice id from free text with a payment code in it; null without one."""
    digits = F.regexp_extract(F.coalesce(content, F.lit("")), f"(?i){CODE_PREFIX}([0-9A-F]+)", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long").bitwiseXOR(F.lit(key).cast("long")))


def quote_tokens(df: DataFrame, rate: float) -> DataFrame:
    """Tokens that an amount buys: thousands times the rate."""
    return df.withColumn("quoted_tokens", F.round(F.floor(F.col("amount_vnd") / 1000) * rate, 4))


def search_substring(df: DataFrame, columns: Sequence[str], term: str) -> DataFrame:
    """Rows in which one of the columns contains the term, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False))
    return df.where(found)


def payments_with_users(payments: DataFrame, users: DataFrame) -> DataFrame:
    """Payments with their user's e-mail; newest first is the reader's sort."""
    return payments.join(users.select(F.col("id").alias("user_id"), "email"), "user_id").select("id", "user_id", "email", "amount_vnd", "status", "created_at")


def recent_transactions(payments: DataFrame, n: int = 5) -> DataFrame:
    return payments.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def users_newest_first(users: DataFrame, root_email: str | None = None) -> DataFrame:
    """Users with a flag for the root admin: the admin with the given e-mail, else the first admin. Newest first."""
    if root_email is not None:
        return users.withColumn("is_root", (F.col("role") == "admin") & (F.col("email") == root_email)).orderBy(F.desc("id"))
    first = users.where(F.col("role") == "admin").agg(F.min_by("email", "id").alias("root_email"))
    flagged = users.join(F.broadcast(first)).withColumn("is_root", (F.col("role") == "admin") & (F.col("email") == F.col("root_email")))
    return flagged.drop("root_email").orderBy(F.desc("id"))


def match_bank_transactions(invoices: DataFrame, transfers: DataFrame, key: int) -> DataFrame:
    """Each invoice (id, amount, created_at) with the first transfer (tx_id, content, amount, paid_at) that pays it.

    The transfer's text holds the invoice's payment code; its amount is at least the invoice's, paid in [created - 600 s, created + 86400 s]. An
    equi-join on the decoded id; amount and time are residual.
    """
    seconds = F.col("paid_at").cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")
    t = transfers.select("tx_id", "paid_at", F.col("amount").alias("paid"), decode_payment_id(F.col("content"), key).alias("id"))
    near = (seconds >= -EARLY_SECONDS) & (seconds <= LATE_SECONDS)
    pairs = invoices.join(t, "id").where(near & (F.col("paid") >= F.col("amount")))
    first = F.min_by(F.struct("tx_id", "paid_at", "paid"), F.struct("paid_at", "tx_id"))
    return pairs.groupBy("id").agg(first.alias("tx")).select("id", "tx.tx_id", "tx.paid_at", "tx.paid")


def dashboard_totals(payments: DataFrame, users: DataFrame, chat: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: completed revenue, users, user questions, nodes."""
    revenue = payments.where("status = 'completed'").agg(F.round(F.coalesce(F.sum("amount_vnd"), F.lit(0.0)), 2).alias("revenue"))
    counts = [users.agg(F.count("*").alias("n_users")), chat.where("role = 'user'").agg(F.count("*").alias("n_queries")), nodes.agg(F.count("*").alias("n_nodes"))]
    for c in counts:
        revenue = revenue.join(c)  # one row each
    return revenue


def revenue_by_type(payments: DataFrame) -> DataFrame:
    """Completed revenue without admin adjustments, by status and type with totals (null: all)."""
    kept = payments.where("status = 'completed' and transaction_type <> 'admin'")
    return kept.cube("status", "transaction_type").agg(F.round(F.sum("amount_vnd"), 2).alias("revenue"), F.count("*").alias("n"))


def daily_queries(chat: DataFrame, asof: str, days: int) -> DataFrame:
    """User messages on each of the days that end with asof, zeros included."""
    day = F.explode(F.sequence(F.date_sub(F.lit(asof).cast("date"), days - 1), F.lit(asof).cast("date")))
    calendar = chat.sparkSession.range(1).select(day.alias("day"))
    counted = chat.where("role = 'user'").groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def ledger_balance(history: DataFrame, users: DataFrame) -> DataFrame:
    """Balance by the history, next to the stored one."""
    signed = F.sum(F.when(F.col("type") == "in", F.col("amount")).otherwise(-F.col("amount")))
    per = history.groupBy("user_id").agg(F.round(signed, 4).alias("balance"), F.count("*").alias("n_rows"))
    out = users.select(F.col("id").alias("user_id"), "token_balance").join(per, "user_id", "left")
    return out.select("user_id", "token_balance", F.coalesce("balance", F.lit(0.0)).alias("balance"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def apply_ledger(events: DataFrame) -> DataFrame:
    """Token movements in order, user by user: an outgoing one over the balance is refused unless forced, and a
    forced one takes what is there. Refused rows don't count, so this is no running sum.

    Returns event id, user_id, applied amount, balance after it, refused.
    """
    ordered = events.select("id", "user_id", "type", "amount", "forced", "created_at").repartition("user_id").sortWithinPartitions("user_id", "created_at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, balance = None, 0.0
        for part in batches:
            rows = []
            for i, u, kind, amount, forced in zip(part["id"], part["user_id"], part["type"], part["amount"], part["forced"]):
                if u != user:
                    user, balance = u, 0.0
                refused = False
                if kind == "in":
                    balance += amount
                elif balance >= amount:
                    balance -= amount
                elif forced:
                    amount, balance = balance, 0.0
                else:
                    amount, refused = 0.0, True
                rows.append((i, u, amount, balance, refused))
            yield pd.DataFrame(rows, columns=["id", "user_id", "applied", "balance", "refused"])

    return ordered.mapInPandas(run, "id long, user_id long, applied double, balance double, refused boolean")


def session_titles(chat: DataFrame, per_user: int = 100) -> DataFrame:
    """Each session with its first user message and last message id, the newest sessions of a user first, per_user at most."""
    is_user = F.col("role") == "user"
    sessions = chat.groupBy("user_id", "session_id").agg(F.min_by(F.when(is_user, F.col("content")), F.when(is_user, F.col("id"))).alias("title"), F.max("id").alias("last_id"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_id")))
    return sessions.withColumn("place", place).where(F.col("place") <= per_user)


def conversation_detail(chat: DataFrame, session_id: int, user_id: int) -> DataFrame:
    return chat.where((F.col("session_id") == session_id) & (F.col("user_id") == user_id)).orderBy("id")


def metric_means(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric, mean and n of each column, one row each."""
    long = metrics.unpivot([], list(columns), "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows of users in gone (user_id). key: the user column of each table."""
    return {name: df.join(gone.select(F.col("user_id").alias(key[name])).distinct(), key[name], "left_anti") for name, df in tables.items()}


def deletion_status(requests: DataFrame) -> DataFrame:
    """Requests (id, user_id, created_at) with their status when the next one of the user comes: a later request within a
    day expires the one before; so does the day's end. Returns id, user_id, expires_at, superseded."""
    later = F.lead("created_at").over(Window.partitionBy("user_id").orderBy("created_at", "id"))
    ends = F.col("created_at") + F.expr("INTERVAL 1 DAY")
    return requests.withColumn("next_at", later).select("id", "user_id", F.least(ends, F.coalesce("next_at", ends)).alias("expires_at"), F.coalesce(F.col("next_at") < ends, F.lit(False)).alias("superseded"))
