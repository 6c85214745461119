"""Event streams: payments, ledger, sessions, daily counts, query cache. Each has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from kgspark.operators.ledger import decode_payment_id
from kgspark.sources.buckets import BucketTable
from kgspark.sources.shared import materialize, shared_folder

#: Microseconds that a login session and a request for deletion last.
SESSION, DAY = 600 * 10**6, 86_400 * 10**6


def shared_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over what is there and return what it wrote, with the number of the batch that wrote it.

    path: where its output and state are kept, to go on from later; by default a new folder.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark)

    def save(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/n={number}")

    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("batch", IntegerType())
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def _timed(events: DataFrame, key: str, order: list[str], step, due, end, schema: str, state: str) -> DataFrame:
    """Rows of events folded into a state for each key, in order in each batch, that ends by itself when the watermark passes its time.

    step(held or None, row) -> (held or None, result rows); due(held) -> the microsecond after which it is over; end(held) -> the result
    rows of its end. An end is told once, by the next event of the key or by the watermark alone, and nothing of it is kept.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(found: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held, out = (group.get if group.exists else None), []
        if not group.hasTimedOut:
            rows = list(parts)
            rows = rows[0] if len(rows) == 1 else pd.concat(rows)
            for row in (rows if len(rows) == 1 else rows.sort_values(order)).itertuples(index=False):
                held, more = step(held, row)
                out += more
        # A timer is set in milliseconds, and fires when the watermark is beyond it.
        if held is not None and (group.hasTimedOut or due(held) // 1000 < group.getCurrentWatermarkMs()):
            out += end(held)
            held = None
        if held is not None:
            group.update(held)
            group.setTimeoutTimestamp(due(held) // 1000)
        elif group.exists:
            group.remove()
        if out:
            yield pd.DataFrame([(*row[:1], found[0], *row[1:]) for row in out], columns=names)

    return events.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def _micros(at: pd.Timestamp) -> int:
    return at.value // 1000


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def stream_payments(invoices: DataFrame, transfers: DataFrame, key: int, delay: str = "15 minutes") -> DataFrame:
    """Invoices (id, amount, created_at) with the first transfer (tx_id, content, paid, paid_at) that pays each: id, tx_id, paid_at, paid.

    The invoice's id is decoded from the transfer's text. Its amount must be met, from ten minutes before the invoice to a day after. An interval join,
    so that the state holds a day of either side; then a state for each paid invoice, for as long as the join can still find a transfer of it. So an
    invoice is credited once, whether transfers of it, or one transfer again, come in one batch or in several.
    """
    i = invoices.withWatermark("created_at", delay)
    decoded = transfers.withColumn("paid_id", decode_payment_id(F.col("content"), key)).where("paid_id is not null")
    t = decoded.select("paid_id", "tx_id", "paid", "paid_at").withWatermark("paid_at", delay)
    when = F.expr("paid_at >= created_at - INTERVAL 600 SECONDS AND paid_at <= created_at + INTERVAL 86400 SECONDS")
    pairs = i.join(t, (F.col("id") == F.col("paid_id")) & when & (F.col("paid") >= F.col("amount")))
    pairs = pairs.select("id", "tx_id", "paid_at", "paid", F.unix_micros("created_at").alias("created"))

    def step(held, row):
        return (held, []) if held is not None else ((row.created,), [(row.id, row.tx_id, row.paid_at, row.paid)])

    # The key comes back from the group, so the row's own copy is taken off again.
    out = _timed(pairs, "id", ["paid_at", "tx_id"], step, lambda held: held[0] + DAY, lambda held: [], "invoice long, id long, tx_id long, paid_at timestamp, paid double", "created long")
    return out.select("id", "tx_id", "paid_at", "paid")


def ledger_step(balance: float, kind: str, amount: float, forced: bool) -> tuple[float, float, bool]:
    """(balance after, amount applied, refused)."""
    if kind == "in":
        return balance + amount, amount, False
    if balance >= amount:
        return balance - amount, amount, False
    return (0.0, balance, False) if forced else (balance, 0.0, True)


def stream_ledger(events: DataFrame) -> DataFrame:
    """Events (id, user_id, type, amount, forced, created_at) applied to their user's balance, in time order in each batch."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["created_at", "id"])
        balance, out = (state.get[0] if state.exists else 0.0), []
        for i, kind, amount, forced in zip(rows["id"], rows["type"], rows["amount"], rows["forced"]):
            balance, applied, refused = ledger_step(balance, kind, amount, forced)
            out.append((i, key[0], applied, balance, refused))
        state.update((balance,))
        yield pd.DataFrame(out, columns=["id", "user_id", "applied", "balance", "refused"])

    schema = "id long, user_id long, applied double, balance double, refused boolean"
    return events.groupBy("user_id").applyInPandasWithState(run, schema, "balance double", "append", GroupStateTimeout.NoTimeout)


def session_step(held: tuple | None, row) -> tuple[tuple | None, list]:
    """A login session (its create event, when it was opened, whether it is completed) and an event -> the session after it, and what to tell.

    create opens one anew; complete and read work within SESSION of it; a completed session is handed out once, on read.
    """
    at, out = _micros(row.at), []
    if held is not None and at - held[1] > SESSION:
        out, held = session_end(held), None
    if row.kind == "create":
        return (row.id, at, False), [*out, (row.id, "created", row.at)]
    if held is None:
        return None, [*out, (row.id, "none", row.at)]
    if row.kind == "complete":
        return (*held[:2], True), [*out, (row.id, "completed", row.at)]
    return (None, [*out, (row.id, "consumed", row.at)]) if held[2] else (held, [*out, (row.id, "pending", row.at)])


def session_end(held: tuple) -> list:
    return [(held[0], "expired", _time(held[1] + SESSION))]


def stream_login_sessions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events (id, user_id, kind, at) -> id, user_id, outcome, told_at; one session a user.

    Each event has its outcome. A session that runs out says so once, under its create event's id and the time that it ended at,
    when the watermark gets there, whether or not its user comes back.
    """
    timed = events.withWatermark("at", delay)
    return _timed(timed, "user_id", ["at", "id"], session_step, lambda held: held[1] + SESSION, session_end, "id long, user_id long, outcome string, told_at timestamp", "id long, opened long, done boolean")


def stream_daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running number of events (at) of each day, by tumbling windows."""
    return events.withWatermark("at", delay).groupBy(F.window("at", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def stream_query_cache(questions: DataFrame, delay: str = "40 days") -> DataFrame:
    """The same question (question, at) is let through once within the delay."""
    return questions.withWatermark("at", delay).dropDuplicatesWithinWatermark(["question"]).select("question")


def deletion_step(held: tuple | None, row) -> tuple[tuple | None, list]:
    """A pending request (id, token, when) and an event -> the pending request after it, and what to tell.

    A request ends the one before it. A confirmation with the pending one's token, within DAY of it, approves it, once.
    """
    at, out = _micros(row.at), []
    if held is not None and at - held[2] >= DAY:
        out, held = deletion_end(held), None
    if row.kind == "request":
        ended = [] if held is None else [(held[0], "superseded", row.at)]
        return (row.id, row.token, at), out + ended
    if held is not None and row.token == held[1]:
        return None, [*out, (row.id, "approved", row.at)]
    return held, [*out, (row.id, "failed", row.at)]


def deletion_end(held: tuple) -> list:
    return [(held[0], "expired", _time(held[2] + DAY))]


def stream_deletions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events (id, user_id, kind, token, at) -> id, user_id, outcome, told_at; kind is request or confirm.

    A request is told of when it ends without approval: superseded by the user's next one, or expired a day after it, by the watermark alone if
    need be. A confirmation is approved or failed (another token, too late, or used already).
    """
    timed = events.withWatermark("at", delay)
    return _timed(timed, "user_id", ["at", "id"], deletion_step, lambda held: held[2] + DAY, deletion_end, "id long, user_id long, outcome string, told_at timestamp", "id long, token string, at long")


def stream_cascade_delete(approved: DataFrame, tables: Mapping[str, str]) -> None:
    """Take the users that a stream approves (user_id) out of every table; runs until the stream is used up.

    tables: the user column of the BucketTable at each path, which is its key. A batch is change number batch + 1 of each table, worked out from the one before, so
    a batch that is run again, after a failure between two tables too, leaves what one run leaves. Buckets without such users stay as they are.
    A batch's users are a checkpoint, so what comes before them, with its state, is worked out once and not for each use of a table.
    """
    spark = approved.sparkSession

    def delete(batch: DataFrame, number: int) -> None:
        users = materialize(batch.select("user_id").distinct())
        for path, key in tables.items():
            BucketTable(spark, path).delete(users.withColumnRenamed("user_id", key), number + 1)

    query = approved.writeStream.foreachBatch(delete).outputMode("append").option("checkpointLocation", f"{shared_path(spark)}/state").trigger(availableNow=True).start()
    query.awaitTermination()
