"""Streams that end by the watermark, credit once and can be run again; tables that are changed bucket by bucket."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kgspark.operators import ledger as L
from kgspark.sources import io
from kgspark.sources.buckets import BucketTable
from kgspark.streaming import jobs as S

START = datetime(2024, 3, 1)
KEY = 77


def at(minutes):
    return START + timedelta(minutes=minutes)


def stream(spark, path, schema, *files):
    """A stream that gets one file a batch."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        newest = max((f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def told(df):
    return sorted((r["id"], r["user_id"], r["outcome"], r["told_at"]) for r in df.collect())


SESSIONS = "id long, user_id long, kind string, at timestamp"


def test_sessions_end_by_the_watermark_alone(spark, tmp_path):
    first = [(1, 1, "create", at(0)), (2, 2, "create", at(1)), (3, 2, "complete", at(2)), (4, 3, "read", at(3)), (5, 4, "create", at(4)), (6, 4, "complete", at(5)), (7, 4, "read", at(6))]
    events = stream(spark, str(tmp_path / "in"), SESSIONS, first, [(8, 9, "read", at(120))])
    out = S.drain(S.stream_login_sessions(events), path=str(tmp_path / "s"))
    assert told(out) == [
        (1, 1, "created", at(0)), (1, 1, "expired", at(10)), (2, 2, "created", at(1)), (2, 2, "expired", at(11)), (3, 2, "completed", at(2)),
        (4, 3, "none", at(3)), (5, 4, "created", at(4)), (6, 4, "completed", at(5)), (7, 4, "consumed", at(6)), (8, 9, "none", at(120)),
    ]
    assert spark.read.format("statestore").load(f"{tmp_path}/s/state").count() == 0


@pytest.mark.parametrize("files", [1, 5])
def test_sessions_are_told_the_same_in_any_batches(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [(i, rng.randrange(6), rng.choice(["create", "create", "complete", "read"]), at(i * 1.5)) for i in range(200)] + [(900, 99, "read", at(5000))]
    want, held = [], {}
    for i, user, kind, when in rows:
        session = held.get(user)
        if session and when - session[1] > timedelta(minutes=10):
            want.append((session[0], user, "expired", session[1] + timedelta(minutes=10)))
            session = None
        if kind == "create":
            session, said = [i, when, False], "created"
        elif session is None:
            said = "none"
        elif kind == "complete":
            session[2], said = True, "completed"
        else:
            said = "consumed" if session[2] else "pending"
            session = None if session[2] else session
        want.append((i, user, said, when))
        held[user] = session
    want += [(s[0], u, "expired", s[1] + timedelta(minutes=10)) for u, s in held.items() if s]
    cut = [rows[len(rows) * k // files : len(rows) * (k + 1) // files] for k in range(files)]
    out = S.drain(S.stream_login_sessions(stream(spark, str(tmp_path / "in"), SESSIONS, *cut)))
    assert told(out) == sorted(want)


DELETIONS = "id long, user_id long, kind string, token string, at timestamp"


def test_deletions_are_confirmed_once(spark, tmp_path):
    day = 24 * 60
    rows = [
        (1, 1, "request", "a", at(0)), (2, 1, "confirm", "x", at(1)), (3, 1, "confirm", "a", at(2)), (4, 1, "confirm", "a", at(3)),
        (5, 2, "request", "a", at(4)), (6, 2, "request", "b", at(5)), (7, 2, "confirm", "a", at(6)),
        (8, 3, "request", "c", at(7)), (9, 4, "confirm", "c", at(8)),
    ]
    late = [(10, 3, "confirm", "c", at(7 + day)), (11, 2, "confirm", "b", at(4 + day)), (12, 5, "request", "e", at(3 * day))]
    out = S.drain(S.stream_deletions(stream(spark, str(tmp_path / "in"), DELETIONS, rows, late)))
    assert told(out) == [
        (2, 1, "failed", at(1)), (3, 1, "approved", at(2)), (4, 1, "failed", at(3)), (5, 2, "superseded", at(5)), (7, 2, "failed", at(6)),
        (8, 3, "expired", at(7 + day)), (9, 4, "failed", at(8)), (10, 3, "failed", at(7 + day)), (11, 2, "approved", at(4 + day)),
    ]


def test_deletions_expire_by_the_watermark_alone(spark, tmp_path):
    day = 24 * 60
    out = S.drain(S.stream_deletions(stream(spark, str(tmp_path / "in"), DELETIONS, [(1, 1, "request", "a", at(0))], [(2, 2, "confirm", "a", at(2 * day))])), path=str(tmp_path / "s"))
    assert told(out) == [(1, 1, "expired", at(day)), (2, 2, "failed", at(2 * day))]
    assert spark.read.format("statestore").load(f"{tmp_path}/s/state").count() == 0


INVOICES = "id long, amount double, created_at timestamp"
TRANSFERS = "tx_id long, content string, paid double, paid_at timestamp"


def code(spark, i):
    return "Ck " + spark.range(1).select(L.encode_payment_id(F.lit(i), KEY)).first()[0].lower() + " cam on"


def test_one_transfer_in_two_batches_credits_once(spark, tmp_path):
    one, two = code(spark, 1), code(spark, 2)
    invoices = stream(spark, str(tmp_path / "i"), INVOICES, [(1, 10.0, at(0)), (2, 10.0, at(0))], [(3, 5.0, at(30))])
    paid = (7, one, 10.0, at(5))
    transfers = stream(spark, str(tmp_path / "t"), TRANSFERS, [paid, (8, two, 9.0, at(5)), (9, "no code", 50.0, at(5))], [paid, (10, one, 20.0, at(8)), (11, two, 10.0, at(9))], [paid])
    out = S.drain(S.stream_payments(invoices, transfers, KEY)).collect()
    assert sorted((r.id, r.tx_id, r.paid) for r in out) == [(1, 7, 10.0), (2, 11, 10.0)]


def test_of_one_batch_the_first_transfer_counts(spark, tmp_path):
    invoices = stream(spark, str(tmp_path / "i"), INVOICES, [(1, 10.0, at(0))])
    rows = [(9, code(spark, 1), 30.0, at(4)), (8, code(spark, 1), 10.0, at(3)), (7, code(spark, 1), 10.0, at(-11)), (6, code(spark, 1), 10.0, at(1441))]
    out = S.drain(S.stream_payments(invoices, stream(spark, str(tmp_path / "t"), TRANSFERS, rows), KEY)).collect()
    assert [(r.id, r.tx_id) for r in out] == [(1, 8)]


# tables in buckets


def files(table):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(table.path) for f in names}


def test_deleting_twice_leaves_what_once_leaves(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"))
    table.create(spark.range(100).withColumn("x", F.col("id") * 2), ["id"], buckets=8)
    gone = spark.createDataFrame([(3,), (5,), (3,), (1000,)], "id long")
    assert table.delete(gone, version=1) == 1
    once = sorted(r.id for r in table.read().collect())
    assert table.delete(gone, version=1) == 1 and sorted(r.id for r in table.read().collect()) == once == [i for i in range(100) if i not in (3, 5)]
    # Whole buckets may go, and so may all.
    table.delete(table.read().select("id"))
    assert table.read().count() == 0 and table.read().columns == ["id", "x"] and table.version == 2


def test_cascading_deletes_run_again(spark, tmp_path):
    tables = {}
    for name, key, df in (("users", "id", spark.range(20)), ("payments", "user_id", spark.range(200).select((F.col("id") % 20).alias("user_id"), F.col("id").alias("amount")))):
        tables[str(tmp_path / name)] = key
        BucketTable(spark, str(tmp_path / name)).create(df, [key], buckets=4)
    approved = stream(spark, str(tmp_path / "in"), "user_id long", [(3,), (4,)], [(4,), (7,)])
    for _ in range(2):  # the second run has a checkpoint of its own, so it repeats all batches
        S.stream_cascade_delete(approved, tables)
        users, payments = (BucketTable(spark, p).read() for p in tables)
        assert users.count() == 17 and payments.count() == 170 and payments.where("user_id in (3, 4, 7)").isEmpty()
    assert BucketTable(spark, str(tmp_path / "users")).version == 2


def test_cascading_deletes_work_out_users_once(spark, tmp_path):
    tables = {}
    for name in ("users", "payments", "tokens"):
        tables[str(tmp_path / name)] = "id"
        BucketTable(spark, str(tmp_path / name)).create(spark.range(20), ["id"], buckets=4)
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    S.stream_cascade_delete(stream(spark, str(tmp_path / "in"), "user_id long", [(3,), (4,), (3,)]).mapInArrow(run, "user_id long"), tables)
    assert seen.value == 3 and all(sorted(r.id for r in BucketTable(spark, p).read().collect()) == [i for i in range(20) if i not in (3, 4)] for p in tables)


def test_write_graph_upserts_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = spark.createDataFrame([(f"n{i}", "X", f"name {i}") for i in range(50)], "id string, label string, name string")
    edges = spark.createDataFrame([(f"n{i}", "r", f"n{i + 1}") for i in range(50)], "from_id string, relation_type string, to_id string")
    io.write_graph(nodes, edges, path, buckets=16)
    before = files(BucketTable(spark, path))
    more = spark.createDataFrame([("n7", None, "new", 3), ("n7", None, "new", 3), ("z", "Y", None, None)], "id string, label string, name string, seen int")
    links = spark.createDataFrame([("n7", "r", "z", "w"), ("n7", "r", "n8", "v"), ("n7", "r", "ghost", "v")], "from_id string, relation_type string, to_id string, why string")
    for _ in range(2):
        io.write_graph(more, links, path, version=1)
    n, e = io.read_graph(spark, path)
    got = {r.id: (r.label, r.name, r.seen) for r in n.collect()}
    assert len(got) == 51 and got["n7"] == ("X", "new", 3) and got["z"] == ("Y", None, None) and got["n8"] == ("X", "name 8", None)
    assert {(r.from_id, r.to_id, r.why) for r in e.where("from_id = 'n7'").collect()} == {("n7", "z", "w"), ("n7", "n8", "v")} and e.count() == 50
    after = files(BucketTable(spark, path))
    assert all(after[f] == t for f, t in before.items())
    assert 1 <= len([d for d in os.listdir(f"{path}/nodes/data/version=1") if d.startswith("bucket")]) <= 2


def test_documents_are_compacted_in_natural_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in (10, 9, 100, 1):
        (tmp_path / "in" / f"page_{i}.json").write_text('{"entity": {"id": "VT_%d"}, "relationships": []}' % i)
    (tmp_path / "in" / "page_2.json").write_text('{"entity": {')
    io.compact_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.file for r in rows] == ["page_1.json", "page_2.json", "page_9.json", "page_10.json", "page_100.json"]
    assert [r.entity.id if r._corrupt_record is None else None for r in rows] == ["VT_1", None, "VT_9", "VT_10", "VT_100"]
    io.compact_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), file_bytes=60)
    parts = [f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]
    assert len(parts) > 1 and spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_compaction_opens_files_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in (10, 9, 1):
        (tmp_path / "in" / f"page_{i}.json").write_text('{"entity": {"id": "VT_%d"}, "relationships": []}' % i)
    real = io.materialize

    def once(df):
        out = real(df)
        for file in (tmp_path / "in").iterdir():
            file.write_text("gone")
        return out

    monkeypatch.setattr(io, "materialize", once)
    io.compact_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), file_bytes=60)
    assert [r.entity.id for r in spark.read.parquet(str(tmp_path / "out")).orderBy("place").collect()] == ["VT_1", "VT_9", "VT_10"]
