"""Registered stream, source, question and vector queries with their oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kgspark.operators import questions as Q
from kgspark.operators import vectors as V
from kgspark.sources import io
from kgspark.sources.buckets import BucketTable
from kgspark.streaming import jobs as S

from .ledger import KEY, transfer_text
from .ledger import ORACLE as LEDGER_ORACLE
from .retrieval import _FROM, _TO, _first, _hit
from .tables import load, oracle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf_dir):
    e = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")
    return e.withColumn("at", F.col("ts").cast("timestamp"))


def stream_payments(spark, sf_dir):
    e = _stream(spark, sf_dir)
    i = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("at").alias("created_at"))
    content = transfer_text(F.col("event_id") - F.col("event_id") % 8)
    t = e.where("event_type = 'purchase'").select(F.col("event_id").alias("tx_id"), content.alias("content"), (F.col("value") * 2).alias("paid"), F.col("at").alias("paid_at"))
    return S.drain(S.stream_payments(i, t, KEY)).drop("batch")


def stream_ledger(spark, sf_dir):
    e = _stream(spark, sf_dir)
    moves = e.select(F.col("event_id").alias("id"), "user_id", F.when(F.col("event_type").isin("signup", "purchase"), "in").otherwise("out").alias("type"), F.col("value").alias("amount"), (F.col("event_type") == "error").alias("forced"), F.col("at").alias("created_at"))
    out = S.drain(S.stream_ledger(moves))
    return out.select("id", "user_id", F.round("applied", 4).alias("applied"), F.round("balance", 4).alias("balance"), "refused")


def stream_login_sessions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "complete").otherwise("read")
    e = _stream(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", kind.alias("kind"), "at")
    return S.drain(S.stream_login_sessions(e)).drop("batch")


def stream_daily_queries(spark, sf_dir):
    out = S.drain(S.stream_daily_counts(_stream(spark, sf_dir).where("event_type = 'view'").select("at")), "update")
    return out.groupBy(F.to_date("start").alias("day")).agg(F.max_by("n", "batch").alias("n"))


def stream_query_cache(spark, sf_dir):
    return S.drain(S.stream_query_cache(_stream(spark, sf_dir).select(F.col("props").alias("question"), "at"))).drop("batch")


def _deletions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "request").otherwise("confirm")
    e = _stream(spark, sf_dir).where("event_type IN ('error', 'purchase')")
    return S.stream_deletions(e.select(F.col("event_id").alias("id"), "user_id", kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("token"), "at"))


def stream_deletions(spark, sf_dir):
    return S.drain(_deletions(spark, sf_dir)).drop("batch")


def stream_cascade_delete(spark, sf_dir):
    users, payments = (BucketTable(spark, f"{S.shared_path(spark)}/{name}") for name in ("users", "payments"))
    users.create(load(spark, sf_dir, "users"), ["id"])
    payments.create(load(spark, sf_dir, "payments"), ["user_id"])
    S.stream_cascade_delete(_deletions(spark, sf_dir).where("outcome = 'approved'").select("user_id"), {users.path: "id", payments.path: "user_id"})
    rows = [t.read().agg(F.count("*").alias("n"), F.sum("id").alias("ids")).withColumn("name", F.lit(name)) for name, t in (("users", users), ("payments", payments))]
    return rows[0].unionByName(rows[1])


def write_graph(spark, sf_dir):
    """Two loads: the second one renames nodes, adds some, and brings edges with descriptions, some of them without both ends."""
    path = S.shared_path(spark)
    io.write_graph(load(spark, sf_dir, "nodes"), load(spark, sf_dir, "edges"), path)
    gappy = load(spark, sf_dir, "nodes_gappy").groupBy("id").agg(F.max(F.upper("name")).alias("name"), F.count("*").alias("seen"))
    raw = load(spark, sf_dir, "edges_raw").groupBy("from_id", "relation_type", "to_id").agg(F.min("description").alias("description"))
    io.write_graph(gappy, raw, path)
    nodes, edges = io.read_graph(spark, path)
    found = nodes.select("id", "label", "name", "alias", "seen", F.lit(None).cast("string").alias("description"))
    key = F.concat_ws("|", "from_id", "relation_type", "to_id")
    nothing = F.lit(None).cast("string")
    return found.unionByName(edges.select(key.alias("id"), nothing.alias("label"), nothing.alias("name"), nothing.alias("alias"), F.lit(None).cast("long").alias("seen"), "description"))


#: How files of a document each are written: tasks move their own into place, and on a local disk without a checksum file beside each.
ONE_A_FILE = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2, "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _silver_files(spark, sf_dir, files=250):
    """A folder with a JSON document of each supplier, every one whose nation is 3 cut off, and an error in those of nation 5.

    A task writes about `files` of them. A supplier's edges meet in one exchange of rows; sets made before it would be sorted on both of its sides.
    """
    n, raw = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "edges_raw")
    n = n.withColumn("from_id", F.concat(F.lit("BT_"), "s_suppkey"))
    tasks = -(-n.count() // files) or 1
    relation = F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "relation_type", F.struct("source_id").alias("source"), F.col("confidence").alias("confidence_score"))
    rows = raw.select("from_id", "to_id", "relation_type", "source_id", "confidence").repartition(tasks, "from_id")
    per = rows.groupBy("from_id").agg(F.sort_array(F.collect_set(relation)).alias("relationships"))
    entity = F.struct(F.concat(F.lit("BT_"), "s_suppkey").alias("id"), F.col("s_name").alias("display_name"), F.when(F.col("s_nationkey") == 5, "no answer").alias("error"))
    whole = n.repartition(tasks, "from_id").join(per, "from_id", "left").select("s_nationkey", F.to_json(F.struct(entity.alias("entity"), "relationships")).alias("value"))
    path = f"{S.shared_path(spark)}/silver"
    cut = F.when(F.col("s_nationkey") == 3, F.substring("value", 1, 40)).otherwise(F.col("value"))
    whole.select(cut.alias("value")).write.options(**ONE_A_FILE).text(path)
    return path


def read_documents(spark, sf_dir):
    docs = io.read_documents(spark, _silver_files(spark, sf_dir)).where("_corrupt_record is null")
    return docs.select(F.col("entity.id").alias("id"), F.col("entity.display_name").alias("name"), F.coalesce(F.size("relationships"), F.lit(0)).alias("n"), F.col("entity.error").alias("error"))


def corrupt_record_stats(spark, sf_dir):
    return io.corrupt_record_stats(io.read_documents(spark, _silver_files(spark, sf_dir)))


def compact_documents(spark, sf_dir):
    """The edges of all documents, read from the compacted files."""
    out = f"{S.shared_path(spark)}/bronze"
    io.compact_documents(spark, _silver_files(spark, sf_dir), out)
    edges = io.explode_edges(spark.read.parquet(out))
    return edges.groupBy("from_id", "relation_type").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


def read_page_text(spark, sf_dir):
    path = f"{S.shared_path(spark)}/pages"
    pages = load(spark, sf_dir, "part").groupBy(F.col("p_size").alias("page")).agg(F.array_join(F.sort_array(F.collect_list("p_name")), "\n").alias("value"))
    pages.repartition("page").write.partitionBy("page").text(path)
    return io.read_page_text(spark, path).select("page", F.md5(F.trim(F.regexp_replace("text", "\\n$", ""))).alias("digest"))


def append_report(spark, sf_dir):
    """Two reports in one folder."""
    path, o = f"{S.shared_path(spark)}/report", load(spark, sf_dir, "orders")
    for status in ("F", "O"):
        io.append_report(o.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("doc_id"), F.lit(status).alias("status"), F.round("o_totalprice", 2).alias("score")), path)
    return spark.read.schema("doc_id long, status string, score double").json(path)


def write_csv_report(spark, sf_dir):
    path = f"{S.shared_path(spark)}/csv"
    io.write_csv_report(load(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n")), path)
    return spark.read.option("header", True).schema("doc_id long, lang string, n int").csv(path)


def read_relational(spark, sf_dir):
    path = S.shared_path(spark)
    for name in ("users", "payments"):
        load(spark, sf_dir, name).write.parquet(f"{path}/{name}.parquet")
    tables = io.read_relational(spark, path, ["users", "payments"])
    joined = tables["payments"].join(tables["users"].select(F.col("id").alias("user_id"), "role"), "user_id")
    return joined.groupBy("role", "status").agg(F.count("*").alias("n"), F.round(F.sum("amount_vnd"), 2).alias("total"))


def repair_json(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("sure: ["), F.regexp_replace("props", "}$", ", }"), F.lit("]")))
        .when(k == 3, F.substring("props", 1, 5))
        .when(k == 4, F.regexp_replace("props", '": ', '" : \\\\ '))
        .otherwise(F.col("props"))
    )
    return e.select("event_id", io.repair_json(raw, "k long")["k"].alias("k"))


def toc_by_page(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    toc = p.select(F.col("p_size").alias("page"), F.col("p_name").alias("entity_name"), F.when(F.col("p_brand") == "Brand#1", F.col("p_type")).alias("group"))
    return io.toc_by_page(toc).select("page", F.size("candidates").alias("n"), F.array_join(F.transform("candidates", lambda c: F.concat_ws("/", c["entity_name"], c["group"])), ";").alias("candidates"))


def flatten_text(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn"))).alias("system"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("user"))
    return c.select("conv_id", F.md5(io.flatten_text(c, ["system", "user"])).alias("digest"))


def vector_topk(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return V.vector_topk(v.where("id % 100 = 0"), v, 30, 0.5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "place")


#: How part number k asks, by k modulo 14: text of the question, intent, and the SQL of its keywords.
ASKED = (
    ("'Để chữa bệnh ' || p_type || ', vị thuốc ' || p_name || ' được dùng với liều lượng và cách thức như thế nào?'", "TIM_HUONG_DAN_SU_DUNG", "p_name", "p_type"),
    ("'Cho hỏi thuốc nào vừa có tính ' || p_type || ' vừa trực tiếp chữa bệnh ' || p_brand || '?'", "TIM_DA_QUAN_HE", "p_type", "p_brand"),
    ("'Vị thuốc ' || p_name || ' có tính ' || p_type || ' không?'", "KIEM_TRA_BOOLEAN", "p_name", "p_type"),
    ("'Vị thuốc ' || p_name || ' tham gia vào bài thuốc để chữa những bệnh gì?'", "TIM_CONG_DUNG_BAI_THUOC_TU_VI_THUOC", "p_name", "''"),
    ("'Bệnh illness ' || CAST(p_size % 5 AS STRING) || ' có thể dùng vị thuốc hoặc bài thuốc nào để chữa?'", "TIM_THUOC_CHUA_BENH", "'illness ' || CAST(p_size % 5 AS STRING)", "''"),
    ("'Cho tôi biết vị của ' || p_name || '.'", "TIM_VI", "p_name", "''"),
    ("'Tính chất của ' || p_name || ' là gì?'", "TIM_TINH", "p_name", "''"),
    ("'Vị thuốc ' || p_name || ' quy vào kinh nào?'", "TIM_QUY_KINH", "p_name", "''"),
    ("'Thành phần hóa học của ' || p_name || ' gồm những gì?'", "TIM_HOAT_CHAT_CUA_THUOC", "p_name", "''"),
    ("'Hãy cho biết công năng của ' || p_name || '.'", "TIM_CONG_NANG", "p_name", "''"),
    ("'Tác dụng dược lý của ' || p_name || ' ra sao?'", "TIM_TAC_DUNG_DUOC_LY", "p_name", "''"),
    ("p_name || ' dùng được ko'", "KIEM_TRA_BOOLEAN", "p_name || ' dùng được ko'", "''"),
    ("'Vị thuốc nào có ' || p_type || ' và ' || p_brand || '?'", "TIM_DA_QUAN_HE", "p_type", "p_brand"),
    ("p_name || '!'", "UNKNOWN", "p_name", "''"),
)
_CASE = lambda part: f"CASE p_partkey % {len(ASKED)} {' '.join(f'WHEN {k} THEN {part(a)}' for k, a in enumerate(ASKED))} END"
PARSED_SQL = f"""SELECT p_partkey AS question_id, {_CASE(lambda a: f"'{a[1]}'")} AS intent, lower({_CASE(lambda a: a[2])}) AS k1, lower({_CASE(lambda a: a[3])}) AS k2 FROM part"""


def parse_questions(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.expr(_CASE(lambda a: a[0])).alias("question"))
    return Q.parse_questions(p, short_forms=True).drop("question")


def generate_qa(spark, sf_dir):
    raw = load(spark, sf_dir, "edges_raw").where("relation_type = 'CHU_TRI_BENH'")
    usage = raw.select("from_id", "to_id", F.concat(F.lit("$"), "dosage", F.lit("$")).alias("dosage"), F.when(F.col("pos") == 1, F.col("description")).alias("how"))
    return Q.generate_qa(load(spark, sf_dir, "nodes"), load(spark, sf_dir, "edges"), usage, 40, ("QUY_KINH",))


def answer_questions(spark, sf_dir):
    nodes, edges = load(spark, sf_dir, "nodes"), load(spark, sf_dir, "edges")
    return Q.answer_questions(parse_questions(spark, sf_dir), nodes, edges)


def grounded_answers(spark, sf_dir):
    hits = load(spark, sf_dir, "edges_raw").select(F.col("doc_id").alias("question_id"), F.col("from_id").alias("subject"), F.col("to_id").alias("object"))
    o = load(spark, sf_dir, "orders")
    answers = o.select(F.col("o_orderkey").alias("question_id"), F.when(F.col("o_orderstatus") == "F", "No record of it.").otherwise(F.concat(F.lit("Take bt_"), (F.col("o_custkey") % 100).cast("string"), F.lit(" twice."))).alias("answer"))
    return Q.grounded_answers(answers, hits)


def _with_up(sql: str) -> str:
    """up(x): x with a large first letter."""
    return re.sub(r"\bup\((\w+)\)", r"(upper(left(\1, 1)) || substr(\1, 2))", sql)


def _answers() -> str:
    """Every intent's lookup over the parsed questions, by the SQL of the single lookups."""
    order = "subject, relation, object, from_id, to_id"
    of = lambda intent: f"JOIN asked q ON q.question_id = h.question_id AND q.intent = '{intent}'"
    hop = lambda intent, kind: _first(f"SELECT DISTINCT h.question_id, h.name AS subject, relation_type AS relation, t.name AS object, e.from_id, e.to_id FROM {_FROM} {of(intent)} WHERE relation_type = '{kind}'", order)
    parts = [hop(v[1], kind) for kind, v in Q.ATTRIBUTES.items()]
    parts.append(_first(f"""SELECT DISTINCT h.question_id, h.name AS subject, r.name AS relation, t.name AS object, h.id AS herb_id, r.id AS remedy_id, t.id AS target_id FROM kw1_hits h {of("TIM_CONG_DUNG_BAI_THUOC_TU_VI_THUOC")}
      JOIN edges c ON c.to_id = h.id AND c.relation_type = 'BAO_GOM_VI_THUOC' JOIN edges d ON d.from_id = c.from_id AND d.relation_type IN ('CHU_TRI_BENH', 'CHU_TRI_TRIEU_CHUNG')
      JOIN nodes r ON r.id = c.from_id JOIN nodes t ON t.id = d.to_id WHERE h.label = 'ViThuoc'""", "subject, relation, object, herb_id, remedy_id, target_id"))
    parts.append(_first(f"SELECT DISTINCT h.question_id, CASE WHEN f.label = 'ViThuoc' THEN 1 ELSE 2 END AS rank, f.name AS subject, relation_type AS relation, h.name AS object, e.from_id, e.to_id FROM {_TO} {of('TIM_THUOC_CHUA_BENH')} WHERE h.label IN ('Benh', 'TrieuChung') AND relation_type IN ('CHU_TRI_BENH', 'CHU_TRI_TRIEU_CHUNG', 'CO_CONG_NANG', 'CO_TAC_DUNG_DUOC_LY')", f"rank, {order}"))
    parts.append(_first(f"""SELECT DISTINCT h.question_id, n.name AS subject, '-' AS relation, n.id AS object FROM kw1_hits h {of("TIM_DA_QUAN_HE")} JOIN edges x ON x.to_id = h.id JOIN edges y ON y.from_id = x.from_id
      JOIN kw2_hits b ON b.id = y.to_id AND b.question_id = h.question_id JOIN nodes n ON n.id = x.from_id WHERE n.label = 'ViThuoc'""", "subject, object"))
    parts.append(_first(f"""SELECT DISTINCT h.question_id, h.name AS subject, e.relation_type AS relation, b.name AS object, h.id AS a_id, b.id AS b_id FROM kw1_hits h {of("TIM_HUONG_DAN_SU_DUNG")}
      JOIN (SELECT from_id AS x, to_id AS y, relation_type FROM edges UNION SELECT to_id, from_id, relation_type FROM edges) e ON e.x = h.id JOIN kw2_hits b ON b.id = e.y AND h.question_id = b.question_id
      WHERE relation_type IN ('CHU_TRI_BENH', 'CHU_TRI_TRIEU_CHUNG', 'CO_CONG_NANG', 'CO_TAC_DUNG_DUOC_LY')""", "subject, relation, object, a_id, b_id"))
    parts.append(_first(f"""SELECT DISTINCT h.question_id, h.name AS subject, coalesce(e.relation_type, '-') AS relation, coalesce(e.to_name, '-') AS object, h.id AS from_id, coalesce(e.to_id, '-') AS to_id
      FROM kw1_hits h {of("UNKNOWN")} LEFT JOIN (SELECT e.*, n.name AS to_name FROM edges e JOIN nodes n ON n.id = e.to_id) e ON e.from_id = h.id""", order))
    kinds = ", ".join(f"'{r}'" for r in (*Q.ATTRIBUTES, "CHU_TRI_BENH", "CHU_TRI_TRIEU_CHUNG", "BAO_GOM_VI_THUOC"))
    parts.append(f"""SELECT question_id, '-' AS subject, '-' AS relation, CASE WHEN question_id IN (SELECT a.question_id FROM kw1_hits a JOIN edges e ON e.from_id = a.id JOIN kw2_hits b ON b.id = e.to_id AND a.question_id = b.question_id
      WHERE relation_type IN ({kinds})) THEN 'true' ELSE 'false' END AS object FROM asked WHERE intent = 'KIEM_TRA_BOOLEAN'""")
    asked = f"asked AS (SELECT question_id, intent, nullif(k1, '') AS kw1, nullif(k2, '') AS kw2 FROM ({PARSED_SQL}))"
    found = [_hit(kw).replace("FROM questions q", "FROM asked q") for kw in ("kw1", "kw2")]
    every = " UNION ALL ".join(f"SELECT question_id, subject, relation, object FROM ({p})" for p in parts)
    return oracle(("nodes", "edges"), f"WITH {asked}, {', '.join(found)} SELECT DISTINCT a.question_id, q.intent, subject, relation, object FROM ({every}) a JOIN asked q USING (question_id)")


#: told: what becomes of requests for deletion and confirmations; the watermark is the last event less an hour.
DELETIONS_SQL = """WITH e AS (SELECT event_id AS id, user_id, ts, event_type = 'error' AS is_request, event_id % 3 AS token, row_number() OVER w AS n, count(*) FILTER (WHERE event_type = 'error') OVER w AS part, max(ts) OVER () AS newest, max(ts) OVER (PARTITION BY user_id) AS latest
        FROM events WHERE event_type IN ('error', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, first_value(ts) OVER p AS asked, first_value(token) OVER p AS wanted FROM e WINDOW p AS (PARTITION BY user_id, part ORDER BY n)),
      f AS (SELECT *, min(n) FILTER (WHERE NOT is_request AND part > 0 AND token = wanted AND epoch_us(ts) - epoch_us(asked) < 86400000000) OVER (PARTITION BY user_id, part) AS ok FROM s),
      r AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY n) AS nxt FROM f WHERE is_request),
      told AS (SELECT id, user_id, CASE WHEN n = ok THEN 'approved' ELSE 'failed' END AS outcome, ts AS told_at FROM f WHERE NOT is_request
        UNION ALL SELECT id, user_id, 'superseded', nxt FROM r WHERE ok IS NULL AND epoch_us(nxt) - epoch_us(ts) < 86400000000
        UNION ALL SELECT id, user_id, 'expired', ts + INTERVAL 24 HOUR FROM r WHERE ok IS NULL AND (nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 86400000000)
          AND (epoch_us(latest) - epoch_us(ts) >= 86400000000 OR epoch_ms(ts) + 86400000 < epoch_ms(newest) - 3600000))"""

ORACLE = {
    "stream_payments": LEDGER_ORACLE["match_bank_transactions"],
    "stream_ledger": LEDGER_ORACLE["apply_ledger"],
    # A session's row of its end: by a later event of the user, or by the watermark (the last event less ten minutes).
    "stream_login_sessions": """WITH e AS (SELECT event_id AS id, user_id, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'complete' ELSE 'read' END AS kind, row_number() OVER w AS n, count(*) FILTER (WHERE event_type = 'signup') OVER w AS part, max(ts) OVER () AS newest, max(ts) OVER (PARTITION BY user_id) AS latest
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, first_value(ts) OVER (PARTITION BY user_id, part ORDER BY n) AS opened FROM e),
      f AS (SELECT *, epoch_us(ts) - epoch_us(opened) > 600000000 AS old FROM s),
      g AS (SELECT *, min(n) FILTER (WHERE kind = 'complete' AND NOT old) OVER (PARTITION BY user_id, part) AS done FROM f),
      h AS (SELECT *, min(n) FILTER (WHERE kind = 'read' AND n > done AND NOT old) OVER (PARTITION BY user_id, part) AS used FROM g),
      o AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY n) AS nxt FROM h WHERE kind = 'create')
      SELECT id, user_id, CASE WHEN part = 0 THEN 'none' WHEN kind = 'create' THEN 'created' WHEN n > coalesce(used, n) OR old THEN 'none' WHEN n = used THEN 'consumed' WHEN kind = 'complete' THEN 'completed' ELSE 'pending' END AS outcome, ts AS told_at FROM h
      UNION ALL SELECT id, user_id, 'expired', opened + INTERVAL 600 SECOND FROM o
      WHERE used IS NULL AND (nxt IS NULL OR epoch_us(nxt) - epoch_us(opened) > 600000000) AND (epoch_us(latest) - epoch_us(opened) > 600000000 OR epoch_ms(opened) + 600000 < epoch_ms(newest) - 600000)""",
    "stream_daily_queries": "SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1",
    "stream_query_cache": "SELECT DISTINCT props AS question FROM events",
    "stream_deletions": f"{DELETIONS_SQL} SELECT id, user_id, outcome, told_at FROM told",
    "stream_cascade_delete": oracle(("users", "payments"), f"""{DELETIONS_SQL}, gone AS (SELECT user_id AS uid FROM told WHERE outcome = 'approved')
      SELECT 'users' AS name, count(*) AS n, sum(id)::BIGINT AS ids FROM users WHERE id NOT IN (SELECT uid FROM gone)
      UNION ALL SELECT 'payments', count(*), sum(id)::BIGINT FROM payments WHERE user_id NOT IN (SELECT uid FROM gone)"""),
    "write_graph": oracle(("nodes", "edges", "nodes_gappy", "edges_raw"), """WITH g AS (SELECT id, max(upper(name)) AS name, count(*) AS seen FROM nodes_gappy GROUP BY 1),
      n1 AS (SELECT DISTINCT * FROM nodes),
      n2 AS (SELECT coalesce(n1.id, g.id) AS id, label, coalesce(g.name, n1.name) AS name, alias, seen FROM n1 FULL JOIN g ON g.id = n1.id),
      e1 AS (SELECT DISTINCT * FROM edges WHERE from_id IN (SELECT id FROM n1) AND to_id IN (SELECT id FROM n1)),
      e2 AS (SELECT from_id, relation_type, to_id, min(description) AS description FROM edges_raw WHERE from_id IN (SELECT id FROM n2) AND to_id IN (SELECT id FROM n2) GROUP BY 1, 2, 3),
      e AS (SELECT from_id, relation_type, to_id, description FROM e1 FULL JOIN e2 USING (from_id, relation_type, to_id))
      SELECT id, label, name, alias, seen, NULL AS description FROM n2 UNION ALL SELECT from_id || '|' || relation_type || '|' || to_id, NULL, NULL, NULL, NULL, description FROM e"""),
    "read_documents": oracle(("edges_raw",), """SELECT 'BT_' || s_suppkey AS id, s_name AS name, coalesce(n, 0)::INT AS n, CASE WHEN s_nationkey = 5 THEN 'no answer' END AS error
      FROM supplier LEFT JOIN (SELECT from_id, count(*) AS n FROM (SELECT DISTINCT from_id, to_id, relation_type, source_id, confidence FROM edges_raw) GROUP BY 1) e ON e.from_id = 'BT_' || s_suppkey WHERE s_nationkey <> 3"""),
    "corrupt_record_stats": "SELECT count(*) AS files, count(*) FILTER (WHERE s_nationkey NOT IN (3, 5)) AS good, count(*) FILTER (WHERE s_nationkey IN (3, 5)) AS damaged, round(100 * count(*) FILTER (WHERE s_nationkey IN (3, 5)) / count(*), 2) AS damaged_percent FROM supplier",
    "compact_documents": oracle(("edges_raw",), """WITH e AS (SELECT DISTINCT from_id, to_id, relation_type, source_id, confidence FROM edges_raw JOIN supplier ON from_id = 'BT_' || s_suppkey WHERE s_nationkey <> 3),
      p AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id, relation_type, source_id, confidence NULLS FIRST) - 1 AS pos FROM e)
      SELECT from_id, relation_type, count(*) AS n, max(pos)::INT AS last FROM p GROUP BY 1, 2"""),
    "read_page_text": "SELECT p_size AS page, md5(array_to_string(list_sort(list(p_name)), chr(10))) AS digest FROM part GROUP BY 1",
    "append_report": "SELECT o_orderkey AS doc_id, o_orderstatus AS status, round(o_totalprice, 2) AS score FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "write_csv_report": "SELECT doc_id, lang, length(text)::INT AS n FROM documents",
    "read_relational": oracle(("users", "payments"), "SELECT role, status, count(*) AS n, round(sum(amount_vnd), 2) AS total FROM payments p JOIN users u ON u.id = p.user_id GROUP BY 1, 2"),
    "repair_json": "SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "toc_by_page": """SELECT p_size AS page, count(*)::INT AS n, string_agg(p_name || '/' || (CASE WHEN p_brand = 'Brand#1' THEN p_type ELSE 'VI_THUOC' END), ';' ORDER BY p_name, CASE WHEN p_brand = 'Brand#1' THEN p_type ELSE 'VI_THUOC' END) AS candidates FROM part GROUP BY 1""",
    "flatten_text": """WITH c AS (SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'system') AS s, min_by(text, turn) FILTER (WHERE role = 'user') AS u FROM conversations GROUP BY 1)
      SELECT conv_id, md5(concat_ws(chr(10) || chr(10), '[SYSTEM]' || chr(10) || nullif(s, ''), '[USER]' || chr(10) || nullif(u, ''))) AS digest FROM c""",
    "vector_topk": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, (1 + list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) / 2 AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p WHERE score >= 0.5) SELECT query_id, vec_id, round(score, 6) AS score, place FROM r WHERE place <= 30""",
    "parse_questions": PARSED_SQL,
    "answer_questions": _answers(),
    "generate_qa": _with_up(oracle(("nodes", "edges", "edges_raw"), """WITH h(x) AS (SELECT 'Dữ liệu dược điển:' || chr(10)), lab AS (SELECT * FROM (VALUES ('CO_VI', 'Vị', 'TIM_VI', 'Vị thuốc X có vị gì?', 'Cho tôi biết vị của X.'), ('CO_TINH', 'Tính', 'TIM_TINH', 'Vị thuốc X có tính gì?', 'Tính chất của X là gì?'), ('QUY_KINH', 'Quy kinh', 'TIM_QUY_KINH', 'Vị thuốc X quy vào kinh nào?', 'Kinh mạch nào liên quan đến X?'), ('CO_CHUA_HOAT_CHAT', 'Hoạt chất', 'TIM_HOAT_CHAT_CUA_THUOC', 'Vị thuốc X chứa hoạt chất gì?', 'Thành phần hóa học của X gồm những gì?')) AS l(relation_type, label, intent, t1, t2)),
      n AS (SELECT e.from_id, e.to_id, e.relation_type, f.name AS fn, t.name AS tn, f.label AS fl FROM edges e JOIN nodes f ON f.id = e.from_id JOIN nodes t ON t.id = e.to_id),
      s1 AS (SELECT from_id, fn, relation_type, list_sort(list(DISTINCT tn))[1:5] AS facts FROM n JOIN lab USING (relation_type) WHERE fl = 'ViThuoc' GROUP BY 1, 2, 3),
      s2 AS (SELECT h.id, h.name, list_sort(list(DISTINCT d.tn))[1:5] AS facts FROM edges c JOIN n d ON d.from_id = c.from_id AND d.fl = 'BaiThuoc' JOIN nodes h ON h.id = c.to_id AND h.label = 'ViThuoc' WHERE c.relation_type = 'BAO_GOM_VI_THUOC' AND d.relation_type = 'CHU_TRI_BENH' GROUP BY 1, 2),
      s3 AS (SELECT DISTINCT from_id, to_id, relation_type, fn, tn, label FROM n JOIN lab USING (relation_type) WHERE fl = 'ViThuoc'),
      comp AS (SELECT id, name, slot, row_number() OVER (PARTITION BY slot ORDER BY id) - 1 AS number, count(*) OVER (PARTITION BY slot) AS size FROM (SELECT id, name, ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT % 64 AS slot FROM nodes WHERE label = 'HoatChat')),
      hk AS (SELECT id, name, md5('42:' || id || ':' || k) AS d FROM (SELECT id, name, unnest([1, 2, 3]) AS k FROM nodes WHERE label = 'ViThuoc')),
      s4 AS (SELECT DISTINCT hk.id AS from_id, c.id AS to_id, hk.name AS fn, c.name AS tn FROM hk JOIN comp c ON c.slot = ('0x' || d[1:8])::BIGINT % 64 AND c.number = ('0x' || d[9:16])::BIGINT % c.size WHERE (hk.id, c.id) NOT IN (SELECT (from_id, to_id) FROM edges WHERE relation_type = 'CO_CHUA_HOAT_CHAT')),
      s5 AS (SELECT a.to_id AS a_id, a.tn AS a, b.to_id AS b_id, b.tn AS b, list_sort(list(DISTINCT a.fn))[1:5] AS facts FROM n a JOIN n b ON a.from_id = b.from_id WHERE a.fl = 'ViThuoc' AND a.relation_type = 'CO_TINH' AND b.relation_type = 'QUY_KINH' GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT a.fn) > 1),
      s6 AS (SELECT r.from_id, r.to_id, f.name AS fn, t.name AS tn, min(dosage) AS dosage, min(CASE WHEN pos = 1 THEN description END) AS how FROM edges_raw r JOIN nodes f ON f.id = r.from_id JOIN nodes t ON t.id = r.to_id WHERE relation_type = 'CHU_TRI_BENH' GROUP BY 1, 2, 3, 4),
      s7 AS (SELECT to_id, tn, list_sort(list(DISTINCT fn))[1:5] AS facts FROM n WHERE relation_type = 'CHU_TRI_BENH' GROUP BY 1, 2),
      q AS (SELECT 'single_relation' AS pattern, intent, from_id || ':' || relation_type AS key, t1 AS q1, t2 AS q2, fn AS name, x || 'Vị thuốc: ' || up(fn) || chr(10) || '- ' || label || ': ' || ups(facts) AS context, facts, ups(facts) AS answer FROM s1 JOIN lab USING (relation_type), h
        UNION ALL SELECT 'multi_hop', 'TIM_CONG_DUNG_BAI_THUOC_TU_VI_THUOC', id, 'Vị thuốc X tham gia vào bài thuốc để chữa những bệnh gì?', 'Bệnh nào có thể chữa bằng bài thuốc chứa X?', name, x || 'Vị thuốc: ' || up(name) || chr(10) || '- Tham gia bài thuốc chữa các bệnh: ' || ups(facts), facts, ups(facts) FROM s2, h
        UNION ALL SELECT 'reverse_search_positive', 'KIEM_TRA_BOOLEAN', from_id || '+' || relation_type || '+' || to_id, 'Vị thuốc X có ' || lower(label) || ' ' || tn || ' không?', NULL, fn, x || 'Vị thuốc: ' || up(fn) || chr(10) || '- ' || label || ': ' || up(tn), ['Có'], 'Có, vị thuốc ' || fn || ' có ' || lower(label) || ' ' || tn FROM s3, h
        UNION ALL SELECT 'reverse_search_negative', 'KIEM_TRA_BOOLEAN', from_id || '-' || to_id, 'Vị thuốc X có chứa hoạt chất ' || tn || ' không?', NULL, fn, x || 'Vị thuốc: ' || up(fn) || chr(10) || '- Ghi chú hoạt chất: Không chứa ' || tn, ['Không'], 'Không, vị thuốc ' || fn || ' không chứa hoạt chất ' || tn FROM s4, h
        UNION ALL SELECT 'multi_relation', 'TIM_DA_QUAN_HE', a_id || '+' || b_id, 'Thuốc nào vừa có tính ' || a || ' vừa trực tiếp chữa bệnh ' || b || '?', NULL, '', x || 'Bộ lọc tìm kiếm: Tính ' || a || ' và trực tiếp chữa ' || b || chr(10) || '- Các vị thuốc thỏa mãn: ' || ups(facts), facts, ups(facts) FROM s5, h
        UNION ALL SELECT 'how_to_usage', 'TIM_HUONG_DAN_SU_DUNG', from_id || '+' || to_id, 'Để chữa bệnh ' || tn || ', vị thuốc X được dùng với liều lượng và cách thức như thế nào?', NULL, fn, x || 'Điều trị bệnh: ' || up(tn) || chr(10) || '- Sử dụng ' || up(fn) || ': ' || concat_ws(', ', 'Liều dùng: ' || dosage, 'Cách dùng: ' || how), list_filter([dosage, how], lambda v: v IS NOT NULL), 'Để chữa bệnh ' || tn || ', vị thuốc ' || fn || ' có liều dùng: ' || coalesce(dosage, 'Theo chỉ định') || ' và cách dùng: ' || coalesce(how, 'Theo chỉ định') FROM s6, h WHERE dosage IS NOT NULL OR how IS NOT NULL
        UNION ALL SELECT 'treatment_search', 'TIM_THUOC_CHUA_BENH', to_id, 'Bệnh X có thể dùng vị thuốc hoặc bài thuốc nào để chữa?', NULL, tn, x || 'Bệnh/Triệu chứng: ' || up(tn) || chr(10) || '- Các thuốc chữa trị: ' || ups(facts), facts, ups(facts) FROM s7, h),
      r AS (SELECT *, md5('42:' || pattern || ':' || key) AS d42, row_number() OVER (PARTITION BY pattern ORDER BY d42, key) AS place, ('0x' || md5(pattern || ':' || key)[1:6])::BIGINT % 100 AS d FROM q)
      SELECT pattern, intent, CASE WHEN intent = 'KIEM_TRA_BOOLEAN' THEN 'BOOLEAN' WHEN intent = 'TIM_DA_QUAN_HE' THEN 'MULTI_CONSTRAINT' WHEN intent = 'TIM_HUONG_DAN_SU_DUNG' THEN 'HOW_TO' WHEN pattern IN ('multi_hop', 'treatment_search') THEN 'REASONING' ELSE 'ATTRIBUTE' END AS intent_group, key,
        replace(CASE WHEN q2 IS NOT NULL AND ('0x' || d42[32:32])::BIGINT % 2 = 1 THEN q2 ELSE q1 END, 'X', name) AS question, context, CASE WHEN pattern IN ('how_to_usage', 'reverse_search_positive', 'reverse_search_negative') THEN facts ELSE list_transform(facts, lambda v: up(v)) END AS facts, answer, CASE WHEN d < 50 THEN 'easy' WHEN d < 80 THEN 'medium' ELSE 'hard' END AS difficulty FROM r WHERE place <= CASE WHEN pattern LIKE 'reverse%' THEN 20 ELSE 40 END""").replace("ups(facts)", "array_to_string(list_transform(facts, lambda v: up(v)), ', ')")),
    "grounded_answers": oracle(("edges_raw",), """WITH a AS (SELECT o_orderkey AS question_id, CASE WHEN o_orderstatus = 'F' THEN 'no record of it.' ELSE 'take bt_' || (o_custkey % 100) || ' twice.' END AS t FROM orders)
      SELECT question_id, contains(t, 'no record') OR NOT EXISTS (SELECT 1 FROM edges_raw h WHERE h.doc_id = question_id) OR EXISTS (SELECT 1 FROM edges_raw h WHERE h.doc_id = question_id AND (contains(t, lower(h.from_id)) OR contains(t, lower(h.to_id)))) AS grounded FROM a"""),
}
QUERIES = {
    f.__name__: f
    for f in (stream_payments, stream_ledger, stream_login_sessions, stream_daily_queries, stream_query_cache, stream_deletions, stream_cascade_delete, write_graph, read_documents, corrupt_record_stats, compact_documents, read_page_text, append_report, write_csv_report, read_relational, repair_json, toc_by_page, flatten_text, vector_topk, parse_questions, generate_qa, answer_questions, grounded_answers)
}
