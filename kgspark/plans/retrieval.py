"""Registered retrieval queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import retrieve as R

from .tables import load, oracle

_MATCH = """
  q.{kw} = ''
   OR (position(' ' IN q.{kw}) > 0 AND (position(q.{kw} IN n.name) > 0 OR position(upper(replace(strip_accents(q.{kw}), ' ', '_')) IN upper(n.id)) > 0))
   OR (position(' ' IN q.{kw}) = 0 AND (upper(n.id) = upper(strip_accents(q.{kw})) OR position(' ' || q.{kw} || ' ' IN ' ' || n.name || ' ') > 0))
   OR (n.label IN ('Benh', 'TrieuChung') AND position(q.{kw} IN n.alias) > 0)"""


def _hit(kw: str) -> str:
    return f"{kw}_hits AS (SELECT q.question_id, n.id, n.name, n.label FROM questions q JOIN nodes n ON {_MATCH.format(kw=kw)})"


def _first(inner: str, order: str, limit: int = R.LIMIT) -> str:
    return f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {order}) AS place FROM ({inner})) WHERE place <= {limit}"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "nodes"), load(spark, sf_dir, "edges")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "questions")


def match_entity(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return R.match_entities(nodes, _questions(spark, sf_dir).select(F.col("question_id").alias("key"), F.col("kw1").alias("keyword")))


def hop_forward(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.hop(nodes, edges, _questions(spark, sf_dir), ("CO_TINH", "CO_VI", "QUY_KINH"))


def hop_backward(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.hop(nodes, edges, _questions(spark, sf_dir), ("BAO_GOM_VI_THUOC",), "backward", "BaiThuoc")


def two_hop_remedy(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.two_hop_remedy(nodes, edges, _questions(spark, sf_dir))


def check_relation(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.check_relation(nodes, edges, _questions(spark, sf_dir), ("CO_CHUA_HOAT_CHAT", "CHU_TRI_BENH", "CO_TINH"))


def treatments_of(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.treatments_of(nodes, edges, _questions(spark, sf_dir))


def herbs_by_attribute(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.herbs_by_attribute(nodes, edges, _questions(spark, sf_dir))


def intersect_relations(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    q = _questions(spark, sf_dir).withColumn("kw1", F.substring_index("kw1", " ", 1))
    return R.intersect_relations(nodes, edges, q)


def usage_lookup(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.usage_lookup(nodes, edges, _questions(spark, sf_dir))


def entity_overview(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.entity_overview(nodes, edges, _questions(spark, sf_dir))


def neighbourhood(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.neighbourhood(nodes, edges, _questions(spark, sf_dir))


def display_nodes(spark, sf_dir):
    return R.display_nodes(neighbourhood(spark, sf_dir))


def negative_pairs(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    herbs = nodes.where("label = 'ViThuoc'").select(F.col("id").alias("herb_id"))
    return R.negative_pairs(herbs, nodes.where("label = 'HoatChat'").select(F.col("id").alias("compound_id")), edges)


def endpoint_ids(spark, sf_dir):
    return R.endpoint_ids(load(spark, sf_dir, "edges"), load(spark, sf_dir, "nodes_gappy"))


def remedies_without_ingredients(spark, sf_dir):
    # A supplier's orders are dealt out to many remedies with a few edges each.
    fine = F.concat("from_id", F.lit("_"), (F.col("doc_id") % 400).cast("string"))
    return R.remedies_without_ingredients(load(spark, sf_dir, "edges_raw").withColumn("from_id", fine))


def constraint_intersection(spark, sf_dir):
    kind, to = F.col("relation_type"), F.col("to_id")
    return R.constraint_intersection(load(spark, sf_dir, "edges"), (kind == "CO_TINH") & (to == "T_ECONOMY"), (kind == "QUY_KINH") & (to == "K_3"))


def facts_per_entity(spark, sf_dir):
    return R.facts_per_entity(load(spark, sf_dir, "nodes"), load(spark, sf_dir, "edges_repeated"), "BaiThuoc")


def multi_constraint_groups(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return R.multi_constraint_groups(nodes, edges, "CO_TINH", "QUY_KINH")


def treatment_groups(spark, sf_dir):
    return R.treatment_groups(load(spark, sf_dir, "edges"))


def sample_per_pattern(spark, sf_dir):
    return R.sample_per_pattern(load(spark, sf_dir, "nodes").select("id", "label"), "label", "id", 40)


def _hits(spark, sf_dir) -> DataFrame:
    """Hits with a score: each edge of a herb with its remedy's number as a score of 0 to 0.99, every tenth exact."""
    edges = load(spark, sf_dir, "edges_raw")
    return edges.select(
        F.col("doc_id").alias("question_id"),
        F.struct("pos", "from_id", "to_id", "price", "seen_at", "relation_type", "source_id", "description").alias("order"),
        F.col("relation_type").alias("relation"),
        F.lower("from_id").alias("kw1"),
        F.lit("").alias("kw2"),
        F.col("from_id").alias("subject"),
        F.col("to_id").alias("object"),
        F.when(F.col("pos") == 1, 2.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("score"),
        F.when(F.col("pos") % 2 == 0, "treat").otherwise("list").alias("intent"),
    )


def filter_by_intent(spark, sf_dir):
    kinds = load(spark, sf_dir, "edges_raw").select("relation_type").distinct()
    allowed = kinds.where("relation_type <> 'CO_CONG_NANG'").select(F.lit("treat").alias("intent"), F.col("relation_type").alias("relation"))
    allowed = allowed.union(kinds.where("relation_type = 'BAO_GOM_VI_THUOC'").select(F.lit("list"), "relation_type"))
    return R.filter_by_intent(_hits(spark, sf_dir), allowed).groupBy("intent", "relation").agg(F.count("*").alias("n"), F.sum("question_id").alias("questions"))


def rank_hits(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("kw1", F.when(F.col("order.pos") % 3 == 0, F.substring("kw1", 1, 4)).when(F.col("order.pos") % 3 == 1, F.col("kw1")).otherwise(F.lit("")))
    return R.rank_hits(hits.withColumnRenamed("order", "position")).select("question_id", "place", "subject", "object", "bucket", F.round("weight", 4).alias("weight"))


def hybrid_union(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    exact = hits.where("relation = 'CHU_TRI_BENH'")
    return R.hybrid_union(exact, hits.where("relation <> 'CO_CONG_NANG'"), ["subject", "relation", "object"]).withColumn("score", F.round("score", 4))


_FROM = "kw1_hits h JOIN edges e ON e.from_id = h.id JOIN nodes t ON t.id = e.to_id"
_TO = "kw1_hits h JOIN edges e ON e.to_id = h.id JOIN nodes f ON f.id = e.from_id"
_HITS = """hits AS (SELECT doc_id AS question_id, pos, relation_type AS relation, from_id AS subject, to_id AS object,
  CASE WHEN pos = 1 THEN 2.0 ELSE coalesce(confidence, 0.0) END AS score, CASE WHEN pos % 2 = 0 THEN 'treat' ELSE 'list' END AS intent,
  price, seen_at, source_id, description FROM edges_raw)"""


def _q(sql: str, both: bool = False) -> str:
    parts = [_hit("kw1"), _hit("kw2")] if both else [_hit("kw1")]
    return oracle(("nodes", "edges", "questions"), f"WITH asked AS (SELECT * FROM questions), {', '.join(parts)} {sql}")


ORACLE = {
    "match_entity": _q("SELECT DISTINCT question_id AS key, id, label, name FROM kw1_hits"),
    "hop_forward": _q(_first(f"SELECT DISTINCT question_id, h.name AS subject, relation_type AS relation, t.name AS object, e.from_id, e.to_id FROM {_FROM} WHERE relation_type IN ('CO_TINH', 'CO_VI', 'QUY_KINH')", "subject, relation, object, from_id, to_id")),
    "hop_backward": _q(_first(f"SELECT DISTINCT question_id, f.name AS subject, relation_type AS relation, h.name AS object, e.from_id, e.to_id FROM {_TO} WHERE relation_type = 'BAO_GOM_VI_THUOC' AND f.label = 'BaiThuoc'", "subject, relation, object, from_id, to_id")),
    "two_hop_remedy": _q(_first("""SELECT DISTINCT question_id, h.name AS subject, r.name AS remedy, t.name AS object, h.id AS herb_id, r.id AS remedy_id, t.id AS target_id
      FROM kw1_hits h JOIN edges c ON c.to_id = h.id AND c.relation_type = 'BAO_GOM_VI_THUOC'
      JOIN edges d ON d.from_id = c.from_id AND d.relation_type IN ('CHU_TRI_BENH', 'CHU_TRI_TRIEU_CHUNG')
      JOIN nodes r ON r.id = c.from_id JOIN nodes t ON t.id = d.to_id WHERE h.label = 'ViThuoc'""", "subject, remedy, object, herb_id, remedy_id, target_id")),
    "check_relation": _q("""SELECT question_id, question_id IN (SELECT a.question_id FROM kw1_hits a JOIN edges e ON e.from_id = a.id JOIN kw2_hits b ON b.id = e.to_id AND a.question_id = b.question_id
      WHERE relation_type IN ('CO_CHUA_HOAT_CHAT', 'CHU_TRI_BENH', 'CO_TINH')) AS found FROM asked""", both=True),
    "treatments_of": _q(_first(f"SELECT DISTINCT question_id, CASE WHEN f.label = 'BaiThuoc' THEN 1 ELSE 2 END AS rank, f.name AS subject, relation_type AS relation, h.name AS object, e.from_id, e.to_id FROM {_TO} WHERE h.label IN ('Benh', 'TrieuChung') AND relation_type IN ('CHU_TRI_BENH', 'CHU_TRI_TRIEU_CHUNG', 'CO_CONG_NANG', 'CO_TAC_DUNG_DUOC_LY')", "rank, subject, relation, object, from_id, to_id")),
    "herbs_by_attribute": _q(_first("SELECT DISTINCT question_id, f.name AS subject, relation_type AS relation, h.name AS object, e.from_id, e.to_id FROM kw2_hits h JOIN edges e ON e.to_id = h.id JOIN nodes f ON f.id = e.from_id WHERE relation_type IN ('CO_TINH', 'CO_VI', 'QUY_KINH')", "subject, relation, object, from_id, to_id"), True),
    "intersect_relations": oracle(("nodes", "edges", "questions"), f"""WITH asked AS (SELECT question_id, kind, split_part(kw1, ' ', 1) AS kw1, kw2 FROM questions), {_hit('kw1').replace('FROM questions q', 'FROM asked q')}, {_hit('kw2').replace('FROM questions q', 'FROM asked q')}
      {_first("SELECT DISTINCT a.question_id, n.name AS subject, n.id AS from_id FROM kw1_hits a JOIN edges x ON x.to_id = a.id JOIN edges y ON y.from_id = x.from_id JOIN kw2_hits b ON b.id = y.to_id AND b.question_id = a.question_id JOIN nodes n ON n.id = x.from_id WHERE n.label = 'ViThuoc'", 'subject, from_id')}"""),
    "usage_lookup": _q(_first("""SELECT DISTINCT a.question_id, a.name AS subject, e.relation_type AS relation, b.name AS object, a.id AS a_id, b.id AS b_id
      FROM kw1_hits a JOIN (SELECT from_id AS x, to_id AS y, relation_type FROM edges UNION SELECT to_id, from_id, relation_type FROM edges) e ON e.x = a.id JOIN kw2_hits b ON b.id = e.y AND a.question_id = b.question_id
      WHERE relation_type IN ('CHU_TRI_BENH', 'CHU_TRI_TRIEU_CHUNG', 'CO_CONG_NANG', 'CO_TAC_DUNG_DUOC_LY')""", "subject, relation, object, a_id, b_id"), True),
    "entity_overview": _q(_first("""SELECT DISTINCT question_id, h.name AS subject, coalesce(e.relation_type, '-') AS relation, coalesce(e.to_name, '-') AS object, h.id AS from_id, coalesce(e.to_id, '-') AS to_id
      FROM kw1_hits h LEFT JOIN (SELECT e.*, n.name AS to_name FROM edges e JOIN nodes n ON n.id = e.to_id) e ON e.from_id = h.id""", "subject, relation, object, from_id, to_id")),
}
_NEAR = _first("""SELECT DISTINCT q.question_id, a.name AS source, b.name AS target, e.relation_type AS relation, a.id AS a_id, b.id AS b_id
      FROM asked q JOIN kw1_hits a ON a.question_id = q.question_id AND position(q.kw1 IN a.name) > 0
      JOIN (SELECT from_id AS x, to_id AS y, relation_type FROM edges UNION ALL SELECT to_id, from_id, relation_type FROM edges) e ON e.x = a.id JOIN nodes b ON b.id = e.y""", "source, target, relation, a_id, b_id", 40)
ORACLE |= {
    "neighbourhood": _q(_NEAR),
    "display_nodes": _q(f"""SELECT question_id, id, name, min(grp) AS grp FROM (SELECT question_id, a_id AS id, source AS name, 1 AS grp FROM ({_NEAR}) UNION ALL SELECT question_id, b_id, target, 2 FROM ({_NEAR})) GROUP BY 1, 2, 3"""),
    "negative_pairs": oracle(("nodes", "edges"), """WITH s AS (SELECT id, ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT % 64 AS slot FROM nodes WHERE label = 'HoatChat'),
      c AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY id) - 1 AS number, count(*) OVER (PARTITION BY slot) AS size FROM s),
      h AS (SELECT id, md5('42:' || id || ':' || k) AS d FROM (SELECT id, unnest([1, 2, 3]) AS k FROM nodes WHERE label = 'ViThuoc')),
      d AS (SELECT DISTINCT h.id AS herb_id, c.id AS compound_id FROM h JOIN c ON c.slot = ('0x' || d[1:8])::BIGINT % 64 AND c.number = ('0x' || d[9:16])::BIGINT % c.size)
      SELECT * FROM d WHERE (herb_id, compound_id) NOT IN (SELECT (from_id, to_id) FROM edges WHERE relation_type = 'CO_CHUA_HOAT_CHAT')"""),
    "endpoint_ids": oracle(("edges", "nodes_gappy"), "SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges UNION SELECT id FROM nodes_gappy"),
    "remedies_without_ingredients": oracle(("edges_raw",), "WITH fine AS (SELECT from_id || '_' || doc_id % 400 AS remedy_id, relation_type FROM edges_raw) SELECT remedy_id FROM fine WHERE relation_type = 'CHU_TRI_BENH' EXCEPT SELECT remedy_id FROM fine WHERE relation_type = 'BAO_GOM_VI_THUOC'"),
    "constraint_intersection": oracle(("edges",), "SELECT from_id FROM edges WHERE relation_type = 'CO_TINH' AND to_id = 'T_ECONOMY' INTERSECT SELECT from_id FROM edges WHERE relation_type = 'QUY_KINH' AND to_id = 'K_3'"),
    "facts_per_entity": oracle(("nodes", "edges"), "SELECT e.from_id, e.relation_type, list_sort(list(DISTINCT t.name))[1:5] AS facts FROM edges e JOIN nodes s ON s.id = e.from_id AND s.label = 'BaiThuoc' JOIN nodes t ON t.id = e.to_id GROUP BY 1, 2"),
    "multi_constraint_groups": oracle(("nodes", "edges"), """SELECT a.to_id AS first_id, b.to_id AS second_id, count(DISTINCT a.from_id) AS n_herbs, list_sort(list(DISTINCT n.name))[1:10] AS herbs
      FROM edges a JOIN edges b ON a.from_id = b.from_id JOIN nodes n ON n.id = a.from_id AND n.label = 'ViThuoc' WHERE a.relation_type = 'CO_TINH' AND b.relation_type = 'QUY_KINH' GROUP BY 1, 2 HAVING count(DISTINCT a.from_id) > 1"""),
    "treatment_groups": oracle(("edges",), "SELECT to_id, count(DISTINCT from_id) AS n_sources, min(from_id) AS first_source FROM edges WHERE relation_type IN ('CHU_TRI_BENH', 'CHU_TRI_TRIEU_CHUNG') GROUP BY 1"),
    "sample_per_pattern": oracle(("nodes",), "SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS place FROM nodes) WHERE place <= 40"),
    "filter_by_intent": oracle(("edges_raw",), f"""WITH {_HITS} SELECT intent, relation, count(*) AS n, sum(question_id)::BIGINT AS questions FROM hits WHERE (score >= 0.94 OR score = 2.0)
      AND ((intent = 'treat' AND relation <> 'CO_CONG_NANG') OR (intent = 'list' AND relation = 'BAO_GOM_VI_THUOC')) GROUP BY 1, 2"""),
    "rank_hits": oracle(("edges_raw",), f"""WITH {_HITS}, w AS (SELECT *, CASE WHEN pos % 3 = 1 OR pos % 3 = 0 AND length(subject) <= 4 THEN 3.0 WHEN pos % 3 = 0 THEN 1.5 ELSE score END AS weight FROM hits),
      r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY weight DESC, pos, subject, object, price, seen_at, relation, source_id, description) AS place FROM w)
      SELECT question_id, place, subject, object, CASE WHEN weight >= 3 THEN 'exact' ELSE 'related' END AS bucket, round(weight::DOUBLE, 4) AS weight FROM r WHERE place <= 5"""),
    "hybrid_union": oracle(("edges_raw",), f"""WITH {_HITS}, u AS (SELECT subject, relation, object, 2.0::DOUBLE AS score FROM hits WHERE relation = 'CHU_TRI_BENH' UNION ALL SELECT subject, relation, object, score::DOUBLE FROM hits WHERE relation <> 'CO_CONG_NANG')
      SELECT subject, relation, object, round(max(score), 4) AS score FROM u GROUP BY 1, 2, 3"""),
}
QUERIES = {
    f.__name__: f
    for f in (match_entity, hop_forward, hop_backward, two_hop_remedy, check_relation, treatments_of, herbs_by_attribute, intersect_relations, usage_lookup, entity_overview, neighbourhood, display_nodes, negative_pairs, endpoint_ids, remedies_without_ingredients, constraint_intersection, facts_per_entity, multi_constraint_groups, treatment_groups, sample_per_pattern, filter_by_intent, rank_hits, hybrid_union)
}
