"""Registered curation queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import curate as C

from .tables import load, oracle

ORDER = ["doc_id", "pos", "from_id", "to_id", "price", "seen_at", "relation_type", "source_id", "description"]
_ORDER = ", ".join(ORDER)
#: Patches drawn from the edges: each line item proposes something by its number, with another target if its price is low.
PATCHES_SQL = """patches AS (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN 'THEM_EDGE' WHEN 1 THEN 'XOA_EDGE' WHEN 2 THEN 'SUA_PROPERTIES' ELSE 'SUA_ID' END AS action,
  from_id, CASE WHEN price > 50000 THEN to_id ELSE to_id || '0' END AS to_id, relation_type, description, 'code' || CAST(pos AS STRING) AS code, price FROM edges_raw)"""
#: Remedies with a few edges each: a supplier's orders are dealt out to many.
_FINE = "fine AS (SELECT * REPLACE (from_id || '_' || CAST(doc_id % 400 AS STRING) AS from_id) FROM edges_raw)"


def _raw(spark, sf_dir):
    return load(spark, sf_dir, "edges_raw")


def _fine(spark, sf_dir):
    return _raw(spark, sf_dir).withColumn("from_id", F.concat("from_id", F.lit("_"), (F.col("doc_id") % 400).cast("string")))


def _patches(spark, sf_dir):
    e = _raw(spark, sf_dir).withColumn("to_id", F.when(F.col("price") > 50000, F.col("to_id")).otherwise(F.concat("to_id", F.lit("0"))))
    k = F.col("pos") % 4
    action = F.when(k == 0, "THEM_EDGE").when(k == 1, "XOA_EDGE").when(k == 2, "SUA_PROPERTIES").otherwise("SUA_ID")
    return e.select("doc_id", "pos", action.alias("action"), "from_id", "to_id", "relation_type", "description", F.concat(F.lit("code"), F.col("pos").cast("string")).alias("code"), "price")


def first_wins(spark, sf_dir):
    return C.first_wins(_raw(spark, sf_dir), C.EDGE_KEY, ORDER).select("from_id", "relation_type", "to_id", "doc_id", "pos", "description")


def skip_processed(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return C.skip_processed(orders, _raw(spark, sf_dir), ["doc_id"])


def merge_edges(spark, sf_dir):
    return C.merge_edges(_raw(spark, sf_dir), ORDER).withColumn("confidence", F.round("confidence", 4))


def merge_nodes(spark, sf_dir):
    e = _raw(spark, sf_dir)
    props = F.create_map(F.lit("text"), F.col("description"), F.lit("dose"), F.coalesce("dosage", F.lit("null")))
    order = [c for c in ORDER if c != "to_id"]  # which is the id
    nodes = e.select(F.col("to_id").alias("id"), F.col("source_id").alias("label"), props.alias("props"), *order)
    out = C.merge_nodes(nodes, order)
    return out.select("id", "label", F.col("props")["text"].alias("text"), F.col("props")["dose"].alias("dose"))


def confidence_stats(spark, sf_dir):
    return C.confidence_stats(_raw(spark, sf_dir))


def _issues(spark, sf_dir):
    level = F.when(F.col("price") > 90000, "ERROR").when(F.col("pos") % 2 == 0, "WARNING").otherwise("FIXED")
    return _raw(spark, sf_dir).select("doc_id", level.alias("level"))


def validation_score(spark, sf_dir):
    return C.validation_score(_issues(spark, sf_dir))


def gate_summary(spark, sf_dir):
    return C.gate_summary(validation_score(spark, sf_dir))


def route_quarantine(spark, sf_dir):
    gold, bad = C.route_quarantine(validation_score(spark, sf_dir))
    return gold.select("doc_id", F.lit("gold").alias("status")).unionByName(bad.select("doc_id", F.lit("quarantine").alias("status")))


def rank_by_richness(spark, sf_dir):
    return C.rank_by_richness(validation_score(spark, sf_dir)).select("doc_id", "score", "rank")


def audit_score(spark, sf_dir):
    p = _patches(spark, sf_dir).select("doc_id", "action", (F.col("price") > 95000).alias("known"), F.col("to_id").endswith("7").alias("guarded"), (F.col("pos") < 7).alias("complete"), (F.col("price") > 60000).alias("filled"))
    return C.audit_score(p)


def _rejects(spark, sf_dir):
    return _patches(spark, sf_dir).where("price > 90000").select("doc_id", "code")


def drop_blacklisted(spark, sf_dir):
    return C.drop_blacklisted(_patches(spark, sf_dir), _rejects(spark, sf_dir)).select("doc_id", "code", "action", "price")


def reject_known_edges(spark, sf_dir):
    return C.reject_known_edges(_patches(spark, sf_dir), _raw(spark, sf_dir)).select("doc_id", "action", "from_id", "to_id", "relation_type", "price")


def patch_telemetry(spark, sf_dir):
    return C.patch_telemetry(_patches(spark, sf_dir), _rejects(spark, sf_dir))


def apply_patches(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    ids = raw.select("doc_id", F.col("from_id").alias("id")).union(raw.select("doc_id", "to_id")).distinct()
    nodes, edges = C.apply_patches(ids, raw, _patches(spark, sf_dir))
    nothing = F.lit(None).cast("string")
    return edges.unionByName(nodes.select("doc_id", F.lit(None).cast("int").alias("pos"), F.col("id").alias("from_id"), nothing.alias("to_id"), nothing.alias("relation_type"), nothing.alias("description")))


def relation_inventory(spark, sf_dir):
    return C.relation_inventory(_raw(spark, sf_dir))


def schema_violations(spark, sf_dir):
    # The allowed ends are those of the clean graph; the raw edges break some.
    head = lambda c: F.regexp_extract(c, "^([^_]+_)", 1)
    rules = load(spark, sf_dir, "edges").select("relation_type", head("from_id").alias("from_prefix"), head("to_id").alias("to_prefix")).distinct()
    return C.schema_violations(_raw(spark, sf_dir), rules).groupBy("relation_type", "kind").agg(F.count("*").alias("n"))


def duplicate_edges(spark, sf_dir):
    return C.duplicate_edges(load(spark, sf_dir, "edges_cyclic"))


def direction_conflicts(spark, sf_dir):
    return C.direction_conflicts(load(spark, sf_dir, "edges_cyclic")).select("doc_id", "pos", "from_id", "to_id", "reverse_pos")


def cycles(spark, sf_dir):
    return C.cycles(load(spark, sf_dir, "edges_cyclic"))


def ghost_nodes(spark, sf_dir):
    return C.ghost_nodes(load(spark, sf_dir, "nodes_gappy"), _raw(spark, sf_dir))


def _hubs(spark, sf_dir):
    """Some of the herbs that the gappy nodes have besides those of edges, without an edge."""
    return load(spark, sf_dir, "supplier").select(F.concat(F.lit("VT_9"), "s_suppkey", F.lit("9")).alias("id"))


def orphan_nodes(spark, sf_dir):
    return C.orphan_nodes(load(spark, sf_dir, "nodes_gappy"), _raw(spark, sf_dir), _hubs(spark, sf_dir))


def inject_missing_nodes(spark, sf_dir):
    return C.inject_missing_nodes(load(spark, sf_dir, "nodes_gappy"), _raw(spark, sf_dir))


def collect_garbage(spark, sf_dir):
    nodes, edges = C.collect_garbage(load(spark, sf_dir, "nodes_gappy"), _fine(spark, sf_dir), _hubs(spark, sf_dir))
    return nodes.select(F.col("id"), F.lit("node").alias("kind")).unionByName(edges.select(F.concat_ws(">", "from_id", "to_id").alias("id"), F.lit("edge").alias("kind")))


def isolated_hubs(spark, sf_dir):
    hubs = load(spark, sf_dir, "nodes_gappy").select(F.col("id").alias("hub_id")).union(_fine(spark, sf_dir).select("from_id").distinct())
    return C.isolated_hubs(hubs, _fine(spark, sf_dir))


def drop_lazy_evidence(spark, sf_dir):
    return C.drop_lazy_evidence(_raw(spark, sf_dir), ["o1", "f2"]).groupBy("description").agg(F.count("*").alias("n"))


def drop_vague_targets(spark, sf_dir):
    vague = load(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("VT_"), F.col("p_partkey").cast("string")).alias("id"))
    kept, dropped = C.drop_vague_targets(_raw(spark, sf_dir), vague)
    count = lambda df, name: df.groupBy("relation_type").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
    return count(kept, "kept").unionByName(count(dropped, "dropped"))


def drop_vague_categories(spark, sf_dir):
    return C.drop_vague_categories(_raw(spark, sf_dir), F.col("to_id").endswith("3")).groupBy("from_id", "relation_type").agg(F.count("*").alias("n"))


def orient_edges(spark, sf_dir):
    e = load(spark, sf_dir, "edges")
    back = e.where("relation_type in ('BAO_GOM_VI_THUOC', 'CHU_TRI_BENH')").select(F.col("to_id").alias("from_id"), "relation_type", F.col("from_id").alias("to_id"))
    return C.orient_edges(e.unionByName(back)).groupBy("from_id", "relation_type", "to_id").agg(F.count("*").alias("n"))


def integrity_report(spark, sf_dir):
    return C.integrity_report(load(spark, sf_dir, "nodes_gappy"), _raw(spark, sf_dir))


def _dictionary(spark, sf_dir):
    nodes = load(spark, sf_dir, "nodes")
    hubs = nodes.where("label = 'ViThuoc'").withColumn("name", F.concat(F.lit("herb "), "name"))
    return C.harvest_dictionary(hubs, nodes)


def harvest_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir)


def enrich_aliases(spark, sf_dir):
    return C.enrich_aliases(_dictionary(spark, sf_dir)).select("id", "aliases")


def build_lookup(spark, sf_dir):
    return C.build_lookup(C.enrich_aliases(_dictionary(spark, sf_dir)))


def dictionary_link(spark, sf_dir):
    # Part names stand for herbs in these edges; the lookup leads back to ids.
    names = load(spark, sf_dir, "part").select(F.col("p_partkey"), F.lower("p_name").alias("name"))
    e = load(spark, sf_dir, "lineitem").join(names, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("bt_"), F.col("l_suppkey").cast("string")).alias("from_id"), F.concat(F.lit("herb "), F.col("name")).alias("to_id"))
    return C.dictionary_link(e, C.build_lookup(C.enrich_aliases(_dictionary(spark, sf_dir)))).groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


def knowledge_signature(spark, sf_dir):
    return C.knowledge_signature(load(spark, sf_dir, "nodes"), load(spark, sf_dir, "edges")).select("id", F.md5("signature").alias("signature"), F.length("signature").alias("length"))


def embedding_text(spark, sf_dir):
    nodes, about = load(spark, sf_dir, "nodes"), F.concat(F.lit("what is "), "name", F.lit("?"))
    told = nodes.withColumns({"hint": F.when(F.col("label") != "TinhVi", about), "description": F.when(F.col("alias") != "", F.repeat(F.concat("name", F.lit("; ")), 30))})
    out = C.embedding_text(told, C.knowledge_signature(nodes, load(spark, sf_dir, "edges"), None))
    return out.select("id", F.md5("text").alias("text"), F.length("text").alias("length"))


def pending_embeddings(spark, sf_dir):
    nodes = load(spark, sf_dir, "nodes").where("label = 'ViThuoc'").select("id")
    cache = load(spark, sf_dir, "embeddings").select(F.concat(F.lit("VT_"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    todo, cached = C.pending_embeddings(nodes, cache)
    return todo.select("id", F.lit(False).alias("cached")).unionByName(cached.select("id", F.lit(True).alias("cached")))


def richness_score(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "name").alias("scientific"), F.when(F.col("o_orderpriority").startswith("1"), "fam").alias("family"), (F.col("o_custkey") % 3).alias("n_variants"), (F.col("o_custkey") % 2).alias("n_tastes"), F.when(F.col("o_custkey") % 5 > 1, "T_ON").alias("nature"), (F.col("o_custkey") % 4).alias("n_meridians"))
    return C.richness_score(docs, _raw(spark, sf_dir))


def chunk_items(spark, sf_dir):
    return C.chunk_items(_raw(spark, sf_dir), "from_id", ORDER).groupBy("from_id", "part").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def _pages(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")


def _anchors(spark, sf_dir):
    return _pages(spark, sf_dir).where("page % 7 = 0").select("book", "page", F.concat(F.lit("E"), F.col("page").cast("string")).alias("entity"))


def carry_anchor(spark, sf_dir):
    return C.carry_anchor(_pages(spark, sf_dir).select("book", "page"), _anchors(spark, sf_dir), 64)


def merge_spilled_text(spark, sf_dir):
    p = _pages(spark, sf_dir)
    placed = C.carry_anchor(p.select("book", "page"), _anchors(spark, sf_dir)).join(p, ["book", "page"])
    return C.merge_spilled_text(placed, 4).select("book", "anchor", "part", F.md5("text").alias("digest"), F.length("text").alias("length"))


def merge_split_recipes(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    items = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", F.concat(F.col("text"), F.lit(" [src]"))).otherwise(F.col("text")).alias("text"))
    return C.merge_split_recipes(items).select("doc_id", "pos", F.md5("text").alias("digest"))


def evidence_filter(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    rel = F.when(F.col("p_size") % 4 == 0, "QUY_KINH").when(F.col("p_size") % 4 == 1, "CO_TINH").when(F.col("p_size") % 4 == 2, "CHU_TRI_BENH").otherwise("KIENG_KY")
    said = F.when(F.col("p_size") % 5 == 0, " Suy luận").when(F.col("p_size") % 5 == 1, " dựa trên công năng").when(F.col("p_size") % 5 == 2, " có lẽ").otherwise(F.concat(F.lit(" "), F.lower("p_type")))
    edges = p.select(F.col("p_partkey").alias("doc_id"), F.lit("VT_1").alias("from_id"), F.concat(F.lit("K_"), "p_type").alias("to_id"), rel.alias("relation_type"), F.concat("p_name", said).alias("description"))
    anchors = p.where("p_type = 'SMALL'").select(F.lower("p_type").alias("core"), F.array(F.lit("nothing")).alias("words")).distinct()
    kept, issues = C.evidence_filter(edges, anchors, keep=["economy"])
    return kept.select("doc_id", F.lit("KEPT").alias("level"), F.length("description").alias("length")).unionByName(issues.select("doc_id", "level", F.lit(0).alias("length")))


def fuse_fragments(spark, sf_dir):
    e = _raw(spark, sf_dir)
    parts = [e.where(F.col("relation_type") == r) for r in ("BAO_GOM_VI_THUOC", "CHU_TRI_BENH", "CO_CONG_NANG")]
    return C.fuse_fragments(parts[0], parts[1:], ORDER).groupBy("doc_id").agg(F.count("*").alias("n_edges"), F.sum("n_merged").alias("n_merged"), F.round(F.max("confidence"), 4).alias("best"))


def join_bronze(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(F.lit("_bai_thuoc"), F.lit("_duoc_ly"), F.lit("_dinh_danh"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    silver = d.select(F.concat(F.col("doc_id").cast("string"), suffix, F.lit(".json")).alias("file"))
    return C.join_bronze(silver, d.select(F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("digest"))).select("file", "doc_id", "digest")


def hub_properties(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("name"), "p_name")).alias("props"))
    docs = p.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("hub_id"), F.create_map(F.lit("name"), F.lit("other"), F.lit("brand"), F.when(F.col("p_size") % 3 == 0, "null").otherwise(F.col("p_brand"))).alias("props"))
    return C.hub_properties(nodes, docs).select("id", F.col("props")["name"].alias("name"), F.col("props")["brand"].alias("brand"))


def link_attributes(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    claims = p.select(F.col("p_size").alias("doc_id"), F.array(F.lower("p_type"), F.lit(" ")).alias("taste"))
    lookup = p.where("p_type <> 'SMALL'").select(F.concat(F.lit("t_"), F.lower("p_type")).alias("key"), F.concat(F.lit("T_"), F.substring("p_type", 1, 3)).alias("canonical_id")).distinct()
    out = C.link_attributes(claims, lookup, "taste", "T_")
    return out.select("doc_id", F.array_join("taste", ",").alias("taste"))


def merge_identity(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    first = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(" ").alias("name"), F.col("c_mktsegment").alias("kind"))
    second = c.where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("doc_id"), F.lit("second").alias("name"), F.lit(None).cast("string").alias("kind"))
    return C.merge_identity(first, second, ["name", "kind"])


# text and id columns


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def strip_accents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_accents("text")).alias("digest"))


def normalize_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_id(F.col("text"))).alias("digest"))


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


def strip_null_words(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.strip_null_words(F.concat(F.lit("None "), "p_name", F.lit(" null "), "p_type")).alias("text"))


def label_from_prefix(spark, sf_dir):
    return load(spark, sf_dir, "nodes").select("id", T.label_from_prefix(F.col("id")).alias("label"), T.id_prefix(F.col("id")).alias("prefix"), T.name_from_id(F.col("id")).alias("name"))


def normalize_prefix(spark, sf_dir):
    n = load(spark, sf_dir, "nodes")
    return n.select("id", T.normalize_prefix(F.lower("id"), synonyms={"ECONOMY": "THRIFT"}).alias("same"), T.normalize_prefix(F.col("id"), target="CN_").alias("as_function"), T.link_id(F.col("id")).alias("linked"))


def clean_entity_name(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.clean_entity_name(F.concat(F.lit("Cây <b>"), "p_name", F.lit("</b>  x"))).alias("name"))


def _edges(sql, *more):
    return oracle(("edges_raw", *more), sql)


_PATCHED = lambda sql: oracle(("edges_raw",), f"WITH {PATCHES_SQL} {sql}")
_SCORED = """scored AS (SELECT doc_id, count(*) FILTER (WHERE price > 90000) AS errors, count(*) FILTER (WHERE price <= 90000 AND pos % 2 = 0) AS warnings, count(*) FILTER (WHERE price <= 90000 AND pos % 2 <> 0) AS fixed FROM edges_raw GROUP BY 1),
  gated AS (SELECT *, greatest(0, 100 - 15 * errors - 5 * warnings) AS score, errors = 0 AND greatest(0, 100 - 15 * errors - 5 * warnings) >= 70 AS passed FROM scored)"""
_DICT = """both_rows AS (SELECT id, label, 'herb ' || name AS name, alias, 0 AS priority FROM nodes WHERE label = 'ViThuoc' UNION ALL SELECT id, label, name, alias, 1 FROM nodes),
  dict AS (SELECT id, arg_min(name, (priority, name, label)) AS name, arg_min(label, (priority, name, label)) AS label, coalesce(list_sort(list(DISTINCT alias) FILTER (WHERE alias <> '')), []) AS aliases FROM both_rows GROUP BY id),
  rich AS (SELECT id, list_sort(list_distinct(list_filter(list_concat([lower(name)], aliases, [replace(lower(name), ' ', '')], list_transform(aliases, lambda a: replace(a, ' ', ''))), lambda a: a <> ''))) AS aliases FROM dict),
  lookup AS (SELECT key, arg_min(id, (priority, id)) AS canonical_id FROM (SELECT lower(id) AS key, id, 0 AS priority FROM rich UNION ALL SELECT unnest(aliases), id, 1 FROM rich) GROUP BY key)"""
_SIGN = """phrases AS (SELECT DISTINCT e.from_id AS id, lower(relation_type) || ' ' || n.name AS phrase FROM edges e JOIN nodes n ON n.id = e.to_id
    UNION SELECT e.to_id, 'of ' || lower(relation_type) || ' ' || n.name FROM edges e JOIN nodes n ON n.id = e.from_id WHERE relation_type IN ('BAO_GOM_VI_THUOC', 'CHU_TRI_BENH', 'CO_CHUA_HOAT_CHAT')),
  signed AS (SELECT id, string_agg(phrase, '; ' ORDER BY phrase) AS signature FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY phrase) AS k FROM phrases) WHERE k <= 1000 GROUP BY id)"""
_HUBS = "(SELECT 'VT_9' || s_suppkey || '9' FROM supplier)"
_ENDS = "ends AS (SELECT from_id AS id FROM edges_raw UNION SELECT to_id FROM edges_raw)"
_PAGES = """pages_of AS (SELECT source AS book, doc_id AS page, text, CASE WHEN doc_id % 7 = 0 THEN 'E' || doc_id END AS entity FROM documents),
  placed AS (SELECT *, last_value(entity IGNORE NULLS) OVER w AS anchor, last_value(CASE WHEN entity IS NOT NULL THEN page END IGNORE NULLS) OVER w AS start_page FROM pages_of WINDOW w AS (PARTITION BY book ORDER BY page ROWS UNBOUNDED PRECEDING))"""
#: Patches in a document's turn, with what THEM_EDGE and SUA_PROPERTIES make of their ends and type.
_TURNS = f"""{PATCHES_SQL}, turns AS (SELECT doc_id, pos, action, relation_type, description, row_number() OVER (PARTITION BY doc_id ORDER BY pos, from_id, to_id, relation_type, description) AS k,
    action IN ('THEM_EDGE', 'SUA_PROPERTIES') AND starts_with(from_id, 'VT_') AND starts_with(to_id, 'BT_') AS swap, CASE WHEN swap THEN to_id ELSE from_id END AS a, CASE WHEN swap THEN from_id ELSE to_id END AS b FROM patches)"""
_WALK = f"""WITH RECURSIVE {_TURNS},
  start AS (SELECT doc_id, list(struct_pack(pos := pos, f := from_id, t := to_id, r := relation_type, d := description) ORDER BY pos, from_id, to_id, relation_type, description) AS e FROM edges_raw GROUP BY 1),
  walk AS (SELECT doc_id, 0::BIGINT AS k, e FROM start UNION ALL SELECT w.doc_id, t.k, CASE t.action
      WHEN 'SUA_ID' THEN list_transform(w.e, lambda x: struct_pack(pos := x.pos, f := CASE WHEN x.f = a THEN b ELSE x.f END, t := CASE WHEN x.t = a THEN b ELSE x.t END, r := x.r, d := x.d))
      WHEN 'XOA_EDGE' THEN list_filter(w.e, lambda x: NOT (x.f = a AND x.t = b))
      ELSE CASE WHEN coalesce(list_position(list_transform(w.e, lambda x: x.f = a AND x.t = b), true), 0) > 0
        THEN list_transform(w.e, lambda x, i: CASE WHEN i = list_position(list_transform(w.e, lambda y: y.f = a AND y.t = b), true) THEN struct_pack(pos := x.pos, f := x.f, t := x.t, r := t.relation_type, d := t.description) ELSE x END)
        WHEN t.action = 'THEM_EDGE' THEN list_append(w.e, struct_pack(pos := 1000000 + t.pos, f := a, t := b, r := t.relation_type, d := t.description)) ELSE w.e END END
    FROM walk w JOIN turns t ON t.doc_id = w.doc_id AND t.k = w.k + 1),
  ids AS (SELECT DISTINCT doc_id, id FROM (SELECT doc_id, from_id AS id FROM edges_raw UNION SELECT doc_id, to_id FROM edges_raw)),
  named AS (SELECT doc_id, id, 0::BIGINT AS k, id AS now FROM ids UNION ALL SELECT n.doc_id, n.id, t.k, CASE WHEN t.action = 'SUA_ID' AND now = a THEN b ELSE now END FROM named n JOIN turns t ON t.doc_id = n.doc_id AND t.k = n.k + 1),
  told AS (SELECT doc_id, unnest(e) AS x FROM (SELECT doc_id, arg_max(e, k) AS e FROM walk GROUP BY 1))
  SELECT doc_id, x.pos AS pos, x.f AS from_id, x.t AS to_id, x.r AS relation_type, x.d AS description FROM told UNION ALL SELECT doc_id, NULL, arg_max(now, k), NULL, NULL, NULL FROM named GROUP BY doc_id, id"""
ORACLE = {
    "apply_patches": oracle(("edges_raw",), _WALK),
    "first_wins": _edges(f"SELECT from_id, relation_type, to_id, doc_id, pos, description FROM (SELECT *, row_number() OVER (PARTITION BY from_id, relation_type, to_id ORDER BY {_ORDER}) AS k FROM edges_raw) WHERE k = 1"),
    "skip_processed": _edges("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM edges_raw)"),
    "merge_edges": _edges(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS k FROM edges_raw),
      t AS (SELECT from_id, relation_type, to_id, string_agg(description, ' | ' ORDER BY k) AS description FROM (SELECT from_id, relation_type, to_id, description, min(k) AS k FROM o GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
      SELECT from_id, relation_type, to_id, t.description, arg_min(dosage, k) FILTER (WHERE dosage <> '') AS dosage, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS source_id,
        round(max(CASE WHEN coalesce(confidence, 0) = 0 THEN 0.75 ELSE confidence END), 4) AS confidence, count(*) AS n_merged FROM o JOIN t USING (from_id, relation_type, to_id) GROUP BY 1, 2, 3, 4"""),
    "merge_nodes": _edges(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS k FROM edges_raw)
      SELECT to_id AS id, arg_min(source_id, k) AS label, arg_min(description, k) AS text, arg_min(dosage, k) FILTER (WHERE dosage IS NOT NULL) AS dose FROM o GROUP BY 1"""),
    "confidence_stats": _edges("""SELECT doc_id, count(*) AS n_claims, round(sum(coalesce(confidence, CASE WHEN source_id LIKE '%CT_VT_VN%' THEN 0.95 ELSE 0.75 END)), 8) AS total,
      round(avg(coalesce(confidence, CASE WHEN source_id LIKE '%CT_VT_VN%' THEN 0.95 ELSE 0.75 END)), 8) AS c_score FROM edges_raw GROUP BY 1"""),
    "validation_score": _edges(f"WITH {_SCORED} SELECT * FROM gated"),
    "gate_summary": _edges(f"WITH {_SCORED} SELECT count(*) AS documents, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS quarantined, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(fixed)::BIGINT AS fixed, round(100 * count(*) FILTER (WHERE passed) / count(*), 2) AS pass_rate FROM gated"),
    "route_quarantine": _edges(f"WITH {_SCORED} SELECT doc_id, CASE WHEN passed THEN 'gold' ELSE 'quarantine' END AS status FROM gated"),
    "rank_by_richness": _edges(f"WITH {_SCORED} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM gated"),
    "audit_score": _PATCHED("""SELECT doc_id, penalty, n_proposals, greatest(0, 100 - penalty) AS score, CASE WHEN penalty <= 10 THEN 'PASS' WHEN penalty <= 40 THEN 'REVIEW' ELSE 'FAIL' END AS verdict FROM (
      SELECT doc_id, count(*) AS n_proposals, sum(CASE WHEN action = 'SUA_PROPERTIES' AND price <= 60000 THEN 20 WHEN pos >= 7 THEN 20 WHEN action = 'THEM_EDGE' THEN 8 ELSE 5 END)::BIGINT AS penalty
      FROM patches WHERE NOT (action = 'THEM_EDGE' AND price > 95000) AND NOT (action = 'XOA_EDGE' AND to_id LIKE '%7') GROUP BY 1)"""),
    "drop_blacklisted": _PATCHED("SELECT doc_id, code, action, price FROM patches WHERE (doc_id, code) NOT IN (SELECT (doc_id, code) FROM patches WHERE price > 90000)"),
    "reject_known_edges": _PATCHED("SELECT doc_id, action, from_id, to_id, relation_type, price FROM patches WHERE action <> 'THEM_EDGE' OR (from_id, to_id, relation_type) NOT IN (SELECT (from_id, to_id, relation_type) FROM edges_raw)"),
    "patch_telemetry": _PATCHED("""SELECT doc_id, count(*) AS proposed, count(*) FILTER (WHERE bad) AS rejected, count(*) FILTER (WHERE NOT bad) AS applied FROM (SELECT *, (doc_id, code) IN (SELECT (doc_id, code) FROM patches WHERE price > 90000) AS bad FROM patches) GROUP BY ROLLUP (doc_id)"""),
    "relation_inventory": _edges("SELECT doc_id, relation_type, array_to_string(list_sort(list(DISTINCT to_id)), ', ') AS targets FROM edges_raw GROUP BY 1, 2"),
    "schema_violations": _edges("""SELECT relation_type, CASE WHEN relation_type IN (SELECT relation_type FROM edges) THEN 'wrong_ends' ELSE 'unknown_type' END AS kind, count(*) AS n FROM edges_raw
      WHERE (relation_type, split_part(from_id, '_', 1), split_part(to_id, '_', 1)) NOT IN (SELECT (relation_type, split_part(from_id, '_', 1), split_part(to_id, '_', 1)) FROM edges) GROUP BY 1, 2""", "edges"),
    "duplicate_edges": oracle(("edges_cyclic",), "SELECT doc_id, from_id, to_id, upper(relation_type) AS relation_type, count(*) - 1 AS repeats FROM edges_cyclic GROUP BY 1, 2, 3, 4 HAVING count(*) > 1"),
    "direction_conflicts": oracle(("edges_cyclic",), "SELECT e.doc_id, e.pos, e.from_id, e.to_id, r.reverse_pos FROM edges_cyclic e JOIN (SELECT doc_id, to_id AS from_id, from_id AS to_id, min(pos) AS reverse_pos FROM edges_cyclic GROUP BY 1, 2, 3) r USING (doc_id, from_id, to_id) WHERE e.pos > r.reverse_pos"),
    "cycles": oracle(("edges_cyclic",), """WITH RECURSIVE pairs AS (SELECT DISTINCT doc_id, from_id, to_id FROM edges_cyclic), reach AS (SELECT doc_id, from_id AS a, to_id AS b FROM pairs UNION SELECT r.doc_id, r.a, p.to_id FROM reach r JOIN pairs p ON p.doc_id = r.doc_id AND p.from_id = r.b)
      SELECT doc_id, a AS node FROM reach WHERE a = b"""),
    "ghost_nodes": _edges(f"WITH {_ENDS} SELECT id FROM ends WHERE id NOT IN (SELECT id FROM nodes_gappy)", "nodes_gappy"),
    "orphan_nodes": _edges(f"WITH {_ENDS} SELECT * FROM nodes_gappy WHERE id NOT IN (SELECT id FROM ends) AND (id NOT IN {_HUBS})", "nodes_gappy"),
    "inject_missing_nodes": _edges(f"""WITH {_ENDS} SELECT * FROM nodes_gappy UNION ALL SELECT id, CASE WHEN id LIKE 'BT%' THEN 'BaiThuoc' ELSE 'ViThuoc' END, split_part(id, '_', 2) FROM ends
      WHERE id NOT IN (SELECT id FROM nodes_gappy) AND (id NOT LIKE 'BT%' OR id IN (SELECT from_id FROM edges_raw WHERE relation_type = 'BAO_GOM_VI_THUOC'))""", "nodes_gappy"),
    "collect_garbage": _edges(f"""WITH {_FINE}, kept AS (SELECT * FROM fine WHERE from_id IN (SELECT from_id FROM fine WHERE relation_type = 'BAO_GOM_VI_THUOC'))
      SELECT id, 'node' AS kind FROM nodes_gappy WHERE id IN (SELECT from_id FROM kept UNION SELECT to_id FROM kept) OR id IN {_HUBS} UNION ALL SELECT from_id || '>' || to_id, 'edge' FROM kept""", "nodes_gappy"),
    "isolated_hubs": _edges(f"""WITH {_FINE}, e AS (SELECT from_id AS id, relation_type IN ('CHU_TRI_BENH', 'CO_CONG_NANG') AS useful FROM fine UNION ALL SELECT to_id, false FROM fine), u AS (SELECT id, bool_or(useful) AS useful FROM e GROUP BY 1),
      hubs AS (SELECT id FROM nodes_gappy UNION ALL SELECT DISTINCT from_id FROM fine)
      SELECT h.id AS hub_id, CASE WHEN useful IS NULL THEN 'ERROR' ELSE 'WARNING' END AS level, CASE WHEN useful IS NULL THEN 'ISOLATED_NODE' ELSE 'NO_TREATMENT_EDGE' END AS code FROM hubs h LEFT JOIN u ON u.id = h.id WHERE NOT coalesce(useful, false)""", "nodes_gappy"),
    "drop_lazy_evidence": _edges("SELECT description, count(*) AS n FROM edges_raw WHERE description NOT IN ('O1', 'F2') GROUP BY 1"),
    "drop_vague_targets": _edges("SELECT relation_type, CASE WHEN to_id IN (SELECT 'VT_' || p_partkey FROM part WHERE p_size = 7) THEN 'dropped' ELSE 'kept' END AS part, count(*) AS n FROM edges_raw GROUP BY 1, 2"),
    "drop_vague_categories": _edges("""SELECT from_id, relation_type, count(*) AS n FROM edges_raw WHERE NOT (relation_type = 'CHU_TRI_BENH' AND to_id LIKE '%3' AND from_id IN (SELECT from_id FROM edges_raw WHERE relation_type = 'CHU_TRI_BENH' AND to_id NOT LIKE '%3')) GROUP BY 1, 2"""),
    "orient_edges": oracle(("edges",), """SELECT from_id, relation_type, to_id, sum(n)::BIGINT AS n FROM (SELECT from_id, relation_type, to_id, CASE WHEN relation_type IN ('BAO_GOM_VI_THUOC', 'CHU_TRI_BENH') THEN 2 ELSE 1 END AS n FROM edges) GROUP BY 1, 2, 3"""),
    "integrity_report": _edges(f"""WITH {_ENDS} SELECT 'ghost' AS kind, count(*) AS n FROM ends WHERE id NOT IN (SELECT id FROM nodes_gappy) UNION ALL SELECT 'orphan', count(*) FROM nodes_gappy WHERE id NOT IN (SELECT id FROM ends)
      UNION ALL SELECT 'self_loop', count(*) FROM edges_raw WHERE from_id = to_id UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM edges_raw GROUP BY from_id, relation_type, to_id HAVING count(*) > 1)""", "nodes_gappy"),
    "harvest_dictionary": oracle(("nodes",), f"WITH {_DICT} SELECT * FROM dict"),
    "enrich_aliases": oracle(("nodes",), f"WITH {_DICT} SELECT * FROM rich"),
    "build_lookup": oracle(("nodes",), f"WITH {_DICT} SELECT * FROM lookup"),
    "dictionary_link": oracle(("nodes",), f"""WITH {_DICT}, e AS (SELECT 'bt_' || l_suppkey AS a, 'herb ' || lower(p_name) AS b FROM lineitem JOIN part ON p_partkey = l_partkey)
      SELECT coalesce(x.canonical_id, a) AS from_id, coalesce(y.canonical_id, b) AS to_id, count(*) AS n FROM e LEFT JOIN lookup x ON x.key = lower(a) LEFT JOIN lookup y ON y.key = lower(b) GROUP BY 1, 2"""),
    "knowledge_signature": oracle(("nodes", "edges"), f"WITH {_SIGN} SELECT id, md5(signature) AS signature, length(signature) AS length FROM signed"),
    "embedding_text": oracle(("nodes", "edges"), """WITH names AS MATERIALIZED (SELECT id, name FROM nodes), links AS MATERIALIZED (SELECT DISTINCT * FROM edges),
      phrases AS (SELECT e.from_id AS id, lower(relation_type) || ' ' || n.name AS phrase FROM links e JOIN names n ON n.id = e.to_id
        UNION SELECT e.to_id, 'of ' || lower(relation_type) || ' ' || n.name FROM links e JOIN names n ON n.id = e.from_id WHERE relation_type IN ('BAO_GOM_VI_THUOC', 'CHU_TRI_BENH', 'CO_CHUA_HOAT_CHAT')),
      signed AS MATERIALIZED (SELECT id, array_to_string(list_sort(list(phrase)), '; ') AS signature FROM phrases GROUP BY id),
      told AS (SELECT n.id, trim('Thực thể YHCT: ' || name || '. Phân loại: ' || label || '. Tên gọi khác: ' || alias || '. Định nghĩa & Gợi ý tìm kiếm: ' || CASE WHEN label <> 'TinhVi' THEN 'what is ' || name || '?' ELSE '' END
        || ' Đặc điểm lâm sàng & Quan hệ: ' || coalesce(signature, '') || ' Mô tả cơ bản: ' || CASE WHEN alias <> '' THEN left(repeat(name || '; ', 30), 250) ELSE '' END) AS text FROM nodes n LEFT JOIN signed s ON s.id = n.id)
      SELECT id, md5(text) AS text, length(text) AS length FROM told"""),
    "pending_embeddings": oracle(("nodes",), "SELECT id, id IN (SELECT 'VT_' || vec_id FROM embeddings) AS cached FROM nodes WHERE label = 'ViThuoc'"),
    "richness_score": _edges("""WITH n AS (SELECT doc_id, count(*) FILTER (WHERE relation_type = 'CO_CONG_NANG') AS cn, count(*) FILTER (WHERE relation_type = 'CHU_TRI_BENH') AS b FROM edges_raw GROUP BY 1),
      d AS (SELECT o_orderkey AS doc_id, coalesce(cn, 0) AS cn, coalesce(b, 0) AS b, (CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END) + (CASE WHEN o_orderpriority LIKE '1%' THEN 5 ELSE 0 END) + (CASE WHEN o_custkey % 3 > 0 THEN 5 ELSE 0 END)
        + (CASE WHEN o_custkey % 2 > 0 THEN 5 ELSE 0 END) + (CASE WHEN o_custkey % 5 > 1 THEN 5 ELSE 0 END) + (CASE WHEN o_custkey % 4 > 0 THEN 10 ELSE 0 END) AS base FROM orders LEFT JOIN n ON n.doc_id = o_orderkey)
      SELECT doc_id, round(least(100.0, (CASE WHEN cn > 0 AND base < 40 THEN least(40, base + 2 * cn) ELSE base END) + least(30.0, 1.5 * least(b, 10)))::DOUBLE, 2) AS richness FROM d"""),
    "chunk_items": _edges(f"SELECT from_id, part, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT from_id, doc_id, (row_number() OVER (PARTITION BY from_id ORDER BY {_ORDER}) - 1) // 6 + 1 AS part FROM edges_raw) GROUP BY 1, 2"),
    "carry_anchor": f"WITH {_PAGES} SELECT book, page, anchor, start_page FROM placed",
    "merge_spilled_text": f"""WITH {_PAGES}, p AS (SELECT *, lag(text) OVER (PARTITION BY book, anchor ORDER BY page) AS before FROM placed WHERE anchor IS NOT NULL AND trim(text) <> ''),
      j AS (SELECT book, anchor, page // 4 AS part, string_agg(CASE WHEN before IS NULL THEN '[T' || page || ']: ' || text WHEN regexp_matches(before, '[.:!?]$') THEN chr(10) || '[T' || page || ']: ' || text ELSE ' ' || text END, '' ORDER BY page) AS t FROM p GROUP BY 1, 2, 3)
      SELECT book, anchor, part, md5(t) AS digest, length(t) AS length FROM j""",
    "merge_split_recipes": """WITH i AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN role = 'assistant' THEN text || ' [src]' ELSE text END AS t, CASE WHEN role = 'assistant' OR contains(text, '[src]') THEN 1 ELSE 0 END AS has FROM conversations),
      g AS (SELECT *, coalesce(sum(has) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM i),
      m AS (SELECT doc_id, island, string_agg(t, ' ' ORDER BY pos) AS t, min(pos) AS pos FROM g GROUP BY 1, 2) SELECT doc_id, min(pos) AS pos, md5(t) AS digest FROM m GROUP BY doc_id, t""",
    "evidence_filter": """WITH e AS (SELECT p_partkey AS doc_id, p_type, p_size % 4 AS r, p_size % 5 AS i, lower(p_name) || (['suy luận', ' dựa trên công năng', ' có lẽ', ' ' || lower(p_type), ' ' || lower(p_type)])[p_size % 5 + 1] AS t,
        length(p_name) + (CASE p_size % 5 WHEN 0 THEN 9 WHEN 1 THEN 19 WHEN 2 THEN 6 ELSE 1 + length(p_type) END) AS n FROM part),
      v AS (SELECT *, CASE WHEN r < 2 AND i < 2 THEN 'D' WHEN r < 2 AND (p_type = 'SMALL' OR NOT contains(t, lower(p_type))) THEN CASE r WHEN 0 THEN 'D' ELSE 'W' END WHEN r = 2 AND i IN (0, 2) THEN CASE p_type WHEN 'ECONOMY' THEN 'N' ELSE 'D' END ELSE 'O' END AS v FROM e)
      SELECT doc_id, 'KEPT' AS level, (n + CASE v WHEN 'N' THEN 31 ELSE 0 END)::INT AS length FROM v WHERE v <> 'D' UNION ALL SELECT doc_id, CASE WHEN v = 'D' THEN 'FIXED' ELSE 'WARNING' END, 0 FROM v WHERE v <> 'O'""",
    "fuse_fragments": _edges("""WITH f AS (SELECT * FROM edges_raw WHERE doc_id IN (SELECT doc_id FROM edges_raw WHERE relation_type = 'BAO_GOM_VI_THUOC'))
      SELECT doc_id, count(DISTINCT (from_id, relation_type, to_id)) AS n_edges, count(*) AS n_merged, round(max(CASE WHEN coalesce(confidence, 0) = 0 THEN 0.75 ELSE confidence END), 4) AS best FROM f GROUP BY 1"""),
    "join_bronze": "SELECT doc_id || (['_bai_thuoc', '_duoc_ly', '_dinh_danh', ''])[doc_id % 4 + 1] || '.json' AS file, doc_id::VARCHAR AS doc_id, md5(text) AS digest FROM documents",
    "hub_properties": "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size > 10 THEN 'other' END AS name, CASE WHEN p_size > 10 AND p_size % 3 <> 0 THEN p_brand END AS brand FROM part",
    "link_attributes": "SELECT p_size AS doc_id, array_to_string(list_sort(list(DISTINCT CASE WHEN p_type = 'SMALL' THEN 'T_SMALL' ELSE 'T_' || p_type[1:3] END)), ',') AS taste FROM part GROUP BY 1",
    "merge_identity": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 > 0 AND c_acctbal > 0 THEN c_name WHEN c_custkey % 5 > 0 THEN 'second' END AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS kind FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 5 > 0",
    "strip_accents": "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents",
    "normalize_id": "SELECT doc_id, md5(regexp_replace(regexp_replace(upper(regexp_replace(strip_accents(text), '[^a-zA-Z0-9_]', '_', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g')) AS digest FROM documents",
    "clean_text": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\r\n|\n|\r|\\n', ' ', 'g'), '\s{2,}', ' ', 'g'))) AS digest FROM documents",
    "strip_null_words": "SELECT p_partkey, p_name || ' ' || p_type AS text FROM part",
    "label_from_prefix": oracle(("nodes",), "SELECT id, label, split_part(id, '_', 1) || '_' AS prefix, list_reduce(list_transform(string_split(lower(replace(substr(id, length(split_part(id, '_', 1)) + 2), '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS name FROM nodes"),
    "normalize_prefix": oracle(("nodes",), """WITH c AS (SELECT id, split_part(id, '_', 1) || '_' AS p, upper(substr(id, length(split_part(id, '_', 1)) + 2)) AS core FROM nodes)
      SELECT id, (CASE WHEN p = 'VT_' THEN 'VI_THUOC_' ELSE p END) || (CASE WHEN core = 'ECONOMY' THEN 'THRIFT' ELSE core END) AS same, 'CN_' || CASE WHEN p = 'NB_' THEN p ELSE '' END || core AS as_function, p || core AS linked FROM c"""),
    "clean_entity_name": "SELECT p_partkey, upper(p_name[1]) || p_name[2:] || ' x' AS name FROM part",
}
_NAMES = "evidence_filter fuse_fragments join_bronze hub_properties link_attributes merge_identity first_wins skip_processed merge_edges merge_nodes confidence_stats validation_score gate_summary route_quarantine rank_by_richness audit_score drop_blacklisted reject_known_edges patch_telemetry apply_patches relation_inventory schema_violations duplicate_edges direction_conflicts cycles ghost_nodes orphan_nodes inject_missing_nodes collect_garbage isolated_hubs drop_lazy_evidence drop_vague_targets drop_vague_categories orient_edges integrity_report harvest_dictionary enrich_aliases build_lookup dictionary_link knowledge_signature embedding_text pending_embeddings richness_score chunk_items carry_anchor merge_spilled_text merge_split_recipes strip_accents normalize_id clean_text strip_null_words label_from_prefix normalize_prefix clean_entity_name"
QUERIES = {name: globals()[name] for name in _NAMES.split()}
