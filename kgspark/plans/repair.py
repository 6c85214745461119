"""Registered queries of the document repair jobs with their oracles. The rows' cases go by line and part numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import repair as R
from kgspark.sources import io

from .tables import load, oracle

ONTOLOGY = R.Ontology(required={"BAO_GOM_VI_THUOC": "VI_THUOC_", "CHU_TRI_BENH": "B_", "CO_TINH": "T_", "CO_VI": "V_", "QUY_KINH": "K_"}, vague=("VAGUE",), function_prefixes=("AN_",), functions=("BO_KHI",))
#: Ids as a number decides, in SQL common to Spark and DuckDB.
_TO = """CASE l_partkey % 8 WHEN 0 THEN 'VT_' || k WHEN 1 THEN 'B_AN_' || k WHEN 2 THEN 'T_ÔN' WHEN 3 THEN 'k_' || k WHEN 4 THEN ' ' WHEN 5 THEN 'B_THUOC_' || k WHEN 6 THEN 'CN_X' || k ELSE 'S_VAGUE' END"""
_LINES = """lines AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey, CAST(l_partkey AS STRING) AS k, l_returnflag AS flag, l_linestatus AS status, CAST(CAST(l_quantity AS INT) AS STRING) AS q,
  CASE l_returnflag WHEN 'N' THEN 'BAO_GOM_VI_THUOC' WHEN 'R' THEN 'CHU_TRI_BENH' ELSE 'CO_CONG_NANG' END AS relation_type, CAST(l_orderkey % 100 AS STRING) AS h, CAST(l_suppkey AS STRING) AS s FROM lineitem)"""


def _lines(spark, sf_dir, select: str):
    return spark.sql(f"WITH lineitem AS (SELECT * FROM {{lineitem}}), {_LINES} {select}", lineitem=load(spark, sf_dir, "lineitem"))


def _hubs(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("VI_THUOC_"), (F.col("o_orderkey") % 100).cast("string")).alias("hub_id"))


def _heal(spark, sf_dir):
    edges = _lines(spark, sf_dir, f"SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN 'BT_' || s WHEN 1 THEN 'vt_' || h ELSE 'HC_' || s END AS from_id, {_TO} AS to_id, relation_type FROM lines")
    return R.heal_edges(edges, _hubs(spark, sf_dir), ONTOLOGY)


def heal_edges(spark, sf_dir):
    return _heal(spark, sf_dir)[0]


def heal_issues(spark, sf_dir):
    return _heal(spark, sf_dir)[1].groupBy("doc_id", "level", "code").agg(F.count("*").alias("n"))


def route_dna_edges(spark, sf_dir):
    edges = _lines(spark, sf_dir, """SELECT doc_id, pos, 'vt ' || s AS from_id, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'k-' || k END AS to_id, CASE WHEN pos % 4 = 0 THEN 'co_tinh' ELSE relation_type END AS relation_type,
      CASE l_partkey % 5 WHEN 0 THEN 'Có lẽ' WHEN 1 THEN 'dựa trên công năng' ELSE q END AS description, CASE WHEN l_partkey % 3 = 0 THEN 'Chưa rõ' ELSE q END AS dosage FROM lines""")
    return R.route_dna_edges(edges, F.col("pos") == 4)


def extract_dosage(spark, sf_dir):
    edges = _lines(spark, sf_dir, """SELECT doc_id, pos, 'VT_NHAN_' || k AS to_id, relation_type, CASE l_partkey % 4 WHEN 0 THEN 'khoảng $' || q || 'g$ một ngày' WHEN 1 THEN 'theo chỉ định' ELSE NULL END AS dosage,
      CASE l_partkey % 3 WHEN 0 THEN '$9ml$ nước, Nhẫn ' || k || ' $' || q || 'g$' WHEN 1 THEN 'uống $' || q || 'mg$' ELSE 'một $3g$ hai $4g$' END AS description FROM lines""")
    return R.extract_dosage(edges).select("doc_id", "pos", "dosage")


def _remedies(spark, sf_dir):
    edges = _lines(spark, sf_dir, "SELECT doc_id, pos, 'BT_B' || k || CASE WHEN l_partkey % 3 = 0 THEN '_HO_' || s ELSE '' END || CASE WHEN pos % 2 = 0 THEN '' ELSE '_X' END AS from_id, CASE flag WHEN 'R' THEN 'B_B' || s ELSE 'VT_' || k END AS to_id, relation_type FROM lines")
    twice = edges.unionByName(edges.select("doc_id", (F.col("pos") + 10).alias("pos"), "from_id", F.concat(F.lit("B_C"), F.col("pos").cast("string")).alias("to_id"), F.lit("CHU_TRI_BENH").alias("relation_type")))
    nodes = edges.select("doc_id", F.col("from_id").alias("id")).distinct()
    return R.rename_remedies(nodes, twice, _hubs(spark, sf_dir))


def rename_remedies(spark, sf_dir):
    return _remedies(spark, sf_dir)[1]


def rename_remedy_nodes(spark, sf_dir):
    return _remedies(spark, sf_dir)[0]


#: One id of each kind of damage, and what it becomes.
ATTRIBUTE_CASES = {
    "T_T_ON": "T_ON", "v_cay": "V_CAY", "T_CAY": "V_CAY", "T_CAY_ON": "T_ON", "T_KHONG_DOC": None, "K_TAM_BAO": "K_TAM_BAO", "K_KINH_THAN": "K_THAN", "V_VI_NGOT": "V_NGOT", "T_CO_TINH_HAN": "T_HAN",
    "V_CAY_CAY": "V_CAY", "V_CAY_DANG": "V_CAY", "T_VI_ON": "T_ON", "V_HAM": "V_HAM", "T_HOI_HAN": "T_HOI_HAN", "K_DAI_TRANG": "K_DAI_TRANG", "T_AN_THAN": None, "V_UNKNOWN": None, "T_MOI": "T_MOI", "CO_VI_CHUA": "V_CHUA", "": None,
}
_GIVEN = "[" + ", ".join(f"'{k}'" for k in ATTRIBUTE_CASES) + "]"
_CLEAN = "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in ATTRIBUTE_CASES.values()) + "]"
_N = len(ATTRIBUTE_CASES)


def _attribute(number):
    return F.element_at(F.array(*[F.lit(k) for k in ATTRIBUTE_CASES]), (number % _N + 1).cast("int"))


def clean_attribute_id(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.clean_attribute_id(_attribute(F.col("p_partkey"))).alias("id"))


def _attributes(spark, sf_dir):
    edges = _lines(spark, sf_dir, "SELECT doc_id, pos, 'VT_' || h AS from_id, l_partkey, CASE WHEN pos % 2 = 0 THEN 'co_vi' ELSE 'CO_TINH' END AS relation_type, flag AS description, q AS dosage FROM lines")
    edges = edges.withColumn("to_id", _attribute(F.col("l_partkey"))).drop("l_partkey")
    nodes = _lines(spark, sf_dir, "SELECT DISTINCT doc_id, 'VT_' || h AS id, 'ViThuoc' AS label, 'herb' AS name FROM lines UNION SELECT doc_id, 'T_CAY', 'x', 'y' FROM lines UNION SELECT doc_id, 'VT_unused', 'ViThuoc', 'z' FROM lines")
    return R.repair_attributes(nodes, edges, ["pos", "dosage"])


def repair_attributes(spark, sf_dir):
    return _attributes(spark, sf_dir)[1].select("doc_id", "from_id", "relation_type", "to_id", "description", "dosage", "pos")


def repair_attribute_nodes(spark, sf_dir):
    return _attributes(spark, sf_dir)[0]


def _patches(spark, sf_dir):
    return _lines(spark, sf_dir, """SELECT doc_id, pos, CASE l_partkey % 3 WHEN 0 THEN 'XOA_EDGE' ELSE 'THEM_EDGE' END AS action, CASE pos % 2 WHEN 0 THEN 'x' || s || '_BAI_THUOC' ELSE 'VT_' || s END AS from_id,
      CASE l_partkey % 7 WHEN 0 THEN 'T_ON' WHEN 1 THEN 'B_' || k WHEN 2 THEN 'S_' || k WHEN 3 THEN 'K_' || k WHEN 4 THEN 'chất ' || k WHEN 5 THEN 'HC_' || k ELSE NULL END AS to_id,
      CASE flag WHEN 'N' THEN 'co_chua_hoat_chat' WHEN 'R' THEN 'co_tac_dung_duoc_ly' ELSE 'co_tinh' END AS relation_type,
      CASE status WHEN 'F' THEN 'tính lạnh, dùng ' || q || ' g mỗi ngày' ELSE 'Bình $' || q || 'g$ ' || q || 'ml.' END AS description FROM lines""")


def sanitize_patches(spark, sf_dir):
    return R.sanitize_patches(_patches(spark, sf_dir), _hubs(spark, sf_dir))


def thermal_fix(spark, sf_dir):
    return R.thermal_fix(_patches(spark, sf_dir)).select("doc_id", "pos", "to_id")


def guard_deletes(spark, sf_dir):
    kept, refused = R.guard_deletes(_patches(spark, sf_dir))
    return kept.select("doc_id", "pos", F.lit("kept").alias("reason")).unionByName(refused.select("doc_id", "pos", "reason"))


def derive_source(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    pages = F.when(F.col("p_size") % 3 == 0, F.array(F.col("p_size"), F.lit(1))).when(F.col("p_size") % 3 == 1, F.array().cast("array<int>"))
    file = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("_VT.json"))).otherwise("VT.json")
    return R.derive_source(p.select(F.col("p_partkey").alias("doc_id"), file.alias("file"), pages.alias("pages")))


def force_source(spark, sf_dir):
    edges = load(spark, sf_dir, "edges_raw").select("doc_id", "pos", "source_id")
    own = load(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("CT_VT_VN_T"), F.col("o_orderkey").cast("string")).alias("source_id"))
    return R.force_source(edges, own)


def non_empty_segments(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ").alias("p_type"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("p_brand"))
    out = R.non_empty_segments(p, {"identity": ["p_name", "p_type"], "remedy": ["p_type", "p_brand"], "effects": ["p_brand"]}, "p_partkey")
    return out.select("p_partkey", "segment", F.col("fields")["p_brand"].alias("brand"))


def detect_headers(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    head = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("II. CÂY THUỐC BỔ\nVÀ CÂY MÁT\n\n"), F.col("p_name"))).when(F.col("p_size") % 4 == 1, "HÌNH MỘT\nPHÂN BỐ Ở ĐÂU\n  DÂY CỦ MÌ  \nCÂY KHÁC").when(F.col("p_size") % 4 == 2, "IV. A\nCAO CO\nBÒ CÔNG ANH").otherwise(F.col("p_name"))
    return R.detect_headers(p.select(F.col("p_partkey").alias("page"), F.concat(F.lit("\n \n"), head, F.lit("\nMỘT HAI")).alias("text")))


def validate_entity(spark, sf_dir):
    return _validated(spark, sf_dir)[0].select("doc_id", "entity_type", "id", "canonical_name", "scientific", "family", F.col("props")["thu_hai"].alias("harvest"), F.col("props")["other"].alias("other"))


def entity_issues(spark, sf_dir):
    return _validated(spark, sf_dir)[1].groupBy("doc_id", "level", "code").agg(F.count("*").alias("n"))


def _validated(spark, sf_dir):
    docs = spark.sql(
        """SELECT p_partkey AS doc_id, CASE WHEN c = 5 THEN NULL WHEN c = 1 THEN 'CAY' ELSE 'VI_THUOC' END AS entity_type,
          CASE c WHEN 0 THEN 'vt_' || k WHEN 1 THEN 'VI_THUOC_' || k WHEN 2 THEN '' WHEN 3 THEN 'VT_VAGUE' WHEN 4 THEN 'VI_THUOC_{{' || k END AS id,
          CASE WHEN c IN (0, 2) THEN p_name END AS raw_name, CASE WHEN c IN (1, 3) THEN p_name WHEN c < 5 THEN '' END AS canonical_name,
          CASE WHEN c = 1 THEN ' ' || p_brand WHEN c = 3 THEN '$x$' END AS scientific, CASE WHEN c = 4 THEN p_type END AS family,
          map('thu_hai', ' ' || p_type, 'other', p_type) AS props, CASE WHEN c = 2 THEN array('a', '', NULL) END AS sources
        FROM (SELECT *, p_partkey % 6 AS c, CAST(p_partkey AS STRING) AS k FROM {part})""",
        part=load(spark, sf_dir, "part"),
    )
    return R.validate_entity(docs, ONTOLOGY)


def merge_identity_edges(spark, sf_dir):
    first = _lines(spark, sf_dir, "SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN '' ELSE 'VT_Ô' || s END AS from_id, CASE pos % 4 WHEN 0 THEN 'VT_O' || s ELSE 'K_' || status END AS to_id, flag AS relation_type, 'a  b' || q AS description FROM lines WHERE status = 'F'")
    second = _lines(spark, sf_dir, "SELECT doc_id, pos, 'VT_O' || s AS from_id, CASE WHEN pos = 1 THEN NULL ELSE 'K_' || CASE WHEN pos = 2 THEN 'F' ELSE status END END AS to_id, CASE WHEN pos = 5 THEN '' ELSE flag END AS relation_type, q AS description FROM lines WHERE status = 'O'")
    return R.merge_identity_edges(first, second, _hubs(spark, sf_dir), R.derive_source(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("").alias("file"), F.array("o_orderkey").alias("pages"))))


def _integrity(spark, sf_dir):
    edges = load(spark, sf_dir, "edges_cyclic").withColumn("to_id", F.when(F.col("pos") % 50 == 0, "").otherwise(F.col("to_id")))
    nodes = edges.select("doc_id", F.col("from_id").alias("id")).union(edges.select("doc_id", F.lit("N_lonely"))).distinct().where("id <> 'N3'")
    rules = spark.createDataFrame([("CONTAINS", "N", "N"), ("TREATS", "X_", "")], "relation_type string, from_prefix string, to_prefix string")
    rules = rules.withColumns({c: F.when(F.col(c) == "N", "").otherwise(F.col(c)) for c in ("from_prefix", "to_prefix")})
    return R.document_integrity(nodes, edges, rules)


def document_integrity(spark, sf_dir):
    return _integrity(spark, sf_dir)


def integrity_totals(spark, sf_dir):
    docs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return R.integrity_totals(_integrity(spark, sf_dir), docs.where("doc_id < 0").unionByName(load(spark, sf_dir, "edges_cyclic").select("doc_id").union(docs)))


def _nested(spark, sf_dir):
    rows = load(spark, sf_dir, "edges_raw").groupBy(F.col("doc_id").alias("file")).agg(F.sort_array(F.collect_list(F.struct("pos", "from_id", "to_id", "relation_type", "source_id", "description", "confidence"))).alias("rows"))
    props, source = lambda x: F.create_map(F.lit("text"), x["description"]), lambda x: F.struct(x["source_id"].alias("source_id"))
    edge = lambda x: F.struct(x["from_id"].alias("from"), F.when(x["pos"] < 6, x["to_id"]).alias("to"), x["relation_type"].alias("relation_type"), source(x).alias("source"), props(x).alias("properties"), x["confidence"].alias("confidence_score"))
    node = lambda x: F.struct(F.when(x["pos"] < 5, x["to_id"]).alias("id"), F.lit("L").alias("label"), props(x).alias("properties"))
    claim = lambda x: F.struct(source(x).alias("source"), x["confidence"].alias("confidence_score"))
    return rows.select("file", F.transform("rows", edge).alias("relationships"), F.transform("rows", node).alias("nodes"), F.transform("rows", claim).alias("claims"))


def explode_edges(spark, sf_dir):
    return io.explode_edges(_nested(spark, sf_dir)).groupBy("doc_id", "from_id", "relation_type", "source_id").agg(F.count("*").alias("n"), F.max("to_id").alias("last_to"), F.count("confidence").alias("confident"))


def explode_nodes(spark, sf_dir):
    return io.explode_nodes(_nested(spark, sf_dir)).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.max(F.col("props")["text"]).alias("last_text"))


def explode_claims(spark, sf_dir):
    return io.explode_claims(_nested(spark, sf_dir)).groupBy("doc_id", "source_id").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def hub_id_from_name(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.hub_id_from_name(F.concat(F.when(F.col("p_size") % 2 == 0, "Cây ").otherwise("Vị thuốc "), F.lit("sâm "), "p_name")).alias("id"))


def wrap_units(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.wrap_units(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, " gam").when(F.col("p_size") % 3 == 1, "ml").otherwise(" kilogram"), F.lit(" của "), F.col("p_name"), F.lit(" $5g$"))).alias("text"))


def _on_lines(sql: str) -> str:
    """A DuckDB query over lines; sql is the select, or further tables before it after a comma."""
    return f"WITH {_LINES}{'' if sql.startswith(',') else ' '}{sql}"


_HEALED = """healed AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN 'BT_' || s ELSE 'VI_THUOC_' || h END AS from_id, flag, l_partkey % 8 AS c,
  CASE flag WHEN 'N' THEN 'VI_THUOC_' WHEN 'R' THEN 'B_' ELSE '' END AS p,
  CASE l_partkey % 8 WHEN 0 THEN k WHEN 1 THEN 'AN_' || k WHEN 2 THEN 'ON' WHEN 3 THEN k WHEN 4 THEN '' WHEN 5 THEN 'THUOC_' || k WHEN 6 THEN 'X' || k ELSE 'VAGUE' END AS core,
  (['VI_THUOC_', 'B_', 'T_', 'K_', '', 'B_', 'CN_', 'S_'])[l_partkey % 8 + 1] AS own, relation_type FROM lines)"""
_DOSE = """CASE WHEN relation_type <> 'BAO_GOM_VI_THUOC' THEN dosage WHEN l_partkey % 4 = 0 THEN '$' || q || 'g$' WHEN dosage IS NOT NULL THEN dosage
  WHEN l_partkey % 3 = 0 THEN '$' || q || 'g$' WHEN l_partkey % 3 = 1 THEN q || 'mg' END"""
_REMEDY = """e AS (SELECT doc_id, pos, 'BT_B' || k || CASE WHEN l_partkey % 3 = 0 THEN '_HO_' || s ELSE '' END || CASE WHEN pos % 2 = 0 THEN '' ELSE '_X' END AS from_id, CASE flag WHEN 'R' THEN 'B_B' || s ELSE 'VT_' || k END AS to_id, relation_type, h FROM lines),
  b AS (SELECT * FROM e UNION ALL SELECT doc_id, pos + 10, from_id, 'B_C' || pos, 'CHU_TRI_BENH', h FROM e),
  t AS (SELECT *, string_split(from_id, '_') AS w, relation_type = 'CHU_TRI_BENH' AND NOT contains(from_id, replace(to_id, 'B_', '')) AS bad FROM b),
  m AS (SELECT doc_id, from_id AS id, NOT bool_or(relation_type = 'BAO_GOM_VI_THUOC') AND bool_or(relation_type = 'CHU_TRI_BENH') AS orphan,
    arg_max('BT_' || replace(to_id, 'B_', '') || '_' || CASE WHEN len(w) > 2 THEN w[-2] || '_' || w[-1] ELSE 'GENERIC' END, (pos, to_id, w)) FILTER (WHERE bad) AS new_id FROM t GROUP BY 1, 2)"""
_MENDED = f"""e AS (SELECT doc_id, pos, 'VT_' || h AS from_id, ({_CLEAN})[l_partkey % {_N} + 1] AS to_id, flag, q FROM lines),
  f AS (SELECT *, CASE to_id[1] WHEN 'T' THEN 'CO_TINH' WHEN 'V' THEN 'CO_VI' ELSE 'QUY_KINH' END AS relation_type FROM e WHERE to_id IS NOT NULL),
  d AS (SELECT doc_id, from_id, relation_type, to_id, flag, min(pos) AS pos, arg_min(q, (pos, q)) AS q, min((pos, q)) AS o FROM f GROUP BY ALL)"""
_INTEGRITY = """ec AS (SELECT doc_id, pos, from_id, CASE WHEN pos % 50 = 0 THEN '' ELSE to_id END AS to_id, upper(relation_type) AS relation_type FROM edges_cyclic),
  w AS (SELECT * FROM ec WHERE to_id <> ''), nn AS (SELECT doc_id, from_id AS id FROM ec WHERE from_id <> 'N3' UNION SELECT doc_id, 'N_lonely' FROM ec),
  pairs AS (SELECT DISTINCT doc_id, from_id, to_id FROM w), reach AS (SELECT doc_id, from_id AS a, to_id AS b FROM pairs UNION SELECT r.doc_id, r.a, p.to_id FROM reach r JOIN pairs p ON p.doc_id = r.doc_id AND p.from_id = r.b),
  ends AS (SELECT doc_id, from_id AS id FROM w UNION SELECT doc_id, to_id FROM w),
  v AS (SELECT doc_id, 'dangling' AS kind, count(*) AS n FROM ec WHERE to_id = '' GROUP BY 1
    UNION ALL SELECT doc_id, 'cycle', count(*) FROM (SELECT DISTINCT doc_id, a FROM reach WHERE a = b) GROUP BY 1
    UNION ALL SELECT doc_id, 'schema', count(*) FROM w WHERE relation_type = 'TREATS' GROUP BY 1
    UNION ALL SELECT doc_id, 'schema', count(*) FROM ends WHERE (doc_id, id) NOT IN (SELECT (doc_id, id) FROM nn) GROUP BY 1
    UNION ALL SELECT doc_id, 'conflict', count(*) FROM w JOIN (SELECT doc_id, to_id AS from_id, from_id AS to_id, min(pos) AS r FROM w GROUP BY 1, 2, 3) USING (doc_id, from_id, to_id) WHERE pos > r AND from_id <> to_id GROUP BY 1
    UNION ALL SELECT doc_id, 'duplicate', sum(m - 1) FROM (SELECT doc_id, count(*) AS m FROM w GROUP BY doc_id, from_id, to_id, relation_type) WHERE m > 1 GROUP BY 1
    UNION ALL SELECT doc_id, 'orphan', count(*) FROM nn WHERE (doc_id, id) NOT IN (SELECT (doc_id, id) FROM ends) GROUP BY 1),
  vv AS (SELECT doc_id, kind, sum(n)::BIGINT AS n FROM v GROUP BY 1, 2)"""
_CASES = "c AS (SELECT *, p_partkey % 6 AS c, p_partkey::VARCHAR AS k FROM part)"
ORACLE = {
    "heal_edges": _on_lines(f""", {_HEALED} SELECT doc_id, pos, from_id, CASE WHEN flag = 'R' AND c = 1 THEN 'CN_' || core WHEN flag = 'R' AND c = 5 THEN 'B_' || core[7:] WHEN flag = 'A' THEN own || core ELSE p || core END AS to_id,
      CASE WHEN flag = 'R' AND c = 1 THEN 'CO_CONG_NANG' WHEN flag = 'A' AND c = 2 THEN 'CO_TINH' WHEN flag = 'A' AND c = 3 THEN 'QUY_KINH' ELSE relation_type END AS relation_type FROM healed WHERE c <> 4 AND NOT (c = 7 AND flag <> 'N')"""),
    "heal_issues": _on_lines(f""", {_HEALED} SELECT doc_id, 'FIXED' AS level, CASE WHEN c IN (4, 7) THEN 'PRUNE_VAGUE_ID' WHEN c = 1 THEN 'RECLASSIFY_FUNCTION' ELSE 'HEAL_HALLUCINATED_DISEASE' END AS code, count(*) AS n
      FROM healed WHERE c = 4 OR (c = 7 AND flag <> 'N') OR (flag = 'R' AND c IN (1, 5)) GROUP BY 1, 2, 3"""),
    "route_dna_edges": _on_lines("""SELECT doc_id, pos, 'VT_' || s AS from_id, 'K_' || k AS to_id, CASE WHEN pos % 4 = 0 THEN 'CO_TINH' ELSE relation_type END AS relation_type, CASE l_partkey % 5 WHEN 0 THEN 'Có lẽ' WHEN 1 THEN 'dựa trên công năng' ELSE q END AS description,
      CASE WHEN l_partkey % 3 = 0 AND flag <> 'A' THEN 'Chưa rõ (Theo nguyên tác)' WHEN l_partkey % 3 = 0 THEN 'Chưa rõ' ELSE q END AS dosage FROM lines WHERE l_partkey % 11 <> 0 AND pos <> 4 AND (flag = 'A' OR l_partkey % 5 <> 0)"""),
    "extract_dosage": _on_lines(f"SELECT doc_id, pos, {_DOSE} AS dosage FROM (SELECT *, CASE l_partkey % 4 WHEN 0 THEN 'khoảng $' || q || 'g$ một ngày' WHEN 1 THEN 'theo chỉ định' END AS dosage FROM lines)"),
    "rename_remedies": _on_lines(f""", {_REMEDY} SELECT b.doc_id, b.pos, CASE WHEN a.orphan THEN 'VI_THUOC_' || h ELSE coalesce(a.new_id, b.from_id) END AS from_id, b.to_id, b.relation_type
      FROM b JOIN m a ON a.doc_id = b.doc_id AND a.id = b.from_id WHERE NOT a.orphan OR b.relation_type = 'CHU_TRI_BENH'"""),
    "rename_remedy_nodes": _on_lines(f", {_REMEDY} SELECT doc_id, coalesce(new_id, id) AS id FROM m WHERE NOT orphan"),
    "clean_attribute_id": f"SELECT p_partkey, ({_CLEAN})[p_partkey % {_N} + 1] AS id FROM part",
    "repair_attributes": _on_lines(f", {_MENDED} SELECT doc_id, from_id, relation_type, to_id, string_agg(flag, ' | ' ORDER BY o, flag) AS description, arg_min(q, (o, flag)) AS dosage, min(pos) AS pos FROM d GROUP BY 1, 2, 3, 4"),
    "repair_attribute_nodes": _on_lines(f", {_MENDED} SELECT DISTINCT doc_id, from_id AS id, 'ViThuoc' AS label, 'herb' AS name FROM f UNION SELECT doc_id, to_id, CASE WHEN to_id LIKE 'K%' THEN 'KinhMach' ELSE 'TinhVi' END, array_to_string(list_transform(string_split(lower(to_id[3:]), '_'), lambda w: upper(w[1]) || w[2:]), ' ') FROM f"),
    "sanitize_patches": _on_lines("""SELECT doc_id, pos, CASE l_partkey % 3 WHEN 0 THEN 'XOA_EDGE' ELSE 'THEM_EDGE' END AS action, CASE pos % 2 WHEN 0 THEN 'x' || s || '_BAI_THUOC' ELSE 'VI_THUOC_' || h END AS from_id,
      CASE WHEN l_partkey % 7 = 6 THEN NULL WHEN flag = 'N' AND l_partkey % 7 <> 5 THEN 'HC_' || t WHEN flag = 'R' THEN 'DL_' || t WHEN l_partkey % 7 = 4 THEN 'chất ' || k ELSE t END AS to_id,
      CASE flag WHEN 'N' THEN 'CO_CHUA_HOAT_CHAT' WHEN 'R' THEN 'CO_TAC_DUNG_DUOC_LY' ELSE 'CO_TINH' END AS relation_type, CASE status WHEN 'F' THEN 'tính lạnh, dùng $' || q || 'g$ mỗi ngày' ELSE 'Bình $' || q || 'g$ $' || q || 'ml$.' END AS description
      FROM (SELECT *, CASE l_partkey % 7 WHEN 0 THEN 'T_ON' WHEN 1 THEN 'B_' || k WHEN 2 THEN 'S_' || k WHEN 3 THEN 'K_' || k WHEN 4 THEN 'CHAT_' || k WHEN 5 THEN 'HC_' || k END AS t FROM lines)"""),
    "thermal_fix": _on_lines("""SELECT doc_id, pos, CASE WHEN (l_partkey % 7 = 0 OR flag = 'A') THEN CASE status WHEN 'F' THEN 'T_HAN' ELSE 'T_BINH' END
      ELSE CASE l_partkey % 7 WHEN 1 THEN 'B_' || k WHEN 2 THEN 'S_' || k WHEN 3 THEN 'K_' || k WHEN 4 THEN 'chất ' || k WHEN 5 THEN 'HC_' || k END END AS to_id FROM lines"""),
    "guard_deletes": _on_lines("SELECT doc_id, pos, CASE WHEN l_partkey % 3 <> 0 THEN 'kept' WHEN l_partkey % 7 IN (1, 2) THEN 'detail' WHEN l_partkey % 7 IN (0, 3) THEN 'attribute' ELSE 'kept' END AS reason FROM lines"),
    "derive_source": "SELECT p_partkey AS doc_id, p AS page, 'CT_VT_VN_T' || p AS source_id FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR WHEN p_size % 2 = 0 THEN p_partkey::VARCHAR ELSE '0' END AS p FROM part)",
    "force_source": oracle(("edges_raw",), "SELECT doc_id, pos, CASE WHEN doc_id % 2 = 0 THEN 'CT_VT_VN_T' || doc_id ELSE source_id END AS source_id FROM edges_raw"),
    "non_empty_segments": """WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS t, p_size % 3 = 0 AS b, CASE WHEN p_size % 3 = 0 THEN p_brand END AS brand FROM part)
      SELECT p_partkey, 'identity' AS segment, NULL AS brand FROM p UNION ALL SELECT p_partkey, 'remedy', brand FROM p WHERE t OR b UNION ALL SELECT p_partkey, 'effects', brand FROM p WHERE b""",
    "detect_headers": """SELECT p_partkey AS page, CASE WHEN p_size % 4 = 0 THEN 'II. CÂY THUỐC BỔ VÀ CÂY MÁT' END AS "group", CASE p_size % 4 WHEN 0 THEN 'VA_CAY_MAT' WHEN 1 THEN 'DAY_CU_MI' WHEN 2 THEN 'BO_CONG_ANH' ELSE 'MOT_HAI' END AS entity_id,
      CASE p_size % 4 WHEN 0 THEN 'VÀ CÂY MÁT' WHEN 1 THEN 'DÂY CỦ MÌ' WHEN 2 THEN 'BÒ CÔNG ANH' ELSE 'MỘT HAI' END AS entity_name FROM part""",
    "validate_entity": f"""WITH {_CASES} SELECT p_partkey AS doc_id, CASE WHEN c < 5 THEN 'VI_THUOC' END AS entity_type, CASE c WHEN 0 THEN 'VI_THUOC_' || k WHEN 1 THEN 'VI_THUOC_' || k WHEN 2 THEN '' WHEN 3 THEN 'VT_VAGUE' WHEN 4 THEN 'VI_THUOC_{{' || k END AS id,
      CASE WHEN c < 4 THEN p_name WHEN c = 4 THEN 'VI_THUOC_{{' || k END AS canonical_name, CASE WHEN c = 1 THEN '$' || p_brand || '$' WHEN c = 3 THEN '$x$' END AS scientific, CASE WHEN c = 4 THEN '$' || p_type || '$' END AS family,
      CASE WHEN c = 5 THEN ' ' || p_type ELSE lower(p_type) END AS harvest, p_type AS other FROM c""",
    "entity_issues": f"""WITH {_CASES}, i AS (SELECT p_partkey AS doc_id, unnest(CASE c WHEN 0 THEN ['F ID_UNIFICATION', 'F MISSING_CANONICAL'] WHEN 1 THEN ['F INVALID_ENTITY_TYPE', 'F MISSING_LATEX_SCINAME'] WHEN 2 THEN ['E MISSING_ID', 'F MISSING_CANONICAL', 'E MISSING_SOURCE_ID', 'E MISSING_SOURCE_ID']
      WHEN 3 THEN ['E MISSING_ID'] WHEN 4 THEN ['F MISSING_CANONICAL', 'F MISSING_LATEX_SCINAME', 'E INVALID_CHARS'] ELSE ['E MISSING_ENTITY'] END) AS i FROM c)
      SELECT doc_id, CASE i[1] WHEN 'E' THEN 'ERROR' ELSE 'FIXED' END AS level, i[3:] AS code, count(*) AS n FROM i GROUP BY 1, 2, 3""",
    "merge_identity_edges": _on_lines(""", e AS (SELECT doc_id, pos, 1 AS stage, CASE WHEN pos % 3 = 0 THEN 'VI_THUOC_' || h ELSE 'VT_O' || s END AS from_id, CASE pos % 4 WHEN 0 THEN 'VT_O' || s ELSE 'K_F' END AS to_id, flag AS relation_type, 'a b' || q AS description FROM lines WHERE status = 'F'
        UNION ALL SELECT doc_id, pos, 2, 'VT_O' || s, 'K_' || CASE WHEN pos = 2 THEN 'F' ELSE 'O' END, flag, q FROM lines WHERE status = 'O' AND pos NOT IN (1, 5)),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, from_id, to_id, relation_type ORDER BY stage, pos, description) AS k FROM e WHERE from_id <> to_id)
      SELECT doc_id, pos, from_id, to_id, relation_type, description, 'CT_VT_VN_T' || doc_id AS source_id FROM r WHERE k = 1"""),
    "document_integrity": oracle(("edges_cyclic",), f"WITH RECURSIVE {_INTEGRITY} SELECT * FROM vv"),
    "integrity_totals": oracle(("edges_cyclic",), f"""WITH RECURSIVE {_INTEGRITY}, ids AS (SELECT o_orderkey AS doc_id FROM orders UNION SELECT doc_id FROM edges_cyclic) SELECT kind, sum(n)::BIGINT AS n FROM vv GROUP BY 1
      UNION ALL SELECT 'passed', count(*) FROM ids WHERE doc_id NOT IN (SELECT doc_id FROM vv) UNION ALL SELECT 'failed', count(*) FROM ids WHERE doc_id IN (SELECT doc_id FROM vv)"""),
    "explode_edges": oracle(("edges_raw",), "SELECT doc_id, from_id, relation_type, source_id, count(*) AS n, max(to_id) AS last_to, count(confidence) AS confident FROM edges_raw WHERE pos < 6 GROUP BY 1, 2, 3, 4"),
    "explode_nodes": oracle(("edges_raw",), "SELECT doc_id, 'L' AS label, count(*) AS n, max(description) AS last_text FROM edges_raw WHERE pos < 5 GROUP BY 1"),
    "explode_claims": oracle(("edges_raw",), "SELECT doc_id, source_id, count(*) AS n, round(sum(confidence), 4)::DOUBLE AS confidence FROM edges_raw GROUP BY 1, 2"),
    "hub_id_from_name": "SELECT p_partkey, 'VI_THUOC_SAM_' || upper(replace(p_name, ' ', '_')) AS id FROM part",
    "wrap_units": "SELECT p_partkey, '$' || p_size || CASE p_size % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'kg' END || '$ của ' || p_name || ' $5g$' AS text FROM part",
}
QUERIES = {
    f.__name__: f
    for f in (heal_edges, heal_issues, route_dna_edges, extract_dosage, rename_remedies, rename_remedy_nodes, clean_attribute_id, repair_attributes, repair_attribute_nodes, sanitize_patches, thermal_fix, guard_deletes, derive_source, force_source, non_empty_segments, detect_headers, validate_entity, entity_issues, merge_identity_edges, document_integrity, integrity_totals, explode_edges, explode_nodes, explode_claims, hub_id_from_name, wrap_units)
}
