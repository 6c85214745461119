"""Repair of entity documents before they become a graph: sources, segments, headers, edges, patches, remedies, attributes.

edges: doc_id, pos, from_id, to_id, relation_type, description, dosage and more; hubs: doc_id, hub_id. Each job works document by
document, with joins and aggregations on doc_id and ids; a document's rows are never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import clean_attribute_id, label_from_prefix, name_from_id, normalize_id, normalize_plain_id, normalize_prefix, strip_accents
from kgspark.sources.shared import materialize

from .curate import CONTAINS, DNA, EDGE_KEY, INFERRED_DNA, INFERRED_OTHER, TREATS, any_phrase, apply_patches, cycles, fold_texts, merge_edges

FUNCTION, CONTAINS_COMPOUND, ACTS = "CO_CONG_NANG", "CO_CHUA_HOAT_CHAT", "CO_TAC_DUNG_DUOC_LY"


@dataclass(frozen=True)
class Ontology:
    """What documents are checked against, given by the user.

    required: the prefix that a relation's target must have; vague: ids and cores that name nothing; functions and
    function_prefixes: cores that are functions, not illnesses.
    """

    required: Mapping[str, str]
    vague: Sequence[str] = ()
    function_prefixes: Sequence[str] = ()
    functions: Sequence[str] = ()
    entity_types: Sequence[str] = ("VI_THUOC",)
    synonyms: Mapping[str, str] = field(default_factory=dict)


def _lookup(key: Column, values: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _one_of(c: Column, values: Sequence[str]) -> Column:
    return c.isin(*values) if values else F.lit(False)


def _issues(*found: tuple[Column, str, str]) -> Column:
    """An array of (level, code) of those whose condition holds."""
    rows = F.array(*[F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for when, level, code in found])
    return F.filter(rows, lambda r: r.isNotNull())


# edges


def heal_edges(edges: DataFrame, hubs: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """(edges, issues): ids in the curation form, and wrong types and targets put right, before edges are merged.

    An edge starts at the hub unless it starts at a remedy. The target gets the prefix that its relation requires; vague
    targets go. Of a treatment, THUOC_ goes from the target, and a target that is a function becomes one; an attribute id
    sets the relation of a function edge, and of an edge whose target's prefix isn't the required one. issues: doc_id, from_id,
    to_id, level, code.
    """
    start, own = normalize_prefix(F.col("from_id"), synonyms=dict(ontology.synonyms)), normalize_prefix(F.col("hub_id"), synonyms=dict(ontology.synonyms))
    required = lambda kind: _lookup(kind, ontology.required)
    e = edges.join(hubs.select("doc_id", "hub_id"), "doc_id", "left")
    e = e.withColumns({"_from": start, "_hub": own, "_to": normalize_prefix(F.col("to_id"), required(F.col("relation_type")), dict(ontology.synonyms))})
    # Unfolded from an array of one, so that what the ids become is worked out once: a filter on it would be pushed below the join and work it out again.
    e = e.select(*edges.columns, "hub_id", F.inline(F.array(F.struct("_from", "_hub", "_to"))))
    rest = lambda c: F.when(c.contains("_"), F.regexp_replace(c, "^[^_]*_", "")).otherwise(c)
    e = e.withColumn("_from", F.when((F.col("_from") == F.col("_hub")) | F.col("_from").startswith("BT_"), F.col("_from")).otherwise(F.coalesce("hub_id", "_from")))
    e = e.withColumn("_to", F.regexp_replace("_to", "^VT_", "VI_THUOC_"))
    vague = (F.trim(F.coalesce("to_id", F.lit(""))) == "") | _one_of(F.col("_to"), ontology.vague) | _one_of(F.upper(rest(F.col("_to"))), ontology.vague)
    kind = F.col("_kind")
    treats = kind.isin(*TREATS)
    e = e.withColumns({"_kind": F.coalesce("relation_type", F.lit("")), "_vague": vague})
    e = e.withColumn("_wrong", treats & F.col("_to").contains("THUOC_"))
    e = e.withColumn("_to", F.when(F.col("_wrong"), F.replace("_to", F.lit("THUOC_"), F.lit(""))).otherwise(F.col("_to")))
    by_target = lambda: F.when(F.col("_to").startswith("K_"), "QUY_KINH").when(F.col("_to").startswith("T_"), "CO_TINH").when(F.col("_to").startswith("V_"), "CO_VI").otherwise(kind)
    e = e.withColumn("_kind", F.when(kind == FUNCTION, by_target()).otherwise(kind)).withColumn("_core", F.upper(rest(F.col("_to"))))
    is_function = _one_of(F.col("_core"), ontology.functions)
    for p in ontology.function_prefixes:
        is_function |= F.col("_core").startswith(p)
    e = e.withColumn("_function", treats & is_function)
    e = e.withColumns({"_to": F.when(F.col("_function"), F.concat(F.lit("CN_"), "_core")).otherwise(F.col("_to")), "_kind": F.when(F.col("_function"), FUNCTION).otherwise(kind)})
    needed = required(kind)
    e = e.withColumn("_kind", F.when(needed.isNotNull() & ~F.col("_to").startswith(needed), by_target()).otherwise(kind))
    found = F.when(F.col("_vague"), _issues((F.lit(True), "FIXED", "PRUNE_VAGUE_ID"))).otherwise(_issues((F.col("_wrong"), "FIXED", "HEAL_HALLUCINATED_DISEASE"), (F.col("_function"), "FIXED", "RECLASSIFY_FUNCTION")))
    healed = e.where(~F.col("_vague")).withColumns({"from_id": F.col("_from"), "to_id": F.col("_to"), "relation_type": F.col("_kind")}).select(*edges.columns)
    return healed, e.select("doc_id", F.col("_from").alias("from_id"), F.col("_to").alias("to_id"), F.explode(found).alias("i")).select("doc_id", "from_id", "to_id", "i.*")


#: What stands for an unknown dosage, and what it becomes.
UNCLEAR_DOSAGE = ("chưa rõ", "không đề cập liều", "không ghi liều", "không có thông tin")
DOSAGE_UNKNOWN = "Chưa rõ (Theo nguyên tác)"


def route_dna_edges(edges: DataFrame, secondary: Column) -> DataFrame:
    """Edges that a fragment may bring: attribute edges not from a secondary one, none with an inferring phrase.

    Ends become plain ids, types upper case; edges without an end or a type go. Treatment and containment edges with a word for an
    unknown dosage get the one text for it.
    """
    kind, low = F.upper(F.coalesce("relation_type", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    clinical = kind.isin(*TREATS, CONTAINS)
    bad = (kind.isin(*DNA) & (secondary | any_phrase(low, INFERRED_DNA))) | (clinical & any_phrase(low, INFERRED_OTHER))
    unclear = clinical & any_phrase(F.lower(F.coalesce("dosage", F.lit(""))), UNCLEAR_DOSAGE)
    there = (F.coalesce("from_id", F.lit("")) != "") & (F.coalesce("to_id", F.lit("")) != "") & (kind != "")
    kept = edges.where(there & ~bad)
    return kept.withColumns({"from_id": normalize_id(F.col("from_id")), "to_id": normalize_id(F.col("to_id")), "relation_type": kind, "dosage": F.when(unclear, DOSAGE_UNKNOWN).otherwise(F.col("dosage"))})


#: Dosages that are words alone, and how a dosage is marked in a text.
WORD_DOSAGES = ("không rõ", "theo chỉ định", "tùy chỉnh", "lượng bằng nhau")
MARKED_DOSAGE = r"\$(\d+[\d\.,-]*\s*[a-zA-Z%°C/\\^]*|đồng cân|chỉ|lạng|phân|tễ|thang)\$"


def extract_dosage(edges: DataFrame, reach: int = 60) -> DataFrame:
    """Containment edges with their dosage cut to its marked span, or looked up in the description where it is empty.

    Looked up: the first marked one within reach characters from the herb's name on (accents and case don't matter), else the only one
    that the description has, without its marks.
    """
    now, text = F.coalesce("dosage", F.lit("")), F.coalesce("description", F.lit(""))
    span = F.regexp_extract(now, r"(?s)\$.*\$", 0)
    cut = F.when(F.lower(F.trim(now)).isin(*WORD_DOSAGES) | (span == ""), now).otherwise(span)
    name = F.lower(strip_accents(F.replace(F.replace(F.replace(F.coalesce("to_id", F.lit("")), F.lit("VI_THUOC_"), F.lit("")), F.lit("VT_"), F.lit("")), F.lit("_"), F.lit(" "))))
    e = edges.withColumns({"_cut": cut, "_at": F.position(name, F.lower(strip_accents(text)))})
    near = F.when(F.col("_at") > 0, F.regexp_extract(text.substr(F.col("_at"), F.lit(reach)), MARKED_DOSAGE, 0)).otherwise("")
    every = F.regexp_extract_all(text, F.lit(MARKED_DOSAGE), F.lit(1))
    looked_up = F.when(near != "", near).when(F.size(every) == 1, F.get(every, F.lit(0)))
    new = F.when(F.col("_cut") != "", F.col("_cut")).otherwise(F.coalesce(looked_up, F.col("dosage")))
    return e.withColumn("dosage", F.when(F.col("relation_type") == CONTAINS, new).otherwise(F.col("dosage"))).drop("_cut", "_at")


# remedies


def rename_remedies(nodes: DataFrame, edges: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): within each document, remedies named after what they treat, and none without ingredients.

    nodes: doc_id, id. A remedy that treats something and contains nothing goes: what it treats, the hub treats; its other edges are
    dropped. A remedy whose id doesn't hold the illness of a treatment edge (the last such one counts, by pos) gets a new id of that
    illness and its own last two words.
    """
    is_remedy, kind = F.col("from_id").startswith("BT_"), F.col("relation_type")
    illness = F.col("to_id")
    for p in ("B_", "NHOMBENH_", "S_"):
        illness = F.replace(illness, F.lit(p), F.lit(""))
    words = F.split("from_id", "_")
    own = F.when(F.size(words) > 2, F.array_join(F.slice(words, -2, 2), "_")).otherwise("GENERIC")
    misnamed = kind.isin(*TREATS) & ~F.col("from_id").contains(illness)
    new_id = F.concat(F.lit("BT_"), illness, F.lit("_"), own)
    filled, treats, last = F.bool_or(kind == CONTAINS), F.bool_or(kind.isin(*TREATS)), F.max(F.when(misnamed, F.struct("pos", new_id.alias("id"))))
    # Edges and hubs meet by document first; the windows of a document's remedies, the keys of which hold the document, need no exchange after that.
    own_edges = Window.partitionBy("doc_id", "from_id")
    told = edges.join(hubs.select("doc_id", "hub_id"), "doc_id", "left").withColumns({"_treats": treats.over(own_edges), "_filled": filled.over(own_edges), "_last": last.over(own_edges)["id"]})
    # Ids of no document meet no others.
    orphan = F.coalesce(is_remedy & F.col("doc_id").isNotNull() & F.col("_treats") & ~F.col("_filled"), F.lit(False))
    told = told.withColumns({"_orphan": orphan, "_new": F.when(is_remedy & F.col("doc_id").isNotNull() & ~orphan, F.col("_last"))})
    e = told.where(~F.col("_orphan") | kind.isin(*TREATS))
    # Only a remedy has a new id, so edges to anything else have nothing to look up, and where none leads to a remedy nothing is shuffled for it.
    known = edges.where(is_remedy).groupBy("doc_id", F.col("from_id").alias("id")).agg(filled.alias("filled"), treats.alias("treats"), last["id"].alias("new_id"))
    known = known.select("doc_id", "id", (F.col("treats") & ~F.col("filled")).alias("orphan"), "new_id").withColumn("new_id", F.when(~F.col("orphan"), F.col("new_id")))
    to_remedy = F.coalesce(F.col("to_id").startswith("BT_"), F.lit(False))
    nothing = F.lit(None).cast("string")
    if edges.where(to_remedy).isEmpty():
        e = e.withColumn("_to", nothing)
    else:
        end = known.where("new_id is not null").select("doc_id", F.col("id").alias("to_id"), F.col("new_id").alias("_to"))
        e = e.where(~to_remedy).withColumn("_to", nothing).unionByName(e.where(to_remedy).join(end, ["doc_id", "to_id"], "left"))
    e = e.withColumns({"from_id": F.when(F.col("_orphan"), F.col("hub_id")).otherwise(F.coalesce("_new", "from_id")), "to_id": F.when(F.col("_orphan"), F.col("to_id")).otherwise(F.coalesce("_to", "to_id"))})
    gone = F.coalesce("_orphan", F.lit(False))
    n = nodes.join(known.select("doc_id", "id", F.col("orphan").alias("_orphan"), "new_id"), ["doc_id", "id"], "left").where(~gone)
    return n.withColumn("id", F.coalesce("new_id", "id")).select(*nodes.columns), e.select(*edges.columns)


def patch_documents(nodes: DataFrame, edges: DataFrame, patches: DataFrame, hubs: DataFrame, order: Sequence[str] = ("pos",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after patches and all that follows them: remedies named after what they treat, one edge a key, a node for each end.

    nodes: doc_id, id, label, name. edges: as apply_patches has them. hubs: doc_id, hub_id. Missing nodes are made within each document.
    """
    nodes, edges = apply_patches(nodes, edges, patches)
    nodes, edges = rename_remedies(nodes, edges, hubs)
    plain = lambda c: F.lit(None).cast(c)
    merged = merge_edges(edges.withColumns({"dosage": plain("string"), "source_id": plain("string"), "confidence": plain("double")}), order, ("doc_id", *EDGE_KEY))
    ends = merged.select("doc_id", F.col("from_id").alias("id")).union(merged.select("doc_id", "to_id")).distinct()
    filled = merged.where(F.col("relation_type") == CONTAINS).select("doc_id", F.col("from_id").alias("id")).distinct()
    missing = ends.join(nodes.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    remedy = F.col("id").startswith("BT_")
    made = missing.where(~remedy).unionByName(missing.where(remedy).join(filled, ["doc_id", "id"], "left_semi"))
    made = made.select("doc_id", "id", label_from_prefix(F.col("id")).alias("label"), F.lower(name_from_id(F.col("id"))).alias("name"))
    return nodes.select("doc_id", "id", "label", "name").unionByName(made), merged


# attributes


def _title(id_: Column) -> Column:
    return F.initcap(F.lower(F.replace(F.regexp_replace(id_, "^[^_]*_", ""), F.lit("_"), F.lit(" "))))


def _attribute_label(id_: Column) -> Column:
    return F.when(id_.rlike("^[TV]_"), "TinhVi").when(id_.startswith("K_"), "KinhMach")


def repair_attributes(nodes: DataFrame, edges: DataFrame, order: Sequence[str] = ("pos",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents with repaired nature, taste and meridian ids. order: columns that order a document's edges.

    nodes: doc_id, id, label, name. Edges whose target says nothing go; the others' type follows the target, and equal edges of a
    document become one, the first, with their descriptions folded in order. Attribute nodes are named and labelled by
    their id; of equal ids one stays. Nodes that no edge uses go, attribute nodes that edges need are made.
    """
    kind, attribute = F.upper(F.coalesce("relation_type", F.lit(""))), lambda c: F.col(c).rlike("^[TVK]_")
    todo = kind.isin(*DNA) | attribute("to_id")
    e = edges.withColumns({"relation_type": kind, "_clean": F.when(todo, clean_attribute_id(F.col("to_id"))).otherwise(F.col("to_id")), "_todo": todo}).where("_clean is not null")
    by_target = F.when(F.col("_clean").startswith("T_"), "CO_TINH").when(F.col("_clean").startswith("V_"), "CO_VI").when(F.col("_clean").startswith("K_"), "QUY_KINH").otherwise(F.col("relation_type"))
    e = e.withColumns({"to_id": F.col("_clean"), "relation_type": F.when(F.col("_todo"), by_target).otherwise(F.col("relation_type"))}).drop("_clean", "_todo")
    keys = ["doc_id", "from_id", "relation_type", "to_id"]
    rest = [c for c in edges.columns if c not in keys and c != "description"]
    # Distinct descriptions by their first place: the fold sees each once.
    texts = e.groupBy(*keys, F.coalesce("description", F.lit("")).alias("description")).agg(F.min(F.struct(*order)).alias("_pos"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_rest"))
    one = texts.groupBy(*keys).agg(F.min_by("_rest", "_pos").alias("_rest"), F.sort_array(F.collect_list(F.struct("_pos", "description"))).alias("_parts"))
    merged = one.select(*keys, fold_texts(F.transform("_parts", lambda p: p["description"])).alias("description"), "_rest.*").select(*edges.columns)
    # Of the edges as they are: merging them changes no end.
    used = e.select("doc_id", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id")).distinct()
    plain = nodes.where(~attribute("id")).select("doc_id", "id", "label", "name")
    mended = nodes.where(attribute("id")).select("doc_id", clean_attribute_id(F.col("id")).alias("id")).where("id is not null")
    made = used.where(attribute("id"))
    attributes = mended.union(made).distinct().select("doc_id", "id", _attribute_label(F.col("id")).alias("label"), _title(F.col("id")).alias("name"))
    out = plain.groupBy("doc_id", "id").agg(F.max_by(F.struct("label", "name"), F.struct("label", "name")).alias("_n")).select("doc_id", "id", "_n.*")
    return out.unionByName(attributes).join(used, ["doc_id", "id"], "left_semi"), merged


# patches


#: Units that a patch's text may have, and words for warmth in the order they are looked for.
PATCH_UNITS = ("g", "ml", "%", "°C", "mm", "cm", "bát", "ống", "muỗng", "phần")
WARMTH = {"HÀN": "T_HAN", "LẠNH": "T_HAN", "LƯƠNG": "T_LUONG", "MÁT": "T_LUONG", "BÌNH": "T_BINH", "ÔN": "T_ON", "ẤM": "T_ON", "NHIỆT": "T_NHIET", "NÓNG": "T_NHIET"}


def sanitize_patches(patches: DataFrame, hubs: DataFrame) -> DataFrame:
    """patches (doc_id, from_id, to_id, relation_type, description) put in form.

    They start at the hub unless they start at a remedy, types are upper case, targets of compounds and effects get their prefix,
    numbers with a unit are marked as $10g$ unless that is done.
    """
    p = patches.join(hubs.select("doc_id", "hub_id"), "doc_id", "left")
    kind, to = F.upper("relation_type"), F.coalesce("to_id", F.lit(""))
    prefixed = to
    for relation, prefix in ((CONTAINS_COMPOUND, "HC_"), (ACTS, "DL_")):
        prefixed = F.when((kind == relation) & (to != "") & ~to.startswith(prefix), F.concat(F.lit(prefix), normalize_id(to))).otherwise(prefixed)
    marked = F.regexp_replace("description", rf"(?<!\$)(?<!\w)(\d+[\d.,-]*)\s*({'|'.join(sorted(PATCH_UNITS, key=len, reverse=True))})(?!\w)(?!\$)", r"\$$1$2\$")
    start = F.when(F.coalesce("from_id", F.lit("")).contains("_BAI_THUOC"), F.col("from_id")).otherwise(F.coalesce("hub_id", "from_id"))
    return p.withColumns({"from_id": start, "relation_type": kind, "to_id": F.when(F.col("to_id").isNotNull(), prefixed), "description": marked}).select(*patches.columns)


def thermal_fix(patches: DataFrame) -> DataFrame:
    """Patches of a nature with the id that the first word for warmth in their description asks for."""
    up, nature = F.upper(F.coalesce("description", F.lit(""))), F.coalesce(F.col("to_id").startswith("T_"), F.lit(False)) | (F.upper(F.coalesce("relation_type", F.lit(""))) == "CO_TINH")
    said = F
    for word, id_ in WARMTH.items():
        said = said.when(up.contains(word), id_)
    return patches.withColumn("to_id", F.when(nature, F.coalesce(said.otherwise(F.lit(None).cast("string")), "to_id")).otherwise(F.col("to_id")))


def guard_deletes(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches, refused): deletes of edges to an illness or symptom ("detail") or to an attribute ("attribute") are refused."""
    to, delete = F.coalesce("to_id", F.lit("")), F.coalesce(F.col("action") == "XOA_EDGE", F.lit(False))
    marked = patches.withColumn("reason", F.when(delete & to.rlike("^[SB]_"), "detail").when(delete & to.rlike("^[VTK]_"), "attribute"))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


# documents


def derive_source(docs: DataFrame, prefix: str = "CT_VT_VN_T") -> DataFrame:
    """doc_id, page, source_id: a document's first page, else the first number in its file's name, else 0.

    docs: doc_id, file, pages (array).
    """
    number = F.regexp_extract(F.coalesce("file", F.lit("")), r"(\d+)", 1)
    page = F.coalesce(F.get("pages", F.lit(0)).cast("string"), F.when(number != "", number), F.lit("0"))
    return docs.select("doc_id", page.alias("page"), F.concat(F.lit(prefix), page).alias("source_id"))


def force_source(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges with the source of their document, whatever they say themselves."""
    own = sources.select("doc_id", F.col("source_id").alias("_source"))
    return edges.join(own, "doc_id", "left").withColumn("source_id", F.coalesce("_source", "source_id")).select(*edges.columns)


def non_empty_segments(docs: DataFrame, segments: Mapping[str, Sequence[str]], key: str = "doc_id") -> DataFrame:
    """key, segment and fields (map) of each segment of a document of which at least one text field isn't blank.

    segments: the text columns that each segment has.
    """
    rows = [F.struct(F.lit(name).alias("segment"), F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))]).alias("fields")) for name, columns in segments.items()]
    each = docs.select(key, F.explode(F.array(*rows)).alias("s")).select(key, "s.*")
    return each.where(F.exists(F.map_values("fields"), lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))


def validate_entity(docs: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """(docs, issues): checked and mended entities.

    docs: doc_id, entity_type, id, raw_name, canonical_name, scientific, family, props (map), sources (array, one a claim). Without
    any of the first four and scientific and family the entity is missing. issues: doc_id, level, code.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    missing = F.coalesce("entity_type", "id", "raw_name", "canonical_name", "scientific", "family").isNull()
    known = sorted({*ontology.required.values(), "VI_THUOC_", "BAI_THUOC_", "BT_", "VT_", "B_THUOC_", "S_THUOC_", "TRIEU_CHUNG_", "BENH_LY_", "BENH_"} - {""}, key=lambda p: (-len(p), p))
    core = F.regexp_replace(strip_accents(F.regexp_replace(F.upper(text("id")), f"^({'|'.join(known)})", "")), "^_+|_+$", "")
    d = docs.withColumns({"_missing": missing, "_id": F.when(text("id") == "", "").otherwise(F.concat(F.lit("VI_THUOC_"), core))})
    there = ~F.col("_missing")
    bad_type = there & ~_one_of(text("entity_type"), ontology.entity_types)
    no_id = there & ((text("id") == "") | _one_of(F.substring_index("_id", "_", -1), ontology.vague))
    other_id = there & ~no_id & (text("id") != F.col("_id"))
    no_name = there & (text("canonical_name") == "")
    unmarked = lambda c: there & (text(c) != "") & ~text(c).startswith("$")
    final_id = F.when(other_id, F.col("_id")).otherwise(F.col("id"))
    forbidden = there & F.coalesce(final_id, F.lit("")).rlike(r'[<>"{}\[\]|\\^`]')
    single = _issues(
        (F.col("_missing"), "ERROR", "MISSING_ENTITY"), (bad_type, "FIXED", "INVALID_ENTITY_TYPE"), (no_id, "ERROR", "MISSING_ID"), (other_id, "FIXED", "ID_UNIFICATION"), (no_name, "FIXED", "MISSING_CANONICAL"),
        (unmarked("scientific"), "FIXED", "MISSING_LATEX_SCINAME"), (unmarked("family"), "FIXED", "MISSING_LATEX_SCINAME"), (forbidden, "ERROR", "INVALID_CHARS"),
    )
    no_source = F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) == "")
    claims = F.transform(no_source, lambda s: F.struct(F.lit("ERROR").alias("level"), F.lit("MISSING_SOURCE_ID").alias("code")))
    marked = lambda c: F.when(unmarked(c), F.concat(F.lit("$"), F.trim(F.col(c)), F.lit("$"))).otherwise(F.col(c))
    lower = F.transform_values("props", lambda k, v: F.when(k.isin("bo_phan_dung", "che_bien_tho", "thu_hai"), F.trim(F.lower(v))).otherwise(v))
    name = F.when(no_name, F.coalesce(F.when(text("raw_name") != "", F.col("raw_name")), final_id, F.lit("UNKNOWN"))).otherwise(F.col("canonical_name"))
    mended = d.withColumns({"_name": name, "_final": final_id, "entity_type": F.when(bad_type, "VI_THUOC").otherwise(F.col("entity_type")), "scientific": marked("scientific"), "family": marked("family"), "props": F.when(F.col("_missing"), F.col("props")).otherwise(lower)})
    issues = d.select("doc_id", F.explode(F.concat(single, claims)).alias("i")).select("doc_id", "i.*")
    return mended.withColumns({"canonical_name": F.col("_name"), "id": F.col("_final")}).select(*docs.columns), issues


#: What a header is written in, lines that are none, words that are no entity's name, and chemistry.
UPPER = "A-ZÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴÈÉẸẺẼÊỀẾỆỂỄÌÍỊỈĨÒÓỌỎÕÔỒỐỘỔỖƠỜỚỢỞỠÙÚỤỦŨƯỪỨỰỬỮỲÝỴỶỸĐ"
VOWELS = "aeiouyàáạảãâèéẹẻẽêìíịỉĩòóọỏõôùúụủũưỳýỵỷỹđ"
PICTURES = ("HÌNH", "ẢNH", "SƠ ĐỒ", "BẢNG")
NO_ENTITY = ("CÁC CÂY THUỐC", "VỊ THUỐC", "CHỮA BỆNH", "PHẦN", "MỤC LỤC", "THÀNH PHẦN", "HÓA HỌC", "CÔNG DỤNG", "LIỀU DÙNG", "MÔ TẢ", "BỘ PHẬN", "PHÂN BỐ", "THU HÁI", "BÀO CHẾ", "CHÚ THÍCH", "HÌNH", "ẢNH")
CHEMISTRY = ("OH", "CO", "CH3", "OCH3")


def detect_headers(pages: DataFrame, lines: int = 20) -> DataFrame:
    """page, group, entity_id, entity_name of each page, by the first lines that aren't blank; null without one.

    A group's header is a Roman numeral and capitals, with the next line if that is in capitals too. An entity's header is the
    first other line in capitals that is a name: two words at least, a vowel, no word that names a section, no chemistry.
    """
    line, after = F.col("l.line"), F.coalesce(F.col("l.after"), F.lit(""))
    full = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    # Pages are dealt out before the work on their lines, since a small file may be one task's; nothing is shuffled after that.
    cut = pages.select("page", "text").repartition("page").select("page", F.slice(full, 1, lines + 1).alias("_full"))
    number = F.transform(F.slice("_full", 1, lines), lambda x, i: i)
    zipped = F.arrays_zip(number.alias("n"), F.slice("_full", 1, lines).alias("line"), F.slice("_full", 2, lines).alias("after"))
    each = cut.select("page", F.explode_outer(zipped).alias("l"))
    picture = any_phrase(F.upper(line), PICTURES)
    roman = F.trim(F.regexp_extract(line, rf"^([IVXLC]+[.\s]+[{UPPER}\s]{{5,}})", 1))
    capitals = (F.upper(after) == after) & (F.lower(after) != after) & ~any_phrase(after, ("1.", "A.", "B.", "HÌNH"))
    name = F.trim(F.regexp_extract(line, rf"^\s*([{UPPER}\s]{{2,}})\s*$", 1))
    own = F.col("_name")
    code = own.rlike(r"^[A-Z0-9\s]+$") & (F.length(own) <= 6)
    named = (own != "") & F.lower(own).rlike(f"[{VOWELS}]") & ~any_phrase(own, NO_ENTITY) & (F.size(F.split(own, r"\s+")) > 1) & ~code & ~any_phrase(own, CHEMISTRY)
    # One column after the other, so that each is worked out once a line.
    marked = each.withColumns({"_roman": roman, "_name": name, "_picture": picture})
    marked = marked.select(
        "page",
        F.col("l.n").alias("n"),
        F.when(~F.col("_picture") & (F.col("_roman") != ""), F.concat("_roman", F.when(capitals, F.concat(F.lit(" "), after)).otherwise(""))).alias("group"),
        F.when(~F.col("_picture") & named, F.col("_name")).alias("name"),
    )
    # The line that is the group's header is no entity's. A page has `lines` candidates at most.
    found = marked.groupBy("page").agg(F.min(F.when(F.col("group").isNotNull(), F.struct("n", "group"))).alias("g"), F.collect_list(F.when(F.col("name").isNotNull(), F.struct("n", "name"))).alias("names"))
    first = F.array_min(F.filter("names", lambda x: F.col("g").isNull() | (x["n"] != F.col("g.n"))))["name"]
    out = found.select("page", F.col("g.group").alias("group"), first.alias("entity_name"))
    return out.select("page", "group", F.when(F.col("entity_name").isNotNull(), normalize_plain_id(strip_accents("entity_name"))).alias("entity_id"), "entity_name")


# identity and integrity


def merge_identity_edges(first: DataFrame, second: DataFrame, hubs: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges of a document from two extraction stages: doc_id, pos, from_id, to_id, relation_type, description, source_id.

    Ends lose their accents, an edge without a start starts at the hub; edges without an end or a type and self loops go; all
    get their document's source; of equal ones the first stage's first stays.
    """
    columns = ["doc_id", "pos", "from_id", "to_id", "relation_type", "description"]
    both = first.select(*columns, F.lit(1).alias("stage")).unionByName(second.select(*columns, F.lit(2).alias("stage")))
    e = both.join(hubs.select("doc_id", "hub_id"), "doc_id", "left")
    e = e.withColumns({"from_id": strip_accents(F.coalesce(F.when(F.col("from_id") != "", F.col("from_id")), F.col("hub_id"))), "to_id": strip_accents(F.coalesce("to_id", F.lit("")))})
    e = e.where("to_id <> '' and coalesce(relation_type, '') <> '' and (from_id is null or from_id <> to_id)")
    text = F.trim(F.regexp_replace("description", r"\s+", " "))
    place = F.struct("stage", "pos", "description")
    one = e.groupBy("doc_id", "from_id", "to_id", "relation_type").agg(F.min_by(F.struct("pos", text.alias("description")), place).alias("_r")).select("doc_id", "_r.pos", "from_id", "to_id", "relation_type", "_r.description")
    return one.join(sources.select("doc_id", "source_id"), "doc_id", "left")


def document_integrity(nodes: DataFrame, edges: DataFrame, rules: DataFrame, cyclic: DataFrame | None = None) -> DataFrame:
    """doc_id, kind, n: how often each kind of violation occurs in a document; clean documents have no row.

    nodes: doc_id, id. rules: relation_type, from_prefix, to_prefix. cyclic: doc_id, node (see cycles, which is asked without it). dangling: an end
    is missing; cycle: self loops and nodes on longer cycles; schema: ends that the rules don't allow, unknown types, and ids
    without a node; conflict: an edge whose reverse came earlier; duplicate: repeats beyond the first; orphan: nodes without an edge.

    edges are read once, into a checkpoint with a row for each different edge of a document, from which all kinds are counted.
    """
    a, b = F.col("from_id"), F.col("to_id")
    pair = Window.partitionBy("doc_id", F.least(a, b), F.greatest(a, b))
    first = lambda way: F.min(F.when(way, F.col("pos"))).over(pair)
    marked = edges.withColumns({"relation_type": F.upper("relation_type"), "_ahead": first(a < b), "_back": first(a > b)})
    late = F.col("doc_id").isNotNull() & (((a < b) & (F.col("pos") > F.col("_back"))) | ((a > b) & (F.col("pos") > F.col("_ahead"))))
    each = materialize(marked.groupBy("doc_id", "from_id", "to_id", "relation_type").agg(F.count("*").alias("n"), F.count_if(late).alias("late")))
    whole = each.where("coalesce(from_id, '') <> '' and coalesce(to_id, '') <> ''")
    kind = lambda df, name, n=F.count("*"): df.groupBy("doc_id").agg(n.alias("n")).select("doc_id", F.lit(name).alias("kind"), F.col("n").cast("long").alias("n"))
    head = lambda c: F.regexp_extract(c, "^([^_]+_)", 1)
    typed = whole.withColumns({"_a": head("from_id"), "_b": head("to_id")})
    known = rules.select("relation_type").distinct()
    starts = rules.select("relation_type", F.col("from_prefix").alias("_a")).distinct()
    stops = rules.select("relation_type", F.col("to_prefix").alias("_b")).distinct()
    ruled = typed.join(known, "relation_type", "left_semi")
    ends = whole.select("doc_id", F.col("from_id").alias("id")).union(whole.select("doc_id", "to_id")).distinct()
    own = materialize(nodes.select("doc_id", "id").distinct())
    loops = whole.where("from_id = to_id").select("doc_id", F.col("from_id").alias("node"))
    cyclic = cycles(whole) if cyclic is None else cyclic
    parts = [
        kind(each.where("coalesce(from_id, '') = '' or coalesce(to_id, '') = ''"), "dangling", F.sum("n")),
        kind(cyclic.select("doc_id", "node").union(loops).distinct(), "cycle"),
        kind(ruled.join(starts, ["relation_type", "_a"], "left_anti"), "schema", F.sum("n")),
        kind(ruled.join(stops, ["relation_type", "_b"], "left_anti"), "schema", F.sum("n")),
        kind(typed.join(known, "relation_type", "left_anti"), "schema", F.sum("n")),
        kind(ends.join(own, ["doc_id", "id"], "left_anti"), "schema"),
        kind(whole.where("late > 0"), "conflict", F.sum("late")),
        kind(whole.where("n > 1"), "duplicate", F.sum(F.col("n") - 1)),
        kind(own.join(ends, ["doc_id", "id"], "left_anti"), "orphan"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "kind").agg(F.sum("n").alias("n"))


def integrity_totals(violations: DataFrame, docs: DataFrame) -> DataFrame:
    """kind and n: the violations of all documents by kind, and how many documents (doc_id) passed and failed."""
    violations = materialize(violations)
    failed = violations.select("doc_id", F.lit(True).alias("_failed")).distinct()
    told = docs.select("doc_id").distinct().join(failed, "doc_id", "left").agg(F.count_if(F.col("_failed").isNull()).alias("passed"), F.count_if("_failed").alias("failed"))
    row = lambda name: F.struct(F.lit(name).alias("kind"), F.col(name).alias("n"))
    return violations.groupBy("kind").agg(F.sum("n").alias("n")).unionByName(told.select(F.inline(F.array(row("passed"), row("failed")))))
