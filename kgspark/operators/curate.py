"""Curation of edge and node tables: merging, linking, validation, integrity.

edges: doc_id, pos, from_id, to_id, relation_type, source_id, description, dosage, confidence and what else orders rows.
"First" always means first in the given total order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import label_from_prefix, name_from_id
from kgspark.sources.shared import materialize

from .retrieve import endpoint_ids
from .substrings import contains_join

CONTAINS = "BAO_GOM_VI_THUOC"
TREATS = ("CHU_TRI_BENH", "CHU_TRI_TRIEU_CHUNG")
EDGE_KEY = ("from_id", "relation_type", "to_id")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. min_by sums up before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def skip_processed(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def fold_texts(texts: Column) -> Column:
    """An ordered array as one text: each part is appended after " | " unless the text so far contains it."""
    add = lambda a, t: F.when(a == "", t).when(a.contains(t), a).otherwise(F.concat(a, F.lit(" | "), t))
    return F.aggregate(texts, F.lit(""), add)


#: Distinct descriptions of a key from which on they are held against each other by a join instead of in one row.
MANY_TEXTS = 1000


def merge_edges(edges: DataFrame, order: Sequence[str], keys: Sequence[str] = EDGE_KEY, default_confidence: float = 0.75, fill: Sequence[str] = (), policy: str = "first", many: int = MANY_TEXTS) -> DataFrame:
    """One edge for each key: the first dosage, folded descriptions, all sources sorted, the highest confidence, how many.

    fill: other properties, each filled with a value of the key that isn't empty: the first, or by policy "longest" the longest one, then the
    first. A null or zero confidence counts as the default. Exact repeats of a description go first, by a summing aggregation, so the ordered
    fold sees distinct texts only. A key with many of them is folded by a join: a text goes if an earlier one contains it, which is met by its rarest
    piece, and no row holds more than the texts that stay.
    """
    if policy not in ("first", "longest"):
        raise ValueError("policy is first or longest")
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, default_confidence).otherwise(F.col("confidence"))
    # A key's own columns order nothing within it: without them a row of the sums is about half as large.
    place = F.struct(*([c for c in order if c not in keys] or order))
    there = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", place)
    rank = lambda c: F.when(there(c).isNotNull(), F.struct(F.lit(0) if policy == "first" else -F.length(F.col(c).cast("string")), place))
    texts = edges.groupBy(*keys, F.coalesce("description", F.lit("")).alias("description")).agg(
        F.min(place).alias("place"),
        F.min(F.when(there("dosage").isNotNull(), F.struct(place.alias("place"), F.col("dosage").alias("value")))).alias("dosage"),
        F.collect_set("source_id").alias("sources"),
        F.max(confidence).alias("confidence"),
        F.count("*").alias("_rows"),
        *[F.min_by(F.struct(rank(c).alias("rank"), F.col(c).alias("value")), rank(c)).alias(f"_fill_{c}") for c in fill],
    )
    summed = [
        F.min("dosage")["value"].alias("dosage"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))), ",").alias("source_id"),
        F.max("confidence").alias("confidence"),
        F.sum("_rows").alias("n_merged"),
        *[F.min_by(f"_fill_{c}.value", f"_fill_{c}.rank").alias(c) for c in fill],
    ]
    parts = F.sort_array(F.collect_list(F.struct("place", "description"))).alias("parts")
    folded = fold_texts(F.transform("parts", lambda p: p["description"]))
    large = edges.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= many).select(*keys)
    if large.isEmpty():
        return texts.groupBy(*keys).agg(parts, *summed).withColumn("description", folded).drop("parts")
    texts = materialize(texts)
    # Where a text holds the mark between texts, or blanks at an end, it could be found across two others: such keys are folded in a row.
    odd = F.bool_or(F.col("description").contains("|") | (F.trim("description") != F.col("description")))
    hot = texts.groupBy(*keys).agg(F.count("*").alias("_n"), odd.alias("_odd")).where((F.col("_n") >= many) & ~F.col("_odd")).select(*keys, F.lit(True).alias("_hot"))
    hot = materialize(hot)
    own = texts.select(*keys, "place", "description")
    kept = own.join(hot, list(keys), "left_anti").unionByName(_uncontained(own.join(hot, list(keys), "left_semi"), keys))
    told = kept.groupBy(*keys).agg(parts).join(hot, list(keys), "left")
    told = told.select(*keys, F.when(F.col("_hot"), F.array_join(F.transform("parts", lambda p: p["description"]), " | ")).otherwise(folded).alias("description"))
    return texts.groupBy(*keys).agg(*summed).join(told, list(keys))


def _uncontained(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """texts (keys, place, description) without those that an earlier one of the key contains, and without empty ones."""
    texts = texts.where("description <> ''")
    later = texts.select(*keys, F.col("place").alias("_place"), F.col("description").alias("_part"))
    inside = contains_join(texts, later, "description", "_part", keys).where(F.col("place") < F.col("_place"))
    gone = inside.select(*keys, F.col("_place").alias("place")).distinct()
    return texts.join(gone, [*keys, "place"], "left_anti")


def merge_nodes(nodes: DataFrame, order: Sequence[str], rows: int = 500_000, many: int = 100_000) -> DataFrame:
    """One node for each id: the first label, and each property's first value that isn't empty.

    nodes: id, label, props (map). Rows meet by id in one exchange, in tasks of about `rows`, which sort them in memory; sums by struct before it
    would be sorted too, and spill on a large slice of input. Attribute nodes stand in nearly every document: an id of `many` rows or more is dealt
    out in shares of `many`, and what is first in each share meets again.
    """
    # An id orders nothing within it.
    place = F.struct(*([c for c in order if c != "id"] or order))
    counts = nodes.groupBy("id").agg(F.count("*").alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    keys, tasks = ["id"], -(-(total or 0) // rows) or 1
    slim = nodes.select("id", "label", "props", *[c for c in dict.fromkeys(order) if c not in ("id", "label", "props")])
    if (largest or 0) >= many:
        # There are fewer such ids than rows / many.
        shares = F.broadcast(counts.where(F.col("_n") >= many).select("id", F.ceil(F.col("_n") / many).alias("_shares")))
        slim = slim.join(shares, "id", "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(*order), "_shares"), F.lit(0))).drop("_shares")
        keys = ["id", "_share"]
    near = slim.repartition(tasks, *keys)
    # The label is the entry without a key.
    label = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("label").alias("value")))
    entries = near.select(*keys, place.alias("place"), F.explode(F.concat(label, F.coalesce(F.map_entries("props"), F.array()))).alias("entry")).select(*keys, "place", "entry.*")
    entries = entries.where("key is null or (value is not null and trim(value) <> '' and value <> 'null')")
    first = entries.groupBy(*keys, "key").agg(F.min(F.struct("place", "value")).alias("first"))
    if len(keys) > 1:
        first = first.groupBy("id", "key").agg(F.min("first").alias("first"))
    pair = F.when(F.col("key").isNotNull(), F.struct("key", F.col("first.value").alias("value")))
    merged = first.groupBy("id").agg(F.max(F.when(F.col("key").isNull(), F.col("first.value"))).alias("label"), F.sort_array(F.collect_list(pair)).alias("_pairs"))
    return merged.select("id", "label", F.when(F.size("_pairs") > 0, F.map_from_entries("_pairs")).alias("props"))


def confidence_stats(claims: DataFrame) -> DataFrame:
    """Per document: claims, sum and mean of their confidence, defaults by source where it is missing."""
    source = F.upper(F.coalesce("source_id", F.lit("")))
    default = F.when(source.contains("CT_VT_VN"), 0.95).when(source.contains("STEP4") | source.contains("AUDIT"), 0.85).otherwise(0.75)
    value = F.coalesce("confidence", default)
    return claims.groupBy("doc_id").agg(F.count("*").alias("n_claims"), F.round(F.sum(value), 8).alias("total"), F.round(F.avg(value), 8).alias("c_score"))


def validation_score(issues: DataFrame) -> DataFrame:
    """Per document: 100 less 15 an error and 5 a warning, 0 at least; passed without errors from 70 on."""
    n = lambda level: F.count_if(F.col("level") == level)
    counts = issues.groupBy("doc_id").agg(n("ERROR").alias("errors"), n("WARNING").alias("warnings"), n("FIXED").alias("fixed"))
    scored = counts.withColumn("score", F.greatest(F.lit(0), 100 - 15 * F.col("errors") - 5 * F.col("warnings")))
    return scored.withColumn("passed", (F.col("errors") == 0) & (F.col("score") >= 70))


def route_quarantine(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold, quarantine) by the pass flag."""
    return scored.where("passed"), scored.where("not passed")


def gate_summary(scored: DataFrame) -> DataFrame:
    total = F.count("*")
    return scored.agg(total.alias("documents"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("quarantined"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.sum("fixed").alias("fixed"), F.round(100 * F.count_if("passed") / total, 2).alias("pass_rate"))


def rank_by_richness(scored: DataFrame, score: str = "score", key: str = "doc_id", rows: int = 1_000_000) -> DataFrame:
    """Global rank by score, descending, then key.

    Rows are range-sorted into partitions of about `rows` (by score and key together, so equal scores are dealt out too), numbered
    within, and moved up by the rows of the partitions before. A checkpoint holds which row went where.
    """
    buckets = -(-scored.count() // rows) or 1
    order = [F.desc(score), F.asc(key)]
    dealt = materialize(scored.repartitionByRange(buckets, *order).withColumn("_b", F.spark_partition_id()))
    edges = dealt.groupBy("_b").agg(F.count("*").alias("_n"))  # a row for each partition
    ahead = edges.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return dealt.withColumn("_place", inside).join(F.broadcast(ahead), "_b").withColumn("rank", F.col("_ahead") + F.col("_place")).drop("_b", "_n", "_ahead", "_place")


def audit_score(proposals: DataFrame) -> DataFrame:
    """Per document: penalties by kind of proposal, the score left and its verdict.

    proposals: doc_id, action, known (an edge that exists), guarded (a refused delete), complete, filled.
    """
    kept = proposals.where(~(F.col("known") & (F.col("action") == "THEM_EDGE")) & ~(F.col("guarded") & (F.col("action") == "XOA_EDGE")))
    lost = (
        F.when(F.col("action") == "LOI_HE_THONG", 50)
        .when((F.col("action") == "SUA_PROPERTIES") & ~F.col("filled"), 20)
        .when(~F.col("complete"), 20)
        .when(F.col("action") == "THEM_EDGE", 8)
        .otherwise(5)
    )
    out = kept.groupBy("doc_id").agg(F.sum(lost).alias("penalty"), F.count("*").alias("n_proposals"))
    score = F.greatest(F.lit(0), 100 - F.col("penalty"))
    return out.withColumn("score", score).withColumn("verdict", F.when(score >= 90, "PASS").when(score >= 60, "REVIEW").otherwise("FAIL"))


def drop_blacklisted(patches: DataFrame, rejects: DataFrame) -> DataFrame:
    return patches.join(rejects.select("doc_id", "code").distinct(), ["doc_id", "code"], "left_anti")


def reject_known_edges(patches: DataFrame, edges: DataFrame) -> DataFrame:
    known = edges.select(*EDGE_KEY).distinct()
    added = patches.where("action = 'THEM_EDGE'").join(known, list(EDGE_KEY), "left_anti")
    return patches.where("action <> 'THEM_EDGE'").unionByName(added)


def patch_telemetry(patches: DataFrame, rejects: DataFrame) -> DataFrame:
    """Proposed, rejected and applied patches of each document, and in total (null document)."""
    marked = patches.join(rejects.select("doc_id", "code", F.lit(True).alias("bad")).distinct(), ["doc_id", "code"], "left")
    bad = F.count_if(F.coalesce("bad", F.lit(False)))
    return marked.rollup("doc_id").agg(F.count("*").alias("proposed"), bad.alias("rejected"), (F.count("*") - bad).alias("applied"))


def rename_map(patches: DataFrame) -> DataFrame:
    """doc_id, id, new_id: what the renames (SUA_ID) of a document, one after another, make of an id that is there from the start.

    Each rename is linked to the next one of the id that it makes; links are then followed two, four, eight ... at a time.
    """
    order = F.struct("pos", "from_id", "to_id", "relation_type", "description")
    renames = patches.where("action = 'SUA_ID' and from_id is not null and to_id is not null and from_id <> to_id").select("doc_id", order.alias("place"), F.col("from_id").alias("old"), F.col("to_id").alias("new"))
    renames = materialize(renames.distinct())
    uses = renames.select("doc_id", F.col("old").alias("id"), "place", F.col("place").alias("used"), F.lit(None).cast("string").alias("new"))
    makes = renames.select("doc_id", F.col("new").alias("id"), "place", F.lit(None).cast(renames.schema["place"].dataType).alias("used"), "new")
    after = Window.partitionBy("doc_id", "id").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    linked = uses.unionByName(makes).withColumn("next", F.first("used", ignorenulls=True).over(after)).where("new is not null").select("doc_id", "place", "new", "next")
    linked = materialize(linked)
    while not linked.where("next is not null").isEmpty():
        ahead = linked.select("doc_id", F.col("place").alias("next"), F.col("new").alias("_new"), F.col("next").alias("_next"))
        linked = materialize(linked.join(ahead, ["doc_id", "next"], "left").select("doc_id", "place", F.coalesce("_new", "new").alias("new"), F.col("_next").alias("next")))
    first = renames.groupBy("doc_id", F.col("old").alias("id")).agg(F.min("place").alias("place"))
    return first.join(linked, ["doc_id", "place"]).select("doc_id", "id", F.col("new").alias("new_id"))


def apply_patches(nodes: DataFrame, edges: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every document after its patches, in their order; documents without patches pass as they are.

    nodes: doc_id, id and more. edges: doc_id, pos, from_id, to_id, relation_type, description. patches: doc_id, pos, action, from_id, to_id,
    relation_type, description. SUA_ID renames from_id to to_id, in nodes too; XOA_EDGE removes edges between two ids, whatever the type; THEM_EDGE
    and SUA_PROPERTIES set type and description of the first edge between two ids, and THEM_EDGE appends one if there is none.
    """
    renamed = nodes.join(rename_map(patches), ["doc_id", "id"], "left").withColumn("id", F.coalesce("new_id", "id")).select(*nodes.columns)
    columns = ["doc_id", "pos", "from_id", "to_id", "relation_type", "description"]
    # One exchange for all documents: asking first which ones have patches would take two more of their edges.
    both = edges.select(*columns, F.lit(None).cast("string").alias("action")).unionByName(patches.select(*columns, "action"))
    ordered = both.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "from_id", "to_id", "relation_type", "description")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*columns).schema)

    def done(doc: object, rows: list[tuple], todo: list[tuple]) -> list[list]:
        # Edges and patches of no document don't meet.
        return _patched(rows, todo) if doc is not None else _patched(rows, []) + _patched([], todo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, rows, todo, kinds = None, [], [], None
        for part in batches:
            out, kinds = [], [part.schema.field(c) for c in columns]
            for row in zip(*(part.column(c).to_pylist() for c in [*columns, "action"])):
                if row[0] != doc:
                    out += done(doc, rows, todo)
                    doc, rows, todo = row[0], [], []
                (todo if row[6] else rows).append(row)
            yield _table(out, kinds)
        if kinds:
            yield _table(done(doc, rows, todo), kinds)

    return renamed, ordered.mapInArrow(run, schema)


def _table(rows: list[list], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _patched(edges: list[tuple], patches: list[tuple]) -> list[list]:
    """One document's edges after its patches; both as (doc_id, pos, from_id, to_id, relation_type, description, action)."""
    rows = [list(e[:6]) for e in edges]
    for doc, pos, a, b, kind, text, action in patches:
        if a is None or b is None:
            continue
        if action == "SUA_ID":
            for r in rows:
                r[2], r[3] = (b if r[2] == a else r[2]), (b if r[3] == a else r[3])
        elif action == "XOA_EDGE":
            rows = [r for r in rows if (r[2], r[3]) != (a, b)]
        elif action in ("THEM_EDGE", "SUA_PROPERTIES"):
            if a.startswith(("VT_", "VI_THUOC_")) and b.startswith("BT_"):
                a, b = b, a
            kind = kind or (TREATS[0] if b.startswith("B_") else CONTAINS)
            old = next((r for r in rows if (r[2], r[3]) == (a, b)), None)
            if old is not None:
                old[4], old[5] = kind, text or old[5]
            elif action == "THEM_EDGE":
                rows.append([doc, 1_000_000 + pos, a, b, kind, text])
    return rows


def relation_inventory(edges: DataFrame) -> DataFrame:
    """Per document and relation: its targets, sorted, as one text."""
    return edges.groupBy("doc_id", "relation_type").agg(F.array_join(F.sort_array(F.collect_set("to_id")), ", ").alias("targets"))


def schema_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges whose type is unknown, or whose ends' prefixes its rule (relation_type, from_prefix, to_prefix) doesn't allow."""
    head = lambda c: F.regexp_extract(c, "^([^_]+_)", 1)
    checked = edges.withColumn("from_prefix", head("from_id")).withColumn("to_prefix", head("to_id"))
    bad = checked.join(rules, ["relation_type", "from_prefix", "to_prefix"], "left_anti")
    known = rules.select("relation_type", F.lit(True).alias("known")).distinct()
    return bad.join(known, "relation_type", "left").withColumn("kind", F.when(F.col("known"), "wrong_ends").otherwise("unknown_type")).drop("known")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Repeats beyond the first of (from, to, upper-case type) in each document."""
    n = edges.groupBy("doc_id", "from_id", "to_id", F.upper("relation_type").alias("relation_type")).agg((F.count("*") - 1).alias("repeats"))
    return n.where("repeats > 0")


def direction_conflicts(edges: DataFrame) -> DataFrame:
    """Edges whose reverse stood earlier in the same document."""
    first = edges.groupBy("doc_id", F.col("from_id").alias("to_id"), F.col("to_id").alias("from_id")).agg(F.min("pos").alias("reverse_pos"))
    return edges.join(first, ["doc_id", "from_id", "to_id"]).where("pos > reverse_pos")


def ghost_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return endpoint_ids(edges).join(nodes.select("id"), "id", "left_anti")


def orphan_nodes(nodes: DataFrame, edges: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Nodes that no edge uses and that are no hubs (id)."""
    return nodes.join(endpoint_ids(edges, hubs), "id", "left_anti")


def inject_missing_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and one for each endpoint without: label by prefix, name from the id; remedies only with an ingredient."""
    filled = edges.where(F.col("relation_type") == CONTAINS).select(F.col("from_id").alias("id")).distinct()
    missing = ghost_nodes(nodes, edges)
    kept = missing.where(~F.col("id").startswith("BT_")).union(missing.where(F.col("id").startswith("BT_")).join(filled, "id", "left_semi"))
    made = kept.select("id", label_from_prefix(F.col("id")).alias("label"), F.lower(name_from_id(F.col("id"))).alias("name"))
    return nodes.select("id", "label", "name").unionByName(made)


def collect_garbage(nodes: DataFrame, edges: DataFrame, hubs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Without edges that start at a remedy that contains nothing, then without nodes that no edge uses and that are no hubs (id)."""
    filled = edges.where(F.col("relation_type") == CONTAINS).select("from_id").distinct()
    starts = F.col("from_id").startswith("BT_")
    kept = edges.where(~starts).unionByName(edges.where(starts).join(filled, "from_id", "left_semi").select(*edges.columns))
    return nodes.join(endpoint_ids(kept, hubs), "id", "left_semi"), kept


def isolated_hubs(hubs: DataFrame, edges: DataFrame) -> DataFrame:
    """Hubs (hub_id) without an edge (ERROR), or with none that treats or has a function (WARNING)."""
    useful = F.col("relation_type").startswith("CHU_TRI") | F.col("relation_type").isin("CO_CONG_NANG", "CO_TAC_DUNG_DUOC_LY")
    ends = edges.select(F.col("from_id").alias("hub_id"), useful.alias("useful")).union(edges.select("to_id", F.lit(False)))
    per = ends.groupBy("hub_id").agg(F.max("useful").alias("useful"))
    joined = hubs.join(per, "hub_id", "left")
    return joined.where("useful is null or not useful").select("hub_id", F.when(F.col("useful").isNull(), "ERROR").otherwise("WARNING").alias("level"), F.when(F.col("useful").isNull(), "ISOLATED_NODE").otherwise("NO_TREATMENT_EDGE").alias("code"))


def drop_lazy_evidence(edges: DataFrame, phrases: Sequence[str]) -> DataFrame:
    low = F.lower(F.coalesce("description", F.lit("")))
    bad = F.lit(False)
    for p in phrases:
        bad |= low.contains(p)
    return edges.where(~bad)


def drop_vague_targets(edges: DataFrame, vague: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dropped): without empty targets and those in vague (id)."""
    full = edges.where(F.coalesce("to_id", F.lit("")) != "")
    bad = vague.select(F.col("id").alias("to_id")).distinct()
    return full.join(bad, "to_id", "left_anti"), edges.where(F.coalesce("to_id", F.lit("")) == "").unionByName(full.join(bad, "to_id", "left_semi").select(*edges.columns))


def drop_vague_categories(edges: DataFrame, vague: Column) -> DataFrame:
    """Without treats-edges to a vague category where the same source also treats something specific."""
    treats = F.col("relation_type").isin(*TREATS)
    specific = edges.where(treats & ~vague).select("from_id").distinct()
    return edges.where(~(treats & vague)).unionByName(edges.where(treats & vague).join(specific, "from_id", "left_anti").select(*edges.columns))


def orient_edges(edges: DataFrame) -> DataFrame:
    """Containment from remedy to herb, treatment towards the illness, no self loops, the type that the target's prefix asks for."""
    kind, a, b = F.col("relation_type"), F.col("from_id"), F.col("to_id")
    inverse = kind.isin("CO_TRONG_BAI_THUOC", "THANH_PHAN_CUA") | ((kind == CONTAINS) & a.startswith("VT_"))
    wrong = kind.startswith("CHU_TRI") & a.rlike("^(B|S)_") & b.rlike("^(VT|BT|HC|DL)_")
    turned = edges.withColumns({"from_id": F.when(inverse | wrong, b).otherwise(a), "to_id": F.when(inverse | wrong, a).otherwise(b), "relation_type": F.when(inverse, CONTAINS).otherwise(kind)})
    b, kind = F.col("to_id"), F.col("relation_type")
    by_target = F.when(kind.contains("KIENG"), kind).when(b.startswith("B_"), "CHU_TRI_BENH").when(b.startswith("S_"), "CHU_TRI_TRIEU_CHUNG").when(b.startswith("T_"), "CO_TINH").when(b.startswith("V_"), "CO_VI").when(b.startswith("K_"), "QUY_KINH").when(b.startswith("HC_"), "CO_CHUA_HOAT_CHAT").otherwise(kind)
    return turned.where("from_id <> to_id").withColumn("relation_type", by_target)


def integrity_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many violations there are of each kind."""
    checks = {
        "ghost": ghost_nodes(nodes, edges),
        "orphan": orphan_nodes(nodes, edges),
        "self_loop": edges.where("from_id = to_id"),
        "duplicate": edges.groupBy(*EDGE_KEY).count().where("count > 1"),
    }
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def harvest_dictionary(hubs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, name, label and aliases of every entity: a hub's own row over that of a node."""
    both = hubs.select("id", "label", "name", "alias", F.lit(0).alias("priority")).unionByName(nodes.select("id", "label", "name", "alias", F.lit(1).alias("priority")))
    place = F.struct("priority", "name", "label")
    aliases = F.sort_array(F.collect_set(F.when(F.coalesce("alias", F.lit("")) != "", F.col("alias"))))
    return both.groupBy("id").agg(F.min_by("name", place).alias("name"), F.min_by("label", place).alias("label"), aliases.alias("aliases"))


def enrich_aliases(dictionary: DataFrame) -> DataFrame:
    """Aliases with the lower-case name and forms without blanks, distinct and sorted."""
    own = F.concat(F.array(F.lower("name")), F.transform("aliases", F.lower))
    dense = F.transform(own, lambda a: F.replace(a, F.lit(" "), F.lit("")))
    return dictionary.withColumn("aliases", F.sort_array(F.array_distinct(F.filter(F.concat(own, dense), lambda a: a != ""))))


def build_lookup(dictionary: DataFrame) -> DataFrame:
    """key -> id: an id beats an alias, and of several entities with an alias the first has it."""
    ids = dictionary.select(F.lower("id").alias("key"), "id", F.lit(0).alias("priority"))
    names = dictionary.select(F.explode("aliases").alias("key"), "id", F.lit(1).alias("priority"))
    return ids.unionByName(names).groupBy("key").agg(F.min_by("id", F.struct("priority", "id")).alias("canonical_id"))


def dictionary_link(edges: DataFrame, lookup: DataFrame) -> DataFrame:
    """Both ends through the lookup, else as they are. Distinct ids are linked, then joined back."""
    ids = endpoint_ids(edges)
    linked = ids.join(lookup, F.lower(ids["id"]) == lookup["key"], "left").select("id", F.coalesce("canonical_id", "id").alias("new_id"))
    out = edges.join(linked.withColumnsRenamed({"id": "from_id", "new_id": "new_from"}), "from_id").join(linked.withColumnsRenamed({"id": "to_id", "new_id": "new_to"}), "to_id")
    return out.withColumns({"from_id": F.col("new_from"), "to_id": F.col("new_to")}).drop("new_from", "new_to").select(*edges.columns)


def knowledge_signature(nodes: DataFrame, edges: DataFrame, most: int | None = 1000) -> DataFrame:
    """A text for each node from its edges: "<relation> <name>", and the reverse phrase for containment and treatment.

    most: the first so many phrases of a node make its text (None: all, which a hub of millions of edges can't hold in a row).
    """
    names = nodes.select("id", "name")
    ahead = edges.join(names.withColumnRenamed("id", "to_id"), "to_id").select(F.col("from_id").alias("id"), F.concat_ws(" ", F.lower("relation_type"), "name").alias("phrase"))
    back = edges.where(F.col("relation_type").isin(CONTAINS, TREATS[0], "CO_CHUA_HOAT_CHAT")).join(names.withColumnRenamed("id", "from_id"), "from_id").select(F.col("to_id").alias("id"), F.concat(F.lit("of "), F.lower("relation_type"), F.lit(" "), F.col("name")).alias("phrase"))
    phrases = ahead.union(back).distinct()
    if most is not None:
        phrases = phrases.withColumn("_p", F.row_number().over(Window.partitionBy("id").orderBy("phrase"))).where(F.col("_p") <= most).drop("_p")
    return phrases.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("phrase")), "; ").alias("signature"))


def embedding_text(nodes: DataFrame, signature: DataFrame, chars: int = 250) -> DataFrame:
    """The text to embed of each node (id, name, label; alias, hint, description if there): who it is, its whole signature, the head of its description."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) if c in nodes.columns else F.lit("")
    out = nodes.join(signature, "id", "left")
    # The words between, which the vectors in use were made with.
    text = F.concat(
        F.lit("Thực thể YHCT: "), there("name"),
        F.lit(". Phân loại: "), F.coalesce("label", F.lit("ThucThe")),
        F.lit(". Tên gọi khác: "), there("alias"),
        F.lit(". Định nghĩa & Gợi ý tìm kiếm: "), there("hint"),
        F.lit(" Đặc điểm lâm sàng & Quan hệ: "), F.trim(F.coalesce("signature", F.lit(""))),
        F.lit(" Mô tả cơ bản: "), F.substring(there("description"), 1, chars),
    )
    return out.select("id", F.trim(text).alias("text"))


def pending_embeddings(nodes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes still to embed, nodes with their cached vector)."""
    return nodes.join(cache.select("id"), "id", "left_anti"), nodes.join(cache.select("id", "embedding"), "id")


def richness_score(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """0 to 100: fields that are there and capped relation counts.

    docs: doc_id, scientific, family, n_variants, n_tastes, nature, n_meridians. edges: doc_id, relation_type.
    """
    kind = F.col("relation_type")
    n = lambda c: F.count_if(c)
    per = edges.groupBy("doc_id").agg(n(kind == "CO_CONG_NANG").alias("cn"), n(kind == "CO_CHUA_HOAT_CHAT").alias("hc"), n(kind == "CO_TAC_DUNG_DUOC_LY").alias("dl"), n(kind.startswith("CHU_TRI")).alias("b"), n(kind == "CO_TRONG_BAI_THUOC").alias("bt"))
    j = docs.join(per, "doc_id", "left").fillna(0, ["cn", "hc", "dl", "b", "bt"])
    there = lambda c, points: F.when(F.coalesce(F.col(c), F.lit("")) != "", points).otherwise(0)
    many = lambda c, points: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, points).otherwise(0)
    base = there("scientific", 10) + there("family", 5) + many("n_variants", 5) + many("n_tastes", 5) + there("nature", 5) + many("n_meridians", 10)
    base = F.when((F.col("cn") > 0) & (base < 40), F.least(F.lit(40), base + 2 * F.col("cn"))).otherwise(base)
    chem = F.least(F.lit(30), 3 * F.least(F.col("hc"), F.lit(5)) + 5 * F.least(F.col("dl"), F.lit(3)))
    use = F.least(F.lit(30.0), 1.5 * F.least(F.col("b"), F.lit(10)) + 5 * F.least(F.col("bt"), F.lit(3)))
    return j.select("doc_id", F.round(F.least(F.lit(100.0), base + chem + use), 2).alias("richness"))


def chunk_items(items: DataFrame, key: str, order: Sequence[str], n: int = 6) -> DataFrame:
    """Lists cut into numbered parts of n."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return items.withColumn("part", F.floor((place - 1) / n) + 1)


def trim_acyclic(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Without edges that can't be on a cycle of their document: each round drops those into ends or out of sources.

    A round uses its edges three times, so each one's are a checkpoint.
    """
    for _ in range(rounds):
        edges = materialize(edges)
        has_out = edges.select("doc_id", F.col("from_id").alias("to_id")).distinct()
        has_in = edges.select("doc_id", F.col("to_id").alias("from_id")).distinct()
        edges = edges.join(has_out, ["doc_id", "to_id"], "left_semi").join(has_in, ["doc_id", "from_id"], "left_semi")
    return edges


def _on_cycles(out: dict[str, list[str]]) -> list[str]:
    """Nodes of strongly connected components of two or more, and of self loops; one walk, linear in the edges."""
    index, low, stack, held, found = {}, {}, [], set(), []
    for start in sorted(out):
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        held.add(start)
        while work:
            node, targets = work[-1]
            for t in targets:
                if t not in index:
                    index[t] = low[t] = len(index)
                    stack.append(t)
                    held.add(t)
                    work.append((t, iter(out.get(t, ()))))
                    break
                if t in held:
                    low[node] = min(low[node], index[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        held.discard(part[-1])
                    found += part if len(part) > 1 or node in out.get(node, ()) else []
    return found


def _reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (doc_id, color, node) that some node of start reaches along edges (doc_id, color, from_id, to_id), start included."""
    found = front = materialize(start)
    while not front.isEmpty():
        ahead = front.withColumnRenamed("node", "from_id").join(edges, ["doc_id", "color", "from_id"]).select("doc_id", "color", F.col("to_id").alias("node")).distinct()
        front = materialize(ahead.join(found, ["doc_id", "color", "node"], "left_anti"))
        found = materialize(found.unionByName(front))
    return found


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """doc_id, node of each node on a cycle, for documents of any size: components by colours, joins alone.

    Each node takes the greatest id from which it can be reached as its colour; the nodes of a colour that also reach the node it is named after
    are that one's strongly connected component. They are taken out, edges between colours can't be on a cycle, and the rest goes round again.
    """
    edges = materialize(edges.select("doc_id", "from_id", "to_id").distinct())
    loops = edges.where("from_id = to_id").select("doc_id", F.col("from_id").alias("node"))
    edges, out = trim_acyclic(edges.where("from_id <> to_id")), [loops]
    while True:
        edges = materialize(edges)
        if edges.isEmpty():
            break
        ends = edges.select("doc_id", F.col("from_id").alias("node")).union(edges.select("doc_id", "to_id")).distinct()
        colors = materialize(ends.withColumn("color", F.col("node")))
        while True:
            sent = edges.join(colors.withColumnRenamed("node", "from_id"), ["doc_id", "from_id"]).groupBy("doc_id", F.col("to_id").alias("node")).agg(F.max("color").alias("sent"))
            new = colors.join(sent, ["doc_id", "node"], "left").withColumn("moved", F.coalesce(F.col("sent") > F.col("color"), F.lit(False)))
            new = materialize(new.select("doc_id", "node", F.greatest("color", "sent").alias("color"), "moved"))
            colors = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        side = lambda c: colors.withColumnsRenamed({"node": f"{c}_id", "color": f"_{c}"})
        colored = edges.join(side("from"), ["doc_id", "from_id"]).join(side("to"), ["doc_id", "to_id"]).where("_from = _to")
        edges = materialize(colored.select("doc_id", F.col("_from").alias("color"), "from_id", "to_id"))
        back = edges.select("doc_id", "color", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
        parts = _reach(colors.where("node = color").select("doc_id", "color", "node"), back)
        many = parts.groupBy("doc_id", "color").agg(F.count("*").alias("n")).where("n > 1")
        out.append(parts.join(many, ["doc_id", "color"], "left_semi").select("doc_id", "node"))
        for end in ("from_id", "to_id"):
            edges = edges.join(parts.select("doc_id", F.col("node").alias(end)), ["doc_id", end], "left_anti")
        edges = trim_acyclic(edges.select("doc_id", "from_id", "to_id"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.distinct()


def cycles(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """doc_id, cyclic nodes of each document (in a cycle of two or more, or a self loop), after trimming.

    A document of at most so many edges is walked by one task, a larger one by joins (cyclic_nodes).
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for a, b in zip(part["from_id"], part["to_id"]):
            out.setdefault(a, []).append(b)
        found = _on_cycles(out)
        return pd.DataFrame({"doc_id": pd.Series([part["doc_id"].iloc[0]] * len(found), dtype="int64"), "node": pd.Series(found, dtype="object")})

    pairs = materialize(trim_acyclic(edges.select("doc_id", "from_id", "to_id").distinct()))
    large = pairs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("doc_id")
    if large.isEmpty():
        return pairs.groupBy("doc_id").applyInPandas(run, "doc_id long, node string")
    walked = pairs.join(large, "doc_id", "left_anti").groupBy("doc_id").applyInPandas(run, "doc_id long, node string")
    return walked.unionByName(cyclic_nodes(pairs.join(large, "doc_id", "left_semi")))


def carry_anchor(pages: DataFrame, anchors: DataFrame, block: int = 1024) -> DataFrame:
    """Every page with the last entity that began on it or before, and where: pages (book, page), anchors (book, page, entity).

    A book is cut into blocks of page numbers; each block's last anchor is a row, so only those are carried along a whole book and
    no task has to hold a book.
    """
    started = F.when(F.col("entity").isNotNull(), F.struct("page", "entity"))
    joined = pages.join(anchors, ["book", "page"], "left").select("book", "page", started.alias("a"), F.floor(F.col("page") / block).alias("block"))
    last = joined.groupBy("book", "block").agg(F.max_by("a", F.when(F.col("a").isNotNull(), F.col("page"))).alias("a"))
    before = Window.partitionBy("book").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("book", "block", F.last("a", ignorenulls=True).over(before).alias("before"))
    so_far = Window.partitionBy("book", "block").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    own = joined.withColumn("a", F.last("a", ignorenulls=True).over(so_far)).join(carried, ["book", "block"])
    anchor = F.coalesce("a", "before")
    return own.select("book", "page", anchor["entity"].alias("anchor"), anchor["page"].alias("start_page"))


def merge_spilled_text(pages: DataFrame, block: int = 1024) -> DataFrame:
    """Text of each (book, anchor) by parts: parts in page order, after a line end with their page's tag if the text before
    ended a sentence, else after a blank; pages without text are skipped.

    An entity's pages are joined by blocks of page numbers, so book, anchor and part (the block) name a row of bounded size; the parts
    of an entity put together in order are its text.
    """
    parts = pages.where("anchor is not null and text is not null and trim(text) <> ''").withColumn("part", F.floor(F.col("page") / block))
    ends = F.col("text").rlike("[.:!?]$")
    in_part = Window.partitionBy("book", "anchor", "part").orderBy("page")
    marked = parts.withColumn("ends", ends).withColumn("_before", F.lag("ends").over(in_part))
    # What the part before ended with: a row for each part.
    last = marked.groupBy("book", "anchor", "part").agg(F.max_by("ends", "page").alias("ended"))
    ahead = last.select("book", "anchor", "part", F.lag("ended").over(Window.partitionBy("book", "anchor").orderBy("part")).alias("ahead"))
    joined = marked.join(ahead, ["book", "anchor", "part"]).withColumn("_before", F.coalesce("_before", "ahead"))
    tag = F.concat(F.lit("[T"), F.col("page").cast("string"), F.lit("]: "), F.col("text"))
    piece = F.when(F.col("_before").isNull(), tag).when(F.col("_before"), F.concat(F.lit("\n"), tag)).otherwise(F.concat(F.lit(" "), "text"))
    rows = joined.select("book", "anchor", "part", "page", piece.alias("piece")).groupBy("book", "anchor", "part")
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "piece"))), lambda p: p["piece"]), "").alias("text"))


def merge_split_recipes(items: DataFrame, marker: str = r"\[src\]") -> DataFrame:
    """Items (doc_id, pos, text) put together until one ends with a source marker; exact repeats dropped."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    has = F.col("text").rlike(marker).cast("int")
    parts = items.withColumn("has", has).withColumn("before", F.lag("has").over(w)).withColumn("island", F.coalesce(F.sum("before").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    merged = parts.groupBy("doc_id", "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), " ").alias("text"), F.min("pos").alias("pos"))
    return merged.groupBy("doc_id", "text").agg(F.min("pos").alias("pos"))


#: Phrases that mark an attribute as inferred, and those that mark what a herb treats, contains or does.
INFERRED_DNA = ("không được đề cập", "suy luận", "không thấy nói", "chưa rõ quy kinh", "có thể liên quan", "không đề cập trực tiếp", "dựa trên công năng")
INFERRED_OTHER = ("suy luận", "có lẽ")
#: What is kept all the same, with a note.
KEPT_CORES = ("an_thai", "chua_ho", "kham_tieng", "thong_tieu")
KEPT_NOTE = " (Cần kiểm chứng từ nguyên tác)"
DNA = ("CO_TINH", "CO_VI", "QUY_KINH")


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out |= text.contains(p)
    return out


def evidence_filter(edges: DataFrame, anchors: DataFrame, keep: Sequence[str] = KEPT_CORES) -> tuple[DataFrame, DataFrame]:
    """(edges, issues): edges whose description bears them out.

    anchors: core, words (array): what a description must hold one of; without a row the core itself with blanks. An attribute
    edge with an inferring phrase goes; without an anchor a meridian edge goes and others get a WARNING. A treatment, containment or
    function edge with an inferring phrase goes too; if its core is in keep it stays, with a note and a WARNING. Others pass.
    """
    low, core = F.lower(F.coalesce("description", F.lit(""))), F.lower(F.regexp_replace("to_id", "^[^_]+_", ""))
    joined = edges.withColumn("_core", core).join(anchors.select(F.col("core").alias("_core"), F.col("words").alias("_words")), "_core", "left")
    words = F.coalesce("_words", F.array(F.replace("_core", F.lit("_"), F.lit(" "))))
    held = F.exists(words, lambda w: low.contains(w))
    kind = F.col("relation_type")
    is_dna, inferred = kind.isin(*DNA), kind.isin(*TREATS, CONTAINS, "CO_CONG_NANG") & any_phrase(low, INFERRED_OTHER)
    verdict = (
        F.when(is_dna & any_phrase(low, INFERRED_DNA), "DROP")
        .when(is_dna & ~held & (kind == "QUY_KINH"), "DROP")
        .when(is_dna & ~held, "WARNING")
        .when(inferred & F.col("_core").isin(*keep), "NOTE")
        .when(inferred, "DROP")
        .otherwise("OK")
    )
    judged = joined.withColumn("_verdict", verdict)
    issues = judged.where("_verdict <> 'OK'").select("doc_id", "from_id", "to_id", F.when(F.col("_verdict") == "DROP", "FIXED").otherwise("WARNING").alias("level"))
    noted = F.when(F.col("_verdict") == "NOTE", F.concat("description", F.lit(KEPT_NOTE))).otherwise(F.col("description"))
    return judged.where("_verdict <> 'DROP'").withColumn("description", noted).select(*edges.columns), issues


def fuse_fragments(identity: DataFrame, others: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Edges of the identity fragments with those of other fragments of the same documents, merged per document."""
    ids = identity.select("doc_id").distinct()
    both = identity
    for df in others:
        both = both.unionByName(df.join(ids, "doc_id", "left_semi").select(*identity.columns))
    return merge_edges(both, order, keys=("doc_id", *EDGE_KEY))


def join_bronze(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Silver fragments (file) with the bronze text of their document (doc_id, text): the name without its fragment suffix."""
    key = F.regexp_replace("file", r"(_bai_thuoc|_duoc_ly|_dinh_danh)?(\.json)?$", "")
    return silver.withColumn("doc_id", key).join(bronze, "doc_id")


def hub_properties(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes (id, props) with the properties of their document (hub_id, props) where they have none; empty and null words don't count."""
    real = F.map_filter("hub_props", lambda k, v: (F.coalesce(v, F.lit("")) != "") & ~F.lower(v).isin("null", "không có thông tin"))
    own = F.coalesce("props", F.create_map().cast("map<string,string>"))
    joined = nodes.join(docs.select(F.col("hub_id").alias("id"), F.col("props").alias("hub_props")), "id", "left")
    new = F.map_filter(F.coalesce(real, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    return joined.withColumn("props", F.map_concat(own, new)).drop("hub_props")


def link_attributes(claims: DataFrame, lookup: DataFrame, field: str, prefix: str) -> DataFrame:
    """Per document: the canonical ids of a claim's values, distinct and sorted; unknown ones keep their own id."""
    rows = claims.select("doc_id", F.explode(field).alias("value")).where("trim(value) <> ''")
    keyed = rows.withColumn("own", F.concat(F.lit(prefix), F.upper(F.regexp_replace(F.trim("value"), " +", "_")))).withColumn("key", F.lower("own"))
    linked = keyed.join(lookup, "key", "left").select("doc_id", F.coalesce("canonical_id", "own").alias("id"))
    return linked.groupBy("doc_id").agg(F.sort_array(F.collect_set("id")).alias(field))


def merge_identity(first: DataFrame, second: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One identity a document from two extraction stages: each field's first value that isn't empty."""
    a, b = first.alias("a"), second.alias("b")
    full = a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full")
    value = lambda c: F.coalesce(F.when(F.trim(F.col(f"a.{c}")) != "", F.col(f"a.{c}")), F.when(F.trim(F.col(f"b.{c}")) != "", F.col(f"b.{c}"))).alias(c)
    return full.select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), *[value(c) for c in fields])
