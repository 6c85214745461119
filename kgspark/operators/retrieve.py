"""Batch retrieval: a table of questions against node and edge tables.

nodes: id, label, name (lower case), alias. edges: from_id, relation_type, to_id. questions: question_id, kw1, kw2.
Results have question_id and the record columns; at most `limit` rows a question, in the order of the columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import strip_accents
from kgspark.sources.shared import materialize

from .substrings import contains_join

HERB, REMEDY, DISEASE, SYMPTOM = "ViThuoc", "BaiThuoc", "Benh", "TrieuChung"
CONTAINS, HAS_COMPOUND = "BAO_GOM_VI_THUOC", "CO_CHUA_HOAT_CHAT"
TREATS = ("CHU_TRI_BENH", "CHU_TRI_TRIEU_CHUNG")
FUNCTION = ("CO_CONG_NANG", "CO_TAC_DUNG_DUOC_LY")
LIMIT = 30


def keyword_id(keyword: Column) -> Column:
    """A keyword as ids are written: without accents, upper case, _ for blanks."""
    return F.upper(F.replace(strip_accents(keyword), F.lit(" "), F.lit("_")))


def entity_predicate(node_id: Column, label: Column, name: Column, alias: Column, keyword: Column, as_id: Column) -> Column:
    """One word: a whole word of the name, or the id. A phrase: part of the name or of the id. Diseases: or part of an alias.

    An empty keyword matches everything. as_id: see keyword_id.
    """
    word = (F.upper(node_id) == as_id) | F.concat(F.lit(" "), name, F.lit(" ")).contains(F.concat(F.lit(" "), keyword, F.lit(" ")))
    phrase = name.contains(keyword) | F.upper(node_id).contains(as_id)
    by_alias = label.isin(DISEASE, SYMPTOM) & alias.contains(keyword)
    return (keyword == "") | F.when(keyword.contains(" "), phrase).otherwise(word) | by_alias


def _keys(node_id: Column, name: Column, label: Column, alias: Column) -> Column:
    """What keywords find a node by, as (kind, text): its id, its name, and a disease's alias. Nodes of one name share a key."""
    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    return F.filter(F.array(key("id", node_id), key("name", name), key("alias", F.when(label.isin(DISEASE, SYMPTOM), alias))), lambda k: k["text"].isNotNull())


def held_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as lookups read them, as a checkpoint: one lookup reads them a dozen times, and a plan with what is behind them each time outgrows the driver."""
    return materialize(nodes.select("id", "label", "name", "alias"))


def keyword_keys(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """keyword, kind, text: the node keys that each keyword finds. Null keywords find nothing, empty ones all.

    Each distinct keyword is looked up once, in distinct ids, names and aliases, by equi-joins: a word meets whole words of names, and ids; a phrase and
    an alias's part meet the texts that hold their rarest piece (contains_join). So there are no more rows than distinct keywords have distinct texts.
    """
    words = keywords.where("keyword is not null").select("keyword").distinct().withColumn("as_id", keyword_id(F.col("keyword")))
    full = materialize(words.where("keyword <> ''"))
    is_phrase = F.col("keyword").contains(" ")
    single, phrases = full.where(~is_phrase), full.where(is_phrase)
    ids = nodes.where("id is not null").select("id").distinct().withColumn("large", F.upper("id"))
    names = nodes.where("name is not null").select("name").distinct()
    aliases = nodes.where(F.col("label").isin(DISEASE, SYMPTOM) & (F.col("alias") != "")).select("alias").distinct()
    found = lambda df, kind, text: df.select("keyword", F.lit(kind).alias("kind"), F.col(text).alias("text"))
    by_word = names.withColumn("keyword", F.explode(F.array_distinct(F.split("name", " ")))).join(single.select("keyword"), "keyword")
    parts = [
        found(ids.join(single.withColumnRenamed("as_id", "large"), "large"), "id", "id"),
        found(by_word, "name", "name"),
        # A phrase is looked for as it is in names, in the form of an id in ids.
        found(contains_join(ids, phrases, "large", "as_id"), "id", "id"),
        found(contains_join(names, phrases, "name", "keyword"), "name", "name"),
        found(contains_join(aliases, full, "alias", "keyword"), "alias", "alias"),
    ]
    # The empty keyword is one row at most.
    empty = F.broadcast(words.where("keyword = ''").select("keyword"))
    parts += [found(names.crossJoin(empty), "name", "name"), found(nodes.where("name is null and id is not null").select("id").distinct().crossJoin(empty), "id", "id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _keyed(nodes: DataFrame, side: str) -> DataFrame:
    """Nodes with their keys, a row for each: <side>_id, <side>_name, <side>_label, kind, text."""
    keys = _keys(F.col("id"), F.col("name"), F.col("label"), F.col("alias"))
    return nodes.withColumn("_key", F.explode(keys)).select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("label").alias(f"{side}_label"), "_key.kind", "_key.text")


def match_entities(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """keywords (key, keyword) with the nodes that match: key, id, label, name. Null keywords match nothing, empty ones all."""
    asked = materialize(keywords.where("keyword is not null").select("key", "keyword").distinct())
    nodes = held_nodes(nodes)
    found = _keyed(nodes, "n").join(keyword_keys(nodes, asked), ["kind", "text"]).select("keyword", F.col("n_id").alias("id"), F.col("n_label").alias("label"), F.col("n_name").alias("name")).distinct()
    return asked.join(found, "keyword").select("key", "id", "label", "name").distinct()


def match_entity(nodes: DataFrame, keyword: str) -> DataFrame:
    """The nodes that one keyword matches; an empty one matches all."""
    kw = F.lit(keyword.strip().lower())
    return nodes.where(entity_predicate(F.col("id"), F.col("label"), F.col("name"), F.coalesce("alias", F.lit("")), kw, keyword_id(kw)))


def first_rows(hits: DataFrame, order: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """At most limit rows of each question in a total order."""
    columns = hits.columns
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return hits.withColumn("_place", place).where(F.col("_place") <= limit).select(*columns)


def _named(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("label").alias(f"{side}_label"))


def first_distinct(rows: DataFrame, by: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """The first distinct rows of each key. What is dropped is dropped before the shuffle too, so a hot key sends `limit` rows a task."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))
    return rows.select(*by, *order).withColumn("_place", place).where(F.col("_place") <= limit).drop("_place").distinct()


def _looked_up(nodes: DataFrame, questions: DataFrame, keywords: Sequence[str], hits: DataFrame | None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes, questions, and for each of some columns of keywords the keys that they find; all are read many times, so they are checkpoints.

    With hits, the keyword_keys of these and other questions, the caller has seen to that.
    """
    if hits is None:
        nodes, questions = held_nodes(nodes), materialize(questions.select("question_id", *keywords))
        each = [questions.select(F.col(kw).alias("keyword")) for kw in keywords]
        hits = materialize(keyword_keys(nodes, reduce(DataFrame.union, each)))
        if len(each) == 1:
            return nodes, questions, [hits]
    return nodes, questions, [hits.join(questions.select(F.col(kw).alias("keyword")).distinct(), "keyword", "left_semi") for kw in keywords]


def _nodes_of(keys: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """keyword and the nodes that it matches: <side>_id, <side>_name, <side>_label."""
    return _keyed(nodes, side).join(keys, ["kind", "text"]).select("keyword", f"{side}_id", f"{side}_name", f"{side}_label").distinct()


def _first_found(questions: DataFrame, keys: DataFrame, nodes: DataFrame, side: str, rows: Callable[[DataFrame], DataFrame], order: Sequence[str], limit: int, fits: Column | None = None) -> DataFrame:
    """The first rows of what each question's kw1 finds: question_id and the columns of order.

    rows: from start nodes (<side>_id, <side>_name, <side>_label, by) to their rows, with `by` as it was. The first rows of a name are found once for all of
    its nodes and keywords, then those of a keyword; questions meet no more than these. So many questions with few keywords, or many nodes with
    few names, cost no more than the nodes' rows. fits: a condition on keyword and a row that all names' keys meet.
    """
    start, columns = _keyed(nodes, side), [f"{side}_id", f"{side}_name", f"{side}_label"]
    names = keys.where("kind = 'name'").select("keyword", F.col("text").alias("by"))
    named = start.where("kind = 'name'").select(*columns, F.col("text").alias("by")).join(names.select("by").distinct(), "by", "left_semi")
    single = start.where("kind <> 'name'").join(keys.where("kind <> 'name'"), ["kind", "text"]).select(*columns, F.col("keyword").alias("by"))
    found = rows(single).select(F.col("by").alias("keyword"), *order)
    best = first_distinct(rows(named), ["by"], order, limit).join(names, "by").select("keyword", *order).unionByName(found if fits is None else found.where(fits))
    asked = questions.select("question_id", F.col("kw1").alias("keyword")).where("keyword is not null").distinct()
    return asked.join(first_distinct(best, ["keyword"], order, limit), "keyword").select("question_id", *order)


def hop(nodes: DataFrame, edges: DataFrame, questions: DataFrame, relations: Sequence[str], direction: str = "forward", target_label: str | None = None, limit: int = LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """One hop from the nodes that kw1 matches, along or against the edges of some relations."""
    start, end = ("from", "to") if direction == "forward" else ("to", "from")
    nodes, questions, (keys,) = _looked_up(nodes, questions, ["kw1"], hits)
    ends = _named(nodes, end) if target_label is None else _named(nodes, end).where(F.col(f"{end}_label") == target_label)
    wanted = edges.where(F.col("relation_type").isin(*relations)).join(ends, f"{end}_id")
    rows = lambda starts: starts.join(wanted, f"{start}_id").select("by", F.col("from_name").alias("subject"), F.col("relation_type").alias("relation"), F.col("to_name").alias("object"), "from_id", "to_id")
    return _first_found(questions, keys, nodes, start, rows, ["subject", "relation", "object", "from_id", "to_id"], limit)


def two_hop_remedy(nodes: DataFrame, edges: DataFrame, questions: DataFrame, limit: int = LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """Herb <- contains - remedy - treats -> disease or symptom. Of a remedy's targets the first ones are enough."""
    nodes, questions, (keys,) = _looked_up(nodes, questions, ["kw1"], hits)
    inside = edges.where(F.col("relation_type") == CONTAINS).select(F.col("from_id").alias("remedy_id"), F.col("to_id").alias("herb_id"))
    treats = edges.where(F.col("relation_type").isin(*TREATS)).select(F.col("from_id").alias("remedy_id"), F.col("to_id").alias("target_id"))
    named = first_distinct(treats.join(_named(nodes, "target"), "target_id"), ["remedy_id"], ["target_name", "target_id"], limit).join(_named(nodes, "remedy"), "remedy_id")
    found = inside.join(named, "remedy_id")
    rows = lambda herbs: herbs.where(F.col("herb_label") == HERB).join(found, "herb_id").select("by", F.col("herb_name").alias("subject"), F.col("remedy_name").alias("remedy"), F.col("target_name").alias("object"), "herb_id", "remedy_id", "target_id")
    return _first_found(questions, keys, nodes, "herb", rows, ["subject", "remedy", "object", "herb_id", "remedy_id", "target_id"], limit)


def _pairs(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "kw1", "kw2").where("kw1 is not null and kw2 is not null").distinct()


def _both(nodes: DataFrame, questions: DataFrame, hits: DataFrame | None, side: tuple[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes and questions as _looked_up has them, then the nodes of the first and of the second keywords: kw1 or kw2, and the columns of their side."""
    nodes, questions, keys = _looked_up(nodes, questions, ["kw1", "kw2"], hits)
    return nodes, questions, *(_nodes_of(k, nodes, s).withColumnRenamed("keyword", kw) for k, kw, s in zip(keys, ("kw1", "kw2"), side))


def check_relation(nodes: DataFrame, edges: DataFrame, questions: DataFrame, relations: Sequence[str], hits: DataFrame | None = None) -> DataFrame:
    """question_id and found: whether an edge joins a node that kw1 matches to one that kw2 matches. Pairs of keywords are looked up, not questions."""
    nodes, questions, left, right = _both(nodes, questions, hits, ("from", "to"))
    wanted = edges.where(F.col("relation_type").isin(*relations)).select("from_id", "to_id")
    reached = left.select("kw1", "from_id").join(wanted, "from_id").select("kw1", "to_id").distinct()
    linked = reached.join(right.select("kw2", "to_id"), "to_id").select("kw1", "kw2").distinct()
    yes = _pairs(questions).join(linked, ["kw1", "kw2"]).select("question_id").distinct()
    return questions.select("question_id").join(yes.withColumn("hit", F.lit(True)), "question_id", "left").select("question_id", F.coalesce("hit", F.lit(False)).alias("found"))


def treatments_of(nodes: DataFrame, edges: DataFrame, questions: DataFrame, prefer: str = REMEDY, limit: int = LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """What treats, or has a function on, a disease or symptom that kw1 matches; sources of the preferred label first."""
    nodes, questions, (keys,) = _looked_up(nodes, questions, ["kw1"], hits)
    wanted = edges.where(F.col("relation_type").isin(*TREATS, *FUNCTION)).join(_named(nodes, "from"), "from_id")
    rows = lambda starts: starts.where(F.col("to_label").isin(DISEASE, SYMPTOM)).join(wanted, "to_id").select("by", F.when(F.col("from_label") == prefer, 1).otherwise(2).alias("rank"), F.col("from_name").alias("subject"), F.col("relation_type").alias("relation"), F.col("to_name").alias("object"), "from_id", "to_id")
    return _first_found(questions, keys, nodes, "to", rows, ["rank", "subject", "relation", "object", "from_id", "to_id"], limit)


def herbs_by_attribute(nodes: DataFrame, edges: DataFrame, questions: DataFrame, relations: Sequence[str] = ("CO_TINH", "CO_VI", "QUY_KINH"), limit: int = LIMIT) -> DataFrame:
    """Herbs with an attribute that kw2 matches."""
    asked = questions.select("question_id", F.col("kw2").alias("kw1"), F.lit(None).cast("string").alias("kw2"))
    return hop(nodes, edges, asked, relations, "backward", None, limit)


def intersect_relations(nodes: DataFrame, edges: DataFrame, questions: DataFrame, limit: int = LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """Herbs with an edge to what kw1 matches and an edge to what kw2 matches."""
    nodes, questions, *found = _both(nodes, questions, hits, ("to", "to"))
    herbs = _named(nodes, "from").where(F.col("from_label") == HERB).select("from_id", "from_name").distinct()
    of_herbs = edges.select("from_id", "to_id").join(herbs.select("from_id").distinct(), "from_id", "left_semi")
    first, second = (ends.select(kw, "to_id").join(of_herbs, "to_id").select(kw, "from_id").distinct() for kw, ends in zip(("kw1", "kw2"), found))
    # A herb has few keywords of either kind; their pairs keep their first herbs, whether they are asked for or not.
    both = first.join(second, "from_id").join(herbs, "from_id").withColumnRenamed("from_name", "subject")
    return _pairs(questions).join(first_distinct(both, ["kw1", "kw2"], ["subject", "from_id"], limit), ["kw1", "kw2"]).select("question_id", "subject", "from_id")


def usage_lookup(nodes: DataFrame, edges: DataFrame, questions: DataFrame, limit: int = LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """Treats or function edges, either way, between what kw1 and kw2 match."""
    wanted = edges.where(F.col("relation_type").isin(*TREATS, *FUNCTION))
    either = wanted.select(F.col("from_id").alias("a_id"), F.col("to_id").alias("b_id"), F.col("relation_type").alias("relation")).union(wanted.select("to_id", "from_id", "relation_type")).distinct()
    nodes, questions, a, b = _both(nodes, questions, hits, ("a", "b"))
    order = ["subject", "relation", "object", "a_id", "b_id"]
    both = a.join(either, "a_id").join(b, "b_id").withColumnsRenamed({"a_name": "subject", "b_name": "object"})
    return _pairs(questions).join(first_distinct(both, ["kw1", "kw2"], order, limit), ["kw1", "kw2"]).select("question_id", *order)


def split_usage_question(questions: DataFrame) -> DataFrame:
    """kw1 of the form "A chữa B" becomes two keywords where kw2 is empty."""
    parts = F.split("kw1", " chữa ", 2)
    two = (F.coalesce("kw2", F.lit("")) == "") & (F.size(parts) == 2)
    return questions.withColumns({"kw1": F.when(two, F.trim(parts[0])).otherwise(F.col("kw1")), "kw2": F.when(two, F.trim(parts[1])).otherwise(F.col("kw2"))})


def entity_overview(nodes: DataFrame, edges: DataFrame, questions: DataFrame, limit: int = LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """Every node that kw1 matches with its outgoing edges, or with defaults if it has none."""
    nodes, questions, (keys,) = _looked_up(nodes, questions, ["kw1"], hits)
    out = edges.join(_named(nodes, "to"), "to_id").select("from_id", "relation_type", "to_name", "to_id")
    none = lambda c: F.coalesce(c, F.lit("-")).alias({"relation_type": "relation", "to_name": "object"}.get(c, c))
    rows = lambda starts: starts.join(out, "from_id", "left").select("by", F.col("from_name").alias("subject"), none("relation_type"), none("to_name"), "from_id", none("to_id"))
    return _first_found(questions, keys, nodes, "from", rows, ["subject", "relation", "object", "from_id", "to_id"], limit)


def neighbourhood(nodes: DataFrame, edges: DataFrame, questions: DataFrame, limit: int = 40) -> DataFrame:
    """Links, either way, of nodes whose name contains kw1."""
    nodes, questions, (keys,) = _looked_up(nodes, questions, ["kw1"], None)
    either = edges.select(F.col("from_id").alias("a_id"), F.col("to_id").alias("b_id"), F.col("relation_type").alias("relation")).union(edges.select("to_id", "from_id", "relation_type"))
    links = either.join(_named(nodes, "b"), "b_id")
    rows = lambda starts: starts.join(links, "a_id").withColumnsRenamed({"a_name": "source", "b_name": "target"})
    # What a keyword finds by an id or an alias may have another name.
    return _first_found(questions, keys, nodes, "a", rows, ["source", "target", "relation", "a_id", "b_id"], limit, F.col("source").contains(F.col("keyword")))


def display_nodes(links: DataFrame) -> DataFrame:
    """Nodes to draw for a neighbourhood's links: centres first, so a node that is both counts as a centre."""
    both = links.select("question_id", F.col("a_id").alias("id"), F.col("source").alias("name"), F.lit(1).alias("grp")).union(links.select("question_id", "b_id", "target", F.lit(2)))
    return both.groupBy("question_id", "id", "name").agg(F.min("grp").alias("grp"))


def negative_pairs(herbs: DataFrame, compounds: DataFrame, edges: DataFrame, per_herb: int = 3, seed: int = 42, slots: int = 64, rows: int = 1 << 18) -> DataFrame:
    """(herb, compound) pairs without an edge, a few candidates a herb drawn by hash; never all pairs.

    herbs: herb_id; compounds: compound_id. Compounds are numbered within each slot, by their digest: there are as many slots as keep one to about
    `rows`, and no fewer than `slots`. Candidate k of a herb is the compound whose slot and number its digest gives, modulo what there is.
    """
    compounds = compounds.distinct()
    slots = max(slots, -(-compounds.count() // rows))
    digest = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *c))
    part = lambda d, at, below: (F.conv(F.substring(d, at, 8), 16, 10).cast("long") % below).cast("int")
    numbered = compounds.withColumn("slot", part(digest("compound_id"), 1, slots))
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy("slot").orderBy("compound_id")) - 1)
    sizes = numbered.groupBy("slot").agg(F.count("*").alias("size"))  # a row for each slot
    drawn = herbs.distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_herb)))).withColumn("digest", digest("herb_id", F.col("k").cast("string")))
    drawn = drawn.withColumn("slot", part("digest", 1, slots)).join(F.broadcast(sizes), "slot").withColumn("number", part("digest", 9, F.col("size")))
    pairs = drawn.join(numbered, ["slot", "number"]).select("herb_id", "compound_id").distinct()
    known = edges.where(F.col("relation_type") == HAS_COMPOUND).select(F.col("from_id").alias("herb_id"), F.col("to_id").alias("compound_id"))
    return pairs.join(known, ["herb_id", "compound_id"], "left_anti")


def endpoint_ids(edges: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Ids that edges use, and the hubs' (id), which need no edge."""
    ids = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id"))
    return (ids if hubs is None else ids.union(hubs.select("id"))).distinct()


def remedies_without_ingredients(edges: DataFrame) -> DataFrame:
    """Remedies that treat something except those that contain something."""
    treat = edges.where(F.col("relation_type").isin(*TREATS)).select(F.col("from_id").alias("remedy_id"))
    return treat.subtract(edges.where(F.col("relation_type") == CONTAINS).select("from_id"))


def constraint_intersection(edges: DataFrame, first: Column, second: Column) -> DataFrame:
    """Ids of nodes with an edge of each kind."""
    return edges.where(first).select("from_id").intersect(edges.where(second).select("from_id"))


def filter_by_intent(hits: DataFrame, allowed: DataFrame, least: float = 0.94, exact: float = 2.0) -> DataFrame:
    """hits (intent, relation, score) whose relation their intent allows and whose score is high enough, or exact."""
    good = (F.col("score") >= least) | (F.col("score") == exact)
    return hits.where(good).join(allowed.select("intent", "relation").distinct(), ["intent", "relation"], "left_semi")


def hybrid_union(exact: DataFrame, vector: DataFrame, record: Sequence[str], exact_score: float = 2.0) -> DataFrame:
    """Exact hits (score 2) and vector hits as one table: a record found both ways keeps its higher score."""
    both = exact.select(*record).withColumn("score", F.lit(exact_score)).unionByName(vector.select(*record, "score"))
    return both.groupBy(*record).agg(F.max("score").alias("score"))


def rank_hits(hits: DataFrame, k: int = 5) -> DataFrame:
    """Top k of each question: weight 3 if a keyword names subject or object, 1.5 if it is part of one, else the score.

    hits: question_id, position, kw1, kw2, subject, object, score. Ties keep their position.
    """
    ends = [F.lower("subject"), F.lower("object")]
    asked = [F.coalesce("kw1", F.lit("")), F.coalesce("kw2", F.lit(""))]
    exact, part = F.lit(False), F.lit(False)
    for kw in asked:
        for end in ends:
            exact |= (kw != "") & (kw == end)
            part |= (kw != "") & end.contains(kw)
    weighted = hits.withColumn("weight", F.when(exact, 3.0).when(part, 1.5).otherwise(F.col("score")))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("weight"), "position"))
    return weighted.withColumn("place", place).where(F.col("place") <= k).withColumn("bucket", F.when(F.col("weight") >= 3, "exact").otherwise("related"))


def first_names(named: DataFrame, keys: Sequence[str], name: str, k: int, alias: str) -> DataFrame:
    """For each key the first k distinct names, sorted. Ranked, then collected, so a group's size doesn't matter."""
    each = named.select(*keys, name).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(name))
    return each.withColumn("_p", place).where(F.col("_p") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list(name)).alias(alias))


def _bucket(end: str, buckets: int = 1 << 16) -> Column:
    return F.pmod(F.xxhash64(end), F.lit(buckets))


def _meeting(many: DataFrame, one: DataFrame, key: str, spread: str, hot: DataFrame, tasks: int) -> DataFrame:
    """many joined with one by key in `tasks` tasks and the shares of hot keys: a hot key's rows of `many` are dealt out by `spread`, those of `one` stand in every share."""
    here = F.broadcast(hot.where(F.col("_end") == key).select("_bucket", "_shares"))
    shares = F.coalesce("_shares", F.lit(1)).cast("long")
    told = lambda df: df.withColumn("_bucket", _bucket(key)).join(here, "_bucket", "left")
    left = told(many).select(*(c for c in many.columns if c != "_share"), F.pmod(F.xxhash64(spread), shares).alias("_share"))
    right = told(one).select(*one.columns, F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("_share"))
    return left.repartition(tasks, key, "_share").join(right.repartition(tasks, key, "_share"), [key, "_share"])


def facts_per_entity(nodes: DataFrame, edges: DataFrame, label: str, k: int = 5, rows: int = 500_000, many: int = 100_000) -> DataFrame:
    """For each (node of a label, relation): the first k distinct names of its objects, sorted. Edges may be repeated.

    Edges meet names by object, then labels by subject: two exchanges of all edges, both in tasks of about `rows` edges, however many there are.
    Ids of `many` edges or more, told by buckets of their hashes, are dealt out in shares of `many`; the first k names of each share meet again.
    """
    edges = edges.select("from_id", "relation_type", "to_id").where("from_id is not null and to_id is not null")
    ends = F.array(*(F.struct(F.lit(c).alias("_end"), _bucket(c).alias("_bucket")) for c in ("from_id", "to_id")))
    # A few numbers for each bucket, not for each id.
    counts = materialize(edges.select(F.inline(ends)).groupBy("_end", "_bucket").agg(F.count("*").alias("_n")))
    total = counts.where("_end = 'from_id'").agg(F.sum("_n")).first()[0]
    tasks = -(-(total or 0) // rows) or 1
    hot = counts.where(F.col("_n") >= many).select("_end", "_bucket", F.ceil(F.col("_n") / many).alias("_shares"))
    named = _meeting(edges, nodes.select(F.col("id").alias("to_id"), F.col("name").alias("to_name")), "to_id", "from_id", hot, tasks)
    subject = nodes.where(F.col("label") == label).select(F.col("id").alias("from_id")).distinct()
    each = _meeting(named, subject, "from_id", "to_id", hot, tasks).select("from_id", "relation_type", "_share", "to_name").distinct()
    place = F.row_number().over(Window.partitionBy("from_id", "relation_type", "_share").orderBy("to_name"))
    return first_names(each.withColumn("_place", place).where(F.col("_place") <= k), ["from_id", "relation_type"], "to_name", k, "facts")


def multi_constraint_groups(nodes: DataFrame, edges: DataFrame, first: str, second: str, k: int = 10) -> DataFrame:
    """(object of one relation, object of another) with more than one herb: how many, and the first k names.

    Names are ranked, not collected, so a group's size doesn't matter.
    """
    herbs = nodes.where(F.col("label") == HERB).select(F.col("id").alias("from_id"), "name")
    a = edges.where(F.col("relation_type") == first).select("from_id", F.col("to_id").alias("first_id"))
    b = edges.where(F.col("relation_type") == second).select("from_id", F.col("to_id").alias("second_id"))
    names = a.join(b, "from_id").join(herbs, "from_id").groupBy("first_id", "second_id", "name").agg(F.countDistinct("from_id").alias("n"))
    group = Window.partitionBy("first_id", "second_id")
    ranked = names.withColumn("place", F.row_number().over(group.orderBy("name"))).withColumn("n_herbs", F.sum("n").over(group)).where("n_herbs > 1")
    return ranked.where(F.col("place") <= k).groupBy("first_id", "second_id", "n_herbs").agg(F.sort_array(F.collect_list("name")).alias("herbs"))


def treatment_groups(edges: DataFrame) -> DataFrame:
    """Each disease or symptom with the number of its distinct sources and the least of them."""
    treats = edges.where(F.col("relation_type").isin(*TREATS))
    return treats.groupBy("to_id").agg(F.countDistinct("from_id").alias("n_sources"), F.min("from_id").alias("first_source"))


def sample_per_pattern(df: DataFrame, pattern: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each pattern in the order of a keyed digest: the same rows however the table is partitioned."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy(pattern).orderBy(digest, key))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
