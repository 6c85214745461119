"""Rule-based question parsing, generated question sets, and checks of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.sources.shared import materialize

from .retrieve import CONTAINS, HERB, REMEDY, TREATS, check_relation, entity_overview, first_names, held_nodes, hop, intersect_relations, keyword_keys, negative_pairs, treatments_of, two_hop_remedy, usage_lookup

COMPOUND = "HoatChat"

#: Phrases of politeness that say nothing, taken out of a question wherever they stand.
POLITE = (
    r"(bác ơi|cho hỏi|cho mình hỏi|thưa bác sĩ|bác sĩ cho em hỏi|dạ|nghe nói|có ai biết)",
    r"(làm ơn cho hỏi|hỏi chút|vui lòng cho biết|thầy thuốc ơi|cho em hỏi)",
)
BOOLEAN, BOTH, USAGE, CURES, REMEDY_OF = "KIEM_TRA_BOOLEAN", "TIM_DA_QUAN_HE", "TIM_HUONG_DAN_SU_DUNG", "TIM_THUOC_CHUA_BENH", "TIM_CONG_DUNG_BAI_THUOC_TU_VI_THUOC"
#: The rules in the order they are tried: (intent, pattern of the questions it is for, forms with the groups of their first and second
#: keyword, words that are taken out of the question to make the first keyword where no form fits).
RULES = (
    (USAGE, r"để chữa bệnh .*?, vị thuốc .*? được dùng với liều lượng", ((r"để chữa bệnh (.*?), vị thuốc (.*?) được dùng với liều lượng", 2, 1),), ()),
    (BOTH, r"(?s)^(?=.*vừa có tính)(?=.*vừa trực tiếp chữa bệnh)", ((r"vừa có tính (.*?) vừa trực tiếp chữa bệnh (.*)", 1, 2),), ()),
    # The last forms of this rule and of TIM_VI are for questions that generate_qa asks and the others leave whole.
    (BOOLEAN, r"(không|ko)\z", ((r"vị thuốc (.*?) có (vị|tính|quy kinh|chứa hoạt chất|quy vào kinh) (.*?) không", 1, 3), (r"vị thuốc (.*?) có hoạt chất (.*?) không", 1, 2)), ("không", "vị thuốc")),
    (REMEDY_OF, r"tham gia vào bài thuốc|bằng bài thuốc chứa", ((r"vị thuốc (.*?) tham gia vào bài thuốc", 1, 0), (r"bằng bài thuốc chứa (.*)", 1, 0)), ()),
    (CURES, r"dùng vị thuốc hoặc bài thuốc nào để chữa|uống thuốc gì", ((r"bệnh (.*?) có thể dùng", 1, 0),), ("chữa bệnh",)),
    ("TIM_VI", r"có vị gì|vị của", ((r"vị thuốc (.*?) có vị gì", 1, 0), (r"vị của (.*?) là", 1, 0), (r"cho tôi biết vị của (.*)", 1, 0)), ()),
    ("TIM_TINH", r"có tính gì|tính chất của", ((r"vị thuốc (.*?) có tính gì", 1, 0), (r"tính chất của (.*?) là", 1, 0)), ()),
    ("TIM_QUY_KINH", r"quy vào kinh nào|kinh mạch nào", ((r"vị thuốc (.*?) quy vào kinh nào", 1, 0), (r"kinh mạch nào liên quan đến (.*)", 1, 0)), ()),
    ("TIM_HOAT_CHAT_CUA_THUOC", r"chứa hoạt chất gì|thành phần hóa học", ((r"vị thuốc (.*?) chứa hoạt chất gì", 1, 0), (r"thành phần hóa học của (.*?) gồm", 1, 0)), ()),
    ("TIM_CONG_NANG", r"có công năng gì|công năng của", ((r"vị thuốc (.*?) có công năng gì", 1, 0), (r"công năng của (.*)", 1, 0)), ()),
    ("TIM_TAC_DUNG_DUOC_LY", r"tác dụng dược lý|cơ chế tác dụng", ((r"tác dụng dược lý của (.*?) ra sao", 1, 0), (r"cơ chế tác dụng của (.*?) là", 1, 0)), ()),
)
UNKNOWN = "UNKNOWN"
#: Shorter ways of asking, for questions that no rule is for.
SHORT_FORMS = (
    (USAGE, r"^cách dùng (.+?) (?:chữa|trị) (.+)$", 1, 2),
    (BOTH, r"^(?:vị thuốc|thuốc) nào có (.+?) và (.+)$", 1, 2),
    (REMEDY_OF, r"^bài thuốc có (.+?) chữa (?:bệnh )?gì$", 1, 0),
    (CURES, r"^(?:thuốc|bài thuốc|cây) (?:nào )?(?:chữa|trị) (.+)$", 1, 0),
)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_questions(questions: DataFrame, short_forms: bool = False) -> DataFrame:
    """questions with intent, k1 and k2 (empty if there is none) by the first rule that is for them; UNKNOWN if none is.

    Questions are lower-cased, freed of politeness and of a mark at their end. A keyword that a rule's forms don't find is the whole question. Letters
    must be composed (NFC). short_forms: questions that no rule is for are tried against some shorter ways of asking. A null question is
    UNKNOWN, with empty keywords.
    """
    text = F.lower(F.coalesce("question", F.lit("")))
    for phrase in POLITE:
        text = F.regexp_replace(text, phrase, "")
    asked = questions.withColumn("_q", _strip(F.regexp_replace(_strip(text), r"[?.,!:]\z", "")))
    q, empty = F.col("_q"), F.lit("")
    group = lambda form, n: F.regexp_extract(q, form, n) if n else empty
    intent, k1, k2 = F, F, F
    for name, fits, forms, without in RULES:
        first, second = empty, empty
        for form, one, two in reversed(forms):
            hit = q.rlike(form)
            first, second = F.when(hit, group(form, one)).otherwise(first), F.when(hit, group(form, two)).otherwise(second)
        rest = q
        for word in without:
            rest = F.replace(rest, F.lit(word), empty)
        none = ~q.rlike("|".join(f"(?:{form})" for form, _, _ in forms))
        own = q.rlike(fits)
        intent, k1, k2 = intent.when(own, name), k1.when(own, F.when(none, rest).otherwise(first)), k2.when(own, second)
    for name, form, one, two in SHORT_FORMS if short_forms else ():
        own = q.rlike(form)
        intent, k1, k2 = intent.when(own, name), k1.when(own, group(form, one)), k2.when(own, group(form, two))
    intent, k1, k2 = intent.otherwise(UNKNOWN), _strip(k1.otherwise(empty)), _strip(k2.otherwise(empty))
    k1 = F.when(k1 == "", q).otherwise(k1)
    for word in ("vị thuốc", "bài thuốc"):
        k1 = F.replace(k1, F.lit(word), empty)
    for word in ("bệnh", "chứng"):
        k2 = F.replace(k2, F.lit(word), empty)
    return asked.withColumns({"intent": intent, "k1": _strip(k1), "k2": _strip(k2)}).drop("_q")


def _difficulty(key: Column) -> Column:
    """easy, medium, hard as 50, 30 and 20 of a hundred, by a digest of the key."""
    n = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long") % 100
    return F.when(n < 50, "easy").when(n < 80, "medium").otherwise("hard")


#: What a relation is called in questions and contexts, its intent, and two ways of asking for it (X: the herb).
ATTRIBUTES = {
    "CO_VI": ("Vị", "TIM_VI", "Vị thuốc X có vị gì?", "Cho tôi biết vị của X."),
    "CO_TINH": ("Tính", "TIM_TINH", "Vị thuốc X có tính gì?", "Tính chất của X là gì?"),
    "QUY_KINH": ("Quy kinh", "TIM_QUY_KINH", "Vị thuốc X quy vào kinh nào?", "Kinh mạch nào liên quan đến X?"),
    "CO_CHUA_HOAT_CHAT": ("Hoạt chất", "TIM_HOAT_CHAT_CUA_THUOC", "Vị thuốc X chứa hoạt chất gì?", "Thành phần hóa học của X gồm những gì?"),
    "CO_CONG_NANG": ("Công năng", "TIM_CONG_NANG", "Vị thuốc X có công năng gì?", "Hãy cho biết công năng của X."),
    "CO_TAC_DUNG_DUOC_LY": ("Tác dụng dược lý", "TIM_TAC_DUNG_DUOC_LY", "Tác dụng dược lý của X ra sao?", "Cơ chế tác dụng của X là gì?"),
}
CHECKED = ("CO_VI", "CO_TINH", "QUY_KINH", "CO_CHUA_HOAT_CHAT")
MULTI_HOP = ("Vị thuốc X tham gia vào bài thuốc để chữa những bệnh gì?", "Bệnh nào có thể chữa bằng bài thuốc chứa X?")
#: The first line of a context, and words that a name is freed of, in their order.
CONTEXT_HEAD = "Dữ liệu dược điển:"
NOT_OF_NAMES = ("Vị thuốc", "vị thuốc", "Bài thuốc", "bài thuốc", "Triệu chứng", "triệu chứng", "Bệnh", "bệnh", "Công năng", "công năng", "Hoạt chất", "hoạt chất", "Hợp chất", "hợp chất", "Tính", "tính")
#: What kind of reasoning an intent takes.
GROUPS = {BOOLEAN: "BOOLEAN", BOTH: "MULTI_CONSTRAINT", USAGE: "HOW_TO", CURES: "REASONING", REMEDY_OF: "REASONING"} | {v[1]: "ATTRIBUTE" for v in ATTRIBUTES.values()}


def question_name(name: Column) -> Column:
    """A name as questions have it: without tags in brackets and words for its kind, blanks squeezed, the first letter large."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), rf"\[.*?\]|{'|'.join(NOT_OF_NAMES)}", "")
    out = _strip(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.concat(F.upper(F.substring(out, 1, 1)), out.substr(F.lit(2), F.length(out)))


def _context(kind: str, name: Column, label: Column | str, values: Column) -> Column:
    """What an answer may be drawn from: a head, "kind: name" and "- label: values"."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lit(f"{CONTEXT_HEAD}\n{kind}: "), name, F.lit("\n- "), label, F.lit(": "), values)


def generate_qa(nodes: DataFrame, edges: DataFrame, usage: DataFrame, per_pattern: int, second: tuple[str, ...] = TREATS, seed: int = 42, k: int = 5) -> DataFrame:
    """pattern, intent, intent_group, key, question, context, facts, answer, difficulty: per_pattern questions of each pattern, drawn by digest.

    single_relation: an attribute of a herb; multi_hop: what remedies with a herb treat; reverse_search_positive and _negative: whether a herb has an
    attribute that it has, or a compound that it hasn't (half of per_pattern each); multi_relation: herbs of a nature that also have an edge of
    the second kind to one thing, more than one; how_to_usage: dosage and use (usage: from_id, to_id, dosage, how) of a treatment;
    treatment_search: what treats an illness. Facts are the first k, sorted. Each question is one that parse_questions reads back.

    Each pattern's questions are drawn by a top-n of their own; names are joined to edges once, in a checkpoint. Where facts are gathered for a key
    of the edges themselves, the keys are drawn first, and facts are gathered for these alone.
    """
    name = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("label").alias(f"{side}_label"))
    named = materialize(edges.select("from_id", "relation_type", "to_id").join(name("from"), "from_id").join(name("to"), "to_id"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    c, called = F.col, lambda col: question_name(F.col(col))
    low = lambda col: F.lower(called(col))
    names = F.transform("facts", question_name)
    joined = F.array_join(names, ", ")
    pick = lambda part: F.element_at(F.create_map(*[F.lit(x) for r, v in ATTRIBUTES.items() for x in (r, v[part])]), c("relation_type"))
    digest = lambda pattern, key: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(pattern), key))
    fill = lambda template, col: F.replace(template, F.lit("X"), low(col))

    def row(df: DataFrame, pattern: str, intent, key, question, context, facts=names, answer=joined, most: int = per_pattern) -> DataFrame:
        """The first `most` of a pattern. question: a text, or two of which the key's digest takes one. Texts are written for what is drawn alone."""
        first = df.withColumn("key", key).withColumn("digest", digest(pattern, c("key"))).orderBy("digest", "key").limit(most)
        one = question if isinstance(question, Column) else F.when(F.conv(F.substring("digest", 32, 1), 16, 10).cast("int") % 2 == 0, question[0]).otherwise(question[1])
        return first.select(F.lit(pattern).alias("pattern"), (F.lit(intent) if isinstance(intent, str) else intent).alias("intent"), "key", one.alias("question"), context.alias("context"), facts.alias("facts"), answer.alias("answer"))

    def drawn_keys(df: DataFrame, pattern: str, key: Column, among: DataFrame | None = None) -> DataFrame:
        """Rows of df whose key is one of the first that `row` could take, out of df's or those of `among`."""
        keys = (df if among is None else among).select(key.alias("_key")).distinct()
        first = keys.orderBy(digest(pattern, c("_key")), "_key").limit(per_pattern)
        return df.withColumn("_key", key).join(F.broadcast(first), "_key", "left_semi").drop("_key")

    of_herb = named.where((c("from_label") == HERB) & c("relation_type").isin(*ATTRIBUTES))
    herb_relation = F.concat_ws(":", "from_id", "relation_type")
    single = first_names(drawn_keys(of_herb, "single_relation", herb_relation), ["from_id", "from_name", "relation_type"], "to_name", k, "facts")
    parts = [row(single, "single_relation", pick(1), herb_relation, (fill(pick(2), "from_name"), fill(pick(3), "from_name")), _context("Vị thuốc", called("from_name"), pick(0), joined))]

    inside = named.where(c("relation_type") == CONTAINS).select(c("from_id").alias("remedy_id"), c("to_id").alias("herb_id"))
    treats = named.where((c("from_label") == REMEDY) & c("relation_type").isin(*TREATS)).select(c("from_id").alias("remedy_id"), "to_name")
    herbs = nodes.where(c("label") == HERB).select(c("id").alias("herb_id"), "name")
    joined_herbs = inside.join(treats.select("remedy_id").distinct(), "remedy_id", "left_semi").join(herbs, "herb_id", "left_semi")
    inside = drawn_keys(inside, "multi_hop", c("herb_id"), joined_herbs)
    hop = first_names(inside.join(treats, "remedy_id"), ["herb_id"], "to_name", k, "facts").join(herbs, "herb_id")
    parts.append(row(hop, "multi_hop", REMEDY_OF, c("herb_id"), tuple(fill(F.lit(t), "name") for t in MULTI_HOP), _context("Vị thuốc", called("name"), "Tham gia bài thuốc chữa các bệnh", joined)))

    half, yes, no = per_pattern // 2, F.array(F.lit("Có")), F.array(F.lit("Không"))
    positive = of_herb.where(c("relation_type").isin(*CHECKED)).select("from_id", "to_id", "relation_type", "from_name", "to_name").distinct()
    said = text("vị thuốc ", low("from_name"), " có ", F.lower(pick(0)), " ", low("to_name"))
    asked = text("Vị thuốc ", low("from_name"), " có ", F.lower(pick(0)), " ", low("to_name"), " không?")
    parts.append(row(positive, "reverse_search_positive", BOOLEAN, F.concat_ws("+", "from_id", "relation_type", "to_id"), asked, _context("Vị thuốc", called("from_name"), pick(0), called("to_name")), yes, text("Có, ", said), half))
    pairs = negative_pairs(herbs.select("herb_id"), nodes.where(c("label") == COMPOUND).select(c("id").alias("compound_id")), named, seed=seed)
    negative = pairs.select(c("herb_id").alias("from_id"), c("compound_id").alias("to_id")).join(name("from"), "from_id").join(name("to"), "to_id")
    said, asked = text("Không, vị thuốc ", low("from_name"), " không chứa hoạt chất ", low("to_name")), text("Vị thuốc ", low("from_name"), " có chứa hoạt chất ", low("to_name"), " không?")
    parts.append(row(negative, "reverse_search_negative", BOOLEAN, F.concat_ws("-", "from_id", "to_id"), asked, _context("Vị thuốc", called("from_name"), "Ghi chú hoạt chất", text("Không chứa ", low("to_name"))), no, said, half))

    of = lambda kinds, side: of_two.where(c("relation_type").isin(*kinds)).select("from_id", "from_name", c("to_name").alias(side), c("to_id").alias(f"{side}_id"))
    of_two = named.where(c("from_label") == HERB)
    both = of(("CO_TINH",), "a").join(of(second, "b").drop("from_name"), "from_id").select("a", "a_id", "b", "b_id", "from_id", "from_name").distinct()
    many = both.groupBy("a_id", "b_id").agg(F.countDistinct("from_name").alias("n")).where("n > 1").select("a_id", "b_id")
    two = first_names(both.join(many, ["a_id", "b_id"], "left_semi"), ["a", "a_id", "b", "b_id"], "from_name", k, "facts")
    asked = text("Thuốc nào vừa có tính ", low("a"), " vừa trực tiếp chữa bệnh ", low("b"), "?")
    parts.append(row(two, "multi_relation", BOTH, F.concat_ws("+", "a_id", "b_id"), asked, _context("Bộ lọc tìm kiếm", text("Tính ", low("a"), " và trực tiếp chữa ", low("b")), "Các vị thuốc thỏa mãn", joined)))

    plain = lambda x: F.trim(F.replace(F.coalesce(x, F.lit("")), F.lit("$"), F.lit("")))
    used = usage.withColumns({"dosage": plain(c("dosage")), "how": plain(c("how"))}).where("dosage <> '' or how <> ''")
    pair = F.concat_ws("+", "from_id", "to_id")
    known = used.select("from_id", "to_id").distinct()
    for side in ("from", "to"):
        known = known.join(nodes.select(c("id").alias(f"{side}_id")), f"{side}_id", "left_semi")
    used = drawn_keys(used, "how_to_usage", pair, known).join(name("from"), "from_id").join(name("to"), "to_id")
    used = used.groupBy("from_id", "to_id", "from_name", "to_name").agg(F.min(F.when(c("dosage") != "", c("dosage"))).alias("dosage"), F.min(F.when(c("how") != "", c("how"))).alias("how"))
    used = used.withColumn("facts", F.filter(F.array("dosage", "how"), lambda x: x.isNotNull())).where(F.size("facts") > 0)
    lines = F.concat_ws(", ", text("Liều dùng: ", c("dosage")), text("Cách dùng: ", c("how")))
    unknown = lambda x: F.coalesce(x, F.lit("Theo chỉ định"))
    about = text("Để chữa bệnh ", low("to_name"), ", vị thuốc ", low("from_name"))
    parts.append(row(used, "how_to_usage", USAGE, pair, text(about, " được dùng với liều lượng và cách thức như thế nào?"), _context("Điều trị bệnh", called("to_name"), text("Sử dụng ", called("from_name")), lines), c("facts"), text(about, " có liều dùng: ", unknown(c("dosage")), " và cách dùng: ", unknown(c("how")))))

    cure = first_names(named.where(c("relation_type").isin(*TREATS)), ["to_id", "to_name"], "from_name", k, "facts")
    parts.append(row(cure, "treatment_search", CURES, c("to_id"), text("Bệnh ", low("to_name"), " có thể dùng vị thuốc hoặc bài thuốc nào để chữa?"), _context("Bệnh/Triệu chứng", called("to_name"), "Các thuốc chữa trị", joined)))

    drawn = parts[0]
    for p in parts[1:]:
        drawn = drawn.unionByName(p)
    group = F.element_at(F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair]), c("intent"))
    return drawn.withColumn("intent_group", group).withColumn("difficulty", _difficulty(F.concat_ws(":", "pattern", "key")))


def grounded_answers(answers: DataFrame, hits: DataFrame, refusals: tuple[str, ...] = ("không có thông tin", "no record")) -> DataFrame:
    """question_id and grounded: an answer names something that was found, or refuses, or nothing was found.

    answers: question_id, answer. hits: question_id, subject, object.
    """
    low = F.lower("answer")
    refuses = F.lit(False)
    for phrase in refusals:
        refuses |= low.contains(phrase)
    names = hits.select("question_id", F.lower("subject").alias("name")).union(hits.select("question_id", F.lower("object"))).where("name <> ''").distinct()
    joined = answers.join(names, "question_id", "left")
    per = joined.groupBy("question_id", "answer").agg(F.max(F.when(F.col("name").isNull(), True).otherwise(low.contains(F.col("name")))).alias("named"))
    return per.select("question_id", (F.col("named") | refuses).alias("grounded"))


def answer_questions(questions: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 30) -> DataFrame:
    """question_id, intent, subject, relation, object of every parsed question (intent, k1, k2), by the lookup of its intent; UNKNOWN gets an overview.

    Questions, nodes and what all their keywords match are checkpoints; the table is split by intent, each part is answered as a batch, and the parts
    are put together. An empty keyword finds nothing.
    """
    some = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
    # Worked out once: each of the parts below would parse all questions again.
    asked = materialize(questions.select("question_id", "intent", some(F.col("k1")).alias("kw1"), some(F.col("k2")).alias("kw2")))
    of = lambda name: asked.where(F.col("intent") == name)
    one = lambda df, subject="subject", relation="relation", object="object": df.select("question_id", F.col(subject).alias("subject"), (F.col(relation) if relation else F.lit("-")).alias("relation"), F.col(object).alias("object"))
    nodes = held_nodes(nodes)
    hits = materialize(keyword_keys(nodes, asked.select(F.col("kw1").alias("keyword")).union(asked.select("kw2"))))
    edges = materialize(edges)
    checked = (*ATTRIBUTES, *TREATS, CONTAINS)
    parts = [
        one(usage_lookup(nodes, edges, of(USAGE), k, hits)),
        one(intersect_relations(nodes, edges, of(BOTH), k, hits), relation="", object="from_id"),
        check_relation(nodes, edges, of(BOOLEAN), checked, hits).select("question_id", F.lit("-").alias("subject"), F.lit("-").alias("relation"), F.col("found").cast("string").alias("object")),
        one(two_hop_remedy(nodes, edges, of(REMEDY_OF), k, hits), relation="remedy"),
        one(treatments_of(nodes, edges, of(CURES), HERB, k, hits)),
        *(one(hop(nodes, edges, of(v[1]), (relation,), limit=k, hits=hits)) for relation, v in ATTRIBUTES.items()),
        one(entity_overview(nodes, edges, of(UNKNOWN), k, hits)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(asked.select("question_id", "intent"), "question_id").distinct()
