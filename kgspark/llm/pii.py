"""Surrogates for personal data and secrets: keyed replacements of the same type and format. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_names

#: Rounds of new attempts for surrogates that collide; each round leaves far fewer. What is left then is numbered.
MAX_ROUNDS = 12
#: Attempts that keep to the shape in all; later ones free what else stays, and grow.
IN_SHAPE = 4

#: Forms of address by gender, in five languages and two scripts.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
NEUTRAL = ("Dr", "Prof")
#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): ("Adam", "Alan", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("f", "latin"): ("Ada", "Alma", "Anna", "Carla", "Clara", "Diana", "Elena", "Emma", "Eva", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Vera"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Олег", "Павел", "Антон", "Борис", "Виктор", "Глеб"),
    ("f", "cyrillic"): ("Анна", "Вера", "Ольга", "Мария", "Елена", "Нина", "Дарья", "Софья"),
}
#: Syllables that further names are made of, and how given names end by gender and script.
SYLLABLES = {
    "latin": ("ba", "den", "fal", "gor", "hel", "jan", "kel", "lin", "mar", "nov", "pel", "ros", "sen", "tor", "val", "wes"),
    "cyrillic": ("ба", "ден", "фал", "гор", "хел", "яни", "кел", "лин", "мар", "нов", "пел", "рос", "сен", "тор", "вал", "зес"),
}
ENDINGS = {("m", "latin"): ("o", "an", "us", "er"), ("f", "latin"): ("a", "ia", "ina", "elle"), ("m", "cyrillic"): ("ан", "ин", "ор", "ек"), ("f", "cyrillic"): ("а", "ия", "ина", "ея")}

_CAPITAL = r"\p{Lu}[\p{L}\p{M}'’-]*"
_TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))
#: How keys of some services begin, and words that a secret is assigned to.
KEY_HEADS = r"AKIA|gh[pousr]_|xox[abprs]-|AIza|sk_live_|sk_test_"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
#: One expression for all types; the order settles what a text at one place is. Each begins with what its first character may
#: be, so most places are passed at once. What repeats is a character class or bounded, so a match needs no deep recursion
#: however long the text is.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "key": r"(?=[AgxGs])(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,250}|xox[abprs]-[A-Za-z0-9-]{10,250}|AIza[A-Za-z0-9_-]{35}|sk_(?:live|test)_[A-Za-z0-9]{16,250})(?![A-Za-z0-9])",
    "secret": rf"(?=[PpSsTtAa])(?<![A-Za-z]){_SECRET}(?=[A-Za-z_+/.-]{{0,250}}[0-9])[A-Za-z0-9_+/.-]{{8,250}}",
    "iban": r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?=[0-9])(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?=[0-9])(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9A-Za-z])",
    "ssn": r"(?=[0-9])(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?=[+(0-9])(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|(?=[+])(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "name": rf"(?=[MHSFDPГ])(?<![\p{{L}}])(?:{_TITLES})\.? {_CAPITAL}(?: {_CAPITAL})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds: a digit or an @, or what begins like a key or a form of address. Texts without are done.
HINT = r"[0-9@]|gh[pousr]_|xox[abprs]-|AIza|sk_(?:live|test)_|[MHSFDPA](?:rs?|s|iss|onsieur|adame|me|err|eñora?|ra?|rau|rof|KIA)(?:\.? \p{Lu}|[0-9A-Z])|Госпо"


def kind_of(entity: Column) -> Column:
    """The first type whose pattern the entity matches as a whole."""
    out = F
    for kind, pattern in PATTERNS.items():
        out = out.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return out


def is_real(kind: Column, mention: Column) -> Column:
    """False for numbers that only look like a type: a card's check sum must be right, and 12.345.678 is a number, not a phone."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return F.when(kind == "card", _luhn(digits) == 0).when(kind == "phone", ~mention.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$")).otherwise(F.lit(True))


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share: case of an address, separators of a number don't matter; of a name its last word, of a secret its value."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    last = F.substring_index(mention, " ", -1)
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "name", last).when(kind == "secret", F.regexp_replace(mention, f"^{_SECRET}", "")).otherwise(mention)


def given_name(kind: Column, mention: Column) -> Column:
    """The word between form of address and family name; null without one."""
    words = F.split(mention, " ")
    return F.when((kind == "name") & (F.size(words) > 2), F.get(words, F.lit(1)))


def is_female(mention: Column) -> Column:
    """What a name's form of address says of the gender; null for those that say nothing."""
    title = F.regexp_extract(mention, r"^(\p{L}+)", 1)
    return F.when(title.isin(*FEMALE), True).when(title.isin(*MALE), False)


def _draw(digest: Column, place: Column, below) -> Column:
    """A number below `below` from byte pair `place` of a hex digest, wrapped around."""
    at = F.pmod(place, F.lit(16)) * 4 + 1
    return F.pmod(F.conv(F.substring(digest, 1, 64).substr(at.cast("int"), F.lit(4)), 16, 10).cast("int"), F.lit(below)).cast("int")


def _characters(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: s.substr(i, F.lit(1)))


def _pick(values, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number + 1)


def _same_shape(s: Column, digest: Column) -> Column:
    """Letters become letters of the same case, digits digits; all else stays."""

    def one(c: Column, i: Column) -> Column:
        lower, upper, digit = (F.lit(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
        step = i + F.floor(i / 16) * 7  # a long string goes round the digest with other offsets
        letter = F.pmod(_draw(digest, i, 26) + step, F.lit(26)).cast("int") + 1
        number = F.pmod(_draw(digest, i, 10) + step, F.lit(10)).cast("int") + 1
        return F.when(c.rlike("^[a-z]$"), lower.substr(letter, F.lit(1))).when(c.rlike("^[A-Z]$"), upper.substr(letter, F.lit(1))).when(c.rlike("^[0-9]$"), digit.substr(number, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_characters(s), one), "")


def _luhn(digits: Column) -> Column:
    """Check sum of a card number modulo 10."""
    n = F.length(digits)
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(_characters(digits), lambda c, i: F.when(F.pmod(n - 1 - i, F.lit(2)) == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _mod97(number: Column) -> Column:
    """What an account number leaves modulo 97, letters counting from A = 10."""

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.pmod(F.when(letter >= 10, rest * 100 + letter).otherwise(rest * 10 + F.ascii(c) - 48), F.lit(97))

    return F.aggregate(_characters(number), F.lit(0), step)


def _iban(entity: Column, rest: Column) -> Column:
    """An account number of entity's country before rest, with check digits that leave what the entity's own leave: right ones stay right."""
    country, after = entity.substr(F.lit(1), F.lit(2)), F.length(entity)
    own = _mod97(F.concat(entity.substr(F.lit(5), after), entity.substr(F.lit(1), F.lit(4))))
    check = F.pmod(own - _mod97(F.concat(rest, country, F.lit("00"))), F.lit(97))
    # Check digits run from 02 to 98.
    return F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), rest)


def surrogate(kind: Column, entity: Column, female: Column, attempt: Column, key: str) -> Column:
    """The keyed replacement of a canonical entity, in canonical form.

    email: local part and host keep their shape, the last two labels become example with the same top
    domain; phone: the first digit stays; card: same length, same check sum; ip: an address of 10.0.0.0/8 (from the fifth attempt on, any);
    iban: country, length and what it leaves modulo 97 stay; key: its prefix stays; secret: its shape; name (a family name) and given: same script, given
    names of the same gender (that of the digest where it is unknown). The attempt number enters the digest. Shapes can be used up, so
    from the fifth attempt on a phone's first digit is free and all but ip grow, by a digit or syllable an attempt (a local part by
    two letters).
    """
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), entity), 256)
    local = F.substring_index(entity, "@", 1)
    top = F.regexp_extract(entity, r"(\.[a-z]{2,})$", 1)
    host = F.substring_index(entity, "@", -1)
    labels = F.regexp_replace(host, r"(?:^|\.)[^.]+\.[^.]+$", "")
    grown = F.greatest(F.lit(0), attempt - IN_SHAPE + 1).cast("int")
    more = _same_shape(F.repeat(F.lit("x"), 2 * grown), F.sha2(F.concat(digest, F.lit("+")), 256))
    digits = _same_shape(F.repeat(F.lit("0"), grown), F.sha2(F.concat(digest, F.lit("+")), 256))
    email = F.concat(_same_shape(local, digest), more, F.lit("@"), F.when(labels != "", F.concat(_same_shape(labels, F.sha2(digest, 256)), F.lit("."))).otherwise(F.lit("")), F.lit("example"), top)
    shaped = _same_shape(entity, digest)
    phone = F.concat(F.when(attempt < IN_SHAPE, entity).otherwise(shaped).substr(F.lit(1), F.lit(1)), shaped.substr(F.lit(2), F.length(entity)), digits)
    body = F.concat(shaped.substr(F.lit(1), F.length(entity) - 1), digits)
    # The last digit counts once, so it takes what the others leave of the check sum.
    last = F.pmod(_luhn(entity) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    card = F.concat(body, last.cast("string"))
    net = F.when(attempt < IN_SHAPE, F.lit(10)).otherwise(_draw(digest, F.lit(3), 223) + 1).cast("string")
    ip = F.concat_ws(".", net, *[_draw(digest, F.lit(k), 256).cast("string") for k in range(3)])
    iban = _iban(entity, F.concat(shaped.substr(F.lit(5), F.length(entity)), digits))
    head = F.regexp_extract(entity, f"^({KEY_HEADS})", 1)
    secret = F.concat(head, shaped.substr(F.length(head) + 1, F.length(entity)), digits)
    cyrillic = entity.rlike(r"^\p{IsCyrillic}")
    woman = F.coalesce(female, _draw(digest, F.lit(9), 2) == 1)
    # Of the entity alone, so a family has one name whatever the first name is.
    own = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), entity), 256)

    def word(script: str, first: int, ending: Column) -> Column:
        syllable = lambda k: _pick(SYLLABLES[script], _draw(own, F.lit(k), 16))
        further = [F.when(grown > k, syllable(5 + k)).otherwise("") for k in range(MAX_ROUNDS - IN_SHAPE)]
        return F.initcap(F.concat(*[syllable(k) for k in range(first)], *further, ending))

    def given(script: str) -> Column:
        one = lambda g: F.when(attempt < 1, _pick(GIVEN[g, script], _draw(own, F.lit(7), len(GIVEN[g, script])))).otherwise(word(script, 3, _pick(ENDINGS[g, script], _draw(own, F.lit(8), 4))))
        return F.when(woman, one("f")).otherwise(one("m"))

    by_script = lambda make: F.when(cyrillic, make("cyrillic")).otherwise(make("latin"))
    name, first_name = by_script(lambda script: word(script, 5, F.lit(""))), by_script(given)
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "key", secret)
    return out.when(kind == "name", name).when(kind == "given", first_name).otherwise(F.concat(shaped, digits))


def numbered(kind: Column, entity: Column, number: Column, width: Column) -> Column:
    """The replacement of an entity by its number among those left over: longer than width, another one for each number.

    The kind's marks stay: top domain, country, prefix, check sum, form of address and script; an ip becomes a local
    one of version 6, since there may be no other.
    """
    places = F.lpad(number.cast("string"), F.greatest(width, F.lit(19)), "0")
    spelt = lambda script: F.initcap(F.array_join(F.transform(_characters(places), lambda c: _pick(SYLLABLES[script], c.cast("int"))), ""))
    name = F.when(entity.rlike(r"^\p{IsCyrillic}"), spelt("cyrillic")).otherwise(spelt("latin"))
    name = F.when(kind == "given", F.concat(name, F.lit("a"))).otherwise(name)
    email = F.concat(F.lit("x"), places, F.lit("@example"), F.regexp_extract(entity, r"(\.[a-z]{2,})$", 1))
    last = F.pmod(_luhn(entity) - _luhn(F.concat(F.lit("4"), places, F.lit("0"))), F.lit(10))
    card = F.concat(F.lit("4"), places, last.cast("string"))
    ip = F.concat(F.lit("fd00::"), F.regexp_replace(F.lpad(F.lower(F.hex(number)), 16, "0"), "(.{4})(?=.)", "$1:"))
    iban = _iban(entity, places)
    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "iban", iban)
    head = F.regexp_extract(entity, f"^({KEY_HEADS})", 1)
    return out.when(kind == "key", F.concat(head, places)).when(kind.isin("name", "given"), name).when(kind == "secret", F.concat(F.lit("s"), places)).when(kind == "ssn", F.concat(F.lit("8"), places)).otherwise(F.concat(F.lit("9"), places))


def assign(entities: DataFrame, key: str, rows: int = 2000) -> DataFrame:
    """kind, entity, surrogate for distinct (kind, entity) rows with female: no two share one, and none is an entity itself.

    Of entities with the same surrogate, of whatever kind, the first keeps it; the others, and those whose surrogate occurs in the corpus,
    try again with the next attempt. The rounds shrink to nothing fast; each is a checkpoint, dealt out anew by rows a task, since a
    surrogate is small in bytes and long in work. Any that are left after MAX_ROUNDS are numbered, and get values longer than
    all entities and surrogates of their kind.
    """

    def dealt(df: DataFrame) -> tuple[DataFrame, int]:
        df = materialize(df)
        n = df.count()
        return df.repartition(max(1, -(-n // rows))), n

    entities = materialize(entities)
    real = entities.select(F.col("entity").alias("surrogate")).distinct()
    pending, n = dealt(entities)
    given = None
    for attempt in range(MAX_ROUNDS):
        if not n:
            break
        tried = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("female"), F.lit(attempt), key))
        first = F.row_number().over(Window.partitionBy("surrogate").orderBy("kind", "entity")) == 1
        free = tried.withColumn("first", first).where("first").drop("first").join(real, "surrogate", "left_anti")
        if given is not None:
            free = free.join(given.select("surrogate"), "surrogate", "left_anti")
        free = materialize(free.select("kind", "entity", "surrogate"))
        given = free if given is None else given.unionByName(free)
        pending, n = dealt(pending.join(free, ["kind", "entity"], "left_anti"))
    if given is None:
        return entities.select("kind", "entity", F.col("entity").alias("surrogate"))
    if not n:
        return given
    taken = entities.select("kind", "entity").unionByName(given.select("kind", F.col("surrogate").alias("entity")))
    width = taken.groupBy("kind").agg((F.max(F.length("entity")) + 1).alias("width"))  # a row for each kind
    # Numbers of their own within parts of a kind, so that no task sees a whole kind.
    part = F.pmod(F.xxhash64("kind", "entity"), F.lit(1024))
    nth = F.row_number().over(Window.partitionBy("kind", "part").orderBy("entity"))
    left = pending.withColumn("part", part).withColumn("number", nth.cast("long") * 1024 + F.col("part"))
    left = left.join(F.broadcast(width), "kind")
    return given.unionByName(left.select("kind", "entity", numbered(F.col("kind"), F.col("entity"), F.col("number"), F.col("width")).alias("surrogate")))


def _render(kind: Column, mention: Column, value: Column, first_name: Column) -> Column:
    """The surrogate in the format of the mention: digits fall into its digits' places, a form of address and what a secret is
    assigned to stay.

    What a grown surrogate has beyond the mention's places follows at the end.
    """
    beyond = lambda places: value.substr(F.length(F.regexp_replace(mention, places, "")) + 1, F.length(value))
    nth = lambda i: F.length(F.regexp_replace(mention.substr(F.lit(1), i + 1), "[^0-9]", ""))
    digits = F.array_join(F.transform(_characters(mention), lambda c, i: F.when(c.rlike("^[0-9]$"), value.substr(nth(i), F.lit(1))).otherwise(c)), "")
    dense = lambda i: F.length(F.regexp_replace(mention.substr(F.lit(1), i + 1), " ", ""))
    spaced = F.array_join(F.transform(_characters(mention), lambda c, i: F.when(c == " ", c).otherwise(value.substr(dense(i), F.lit(1)))), "")
    digits, spaced = F.concat(digits, beyond("[^0-9]")), F.concat(spaced, beyond(" "))
    named = F.concat_ws(" ", F.substring_index(mention, " ", 1), first_name, value)
    assigned = F.concat(F.regexp_extract(mention, f"^({_SECRET})", 1), value)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", spaced).when(kind == "name", named).when(kind == "secret", assigned).otherwise(value)


def entities_of(mentions: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of mentions (kind, entity, given, female), given names as a kind of their own.

    female of a given name is what most of its mentions say; null if none says anything.
    """
    whole = mentions.groupBy("kind", "entity").agg(F.lit(None).cast("boolean").alias("female"))
    votes = F.sum(F.when(F.col("female"), 1).when(~F.col("female"), -1))
    first = mentions.where("given is not null").groupBy(F.lit("given").alias("kind"), F.col("given").alias("entity")).agg((votes >= 0).alias("female"))
    return whole.unionByName(first)


def _bare(text: Column, names: Column) -> tuple[Column, Column]:
    """(text with each full name of names (full, shown) replaced where it stands as whole words, how many there are)."""
    full = F.array_join(F.transform(names, lambda n: n["full"]), "|")
    pattern = F.concat(F.lit(r"(?=\p{Lu})(?<![\p{L}\p{M}])(?:"), full, F.lit(r")(?![\p{L}\p{M}]|['’-]\p{Lu})"))
    found, shown = F.regexp_extract_all(text, pattern, F.lit(0)), F.map_from_entries(names)
    rest = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(rest, F.transform(found, lambda f: shown[f]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""), F.size(found)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced by one without the detected personal data, and n_entities and kinds; other columns stay.

    docs: text; columns named n_entities or kinds are replaced. key: a secret; who knows it can tell which surrogate an entity has.
    One entity has one surrogate in all documents, whatever its format or form of address; different entities have different ones, and no
    surrogate is an entity of the corpus. Given and family names have theirs each, so a family keeps one name and a person
    both; where a text has a full name after a form of address, the same full name is replaced wherever it stands in that text. Null texts stay null. Repeated rows get the same text each. Texts of any length are taken whole; patterns are bounded, so
    they don't recurse. An empty table gives no rows.
    The patterns run once a row; what they find is kept in a checkpoint with the row, by a number of its own. Only rows with an entity
    meet the table of surrogates; a text is cut at its entities and joined again.
    """
    docs = docs.drop("n_entities", "kinds")
    found_in, row, shown, full = own_names(docs, "_found", "_row", "_shown", "_full")
    text = F.coalesce("text", F.lit(""))
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = materialize(docs.withColumn(found_in, found).withColumn(row, F.monotonically_increasing_id()))
    clean = marked.where(F.size(found_in) == 0)
    dirty = marked.where(F.size(found_in) > 0)
    mentions = dirty.select(F.col(row).alias("_row"), F.posexplode(found_in).alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
    mentions = mentions.withColumn("kind", F.when(is_real(F.col("kind"), F.col("mention")), F.col("kind")))
    kind, mention = F.col("kind"), F.col("mention")
    mentions = materialize(mentions.withColumns({"entity": canonical(kind, mention), "given": given_name(kind, mention), "female": F.when(kind == "name", is_female(mention))}))
    values = assign(entities_of(mentions.where("kind is not null")), key)
    # Each distinct mention is written once; then rows take theirs.
    known = mentions.where("kind is not null").select("mention", "kind", "entity", "given").distinct()
    first = values.where("kind = 'given'").select(F.col("entity").alias("given"), F.col("surrogate").alias("first_name"))
    ready = known.join(values, ["kind", "entity"]).join(first, "given", "left")
    called = F.when((kind == "name") & F.col("given").isNotNull(), F.struct(F.concat_ws(" ", "given", "entity").alias("full"), F.concat_ws(" ", "first_name", "surrogate").alias("shown")))
    ready = ready.select("mention", _render(kind, mention, F.col("surrogate"), F.col("first_name")).alias("shown"), called.alias("called"))
    ready = mentions.select("_row", "pos", "mention", "kind").join(ready, "mention", "left").withColumn("shown", F.coalesce("shown", "mention"))
    per = ready.groupBy(F.col("_row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("pos", "shown"))).alias(shown), F.count("kind").alias("n_entities"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.collect_set("called").alias(full))
    pieces = F.split("text", F.lit(ANY), -1)
    between = F.transform(pieces, lambda p: _bare(p, F.col(full))[0])
    further = F.aggregate(pieces, F.lit(0), lambda n, p: n + _bare(p, F.col(full))[1])
    named = F.size(full) > 0
    text = F.array_join(F.zip_with(F.when(named, between).otherwise(pieces), F.transform(shown, lambda x: x["shown"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    n_entities = F.col("n_entities") + F.when(named, further).otherwise(0)
    replaced = dirty.join(per, row).withColumns({"text": text, "n_entities": n_entities})
    columns = [*docs.columns, "n_entities", "kinds"]
    untouched = clean.withColumn("n_entities", F.lit(0).cast("long")).withColumn("kinds", F.array().cast("array<string>"))
    return replaced.select(*columns).unionByName(untouched.select(*columns))
