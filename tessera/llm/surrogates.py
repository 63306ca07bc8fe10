"""PII surrogates: detected entities get keyed, type-consistent replacements. DataFrame functions only.

Texts are cut at entities (one pattern, one alternative a type). An entity's canonical form (lower case, or digits alone)
carries coreference: it has one surrogate everywhere, whatever its formatting. A surrogate is derived from a keyed digest of
the form and keeps what the type asks for: letters stay letters of their case and script, digits stay digits, punctuation
stays; addresses move to reserved domains and ranges; card numbers and IBANs keep whether their check digits are right.

People are found after a title. Their given and family names are entities of their own, so "Mr. Peter Miller", "Mr. Miller",
and in the same text bare "Peter Miller", "Peter" and "Miller" agree; family names keep script and upper case, given names also
gender (of a title in the text, else a known given name's). Names that no title introduces in their text aren't found, nor are
phone numbers without a country code unless written as 555-010-9999 or (555) 010 9999. A run of 13 to 19 digits is a card if it has 16 or
its check digit is right.

Collisions are checked over all entities of the corpus: of two forms with one surrogate, and of a surrogate that is itself an
entity of the corpus, one is derived anew with the next attempt's digest (names get a further part, so theirs don't run out),
until none is left, so distinct entities stay distinct. IPv4 surrogates end at 2^28 addresses: beyond it the operator fails.

Rows are dealt by canonical form or by text digest; only texts with entities are shuffled. Defined results: null texts stay
null with no entities; empty texts stay empty; texts without entities are returned as they are; repeated rows give repeated
rows with the same replacements; a null id stays null; texts of any length are searched whole; other
columns, whatever their names, are left out of the result; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import texts, written

# How each type looks, in the order in which they are tried at a place.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-]@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IP = r"(?<![\p{L}\p{N}.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\p{L}\p{N}]|\.[0-9])"
IP += r"|(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z]{0,4}[0-9]{10,26}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}[ .-]?[0-9](?:[ .-][0-9]{2}){4}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}]|[.-][0-9])"
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа")
OTHER_TITLES = ("Dr", "Prof", "Mx")
TITLE = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + r")\.? "
WORD = r"\p{Lu}(?:\p{L}|[-'](?=\p{L})(?!s(?!\p{L})))+"
NAME = r"(?<![\p{L}\p{N}])" + TITLE + WORD + f"(?: {WORD})?"
TYPES = {"email": EMAIL, "ip": IP, "iban": IBAN, "card": CARD, "ssn": SSN, "phone": PHONE, "name": NAME}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
#: What every entity has; texts without it aren't searched.
HINT = r"[0-9@]|" + TITLE + r"\p{Lu}"
#: Around a name that the text has introduced.
BEFORE, AFTER = r"(?<![\p{L}\p{N}-])(?<!\p{L}')", r"(?!-?[\p{L}\p{N}]|'(?!s(?!\p{L}))\p{L})"
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nina", "Olga", "Paula"),
    ("latin", "n"): ("Alex", "Andrea", "Chris", "Dominique", "Eden", "Francis", "Gabriel", "Jules", "Kim", "Luca", "Marian", "Nikita", "Quinn", "Robin", "Sasha", "Toni"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Илья", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"),
    ("cyrillic", "f"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Паша", "Слава", "Шура", "Тоня", "Миша", "Юля", "Вика", "Лёша", "Гена", "Рита", "Ника", "Даня", "Коля"),
}
FAMILY = {
    "latin": ("Abel", "Bauer", "Costa", "Dubois", "Ernst", "Faber", "Garcia", "Hansen", "Ibsen", "Jensen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Petit", "Quint", "Rossi", "Silva", "Torres", "Unger", "Vidal", "Weber", "Young"),
    "cyrillic": ("Авдеенко", "Бондаренко", "Власенко", "Гриценко", "Дорошенко", "Ермоленко", "Жданко", "Захаренко", "Иваненко", "Коваленко", "Лысенко", "Марченко", "Назаренко", "Остапенко", "Павленко", "Руденко"),
}


def type_of(entity: Column) -> Column:
    """The first type whose pattern is all of ``entity``; surroundings played their part when it was found. What has none is
    a name without its title; digits that only look like a card are ``none``."""
    kind = F.lit("name")
    for name, pattern in reversed(TYPES.items()):
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when((kind == "card") & (F.length(digits) != 16) & (luhn(digits) != 0), "none").otherwise(kind)


def canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind.isin("card", "ssn", "phone"), digits).otherwise(F.lower(F.regexp_replace(entity, " ", "")))


def digest(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """256 hex digits that only the key's holder can derive."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string"), F.lit(str(i))), 256) for i in range(4)]
    return F.concat(*parts)


def number(hexes: Column, at, size: int) -> Column:
    """The ``at``-th group of 4 hex digits (from 0, around) as a number under ``size``."""
    place = (F.lit(at) if isinstance(at, int) else at) % 64
    return F.conv(F.substring(hexes, (place * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % size


def reshaped(form: Column, hexes: Column) -> Column:
    """Each letter another letter of its script, each digit another digit, the rest as it is (lower case)."""
    latin, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"

    def one(c, i):
        pick = lambda letters: F.substring(F.lit(letters), number(hexes, i, len(letters)) + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike(r"^\p{IsCyrillic}$"), pick(cyrillic)).when(c.rlike(r"^\p{IsGreek}$"), pick(greek)).when(c.rlike(r"^\p{L}$"), pick(latin)).otherwise(c)

    return F.concat_ws("", F.transform(F.split(form, ""), one))


def luhn(digits: Column) -> Column:
    """Check sum of a digit string, modulo 10."""
    size = F.length(digits)

    def one(c, i):
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((size - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10


def script(form: Column) -> Column:
    return F.when(form.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def rest97(iban: Column) -> Column:
    """An IBAN's (lower case) remainder by 97, which is 1 if its check digits are right."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + F.coalesce(value(c), F.lit(0))) % 97))


def known_gender(given: Column) -> Column:
    of = lambda g: F.initcap(given).isin(*[n for (_, x), names in GIVEN.items() if x == g for n in names])
    return F.when(of("m"), "m").when(of("f"), "f").otherwise("n")


def picked(names: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), at % len(names) + 1)


def surrogate(kind: Column, form: Column, hexes: Column, attempt: Column) -> Column:
    """The replacement's canonical form."""
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    email = F.concat(reshaped(local, hexes), F.lit("@"), F.concat(F.lit("mail"), number(hexes, 60, 10000).cast("string"), F.lit(".example.")), F.when(domain.rlike(r"\.(com|net|org)$"), F.substring_index(domain, ".", -1)).otherwise("org"))
    v4 = F.concat_ws(".", F.when(attempt < 2, 10).otherwise(number(hexes, 0, 16) + 240).cast("string"), *[number(hexes, i, 256).cast("string") for i in (1, 2, 3)])
    v6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.lower(F.hex(number(hexes, i, 65536))) for i in range(6)])
    ip = F.when(form.contains(":"), v6).otherwise(v4)
    body = F.substring(reshaped(F.regexp_replace(form, "[0-9]", "0"), hexes), F.lit(1), F.length(form) - 1)
    short = luhn(F.concat(body, F.lit("0")))
    check = (F.lit(20) - short + luhn(form)) % 10
    card = F.concat(body, check.cast("string"))
    ssn = F.concat(F.lit("9"), F.substring(reshaped(form, hexes), 2, 8))
    # a country code is kept; the number's first digits are those that are never dialled
    phone = F.concat(F.substring(form, F.lit(1), F.greatest(F.length(form) - 10, F.lit(0))), F.substring(reshaped(form, hexes), F.greatest(F.length(form) - 10, F.lit(0)) + 1, F.lit(10)))
    account = F.substring(reshaped(form, hexes), F.lit(5), F.length(form))
    right = F.lpad((F.lit(98) - rest97(F.concat(F.substring(form, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(F.substring(form, 1, 2), F.when(rest97(form) == 1, right).otherwise(F.substring(reshaped(form, hexes), 3, 2)), account)
    parts = lambda names: F.concat_ws("-", F.transform(F.sequence(F.lit(0), attempt), lambda i: picked(names, number(hexes, i, 4096))))
    name = F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        name = F.when((script(form) == s) & (kind == f"given_{g}"), parts(names)).otherwise(name)
    for s, names in FAMILY.items():
        name = F.when((script(form) == s) & (kind == "family"), parts(names)).otherwise(name)
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "card", card)
    return out.when(kind == "ssn", ssn).when(kind == "phone", phone).otherwise(name)


def poured(entity: Column, filling: Column, what: str) -> Column:
    """``entity`` with its characters of the class ``what`` replaced, in order, by ``filling``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(a, c):
        hit = c.rlike(f"^{what}$")
        return F.struct(F.concat(a["out"], F.when(hit, F.substring(filling, a["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(hit, a["k"] + 1).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.split(entity, ""), start, step, lambda a: a["out"])


def written_as(kind: Column, entity: Column, replacement: Column) -> Column:
    """The replacement in the format of the occurrence."""
    shouted = (entity == F.upper(entity)) & (F.length(entity) > 1)
    as_name = F.when(shouted, F.upper(replacement)).otherwise(replacement)
    return F.when(kind.isin("card", "ssn", "phone"), poured(entity, replacement, "[0-9]")).when(kind == "iban", poured(entity, F.upper(replacement), "[^ ]")).when(kind == "name", as_name).otherwise(replacement)


def people(entities: Column) -> dict[str, Column]:
    """Arrays of the names that titles introduce: whole, single, given and family names, and given names by their titles' gender."""
    named = F.filter(entities, lambda e: e.rlike(f"^{TITLE}"))
    bare = lambda e: F.regexp_replace(e, f"^{TITLE}", "")
    full = F.filter(named, lambda e: bare(e).contains(" "))
    of = lambda titles: F.transform(F.filter(full, lambda e: e.rlike("^(?:" + "|".join(titles) + r")\.? ")), lambda e: F.split(bare(e), " ")[0])
    return {
        "whole": F.array_distinct(F.transform(full, bare)),
        "single": F.array_distinct(F.transform(F.filter(named, lambda e: ~bare(e).contains(" ")), bare)),
        "given": F.array_distinct(F.transform(full, lambda e: F.split(bare(e), " ")[0])),
        "family": F.array_distinct(F.transform(full, lambda e: F.split(bare(e), " ")[1])),
        "male": of(MALE_TITLES),
        "female": of(FEMALE_TITLES),
    }


def parts_of(kind: Column, entity: Column, who: Column) -> Column:
    """What of an occurrence gets a surrogate of its own: before (what stays in front of it), part, sort (kind of its form) and form."""
    title = F.regexp_extract(entity, f"^{TITLE}", 0)
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")

    def one(w, i):
        given = F.when(F.size(words) > 1, i == 0).otherwise(F.array_contains(who["given"], w) & ~F.array_contains(who["family"], w))
        gender = F.when(F.array_contains(who["male"], w), "m").when(F.array_contains(who["female"], w), "f").otherwise(known_gender(w))
        return F.struct(F.when(i == 0, title).otherwise(" ").alias("before"), w.alias("part"), F.when(given, F.concat(F.lit("given_"), gender)).otherwise("family").alias("sort"), F.lower(w).alias("form"))

    whole = F.struct(F.lit("").alias("before"), entity.alias("part"), kind.alias("sort"), canonical(kind, entity).alias("form"))
    return F.when(kind == "name", F.transform(words, one)).otherwise(F.array(whole))


def assign(forms: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """(kind, form, replacement) of all distinct (kind, form), without collisions."""
    make = lambda df: df.withColumn("replacement", surrogate(F.col("kind"), F.col("form"), digest(key, F.col("kind"), F.col("form"), F.col("attempt")), F.col("attempt")))
    held = written(make(forms.withColumn("attempt", F.lit(0))), "surrogates")
    entities = forms.select(F.split("kind", "_")[0].alias("_sort"), F.col("form").alias("_form")).distinct()
    for _ in range(most_attempts):
        taken = held.groupBy("kind", "replacement").agg(F.min("form").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("kind", "replacement", "owner")
        double = held.join(taken, ["kind", "replacement"]).filter("form <> owner").select("kind", "form")
        real = held.join(entities, (F.split("kind", "_")[0] == F.col("_sort")) & (F.lower("replacement") == F.col("_form")), "left_semi").select("kind", "form")
        again = written(double.union(real).distinct(), "collisions")
        if again.isEmpty():
            return held.select("kind", "form", "replacement")
        kept = held.join(again, ["kind", "form"], "left_anti")
        anew = held.join(again, ["kind", "form"], "left_semi").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        held = written(kept.unionByName(make(anew)), "surrogates")
    raise RuntimeError(f"surrogates still collide after {most_attempts} attempts: the key space of a type is used up")


def replace(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds (map of type to count) of each row."""
    docs = texts(df, id_col, text_col)
    found = docs.withColumn("entities", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    plain = found.filter("text is null or size(entities) = 0").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.create_map().cast("map<string,long>").alias("kinds"))
    some = found.filter("size(entities) > 0").withColumn("of", F.sha2("text", 256))
    some = some.withColumn("who", F.struct(*(c.alias(n) for n, c in people(F.col("entities")).items())))
    # names that the text has introduced are found again without their titles
    names = F.concat(*(F.col("who")[n] for n in ("whole", "family", "given", "single")))
    pattern = F.concat(F.lit(f"{ANY}|{BEFORE}(?:"), F.array_join(names, "|"), F.lit(f"){AFTER}"))
    some = some.withColumn("pattern", F.when(F.size(names) > 0, pattern))
    entities = F.when(F.col("pattern").isNull(), F.col("entities")).otherwise(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    each = some.select("of", "who", F.posexplode(entities).alias("at", "entity")).withColumn("kind", type_of(F.col("entity")))
    each = each.select("of", "at", "kind", F.posexplode(parts_of(F.col("kind"), F.col("entity"), F.col("who"))).alias("nth", "p")).select("of", "at", "kind", "nth", "p.*").distinct()
    each = written(each, "entities")
    assigned = assign(each.filter("kind <> 'none'").select(F.col("sort").alias("kind"), "form").distinct(), key).withColumnRenamed("kind", "sort")
    said = F.concat("before", F.coalesce(written_as(F.col("kind"), F.col("part"), F.col("replacement")), F.col("part")))
    said = each.join(assigned, ["sort", "form"], "left").select("of", "at", "nth", "kind", said.alias("said"))
    whole = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]))
    said = said.repartition("of").groupBy("of", "at").agg(F.first("kind").alias("kind"), whole.alias("said"))
    by_text = said.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "said"))).alias("said"))
    pieces = F.when(F.col("pattern").isNull(), F.split("text", ANY, -1)).otherwise(F.split("text", F.col("pattern"), -1))
    whole = F.concat_ws("", F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("said"), i)["said"], F.lit("")))))
    counted = F.filter("said", lambda x: x["kind"] != "none")
    kinds = F.aggregate(counted, F.create_map().cast("map<string,long>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["kind"]), F.create_map(x["kind"], F.coalesce(F.element_at(m, x["kind"]), F.lit(0)) + F.lit(1).cast("long"))))
    changed = some.join(by_text, "of").select("doc_id", whole.alias("text"), F.size(counted).cast("long").alias("n_entities"), kinds.alias("kinds"))
    return plain.unionByName(changed)
