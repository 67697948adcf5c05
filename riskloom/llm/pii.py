"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

Everything is DataFrame work. One pattern finds e-mail addresses, IPv4 addresses, card and phone numbers, US and IBAN
numbers, long hexadecimal secrets, key tokens and titled names. An entity's canonical form (case, separators and
country code aside) and a secret key give a stream of numbers; each digit, letter or octet is replaced from it in
place, so every mention of an entity changes alike and keeps its own spelling. A check over all entities of the corpus
finds surrogates that meet one another or an entity that occurs; all but the first get the next attempt until none do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stage, unused

KEY, LITERALS = "riskloom-surrogates", 500

# US grouping; after +, a country code and up to 15 digits; with a leading 0, or 8 as in Russia; ten bare US digits.
_BREAK = r"(?:[ .-]?\(|\)[ .-]?|[ ./-])?"
PHONES = [
    r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    rf"\+[1-9](?:{_BREAK}[0-9]){{6,14}}(?![0-9])",
    r"(?<![0-9])(?<![0-9][.,:/-])8[ -]?(?=(?:[ ()-]{0,2}[0-9]){10}(?![0-9]))(?:\([0-9]{3,5}\)|[0-9]{3,5})[ -]?[0-9]{1,3}[ -]?[0-9]{2}[ -]?[0-9]{2}(?![0-9])",
    r"(?<![0-9])(?<![0-9][.,:/-])8[ -]?\([0-9]{1,5}\)(?:[ -]?[0-9]){5,9}(?![0-9])",
    # not a date, a thousand's zeros or a decimal
    rf"(?<![0-9])(?<![0-9][.,:/-])(?!0?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)[0-9]{{2}}(?![0-9]))(?!000)(?:\(0|0(?=[0-9]))(?:{_BREAK}[0-9]){{6,14}}(?![0-9])",
    r"(?<![0-9])(?<![0-9][.,:/-])[2-9][0-9]{9}(?![0-9])",
]
# What stays of a phone number: country code, trunk digit.
PREFIX = r"^(?:\+[0-9]{1,3}(?=[ .(-])(?:[ .-]?\(0\))?|\(?0|8(?=[ (-]|[0-9]{10}$))"
# What the entities look like, by type, in order of precedence, and the names given in their place.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b",
    "key": r"\b(?:sk|pk|gh[pousr]|xox[abpr])[-_][A-Za-z0-9_-]{16,}|\bAKIA[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b(?<=[0-9].{0,12})",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "|".join(PHONES),
    "man": r"\b(?:Mr|Herr|Monsieur|Señor|Sr)\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?|(?:Господин) \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
    "woman": r"\b(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra)\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?|(?:Госпожа) \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
NAMES = {
    ("man", "latin"): ["Adam", "Boris", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Louis", "Marco", "Nils", "Oscar", "Pablo"],
    ("woman", "latin"): ["Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helga", "Irene", "Julia", "Karen", "Laura", "Maria", "Nadia", "Olga", "Paula"],
    ("man", "cyrillic"): ["Иван", "Пётр", "Олег", "Павел", "Антон", "Борис", "Виктор", "Денис"],
    ("woman", "cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Нина", "Вера", "Дарья"],
}
SURNAMES = {
    "latin": ["Alder", "Berg", "Conti", "Durand", "Ekman", "Fuchs", "Garcia", "Holm", "Ibsen", "Jansen", "Keller", "Lopez", "Meyer", "Novak", "Olsen", "Petit", "Quint", "Rossi", "Silva", "Turner", "Ulrich", "Vidal", "Weber", "Young"],
    "cyrillic": ["Громов", "Зимин", "Карпов", "Лосев", "Мороз", "Носов", "Орлов", "Попов"],
}
LATER = {"latin": "ghklmnoprsabcdef", "cyrillic": "абвгдезиклмнопрс"}
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Without a digit or @, only these begin an entity; looking for them is far cheaper than the patterns.
OPENERS = ("Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Господин", "Госпожа", "sk-", "sk_", "pk-", "pk_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "ghp-", "gho-", "ghu-", "ghs-", "ghr-", "xox", "AKIA")


def found(text: Column) -> Column:
    """All entities of a text, in order; none for null. A secret without any digit is a word."""
    likely = text.rlike("[0-9@]")
    for opener in OPENERS:
        likely = likely | text.contains(opener)
    return F.when(likely, F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))


def kind(value: Column) -> Column:
    out = F.lit("phone")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(value: Column, of: Column) -> Column:
    """What all mentions of an entity share."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    plain = F.when(of.isin("card", "ssn"), digits).when(of == "phone", F.substring(F.regexp_replace(F.regexp_replace(value, PREFIX, ""), "[^0-9]", ""), -10, 10))
    name = F.lower(F.regexp_replace(value, r"^\p{L}+\.? ", ""))
    return F.concat_ws(":", of, plain.when(of.isin("man", "woman"), name).when(of == "iban", F.regexp_replace(value, " ", "")).when(of == "key", value).otherwise(F.lower(value)))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(stream: Column, at: Column) -> Column:
    """From 0 to 255: one of the 64 numbers of a stream."""
    return F.conv(F.substr(stream, F.lit(2) * F.pmod(at, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")


def _characters(value: Column, stream: Column, letters: int = 26, keep: int = 0, shift: int = 0) -> Column:
    """Letters and digits replaced one by one, by letters of the same case and digits; the first ``keep`` stay."""

    def one(i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        pick = lambda of, many: F.substr(F.lit(of), F.pmod(_number(stream, i + shift), F.lit(many)) + 1, F.lit(1))
        new = lambda c: F.when(F.lit(DIGITS).contains(c), pick(DIGITS, 10)).when(F.lit(LOWER).contains(c), pick(LOWER, letters)).when(F.lit(UPPER).contains(c), pick(UPPER, letters)).otherwise(c)
        return F.when(i > keep, let(c, new)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _digits(value: Column, stream: Column, most: int, keep: int | Column = 0) -> Column:
    """The last ``most`` digits after the first ``keep`` characters replaced by their place from the right."""

    def one(i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(value, i), "[^0-9]", ""))
        new = lambda n: F.substr(F.lit(DIGITS), F.pmod(_number(stream, n), F.lit(10)) + 1, F.lit(1))
        c = F.substr(value, i, F.lit(1))
        return F.when(F.lit(DIGITS).contains(c) & (i > keep), let(place, lambda n: F.when(n <= most, new(n)).otherwise(c))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    one = lambda n, i: F.when(i % 2 == 1, F.pmod(n * 2, F.lit(10)) + F.floor(n * 2 / 10)).otherwise(n)
    return F.aggregate(F.transform(digits, lambda c, i: one(F.coalesce(c.try_cast("int"), F.lit(0)), i).cast("int")), F.lit(0), lambda a, x: a + x)


def _card(value: Column, stream: Column) -> Column:
    """The first digit stays; the last makes the check sum right where it was right."""

    def checked(made: Column) -> Column:
        body = F.substr(made, F.lit(1), F.length(made) - 1)
        last = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(_luhn(value), F.lit(10)) == 0, F.concat(body, last)).otherwise(made)

    return let(_digits(value, stream, 99, keep=1), checked)


def _phone(value: Column, stream: Column) -> Column:
    """Country code or trunk digit stay; of a code that nothing sets off, what stands before the last ten digits."""
    over = F.length(F.regexp_replace(value, "[^0-9]", "")) - 10
    code = F.length(F.regexp_extract(value, PREFIX, 0))
    keep = F.when(code > 0, code).when(value.startswith("+"), 1 + F.greatest(F.lit(0), F.least(F.lit(3), over))).otherwise(0)
    return let(keep, lambda k: _digits(value, stream, 15, k))


def _email(value: Column, stream: Column) -> Column:
    """The top-level domain stays."""
    domain = F.substring_index(value, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    return F.concat(_characters(F.substring_index(value, "@", 1), stream), F.lit("@"), _characters(host, stream, shift=32), top)


def _name(value: Column, stream: Column, gender: str, letters: str, attempt: Column) -> Column:
    """Title and number of names stay."""
    pick = lambda of, k: F.element_at(F.array(*map(F.lit, of)), F.pmod(_number(stream, F.lit(k)), F.lit(len(of))) + 1)
    # a character more with each attempt, so that the names never run out
    suffix = F.translate(F.substr(stream, F.lit(9), F.least(3 + attempt, F.lit(120))), "0123456789abcdef", LATER[letters])
    more = F.when(attempt > 0, F.concat(F.lit("-"), F.initcap(suffix))).otherwise("")
    title, family = F.regexp_extract(value, r"^(\p{L}+\.? )", 1), F.concat(pick(SURNAMES[letters], 2), more)
    return F.when(value.rlike(r"^\p{L}+\.? \S+ \S"), F.concat(title, pick(NAMES[gender, letters], 1), F.lit(" "), family)).otherwise(F.concat(title, family))


def _surrogate(m: Column) -> Column:
    """What takes the place of a mention (value, of, attempt, stream)."""
    value, of, stream = m["value"], m["of"], m["stream"]
    octets = [(F.pmod(_number(stream, F.lit(k)), F.lit(223 if k == 0 else 254)) + 1).cast("string") for k in range(4)]
    out = F.when(of == "email", _email(value, stream)).when(of == "ip", F.concat_ws(".", *octets)).when(of == "card", _card(value, stream))
    out = out.when(of == "secret", _characters(value, stream, letters=6)).when(of == "key", _characters(value, stream, keep=4)).when(of == "iban", _characters(value, stream, keep=2))
    for gender, letters in NAMES:
        script = value.rlike(r"\p{IsCyrillic}") == (letters == "cyrillic")
        out = out.when((of == gender) & script, _name(value, stream, gender, letters, m["attempt"]))
    return out.when(of == "ssn", _digits(value, stream, 99)).otherwise(_phone(value, stream))


def mentions(text: Column) -> Column:
    """All mentions of a text, in order: value, of (the type), entity (what all its mentions share)."""
    typed = F.transform(found(text), lambda v: F.struct(v.alias("value"), kind(v).alias("of")))
    return F.transform(typed, lambda m: F.struct(m["value"].alias("value"), m["of"].alias("of"), canonical(m["value"], m["of"]).alias("entity")))


def surrogates(named: Column, attempt, key: str = KEY) -> Column:
    """The surrogates of mentions, at the attempt that ``attempt`` gives for an entity."""
    tried = F.transform(named, lambda m: F.struct(*[m[c].alias(c) for c in ("value", "of", "entity")], attempt(m["entity"]).alias("attempt")))
    stream = lambda m: F.sha2(F.concat_ws("|", F.lit(key), m["attempt"].cast("string"), m["entity"]), 512)
    keyed = F.transform(tried, lambda m: F.struct(*[m[c].alias(c) for c in ("value", "of", "attempt")], stream(m).alias("stream")))
    return F.transform(keyed, _surrogate)


def collisions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """entity and attempt (over 0) of those whose first surrogate meets another one's or an entity of the corpus."""
    every = docs.select(F.explode(mentions(F.col("text"))).alias("m")).select("m.*")
    entities = stage(every.groupBy("entity").agg(F.min("value").alias("value"), F.min("of").alias("of")), "pii-entities")
    now, tries = entities.withColumn("attempt", F.lit(0)), 0
    while True:
        one = F.array(F.struct("value", "of", "entity"))
        new = F.element_at(surrogates(one, lambda entity: F.col("attempt"), key), 1)
        made = stage(now.withColumn("made", canonical(new, F.col("of"))), "pii-made")
        met = made.join(entities.select(F.col("entity").alias("made")).hint("merge"), "made", "left_semi").select("entity")
        turn = F.row_number().over(Window.partitionBy("made").orderBy("attempt", "entity"))
        again = made.withColumn("turn", turn).where("turn > 1").select("entity").union(met).distinct().withColumn("again", F.lit(1))
        now = stage(made.join(again.hint("merge"), "entity", "left").select("entity", "value", "of", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "pii-attempts")
        tries += 1
        if now.where(F.col("attempt") == tries).isEmpty():
            return now.where("attempt > 0").select("entity", "attempt")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities replaced in ``text`` and two more columns: n_entities and the entities' types.

    All columns and rows stay, repeated ones too. Null and empty texts stay as they are, with no entities; texts
    without entities stay byte for byte. n_chars, if there, follows the new text.
    """
    again, own = collisions(docs, key), unused(docs, "pii")
    seen, hashed, tries = (f"{own}_{x}" for x in ("seen", "hash", "tries"))
    few = again.limit(LITERALS + 1).collect()
    columns = [c for c in docs.columns if c not in ("n_entities", "entity_types")]
    rows = docs.select(*columns, mentions(F.col("text")).alias(seen))
    if not few:
        attempt = lambda entity: F.lit(0)
    elif len(few) <= LITERALS:
        known = F.create_map(*[F.lit(x) for r in few for x in (r.entity, r.attempt)])
        attempt = lambda entity: F.coalesce(F.try_element_at(known, entity), F.lit(0))
    else:
        # many: each text with such an entity gets its own small map, by a join on the text's hash
        rows = rows.withColumn(hashed, F.sha2(F.col("text"), 256))
        theirs = rows.where(F.size(seen) > 0).select(hashed, F.explode(F.array_distinct(F.transform(seen, lambda m: m["entity"]))).alias("entity")).distinct()
        maps = theirs.join(again, "entity").groupBy(hashed).agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias(tries))
        rows = rows.join(maps, hashed, "left")
        attempt = lambda entity: F.coalesce(F.try_element_at(F.col(tries), entity), F.lit(0))
    between = F.split(F.col("text"), ANY, -1)
    rebuilt = F.array_join(F.zip_with(between, surrogates(F.col(seen), attempt, key), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size(seen) > 0, rebuilt).otherwise(F.col("text"))
    types = F.transform(seen, lambda m: m["of"])
    out = rows.select(*[c for c in columns if c not in ("text", "n_chars")], text.alias("text"), F.size(seen).alias("n_entities"), types.alias("entity_types"), *[c for c in columns if c == "n_chars"])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns, "n_entities", "entity_types")
