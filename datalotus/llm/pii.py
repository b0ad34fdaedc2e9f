"""PII: surrogate generation (DataFrame only).

Entities are found by one alternation of patterns: secrets (keyword and value,
key ids, long hex), e-mail addresses, IPv4 and IPv6 addresses (in full, compressed
or with an IPv4 tail), IBANs (11 to 30 characters after the check digits), card
numbers (15 and 16 digits in fours or 4-6-5, 14 digits grouped 4-6-4), phone
numbers (with a country code and groups of one to four digits, or 3-3-4), social
security numbers, and persons: a title and one to three capitalised names, in
Latin, Greek or Cyrillic script, and in the same document every further mention,
without a title, of a name of two or more words. Not found: cards of 13 or 17 to 19
digits, phones without a country code in groups other than 3-3-4, persons never
named with a title, and a titled person's family name alone.

Each entity gets a replacement derived from a keyed hash of its type and canonical
form (case, separators, country marks and trunk zeros folded), so that all mentions
of one entity, in any document, get the same replacement: coreference holds. A
person's canonical form is gender and name; a mention without a title goes with the
document's first titled one of that name. The replacement keeps the mention's format:
digits stay digits and separators stay in place, letters keep case and script, country
codes stay, card numbers pass the Luhn test and IBANs the mod-97 test, e-mail domains
become example domains, and a person's name is replaced by one of the title's gender
and the name's script.

Collision check: distinct entities of a type whose replacements coincide, or whose
replacement is the canonical form of a real entity (itself included), are derived
again with the next attempt number (all but the smallest), until no collision is
left or `MOST` attempts are used up; then the replacement is the type and 96 bits of
the hash, which gives up the format to keep entities distinct. These exceptions alone
are joined to the documents that mention them; all other documents are rewritten where
they are read.

The key is the caller's secret: who knows it can test guesses.

Defined cases: a null text stays null with no entities; a text without an entity
is unchanged; repeated rows each keep their row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalotus.llm.common import Tables, column, materialize, partitions

MOST = 8  # attempts at a replacement in the mention's format
_NAME = r"(?:\p{Lu}[\p{L}'’-]+)"
_TITLES = "(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señora|Señor|Sra|Sr|Madame|Monsieur|Mme|κ|Κα|Г-н|Г-жа)"
_H = "[0-9a-fA-F]{1,4}"
#: Compressed addresses: with an IPv4 tail, then by the place of the double colon.
#: Nothing like C++ names: no letter, digit or other double colon beside them, and
#: a digit where only the double colon ends them.
_IPV6 = (
    rf"(?<![0-9A-Za-z_]|::)(?:(?:(?:{_H}:){{6}}|(?:(?:{_H}:){{1,5}}|:):(?:{_H}:){{0,4}})(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}"
    + "".join(f"|(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7))
    + rf"|(?<!:):(?::{_H}){{1,7}}|(?=[a-fA-F:]*[0-9])(?:{_H}:){{1,7}}:)(?![0-9A-Za-z_]|:[0-9a-fA-F:])"
)
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)[A-Za-z0-9+/_.-]{8,}|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp|gho|sk|pk)[_-][A-Za-z0-9_]{20,}\b|\b[0-9a-fA-F]{32,}\b",
    "email": r"(?<![\p{L}0-9])[\p{L}0-9][\p{L}0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})\b",
    "ip": rf"(?<![0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9])|\b(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}\b|{_IPV6}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[ -]?){3}[0-9]{3,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    # with groups of one digit, and eight digits at least
    r"|(?<![0-9])(?=\+(?:[ .()-]{0,2}[0-9]){8})\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?(?:[0-9](?![0-9])|[0-9]{2,4})(?:[ .-][0-9](?![0-9])|[ .-]?[0-9]{2,4}){1,5}[ .-]?[0-9]{2,4}(?![0-9])"
    r"|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "person": rf"\b{_TITLES}\.? {_NAME}(?: {_NAME}){{0,2}}",
}
REGEX = "|".join(f"({p})" for p in PATTERNS.values())
#: For every alternative of REGEX a part that each of its matches holds; most
#: documents hold none of these and skip the full pattern.
HINTS = (
    "@",  # email
    r"(?i:password|passwd|pwd|token|secret|key)|AKIA|ASIA|\b(?:ghp|gho|sk|pk)[_-][A-Za-z0-9_]{20}|[0-9a-fA-F]{32}",  # secret
    "[A-Z]{2}[0-9]{2}",  # iban
    r"[0-9]\.[0-9]|[0-9a-fA-F]:[0-9a-fA-F]|::",  # ip
    "[0-9]{3}",  # ssn, card, phone without a country code
    r"\+[0-9]",  # phone with a country code
    rf"\b{_TITLES}\.? \p{{Lu}}",  # person
)
HINT = "|".join(HINTS)

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Κα", "Г-жа")
NAMES = {
    ("latin", True): "Ada Alma Anna Clara Dora Edith Elena Emma Greta Hanna Irma Ines Jana Julia Karla Laura Lena Lotte Luisa Maria Marta Mina Nora Olga Paula Rita Rosa Sara Tilda Vera Wilma Zoe",
    ("latin", False): "Adam Albin Anton Bruno Carlo David Emil Erik Felix Franz Georg Gustav Hugo Ivan Jakob Jonas Karl Klaus Leon Luis Marco Martin Nils Oskar Otto Paul Pedro Robert Samuel Theo Viktor Walter",
    ("greek", True): "Άννα Ελένη Μαρία Σοφία Ειρήνη Δανάη Ζωή Χλόη",
    ("greek", False): "Γιώργος Νίκος Πέτρος Κώστας Μάρκος Αλέξης Ηλίας Παύλος",
    ("cyrillic", True): "Анна Елена Мария Ольга Вера Нина Софья Дарья",
    ("cyrillic", False): "Иван Пётр Олег Игорь Павел Антон Борис Денис",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo wa we",
    "greek": "βα βε γα δα δο ζα θα κα κε λα λο μα με να νο πα πε ρα ρο σα σε τα το φα χα",
    "cyrillic": "ба бо ва ве га го да де жа за ка ко ла ло ма ме на не па по ра ро са со та то фа ха",
}


def _pick(options: str, number: Column) -> Column:
    values = options.split()
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def kind_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


#: The part of a secret before its value.
_LEAD = r"^(?i:(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?)"
_TITLE = rf"^{_TITLES}\.? "
#: Country calling codes of one and two digits; all others have three.
CODES_1, CODES_2 = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_SEP = "\x1f"


def lead(kind: Column, mention: Column) -> Column:
    """What a replacement leaves in place: a secret's keyword, a person's title."""
    return F.when(kind == "secret", F.regexp_extract(mention, _LEAD, 0)).when(kind == "person", F.regexp_extract(mention, _TITLE, 0)).otherwise(F.lit(""))


def _digits(mention: Column) -> Column:
    return F.regexp_replace(mention, "[^0-9]", "")


def _phone(mention: Column) -> Column:
    """All digits with the country code, without a trunk zero in brackets."""
    digits = _digits(F.replace(mention, F.lit("(0)"), F.lit("")))
    return F.when((F.length(digits) == 10) & ~mention.startswith("+"), F.concat(F.lit("1"), digits)).otherwise(digits)


def _country(number: Column) -> Column:
    """The country code that a phone's canonical form starts with."""
    n = F.when(F.substring(number, 1, 1).isin(*CODES_1), 1).when(F.substring(number, 1, 2).isin(*CODES_2), 2).otherwise(3)
    return F.substring(number, F.lit(1), n)


def _gender(mention: Column) -> Column:
    title = F.regexp_replace(F.regexp_extract(mention, _TITLE, 0), "[. ]", "")
    return F.when(title.isin(*FEMALE), "f").otherwise("m")


def _groups(mention: Column) -> Column:
    """An IPv6 address as eight groups without leading zeros."""
    octet = lambda i: F.regexp_extract(mention, r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$", i).cast("int")
    tail = F.concat(F.regexp_replace(mention, r"[0-9]+\.[0-9.]+$", ""), F.hex(octet(1) * 256 + octet(2)), F.lit(":"), F.hex(octet(3) * 256 + octet(4)))
    halves = F.split(F.lower(F.when(mention.contains("."), tail).otherwise(mention)), "::", 2)
    part = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(part(0)) - F.size(part(1)))
    return F.array_join(F.transform(F.concat(part(0), zeros, part(1)), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def canonical(kind: Column, mention: Column) -> Column:
    """What is the same in all mentions of an entity."""
    return (
        F.when(kind == "phone", _phone(mention))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "email", F.lower(mention))
        .when((kind == "ip") & mention.contains(":"), _groups(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "person", F.concat(_gender(mention), F.lit(_SEP), F.lower(F.regexp_replace(mention, _TITLE, ""))))
        .when(kind == "secret", F.regexp_replace(mention, _LEAD, ""))
        .otherwise(F.lower(mention))
    )


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hex digits that depend on the key and the entity alone."""
    return F.sha2(F.concat_ws(_SEP, F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)


def _hex_number(stream: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(stream, at, digits), 16, 10).cast("long")


def _digit_string(stream: Column, length: int) -> Column:
    """Up to 96 decimal digits of the stream."""
    parts = [F.lpad(F.pmod(_hex_number(stream, 1 + 15 * i, 15), F.lit(10**12)).cast("string"), 12, "0") for i in range(8)]
    return F.substring(F.concat(*parts), 1, length)


def _place(shape: Column, chars: Column, sign: str = "[0-9]") -> Column:
    """`shape` with the signs that match `sign` replaced by `chars`, in order."""
    pieces = F.split(shape, sign, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(pieces) - 1, F.substring(chars, i + 1, F.lit(1))).otherwise(""))), "")


def _fill(shape: Column, source: Column) -> Column:
    """`shape` with its digits and letters replaced, one for one, by the source's
    hex digits: digits to digits, letters to letters of the same case. Other signs
    stay and aren't counted, so all ways to write it are filled alike."""
    bare = F.regexp_replace(shape, "[^0-9A-Za-z]", "")
    n = F.length(bare)
    at = lambda i: F.conv(F.substring(source, F.pmod((i - 1) * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
    one = lambda i: F.substring(bare, i, F.lit(1))
    letter = lambda i, base: F.char(F.lit(base) + F.pmod(at(i), F.lit(26)))
    chars = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when(one(i).rlike("[0-9]"), F.pmod(at(i), F.lit(10)).cast("string")).when(one(i).rlike("[A-Z]"), letter(i, 65)).otherwise(letter(i, 97)),
    )
    return F.when(n > 0, _place(shape, F.array_join(chars, ""), "[0-9A-Za-z]")).otherwise(shape)


def _iban(canon: Column, stream: Column) -> Column:
    """An IBAN of the same country and form with right check digits, without blanks."""
    body = _fill(F.substring(canon, F.lit(5), F.length(canon)), stream)
    signs = F.concat(body, F.substring(canon, 1, 2), F.lit("00"))
    rest = F.aggregate(F.split(signs, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))))
    return F.concat(F.substring(canon, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), body)


def _hex_fill(shape: Column, source: Column) -> Column:
    """The same for hexadecimal strings, which stay hexadecimal."""
    n = F.length(shape)
    upper = shape.rlike("[A-F]")
    text = F.substring(F.repeat(source, F.floor(n / F.lit(128)).cast("int") + 1), F.lit(1), n)
    return F.when(upper, F.upper(text)).otherwise(text)


def _luhn(body: Column) -> Column:
    """`body` (digits) with its check digit."""
    n = F.length(body)
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    digit = lambda i: F.substring(body, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(F.pmod(n - i, F.lit(2)) == 0, doubled(digit(i))).otherwise(digit(i)))
    return F.concat(body, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _person(canon: Column, stream: Column) -> Column:
    names = F.split(F.substring_index(canon, _SEP, -1), " ")
    female = canon.startswith("f")
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    made = F.lit("")
    for s in ("latin", "greek", "cyrillic"):
        given = F.when(female, _pick(NAMES[s, True], _hex_number(stream, 1, 8))).otherwise(_pick(NAMES[s, False], _hex_number(stream, 1, 8)))
        family = F.initcap(F.concat(*[_pick(SYLLABLES[s], _hex_number(stream, 9 + 6 * i, 6)) for i in range(5)]))
        middle = _pick(NAMES[s, True], _hex_number(stream, 41, 8))
        whole = F.when(F.size(names) == 1, family).when(F.size(names) == 2, F.concat_ws(" ", given, family)).otherwise(F.concat_ws(" ", given, F.when(female, middle).otherwise(_pick(NAMES[s, False], _hex_number(stream, 41, 8))), family))
        made = F.when(script == s, whole).otherwise(made)
    return made


def surrogate(kind: Column, mention: Column, canon: Column, stream: Column, attempt: Column) -> Column:
    """The replacement of a mention, without what `lead` keeps."""
    value = F.when(kind == "secret", F.regexp_replace(mention, _LEAD, "")).otherwise(mention)
    octet = lambda i: (F.pmod(_hex_number(stream, 1 + 6 * i, 6), F.lit(254)) + 1).cast("string")
    country = _country(canon)
    own = F.length(canon) - F.length(country)
    number = F.substring(_digit_string(stream, 24), F.lit(24) - own + 1, own)
    phone = F.replace(_place(F.replace(mention, F.lit("(0)"), F.lit("(o)")), F.when(mention.startswith("+") | (F.length(_digits(mention)) != 10), F.concat(country, number)).otherwise(number)), F.lit("(o)"), F.lit("(0)"))
    mailbox = F.concat(F.lit("u"), F.substring(stream, 1, 14), F.lit("@"), F.concat(F.lit("mail"), F.pmod(_hex_number(stream, 20, 4), F.lit(10)).cast("string"), F.lit(".example."), _pick("com net org", _hex_number(stream, 30, 4))))
    hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return (
        F.when(attempt >= MOST, F.concat(kind, F.lit("-"), F.substring(stream, 1, 24)))
        .when(kind == "email", mailbox)
        .when((kind == "ip") & mention.contains(":"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(stream, i * 4 + 1, F.lit(4))), ":"))
        .when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
        .when(kind == "card", _place(mention, _luhn(_digit_string(stream, 40).substr(F.lit(1), F.length(canon) - 1))))
        .when(kind == "phone", phone)
        .when(kind == "ssn", _place(mention, _digit_string(stream, 9)))
        .when(kind == "iban", _place(mention, _iban(canon, stream), "[0-9A-Z]"))
        .when(kind == "person", _person(canon, stream))
        .when(hexadecimal, _hex_fill(value, stream))
        .when(value.rlike("^(?:AKIA|ASIA)"), F.concat(F.substring(value, 1, 4), _fill(F.substring(value, F.lit(5), F.length(value)), stream)))
        .otherwise(_fill(value, stream))
    )


def found(rows: DataFrame) -> DataFrame:
    """`rows` (with text) and pattern (null where the fixed one is enough) and forms:
    the mentions in order with kind and canonical form."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn("first", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(REGEX), F.lit(0))).otherwise(none))
    full = F.filter("first", lambda m: m.rlike(rf"{_TITLE}{_NAME} {_NAME}"))
    people = F.transform(full, lambda m: F.struct(F.regexp_replace(m, _TITLE, "").alias("name"), canonical(F.lit("person"), m).alias("canon")))
    rows = rows.withColumn("people", people)
    # longer names first, so that the longest one matches
    names = F.array_sort(F.array_distinct(F.transform("people", lambda p: F.struct((-F.length(p["name"])).alias("n"), p["name"].alias("name")))))
    again = F.concat(F.lit(rf"{REGEX}|(?<![\p{{L}}0-9])(?:"), F.array_join(F.transform(names, lambda x: F.concat(F.lit(r"\Q"), x["name"], F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}0-9'’-])"))
    rows = rows.withColumn("pattern", F.when(F.size("people") > 0, again))
    rows = rows.withColumn("all", F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("first")))
    kinds = F.transform("all", lambda m: F.struct(F.coalesce(kind_of(m), F.lit("person")).alias("kind"), m.alias("mention")))
    rows = rows.withColumn("kinds", kinds)
    untitled = lambda x: (x.kind == "person") & ~x.mention.rlike(_TITLE)
    canon = lambda x: F.when(untitled(x), F.get(F.filter("people", lambda p: p["name"] == x.mention), F.lit(0))["canon"]).otherwise(canonical(x.kind, x.mention))
    forms = F.transform("kinds", lambda x: F.struct(x.kind.alias("kind"), x.mention.alias("mention"), canon(x).alias("canon")))
    return rows.withColumn("forms", F.coalesce(forms, F.array().cast("array<struct<kind:string,mention:string,canon:string>>"))).drop("first", "people", "all", "kinds")


def exceptions(entities: DataFrame, key: str, tables: Tables) -> DataFrame | None:
    """(kind, canon, attempt) of entities that need another attempt than 0; None if
    there are none. `entities` has kind, canon and one mention of each."""
    state = materialize(entities.withColumn("attempt", F.lit(0)), "entities", tables)
    kind, mention, canon, attempt = F.col("kind"), F.col("mention"), F.col("canon"), F.col("attempt")
    moved = False
    while True:
        # spread by hash: the table is small in bytes, but each row is costly
        spread = state.repartition(partitions(state.sparkSession), "kind", "canon")
        value = spread.withColumn("stream", _stream(kind, canon, attempt, key)).withColumn("value", surrogate(kind, mention, canon, F.col("stream"), attempt))
        form = F.when(kind == "person", F.concat(F.substring_index(canon, _SEP, 1), F.lit(_SEP), F.lower("value"))).otherwise(canonical(kind, F.concat(lead(kind, mention), F.col("value"))))
        made = materialize(value.select("kind", "canon", "attempt", form.alias("made")), "surrogates", tables)
        twice = made.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("first")).where("n > 1").drop("n")
        real = made.select("kind", F.col("canon").alias("made")).join(made.select("kind", "made").distinct(), ["kind", "made"], "left_semi").withColumn("taken", F.lit(True))
        bad = made.where(attempt < MOST).join(twice, ["kind", "made"], "left").join(real, ["kind", "made"], "left").where(F.col("taken") | (F.col("first").isNotNull() & (F.col("first") != canon))).select("kind", "canon").withColumn("again", F.lit(1))
        bad = materialize(bad, "collisions", tables)
        if bad.isEmpty():
            return state.where("attempt > 0").select("kind", "canon", "attempt") if moved else None
        moved = True
        state = materialize(state.join(bad, ["kind", "canon"], "left").select("kind", "canon", "mention", (attempt + F.coalesce("again", F.lit(0))).alias("attempt")), "entities", tables)


def _rewrite(attempts: Column | None, key: str) -> Column:
    """The text of `found` rows with its mentions replaced."""

    def tried(x: Column) -> Column:
        if attempts is None:
            return F.lit(0)
        return F.coalesce(F.element_at(attempts, F.concat_ws(_SEP, x.kind, x.canon)), F.lit(0))

    # one array after the other, so that no step is written out twice
    streams = F.transform("forms", lambda x: F.struct(x.kind.alias("kind"), x.mention.alias("mention"), x.canon.alias("canon"), tried(x).alias("attempt")))
    streams = F.transform(streams, lambda x: F.struct(x.kind.alias("kind"), x.mention.alias("mention"), x.canon.alias("canon"), x.attempt.alias("attempt"), _stream(x.kind, x.canon, x.attempt, key).alias("stream")))
    new = F.transform(streams, lambda x: F.concat(lead(x.kind, x.mention), surrogate(x.kind, x.mention, x.canon, x.stream, x.attempt)))
    pieces = F.when(F.col("pattern").isNull(), F.split("text", REGEX, -1)).otherwise(F.split("text", F.col("pattern"), -1))
    ends = F.concat(new, F.array(F.lit("")))
    return F.when(F.size("forms") == 0, F.col("text")).otherwise(F.array_join(F.zip_with(pieces, ends, lambda p, e: F.concat(F.coalesce(p, F.lit("")), F.coalesce(e, F.lit("")))), ""))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """One row per document: doc_id, text (with replacements), n_entities and
    entities (array of kind, mention, as found)."""
    tables = tables or Tables(docs.sparkSession)
    rows = found(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")))
    each = rows.select(F.explode("forms").alias("f")).select("f.*").groupBy("kind", "canon").agg(F.min("mention").alias("mention"))
    odd = exceptions(each, key, tables)
    if odd is None:
        done = rows.withColumn("new", _rewrite(None, key))
    else:
        # documents by a row number of their own, since ids may repeat
        held = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mentions", tables)
        in_docs = held.select("row", F.explode("forms").alias("f")).select("row", "f.kind", "f.canon").distinct()
        maps = in_docs.join(odd, ["kind", "canon"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(_SEP, "kind", "canon"), "attempt"))).alias("attempts"))
        done = held.join(maps, "row", "left").withColumn("attempts", F.coalesce("attempts", F.create_map().cast("map<string,int>"))).withColumn("new", _rewrite(F.col("attempts"), key))
    entities = F.transform("forms", lambda x: F.struct(x.kind.alias("kind"), x.mention.alias("mention")))
    return done.select("doc_id", F.col("new").alias("text"), F.size("forms").cast("long").alias("n_entities"), entities.alias("entities"))
