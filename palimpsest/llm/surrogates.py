"""PII: keyed surrogates for detected entities (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

# Titles and what gender they name, given names by gender and script, syllables of surnames.
TITLES = {
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Pan", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Pani", "г-жа", "госпожа"),
    "n": ("Dr", "Prof", "Professor", "Doctor", "Professeur", "Doktor"),
}
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Konrad Leon Martin Nils Oscar Paul Robin Simon Theo Victor".split(),
    ("latin", "f"): "Alma Bianca Clara Diana Elena Flora Greta Helena Irene Julia Klara Laura Marta Nina Olivia Petra Rosa Sofia Tessa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Лев Максим Николай Олег Павел Роман Степан Тимур".split(),
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Елена Жанна Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья".split(),
}
SYLLABLES = {
    "latin": "bal ber bor dal den dor fal fen gar gel hol kal kem lan lem lor mar mel mon nor pal per ral ren ros sal sel tal ten tor val ver".split(),
    "cyrillic": "бал бер бор вал вер гор дан дол жар зор кал кор лан лев мар мил нов ор пав рад ром сав сел тал тем фад хол чер шал яр".split(),
}

PARTICLES = ("von", "van", "der", "den", "de", "del", "di", "da", "la", "le", "du", "bin", "al", "zu")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square", "Terrace")
#: What announces an untitled name.
CONTEXT = ("my name is", "full name:", "name:", "patient:", "client:", "customer:", "contact person:", "signed by", "sincerely,", "regards,")
#: Attempts after which a surrogate may grow beyond its layout, so that a full space of layouts still ends.
PATIENCE = 12

_WORD = r"\p{Lu}[\p{L}\p{M}'’\-]+"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: -len(t)))
_PARTICLE = "|".join(PARTICLES)
_GAP = "[  ]"
_FIRST = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
_NAMES = rf"(?=[{_FIRST}])(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?{_GAP}(?:(?:{_WORD}|\p{{Lu}}\.|{_PARTICLE}){_GAP}){{0,3}}{_WORD}"
_BARE = rf"(?=\p{{Lu}}[\p{{L}}.])(?<=(?i:{'|'.join(CONTEXT)})[ \n]{{1,2}}){_WORD}(?:{_GAP}(?:{_WORD}|\p{{Lu}}\.|{_PARTICLE})){{0,2}}{_GAP}{_WORD}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV6 = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})"
_SECRET = r"(?<=[:=][ \t]{0,3}[\"']?)(?<=(?i:token|secret|passwd|password|pwd|api.?key|access.?key|auth.?key|private.?key|credential)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?)(?![\"'])(?=[+/_.~=\-]{0,64}[A-Za-z0-9])[A-Za-z0-9+/_.~=\-]{6,}+"
#: What counts as an entity, first match first.
PATTERN = "|".join(
    (
        r"(?<=-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?=[\s]*[A-Za-z0-9])[A-Za-z0-9+/=\s]{16,}+",
        _SECRET,
        r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+)",
        r"[\p{L}\p{M}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
        rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
        rf"(?=[0-9A-Fa-f]{{1,4}}:)(?<![0-9A-Za-z:.]){_IPV6}(?![0-9A-Za-z:])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?<![0-9+])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
        r"(?<![0-9+.,])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
        r"(?<![0-9])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])",
        r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ \-][0-9]{4}(?![0-9])",
        r"(?<![0-9A-Za-z.,+\-])(?:1[ .\-])?[2-9][0-9]{2}([ .\-])[0-9]{3}\1[0-9]{4}(?![0-9]|[.\-][0-9])",
        r"(?<![0-9A-Za-z.,+\-])0[1-9](?:[ .\-][0-9]{2}){4}(?![0-9]|[.\-][0-9])",
        r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
        rf"(?<![0-9A-Za-z.,])[0-9]{{1,5}} (?:{_WORD} ){{1,3}}(?:{'|'.join(STREETS)})(?![\p{{L}}\p{{N}}])",
        _NAMES,
        _BARE,
    )
)
#: A cheap test that texts without any entity fail: a digit, an at sign, an assignment, a title or an announced name. One character class decides at most places.
_MAYBE = rf"[0-9@=:]|(?=[{_FIRST}])(?:{_TITLE})\.?{_GAP}[\p{{Lu}}\p{{Ll}}]|(?=[mMsSrR])(?i:my name is|signed by|sincerely,|regards,)[ \n]"


def _mod97(s: Column) -> Column:
    """An IBAN's remainder: the first four characters go last, letters count from 10."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(F.pmod(F.when(F.ascii(c) >= 65, a * 100).otherwise(a * 10) + value(c), F.lit(97))).cast("int"))


def _luhn(s: Column) -> Column:
    """Luhn sum mod 10 of a digit string."""
    digit = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    values = F.transform(F.filter(F.split(F.reverse(s), ""), lambda c: c != ""), lambda c, i: digit(c.cast("int"), i))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, c: (a + c).cast("int")), F.lit(10))


def kind_of(hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return (
        F.when(hit.contains("@"), "EMAIL")
        .when(hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "IP")
        .when(hit.rlike(rf"^{_IPV6}$"), "IPV6")
        .when(hit.rlike(rf"^[0-9]{{1,5}} {_WORD} "), "ADDRESS")
        .when(hit.rlike(r"^(?:\+[0-9]|\([0-9]|(?:1[ .\-])?[2-9][0-9]{2}[ .\-][0-9]{3}[ .\-][0-9]{4}$|0[1-9](?:[ .\-][0-9]{2}){4}$)"), "PHONE")
        .when(hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "SSN")
        .when(hit.rlike(r"^[0-9](?:[ \-]?[0-9]){12,18}$"), F.when(_luhn(digits) == 0, "CARD").otherwise("NUMBER"))
        .when(hit.rlike(r"^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$") & (F.length(F.replace(hit, F.lit(" "), F.lit(""))) <= 34), F.when(_mod97(hit) == 1, "IBAN").otherwise("SECRET"))
        .when(hit.rlike(rf"^\p{{L}}[\p{{L}}\p{{M}}'’.\-]*{_GAP}\S") & ~hit.rlike("[0-9=+/_~]"), "PERSON")
        .otherwise("SECRET")
    )


def canonical(kind: Column, hit: Column) -> Column:
    """What mentions of one entity have in common: case and separators don't count where the kind has none."""
    return (
        F.when(kind == "EMAIL", F.lower(hit))
        .when(kind.isin("PHONE", "SSN", "CARD", "NUMBER"), F.regexp_replace(hit, "[^0-9+]", ""))
        .when(kind == "IBAN", F.replace(hit, F.lit(" "), F.lit("")))
        .when(kind.isin("SECRET", "IP", "ADDRESS"), hit)
        .otherwise(F.lower(hit))
    )


def _number(at: int, below: int) -> Column:
    """One of the keyed numbers of the row's entity and attempt."""
    return F.pmod(F.conv(F.substring("_a", 1 + 8 * at, 8), 16, 10).cast("long"), F.lit(below))


def _keyed(entities: DataFrame, key: str) -> DataFrame:
    """Add keyed pseudo-random characters to rows (kind, canon, attempt): 48 digits, 64 hexadecimal letters, 64 letters of all."""
    seed = F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
    digits = F.concat(*[F.lpad(F.substr(F.lpad(F.conv(F.substring("_b", 1 + 16 * i, 12), 16, 10), 15, "0"), F.lit(4)), 12, "0") for i in range(4)])
    rest = F.translate(F.substring("_b", 33, 32), "0123456789abcdef", "qrstuvwxyzghijkl")
    return (
        entities.withColumn("_seed", seed)
        .withColumn("_a", F.sha2(F.col("_seed").cast("binary"), 256))
        .withColumn("_b", F.sha2(F.concat("_seed", F.lit("|b")).cast("binary"), 256))
        .withColumn("_digits", digits)
        .withColumn("_hex", F.translate("_a", "0123456789", "abcdefabcd"))
        .withColumn("_letters", F.translate(F.concat(F.substring("_a", 1, 32), rest), "0123456789", "mnopghijkl"))
    )


def _spread(hit: Column, letters: Column, keep: Column) -> Column:
    """Every character after the first ``keep`` replaced by one of its class; others stay."""
    digits = F.col("_digits")
    out = F.transform(
        F.filter(F.split(hit, ""), lambda c: c != ""),
        lambda c, i: F.when(i < keep, c)
        .when(c.rlike("[0-9]"), F.substr(digits, F.pmod(i, F.lit(48)) + 1, F.lit(1)))
        .when(c.rlike("[a-z]"), F.substr(letters, F.pmod(i, F.lit(64)) + 1, F.lit(1)))
        .when(c.rlike("[A-Z]"), F.upper(F.substr(letters, F.pmod(i, F.lit(64)) + 1, F.lit(1))))
        .otherwise(c),
    )
    return F.array_join(out, "")


def _shape_back(hit: Column, digits: Column) -> Column:
    """``digits`` laid into the places of the digits of ``hit``."""
    n = lambda i: F.length(F.regexp_replace(F.substring(hit, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.filter(F.split(hit, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, n(i), F.lit(1))).otherwise(c)), "")


def _values(keyed: DataFrame) -> DataFrame:
    """Add ``new`` to rows (kind, part, canon) of entities that are no names, each in the layout of its mention."""
    kind, hit = F.col("kind"), F.col("part")
    prefix = F.when(kind == "PHONE", F.length(F.regexp_extract(hit, r"^\+([0-9]{1,3}?)(?:[ .\-(]|[0-9]{7})", 1))).when(kind == "SSN", 0).otherwise(1)
    staged = keyed.withColumn("_own", F.regexp_replace("canon", "[^0-9]", "")).withColumn("_n", F.length("_own")).withColumn("_keep", prefix)
    staged = staged.withColumn("_fresh", F.concat(F.substr("_own", F.lit(1), F.col("_keep")), F.substr("_digits", F.lit(1), F.col("_n") - F.col("_keep"))))
    body = F.substr("_fresh", F.lit(1), F.col("_n") - 1)
    staged = staged.withColumn("_body", F.when(kind == "CARD", body))
    check = F.pmod(10 - _luhn(F.concat("_body", F.lit("0"))), F.lit(10)).cast("string")
    staged = staged.withColumn("_shown", F.when(kind == "CARD", F.concat("_body", check)).otherwise(F.col("_fresh")))
    hexadecimal = hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    staged = staged.withColumn("_alphabet", F.when(hexadecimal, F.col("_hex")).otherwise(F.col("_letters")))
    net = F.when(F.col("attempt") < 4, F.lit(10)).otherwise(_number(3, 223) + 1)
    ip = F.concat_ws(".", net.cast("string"), *[_number(i, 256).cast("string") for i in range(3)])
    ipv6 = F.concat_ws(":", F.lit("fd00"), *[F.substring("_a", 1 + 4 * i, 4) for i in range(7)])
    sound = lambda at: F.element_at(F.array(*map(F.lit, SYLLABLES["latin"])), (_number(at, len(SYLLABLES["latin"])) + 1).cast("int"))
    street = F.concat_ws(" ", _spread(F.substring_index(hit, " ", 1), F.col("_letters"), F.lit(0)), F.initcap(F.concat(sound(0), sound(1), sound(2))), F.substring_index(hit, " ", -1))
    local = F.substr("_letters", F.lit(1), F.greatest(F.lit(6), F.least(F.lit(16), F.length(F.substring_index(hit, "@", 1)))) + F.col("attempt"))
    mail = F.concat(local, F.lit("@example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), (_number(7, 3) + 1).cast("int")))
    staged = staged.withColumn("_mail", F.when(kind == "EMAIL", F.when(F.upper(hit) == hit, F.upper(mail)).otherwise(mail)))
    staged = staged.withColumn("_account", F.when(kind == "IBAN", F.upper(_spread(F.col("canon"), F.col("_letters"), F.lit(4)))))
    country = F.substring("_account", 1, 2)
    remainder = _mod97(F.concat(country, F.lit("00"), F.substr("_account", F.lit(5))))
    account = F.concat(country, F.lpad((98 - remainder).cast("string"), 2, "0"), F.substr("_account", F.lit(5)))
    account = F.when(hit.contains(" "), F.rtrim(F.regexp_replace(account, "(.{4})", "$1 "))).otherwise(account)
    return staged.withColumn(
        "new",
        F.when(kind == "EMAIL", F.col("_mail"))
        .when(kind == "IP", ip)
        .when(kind == "IPV6", F.when(F.upper(hit) == hit, F.upper(ipv6)).otherwise(ipv6))
        .when(kind == "ADDRESS", street)
        .when(kind == "IBAN", account)
        .when(kind == "SECRET", _spread(hit, F.col("_alphabet"), F.lit(0)))
        .otherwise(_shape_back(hit, F.col("_shown"))),
    )


# -- persons: each part of a name is an entity, so a surname keeps its surrogate with and without given names --


def _gender(title: Column, name: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(*TITLES["m"]), "m").when(bare.isin(*TITLES["f"]), "f").otherwise(F.when(F.lower(name).rlike("(?:a|e|я|а)$"), "f").otherwise("m"))


def name_parts(hit: Column) -> Column:
    """(kind, part) of each word of a person's mention after the title, if any. kind: SURNAME for the last, else GIVEN, with gender
    and script; KEEP for a particle and INITIAL for an initial, which are no entities of their own."""
    words = F.split(hit, _GAP)
    titled = hit.rlike(rf"^(?:{_TITLE})\.?{_GAP}")
    first = F.when(titled, 1).otherwise(0)
    n = F.size(words)
    gender = F.when(titled, _gender(F.get(words, 0), F.get(words, 1))).otherwise(_gender(F.lit(""), F.get(words, 0)))
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def one(w, i):
        last = i == n - first - 1
        kind = F.concat_ws(":", F.when(last, "SURNAME").otherwise("GIVEN"), F.when(last & (script(w) == "latin"), "-").otherwise(gender), script(w))
        return F.struct(F.when(w.isin(*PARTICLES), "KEEP").when(w.rlike(r"^\p{Lu}\.$"), "INITIAL").otherwise(kind).alias("kind"), w.alias("part"))

    return F.transform(F.slice(words, first + 1, F.lit(8)), one)


def _names(keyed: DataFrame) -> DataFrame:
    """Add ``new`` to rows (kind, part) of names: of the same gender and script."""
    kind, part, attempt = F.col("kind"), F.col("part"), F.col("attempt")
    female, cyrillic = kind.contains(":f:"), kind.endswith("cyrillic")
    both = lambda latin, other: F.when(cyrillic, other).otherwise(latin)

    def one(at: int) -> Column:
        pick = lambda script: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), (_number(at, len(SYLLABLES[script])) + 1).cast("int"))
        return both(pick("latin"), pick("cyrillic"))

    def listed(script: str, gender: str) -> Column:
        return F.element_at(F.array(*map(F.lit, GIVEN[script, gender])), (_number(4, len(GIVEN[script, gender])) + 1).cast("int"))

    vowels = F.translate(F.substr("_b", F.lit(1), attempt), "0123456789abcdef", "aeioaeioaeioaeio")
    more = F.concat(F.when(attempt >= 3, one(3)).otherwise(""), F.when(attempt >= 6, both(vowels, F.translate(vowels, "aeio", "аеио"))).otherwise(""))
    staged = keyed.withColumn("_stem", F.concat(one(0), one(1), one(2), more))
    surname = F.concat("_stem", F.when(~cyrillic, "").when(female, "ова").otherwise("ов"))
    given = F.concat("_stem", both(F.when(female, "ina").otherwise("en"), F.when(female, "ина").otherwise("ен")))
    early = F.when(female, both(listed("latin", "f"), listed("cyrillic", "f"))).otherwise(both(listed("latin", "m"), listed("cyrillic", "m")))
    staged = staged.withColumn("_name", F.when(kind.startswith("SURNAME"), F.initcap(surname)).when(attempt < 3, early).otherwise(F.initcap(given)))
    return staged.withColumn("new", F.when((F.upper(part) == part) & (F.length(part) > 1), F.upper("_name")).otherwise(F.col("_name")))


def replaced(entities: DataFrame, key: str) -> DataFrame:
    """Add ``new`` to rows (kind, part, canon, attempt): a function of key, kind, canonical value and attempt, in the part's layout.

    From attempt PATIENCE on it gets letters more, one for each attempt: no
    layout has room for endlessly many, and the rounds must end.
    """
    columns = [*entities.columns, "new"]
    keyed = _keyed(entities, key)
    name = F.col("kind").contains(":")
    made = _values(keyed.where(~name)).unionByName(_names(keyed.where(name)), allowMissingColumns=True)
    more = F.substr("_letters", F.lit(1), F.least(F.lit(64), F.greatest(F.lit(0), F.col("attempt") - PATIENCE + 1)))
    return made.withColumn("new", F.concat("new", more)).select(*columns)


# -- the operator ------------------------------------------------------------


def _mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _parts(mentions: DataFrame) -> DataFrame:
    """The entities of distinct mentions: rows (hit) → (hit, place, kind, part, canon). A name has one for each word."""
    typed = mentions.withColumn("kind", kind_of(F.col("hit")))
    names = typed.where("kind = 'PERSON'").select("hit", F.posexplode(name_parts(F.col("hit"))).alias("place", "p")).select("hit", "place", "p.kind", "p.part", F.lower("p.part").alias("canon"))
    others = typed.where("kind <> 'PERSON'").select("hit", F.lit(0).alias("place"), "kind", F.col("hit").alias("part"), canonical(F.col("kind"), F.col("hit")).alias("canon"))
    return names.unionByName(others)


def _form(c: Column) -> Column:
    """What two surrogates must differ in."""
    return F.lower(F.regexp_replace(c, "[ \\-().]", ""))


def attempts(parts: DataFrame, key: str) -> DataFrame:
    """Entities (kind, canon) with the number of the attempt that gives each a surrogate of its own.

    Taken is a surrogate that a settled value of the group has, or that is
    itself a value of the group in the corpus; of several values that want one
    surrogate, the smallest gets it. The others, and only they, are made again
    with their next attempt, until nobody is left.
    """
    group = F.regexp_replace(F.regexp_extract("kind", "^[A-Z0-9]+", 0), "^(?:PHONE|SSN|CARD)$", "NUMBER")
    values = stash(parts.groupBy("kind", "canon").agg(F.min("part").alias("part")).withColumn("group", group), "pii-values")
    taken = values.select("group", _form(F.col("part")).alias("form")).distinct()
    columns = ["kind", "canon", "part", "group"]
    waiting, settled, attempt = values, None, 0
    while True:
        made = replaced(waiting.withColumn("attempt", F.lit(attempt)), key).withColumn("form", _form(F.col("new")))
        free = made.groupBy("group", "form").agg(F.min(F.struct("canon", "kind")).alias("owner"))
        used = taken if settled is None else taken.unionByName(settled.select("group", "form"))
        free = free.join(used, ["group", "form"], "left_anti")
        judged = made.join(free, ["group", "form"], "left").withColumn("won", F.coalesce(F.col("owner") == F.struct("canon", "kind"), F.lit(False)))
        judged = stash(judged.select(*columns, "attempt", "form", "won"), "pii-attempts")
        won = judged.where("won").drop("won")
        settled = won if settled is None else settled.unionByName(won)
        waiting = judged.where("not won").select(*columns)
        attempt += 1
        if waiting.isEmpty():
            return settled.select("kind", "canon", "attempt")


def anonymise(documents: DataFrame, *, key: str) -> DataFrame:
    """Replace personal data and secrets in rows (doc_id, text).

    Found are e-mail, IPv4 and IPv6 addresses, phone, card, account and social
    security numbers, street addresses, secrets (assigned, well-known forms,
    private keys, long hexadecimal tokens), names with a title or announced by
    words such as "my name is", and in the same text later mentions of these
    surnames. Other names and dates are not looked for.

    A mention's surrogate depends on ``key``, its kind and its canonical value,
    so one entity has one surrogate everywhere; it keeps the mention's kind,
    script, gender and layout (card numbers and IBANs keep valid check digits
    where they had them). All distinct values are compared: no two share a
    surrogate, and none is a value that occurs in the corpus. Where a layout
    has too little room, surrogates grow beyond it. Values without a letter or
    digit are no secrets. Only texts with mentions are shuffled, by their
    digest, to meet the surrogates of their mentions.

    Returns doc_id, text, n_entities (mentions replaced). Null text stays
    null, 0 mentions. Equal texts are replaced alike, whatever their doc_id.
    Empty table: empty. Other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    maybe = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))
    dirty = docs.where(maybe).withColumn("digest", F.md5(F.col("text").cast("binary")))
    mentions = stash(dirty.select("digest", F.explode(F.array_distinct(_mentions(F.col("text")))).alias("hit")).distinct(), "pii-mentions")
    parts = stash(_parts(mentions.select("hit").distinct()), "pii-parts")
    entity = ~F.col("kind").isin("KEEP", "INITIAL")
    chosen = replaced(parts.where(entity).join(attempts(parts.where(entity), key), ["kind", "canon"]), key).drop("attempt")
    letter = F.upper(F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("INITIAL"), "part").cast("binary"), 256), 1, 1), "0123456789abcdef", "ABCDEFGHIJKLMNOP"))
    others = parts.where(~entity).withColumn("new", F.when(F.col("kind") == "KEEP", F.col("part")).otherwise(F.concat(letter, F.lit("."))))
    words = F.transform(F.sort_array(F.collect_list(F.struct("place", "new"))), lambda p: p["new"])
    title = F.when(F.max(F.col("kind").contains(":")), F.regexp_extract("hit", rf"^(?:{_TITLE})\.?{_GAP}", 0)).otherwise("")
    surname = F.max(F.when(F.col("kind").startswith("SURNAME") & (F.length("part") > 2), F.struct("part", "new")))
    surrogates = stash(chosen.unionByName(others).groupBy("hit").agg(F.concat(title, F.array_join(words, " ")).alias("new"), surname.alias("surname")), "pii-surrogates")
    met = stash(mentions.join(surrogates, "hit"), "pii-met")
    names = met.where("surname is not null").groupBy("digest", F.col("surname.part").alias("part")).agg(F.min("surname.new").alias("alias"))
    names = names.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("part", "alias"))).alias("names"))
    marks = met.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("hit", "new"))).alias("marks")).join(names, "digest", "left")
    known = F.col("marks").isNotNull()
    found = dirty.join(marks, "digest", "left").withColumn("hits", F.when(known, _mentions(F.col("text")))).withColumn("gaps", F.when(known, F.split("text", PATTERN, -1)))
    found = found.withColumn("new", F.transform("hits", lambda h: F.try_element_at("marks", h)))
    pieces = F.split(F.array_join("gaps", "\x00"), r"(?<=\p{L})(?![\p{L}\p{M}'’\-])|(?<![\p{L}\p{M}'’\-])(?=\p{L})", -1)
    found = found.withColumn("again", F.when(F.col("names").isNotNull(), pieces))
    later = F.size(F.filter("again", lambda w: F.map_contains_key("names", w)))
    renamed = F.split(F.array_join(F.transform("again", lambda w: F.coalesce(F.try_element_at("names", w), w)), ""), "\x00", -1)
    found = found.withColumn("gaps", F.when(F.col("names").isNotNull() & ~F.col("text").contains("\x00"), renamed).otherwise(F.col("gaps")))
    text = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("new", i), F.lit("")))), "")
    count = F.coalesce(F.array_size("hits"), F.lit(0)) + F.when(F.col("names").isNotNull() & ~F.col("text").contains("\x00"), later).otherwise(0)
    changed = found.select("doc_id", F.when(known, text).otherwise(F.col("text")).alias("text"), count.cast("long").alias("n_entities"))
    return docs.where(~maybe).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")).unionByName(changed)
