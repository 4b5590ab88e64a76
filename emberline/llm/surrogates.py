"""Surrogates for personal data: keyed, consistent replacements that keep type, script, gender and format.

One pattern finds e-mail addresses, secrets after a name, access keys, account, card, social security and phone
numbers, IPv4 addresses, and names after a title. Each occurrence has a canonical form (case, separators and title
apart), and each distinct canonical form one surrogate, drawn from a keyed digest, so that a person or number is the
same one in every document. Characters become characters of their kind; country codes, issuers' first digits, top
level domains and names of secrets stay; names come from lists by gender of the title and by script.

Collision check: a surrogate that equals a found value or another's surrogate is drawn anew with the next attempt
number, until none collides. Later attempts lengthen names and addresses, so there is always room.

Text is rebuilt from the gaps between matches and the surrogates, so nothing is replaced twice. Everything is
built-in functions.

Defined results: a null text stays null with no entities. Equal rows get equal texts. Texts are searched whole. No
documents give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import read, written

KEY = "emberline"
#: Attempts after which names and addresses get longer.
ROOMY = 4

_octet = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος"),
    "n": ("Dr", "Prof"),
}
_title = "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + ")"
# A printable ASCII character of a secret; of a query string only one value.
_sign = r"(?:[!#-%(-+\--9=?-~]|&(?![A-Za-z0-9_]+=))"
# Numbers with a country code; with an area code in brackets; of three, three and four digits; with a trunk zero, of
# nine to twelve digits or of five pairs.
_phones = (
    r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}",
    r"\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}",
    r"\(0[0-9]{1,4}\) ?[0-9]{3,8}(?:[ \-][0-9]{2,5}){0,2}",
    r"(?<![\p{L}\p{N}]|[0-9][.\-])(?:(?:1[ .\-])?[2-9][0-9]{2}[ .\-][0-9]{3}[ .\-][0-9]{4}"
    r"|0[1-9](?:[ .\-][0-9]{2}){4}"
    r"|(?=(?:[ ./\-]?[0-9]){9,12}(?![0-9]))0[1-9][0-9]{1,3}[ ./\-][0-9]{3,8}(?:[ .\-][0-9]{2,5}){0,2})(?![.\-][0-9])",
)
#: Kinds in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "secret": r"(?<![\p{L}\p{N}])(?i:password|passwd|pwd|token|secret|api[_\-]?key)\s*[=:]\s*[\"']?(?=[^\s\"']*[A-Za-z0-9])" + _sign + r"{7,}[#-%*+/0-9=@-Z^_a-z~\-][\"']?",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": rf"(?<![0-9])(?:{'|'.join(_phones)})(?![0-9])",
    "card": r"(?<![0-9.])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "ip": rf"(?<![0-9.])(?:{_octet}\.){{3}}{_octet}(?![0-9]|\.[0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_title}\.? \p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+){{0,2}}",
}
ANY = "(?:" + "|".join(PATTERNS.values()) + ")"
#: A text that matches none of the patterns for want of a digit, an at sign or a title is not searched further.
HINT = rf"[0-9@]|[=:]\s*[\"']?{_sign}{{8}}|{_title}"
SECRET_NAME = r"^[A-Za-z_\-]+\s*[=:]\s*[\"']?"

FIRST = {
    "latin": {"f": ("Anna", "Clara", "Edith", "Helen", "Irene", "Julia", "Laura", "Marta"), "m": ("Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Louis", "Oscar"), "n": ("Alex", "Kim", "Robin", "Sasha")},
    "cyrillic": {"f": ("Анна", "Вера", "Елена", "Ольга"), "m": ("Иван", "Олег", "Павел", "Юрий"), "n": ("Женя", "Саша")},
    "greek": {"f": ("Ελένη", "Μαρία", "Σοφία"), "m": ("Γιώργος", "Νίκος", "Πέτρος"), "n": ("Άγγελος", "Χάρις")},
}
SYLLABLES = {
    "latin": ("bar", "cor", "den", "fal", "gri", "hol", "jan", "kel", "lor", "mar", "nor", "pel", "ras", "sil", "tor", "wen"),
    "cyrillic": ("бар", "вол", "гор", "дан", "зар", "кор", "лев", "мар", "нор", "пет", "ром", "сол"),
    "greek": ("αλε", "βασ", "δημ", "καλ", "λαμ", "μαρ", "νικ", "παπ", "σαρ", "τασ"),
}


def kind_of(found: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        kind = F.when(found.rlike(rf"\A{pattern}\z"), F.lit(name)).otherwise(kind)
    return kind


def canonical(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9+]", "")
    bare = F.regexp_replace(F.regexp_replace(found, rf"^{_title}\.? ", ""), " +", " ")
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind.isin("ssn", "phone", "card"), digits)
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind == "secret", F.regexp_replace(F.regexp_replace(found, SECRET_NAME, ""), "[\"']$", ""))
        .when(kind == "name", F.initcap(bare))
        .otherwise(found)
    )


def gender_of(found: Column) -> Column:
    gender = F.lit("n")
    for name in ("m", "f"):
        gender = F.when(found.rlike(rf"^(?:{'|'.join(TITLES[name])})\.? "), F.lit(name)).otherwise(gender)
    return gender


def drawn(digest: Column, place: Column | int) -> Column:
    """A number from 0 to 4095 for a place in a digest of 128 hexadecimal digits."""
    at = (F.lit(place) if isinstance(place, int) else place) * 3 % 126 + 1
    return F.conv(F.substring(digest, at, F.lit(3)), 16, 10).cast("int")


def picked(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), number % len(values))


def like(char: Column, number: Column, narrow: Column) -> Column:
    """A character of the same kind, case and script; `narrow` keeps hexadecimal digits so."""
    def span(low: str, count: int) -> Column:
        return F.char(F.lit(ord(low)) + number % count) if ord(low) < 128 else picked(tuple(chr(ord(low) + i) for i in range(count)), number)

    return (
        F.when(char.rlike("[0-9]"), span("0", 10))
        .when(narrow & char.rlike("[a-f]"), span("a", 6))
        .when(narrow & char.rlike("[A-F]"), span("A", 6))
        .when(char.rlike(r"\p{IsCyrillic}"), F.when(char == F.upper(char), span("А", 32)).otherwise(span("а", 32)))
        .when(char.rlike(r"\p{IsGreek}"), F.when(char == F.upper(char), span("Α", 17)).otherwise(span("α", 17)))
        .when(char.rlike(r"\p{L}"), F.when(char == F.lower(char), span("a", 26)).otherwise(span("A", 26)))
        .otherwise(char)
    )


def syllable(values: tuple[str, ...], digest: Column, place: Column) -> Column:
    return picked(values, drawn(digest, place))


def surrogate(kind: Column, value: Column, gender: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of a canonical form for an attempt."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 512)
    kept = F.coalesce(F.when(kind == "phone", F.when(value.rlike(r"^\+[17]"), 2).when(value.rlike(r"^\+"), 3).otherwise(1)).when(kind == "card", 1).when(kind == "iban", 2).when(kind == "key", 4), F.lit(0))
    ending = F.when(kind == "email", F.length(F.regexp_extract(value, r"\.[^.]+$", 0))).otherwise(F.lit(0))
    # Only a value of hexadecimal digits alone stays one.
    narrow = (kind == "secret") & value.rlike("^[0-9a-fA-F]+$")
    places = F.sequence(F.lit(1), F.length(value))
    chars = F.transform(
        places,
        lambda i: F.when((i <= kept) | (i > F.length(value) - ending), F.substring(value, i, F.lit(1))).otherwise(
            like(F.substring(value, i, F.lit(1)), drawn(digest, i), narrow)
        ),
    )
    longer = F.when((kind == "email") & (attempt > ROOMY), F.substring(digest, F.lit(1), attempt.cast("int"))).otherwise(F.lit(""))
    ip = F.concat_ws(".", *[(1 + drawn(digest, i) % 223 if i == 0 else drawn(digest, i) % 256).cast("string") for i in range(4)])
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    name = F.lit(None)
    for wanted, firsts in FIRST.items():
        syllables = 3 + F.when(attempt > ROOMY, attempt).otherwise(F.lit(0))
        parts = F.transform(F.sequence(F.lit(5), syllables + 4), partial(syllable, SYLLABLES[wanted], digest))
        last = F.initcap(F.array_join(parts, ""))
        first = F.lit(None)
        for sex, names in firsts.items():
            first = F.when(gender == sex, picked(names, drawn(digest, 1))).otherwise(first)
        second = picked(firsts["n"], drawn(digest, 2))
        words = F.size(F.split(value, " "))
        full = F.when(words == 1, last).when(words == 2, F.concat_ws(" ", first, last)).otherwise(F.concat_ws(" ", first, second, last))
        name = F.when(script == wanted, full).otherwise(name)
    return F.when(kind == "ip", ip).when(kind == "name", name).otherwise(F.concat(longer, F.array_join(chars, "")))


def shaped(kind: Column, found: Column, new: Column) -> Column:
    """A surrogate in the format of an occurrence."""
    digits = F.regexp_replace(new, "[^0-9]", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(found, F.lit(1), i), "[^0-9]", ""))
    filled = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(found)),
            lambda i: F.when(F.substring(found, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, before(i), F.lit(1))).otherwise(F.substring(found, i, F.lit(1))),
        ),
        "",
    )
    compact = lambda i: F.length(F.replace(F.substring(found, F.lit(1), i), F.lit(" "), F.lit("")))
    grouped = F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(found)), lambda i: F.when(F.substring(found, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(new, compact(i), F.lit(1)))), ""
    )
    shouted = F.when((found == F.upper(found)) & (found != F.lower(found)), F.upper(new)).otherwise(new)
    return (
        F.when(kind.isin("ssn", "phone", "card"), filled)
        .when(kind == "iban", grouped)
        .when(kind == "secret", F.concat(F.regexp_extract(found, SECRET_NAME, 0), new, F.regexp_extract(found, "[\"']$", 0)))
        .when(kind == "name", F.concat(F.regexp_extract(found, rf"^{_title}\.? ", 0), new))
        .when(kind == "email", shouted)
        .otherwise(new)
    )


def row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("row_a"), F.hash("text", "doc_id").alias("row_b")]


def occurrences(docs: DataFrame) -> DataFrame:
    """row_a, row_b, pos, found, kind, value, gender of every match."""
    matches = F.regexp_extract_all("text", F.lit(ANY), 0)
    hinted = docs.where(F.col("text").rlike(HINT)).select(*row_keys(), F.posexplode(matches).alias("pos", "found"))
    kinded = hinted.withColumn("kind", kind_of(F.col("found")))
    return kinded.withColumn("value", canonical(F.col("kind"), F.col("found"))).withColumn("gender", gender_of(F.col("found")))


def distinct_surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """kind, value, new: one surrogate for each canonical form, all distinct and none a found value."""
    fields = ["kind", "value", "gender"]
    entities = found.groupBy("kind", "value").agg(F.min("gender").alias("gender"))
    drawn_now = entities.withColumn("attempt", F.lit(0)).withColumn("new", surrogate(*map(F.col, fields), F.col("attempt"), key))
    current = written(drawn_now)
    while True:
        # Of the holders of a surrogate the one of fewest attempts, then least value, keeps it; a found value goes first.
        real = current.select("kind", F.col("value").alias("new"), F.lit(-1).alias("attempt"), F.lit("").alias("value"))
        claims = current.select("kind", "new", "attempt", "value").union(real)
        owners = claims.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("owner"), F.count(F.lit(1)).alias("claims"))
        taken = owners.where(F.col("claims") > 1).select("kind", "new", "owner")
        clash = F.col("owner").isNotNull() & (F.col("owner") != F.struct("attempt", "value"))
        judged = written(current.join(taken, ["kind", "new"], "left").select(*fields, "attempt", "new", F.coalesce(clash, F.lit(False)).alias("clash")))
        if judged.where("clash").isEmpty():
            return judged.select("kind", "value", "new")
        again = judged.where("clash").select(*fields, (F.col("attempt") + 1).alias("attempt"))
        again = again.withColumn("new", surrogate(*map(F.col, fields), F.col("attempt"), key))
        current = written(judged.where("NOT clash").select(*fields, "attempt", "new").union(again.select(*fields, "attempt", "new")))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates, and the number of entities of every document."""
    docs = docs.select("doc_id", "text")
    found = written(occurrences(docs))
    replaced = found.join(distinct_surrogates(found, key), ["kind", "value"])
    shown = replaced.select("row_a", "row_b", F.struct("pos", shaped(F.col("kind"), F.col("found"), F.col("new")).alias("shown")).alias("entity"))
    by_row = shown.groupBy("row_a", "row_b").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    gaps = F.split("text", ANY, -1)
    rebuilt = F.array_join(F.zip_with(gaps, "entities", lambda gap, e: F.concat(gap, F.coalesce(e["shown"], F.lit("")))), "")
    return docs.select("doc_id", "text", *row_keys()).join(by_row, ["row_a", "row_b"], "left").select(
        "doc_id",
        F.when(F.col("entities").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        F.coalesce(F.size("entities"), F.lit(0)).alias("entities"),
    )


def op8_keyed_surrogates(spark: SparkSession, directory: str) -> DataFrame:
    return pseudonymise(read(spark, directory, "documents"))
