"""Personal data replaced by keyed, type-consistent surrogates, in DataFrame functions only.

Entities are found by one pattern. Each distinct entity (type, canonical form) of all documents gets one
surrogate from a keyed hash: letters for letters and digits for digits, octets for addresses, names of the
same gender and script. Candidates that two entities share, or that are real entities, are drawn again, so
surrogates stay distinct and equal entities stay equal everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stavework.session import share

# Forms of address by gender, in the languages served.
MALE = ["Mr", "Mister", "Herr", "Señor", "Sr", "Don", "Monsieur", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Doña", "Madame", "Mme", "Mademoiselle", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]

# Syllables of invented names by script: beginnings, middles, male ends, female ends, family ends.
SYLLABLES = {
    "latin": (["Ba", "Be", "Co", "Da", "De", "El", "Fa", "Ga", "Ho", "Ja", "Ka", "Le", "Ma", "Na", "Ro", "Sa", "Te", "Va"], ["bri", "da", "lan", "mi", "ner", "ri", "sto", "ta", "vi", "zo"],
              ["n", "rt", "ck", "s", "no"], ["na", "ra", "lia", "tta", "sa"], ["ley", "man", "rez", "mont", "ner", "sen"]),
    "cyrillic": (["Ба", "Ве", "Го", "Да", "Ка", "Ле", "Ма", "Не", "Ро", "Са", "Та"], ["ври", "да", "ли", "ми", "нар", "ри", "сла", "ти"], ["н", "р", "с", "мир", "в"], ["на", "ра", "ля", "са", "ка"], ["ров", "нко", "лин", "ский", "чук"]),
    "greek": (["Αλ", "Βα", "Γε", "Δη", "Θε", "Κα", "Λε", "Μα", "Νι", "Πα"], ["δρι", "κο", "λα", "μη", "νι", "ρα", "στα", "τι"], ["ος", "ης", "ων", "ας", "ις"], ["α", "η", "ία", "ώ", "ίνα"], ["πουλος", "ίδης", "άκης", "έας", "άτος"]),
}

_TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_NAME_WORD = r"\p{Lu}[\p{L}'’]*+(?:-\p{Lu}[\p{L}'’]*+)?"
# Words in front of a telephone number, in the languages served.
_PHONE_WORD = "phone|mobile|cell|call|fax|tel|telefon|téléphone|teléfono|telefono|portable|móvil|mobil|handy|rufnummer|whatsapp"
_H = "[0-9A-Fa-f]{1,4}"
_PHONES = [
    r"(?<![\d+(])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])|\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]\d{3,4}(?![ .-]?\d)",
    r"(?<![\d+(./-])(?<!\d )(?:1[ .-])?\d{3}(?<sep>[ .-])\d{3}\k<sep>\d{4}(?![ .-]?\d)",
    r"(?<!\d)\+\d(?:(?:[ ./-]|[ ./-]?\(|\)[ ./-]?)?\d){7,14}(?!\d)",
    r"(?<![\d+(./-])0\d{1,4}(?<gap>[ .-])(?=(?:[ .-]?\d){5,10}(?!\d))\d{2,4}(?:\k<gap>\d{2,4}){2,4}(?![ .-]?\d)",
    r"(?<![\d+(./-])(?:[6-9]\d{2}(?: \d{2}){3}|[89]\d \d{3}(?: \d{2}){2})(?![ .-]?\d)",
    r"(?<![\d+(./-])(?:0\d{1,4}[ /-]|\(0\d{1,4}\)[ /-]?)\d{5,9}(?![\d.-]\d|\d)",
    r"(?<![\d+(])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])|\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]\d{3,4}(?!\d)",
    rf"(?=\d{{7}})(?<=(?iu:{_PHONE_WORD})(?iu: number| me| us| no\.?| nr\.?)?(?iu: at| on| is| unter| au| al)?\s?[.:]{{0,2}}\s{{0,2}})\d{{7,15}}(?!\d)",
]
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)|"
    rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f]{{0,4}}:)(?=[0-9A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{2,7}}:|:(?::{_H}){{1,7}})(?![\p{{L}}\p{{N}}:])",
    "card": r"(?<![\d.+-])(?:\d{13,19}|\d{4}(?<cut>[ -])\d{4}\k<cut>\d{4}\k<cut>\d{1,4}(?:\k<cut>\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": "|".join(_PHONES),
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "secret": r"(?<![\p{L}\d])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})(?![\p{L}\d])|(?<=[=:\s\"'])(?<=(?i:key|token|secret|passw(?:or)?d)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)(?=[A-Za-z0-9/+_-]*(?:\d|[a-z][A-Z]))[A-Za-z0-9/+_-]{8,}+",
    "name": rf"(?<![\p{{L}}\d])(?:{_TITLE})\.? {_NAME_WORD}(?: {_NAME_WORD})?",
}
ANY = "|".join(PATTERNS.values())
_HINT = rf"[0-9@]|(?:{_TITLE})\.? \p{{Lu}}|(?i:key|token|secret|passw)"
PLAIN_TRIES = 8


def mentions(text: Column) -> Column:
    """All entity mentions of a text in order; none for null."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _kind(m: Column) -> Column:
    whole = {k: m.rlike(f"^(?:{PATTERNS[k]})$") for k in ("email", "ip", "card", "ssn", "phone", "iban", "name")}
    whole["phone"] = whole["phone"] | m.rlike(r"^\d{7,15}$")
    return reduce(lambda rest, k: F.when(whole[k], k).otherwise(rest), ["name", "iban", "phone", "ssn", "card", "ip", "email"], F.lit("secret"))


def _canonical(kind: Column, m: Column) -> Column:
    return F.when((kind == "email") | ((kind == "ip") & F.contains(m, F.lit(":"))), F.lower(m)).when(kind.isin("card", "ssn", "phone", "iban"), F.regexp_replace(m, r"[^\p{L}\p{N}]", "")).otherwise(m)


def _draw(digest: Column, at: Column, n: int | Column) -> Column:
    """A number under n from two hex digits of the digest, taken round and round."""
    return F.conv(F.substr(digest, (at * 2) % 62 + 1, F.lit(4)), 16, 10).cast("int") % n


def _char(ch: Column, i: Column, digest: Column, hexes: Column) -> Column:
    low, high = F.expr("'abcdefghijklmnopqrstuvwxyz'"), F.expr("'ABCDEFGHIJKLMNOPQRSTUVWXYZ'")
    span = F.when(hexes, 6).otherwise(26)
    pick = lambda alphabet: F.substr(alphabet, _draw(digest, i, span) + 1, F.lit(1))
    return (F.when(ch.rlike("^[0-9]$"), _draw(digest, i, 10).cast("string")).when(ch.rlike(r"^\p{Ll}$"), pick(low)).when(ch.rlike(r"^\p{Lu}$"), pick(high)).otherwise(ch))


def _alike(text: Column, digest: Column) -> Column:
    """Letters for letters and digits for digits; hexadecimal strings and addresses stay hexadecimal."""
    hexes = text.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+|[0-9a-f]*:[0-9a-f:]+)$")
    longer = F.concat(digest, F.sha2(digest, 256))
    return F.array_join(F.transform(F.split(text, ""), lambda ch, i: _char(ch, i, F.when(i < 31, digest).otherwise(F.sha2(F.concat(longer, F.floor(i / 31).cast("string")), 256)), hexes)), "")


def _name(script: Column, part: Column, digest: Column) -> Column:
    out = F.lit("")
    for name, (begin, middle, male, female, family) in SYLLABLES.items():
        def of(table, at):
            return F.element_at(F.array(*[F.lit(x) for x in table]), _draw(digest, F.lit(at), len(table)) + 1)
        end = F.when(part == "male", of(male, 3)).when(part == "female", of(female, 3)).when(part == "family", of(family, 3)).otherwise(of(male + female, 3))
        out = F.when(script == name, F.concat(of(begin, 0), of(middle, 1), F.when(_draw(digest, F.lit(6), 2) == 0, of(middle, 2)).otherwise(""), end)).otherwise(out)
    return out


def _candidate(kind: Column, canon: Column, digest: Column, key: str) -> Column:
    domain = F.substring_index(canon, "@", -1)
    host = F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 1)
    email = F.concat(_alike(F.substring_index(canon, "@", 1), digest), F.lit("@"), _alike(host, F.sha2(F.concat(F.lit(key + "|domain|"), domain), 256)), F.regexp_extract(domain, r"(\.[^.]*)$", 1))
    ip = F.concat_ws(".", *[(_draw(digest, F.lit(4 * k), 254) + 1).cast("string") for k in range(4)])
    plain = _alike(canon, digest)
    head = F.substr(plain, F.lit(1), F.length(plain) - 1)
    luhn = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(head, d.cast("string"))))
    card = F.when(F.call_function("luhn_check", canon), F.concat(head, luhn[0].cast("string"))).otherwise(plain)
    iban = F.concat(F.substring(canon, 1, 2), _alike(F.substr(canon, F.lit(3)), digest))
    secret = F.when(canon.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), _alike(F.substr(canon, F.lit(5)), digest))).otherwise(plain)
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    return (F.when(kind == "email", email).when((kind == "ip") & F.contains(canon, F.lit(".")), ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "secret", secret)
            .when(kind.isin("male", "female", "person", "family"), _name(script, kind, digest)).otherwise(plain))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon): no two of a kind alike, none a real entity of that kind.

    Rounds go on until every entity has its own; after PLAIN_TRIES rounds candidates grow by digits or letters of the round,
    so formats with few members cannot run out.
    """
    entities = share(entities.select("kind", "canon").distinct())
    names = F.when(F.col("kind").isin("male", "female", "person", "family"), "name").otherwise(F.col("kind"))
    real = entities.select(names.alias("k"), F.lower("canon").alias("c")).distinct()
    open_, done, turn = entities, None, 0
    while True:
        digest = F.sha2(F.concat(F.lit(key + "|"), "kind", F.lit("|"), "canon", F.lit(f"|{turn}")), 256)
        made = _candidate(F.col("kind"), F.col("canon"), digest, key)
        if turn >= PLAIN_TRIES:
            more = F.when(names == "name", F.translate(F.lit(str(turn)), "0123456789", "aeiouylnrs")).otherwise(F.lit(str(turn)))
            made = F.when(F.col("kind") == "email", F.concat(more, made)).otherwise(F.concat(made, more))
        tried = open_.withColumn("surrogate", made).withColumn("k", names).withColumn("c", F.lower("surrogate"))
        free = tried.join(real, ["k", "c"], "left_anti")
        if done is not None:
            free = free.join(done.select(names.alias("k"), F.lower("surrogate").alias("c")).distinct(), ["k", "c"], "left_anti")
        won = free.groupBy("k", "c").agg(F.min(F.struct("kind", "canon", "surrogate")).alias("w")).select("w.kind", "w.canon", "w.surrogate")
        done = share(won if done is None else done.union(won))
        open_ = share(entities.join(done, ["kind", "canon"], "left_anti"))
        turn += 1
        if open_.isEmpty():
            return done


def _refill(mention: Column, surrogate: Column) -> Column:
    """The surrogate's letters and digits in the mention's punctuation; what is left over follows."""
    pad = F.length(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))
    walked = F.aggregate(F.split(mention, ""), start, lambda acc, ch: F.when(ch.rlike(r"^[\p{L}\p{N}]$"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["out"], F.substr(surrogate, acc["i"], F.lit(1))).alias("out")))
                         .otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["out"], ch).alias("out"))))
    return F.concat(walked["out"], F.substr(surrogate, pad + 1))


def _cased(mention: Column, surrogate: Column) -> Column:
    return F.when((F.upper(mention) == mention) & (F.lower(mention) != mention) & (F.length(mention) > 1), F.upper(surrogate)).otherwise(surrogate)


def replaced(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with their columns, entities in `text_col` replaced, and `_entities`, the number replaced.

    * Every occurrence of an entity gets the same surrogate in all documents, in the occurrence's own punctuation and case.
      Names keep their form of address; given and family names are replaced apart, so a later mention by family name agrees,
      and further bare mentions in the same text are replaced too.
    * Null and empty texts, and texts without entities, come back as they are. Repeated rows are treated alike.
      Rows need no id. An empty table gives no rows. Other columns may have any name not starting with `_pii`.
    * Only texts with entities are written and joined; the others pass through one scan.
    """
    names = [c for c in docs.columns]
    found = docs.withColumn("_pii", mentions(F.col(text_col)))
    clean = found.where(F.size("_pii") == 0).drop("_pii").withColumn("_entities", F.lit(0))
    hits = share(found.where(F.size("_pii") > 0).withColumn("_pii_row", F.monotonically_increasing_id()))
    each = hits.select("_pii_row", F.posexplode("_pii").alias("pos", "mention")).withColumn("kind", _kind(F.col("mention")))
    title = F.regexp_extract("mention", rf"^({_TITLE})(\.? )", 1)
    gender = F.when(title.isin(MALE), "male").when(title.isin(FEMALE), "female").otherwise("person")
    words = F.split(F.regexp_replace("mention", rf"^(?:{_TITLE})\.? ", ""), " ")
    as_name = F.when(F.size(words) == 2, F.array(F.struct(F.lit(0).alias("part"), gender.alias("kind"), words[0].alias("piece")), F.struct(F.lit(1).alias("part"), F.lit("family").alias("kind"), words[1].alias("piece")))).otherwise(
        F.array(F.struct(F.lit(0).alias("part"), F.lit("family").alias("kind"), words[0].alias("piece"))))
    as_whole = F.array(F.struct(F.lit(0).alias("part"), F.col("kind").alias("kind"), F.col("mention").alias("piece")))
    parts = each.select("_pii_row", "pos", "mention", F.explode(F.when(F.col("kind") == "name", as_name).otherwise(as_whole)).alias("p"))
    person = F.col("p.kind").isin("male", "female", "person", "family")
    canon = F.when(person, F.initcap(F.lower(F.col("p.piece")))).otherwise(_canonical(F.col("p.kind"), F.col("p.piece")))
    parts = share(parts.select("_pii_row", "pos", "mention", "p.part", "p.kind", "p.piece", canon.alias("canon")))
    known = surrogates(parts.select("kind", "canon"), key)
    joined = parts.join(known, ["kind", "canon"])
    shown = F.when(F.col("kind").isin("card", "ssn", "phone", "iban"), _refill(F.col("piece"), F.col("surrogate"))).otherwise(_cased(F.col("piece"), F.col("surrogate")))
    joined = joined.withColumn("shown", shown).withColumn("person", F.col("kind").isin("male", "female", "person", "family"))
    whole = joined.groupBy("_pii_row", "pos", "mention").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "shown"))), lambda s: s["shown"]), " ").alias("shown"), F.max("person").alias("person"),
                                                             F.collect_set(F.when(F.col("person"), F.struct(F.col("piece").alias("piece"), F.col("shown").alias("shown")))).alias("people"))
    text = F.when(F.col("person"), F.concat(F.regexp_extract("mention", rf"^((?:{_TITLE})\.? )", 1), "shown")).otherwise(F.col("shown"))
    rows = whole.select("_pii_row", F.struct("pos", text.alias("shown")).alias("s"), "people").groupBy("_pii_row").agg(
        F.transform(F.array_sort(F.collect_list("s")), lambda s: s["shown"]).alias("_pii_shown"), F.array_distinct(F.flatten(F.collect_list("people"))).alias("_pii_people"))
    done = hits.join(rows, "_pii_row")
    between = F.split(F.col(text_col), ANY, -1)
    bare = lambda gap: F.aggregate("_pii_people", gap, lambda t, p: F.when(F.contains(t, p["piece"]), F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), p["piece"], F.lit(r"\E(?![\p{L}\p{N}])")), p["shown"])).otherwise(t))
    rebuilt = F.array_join(F.transform(between, lambda gap, i: F.concat(F.when(F.size("_pii_people") > 0, bare(gap)).otherwise(gap), F.coalesce(F.get("_pii_shown", i), F.lit("")))), "")
    done = done.withColumn("_entities", F.size("_pii_shown")).withColumn(text_col, rebuilt)
    return clean.select(*[F.col(f"`{c}`") for c in names], "_entities").union(done.select(*[F.col(f"`{c}`") for c in names], "_entities"))
