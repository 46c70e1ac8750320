"""Operator 8: personal data is replaced by keyed surrogates of the same type.

Detected: e-mail addresses, IPv4 addresses, phone numbers, card-like numbers of 13 to 19 digits, social
security numbers, IBANs, and names behind an honorific or a known given name; a surname found so is replaced
wherever else its document has it. A surrogate is drawn by HMAC-SHA256 with a secret key from the type,
the normalised value and an attempt number, so an entity gets one surrogate in all documents and in every
format (coreference) and nobody without the key can go back. It is drawn for the normalised value and laid
into the format of each mention: digits stay digits, separators, case, lengths and country codes stay, a
letter is replaced by one of its script, a card number keeps its remainder modulo 10 in the Luhn sum, and a
name keeps gender and script.

Collisions: the distinct entities of the whole corpus are checked. Where two share a surrogate, or a
surrogate is itself an entity of the corpus, all but the first draw again with the next attempt until no
collision is left; a round reads only those that draw again and compares them with what is settled. A name
gets one more syllable with each attempt, so names of any number find room. Only those few have an attempt
above 0; it is joined to the documents that mention them, and all other surrogates are computed in place.

The key is the caller's: ``configured_key`` reads it from the session's configuration and refuses to go on
without one.

Everything is DataFrame code; a text is split at its matches and put together again.

Defined results: a null text stays null; texts without entities stay as they are; repeated rows are
treated alike; other columns pass, whatever they are called, but for ``n_entities``, which is replaced; an
empty table gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.llm.text import let
from varve.session import few, remove, stash

#: The setting that holds the key.
SETTING = "spark.varve.pii.key"
#: Rows that a join of entities broadcasts at most.
FEW = 100_000
#: Attempts after which the values of a short mail or phone format count as used up: from then on it grows.
FULL = 16

# Honorifics and common given names by gender.
MALE_TITLES = "Mr Sir Herr Señor Monsieur Господин".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Señora Señorita Madame Mademoiselle Mme Mlle Госпожа".split()
#: These have no gender; a given name behind them tells it.
TITLES = "Dr Doctor Doktor Docteur Prof Professor Professeur Mx Доктор Профессор".split()
MALE_NAMES = "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul Mark George Hans Klaus Jürgen Wolfgang Pierre Jean Michel Carlos José Juan Luis Miguel".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Anna Emma Laura Julia Ursula Monika Sabine Marie Claire Isabelle Carmen María Ana Lucía Sofía".split()
MALE_CYRILLIC = "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split()
SYLLABLES = {"latin": "bar ken lor mi ran del sto wel hart ming ner tol vas per gar lin dor sel mun ford".split(), "cyrillic": "бар кен лор ми ран дел сто вел гар лин дор сел мун пор тов рин".split(), "greek": "βαρ κεν λορ μι ραν δελ στο βελ γαρ λιν δορ σελ μουν πορ τοβ ριν".split()}
#: Endings of surnames that tell the gender, and what a surrogate of that gender ends with.
ENDINGS = {"f": (r"(?:ова|ева|ёва|ина|ская|цкая|ая)$", "ова"), "m": (r"(?:ов|ев|ёв|ин|ский|цкий|ой|ый)$", "ов")}
#: Country codes of telephone numbers by length: all others have three digits.
ONE_DIGIT, TWO_DIGITS = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

#: What a title or given name begins with: one look at a character spares the long alternations.
_FIRST = "(?=[" + "".join(sorted({x[0] for x in TITLES + MALE_TITLES + FEMALE_TITLES + MALE_NAMES + FEMALE_NAMES + MALE_CYRILLIC + FEMALE_CYRILLIC})) + "])"
_L = r"\p{L}"
#: McDonald, O'Brien, Smith-Jones.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:['’-]?\p{Lu}\p{Ll}+)*"
_TITLE = "|".join(sorted(TITLES + MALE_TITLES + FEMALE_TITLES, key=len, reverse=True))
_GIVEN = "|".join(sorted(MALE_NAMES + FEMALE_NAMES + MALE_CYRILLIC + FEMALE_CYRILLIC, key=len, reverse=True))
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
#: No address of four numbers begins behind this space: a number with groups ends here.
_STOP = r"(?!\x20(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9]))"
IBAN = r"(?=[A-Z]{2}[0-9])(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:" + _STOP + r"\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?=[0-9])(?<![0-9])(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
SSN = r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:" + _STOP + r"[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?=[0-9])(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
CARD = r"(?=[0-9])(?<![0-9])[0-9](?:" + _STOP + r"[\x20-]?[0-9]){12,18}(?![0-9])"
NAME = rf"{_FIRST}(?<!{_L})(?:(?:(?:{_TITLE})\.?\x20)+{_NAME}(?:\x20{_NAME})?|(?:{_GIVEN})\x20{_NAME})(?!{_L})"
ANY = "|".join((EMAIL, IBAN, IP, SSN, PHONE, CARD, NAME))
KINDS = ("email", "iban", "ip", "ssn", "phone", "card", "name")
#: Holds for every text with a match, and costs little.
MAYBE = rf"[0-9]|@|{_FIRST}(?:{_TITLE}|{_GIVEN})\.?\x20\p{{Lu}}"

ACCENTS, CYRILLIC, GREEK = "áéíóúàèìòùâêîôûäëïöü", "абвгдежзиклмнопрстуф", "αβγδεζηθικλμνξοπρστυ"


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(m.rlike(r"^[0-9]"), "card")
        .otherwise("name")
    )


def normal(kind: Column, m: Column) -> Column:
    """What is equal for mentions of one entity."""
    return F.when(kind.isin("iban", "ssn", "phone", "card"), F.regexp_replace(m, r"[^A-Z0-9+]", "")).when(kind == "email", F.lower(m)).otherwise(m)


def configured_key(spark: SparkSession) -> str:
    """The key of the session's configuration; without one no surrogate is made."""
    key = spark.conf.get(SETTING, None)
    if not key:
        raise ValueError(f"set {SETTING}: surrogates need a secret key")
    return key


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 as 64 hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\x00")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    inner = F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def draw(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits, different for every entity and attempt."""
    seed = F.concat_ws("\x1f", kind, value, attempt.cast("string"))
    return let(_hmac(key, seed), lambda first: F.concat(first, F.sha2(first, 256)))


def _number(hexes: Column, at: Column | int, below: int) -> Column:
    """A number under below from six digits of the draw."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.pmod(F.conv(F.substring(hexes, F.pmod(at, F.lit(120)) + 1, F.lit(6)), 16, 10).cast("long"), F.lit(below)).cast("int")


def _letter(alphabet: str, hexes: Column, i: Column) -> Column:
    return F.substring(F.lit(alphabet), _number(hexes, i, len(alphabet)) + 1, F.lit(1))


def _reformed(m: Column, keep: Column, hexes: Column) -> Column:
    """m with its letters and digits behind the first keep of them drawn anew; the k-th letter or digit gets the k-th draw, whatever stands between."""

    def one(c: Column, i: Column) -> Column:
        k = F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        low = F.lower(c)
        new = (
            F.when(c.rlike("[0-9]"), _number(hexes, k, 10).cast("string"))
            .when(low.rlike("[a-z]"), _letter("abcdefghijklmnopqrstuvwxyz", hexes, k))
            .when(c.rlike(r"\p{IsCyrillic}"), _letter(CYRILLIC, hexes, k))
            .when(c.rlike(r"\p{IsGreek}"), _letter(GREEK, hexes, k))
            .when(c.rlike(r"\p{L}"), _letter(ACCENTS, hexes, k))
            .otherwise(c)
        )
        return F.when(k <= keep, c).when(c == low, new).otherwise(F.upper(new))

    return F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), one), "")


def _luhn(m: Column) -> Column:
    """The Luhn sum modulo 10 of the digits of m."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(m, "[^0-9]", "")), ""), lambda c: c != "")
    each = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _longer(steps: Column, hexes: Column, one) -> Column:
    """As many pieces as steps, each of a draw of its own: the space of surrogates has no bound."""
    return F.when(steps > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), lambda k: one(F.sha2(F.concat(hexes, k.cast("string")), 256))), "")).otherwise("")


def _person(kind: Column, hexes: Column, attempt: Column) -> Column:
    """A name for kinds given:<gender>:<script> and surname:<gender or nothing>:<script>."""
    pick = lambda names: F.get(F.array(*map(F.lit, names)), _number(hexes, 0, len(names)))
    one = lambda script, digits, at: F.get(F.array(*map(F.lit, SYLLABLES[script])), _number(digits, at, len(SYLLABLES[script])))
    made = lambda script: F.initcap(F.concat(*[one(script, hexes, 8 * k) for k in range(3)], _longer(attempt, hexes, lambda d: one(script, d, 0))))
    name = F.when(kind.endswith("cyrillic"), made("cyrillic")).when(kind.endswith("greek"), made("greek")).otherwise(made("latin"))
    female = F.when(kind.endswith("cyrillic"), "а").when(kind.endswith("greek"), "α").otherwise("a")
    ending = F.when(kind.startswith("given:f"), female).when(kind == "surname:f:cyrillic", ENDINGS["f"][1]).when(kind == "surname:m:cyrillic", ENDINGS["m"][1]).otherwise("")
    return (
        F.when((kind == "given:m:latin") & (attempt == 0), pick(MALE_NAMES))
        .when((kind == "given:f:latin") & (attempt == 0), pick(FEMALE_NAMES))
        .when((kind == "given:m:cyrillic") & (attempt == 0), pick(MALE_CYRILLIC))
        .when((kind == "given:f:cyrillic") & (attempt == 0), pick(FEMALE_CYRILLIC))
        .otherwise(F.concat(name, ending))
    )


def _country(m: Column) -> Column:
    """Digits of the country code that a number behind + begins with: by the code itself, so equal in all formats."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.when(~m.startswith("+"), 0).when(digits.rlike(f"^{ONE_DIGIT}"), 1).when(digits.rlike(f"^(?:{TWO_DIGITS})"), 2).otherwise(3)


def _octets(m: Column, hexes: Column, attempt: Column) -> Column:
    """Four numbers with as many digits each as those of m, as long as such are left."""

    def one(x: Column, k: Column) -> Column:
        n = F.when(attempt >= FULL, 0).otherwise(F.length(x))
        d = lambda below: _number(hexes, k * 8, below)
        return F.when(n == 1, d(9) + 1).when(n == 2, d(90) + 10).when(n == 3, d(155) + 100).otherwise(d(254) + 1).cast("string")

    return F.array_join(F.transform(F.split(m, r"\."), one), ".")


def surrogate(kind: Column, m: Column, attempt: Column, key: str) -> Column:
    """The surrogate of mention m."""

    def of(hexes: Column) -> Column:
        at = F.instr(m, "@")
        suffix = F.length(F.substring_index(m, ".", -1))
        more = attempt - FULL
        mail = F.concat(_longer(more, hexes, lambda d: _letter("abcdefghijklmnopqrstuvwxyz", d, F.lit(0))), _reformed(F.substring(m, F.lit(1), F.length(m) - suffix), F.lit(0), hexes), F.substring_index(m, ".", -1))

        def card(x: Column) -> Column:
            # the last digit has weight 1 in the sum: it takes up the difference
            last = F.pmod(F.substring(x, -1, 1).cast("int") + _luhn(m) - _luhn(x), F.lit(10)).cast("string")
            return F.concat(F.substring(x, F.lit(1), F.length(x) - 1), last)

        return (
            F.when(kind == "email", F.when(at > 0, mail))
            .when(kind == "ip", _octets(m, hexes, attempt))
            .when(kind == "card", let(_reformed(m, F.lit(0), hexes), card))
            .when(kind == "iban", _reformed(m, F.lit(2), hexes))
            .when(kind == "phone", F.concat(_reformed(m, _country(m), hexes), _longer(more, hexes, lambda d: _number(d, 0, 10).cast("string"))))
            .when(kind == "ssn", _reformed(m, F.lit(0), hexes))
            .otherwise(_person(kind, hexes, attempt))
        )

    return let(draw(kind, normal(kind, m), attempt, key), of)


def parts(m: Column) -> Column:
    """Entities of one match: array of (kind, value); a name has one for each of its words, title excluded."""
    struct = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))

    # what a name has behind its titles: the last word is never one
    titles = F.regexp_extract(m, rf"^(?:(?:{_TITLE})\.?\x20)+", 0)

    def person(ws: Column) -> Column:
        first = F.regexp_replace(F.get(F.split(m, r"\x20"), F.lit(0)), r"\.$", "")
        script = F.when(m.rlike(r"\p{IsCyrillic}"), "cyrillic").when(m.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        ends = lambda w: F.when(script != "cyrillic", "").when(w.rlike(ENDINGS["f"][0]), "f:").when(w.rlike(ENDINGS["m"][0]), "m:").otherwise("")
        tells = F.when(first.isin(*TITLES), F.coalesce(F.regexp_extract(titles, r"(?:^|\x20)(" + "|".join(FEMALE_TITLES) + r")\b", 1), F.lit(""))).otherwise(first)
        tells = F.when(tells == "", F.get(ws, F.lit(0))).otherwise(tells)
        female = tells.isin(*FEMALE_TITLES, *FEMALE_NAMES, *FEMALE_CYRILLIC)
        given = F.concat(F.lit("given:"), F.when(female, "f").otherwise("m"), F.lit(":"), script)
        return F.transform(ws, lambda w, i: struct(F.when((i == 0) & ((F.size(ws) > 1)), given).otherwise(F.concat(F.lit("surname:"), ends(w), script)), w))

    return F.when(kind_of(m) == "name", let(F.split(F.substring(m, F.length(titles) + 1, F.length(m)), r"\x20"), person)).otherwise(F.array(struct(kind_of(m), m)))


def mentions(text: Column) -> Column:
    """All matches in order."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def found_by(ms: Column) -> Column:
    """The pattern of a document with matches ms: ANY, and the bare surnames among them (letters, apostrophes, hyphens)."""
    surnames = F.filter(F.flatten(F.transform(F.filter(ms, lambda m: kind_of(m) == "name"), parts)), lambda e: e["kind"].startswith("surname:"))
    return let(
        F.array_distinct(F.transform(surnames, lambda e: e["value"])),
        lambda xs: F.when(F.size(xs) == 0, F.lit(ANY)).otherwise(F.concat(F.lit(ANY + r"|(?<!\p{L})(?<!\p{L}['’-])(?:"), F.array_join(xs, "|"), F.lit(r")(?!\p{L}|['’-]\p{Lu})"))),
    )


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, norm, value), one row for each distinct entity of the corpus."""
    found = docs.select(F.explode(F.array_distinct(F.flatten(F.transform(mentions(F.col(text)), parts)))).alias("e")).select("e.kind", "e.value")
    return found.groupBy("kind", normal(F.col("kind"), F.col("value")).alias("norm")).agg(F.min("value").alias("value"))


def redraws(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate collides; the others have attempt 0."""
    spark = docs.sparkSession
    drawn = lambda rows: rows.withColumn("s", normal(F.col("kind"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
    # the entity that drew first keeps the surrogate
    rank = F.row_number().over(Window.partitionBy("kind", "s").orderBy("norm"))
    real, real_path = stash(entities(docs, text), "entities")
    names = real.select("kind", F.col("norm").alias("s"))
    columns = ["kind", "norm", "value", "attempt", "s"]
    own, path = stash(drawn(real.withColumn("attempt", F.lit(0))), "drawn")
    judged, _ = stash(own.withColumn("bad", rank > 1).join(names.withColumn("real", F.lit(True)), ["kind", "s"], "left").select(*columns, (F.col("bad") | F.coalesce("real", F.lit(False))).alias("bad")), "judged")
    remove(spark, path)
    settled, left, again = judged.where("not bad").select(*columns), judged.where("bad").select(*columns), None
    while left.limit(1).count():  # names, mails and phones grow with the attempt, so there is always room
        left, path = stash(drawn(left.withColumn("attempt", F.col("attempt") + 1).drop("s")), "drawn")
        asked = few(left.select("kind", "s").distinct(), FEW)
        # what the few drew is looked for among all: only hits are kept
        held = names.unionByName(settled.select("kind", "s")).join(asked, ["kind", "s"], "left_semi").distinct().withColumn("held", F.lit(True))
        judged, _ = stash(left.withColumn("first", rank == 1).join(held, ["kind", "s"], "left").select(*columns, (~F.col("first") | F.coalesce("held", F.lit(False))).alias("bad")), "judged")
        remove(spark, path)
        good, left = judged.where("not bad").select(*columns), judged.where("bad").select(*columns)
        settled, again = settled.unionByName(good), good if again is None else again.unionByName(good)
    return (settled.where("false") if again is None else again).select("kind", "norm", "attempt")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text", again: DataFrame | None = None) -> DataFrame:
    """docs with surrogates in place, and n_entities: how many matches were replaced."""
    again = redraws(docs, key, text) if again is None else again
    names = [c for c in docs.columns if c != "n_entities"]
    mark = F.struct(F.col(id_col).alias("i"), F.xxhash64(F.col(text)).alias("h"))
    # all columns as one value: none can clash with those made here
    docs2 = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text"), mark.alias("_k"))
    if again.limit(1).count():
        own = docs2.select("_k", F.explode(F.array_distinct(F.flatten(F.transform(mentions(F.col("_text")), parts)))).alias("e"))
        hit = own.select("_k", F.col("e.kind").alias("kind"), normal(F.col("e.kind"), F.col("e.value")).alias("norm")).join(few(again, FEW), ["kind", "norm"])
        per, _ = stash(hit.groupBy("_k").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "norm"), "attempt"))).alias("_again")), "again")
        docs2 = docs2.join(few(per.withColumnRenamed("_k", "_m"), FEW), F.col("_k").eqNullSafe(F.col("_m")), "left")
    else:
        docs2 = docs2.withColumn("_again", F.lit(None).cast("map<string,int>"))

    def whole(m: Column) -> Column:
        def of(e: Column) -> Column:
            tries = F.coalesce(F.try_element_at(F.col("_again"), F.concat_ws("\x1f", e["kind"], normal(e["kind"], e["value"]))), F.lit(0))
            return surrogate(e["kind"], e["value"], tries, key)

        # a match is one entity, or a title (kept) and names
        new = F.transform(parts(m), of)
        whole_name = lambda xs: F.array_join(F.concat(F.slice(F.split(m, r"\x20"), F.lit(1), F.size(F.split(m, r"\x20")) - F.size(xs)), xs), " ")
        return let(new, lambda xs: F.when(kind_of(m) == "name", whole_name(xs)).otherwise(F.get(xs, F.lit(0))))

    t = F.col("_text")

    def put(found: Column) -> Column:
        # gaps and surrogates in turn
        by, ms = found["by"], found["ms"]
        rebuilt = let(F.transform(ms, whole), lambda xs: F.array_join(F.zip_with(F.split(t, by, -1), xs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
        return F.struct(F.size(ms).cast("long").alias("n"), F.when(F.size(ms) > 0, rebuilt).otherwise(t).alias("text"))

    # a surname that was found once is replaced wherever the document has it
    again_in = lambda by: F.struct(by.alias("by"), F.regexp_extract_all(t, by, F.lit(0)).alias("ms"))
    seen = lambda ms: F.when(F.size(ms) > 0, let(let(found_by(ms), again_in), put)).otherwise(F.struct(F.lit(0).cast("long").alias("n"), t.alias("text")))
    out = docs2.withColumn("_r", F.when(t.isNotNull(), let(mentions(t), seen)))
    return out.select(*[F.col("_r.text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in names], F.coalesce("_r.n", F.lit(0).cast("long")).alias("n_entities"))
