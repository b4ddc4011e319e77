"""Surrogates for personal data: keyed, of the same kind and format, distinct and the same wherever an entity recurs. DataFrame functions only.

Detected are e-mail addresses, phone, card and social-security numbers, IPv4 addresses, IBANs, and names after a title (Latin, Cyrillic, Greek or Arabic), which
also tells the gender where it has one; a document's names are then found wherever else it spells them alike. An entity is a kind and a canonical form (case and
separators dropped), so that all its spellings share a surrogate. The surrogate is made from a keyed hash (HMAC-SHA-512), sign by sign: digits for digits, vowels for vowels, consonants for consonants, and letters of
the same script; with the country code, the network digit and Luhn's sum of a card, octets in range, the top-level domain, and
the ending of a given name by gender. Each spelling is then rendered with its own separators and capitals.

Collision checks: a surrogate that another entity of its kind has, or that is itself an entity of the corpus, goes to the least
canonical form or to none; the others hash anew until no collision is left. After SAME_LENGTH tries one sign is added a try, so that
it ends even where a format has too few values.

Defined cases: a null text stays null and has no entity; documents without entities keep their text; repeated rows get the same text each;
an empty table gives no rows; further columns of the input pass ``replace`` under any name. Where two collide the smaller canonical form keeps its surrogate.
A very long text is handled whole, in the row that holds it; its entities are rows of their own.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, documents

#: The key of the query alone; ``replace`` takes the caller's.
QUERY_KEY = "surrogate-key-1"
SAME_LENGTH = 12
# fixed values: titles by gender, and letters by script
MALE = r"Mr|Mister|Sir|Herr|Señor|Sr|Monsieur|M\.(?= )|Господин|Κύριος|السيد|سيد"
FEMALE = r"Mrs|Ms|Miss|Frau|Fräulein|Señora|Señorita|Sra|Srta|Madame|Mademoiselle|Mme|Mlle|Lady|Госпожа|Κυρία|السيدة|الآنسة"
EITHER = r"Dr|Doctor|Prof|Professor|Доктор|Профессор|الدكتور|الدكتورة"
SCRIPTS = (
    ("[aeiou]", "aeiou"),
    ("[b-df-hj-np-tv-z]", "bcdfghjklmnprstvz"),
    ("[à-öø-ÿ]", "áéíóúàèòñçüöä"),
    ("[аеёиоуыэюя]", "аеиоуя"),
    ("[б-джзй-нп-тф-щъь]", "бвгджзклмнпрстфхцчш"),
    ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("[ء-ي]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
)
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"
IP = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-])"
PHONE = r"(?<![\p{L}\p{N}.+\-])\+?(?:\d{1,3}[ .\-]?)?\(?\d{2,4}\)?[ .\-]\d{3,4}[ .\-]\d{3,4}(?![\d\-])"
#: With a country code: 8 to 15 digits in groups of any size.
ABROAD = r"(?<![\p{L}\p{N}.+\-])\+(?=(?:[ .\-()]{0,2}\d){8,15}(?![ .\-()]{0,2}\d))\d{1,3}(?:[ .\-]{0,1}\(?\d{1,8}\)?){1,7}(?!\d)"
#: A name begins with a capital, or is of Arabic letters, which have none.
NAME = r"(?:\p{Lu}[\p{L}\-]+|[\u0621-\u064A]{2,})"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE}|{EITHER})\.? {NAME}(?: {NAME})?"
ANY = "|".join((EMAIL, IP, IBAN, SSN, CARD, ABROAD, PHONE, PERSON))
SEPARATORS = r"[^\p{L}\p{N}]"


def kind(surface: Column) -> Column:
    """The kind of a match, in the order of the alternatives."""
    whole = [("email", EMAIL), ("ip", IP), ("iban", IBAN), ("ssn", SSN), ("card", CARD), ("phone", f"{ABROAD}|{PHONE}")]
    return reduce(lambda rest, x: F.when(surface.rlike(f"^(?:{x[1]})$"), F.lit(x[0])).otherwise(rest), reversed(whole), F.lit("person"))


def canonical(of: Column, surface: Column) -> Column:
    return F.when(of.isin("email", "ip"), F.lower(surface)).otherwise(F.lower(F.regexp_replace(surface, SEPARATORS, "")))


def _value(hexes: Column, i: Column) -> Column:
    """The i-th byte of a hash, as a number."""
    return F.conv(F.substring(hexes, ((2 * i) % 126 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, v: Column) -> Column:
    return F.substring(F.lit(letters), (v % len(letters) + 1).cast("int"), F.lit(1))


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 (RFC 2104) of a text, in hex."""
    raw = key.encode()
    block = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    pad = lambda x: F.lit(bytearray(c ^ x for c in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 512))
    return F.sha2(F.concat(pad(0x5C), inner), 512)


def surrogate(of: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form; it is as long as ``canon`` but for late attempts."""
    hexes = hmac(key, F.concat_ws("|", of, canon, attempt.cast("string")))
    n = F.length(canon)

    def sign(c: Column, i: Column) -> Column:
        v = _value(hexes, i)
        letter = reduce(lambda rest, s: F.when(c.rlike(f"^{s[0]}$"), _pick(s[1], v)).otherwise(rest), reversed(SCRIPTS), c)
        digit = (v % 10).cast("string")
        lead = (v % 8 + 2).cast("string")
        plain = F.when(c.rlike("^[0-9]$"), digit).otherwise(letter)
        kept = (
            ((of == "phone") & (i < n - 10))
            | ((of == "card") & (i == 0))
            | ((of == "iban") & (i < 2))
            | ((of == "email") & (i >= n - F.length(F.substring_index(canon, ".", -1))))
        )
        return F.when(kept, c).when((of == "phone") & ((i == n - 10) | (i == n - 7)), lead).otherwise(plain)

    signs = F.transform(F.split(canon, ""), sign)
    text = F.array_join(signs, "")

    # a card's last digit makes Luhn's sum a multiple of ten
    def doubled(d: Column, i: Column) -> Column:
        x = d.cast("int") * F.when((n - 1 - i) % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    body = F.slice(signs, F.lit(1), F.greatest(n - 1, F.lit(0)))
    total = F.aggregate(F.transform(F.when(of == "card", body).otherwise(F.array().cast("array<string>")), doubled), F.lit(0), lambda a, x: a + x)
    card = F.concat(F.array_join(body, ""), ((10 - total % 10) % 10).cast("string"))

    # octets keep their number of digits and stay below 255
    def octet(o: Column, i: Column) -> Column:
        v = _value(hexes, 2 * i) * 256 + _value(hexes, 2 * i + 1)
        return F.when(F.length(o) == 3, 100 + v % 155).when(F.length(o) == 2, 10 + v % 90).otherwise(1 + v % 9).cast("string")

    ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    v = _value(hexes, F.lit(62))
    latin = canon.rlike("[a-z]$")
    cyrillic = canon.rlike("[а-яё]$")
    start = F.substring(text, F.lit(1), (n - 1).cast("int"))
    given_f = F.when(latin, F.concat(start, F.lit("a"))).when(cyrillic, F.concat(start, F.lit("а"))).otherwise(text)
    given_m = F.when(latin, F.concat(start, _pick("nrsdkt", v))).when(cyrillic, F.concat(start, _pick("нрсдкт", v))).otherwise(text)
    made = F.when(of == "card", card).when(of == "ip", ip).when(of == "given_f", given_f).when(of == "given_m", given_m).otherwise(text)
    more = F.greatest(attempt - SAME_LENGTH, F.lit(0)).cast("int")
    tail = F.substring(F.when(of.isin("email", "given_f", "given_m", "given", "surname"), F.translate(hexes, "0123456789", "ghijklmnop")).otherwise(F.translate(hexes, "abcdef", "012345")), F.lit(1), more)
    return F.when(of == "email", F.concat(tail, made)).otherwise(F.concat(made, tail))


def rendered(surface: Column, canon: Column, made: Column, of: Column) -> Column:
    """The surrogate with the separators and capitals of a spelling; what is longer than the spelling follows behind."""
    exact = of.isin("email", "ip")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        own = F.substring(made, a["at"], F.lit(1))
        own = F.when(c != F.lower(c), F.upper(own)).otherwise(own)
        takes = exact | c.rlike(r"^[\p{L}\p{N}]$")
        return F.struct(F.concat(a["out"], F.when(takes, own).otherwise(c)).alias("out"), (a["at"] + F.when(takes, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(surface, ""), start, step, lambda a: F.concat(a["out"], F.substring(made, a["at"], F.length(made))))


def settled(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, canon, made of all entities, without collisions."""
    open_, done, step = entities.withColumn("attempt", F.lit(0)), None, 0
    while True:
        tried = scratch.table(open_.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), f"tried-{step}")
        real = entities.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real"))
        free = tried.join(real.hint("merge"), ["kind", "made"], "left")
        if done is not None:
            free = free.join(done.select("kind", "made", F.lit(True).alias("taken")).hint("merge"), ["kind", "made"], "left")
        else:
            free = free.withColumn("taken", F.lit(None).cast("boolean"))
        first = F.row_number().over(W.partitionBy("kind", "made").orderBy("canon")) == 1
        free = scratch.table(free.withColumn("good", first & F.col("real").isNull() & F.col("taken").isNull()), f"free-{step}")
        good = free.where("good").select("kind", "canon", "made")
        done = good if done is None else scratch.table(done.unionByName(good), f"done-{step}")
        open_ = free.where("not good").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return done
        step += 1


def spread_names(piece: Column, names: Column) -> Column:
    """A piece of text in which the words that ``names`` (a map) has are what they become there."""
    words = F.regexp_extract_all(piece, F.lit(r"\p{L}[\p{L}\-]*|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(names, w), w)), "")


def replace(docs: DataFrame, spark: SparkSession, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities (the matches in it), where ``docs`` has no such column of its own. ``key`` is the caller's secret."""
    scratch = Scratch(spark, "pii")
    names = docs.columns
    told = lambda text, n: [*[(text if c == "text" else F.col("whole").getField(c)).alias(c) for c in names], *([] if "n_entities" in names else [n.cast("long").alias("n_entities")])]
    found = F.when(F.col("text").rlike(f"[@0-9]|{MALE}|{FEMALE}|{EITHER}"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    marked = docs.select(F.struct(*names).alias("whole"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    hits = scratch.table(marked.where(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id()), "hits")
    units = hits.select("row", F.posexplode("found").alias("pos", "match")).withColumn("kind", kind(F.col("match")))
    # a name is replaced word by word: the last word is the surname, one before it the given name, and the title stays
    words = F.when(F.col("kind") == "person", F.split("match", " ")).otherwise(F.array("match"))
    units = units.withColumn("words", words).select("row", "pos", "kind", "words", F.posexplode("words").alias("word", "surface"))
    title = F.element_at("words", 1)
    given = F.when(title.rlike(rf"^(?:{FEMALE})\.?$"), "given_f").when(title.rlike(rf"^(?:{EITHER})\.?$"), "given").otherwise("given_m")
    role = F.when(F.col("word") == 0, "title").when(F.col("word") == F.size("words") - 1, "surname").otherwise(given)
    units = units.withColumn("kind", F.when(F.col("kind") == "person", role).otherwise(F.col("kind")))
    units = scratch.table(units.withColumn("canon", canonical(F.col("kind"), F.col("surface"))).drop("words"), "units")
    entities = scratch.table(units.where("kind <> 'title'").select("kind", "canon").distinct(), "entities")
    made = settled(entities, scratch, key)
    new = F.when(F.col("made").isNull(), F.col("surface")).otherwise(rendered(F.col("surface"), F.col("canon"), F.col("made"), F.col("kind")))
    is_name = F.col("kind").isin("surname", "given", "given_f", "given_m")
    spelt = units.join(made.hint("merge"), ["kind", "canon"], "left").select("row", "pos", "word", new.alias("new"), F.when(is_name, F.col("surface")).alias("name"))
    # the matches of one document come together, which its text bounds
    spelt = spelt.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "new", "name"))).alias("new"))
    both = hits.join(spelt.hint("merge"), "row")
    of_match = lambda p: F.array_join(F.transform(F.filter("new", lambda u: u["pos"] == p), lambda u: u["new"]), " ")
    matches = F.transform(F.sequence(F.lit(0), F.size("found") - 1), of_match)
    # a name's first role in the document stands for its bare mentions
    own = F.filter("new", lambda u: u["name"].isNotNull())
    first = F.filter(own, lambda u, i: ~F.exists(F.slice(own, F.lit(1), i), lambda v: v["name"] == u["name"]))
    bare = F.map_from_entries(F.transform(first, lambda u: F.struct(u["name"], u["new"])))
    between = F.split(F.col("whole.text"), ANY)
    between = F.when(F.size(own) > 0, F.transform(between, lambda p: spread_names(p, bare))).otherwise(between)
    text = F.array_join(F.zip_with(between, matches, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = both.select(*told(text, F.size("found")))
    return changed.union(marked.where(F.size("found") == 0).select(*told(F.col("whole.text"), F.lit(0))))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities for every row of ``documents``."""
    return replace(documents(spark, sf_dir).select("doc_id", "text"), spark, QUERY_KEY)
