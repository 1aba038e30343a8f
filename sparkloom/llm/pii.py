"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern. Each gets a keyed surrogate of its own type:

* numbers, keys and addresses keep their format: characters are shifted within
  their class (digits, hexadecimal letters, capitals, small letters) by a keyed
  Feistel network over the two halves, which is a bijection, so different
  entities of a format stay different. Card numbers keep whether their check
  digit is right, internet addresses stay in range, phone numbers keep their
  country code, and mail stays in reserved domains;
* names after a title keep title, script and capitals; a given name is drawn
  from those of the title's gender. Later mentions of the surname in the same
  text, whatever their case and with a possessive or in a compound, follow; what
  stands before the first titled mention is left alone. All replacements are
  made in the pieces of the original text, so none meets another's surrogate.

Equal entities get equal surrogates everywhere, as they depend on the key and
the entity alone. Names are made of units, whatever the title: a surname, which
Mr. Smith, Dr. SMITH and Mr. John Smith share and so change alike, and a given
name of one gender before one surname; any other entity is a unit as a whole. A
corpus-wide check holds that the surrogates of all surnames differ, as do those
of the given names before one surname and those of the other entities, case
aside; and that no surrogate is itself a surname of the corpus, a given name
before that surname, or an entity of the corpus. Units that fail are drawn again
until none is left, by the attempt in their key. Names get longer with each
attempt, so there are enough of them. Mail keeps its format for ``MAIL_KEEPS``
attempts and then gets a longer local part, as a large corpus holds every short
one of a reserved domain. The other types keep their format; where the corpus
itself fills one, so that an entity still collides after many attempts, an error
names it.

Runs and groups of the patterns are possessive, and begin where a run begins, so
no text, whatever its length, exhausts the stack or takes quadratic time, and no
key, host or local part is too long to be found.

The main path scans texts twice, shuffles distinct entities only, and replaces
inside the row. Repeatedly drawn entities, normally none, are joined back by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored, unused

_FEMALE, _MALE, _EITHER = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Señorita|Г-жа", "Mr|Herr|Monsieur|Señor|Sr|Г-н", "Dr|Prof"
#: A capitalised word of two letters or more, with inner hyphens and apostrophes; a possessive isn't part of it.
_NAME = r"\p{Lu}(?=\p{L}|['’\-]\p{L}{2})\p{L}*+(?:(?:-|['’](?![sS](?!\p{L})))\p{L}++){0,9}+"
#: Type and pattern; of several at one place the first wins.
TYPES = (
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^\-]++|-(?!----(?:BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"),
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9][A-Za-z0-9\-]*+(?:\.[A-Za-z0-9][A-Za-z0-9\-]*+)++"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-+/=.]{8,}"),
    ("access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b"),
    ("hex_key", r"\b(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}+\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("card", r"\b[0-9]{13,19}\b|\b[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}\b"),
    ("phone", r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}\b|(?:\([0-9]{3}\) ?|\b[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}\b"),
    ("ipv4", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("name", rf"(?<!\p{{L}})(?:{_FEMALE}|{_MALE}|{_EITHER})\.?\s{_NAME}(?:\s{_NAME})?"),
)
#: A text without any of these has no entity: each type's pattern needs one of them.
_HINT = rf"[0-9]{{3}}|[0-9]\.[0-9]|\+[0-9]|[A-Z]{{2}}[0-9]{{2}}|@|[=:]|PRIVATE KEY|AKIA|ASIA|gh[pousr]_|sk-|[0-9a-fA-F]{{32}}|(?<!\p{{L}})(?:{_FEMALE}|{_MALE}|{_EITHER})\.?\s"
PATTERN = "|".join(f"(?:{p})" for _, p in TYPES)

#: Names for surrogates, by script and gender.
GIVEN = {
    ("latin", "f"): "Alma Berta Clara Dora Edith Flora Greta Helga Irene Julia Karla Lena Marta Nora Olga Paula".split(),
    ("latin", "m"): "Anton Bruno Conrad David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oskar Paul".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Жанна Зоя Ирина Лидия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Лев".split(),
}
SURNAME = {
    "latin": ("Al Bar Cor Dal Es Far Gold Har Ing Jan Kel Lin Mar Nor Os Pel Quin Ros Stan Tol Ul Ver Wen Zell".split(), "a bach berg dale er feld holm in land man ner o ow quist son stein ton ville win wood".split()),
    "cyrillic": ("Ал Бар Вол Гор Дан Ерм Зим Кар Лес Мор Ник Ор".split(), "ов ин ский енко ук ев ак ич".split()),
}

#: Attempts in which mail keeps its format.
MAIL_KEEPS = 4


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def entity_type(e: Column) -> Column:
    return F.coalesce(*[F.when(e.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in TYPES], F.lit("secret"))


def _number(text: Column, at: int = 1) -> Column:
    """A keyed number below 2**48."""
    return F.conv(F.substring(F.sha2(text, 256), at, 12), 16, 10).cast("long")


def _shift(part: Column, stream: Column, hexadecimal: bool) -> Column:
    """``part`` with every character shifted in its class by the bytes of ``stream`` (64 hexadecimal digits)."""
    letters = 6 if hexadecimal else 26

    def with_stream(digits: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            k = F.conv(F.substring(digits, 2 * F.pmod(i, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int") + i

            def turned(first: int, count: int) -> Column:
                return F.chr((F.lit(first) + F.pmod(F.ascii(c) - first + k, F.lit(count))).cast("long"))

            return (
                F.when(c.rlike("[0-9]"), turned(48, 10))
                .when(c.rlike("[a-f]" if hexadecimal else "[a-z]"), turned(97, letters))
                .when(c.rlike("[A-F]" if hexadecimal else "[A-Z]"), turned(65, letters))
                .otherwise(c)
            )

        return F.array_join(F.transform(_chars(part), one), "")

    return _let(stream, with_stream)


def scrambled(e: Column, key: Column, hexadecimal: bool = False, rounds: int = 4) -> Column:
    """Keyed bijection on the strings of one format: each round shifts one half by the other. ``rounds`` is even."""
    half = F.ceil(F.length(e) / 2).cast("int")
    start = F.struct(F.substring(e, F.lit(1), half).alias("a"), F.substring(e, half + 1, F.length(e)).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s["b"].alias("a"), _shift(s["a"], F.sha2(F.concat_ws("|", key, i.cast("string"), s["b"]), 256), hexadecimal).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _luhn_digit(digits: Column) -> Column:
    """The check digit that belongs behind ``digits``."""
    doubled = lambda c: F.floor(c * 2 / 10) + (c * 2) % 10
    parts = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("long"))).otherwise(c.cast("long")))
    return F.pmod(10 - F.pmod(F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(10)), F.lit(10))


def _card(e: Column, key: Column) -> Column:
    plain = lambda x: F.regexp_replace(x, "[^0-9]", "")
    body = F.substring(e, F.lit(1), F.length(e) - 1)
    offset = F.substring(e, F.length(e), F.lit(1)).cast("long") - _luhn_digit(plain(body))
    return _let(scrambled(body, key), lambda new: F.concat(new, F.pmod(_luhn_digit(plain(new)) + offset, F.lit(10)).cast("string")))


def _ipv4(e: Column, key: Column) -> Column:
    part = lambda i: F.get(F.split(e, r"\."), F.lit(i)).cast("long")
    start = F.struct((part(0) * 256 + part(1)).alias("a"), (part(2) * 256 + part(3)).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _number(F.concat_ws("|", key, i.cast("string"), s["b"].cast("string"))), F.lit(65536)).alias("b"))

    def written(s: Column) -> Column:
        return F.concat_ws(".", *[x.cast("long").cast("string") for v in (s["a"], s["b"]) for x in (F.floor(v / 256), F.pmod(v, F.lit(256)))])

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn, written)


def _email(e: Column, key: Column, attempt: Column) -> Column:
    more = F.when(attempt >= MAIL_KEEPS, F.concat(F.lit("."), F.substring(F.sha2(F.concat_ws("|", key, e), 256), 1, 8))).otherwise("")

    def at(domain: Column) -> Column:
        kept = domain.rlike(r"(^|\.)example\.(com|net|org)$|\.(test|example|invalid)$")
        home = F.when(kept, domain).otherwise(F.concat(scrambled(F.regexp_replace(domain, r"\.", "-"), key), F.lit(".example.com")))
        return F.concat(scrambled(F.substring_index(e, "@", 1), F.concat_ws("|", key, domain)), more, F.lit("@"), home)

    return _let(F.lower(F.substring_index(e, "@", -1)), at)


def _after(e: Column, head: str, change) -> Column:
    """``e`` with what follows the match of ``head`` changed."""
    return _let(F.regexp_extract(e, head, 0), lambda h: F.concat(h, _let(F.substring(e, F.length(h) + 1, F.length(e)), change)))


def _pick(names, number: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(names)), " "), F.pmod(number, F.lit(len(names))).cast("int"))


def _by_script(word: Column, make) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), make("cyrillic")).otherwise(make("latin"))


def _longer(base: Column, attempt: Column, more) -> Column:
    """``more`` of the keys of the second to the last attempt, joined."""
    return F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.concat(F.lit("-"), more(F.concat_ws("|", base, i.cast("string"))))), "")).otherwise("")


def _cased(new: Column, word: Column) -> Column:
    return _let(new, lambda n: F.when(word == F.upper(word), F.upper(n)).otherwise(n))


def _surname(word: Column, key: Column, attempt: Column) -> Column:
    one = lambda k: _by_script(word, lambda s: F.concat(_pick(SURNAME[s][0], _number(k)), _pick(SURNAME[s][1], _number(k, 13))))
    base = F.concat_ws("|", key, F.lower(word))
    return _cased(F.concat(one(base), _longer(base, attempt, one)), word)


def _given(word: Column, female: Column, key: Column, attempt: Column) -> Column:
    one = lambda k: _let(_number(k), lambda n: _by_script(word, lambda s: F.when(female, _pick(GIVEN[s, "f"], n)).otherwise(_pick(GIVEN[s, "m"], n))))
    base = F.concat_ws("|", key, F.lower(word))
    return _cased(F.concat(one(base), _longer(base, attempt, one)), word)


def _name_words(e: Column) -> Column:
    return F.split(F.regexp_replace(e, rf"^(?:{_FEMALE}|{_MALE}|{_EITHER})\.?\s", ""), r"\s")


def _is_name(e: Column) -> Column:
    return e.rlike(rf"^(?:{_FEMALE}|{_MALE}|{_EITHER})\.?\s{_NAME}(?:\s{_NAME})?$")


def _is_female(e: Column, first: Column) -> Column:
    """By the title, or where it says nothing by the given name's ending."""
    return e.rlike(rf"^(?:{_FEMALE})\.?\s") | (~e.rlike(rf"^(?:{_MALE})\.?\s") & first.rlike("[aAаАяЯ]$"))


def units(e: Column) -> Column:
    """What ``e`` is made of and drawn again by: its surname and its given name (or null), or the entity and null."""

    def of_words(words: Column) -> Column:
        surname, first = F.lower(F.element_at(words, -1)), F.get(words, F.lit(0))
        given = F.concat(F.lit("g|"), surname, F.lit("|"), F.when(_is_female(e, first), "f").otherwise("m"), F.lit("|"), F.lower(first))
        return F.array(F.concat(F.lit("s|"), surname), F.when(F.size(words) > 1, given))

    return F.when(_is_name(e), _let(_name_words(e), of_words)).otherwise(F.array(F.concat(F.lit("e|"), e), F.lit(None).cast("string")))


def _name(e: Column, key: Column, attempt: Column, given_attempt: Column) -> Column:
    title, between = F.regexp_extract(e, r"^\S+\s", 0), F.regexp_extract(e, r"^\S+\s\S+(\s)", 1)

    def of_words(words: Column) -> Column:
        first = F.get(words, F.lit(0))
        given = F.when(F.size(words) > 1, F.concat(_given(first, _is_female(e, first), key, given_attempt), between)).otherwise("")
        return F.concat(title, given, _surname(F.element_at(words, -1), key, attempt))

    return _let(_name_words(e), of_words)


def surrogate(entity: Column, key: str, attempt: Column, given_attempt: Column | None = None) -> Column:
    """The surrogate of ``entity`` at the given attempts of its units."""

    def of(s: Column) -> Column:
        e, kind, k = s["e"], s["kind"], F.concat_ws("|", F.lit(key), s["kind"], s["attempt"].cast("string"))
        key_of = lambda x: F.when(x.rlike("^[0-9a-fA-F]+$"), scrambled(x, k, hexadecimal=True)).otherwise(scrambled(x, k))
        whole = F.concat(F.regexp_extract(e, r"^-----BEGIN [A-Z ]*-----", 0), F.lit("\n"), F.sha2(F.concat_ws("|", k, e), 512), F.lit("\n"), F.regexp_extract(e, r"-----END [A-Z ]*-----$", 0))
        return (
            F.when(kind == "email", _email(e, k, s["attempt"]))
            .when(kind == "card", _card(e, k))
            .when(kind == "phone", _after(e, r"^(\+[0-9]{1,3}(?=[ .\-(]))?", lambda x: scrambled(x, k)))
            .when(kind == "ipv4", _ipv4(e, k))
            .when(kind == "name", _name(e, F.lit(f"{key}|name"), s["attempt"], s["given"]))
            .when(kind.isin("hex_key", "ipv6"), scrambled(e, k, hexadecimal=True))
            .when(kind == "access_key", _after(e, r"^(AKIA|ASIA|gh[pousr]_|sk-)", lambda x: scrambled(x, k)))
            .when(kind == "iban", _after(e, r"^[A-Z]{2}", lambda x: scrambled(x, k)))
            .when(kind == "private_key", whole)
            .when(kind == "secret", _after(e, r"^[^=:]*[=:]\s{0,3}[\"']?", key_of))
            .otherwise(scrambled(e, k))
        )

    given = F.lit(0) if given_attempt is None else given_attempt
    return _let(F.struct(entity.alias("e"), entity_type(entity).alias("kind"), attempt.alias("attempt"), given.alias("given")), of)


def found_entities(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), 0))


def _drawn(units_: DataFrame, key: str) -> DataFrame:
    """``units_(unit, attempt)`` with its surrogate as new, the place within which that is to be its own, and what it stands for as old; case aside."""
    unit, attempt = F.col("unit"), F.col("attempt")
    kind, rest = F.substring(unit, 1, 1), F.substring(unit, 3, 1 << 30)
    part = lambda i: F.get(F.split(unit, r"\|"), F.lit(i))
    surname = F.lower(_surname(rest, F.lit(f"{key}|name"), attempt))
    given = F.lower(_given(part(3), part(2) == "f", F.lit(f"{key}|name"), attempt))
    return units_.select(
        "unit", "attempt", F.when(kind == "s", surname).when(kind == "g", given).otherwise(surrogate(rest, key, attempt)).alias("new"),
        F.when(kind == "g", F.concat(F.lit("g|"), part(1))).otherwise(kind).alias("place"), F.when(kind == "g", part(3)).otherwise(rest).alias("old"),
    )


def drawn_again(docs: DataFrame, key: str, text_col: str, most: int = 100) -> DataFrame:
    """(unit, attempt): the units whose first surrogate isn't their own, with an attempt that is; an error if ``most`` attempts don't give all of them one."""
    entities = docs.select(F.explode(found_entities(F.col(text_col))).alias("entity")).distinct()
    own = stored(entities.select(F.explode(units(F.col("entity"))).alias("unit")).where("unit is not null").distinct())
    drawn = stored(_drawn(own.withColumn("attempt", F.lit(0)), key))
    real = drawn.select("place", F.col("old").alias("new"))
    for tried in range(most + 1):
        taken = drawn.join(real, ["place", "new"], "left_semi").select("unit", "attempt")
        kept = drawn.groupBy("place", "new").agg(F.min("unit").alias("keeps"), F.count("*").alias("n")).where("n > 1")
        shared = drawn.join(kept, ["place", "new"]).where("unit <> keeps").select("unit", "attempt")
        bad = stored(taken.unionByName(shared).distinct())
        if bad.isEmpty():
            break
        if tried == most:
            kind = F.when(F.col("unit").startswith("e|"), entity_type(F.substring("unit", 3, 1 << 30))).otherwise("name")
            kinds = sorted(r[0] for r in bad.select(kind).distinct().collect())
            raise ValueError(f"no surrogates of their own for some entities after {most} attempts: {', '.join(kinds)}")
        anew = _drawn(bad.withColumn("attempt", F.col("attempt") + 1), key)
        drawn = stored(drawn.join(bad.select("unit"), "unit", "left_anti").unionByName(anew))
    return drawn.where("attempt > 0").select("unit", "attempt")


#: Words with their inner marks, and what is between them; and the same without inner marks.
_TOKENS, _PARTS = r"\p{L}[\p{L}'’\-]*+|[^\p{L}]++", r"\p{L}++|[^\p{L}]++"


def _mentions(piece: Column, known: Column) -> Column:
    """``piece`` of a text with the surnames of ``known(old, new)`` replaced, whatever their case: whole words, without a possessive, or parts of a compound."""

    def new_of(word: Column) -> Column:
        hit = F.get(F.filter(known, lambda n: n["old"] == F.lower(word)), F.lit(0))["new"]
        return F.when(word == F.lower(word), F.lower(hit)).when(word == F.upper(word), F.upper(hit)).otherwise(hit)

    def one(token: Column) -> Column:
        stem = F.regexp_replace(token, r"['’][sS]?$", "")
        whole = F.concat(new_of(stem), F.substring(token, F.length(stem) + 1, F.length(token)))
        parts = F.array_join(F.transform(F.regexp_extract_all(token, F.lit(_PARTS), 0), lambda p: F.coalesce(new_of(p), p)), "")
        return F.when(token.rlike(r"^\p{L}"), F.coalesce(new_of(token), whole, parts)).otherwise(token)

    near = F.exists(known, lambda n: F.contains(F.lower(piece), n["old"]))
    return F.when(near, F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(_TOKENS), 0), one), "")).otherwise(piece)


def replaced(text: Column, attempts: Column | None, key: str) -> Column:
    """``text`` with surrogates, each made once; ``attempts`` maps units to attempts over 0, or is null."""
    tried = lambda u: F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, u), F.lit(0))

    def of(e: Column) -> Column:
        def of_units(u: Column) -> Column:
            surname = F.when(F.get(u, F.lit(0)).startswith("s|"), F.substring(F.get(u, F.lit(0)), 3, 1 << 30))
            new = F.when(surname.isNotNull(), _surname(surname, F.lit(f"{key}|name"), tried(F.get(u, F.lit(0)))))
            return F.struct(surrogate(e, key, tried(F.get(u, F.lit(0))), tried(F.get(u, F.lit(1)))).alias("s"), surname.alias("old"), new.alias("new"))

        return _let(units(e), of_units)

    def changed(pairs: Column) -> Column:
        placed = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p["old"].alias("old"), p["new"].alias("new"))), lambda n: n["old"].isNotNull())
        plain = F.zip_with(F.split(text, PATTERN, -1), pairs, lambda p, x: F.concat(F.coalesce(p, F.lit("")), F.coalesce(x["s"], F.lit(""))))

        def with_names(names: Column) -> Column:
            said = F.transform(F.split(text, PATTERN, -1), lambda p, i: _mentions(p, F.filter(names, lambda n: n["at"] < i)))
            return F.zip_with(said, pairs, lambda p, x: F.concat(F.coalesce(p, F.lit("")), F.coalesce(x["s"], F.lit(""))))

        first = F.filter(placed, lambda n, j: F.array_position(F.transform(placed, lambda m: m["old"]), n["old"]) == j + 1)
        pieces = F.when(F.size(placed) > 0, _let(first, with_names)).otherwise(plain)
        return F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, text).otherwise(F.array_join(pieces, ""))

    return _let(F.transform(found_entities(text), of), changed)


def with_surrogates(docs: DataFrame, key: str = "surrogates", text_col: str = "text") -> DataFrame:
    """``docs``, all columns kept whatever their names, with the entities of ``text_col`` replaced.

    Null and empty texts, and texts without entities, stay as they are. Texts
    of any length are scanned in whole. Repeated rows stay and change alike. An
    empty table gives an empty result. Different surnames never become one, in
    one text or in several, and one surname never becomes two.
    """
    again = drawn_again(docs, key, text_col)
    if again.isEmpty():
        return docs.withColumn(text_col, replaced(F.col(text_col), None, key))
    digest, own, attempts = unused(docs, "digest", "own_digest", "attempts")
    found = docs.select(F.md5(F.col(text_col)).alias(own), found_entities(F.col(text_col)).alias("entities")).where(F.size("entities") > 0)
    each = found.select(own, F.explode(F.array_distinct(F.flatten(F.transform("entities", units)))).alias("unit")).where("unit is not null").distinct()
    hit = each.join(again, "unit").groupBy(own).agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias(attempts))
    joined = docs.withColumn(digest, F.md5(F.col(text_col))).join(hit, F.col(digest) == F.col(own), "left")
    return joined.withColumn(text_col, replaced(F.col(text_col), F.col(attempts), key)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_surrogates(docs)
