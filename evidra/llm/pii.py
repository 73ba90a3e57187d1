r"""Private data: detected entities get keyed surrogates of their own type and format.

Built-in functions only.  Regular expressions find e-mail addresses, phone
numbers, IP addresses of both versions, account and card numbers, access tokens,
social security and bank account numbers, and names after an honorific or an
academic title.  A text is searched once; what is found is staged with the
pieces between, and the text is put together again from these.  The
surrogate of an entity is made from a keyed SHA-512 of (type, normal form,
attempt), character by character from the end: digits become digits, letters
become letters of the same case, everything else stays, so length and
punctuation are kept; in secrets signs become signs.  Entities of more than 256
characters are made in blocks, each with a stream of its own, in linear time.  Names come from lists by gender (from the honorific)
and script.  Card numbers that pass the Luhn test get a surrogate that passes.

Coreference: the surrogate depends on the normal form alone (lower case,
digits only), so an entity gets the same one in every document and spelling.
A name is two entities, given and family name, so ``Mr. John Smith`` and
``Mr. Smith`` keep one family name, and different given names stay different.
Distinctness: all distinct entities of the corpus are gathered (pre-aggregated,
so frequent ones cost nothing), and those whose surrogate is taken by another
entity, or is itself an entity of the corpus, get the next attempt until none
is left.  Later attempts have more room: names get a second family name, then one
more syllable an attempt; mail addresses, tokens, secrets and types of the caller's
patterns one more character from the fifth attempt on, and addresses with
colons become whole ones of eight groups, so that short ones do not run out.  Only texts with such an entity are joined with its attempt.

Nulls: a null text stays null and has no entities.  Empty texts stay empty.
Repeated rows get equal texts.  An empty table gives no rows.  Extra columns
are kept, unless they clash with ``n_pii`` and ``pii_types``, which replace
them; columns that start with ``_pii`` are not allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Honorifics that tell a gender, and titles that do not.
MALE_TITLES, FEMALE_TITLES = "Mr|Mister|Herr|Monsieur|Señor|Господин", "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Госпожа"
TITLES = "Dr|Prof|Doctor|Professor|Doktor|Docteur|Professeur|Profesor|Profesora|Доктор|Профессор"
_TITLE = rf"\b(?:{MALE_TITLES}|{FEMALE_TITLES}|{TITLES})\b"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Type: pattern. An earlier one wins where two could start.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]{1,63}\.){1,126}\p{L}{2,63}",
    "token": r"\b(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|(?:ghp|gho|xoxb|sk)[-_][A-Za-z0-9_-]{16,})\b",
    "secret": r"(?<=[=:\"' ])(?<=\b(?i:password|passwd|pwd|secret|api[_-]?key|access_token)[\"']? ?[=:] ?[\"']?)[^\s\"',;]{6,}+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)|(?<![\w:])(?=[\p{{XDigit}}:]*\d)(?:(?:\p{{XDigit}}{{1,4}}:){{7}}\p{{XDigit}}{{1,4}}|(?=(?:\p{{XDigit}}{{4}}|64:ff9b):)(?=\p{{XDigit}}*[A-Fa-f]|\p{{XDigit}}+:\p{{XDigit}})(?:\p{{XDigit}}{{1,4}}:){{1,6}}(?::\p{{XDigit}}{{1,4}}){{1,6}})(?![\w:])",
    "phone": r"(?:\+\d{1,3}[^\w\n]{1,6}\d{3}[^\w\n]{1,6}\d{3}[^\w\n]{1,6}\d{4}|\(\d{3}\)[^\w\n]{0,6}\d{3}[^\w\n]{1,6}\d{4}|\+\d(?:[ .()/-]{0,3}\d){7,14}"
    # National: 555-123-4567, 06 12 34 56 78, 030 1234567, 8 (495) 123-45-67, 612 345 678.
    r"|(?<![\d.,+-])(?:\d{3}[-. ]\d{3}[-. ]\d{4}|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{5,8}|8[ -]?\(?\d{3}\)?[ -]?\d{3}-\d{2}-\d{2}|[67]\d{2}[ -]\d{3}[ -]\d{3}))(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "number": r"(?<![\d.])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)",
    "name": rf"(?:{_TITLE}\.? )+\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?:-\p{{Lu}}\p{{Ll}}+)?",
}
#: Types whose surrogates never get longer: they have more surrogates than there can be entities, or another way.
FIXED_LENGTH = ("phone", "iban", "ip", "ssn", "number", "name", "given")
#: Most texts hold nothing that could start an entity; this is all that is tried on them.
HINT = r"\d{3}|\+\d|\d\d[ .-]\d\d|[=:](?<=(?i:password|passwd|pwd|secret|key|token)[\"']? ?[=:])|\d\.\d|@|\d[A-Fa-f]|[A-Fa-f]\d|[\dA-Fa-f]::?[\dA-Fa-f]|AKIA|gh[po][-_]|xoxb|sk[-_]|" + _TITLE
#: Fixed lists of names, by gender and script.
MALE, FEMALE = "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Karim Louis Marco Nils Oscar Paul", "Alice Berta Clara Diana Emma Fiona Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula"
FAMILY = "Abel Bauer Costa Dubois Ebner Fischer Garcia Hansen Ivers Jansen Keller Lopez Moreau Novak Olsen Perrin"
MALE_CYRILLIC, FEMALE_CYRILLIC, FAMILY_CYRILLIC = "Антон Борис Виктор Глеб Денис Егор Иван Кирилл", "Анна Вера Галина Дарья Елена Ирина Мария Ольга", "Белов Волков Громов Данилов Ершов Зимин Козлов Лебедев"
SYLLABLES, SYLLABLES_CYRILLIC = "ba be do fa ga ho ja ke la mi no pa ri so ta vu", "ба ве до жа за ки ла ми но па ри со та фу ха ча"
#: What stands for a sign of a secret.
_SIGNS = "!#$%&*+-./?@^_~"
#: Characters of an entity that share one keyed stream (its hex digits); longer ones are made block by block.
_BLOCK = 128
_PREFIX = rf"^((?:{_TITLE}\.? )+)"
_LOWER_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def _any(patterns: dict[str, str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns.values())


def kind(e: Column, patterns: dict[str, str]) -> Column:
    """The type of a match. What matches no pattern on its own was found by its context: a secret."""
    out = F.lit("secret")
    for name, p in reversed(patterns.items()):
        out = F.when(e.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def normal(e: Column, t: Column) -> Column:
    """What two spellings of one entity have in common."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(t.isin("number", "ssn"), digits).when(t == "phone", F.right(digits, F.lit(10))).when(t == "iban", F.upper(F.regexp_replace(e, " ", "")))
        .when(t == "name", F.lower(F.regexp_extract(e, r"(\S+)$", 1))).when(t == "given", F.concat(F.lower(given(e)), F.when(female(e), F.lit("|f")).otherwise(F.lit("|m")))).otherwise(F.lower(e))
    )


def given(e: Column) -> Column:
    """The given name of a match, empty where it has the family name only."""
    return F.regexp_extract(F.regexp_replace(e, _PREFIX, ""), r"^(\S+) \S+$", 1)


def female(e: Column) -> Column:
    """By the honorific; after a title alone by the end of the given name."""
    return e.rlike(rf"(?:^| )(?:{FEMALE_TITLES})\b") | (~e.rlike(rf"(?:^| )(?:{MALE_TITLES})\b") & given(e).rlike("[aа]$"))


def _byte(stream: Column, i: Column) -> Column:
    """A number from 0 to 255 of the keyed stream."""
    return F.conv(F.substr(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, v: Column) -> Column:
    return F.substr(F.lit(alphabet), v % len(alphabet) + 1, F.lit(1))


def _between(c: Column, first: str, last: str) -> Column:
    """Whether one character lies in a range of code points."""
    return (c >= first) & (c <= last)


def _mapped(e: Column, stream: Column, keep_from: Column, hexadecimal: Column, signs: Column) -> Column:
    """Each letter and digit (with ``signs`` every character) by its place from the end; those from the ``keep_from``-th on stay. Linear in the length."""
    unit = F.when(signs, F.lit("(?s).")).otherwise(F.lit(r"[\p{L}\p{N}]"))

    def step(c: Column, i: Column) -> Column:
        v = _byte(stream, i)
        return (
            F.when(i >= keep_from, c).when(_between(c, "0", "9"), (v % 10).cast("string"))
            .when(_between(c, "a", "z"), F.when(hexadecimal, _pick("abcdef", v)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", v)))
            .when(_between(c, "A", "Z"), F.when(hexadecimal, _pick("ABCDEF", v)).otherwise(_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", v)))
            .when(_between(c, "а", "я"), _pick(_LOWER_CYRILLIC, v)).when(_between(c, "А", "Я"), F.upper(_pick(_LOWER_CYRILLIC, v)))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", v)).when(c.rlike(r"[\p{L}\p{N}]"), _pick("abcdefghijklmnopqrstuvwxyz", v)).otherwise(_pick(_SIGNS, v))
        )

    new = F.reverse(F.transform(F.reverse(F.regexp_extract_all(e, unit, F.lit(0))), step))
    return F.array_join(F.zip_with(F.split(e, unit, -1), new, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def _mapped_blocks(e: Column, stream: Column, hexadecimal: Column, upper: Column, signs: Column) -> Column:
    """As `_mapped`, for entities of any length: blocks of `_BLOCK` characters with a stream for each, so that one block at a time is in pieces."""
    blocks = F.transform(F.regexp_extract_all(e, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), lambda c, i: F.struct(c.alias("c"), F.sha2(F.concat(stream, i.cast("string")), 512).alias("s")))
    digits = lambda b: F.substr(b["s"], F.lit(1), F.length(b["c"]))
    each = lambda b: F.when(hexadecimal & upper, F.upper(digits(b))).when(hexadecimal, digits(b)).otherwise(_mapped(b["c"], b["s"], F.lit(_BLOCK + 1), F.lit(False), signs))
    return F.array_join(F.transform(blocks, each), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    chars = F.transform(F.reverse(F.regexp_extract_all(digits, F.lit(r"\d"), F.lit(0))), lambda c: c.cast("int"))
    each = F.transform(chars, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10


def _names(words: str, v: Column) -> Column:
    return F.element_at(F.split(F.lit(words), " "), v % len(words.split()) + 1)


def _more(stream: Column, n: Column, of) -> Column:
    """``of`` (a number of the keyed stream) for ``n`` further places, none for n < 1."""
    return F.when(n < 1, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: of(_byte(stream, k + 5))), ""))


def with_surrogates(df: DataFrame, key: str) -> DataFrame:
    """Adds ``made``, the surrogate, to rows (e, type, norm, attempt); for a name the family name alone, for a given name that name."""
    e, t, n, stream = F.col("e"), F.col("type"), F.col("attempt"), F.col("_stream")
    # An address keeps its last label, or the whole of a reserved domain.
    tail = F.when(t == "email", F.regexp_extract(e, r"((?:(?<=[@.])example)?\.\p{L}{2,63})$", 1)).otherwise(F.lit(""))
    keep = F.when(t == "phone", 10).when(t == "iban", F.length(F.regexp_replace(e, " ", "")) - 2).otherwise(999)
    two = lambda k: _byte(stream, F.lit(k)) * 256 + _byte(stream, F.lit(k + 1))
    woman, cyrillic = female(e), F.regexp_replace(e, _PREFIX, "").rlike("[А-Яа-я]")
    hexadecimal = F.col("_hex")
    df = df.withColumns({"_stream": F.sha2(F.concat_ws("|", F.lit(key), t, "norm", n.cast("string")), 512), "_tail": tail, "_hex": (t.isin("token", "secret") & e.rlike("^[0-9a-fA-F]+$")) | (t == "ip"), "_upper": e.rlike("[A-F]")})
    body = F.substr(e, F.lit(1), F.length(e) - F.length("_tail"))
    first = lambda v: F.when(woman & cyrillic, _names(FEMALE_CYRILLIC, v)).when(cyrillic, _names(MALE_CYRILLIC, v)).when(woman, _names(FEMALE, v)).otherwise(_names(MALE, v))
    df = df.withColumns({
        "_plain": F.concat(F.when(F.length(e) > 2 * _BLOCK, _mapped_blocks(body, stream, F.col("_hex"), F.col("_upper"), t == "secret")).otherwise(_mapped(body, stream, keep, F.col("_hex"), t == "secret")), "_tail"),
        "_ip": F.concat_ws(".", *[(_byte(stream, F.lit(k)) % 254 + 1).cast("string") for k in range(4)]),
        "_given": F.concat(first(two(0)), F.when(n > 0, F.concat(F.lit("-"), first(two(4)))).otherwise(F.lit(""))),
        "_family": F.when(cyrillic, F.concat(_names(FAMILY_CYRILLIC, two(2)), F.when(woman, F.lit("а")).otherwise(F.lit("")))).otherwise(_names(FAMILY, two(2))),
        # The lists are short: later attempts add a second family name, then a syllable each.
        "_more": _more(stream, n - 1, lambda v: F.when(cyrillic, _names(SYLLABLES_CYRILLIC, v)).otherwise(_names(SYLLABLES, v))),
        "_second": F.when(n < 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.when(cyrillic, _names(FAMILY_CYRILLIC, two(4))).otherwise(_names(FAMILY, two(4))))),
        "_six": F.concat_ws(":", *[F.substr(stream, F.lit(65 + 4 * k), F.lit(4)) for k in range(8)]),
        "_longer": F.when(~t.isin(*FIXED_LENGTH), _more(stream, n - 4, lambda v: F.when(hexadecimal, _pick("abcdef", v)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", v)))).otherwise(F.lit("")),
        "_valid": F.when(t == "number", _luhn(e) == 0),
    })
    df = df.withColumn("_open", F.regexp_replace("_plain", r"\d$", ""))
    number = F.when(F.col("_valid"), F.concat("_open", ((10 - _luhn(F.concat("_open", F.lit("0")))) % 10).cast("string"))).otherwise(F.col("_plain"))
    made = F.when((t == "ip") & ~F.contains(e, F.lit(":")), F.col("_ip")).when((t == "ip") & (n > 4), F.col("_six")).when(t == "number", number).when(t == "name", F.concat("_family", "_second", "_more")).when(t == "given", F.concat("_given", "_more"))
    return df.withColumn("made", made.otherwise(F.concat("_longer", "_plain"))).drop("_stream", "_tail", "_plain", "_ip", "_given", "_family", "_second", "_more", "_six", "_hex", "_upper", "_longer", "_valid", "_open")


def found(docs: DataFrame, patterns: dict[str, str] = PATTERNS, hint: str = HINT) -> DataFrame:
    """The rows with an entity: the columns of ``docs`` but text, and _pii (entities in order), _pii_gaps (the text between them), _pii_sha."""
    parts = F.struct(F.regexp_extract_all("text", F.lit(_any(patterns)), F.lit(0)).alias("_pii"), F.split("text", _any(patterns), -1).alias("_pii_gaps"), F.sha2("text", 256).alias("_pii_sha"))
    # An inlined array is computed once: the filter on it does not repeat the patterns.
    return docs.where(F.col("text").rlike(hint)).select(*[c for c in docs.columns if c != "text"], F.inline(F.array(parts))).where(F.size("_pii") > 0)


def spellings(matches: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(e, type, norm, given): every distinct spelling of an entity in the corpus; ``given``: the normal form of a given name, or null."""
    each = matches.select(F.explode("_pii").alias("e")).groupBy("e").count().select("e", kind(F.col("e"), patterns).alias("type"))
    return each.withColumns({"norm": normal(F.col("e"), F.col("type")), "given": F.when((F.col("type") == "name") & (given(F.col("e")) != ""), normal(F.col("e"), F.lit("given")))})


def dictionary(spelled: DataFrame, key: str, rounds: int = 50, scope: str = "") -> DataFrame:
    """(e, type, norm, made): distinct entities of a type get distinct surrogates that are no entities of the corpus."""
    spelled = common.staged(spelled, "spellings", scope)
    parts = spelled.select("type", "norm", "e").unionByName(spelled.where("given is not null").select(F.lit("given").alias("type"), F.col("given").alias("norm"), "e"))
    known = parts.groupBy("type", "norm").agg(F.min("e").alias("e"), F.lit(0).alias("attempt"))
    real = known.select("type", F.col("norm").alias("made"), F.lit(True).alias("real"))
    of_made = F.when(F.col("type") == "given", F.concat(F.lower("made"), F.when(female(F.col("e")), F.lit("|f")).otherwise(F.lit("|m")))).otherwise(normal(F.col("made"), F.col("type")))
    for _ in range(rounds):
        made = with_surrogates(known, key).withColumn("made", of_made)
        made = made.withColumn("taken", F.row_number().over(Window.partitionBy("type", "made").orderBy("attempt", "norm")) > 1).join(real, ["type", "made"], "left")
        made = common.staged(made.select("type", "norm", "e", "attempt", (F.col("taken") | F.coalesce("real", F.lit(False))).alias("again")), "entities", scope)
        if made.where("again").isEmpty():
            break
        known = made.select("type", "norm", "e", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    else:
        raise ValueError(f"more entities of a type than distinct surrogates were found in {rounds} rounds")
    attempts = made.select("type", "norm", "attempt")
    whole = with_surrogates(spelled.join(attempts, ["type", "norm"]), key)
    first = with_surrogates(made.where("type = 'given'").select("type", "norm", "e", "attempt"), key).select(F.col("norm").alias("given"), F.col("made").alias("_first"))
    name = F.concat(F.regexp_extract("e", _PREFIX, 1), F.coalesce(F.concat("_first", F.lit(" ")), F.lit("")), "made")
    return whole.join(first, "given", "left").select("e", "type", "norm", F.when(F.col("type") == "name", name).otherwise(F.col("made")).alias("made"))


def replace(docs: DataFrame, key: str, patterns: dict[str, str] = PATTERNS, hint: str = HINT, scope: str = "") -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_pii and pii_types (distinct, sorted, comma-joined)."""
    docs = docs.drop("n_pii", "pii_types")
    names = docs.columns
    has = F.coalesce(F.col("text").rlike(hint) & F.col("text").rlike(_any(patterns)), F.lit(False))
    some = common.staged(found(docs, patterns, hint), "found", scope)
    known = common.staged(dictionary(spellings(some, patterns), key, scope=scope), "surrogates", scope)
    each = some.select("_pii_sha", F.explode(F.array_distinct("_pii")).alias("e")).distinct()
    maps = each.join(known.select("e", "made", "type"), "e").groupBy("_pii_sha").agg(F.map_from_entries(F.collect_list(F.struct("e", "made"))).alias("_pii_made"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("pii_types"))
    joined = F.array_join(F.zip_with("_pii_gaps", F.transform("_pii", lambda e: F.coalesce(F.col("_pii_made")[e], e)), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    new = some.join(maps, "_pii_sha", "left").select(*[joined.alias("text") if c == "text" else F.col(c) for c in names], F.size("_pii").alias("n_pii"), F.coalesce("pii_types", F.lit("")).alias("pii_types"))
    return docs.where(~has).select(*names, F.lit(0).alias("n_pii"), F.lit("").alias("pii_types")).unionByName(new)


#: A key for tables of invented text; production passes its own secret.
DEMO_KEY = "evidra-demo-key"


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(common.table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
