"""Column functions on text and identifiers; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character reference of HTML: decimal, hexadecimal, or up to 32 characters of a name.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that may also stand without a semicolon are at most this long: they count where they begin a longer word.
SHORT_NAME = max(len(n) for n in html5 if not n.endswith(";"))
#: Numbers 128 to 159 mean the characters of Windows-1252, by the standard; five of them have none there and stay.
WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))
#: Who speaks, what shows use, and phrases that show it alone.
FIRST_PERSON = "i|we|i've|we've|i'd|we'd|i'm|we're"
USAGE_VERBS = (
    "use|used|using|tried|try|tested|test|ran|run|asked|ask|prompted|prompt|switched|migrated|deployed|deploy|integrated|integrate|built|build|"
    "paid|subscribed|cancelled|canceled|found|find|got|get|see|saw"
)
FIRSTHAND_PHRASES = (
    "in production|my workflow|our workflow|our team|my app|our app|my experience|from experience|for me|for us|in our tests|in my tests|"
    "we use|we used|i use|i used|i tried|we tried|i tested|we tested|been using|have been using|daily driver"
)
#: Beginnings of lines of an issue template, and of titles that say nothing.
TEMPLATE_LINES = ("### ", "## ", "task:", "[task]", "- [ ]", "- [x]", "steps to reproduce", "expected behavior", "actual behavior", "environment", "additional context", "checklist")
LOW_SIGNAL_TITLES = ("[task]", "task-", "chore:", "docs:", "bump ", "release ")
_IN, _OUT = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: Words of any script, written out so that every engine reads them alike.
FIRSTHAND = (
    f"(?:^|{_OUT})(?:{FIRSTHAND_PHRASES})(?:$|{_OUT})|"
    f"(?:^|{_OUT})(?:{FIRST_PERSON})(?:{_OUT}+{_IN}+){{0,8}}?{_OUT}+(?:{USAGE_VERBS})(?:$|{_OUT})"
)


def nz(c: Column | str) -> Column:
    """Null for missing or blank: the one place where both are made equal."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def _numbered(n: Column) -> Column:
    """The character of a number in a reference: none for control characters and the like, U+FFFD where there is no such character."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    control = ((n < 32) & ~n.isin(9, 10, 12, 13)) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(n == 13, "\r").when(n.between(128, 159), F.substring(F.lit(WINDOWS), (n - 127).cast("int"), 1)).when(control, "").otherwise(char)
    )


def _entity(e: Column) -> Column:
    """What one reference stands for; an unknown name stays as it is."""
    table = F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in html5.items())), F.lit("\x01"), F.lit("\x02"))
    digits = F.regexp_replace(e, r"^&#[xX]?0*|;$", "")
    # A number of more than nine digits is no character; the rest fits.
    number = F.when(F.length(digits) > 9, F.lit(0x110000).cast("long")).when(digits == "", F.lit(0).cast("long")).otherwise(F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
    name = F.substring(e, 2, 40)
    begun = [F.concat(F.try_element_at(table, F.left(name, F.lit(k))), F.substring(name, k + 1, 40)) for k in range(SHORT_NAME, 1, -1)]
    return F.when(e.startswith("&#"), _numbered(number)).otherwise(F.coalesce(F.try_element_at(table, name), *begun, e))


def unescape(c: Column) -> Column:
    """All named and numeric references, once each, by the standard table; texts without ``&`` are not searched."""
    parts = F.zip_with(F.split(c, ENTITY, -1), F.transform(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), _entity), lambda gap, e: F.concat(gap, F.coalesce(e, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)


def strip_html(c: Column) -> Column:
    """Tags become spaces, then references are unescaped."""
    return unescape(F.regexp_replace(c, "<[^>]+>", " "))


def normalize(c: Column) -> Column:
    """Without tags, white space collapsed, trimmed; null is empty."""
    return F.trim(F.regexp_replace(strip_html(F.coalesce(c, F.lit(""))), r"(?U)[\s\x1C-\x1F]+", " "))


def hash_identifier(c: Column, salt: str) -> Column:
    return F.when(nz(c.cast("string")).isNotNull(), F.substring(F.sha2(F.concat(F.lit(salt + ":"), c.cast("string")), 256), 1, 24))


def fingerprint(c: Column) -> Column:
    """Equal for texts that differ in case and white space only."""
    return F.sha2(F.lower(normalize(c)), 256)


def without_urls(c: Column) -> Column:
    return normalize(F.regexp_replace(F.coalesce(c, F.lit("")), r"https?://\S+", " "))


def starts_with(c: Column, beginnings: Sequence[str]) -> Column:
    out = F.lit(False)
    for b in beginnings:
        out = out | c.startswith(b)
    return out


def markdown_cleanup(c: Column, keep: str = "(?!)") -> Column:
    """Lines without comments, code fences, checkboxes, and without headings and template lines unless they match ``keep``."""
    text = F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", " "), "(?s)```.*?```", " ")
    dull = lambda s: s.rlike(r"^#{1,6}\s") | starts_with(F.lower(s), TEMPLATE_LINES)
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(r"^[-*]\s+\[[ xX]\]\s") & (~dull(s) | s.rlike(keep)))
    return F.array_join(lines, "\n")


def cleaned(platform: Column, body: Column, keep: str = "(?!)", issues: str = "issues", forum: str = "forum") -> Column:
    """The body as its platform wants it: template lines dropped, or addresses dropped; always normalized."""
    body = F.coalesce(body, F.lit(""))
    return F.when(platform == issues, normalize(markdown_cleanup(body, keep))).when(platform == forum, without_urls(body)).otherwise(normalize(body))


def low_signal_title(c: Column) -> Column:
    return starts_with(F.lower(normalize(c)), LOW_SIGNAL_TITLES)


def is_firsthand(c: Column) -> Column:
    """A phrase of experience, or a first person followed within eight words by a verb of use."""
    return F.coalesce(F.lower(c).rlike(FIRSTHAND), F.lit(False))


def doubled_text(evidence: Column, context: Column, metadata: Column) -> Column:
    """The evidence twice, then context and metadata; empty parts are left out."""
    return F.concat_ws("\n", nz(evidence), nz(evidence), nz(context), nz(metadata))


def metadata_text(**fields: Column) -> Column:
    """name=value of the fields that have one, lower-cased, by spaces."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.lower(nz(v.cast("string")))) for k, v in fields.items()])


def label_value(c: Column) -> Column:
    """A label as text: true and false for booleans."""
    return c.cast("string")


def garbled(c: Column) -> Column:
    """CJK in a short text, or mostly non-ASCII letters in a very short one."""
    tokens = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != ""))
    letters, other = F.length(F.regexp_replace(c, r"\P{L}", "")), F.length(F.regexp_replace(F.regexp_replace(c, r"\P{L}", ""), r"[A-Za-z]", ""))
    return (c.rlike(r"[一-鿿]") & (tokens < 40)) | ((F.coalesce(F.try_divide(other, letters), F.lit(0.0)) > 0.55) & (tokens < 30))


def sentences(c: Column) -> Column:
    """Trimmed, non-empty sentences: cut after . ! ? before white space, and at line ends."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")  # bare F.trim would take the place for its second argument


def window_of(s: Column, i: Column) -> Column:
    """The sentence at 1-based place ``i`` with its neighbours."""
    return F.array_join(F.slice(s, F.greatest(i - 1, F.lit(1)), F.when(i == 1, 2).otherwise(3)), " ")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))


def exactly_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def strict_int(c: Column) -> Column:
    """0 unless the text is an integer."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("int")).otherwise(0)


def loose_int(c: Column) -> Column:
    """0 unless the text is a number; its integer part."""
    return F.coalesce(F.trim(c).try_cast("double").try_cast("int"), F.lit(0))


def in_domain(c: Column, domain: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*domain), c).otherwise(default)


def model_text(evidence: Column, context: Column, **fields: Column) -> Column:
    """Non-empty parts joined by line ends; fields as name=value."""
    return F.concat_ws("\n", nz(evidence), nz(context), *[F.concat(F.lit(f"{k}="), nz(v.cast("string"))) for k, v in fields.items()])


def trimmed_span(s: Column, preface: Callable[[Column], Column], question: Callable[[Column], Column]) -> Column:
    """Sentences without those at the start that are a preface, then without questions at both ends while more than one is left; null stays null."""
    s = after_preface(s, first_true(F.transform(s, lambda x: ~preface(x))))
    return between_questions(s, F.transform(s, lambda x: ~question(x)))


def first_true(a: Column) -> Column:
    """The 1-based place of the first true value, 0 if there is none."""
    return F.array_position(a, True).cast("int")


def after_preface(s: Column, kept: Column) -> Column:
    """Sentences from the place ``kept`` on, none if that is 0; null stays null."""
    return F.when(kept > 0, F.slice(s, F.greatest(kept, F.lit(1)), F.greatest(F.size(s), F.lit(0)))).when(s.isNotNull(), F.slice(s, 1, 0))


def between_questions(s: Column, plain: Column) -> Column:
    """Sentences from the first to the last that is ``plain``, as long as more than one is left; if none is, the last one stays."""
    size, first = F.size(s), first_true(plain)
    last = size + 1 - first_true(F.reverse(plain))
    return F.when(size < 2, s).when(first > 0, F.slice(s, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0)))).otherwise(F.slice(s, -1, 1))
