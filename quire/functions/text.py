"""Text functions over columns; all are JVM expressions.

White space is Unicode White_Space, written out so that it means the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space class, the line break class, list bullets and allowed link schemes.
WS = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
BREAK = r"[\n\r\u2028\u2029]"
BULLETS = "•‣◦⁃∙▪●·*+-"
SCHEMES = ("http", "https", "mailto")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(s: Column | str) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(_c(s), f"^{WS}+|{WS}+$", "")


def clean_text(s: Column | str) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(_c(s), f"{WS}+", " "))


def words(s: Column | str) -> Column:
    """Number of words."""
    return F.regexp_count(_c(s), F.lit(f"[^{WS[1:-1]}]+"))


def inner_whitespace(s: Column | str) -> Column:
    """Runs of white space become a line mark if they hold a line break, else one space; none at the ends."""
    marked = F.regexp_replace(strip(s), f"{WS}*{BREAK}{WS}*", "\x00")
    return F.replace(F.regexp_replace(marked, f"{WS}+", " "), F.lit("\x00"), F.lit("<br>\n"))


def escape_markdown(s: Column | str) -> Column:
    s = F.replace(F.replace(F.replace(_c(s), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(F.regexp_replace(s, r"([\\*_\[\]`|#!])", r"\\$1"), r"\p{Cc}", " ")


def escape_link_target(s: Column | str) -> Column:
    """Percent-encodes ASCII control characters, spaces, backslashes, parentheses and angle brackets."""
    one = lambda c: F.when(c.rlike(r"^[\x00-\x20\x7F\\()<>]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.array_join(F.transform(F.regexp_extract_all(_c(s), F.lit(r"(?s)(.)")), one), "")


def escape_html(s: Column | str, attribute: bool = False) -> Column:
    s = F.replace(F.replace(F.replace(_c(s), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    s = F.replace(F.replace(s, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;")) if attribute else s
    return F.regexp_replace(s, r"\p{Cc}", " ")


def escape_record(s: Column | str) -> Column:
    """One physical line: backslash, line feed and carriage return by letter, other control characters and line separators by number."""
    s = F.replace(F.replace(F.replace(_c(s), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    one = lambda c: F.when(c.rlike(r"^[\p{Cc}\u2028\u2029]$"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c)
    each = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"(?s)(.)")), one), "")
    return F.when(s.rlike(r"[\p{Cc}\u2028\u2029]"), each).otherwise(s)


def collapse_warning(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), r"[\r\n\t]+", " ")


def safe_comment(s: Column | str) -> Column:
    """Text that can't end a comment."""
    return F.replace(F.replace(_c(s), F.lit("--"), F.lit("- -")), F.lit(">"), F.lit("&gt;"))


def href_allowed(s: Column | str) -> Column:
    """Links without a scheme, or with an allowed one; white space and control characters in it are ignored."""
    bare = F.regexp_replace(_c(s), rf"{WS}|\p{{Cc}}", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([^:/?#]*):", 1))
    return ~bare.rlike(r"^[^:/?#]*:") | scheme.isin(*SCHEMES)


_MARKER = rf"(?s)^({WS}*)([^{WS[1:-1]}]+)({WS}+)(?={WS}*[^{WS[1:-1]}])"


def list_item(s: Column | str) -> Column:
    """A struct (kind bullet/letter/ordered, marker, start) of a list item's text, else null; start counts characters."""
    marker = F.regexp_extract(_c(s), _MARKER, 2)
    core = F.regexp_extract(marker, r"^\(?([A-Za-z]|[0-9]{1,3})[.)]$", 1)
    kind = F.when(marker.rlike(f"^[{BULLETS[:-1]}\\-]$"), "bullet").when(core.rlike("^[A-Za-z]$"), "letter").when(core.rlike("^[0-9]+$"), "ordered")
    shown = F.when(kind == "ordered", F.concat(F.regexp_replace(core, "^0+(?=[0-9])", ""), F.lit("."))).when(kind == "bullet", "-").otherwise(F.concat(F.lit("- "), marker))
    start = F.length(F.regexp_extract(_c(s), _MARKER, 0))
    return F.when(_c(s).rlike(_MARKER) & kind.isNotNull(), F.struct(kind.alias("kind"), shown.alias("marker"), start.alias("start")))


def heading_role(s: Column | str) -> Column:
    """Level 1 to 9 of roles h1 to h9."""
    level = F.regexp_extract(_c(s), r"^h\+?0*([1-9])$", 1)
    return F.when(level != "", level.cast("int"))


def heading_like(s: Column | str) -> Column:
    c = clean_text(s)
    return (c != "") & (words(c) <= 12) & (F.length(c) <= 100)


def tabular_cell(s: Column | str) -> Column:
    c = strip(s)
    return (words(c) <= 3) & (F.length(c) <= 24)


def font_name(s: Column | str) -> Column:
    return F.when(_c(s) == "", "-").otherwise(F.regexp_replace(_c(s), WS, "_"))


def suspect_character(s: Column | str) -> Column:
    """The replacement character, or a control character that is no white space."""
    return _c(s).rlike(r"^(\uFFFD|[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F])$")


def page_selection(s: Column | str) -> Column:
    """A struct (first, last) of "7" or "1-200"; null where it is no selection."""
    a = F.nullif(F.regexp_extract(_c(s), r"^([0-9]{1,9})(-[0-9]{1,9})?$", 1), F.lit("")).cast("int")
    b = F.nullif(F.regexp_extract(_c(s), r"^[0-9]{1,9}-([0-9]{1,9})$", 1), F.lit("")).cast("int")
    end = F.coalesce(b, a)
    return F.when((a >= 1) & (end >= a), F.struct(a.alias("first"), end.alias("last")))


def letters(n: Column | str) -> Column:
    """Bijective base 26: 1 is a, 27 is aa; empty below 1."""
    step = lambda acc, _: F.when(acc["n"] > 0, F.struct(F.concat(F.char(F.lit(97) + (acc["n"] - 1) % 26), acc["s"]).alias("s"), F.floor((acc["n"] - 1) / 26).cast("long").alias("n"))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(F.lit("").alias("s"), _c(n).cast("long").alias("n")), step)["s"]


#: Roman numerals.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column | str) -> Column:
    """Lower-case roman numerals of 1 to 3999, else the decimal digits."""
    rest, out = _c(n).cast("long"), []
    for value, sign in ROMAN:
        out.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(_c(n).between(1, 3999), F.concat(*out)).otherwise(_c(n).cast("string"))


def list_number(n: Column | str, style: Column | str) -> Column:
    """A counter in a numbering style; unknown styles are decimal, none and bullet are empty."""
    s = _c(style)
    return (
        F.when(s == "lowerLetter", letters(n)).when(s == "upperLetter", F.upper(letters(n))).when(s == "lowerRoman", roman(n)).when(s == "upperRoman", F.upper(roman(n)))
        .when(s == "decimalZero", F.when(_c(n).between(0, 9), F.concat(F.lit("0"), _c(n).cast("string"))).otherwise(_c(n).cast("string"))).when(s.isin("none", "bullet"), "").otherwise(_c(n).cast("string"))
    )


def hex_color(s: Column | str) -> Column:
    """[r, g, b] of six hexadecimal digits, else null."""
    part = lambda at: F.conv(F.substring(_c(s), at, 2), 16, 10).cast("smallint")
    return F.when(_c(s).rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5)))
