"""String expressions of document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC, LATIN = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]", r"[A-Za-z]"
#: Tokens of style that cell text is freed of.
STYLE_TOKENS = ["<b>", "</b>", "<i>", "</i>", "<sup>", "</sup>", "<sub>", "</sub>", "<strike>", "</strike>", "<overline>", "</overline>", "<underline>", "</underline>"]


def half_width(text: Column) -> Column:
    """Full-width forms as their ASCII ones."""
    wide = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.translate(text, wide, " " + "".join(map(chr, range(0x21, 0x7F))))


def alnum_lower(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def strip_styles(text: Column) -> Column:
    return F.regexp_replace(text, "|".join(STYLE_TOKENS), "")


def squash_lines(text: Column) -> Column:
    """Line ends with the white space around them as one space; runs of blanks as one; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t\n]*", " "), r"[ \t]{2,}", " "))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([*`~$])", r"\\$1")


def escape_url(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def script_spaces(text: Column) -> Column:
    """A space where Arabic and Latin letters or digits meet; runs of blanks as one; trimmed."""
    apart = F.regexp_replace(F.regexp_replace(text, f"({ARABIC})([A-Za-z0-9])", "$1 $2"), f"([A-Za-z0-9])({ARABIC})", "$1 $2")
    return F.trim(F.regexp_replace(apart, r"[ \t]{2,}", " "))


def is_rtl(text: Column) -> Column:
    """At least as many Arabic as Latin letters."""
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    return count(ARABIC) >= count(LATIN)


def visual_order(text: Column) -> Column:
    """Right-to-left text reversed, runs of ASCII words and signs as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9 :*./%+-]+|[^a-zA-Z0-9 :*./%+-])"), 1)
    return F.array_join(F.reverse(parts), "")


def squeeze_spaces(text: Column) -> Column:
    """Three spaces become one, single spaces go."""
    mark = F.lit("\u0001")
    return F.replace(F.replace(F.replace(text, F.lit("   "), mark), F.lit(" "), F.lit("")), mark, F.lit(" "))


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w[:1].upper() + w[1:] for w in rest)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance; a row of its table is held as two integers with a bit an item (Hyyrö), so long lists are no burden."""
    if not a or a == b:
        return 0 if a == b else len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, far = every, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        tall, wide = same | down, (((same & up) + up) ^ up) | same
        more, less = down | ~(wide | up) & every, up & wide
        far += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | ~(tall | more) & every, more & tall
    return far
