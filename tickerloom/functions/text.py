"""Text columns: page text, headlines, search input."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headlines containing one of these phrases are list-style or broad market articles.
BLOCKED_HEADLINE_PHRASES = [
    "stocks to watch",
    "stocks in focus",
    "shares to watch",
    "day trading guide",
    "market wrap",
    "top gainers",
    "top losers",
    "stock market today",
    "best stocks",
    "top stocks",
]

# Accepted search input, upper-cased.
SYMBOL_PATTERN = r"^[A-Z0-9][A-Z0-9&-]{0,19}(\.(NS|BO|SI|AX))?$"
COMPANY_NAME_PATTERN = r"^[A-Z0-9][A-Z0-9 .&'()-]{1,79}$"

WHITESPACE = " \t\r\n"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapsed(text: Column) -> Column:
    """Runs of whitespace (and no-break spaces) become one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n\\f\\u00a0]+", " "))


# Every named character reference, with and without its semicolon where that is allowed, and the numbers 128
# to 159, which stand for what Windows prints there.
NAMED_REFERENCES = {name: char for name, char in sorted(html5.items()) if not set(char) & {"\x01", "\x02"}}
NAMED_REFERENCES |= {
    f"#{number}{end}": char
    for n in range(128, 160)
    if (char := bytes([n]).decode("cp1252", "ignore"))
    for number in (n, f"x{n:x}", f"X{n:x}", f"x{n:X}", f"X{n:X}")
    for end in ("", ";")
}
_NAMED = "\x01".join(f"{name}\x02{char}" for name, char in NAMED_REFERENCES.items())
# The references that pages are full of, looked up before the whole table is gone through.
_FREQUENT = "\x01".join(f"{name}\x02{NAMED_REFERENCES[name]}" for name in ("nbsp;", "amp;", "quot;", "lt;", "gt;", "apos;"))
_REFERENCE = "^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"


def _character(number: Column) -> Column:
    """The character of a code point; what is none becomes the replacement character."""
    sound = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(sound, plain).otherwise(F.lit("\ufffd"))


def unescaped(text: Column) -> Column:
    """Named, decimal and hexadecimal character references decoded, in one pass from left to right."""
    frequent, named = (F.str_to_map(F.lit(t), F.lit("\x01"), F.lit("\x02")) for t in (_FREQUENT, _NAMED))  # folded into constants

    def decoded(piece: Column) -> Column:
        found = F.regexp_extract(piece, _REFERENCE, 1)
        digits = F.regexp_replace(found, "[#;xX]", "")
        number = F.when(found.rlike("^#[0-9]"), digits.try_cast("bigint")).when(
            found.rlike("^#[xX]"), F.conv(F.right(F.concat(F.lit("0"), digits), F.lit(9)), 16, 10).try_cast("bigint")
        )
        numbered = F.when(found.startswith("#"), _character(F.coalesce(number, F.lit(0))))
        char = F.coalesce(F.try_element_at(frequent, found), F.try_element_at(named, found), numbered)
        return F.when(char.isNotNull(), F.concat(char, F.substr(piece, F.length(found) + 1))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), decoded)
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))


def html_cell_text(fragment: Column) -> Column:
    """Plain text of an HTML fragment: tags out, entities (if there are any) decoded, whitespace collapsed."""
    text = F.regexp_replace(fragment, "<[^>]+>", " ")
    return F.when(fragment.contains("&"), collapsed(unescaped(text))).otherwise(collapsed(text))


def page_text(html: Column) -> Column:
    """Visible text of a whole page: comments, scripts and styles go with their content."""
    visible = F.regexp_replace(
        html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "
    )
    return html_cell_text(visible)


def is_blocked_headline(title: Column) -> Column:
    return F.lower(title).rlike("|".join(BLOCKED_HEADLINE_PHRASES))


def is_valid_search(text: Column) -> Column:
    cleaned = F.upper(stripped(text))
    return cleaned.rlike(SYMBOL_PATTERN) | cleaned.rlike(COMPANY_NAME_PATTERN)
