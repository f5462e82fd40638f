"""Text helpers that keep browser and decoder semantics inside Spark expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the browser's regular expressions and trim see it, whitespace as the
# posting decoder trims it, and a character that is not a line end (what '.' matches in the browser).
# The escapes are read the same way by Java and RE2.
BROWSER_SPACE = (
    r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
DECODER_SPACE = (
    r"[\t\n\x0b\f\r \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_LINE_END = r"[^\n\r\x{2028}\x{2029}]"
BROWSER_SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
DECODER_SPACE_CHARS = BROWSER_SPACE_CHARS.replace("\ufeff", "") + "\u0085"

# The browser's whitespace for Java alone: letters already fail the first, cheaper test.
FAST_BROWSER_SPACE = rf"[\x00-\x20\x{{a0}}\x{{1680}}\x{{2000}}-\x{{feff}}&&{BROWSER_SPACE}]"


def trim_browser(col: Column) -> Column:
    return F.btrim(col, F.lit(BROWSER_SPACE_CHARS))


def trim_decoder(col: Column) -> Column:
    return F.btrim(col, F.lit(DECODER_SPACE_CHARS))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units, the unit all capture lengths are measured in."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("bigint")


def cut_at_marker(text: Column, marker: str) -> Column:
    """Keep what stands before the first marker, unless the marker opens the text."""
    return F.when(F.instr(text, marker) > 1, F.substring_index(text, marker, 1)).otherwise(text)


def bound(col: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn` of a value that is worked out once, however often `fn` looks at it."""
    return F.get(F.transform(F.array(col), fn), F.lit(0))


def _trimmed(text: Column) -> Column:
    """As `trim_decoder`, which notes where every character stands, also where there is nothing to trim."""
    space = F.lit(DECODER_SPACE_CHARS)
    edge = F.contains(space, F.left(text, F.lit(1))) | F.contains(space, F.right(text, F.lit(1)))
    return F.when(edge, trim_decoder(text)).otherwise(text)


def strip_fences(response: Column) -> Column:
    """Take a model response out of its code fence."""

    def opened(body: Column) -> Column:
        begin = F.lit(1)
        for fence in ("```", "```json", "```json```"):
            begin = F.when(F.startswith(body, F.lit(fence)), len(fence) + 1).otherwise(begin)
        return F.when(F.startswith(body, F.lit("```")), F.substr(body, begin)).otherwise(body)

    def closed(body: Column) -> Column:
        return F.when(F.endswith(body, F.lit("```")), F.left(body, F.length(body) - 3)).otherwise(body)

    text = response
    for step in (_trimmed, opened, closed, _trimmed):
        text = bound(text, step)
    return text


def extract_url(text: Column) -> Column:
    """The rest of the line after the first 'URL:', or '' when there is none."""
    return trim_decoder(F.regexp_extract(text, r"URL:([^\n]*)", 1))


def is_blank(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) == ""


def or_default(col: Column, default: str) -> Column:
    """A blank or missing text becomes the default."""
    return F.when(is_blank(col), F.lit(default)).otherwise(col)


def like_pattern(term: str) -> str:
    """A contains pattern in which % and _ stay wildcards and a backslash is an ordinary character."""
    return "%" + term.replace("\\", "\\\\") + "%"


# LIKE folds the case of these letters and no others.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)
