"""Text functions as column expressions, JVM-side but for the cleaner.

Java's ``\\w \\s \\d`` are ASCII unless a pattern starts with ``(?U)``; every pattern that means
Unicode classes says so.  Null in gives null out unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes and artefacts that cleaning removes.
ZERO_WIDTH = "[\\u200b-\\u200f\\ufeff]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
BOX_DRAWING = "[\\u2500-\\u257f]+"
DOT_LEADERS = "[.\\u00b7\\u2024\\u2027\\u2219\\u22c5\\u30fb\\u318d]{4,}"
CARET_RUN = "(?:\\(?\\^+\\s*\\d+[.)]?\\)?\\s*){2,}"
CARET = "\\(?\\^+\\s*\\d+[.)]?\\)?"
FORMULA = "=[A-Z][A-Z0-9_]*\\([^)\\s]*\\)[^\\s]*"
FORMAT_CODE = "%[A-Za-z](?:[,;]+)?"
QUESTIONS = "\\?{2,}"
#: Where lines end besides ``\n`` and what is left of the others after control characters became blanks.
LINE_END = "\\n|\\x85|\\u2028|\\u2029"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_blank(text: Column) -> Column:
    """Every run of Unicode white space (no-break spaces and line ends included) as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """:func:`one_blank` in lower case, '' for null: the form in which keywords are looked for."""
    return F.lower(one_blank(F.coalesce(text, F.lit(""))))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _tight(text: Column) -> Column:
    return _strip(F.regexp_replace(text, "[ \\t]{2,}", " "))


def normalized_lines(text: Column) -> Column:
    """White space in order, line by line: no-break spaces as blanks, no zero-width characters, line
    ends as ``\\n``, runs of blanks as one, ends of lines and of the text trimmed.  '' for null."""
    value = F.regexp_replace(F.coalesce(text, F.lit("")), "\\u00a0", " ")
    value = F.regexp_replace(F.regexp_replace(value, ZERO_WIDTH, ""), CONTROL, " ")
    value = F.regexp_replace(value, "\\r\\n?", "\n")
    return _strip(F.array_join(F.transform(F.split(value, LINE_END), _tight), "\n"))


def is_noise_line(line: Column) -> Column:
    """Blank lines, rules of signs, caret markers alone, and ``n / m``."""
    return let(_strip(line), _says_nothing)


def _says_nothing(bare: Column) -> Column:
    return (bare == "") | bare.rlike(r"(?U)^(?:[-=*_~\s]{3,})$") | bare.rlike(r"(?U)^(?:\(?\^+\s*\d+[.)]?\)?\s*)+$") | bare.rlike(r"(?U)^\d+\s*/\s*\d+$")


def consecutive_distinct(lines: Column) -> Column:
    """An array without elements that equal the one before."""
    return let(lines, lambda x: F.filter(x, lambda line, i: (i == 0) | ~line.eqNullSafe(F.get(x, i - 1))))


def cleaned(text: Column) -> Column:
    """Extracted text without the traces of layout, '' for null (:mod:`corpusmill.functions.cleaning`).

    Arrow batches: a dozen patterns over every text are compiled once there, and most are skipped by
    a look for their sign.  Not to be used inside a lambda, which has no place for Python.
    """
    from corpusmill.functions.cleaning import clean

    return _each(clean)(text)


def block_text(text: Column) -> Column:
    """Cleaned text on one line."""
    from corpusmill.functions.cleaning import clean_block

    return _each(clean_block)(text)


def _each(function: Callable[[str | None], str]) -> Callable[[Column], Column]:
    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([function(t) for t in texts.to_pylist()], pa.string())

    return apply


def line_blocks(text: Column) -> Column:
    """The non-blank lines of a text, each trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n?|\\n|\\x0b|\\x0c|\\x1c|\\x1d|\\x1e|\\x85|\\u2028|\\u2029"), one_blank), lambda line: line != "")


def looks_broken(text: Column) -> Column:
    """Text that was extracted badly: at least 80 characters, and Han without Hangul or many signs of loss."""
    n = F.length(text)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    han, hangul, lost = share("[\\u4e00-\\u9fff]"), share("[\\uac00-\\ud7a3]"), share("[?\\ufffd]")
    return (n >= 80) & (((han >= 0.15) & (hangul <= 0.10)) | (lost >= 0.08) | (F.regexp_count(text, F.lit("\\?\\?")) >= 8))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the folded text has one of the words."""
    value = folded(text)
    found = F.lit(False)
    for word in words:
        found = found | value.contains(word.lower())
    return found


def without_nul(text: Column) -> Column:
    return F.replace(text, F.char(F.lit(0)), F.lit(""))


def token_count(text: Column) -> Column:
    """White-space tokens; 0 for blank and null texts."""
    value = one_blank(F.coalesce(text, F.lit("")))
    return F.when(value == "", 0).otherwise(F.size(F.split(value, " ")))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.left(text, F.lit(most - 1)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def snippet(text: Column, most: int = 300) -> Column:
    value = one_blank(text)
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("..."))).otherwise(value)


def chat_title(text: Column, most: int = 80) -> Column:
    value = one_blank(text)
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("…"))).otherwise(value)


def formatted_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(n / (1024 * 1024), 1), F.lit(" MB")))
    )


def truthy(text: Column) -> Column:
    """Whether a metadata value says yes."""
    return folded(text).isin("1", "true", "yes", "y")


def repaired_latin(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, put right where this makes more Hangul; others as they are."""
    possible = ~text.rlike("[^\\x00-\\xff]")
    turned = F.try_validate_utf8(F.encode(F.when(possible, text).otherwise(""), "ISO-8859-1").cast("string"))
    hangul = lambda c: F.regexp_count(c, F.lit("[\\uac00-\\ud7a3]"))
    return F.when(possible & turned.isNotNull() & (hangul(turned) > hangul(text)), turned).otherwise(text)


def safe_filename(name: Column) -> Column:
    """A name without the characters that file systems refuse."""
    return F.regexp_replace(one_blank(name), '[\\\\/:*?"<>|]', "_")


def ordered_join(texts: Column, separator: str = "\n\n") -> Column:
    """Distinct non-blank texts in order, joined."""
    kept = F.filter(F.transform(texts, lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return F.array_join(F.array_distinct(kept), separator)


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))
