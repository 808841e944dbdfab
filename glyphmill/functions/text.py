"""Text expressions with one definition of white space and of a word character.

Java's and RE2's ``\\w`` and ``\\s`` differ from each other and treat combining marks
differently, so both classes are spelled out once here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 white-space code points and the word characters (letters, numbers, underscore).
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"

WORD_RUN = f"[{WORD}]+"
NON_WS_RUN = f"[^{WS}]+"
# The same runs for Java: one or two plain ranges take the bulk of a word, the full class only its rest.
# (U+00A1 to U+167F holds no white space.) Possessive, without a repeated group, so nothing backtracks.
_FAST_WORD_RUN = f"[a-z0-9A-Z_]++[{WORD}]*+|[{WORD}]++"
_FAST_NON_WS_RUN = rf"[!-~\x{{A1}}-\x{{167F}}]++[^{WS}]*+|[^{WS}]++"
# Control, format, surrogate, private, unassigned and separator characters other than the plain space.
UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def not_blank(text: Column) -> Column:
    """True for text that is neither NULL nor made of white space only."""
    return text.isNotNull() & text.rlike(f"[^{WS}]")


def split_words(text: Column) -> Column:
    """White-space separated words; no empty strings."""
    return F.regexp_extract_all(text, F.lit(_FAST_NON_WS_RUN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters (text lower-cased first)."""
    return F.regexp_extract_all(F.lower(text), F.lit(_FAST_WORD_RUN), F.lit(0))


def token_count(text: Column, max_length: int | None = None) -> Column:
    """Number of regex word tokens, cut at a tokenizer's length limit when one is given."""
    n = F.size(F.regexp_extract_all(text, F.lit(_FAST_WORD_RUN), F.lit(0)))
    return n if max_length is None else F.least(n, F.lit(max_length))


def clean_text(text: Column) -> Column:
    """Punctuation to spaces, lower case, single spaces."""
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(_FAST_WORD_RUN), F.lit(0)), " "))


def clean_words(text: Column) -> Column:
    """Words of the cleaned text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_FAST_WORD_RUN), F.lit(0)), F.lower)


def ngrams(words: Column, n: int, plain: bool = False) -> Column:
    """All runs of ``n`` consecutive words joined by a space; empty below ``n`` words.

    ``plain`` says that ``words`` is a column of the table, not an expression to compute once.
    """
    if n == 1:
        return words

    def runs(w: Column) -> Column:
        # Element access is constant time; slice() would copy the whole array for every start.
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))

    return F.coalesce(runs(words) if plain else let(words, runs), F.array().cast("array<string>"))


def shingles(text: Column, n: int = 3) -> Column:
    """Set of word n-grams of the lower-cased text."""
    return F.array_distinct(ngrams(word_tokens(text), n))


def truncate_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def as_text(value: Column, null_as: str | None = "None") -> Column:
    """String form of any value; NULL becomes ``null_as`` (or stays NULL)."""
    cast = value.cast("string")
    return cast if null_as is None else F.coalesce(cast, F.lit(null_as))


def join_as_text(*values: Column, null_as: str = "None") -> Column:
    return F.concat_ws(" ", *[as_text(v, null_as) for v in values])


def fill_value(value: Column, when_equal: str, replacement: str) -> Column:
    return F.when(value == F.lit(when_equal), F.lit(replacement)).otherwise(value)


def swap_token(text: Column, old: str, new: str) -> Column:
    """Replace one literal mask token by another model's."""
    return F.replace(text, F.lit(old), F.lit(new))


def mask_word(text: Column, position_draw: Column, mask: str = "<mask>") -> Column:
    """Replace the word at ``position_draw mod n`` by the mask; words are split on single spaces."""
    parts = F.split(text, " ")
    hit = F.pmod(position_draw, F.size(parts).cast("bigint"))
    return F.array_join(let(hit, lambda h: F.transform(parts, lambda w, i: F.when(i == h, F.lit(mask)).otherwise(w))), " ")


def causal_prefix(text: Column, long_from: int = 45) -> Column:
    """First half of a short text's words, first two thirds of a long one's."""
    words = split_words(text)
    n = F.size(words)
    half = F.floor(n / 2).cast("int")
    two_thirds = (F.floor(n / 3) * 2).cast("int")
    return F.array_join(F.slice(words, 1, F.when(n < long_from, half).otherwise(two_thirds)), " ")


def quoted(value: Column) -> Column:
    """Render a string the way a dictionary prints it: quoted, with escapes for what cannot be printed."""
    has_single, has_double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    double_quoted = has_single & ~has_double
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    out = F.when(has_single & has_double, F.replace(out, F.lit("'"), F.lit("\\'"))).otherwise(out)
    out = F.when(out.rlike(UNPRINTABLE), F.array_join(F.transform(F.split(out, ""), _escape_char), "")).otherwise(out)
    mark = F.when(double_quoted, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, out, mark)


def _escape_char(ch: Column) -> Column:
    code = F.ascii(ch)
    digits = F.lower(F.hex(code))
    shown = (
        F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )
    return F.when(ch.rlike(UNPRINTABLE), shown).otherwise(ch)


def render_map(names: list[str]) -> Column:
    """One string per row for the named columns: ``{'name': 'value', ...}``; ``{}`` without columns."""
    items = [F.concat(quoted(F.lit(n)), F.lit(": "), quoted(as_text(F.col(f"`{n}`")))) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}")) if items else F.lit("{}")
