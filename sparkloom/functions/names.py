"""Scalar functions on identifiers, literals and lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the language that are no identifiers.
KEYWORDS = (
    "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class co_await co_return "
    "co_yield compl concept const const_cast consteval constexpr constinit continue decltype default delete do double dynamic_cast "
    "else enum explicit export extern false final float for friend goto if inline int long mutable namespace new noexcept not not_eq "
    "nullptr operator or or_eq override private protected public register reinterpret_cast requires return short signed sizeof static "
    "static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using "
    "virtual void volatile wchar_t while xor xor_eq"
).split()


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def indent(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*", 0)


def is_snake(c: Column) -> Column:
    return c.rlike("^[a-z_][a-z0-9_]*$")


def is_upper_snake(c: Column) -> Column:
    return c.rlike("^[A-Z_][A-Z0-9_]*$")


def passes_snake(c: Column) -> Column:
    """Snake case, the empty name, or capitals and digits with an underscore among them."""
    return (c == "") | is_snake(c) | (c.rlike("^[A-Z0-9_]+$") & c.contains("_"))


def to_snake(c: Column) -> Column:
    """An underscore before capitals that begin a word, then lower case (ASCII)."""
    split = F.regexp_replace(F.regexp_replace(c, "([A-Z])([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.translate(split, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_constant_like(c: Column) -> Column:
    return is_upper_snake(c) | c.rlike("^[CS]_[A-Z_][A-Z0-9_]*$") | c.rlike("^[cs]_[a-z_][a-z0-9_]*$")


def is_keyword(c: Column) -> Column:
    return c.isin(*KEYWORDS)


def has_prefix(c: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        if p:
            found = found | c.startswith(p)
    return found


def stacked_prefix(scope: Column, static: Column, const: Column, volatile: Column, pointer: Column) -> Column:
    """Prefix from a variable's scope (field, global, other) and flags, in that order."""
    first = F.when(scope == "field", "m_").when(scope == "global", "g_").otherwise("l_")
    return F.concat(first, F.when(static, "s_").otherwise(""), F.when(const, "c_").otherwise(""), F.when(volatile, "v_").otherwise(""), F.when(pointer, "p_").otherwise(""))


def base_type(c: Column) -> Column:
    """The last part of a qualified type without qualifiers before it."""
    bare = c
    for word in ("const ", "volatile ", "class ", "struct "):
        bare = F.regexp_replace(bare, f"^({word})+", "")
    return strip(F.substring_index(bare, "::", -1))


def is_number(c: Column) -> Column:
    return c.rlike(r"^[0-9][0-9a-fA-FxXuUlLpP.'+-]*$")


def is_float(c: Column) -> Column:
    return ~c.rlike("^0[xXbB]") & c.rlike("[.eE]")


def without_suffix(c: Column) -> Column:
    return F.when(is_float(c), F.regexp_replace(c, "[fFlL]$", "")).otherwise(F.regexp_replace(c, "[uUlL]+$", ""))


def rewrite_number(c: Column, suffix: Column, to_float: Column) -> Column:
    """The literal with another suffix, decimals without trailing zeros; null if the kind differs or nothing changes."""
    bare = without_suffix(c)
    plain = F.when(to_float & (suffix != ""), F.regexp_replace(bare, r"(\.[0-9]*?)0+(?=$|[eE])", "$1")).otherwise(bare)
    new = F.concat(plain, suffix)
    return F.when((is_float(c) == to_float) & (new != c), new)


def operator_name(c: Column) -> Column:
    """``operator`` followed by a space only before a letter, digit or underscore."""
    rest = F.regexp_extract(c, r"^operator\s*(.*)$", 1)
    return F.when(~c.startswith("operator") | (rest == ""), c).when(rest.rlike("^[A-Za-z0-9_]"), F.concat(F.lit("operator "), rest)).otherwise(F.concat(F.lit("operator"), rest))


def guard_macro(path: Column) -> Column:
    """Include guard of a path: capitals, other characters as single underscores, one at the end."""
    core = F.regexp_replace(F.regexp_replace(F.translate(path, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    named = F.when(core == "", "HEADER").otherwise(core)
    return F.concat(F.when(named.rlike("^[0-9]"), "H_").otherwise(""), named, F.lit("_"))


def consensus_stem(c: Column) -> Column:
    """Stem in lower case without a test or benchmark ending, if anything is left."""
    low = F.lower(strip(c))
    out = low
    for end in ("test", "_test", "bench", "_bench", "benchmark", "_benchmark"):  # the first that fits, from the longest
        left = F.regexp_replace(F.regexp_replace(low, f"{end}$", ""), "^_+|_+$", "")
        out = F.when(low.endswith(end) & (left != ""), left).otherwise(out)
    return out


def capital_positions(c: Column) -> Column:
    """Places (from 0) of capitals A to Z."""
    return F.filter(F.transform(F.split(c, ""), lambda ch, i: F.when(ch.rlike("^[A-Z]$"), i)), lambda i: i.isNotNull())


def line_hint(lines: Column, most: int) -> Column:
    """The first ``most`` numbers, and how many more there are."""
    n = F.size(lines)
    shown = F.array_join(F.transform(F.slice(lines, 1, most), lambda x: x.cast("string")), ", ")
    return F.when(n > most, F.concat(shown, F.format_string(" (+%d more)", n - most))).otherwise(shown)


def keyword_operators(c: Column) -> Column:
    """``&&`` and ``||`` as words, with a space where none stands and no bracket or end of clause follows."""
    for sign, word in (("&&", "and"), (r"\|\|", "or")):
        c = F.regexp_replace(c, rf"(?<=[^\s(\[{{]){sign}", f" {word}\u0001")
        c = F.regexp_replace(c, sign, f"{word}\u0001")
    c = F.regexp_replace(c, "\u0001(?=[^\\s)\\]};,:?\u0001])", " ")
    return F.replace(c, F.lit("\u0001"), F.lit(""))


def include_group(quote: Column, header: Column, is_main: Column, project: list[str]) -> Column:
    """main, std, third_party, project or local."""
    head = F.lower(header)
    own = has_prefix(head, project)
    standard = ~head.contains(".") & ~head.contains("/")
    return F.when(is_main, "main").when(quote == "<", F.when(standard, "std").otherwise("third_party")).otherwise(F.when(own, "project").otherwise("local"))
