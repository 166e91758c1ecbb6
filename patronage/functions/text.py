"""Text expressions: fenced code blocks and SQL references, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.functions import fixed_values as fx

# A fence line starts with ``` after blanks; the closing one holds nothing else. The body is matched
# line by line with a possessive loop, which neither backtracks nor recurses on long blocks. The line
# break before the closing fence belongs to the fence.
_BLANK = r"[^\S\n]*"
_CLOSING = rf"{_BLANK}```{_BLANK}$"
FENCED_BLOCK = rf"(?mdU)^{_BLANK}```[^\n]*\n((?:(?!{_CLOSING})[^\n]*\n)*+){_CLOSING}"


def fenced_blocks(text: Column) -> Column:
    """Contents of the closed fenced blocks, in order. An unclosed fence gives nothing."""
    bodies = F.regexp_extract_all(text, F.lit(FENCED_BLOCK), F.lit(1))
    return F.transform(bodies, lambda body: F.regexp_replace(body, r"\n\z", ""))


def code_text(text: Column) -> Column:
    """All language-fenced code joined by blank lines, or the trimmed text where there is none."""
    blocks = F.regexp_extract_all(text, F.lit(fx.LANGUAGE_FENCE), F.lit(1))
    return strip(F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(text))


WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(text: Column) -> Column:
    """Without leading and trailing white space, line breaks included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def referenced_tables(sql: Column) -> Column:
    """Distinct names after FROM and JOIN, sorted."""
    names = [F.regexp_extract_all(sql, F.lit(p), F.lit(1)) for p in (fx.TABLE_AFTER_FROM, fx.TABLE_AFTER_JOIN)]
    return F.array_sort(F.array_distinct(F.concat(*names)))


def cte_names(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(fx.CTE_AFTER_WITH), F.lit(1))


# A scan of SQL that knows what is not code. Comments may hold comments, four deep; one that is never closed ends with
# the text. A doubled quote is part of its literal or name. Loops are possessive, so long texts neither backtrack nor recurse.
_NESTED = "(?!)"
for _ in range(4):
    _NESTED = rf"(?s:/\*(?:[^*/]++|\*(?!/)|/(?!\*)|{_NESTED})*+(?:\*/|\z))"
_COMMENT = rf"--[^\n]*+|{_NESTED}"
_LITERAL = r"(?:(?<!\w)[nN])?(')(?:[^']++|'')*+(?:'|\z)"
_QUOTED = r"\[(?:[^\]]++|\]\])*+\]|\"(?:[^\"]++|\"\")*+\"|`(?:[^`]++|``)*+`"
_PART = rf"(?:{_QUOTED}|[\p{{L}}_#@][\p{{L}}\p{{N}}_$#@]*+)"
_PATH = rf"{_PART}(?:\s*+\.\s*+{_PART})*+"
#: Each quoted name outside of a reference, and each call that has a FROM of its own, is passed over as a whole.
_PASSED = rf"{_QUOTED}|(?i:\b(?:extract|trim|substring|overlay)\s*+\([^()]*+\))"
_SCANNED_TABLE = rf"{_PASSED}|(?i:(?<![\w$#@.])(?:from|join|apply)\s++(?!(?:select|lateral|unnest|only)\b)({_PATH})(?!\s*+\())"
_SCANNED_CTE = (
    rf"(?i:(?:(?<![\w$#@.])with\s++(?:recursive\s++)?|\)\s*+,\s*+)({_PART})\s*+(?:\([^()]*+\)\s*+)?as\s++(?:(?:not\s++)?materialized\s*+)?\()|{_PASSED}"
)


def without_comments(sql: Column) -> Column:
    """The script without comments, each literal cut to a quote, names as they are."""
    return F.regexp_replace(sql, rf"{_COMMENT}|{_LITERAL}|({_QUOTED})", " $1$2 ")


def _plain_name(name: Column) -> Column:
    """A name without quotes and blanks around dots; its parts joined by dots."""
    parts = F.regexp_extract_all(name, F.lit(rf"({_PART})"), F.lit(1))

    def bare(part: Column) -> Column:
        inner = F.substring(part, F.lit(2), F.length(part) - 2)
        closing = F.when(part.startswith("["), "]").when(part.startswith('"'), '"').when(part.startswith("`"), "`")
        return F.when(closing.isNotNull(), F.replace(inner, F.concat(closing, closing), closing)).otherwise(part)

    return F.array_join(F.transform(parts, bare), ".")


def _scanned(code: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
    return F.transform(F.filter(found, lambda x: x != ""), _plain_name)


def scanned_ctes(code: Column) -> Column:
    """Names that WITH defines, in order, from code without comments."""
    return F.array_distinct(_scanned(code, _SCANNED_CTE))


def scanned_tables(code: Column, ctes: Column) -> Column:
    """Distinct names after FROM and JOIN that are no CTE, sorted, from code without comments. Case does not tell names from CTEs."""
    known = F.transform(ctes, F.lower)
    return F.array_sort(F.array_distinct(F.filter(_scanned(code, _SCANNED_TABLE), lambda x: ~F.array_contains(known, F.lower(x)))))


def stage_of(block: Column) -> Column:
    """The stage a code block belongs to, by the first marker it holds; null without one."""
    stage = F.lit(None).cast("string")
    for name, marker in reversed(fx.STAGE_MARKERS):
        stage = F.when(block.contains(marker), name).otherwise(stage)
    return stage
