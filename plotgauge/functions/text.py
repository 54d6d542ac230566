"""Text columns: whitespace, code fences, JSON payloads, HTML pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

JUDGE_SCHEMA = T.StructType(
    [
        T.StructField("reasoning_trace", T.StringType()),
        T.StructField("fatal_errors", T.ArrayType(T.StringType())),
        T.StructField("style_warnings", T.ArrayType(T.StringType())),
        T.StructField("scores", T.StructType([T.StructField(n, T.DoubleType()) for n in ("visual_logic_score", "data_fidelity_score", "style_consistency_score", "interaction_score")])),
    ]
)


#: The characters that stripping takes off both ends.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(text, F.lit(BLANKS))


def normalize_text(text: Column) -> Column:
    """Null as empty, runs of Unicode white space as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def strip_code_fences(text: Column) -> Column:
    """Stripped, then without a leading fence (of html, json or no language) and without a trailing one. Of any other language's fence the name stays."""
    head = F.regexp_replace(strip(text), r"^```(?:html|json)?", "")
    tail = F.regexp_replace(strip(head), r"```\z", "")
    return strip(tail)


def extract_html(text: Column) -> Column:
    """Content of the first html fence, in any case; the text itself if it has none."""
    pattern = r"(?is)```html(.*?)```"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1), F.lit(" \n\t\r"))).otherwise(text)


def _between(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing character, or null."""
    first = F.instr(text, opening)
    last = F.length(text) + 1 - F.instr(F.reverse(text), closing)
    return F.when((first > 0) & (F.instr(text, closing) > 0) & (last > first), F.substring(text, first, last - first + 1))


def json_payload(text: Column) -> Column:
    """The JSON part of a model's answer: the first fenced block, else the outermost braces, else the outermost brackets."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json|markdown)?\s*(.*?)\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.coalesce(_between(text, "{", "}"), _between(text, "[", "]")))


#: What a JSON value begins with; any other text needs no parser to be refused.
_JSON_START = r"\A[ \n\t\r]*[\[{\"0-9tfn-]"


def valid_json(text: Column) -> Column:
    """The text if all of it is one JSON value, else null. The parser alone would let anything follow the value, so it reads a list of the text, once."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    size = F.size(F.try_variant_get(listed, "$", "array<variant>"))
    return F.when(text.rlike(_JSON_START) & (size == 1), text)


def json_block(text: Column) -> Column:
    """Stricter: the whole text if it is JSON, else the greedily fenced braces, else the outermost braces; null if what is found doesn't parse."""
    whole = F.trim(text, F.lit(" \n\t\r"))
    fenced = F.regexp_extract(whole, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(valid_json(whole).isNotNull(), whole).when(fenced != "", valid_json(fenced)).otherwise(valid_json(_between(whole, "{", "}")))


def wrap_html(text: Column, head: str, tail: str) -> Column:
    """A page as it is, anything else inside a page."""
    return F.when(F.lower(text).contains("<html"), text).otherwise(F.concat(F.lit(head), text, F.lit(tail)))


def line_count(text: Column) -> Column:
    """Lines as a file reader counts them: a line break at the end begins no further line."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1))


def html_gate(text: Column) -> Column:
    """Whether a generated page is whole enough to be loaded."""
    return F.coalesce(text.contains("html>") & text.contains("</html>"), F.lit(False))
