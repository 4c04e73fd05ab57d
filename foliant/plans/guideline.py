"""Requirements that a guideline's reader found, mapped to rules.

A requirement is JSON text, {"kind": ..., "detail": {...}}, in one of many spellings. It is read as a variant, so the whole mapping is
a projection: no schema, no Python in the tasks. Equal requirements of a guideline (by canonical JSON: keys sorted, no blanks,
1.0 as 1) count once, at their first place. Those that can't be mapped are dropped, and don't take a rule's number.

Defined results. Text that is no JSON object isn't a requirement and goes, as do nulls. A detail that is no object counts as empty. As
values count what a reader's free spelling gives: numbers in quotes, one name in place of a list; nested values in a list of names
are named by their JSON. Of several spellings of a number the first key that is there counts, of a name the first that isn't
empty. Requirements of one guideline with the same `ord` are ordered by their JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.columns import let, strip
from foliant.plans.review import once

#: Formats that a field can have; sizes and orientations of a page.
FORMATS = ("email", "cn_mobile", "phone", "date", "cn_id", "number", "project_code")
PAPERS, TURNS = ("A4", "A3", "LETTER"), ("portrait", "landscape", "any")
#: The rule type and severity of each kind of requirement.
KINDS = {
    "page_limit": ("page_limit", "error"), "word_limit": ("word_limit", "warning"), "required_section": ("required_sections", "error"), "font": ("font_check", "warning"),
    "budget_ratio": ("budget_check", "error"), "duration": ("date_check", "warning"), "attachment": ("attachment_checklist", "info"), "required_field": ("required_fields", "error"),
    "field_format": ("field_format", "warning"), "heading_numbering": ("heading_numbering", "warning"), "layout": ("layout_check", "warning"),
}
DESCRIPTION = "Generated from guideline"


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it is none."""
    return F.to_json(F.try_parse_json(text))


def _at(key: str) -> Column:
    """A detail's value as a variant; null if the key isn't there, a variant's null if it is null."""
    return F.variant_get("detail", f"$.{key}", "variant")


def _json(v: Column) -> Column:
    return F.to_json(v)


def _true(v: Column) -> Column:
    """Whether a value is there and neither null, false, zero nor empty."""
    return F.coalesce(~F.regexp_like(_json(v), F.lit(r'\A(null|false|""|\[\]|\{\}|-?0(\.0*)?([eE][+-]?[0-9]+)?)\z')), F.lit(False))


def _first_true(*keys: str) -> Column:
    """The first value that isn't empty, or else that of the last key."""
    return F.coalesce(F.get(F.filter(F.array(*map(_at, keys)), _true), F.lit(0)), _at(keys[-1]))


def _text(v: Column) -> Column:
    """A value as a word."""
    word = lambda v, j: F.when(F.startswith(j, F.lit('"')), F.try_variant_get(v, "$", "string")).when(j == "true", "True").when(j == "false", "False").otherwise(j)
    return let(v, lambda v: let(_json(v), lambda j: word(v, j)))


def _quoted(c: Column) -> Column:
    """A word as JSON."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _names(v: Column) -> Column:
    """The words of a list, or of a single value; none of null."""

    def listed(v: Column, j: Column) -> Column:
        items = F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), _true), _text)
        return F.when(v.isNull() | (j == "null"), F.array().cast("array<string>")).when(F.startswith(j, F.lit("[")), items).otherwise(F.array(_text(v)))

    return let(v, lambda v: let(_json(v), lambda j: listed(v, j)))


def _first_key(keys: tuple[str, ...], f: Callable[[Column, Column], Column]) -> Column:
    """f(the value's word, whether it is in quotes) of the first key that is there."""
    return let(F.coalesce(*map(_at, keys)), lambda v: let(strip(_text(v)), lambda word: f(word, F.startswith(_json(v), F.lit('"')))))


def _number(*keys: str) -> Column:
    """The first key's number, as JSON: whole ones without a point."""

    def value(word: Column, quoted: Column) -> Column:
        plain = F.when(F.regexp_like(word, F.lit(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z")), word.try_cast("double"))
        return F.when(word.isin("True", "False") & ~quoted, (word == "True").cast("double")).otherwise(plain)

    shown = lambda x: F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return let(_first_key(keys, value), shown)


def _whole(*keys: str) -> Column:
    """The first key's whole number: of digits in quotes, or of a number, whose fraction goes."""

    def value(word: Column, quoted: Column) -> Column:
        digits = F.when(F.regexp_like(word, F.lit(r"\A[+-]?[0-9]+(_[0-9]+)*\z")), F.translate(word, "_", "").try_cast("long"))
        return F.when(quoted, digits).when(word.isin("True", "False"), (word == "True").cast("long")).otherwise(word.try_cast("double").try_cast("long"))

    return _first_key(keys, value).cast("string")


def _object(v: Column) -> Column:
    """An object's JSON, else null."""
    return F.when(F.startswith(_json(v), F.lit("{")), _json(v))


def _fields(*given: tuple[str, Column]) -> Column:
    """JSON of the fields that aren't null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in given]), F.lit("}"))


def _list(names: Column, key: str | None = None) -> Column:
    """JSON of words, or of objects with one word each; null for none."""
    one = (lambda w: _quoted(w)) if key is None else (lambda w: F.concat(F.lit(f'{{"{key}":'), _quoted(w), F.lit("}")))
    return F.when(F.size(names) > 0, F.concat(F.lit("["), F.array_join(F.transform(names, one), ","), F.lit("]")))


def _needed(condition: Column, value: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value)


def _params() -> dict[str, Column]:
    """The rule's parameters by kind, as JSON; null if they can't be had."""
    sections, expected, names = _names(_first_true("sections", "required", "names", "section")), _names(_first_true("expected", "attachments", "names", "name")), _names(_first_true("names", "fields", "name"))
    font, size = _first_true("body_font", "font", "name"), _number("body_size", "size", "font_size")
    item, ratio = _first_true("item", "name", "category"), _number("max_ratio", "ratio", "limit")
    field, form, pattern = _first_true("name", "field"), _at("format"), _at("pattern")
    known = strip(_text(form))
    by_format = _needed(known.isin(*FORMATS), _fields(("name", _quoted(_text(field))), ("format", _quoted(known))))
    by_pattern = _fields(("name", _quoted(_text(field))), ("pattern", _quoted(_text(pattern))), ("expected", F.when(_true(_at("expected")), _quoted(_text(_at("expected"))))))
    flag = lambda key, default: F.when(_at(key).isNull(), F.lit(default)).otherwise(_true(_at(key))).cast("string")
    paper, turn = F.upper(F.coalesce(_text(F.coalesce(_at("page_size"), _at("size"))), F.lit("A4"))), F.coalesce(_text(_at("orientation")), F.lit("portrait"))
    return {
        "page_limit": _fields(("max_pages", _whole("max_pages", "pages", "limit"))),
        "word_limit": _fields(("max_words", _whole("max_words", "words", "limit"))),
        "required_section": _fields(("sections", _list(sections, "title"))),
        "font": _fields(("body_font", F.when(_true(font), _quoted(_text(font)))), ("body_size", size)),
        "budget_ratio": _needed(item.isNotNull() & (_json(item) != "null") & ratio.isNotNull(), _fields(("max_ratio", F.concat(F.lit("{"), _quoted(_text(item)), F.lit(":"), ratio, F.lit("}"))))),
        "duration": _fields(("expected_months", _whole("expected_months", "months", "duration_months"))),
        "attachment": _fields(("expected", _list(expected))),
        "required_field": _fields(("fields", _list(names, "name"))),
        "field_format": _needed(_true(field), F.concat(F.lit('{"fields":['), F.when(_true(form), by_format).when(_true(pattern), by_pattern), F.lit("]}"))),
        "heading_numbering": _fields(("require_numbering", flag("require_numbering", True)), ("allow_mixed_styles", flag("allow_mixed_styles", False)), ("allowed_styles", _object(_at("allowed_styles")))),
        "layout": _needed(paper.isin(*PAPERS) & turn.isin(*TURNS), _fields(("page", _fields(("size", _quoted(paper)), ("orientation", _quoted(turn)))), ("margins_mm", _object(_first_true("margins_mm", "margins"))), ("body", _object(_at("body"))), ("headings", _object(_at("headings"))))),
    }


def mapped(requirements: DataFrame) -> DataFrame:
    """guideline, ord, requirement (canonical), rule_id, type, severity, params, description of each distinct requirement of
    requirements (guideline, ord, requirement); rule_id and what follows are null for a dropped one."""
    rows = requirements.select("guideline", "ord", F.col("requirement").alias("text_"))
    # guidelines repeat each other, so each distinct text is read once, and joined back
    read = once(rows.select("text_").where("text_ is not null").distinct().withColumn("requirement", canonical(F.col("text_"))), "requirement").where(F.startswith("requirement", F.lit("{")))
    read = once(read.withColumn("whole", F.parse_json("requirement")), "whole")
    detail = F.variant_get("whole", "$.detail", "variant")
    detail = F.when(F.startswith(F.to_json(detail), F.lit("{")), detail).otherwise(F.parse_json(F.lit("{}")))
    kind = F.when(F.startswith(F.to_json(F.variant_get("whole", "$.kind", "variant")), F.lit('"')), F.try_variant_get("whole", "$.kind", "string"))
    read = once(read.select("text_", "requirement", F.struct(kind.alias("kind"), detail.alias("detail")).alias("r")), "r").select("text_", "requirement", "r.*")
    params = F.coalesce(*[F.when(F.col("kind") == k, F.nullif(p, F.lit("{}"))) for k, p in _params().items()])
    read = once(read.select("text_", "requirement", "kind", canonical(params).alias("params")), "params")
    ruled = rows.join(read, "text_").groupBy("guideline", "requirement", "kind", "params").agg(F.min("ord").alias("ord"))
    fits = F.col("params").isNotNull()
    number = F.sum(fits.cast("int")).over(Window.partitionBy("guideline").orderBy("ord", "requirement").rowsBetween(Window.unboundedPreceding, 0))
    of_kind = lambda i: F.when(fits, F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[i])) for k, v in KINDS.items()]))
    rule_id = F.when(fits, F.concat(F.lit("G"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))))
    return ruled.select("guideline", "ord", "requirement", rule_id.alias("rule_id"), of_kind(0).alias("type"), of_kind(1).alias("severity"), "params", F.when(fits, DESCRIPTION).alias("description"))


def dropped(rules: DataFrame) -> DataFrame:
    """guideline, ord, requirement of what `mapped` couldn't map."""
    return rules.where("rule_id is null").select("guideline", "ord", "requirement")
