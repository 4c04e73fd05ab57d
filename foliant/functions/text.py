"""Small functions of strings and times: file names, answers of models, times for people, Unicode forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, strip

#: Characters that a file name mustn't have, its length, and the name of one that has none.
FORBIDDEN, LONGEST, UNNAMED = r'[<>:"/\\|?*\x00-\x1f]', 180, "unnamed"


def safe_filename(name: Column) -> Column:
    """The last part of a path, of either kind of slash, with forbidden characters as "_", cut to a length."""
    parts = F.filter(F.split(F.translate(F.coalesce(name, F.lit("")), "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    cut = F.substring(F.regexp_replace(strip(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))), FORBIDDEN, "_"), 1, LONGEST)
    return F.when(cut == "", UNNAMED).otherwise(cut)


def unfenced(answer: Column) -> Column:
    """An answer without the code fence around it: its first line, and its last if that closes the fence."""
    inner = strip(F.regexp_replace(F.regexp_replace(strip(answer), r"\A```[^\n]*(\n|\z)", ""), r"(\A|\n)[^\S\n]*```[^\S\n]*\z", ""))
    return F.when(F.startswith(strip(answer), F.lit("```")), inner).otherwise(strip(answer))


def json_object(answer: Column) -> Column:
    """The JSON object that an answer is, fenced or not; null if it is no JSON, or JSON of another kind."""
    is_object = lambda t: F.startswith(F.schema_of_variant(F.try_parse_json(t)), F.lit("OBJECT"))
    return let(unfenced(answer), lambda t: F.when(is_object(t), t))


def iso_time(at: Column) -> Column:
    """ISO 8601 to the second with the session's offset; empty for null."""
    return F.coalesce(F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit(""))


#: Between the pairs of a table of characters, and within one; neither is in any pair.
BETWEEN, WITHIN = "\x01", "\x02"


def _ranges(codes: list[int]) -> str:
    """Code points as a class of characters, with as few ranges as they make: each is a test of its own for each character read."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out) + "]"


@lru_cache(maxsize=2)
def _table(name: str) -> tuple[str, str, str, str, str]:
    """Characters that become one other, these, a pattern of those that become several, their pairs, and a pattern of texts of ASCII and
    Chinese characters that stay; found by the rule itself."""
    rule: Callable[[str], str] = {"nfkc": lambda c: unicodedata.normalize("NFKC", c), "casefold": str.casefold}[name]
    pairs = [(c, rule(c)) for c in map(chr, range(0x80 if name == "nfkc" else 0, 0x110000)) if not "\ud800" <= c <= "\udfff" and rule(c) != c]
    one, several = [p for p in pairs if len(p[1]) == 1], [p for p in pairs if len(p[1]) > 1]
    stays = [c for c in (*range(0x80), *range(0x4E00, 0xA000)) if rule(chr(c)) == chr(c)]
    pairs_of = BETWEEN.join(f"{a}{WITHIN}{b}" for a, b in several)
    return "".join(a for a, _ in one), "".join(b for _, b in one), _ranges([ord(c) for c, _ in several]), pairs_of, rf"\A{_ranges(stays)}*+\z"


def _by_table(text: Column, name: str) -> Column:
    """Each character as the table has it. Those that become several are looked up only where a text has some, and none where a text
    is of characters that stay."""
    froms, tos, pattern, pairs, plain = _table(name)
    named = F.str_to_map(F.lit(pairs), F.lit(BETWEEN), F.lit(WITHIN))
    each = lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), t, lambda acc, c: F.replace(acc, c, F.element_at(named, c)))
    changed = lambda x: let(F.translate(x, froms, tos), lambda t: F.when(F.regexp_like(t, F.lit(pattern)), each(t)).otherwise(t))
    return let(text, lambda x: F.when(F.regexp_like(x, F.lit(plain)), x).otherwise(changed(x)))


def compatible(text: Column) -> Column:
    """NFKC of each character: full-width forms, ligatures, numbers in circles and the like. What letters and marks that follow them
    make together isn't composed."""
    return _by_table(text, "nfkc")


def casefolded(text: Column) -> Column:
    """Full case folding: as lower case, and one letter as several where their cases meet so."""
    return _by_table(text, "casefold")
