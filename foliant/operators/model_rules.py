"""Rules that need a model: what is asked is built in Spark, a provider answers, and only answers with evidence in the text count.

A provider is a function prompt -> {"issues": [{"evidence", "message", "suggestion"}]}, called in tasks. Without one these rules
are skipped. A chunk whose call fails leaves one degraded finding, and then stands alone for its rule and document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.columns import let, strip
from foliant.functions.derive import chunks
from foliant.plans.rules import Rule, RuleError

Provider = Callable[[str], dict]
#: Words of sentences that tell figures which must agree; the least similarity of evidence that isn't verbatim.
TELLING, SIMILAR = ("期限", "经费", "总额", "万元", "成员", "人员"), 0.85
FOUND = "doc_id string, rule_id string, checker string, severity string, page int, block_id string, evidence string, message string, suggestion string, confidence string, layer string"
BLOCK = "struct<id:string,page:int,text:string>"


def plain_blocks(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.struct(b["id"].alias("id"), b["page"].alias("page"), b["text"].alias("text")))


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda b: b["text"]), "\n\n")


def anonymity_chunks(rule: Rule) -> Column:
    """Non-empty blocks off the cover pages, packed."""
    cover, most = [int(p) for p in rule.params.get("cover_pages", [1])], int(rule.params.get("max_chunk_chars", 12000))
    body = F.filter("blocks", lambda b: ~F.coalesce(b["page"].isin(*cover), F.lit(False)) & (strip(b["text"]) != ""))
    return F.transform(chunks(plain_blocks(body), lambda b: F.length(b["text"]), most, BLOCK), joined)


def section_chunks(rule: Rule) -> Column:
    """Each level-1 heading with the paragraphs up to the next one, the text cut at max_section_chars; sections packed."""
    cut, most = int(rule.params.get("max_section_chars", 6000)), int(rule.params.get("max_chunk_chars", 12000))
    heads = F.filter("blocks", lambda b: (b["type"] == "heading") & (b["level"] == 1))

    def section(h: Column, i: Column, hs: Column) -> Column:
        end = F.coalesce(F.get(hs, i + 1)["ord"], F.lit(2**31 - 1))
        body = F.filter("blocks", lambda b: (b["type"] == "paragraph") & (b["ord"] > h["ord"]) & (b["ord"] < end))
        return F.concat(h["text"], F.lit("\n"), F.substring(F.array_join(F.transform(body, lambda b: b["text"]), "\n"), 1, cut))

    sections = let(heads, lambda hs: F.transform(hs, lambda h, i: section(h, i, hs)))
    return F.transform(chunks(sections, F.length, most, "string"), lambda c: F.array_join(c, "\n\n"))


def sentence_chunks(rule: Rule) -> Column:
    """One chunk: the numbered sentences that tell figures, as many from the first on as fit; at least one."""
    most = int(rule.params.get("max_chunk_chars", 8000))
    sentences = F.flatten(F.transform("blocks", lambda b: F.split(b["text"], "(?<=[。！？!?])")))
    telling = F.filter(F.transform(sentences, strip), lambda s: F.exists(F.array(*map(F.lit, TELLING)), lambda w: F.contains(s, w)))
    numbered = F.transform(telling, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    kept = F.get(chunks(numbered, F.length, most - 50, "string"), F.lit(0))
    return F.when(F.size(telling) > 0, F.array(F.array_join(kept, "\n"))).otherwise(F.array().cast("array<string>"))


CHUNKS = {"anonymity_check": anonymity_chunks, "title_content_match": section_chunks, "cross_consistency_semantic": sentence_chunks}


def prompts(documents: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, chunk, prompt: what a model would be asked for a rule. No shuffle."""
    if rule.type not in CHUNKS:
        raise RuleError(f"{rule.type} asks no model")
    wrapped = F.concat(F.lit(f"{rule.description or rule.type}\n\n<untrusted_document>\n"), F.col("text"), F.lit("\n</untrusted_document>"))
    return documents.select("doc_id", F.posexplode(CHUNKS[rule.type](rule)).alias("chunk", "text")).select("doc_id", "chunk", wrapped.alias("prompt"))


def most_alike(e: str, counts: Counter, t: str) -> float:
    """What the ratio of two texts can't pass: matching characters are in both, as often as in the one that has fewer."""
    shared, left = 0, dict(counts)
    for c in t:
        if left.get(c, 0) > 0:
            left[c] -= 1
            shared += 1
    return 2 * shared / (len(e) + len(t))


def placed(evidence: str, blocks: list) -> dict | None:
    """The first block that holds the evidence, blanks aside; else the most similar from SIMILAR on, of equals the first.

    Blocks are compared in the order of a bound of their ratio, first by length and then by shared characters, and only as long as
    the bound allows for more than the best so far; so few of them are.
    """
    bare = lambda t: "".join((t or "").split())
    e = bare(evidence)
    texts = [bare(b["text"]) for b in blocks] if e else []
    for b, t in zip(blocks, texts, strict=False):
        if t and e in t:
            return b
    counts = Counter(e)
    near = [i for i, t in enumerate(texts) if t and 2 * min(len(e), len(t)) / (len(e) + len(t)) >= SIMILAR]
    bounded = sorted((-bound, i) for i in near if (bound := most_alike(e, counts, texts[i])) >= SIMILAR)
    best, most = None, 0.0
    for bound, i in bounded:
        if -bound < most:
            break
        ratio = SequenceMatcher(None, e, texts[i]).ratio()
        if ratio >= SIMILAR and (ratio > most or ratio == most and i < best):
            best, most = i, ratio
    return None if best is None else blocks[best]


def asked(documents: DataFrame, rule: Rule, provider: Provider) -> DataFrame:
    """Findings of a rule from a provider's answers; answers whose evidence no block holds are dropped."""
    head = (rule.id, rule.type, rule.severity)
    rows = documents.select("doc_id", plain_blocks(F.col("blocks")).alias("blocks"), F.transform(CHUNKS[rule.type](rule), lambda t: F.concat(F.lit(f"{rule.description or rule.type}\n\n<untrusted_document>\n"), t, F.lit("\n</untrusted_document>"))).alias("prompts"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, blocks, prompts in batch.itertuples(index=False):
                own = []
                for prompt in prompts:
                    try:
                        issues = provider(prompt)["issues"]
                        if not isinstance(issues, list):
                            raise TypeError("issues is no list")
                    except Exception as e:  # noqa: BLE001  a provider's fault is a finding of its own
                        own = [(doc_id, *head[:2], "info", None, None, "", f"模型检查未完成：{type(e).__name__}", "请人工核对", "degraded", "llm")]
                        break
                    for issue in issues:
                        block = placed(str(issue.get("evidence", "")), list(blocks)) if isinstance(issue, dict) else None
                        if block is not None:
                            page = None if block["page"] is None or pd.isna(block["page"]) else int(block["page"])
                            own.append((doc_id, *head, page, block["id"], str(issue.get("evidence", ""))[:200], str(issue.get("message", "")), str(issue.get("suggestion", "")), "ai", "llm"))
                out += own
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")]).astype({"page": "Int32"})

    return rows.mapInPandas(ask, FOUND)
