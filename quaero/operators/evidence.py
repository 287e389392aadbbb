"""Evidence for prompts: ranked blocks, budgets, rendering, and what a model's input limit leaves visible."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the marker before a block's id, by which audits find blocks again.
MARKER = "法条ID"
METHODS = ("bm25", "dense", "hybrid")
PACKING_VERSION = "ranked_complete_blocks_v1"


@dataclass(frozen=True)
class Templates:
    """Prompt texts with {question} and, for evidence, {evidence}."""

    direct: str = "Q={question}"
    rag: str = "Q={question} E={evidence}"


def block(id_: Column, name: Column, text: Column, marker: str = MARKER) -> Column:
    return F.concat(F.lit(f"[{marker} "), id_.cast("string"), F.lit("] "), name, F.lit("\n"), text)


def blocks(ranked: DataFrame, corpus: DataFrame, k: int = 10, marker: str = MARKER) -> DataFrame:
    """(query_id, rank, id, block) of the first k ranks; ids that the corpus lacks are left out, later ranks don't move up."""
    rows = ranked.where(F.col("rank") <= k).join(corpus, "id")
    return rows.select("query_id", "rank", "id", block(F.col("id"), F.col("name"), F.col("text"), marker).alias("block"))


def evidence(found: DataFrame) -> DataFrame:
    """(query_id, evidence, ids): the blocks in rank order, an empty line between."""
    own = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "block"))).alias("b"))
    return own.select("query_id", F.array_join("b.block", "\n\n").alias("evidence"), F.col("b.id").alias("ids"))


def render(template: str, **values: Column) -> Column:
    """A template with its {names} filled in; text that is filled in is not looked at again, and {{ }} are braces."""
    out = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})*)(?:\{(\w+)\})?", template):
        if literal:
            out.append(F.lit(literal.replace("{{", "{").replace("}}", "}")))
        if name:
            out.append(values[name])
    return F.concat(*out) if out else F.lit("")


def prompt(method: str, templates: Templates, question: Column, evidence_: Column | None = None) -> Column:
    """The prompt of a method; unknown methods are an error."""
    if method == "direct":
        return render(templates.direct, question=question)
    if method in METHODS:
        return render(templates.rag, question=question, evidence=evidence_ if evidence_ is not None else F.lit(""))
    raise ValueError(f"unknown method {method!r}")


def pack(queries: DataFrame, found: DataFrame, budget: int, templates: Templates = Templates()) -> DataFrame:
    """Prompts with as many whole blocks in rank order as fit in ``budget`` characters.

    The first block that doesn't fit ends the evidence.  A query without blocks
    that fit has a prompt without evidence, even over the budget.
    """
    base = F.length(prompt("bm25", templates, F.col("question"), F.lit("")))
    times = templates.rag.count("{evidence}")
    sizes = found.join(queries.select("query_id", base.alias("base")), "query_id")
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.col("base") + times * (F.sum(F.length("block")).over(before) + 2 * (F.count("*").over(before) - 1))
    fit = sizes.withColumn("used", used).where(F.col("used") <= budget)  # lengths only grow, so what fits is a prefix
    own = evidence(fit)
    text = F.coalesce("evidence", F.lit(""))
    out = queries.select("query_id", "question").join(own, "query_id", "left")
    full = prompt("bm25", templates, F.col("question"), text)
    return out.select("query_id", "question", text.alias("evidence"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("included_ids"), full.alias("prompt"), F.length(full).alias("tokens"), F.lit(PACKING_VERSION).alias("packing_version"))


def pack_with(tokenizer, queries: DataFrame, found: DataFrame, budget: int, templates: Templates = Templates()) -> DataFrame:
    """As :func:`pack`, for a tokenizer (text to a number of tokens) whose counts don't add up: prompts are counted whole."""
    rows = queries.select("query_id", "question").join(found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "block"))).alias("b")), "query_id", "left")

    def fill(template: str, question: str, text: str) -> str:
        return template.format(question=question, evidence=text)

    def run(batches):
        for pdf in batches:
            out = []
            for q, question, own in zip(pdf["query_id"], pdf["question"], pdf["b"], strict=True):
                taken: list = []
                for b in own if own is not None else []:
                    text = "\n\n".join(x["block"] for x in [*taken, b])
                    if tokenizer(fill(templates.rag, question, text)) > budget:
                        break
                    taken.append(b)
                text = "\n\n".join(x["block"] for x in taken)
                whole = fill(templates.rag, question, text)
                out.append((q, question, text, [int(x["id"]) for x in taken], whole, tokenizer(whole), PACKING_VERSION))
            yield pd.DataFrame(out, columns=["query_id", "question", "evidence", "included_ids", "prompt", "tokens", "packing_version"])

    return rows.mapInPandas(run, "query_id long, question string, evidence string, included_ids array<long>, prompt string, tokens int, packing_version string")


def marker_spans(prompts: DataFrame, marker: str = MARKER) -> DataFrame:
    """(query_id, pos, id, start, end, size): each marked block of a prompt (query_id, prompt), to the next marker or the end.

    Markers anywhere in the prompt count.  Places are characters from 0.
    """
    pattern = rf"\[{marker} (\d+)\]"
    ids, marks = (F.regexp_extract_all("prompt", F.lit(pattern), F.lit(g)) for g in (1, 0))
    gaps = F.slice(F.split("prompt", pattern, -1), 1, F.greatest(F.size(ids), F.lit(1)))
    sizes = lambda texts: F.transform(texts, lambda x: F.length(x))  # noqa: E731  # texts themselves need not go through the window
    rows = prompts.select("query_id", F.length("prompt").alias("size"), F.posexplode(F.arrays_zip(ids.alias("id"), sizes(marks).alias("mark"), sizes(gaps).alias("gap"))).alias("pos", "m")).where("m.id is not null")
    order = Window.partitionBy("query_id").orderBy("pos")
    start = F.sum("m.gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("m.mark").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("query_id", "pos", F.col("m.id").cast("long").alias("id"), start.alias("start"), "size")
    return placed.select("query_id", "pos", "id", "start", F.coalesce(F.lead("start").over(order), F.col("size")).alias("end"), "size")


def audit(prompts: DataFrame, limit: int, marker: str = MARKER) -> DataFrame:
    """What a limit of characters leaves of each prompt: blocks that are visible, wholly and in part.

    A block is visible if it starts before the limit, and whole if it ends by it.
    """
    spans = marker_spans(prompts, marker)
    kind = lambda test: F.array_compact(F.transform("s", lambda x: F.when(test(x), x["id"])))
    own = spans.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "start", "end"))).alias("s"))
    none = F.array().cast("array<struct<pos:int,id:bigint,start:bigint,end:bigint>>")
    rows = prompts.select("query_id", F.length("prompt").alias("tokens")).join(own, "query_id", "left").withColumn("s", F.coalesce("s", none))
    return rows.select(
        "query_id", "tokens", (F.col("tokens") > limit).alias("truncated"), kind(lambda x: x["start"] < limit).alias("visible"),
        kind(lambda x: x["end"] <= limit).alias("full"), kind(lambda x: (x["start"] < limit) & (x["end"] > limit)).alias("partial"),
    )


def audit_with(offsets, prompts: DataFrame, limit: int, marker: str = MARKER) -> DataFrame:
    """As :func:`audit`, for a tokenizer that gives each token's (start, end) in a text."""
    pattern = re.compile(rf"\[{marker} (\d+)\]")

    def one(text: str):
        spans = list(offsets(text))
        marks = list(pattern.finditer(text))
        ends = [m.start() for m in marks[1:]] + [len(text)]
        visible, full, partial = [], [], []
        for mark, end in zip(marks, ends, strict=False):
            inside = [i for i, (a, b) in enumerate(spans) if b > mark.start() and a < end]
            seen = sum(i < limit for i in inside)
            if seen:
                visible.append(int(mark[1]))
                (full if seen == len(inside) else partial).append(int(mark[1]))
        return len(spans), len(spans) > limit, visible, full, partial

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(q, *one(t)) for q, t in zip(pdf["query_id"], pdf["prompt"], strict=True)], columns=["query_id", "tokens", "truncated", "visible", "full", "partial"])

    return prompts.select("query_id", "prompt").mapInPandas(run, "query_id long, tokens int, truncated boolean, visible array<long>, full array<long>, partial array<long>")


def prompts_for(methods: dict[str, DataFrame], queries: DataFrame, corpus: DataFrame, templates: Templates = Templates(), k: int = 10) -> DataFrame:
    """(method, query_id, prompt): every query's prompt for "direct" and for each ranked list given; the corpus is read once for all lists."""
    direct = queries.select(F.lit("direct").alias("method"), "query_id", prompt("direct", templates, F.col("question")).alias("prompt"))
    if not methods:
        return direct
    pair = lambda m: F.struct(m.alias("method"), F.col("query_id").alias("q")).alias("query_id")
    ranked = reduce(DataFrame.unionByName, [r.select(pair(F.lit(m)), "rank", "id") for m, r in methods.items()])
    asked = queries.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).select(pair(F.col("method")), "question")
    text = F.coalesce("evidence", F.lit(""))
    each = F.coalesce(*[F.when(F.col("query_id.method") == m, prompt(m, templates, F.col("question"), text)) for m in methods])
    own = asked.join(evidence(blocks(ranked, corpus, k)), "query_id", "left")
    return direct.unionByName(own.select("query_id.method", F.col("query_id.q").alias("query_id"), each.alias("prompt")))
