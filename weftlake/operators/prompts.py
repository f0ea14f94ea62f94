"""Prompts for answering and judging, from ranked chunks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.session import is_blank

#: What stands for a missing context.
NO_CONTEXT = "- Không có FAQ bổ sung."
NO_JUDGE_CONTEXT = "(trống)"


def context_of(ranked: DataFrame) -> DataFrame:
    """(qid, context): one line per chunk of (qid, rank, title, content), in rank order."""
    head = F.when(is_blank(F.col("title")), F.lit("")).otherwise(F.concat("title", F.lit(": ")))
    line = F.concat(F.lit("- "), head, F.coalesce("content", F.lit("")), F.lit("\n"))
    return ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")).select("qid", F.array_join("lines.line", "").alias("context"))


def system_prompt(template: str, now: Column, lang: Column, context: Column) -> Column:
    """The template with its places filled: the time, the language (none as vi), the context (none as a fixed line)."""
    filled = F.replace(F.lit(template), F.lit("{{now}}"), now)
    filled = F.replace(filled, F.lit("{{lang}}"), F.coalesce(lang, F.lit("vi")))
    return F.replace(filled, F.lit("{{context}}"), F.when(is_blank(context), F.lit(NO_CONTEXT)).otherwise(context))


def template_of(folder: str, name: str, variant: str | None = None) -> str:
    """The text of a prompt template: `name.txt`, or `name_variant.txt`; a variant that is not there is an error."""
    path = Path(folder) / (f"{name}_{variant}.txt" if variant else f"{name}.txt")
    if not path.is_file():
        raise FileNotFoundError(f"no prompt {variant or name!r} in {folder}")
    return path.read_text(encoding="utf-8")


def ranking_line(docs: Column, expected: Column, limit: int = 5) -> Column:
    """A ranking as one line, the expected documents with a mark."""
    return F.array_join(F.transform(F.slice(docs, 1, limit), lambda d: F.when(F.array_contains(expected, d), F.concat(d, F.lit(" ✓"))).otherwise(d)), "  ")


def judge_prompt(question: Column, context: Column, answer: Column) -> Column:
    text = F.when(is_blank(context), F.lit(NO_JUDGE_CONTEXT)).otherwise(context)
    return F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nCONTEXT:\n"), text, F.lit("\n\nANSWER:\n"), F.coalesce(answer, F.lit("")))
