"""Files in and out: YAML knowledge bases and question sets, sheets, CSV, JSON, environment files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlake.functions import text as T
from weftlake.operators.corpus import require_unique
from weftlake.session import broadcast_if_small, is_blank, stripped

CHUNK_SCHEMA = "file string, pos int, doc_id string, title string, category string, lang string, content string"
QUESTION_SCHEMA = "file string, pos int, query string, expected array<string>, lang string"
ITEM_SCHEMA = "file string, pos int, json string"


def _records(pattern: str, spark: SparkSession, schema: str, pick) -> DataFrame:
    """Rows of YAML lists, one file to a row of a distributed read; files are parsed where they are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [pick(path.rsplit("/", 1)[-1], i, record) for path, text in zip(batch["path"], batch["value"], strict=True) for i, record in enumerate(yaml.safe_load(text) or []) if isinstance(record, dict)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, schema)


def _text(value) -> str | None:
    return None if value is None else str(value)


def load_knowledge_base(spark: SparkSession, pattern: str, lang: str | None = None) -> DataFrame:
    """(ord, doc_id, title, category, lang, content) of YAML files, in order of file name and place.

    docId or doc_id is accepted; rows with a blank id or content are left out; a blank language is vi. An id that occurs
    twice, in whatever files and language, is an error, and so is an empty base.
    """
    pick = lambda f, i, r: (f, i, _text(r.get("docId", r.get("doc_id"))), _text(r.get("title")), _text(r.get("category")), _text(r.get("lang")), _text(r.get("content")))
    rows = _records(pattern, spark, CHUNK_SCHEMA, pick).where(~is_blank(F.col("doc_id")) & ~is_blank(F.col("content")))
    rows = rows.select("file", "pos", stripped(F.col("doc_id")).alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("category", F.lit("")).alias("category"), T.case_lang(F.col("lang")).alias("lang"), stripped(F.col("content")).alias("content"))
    require_unique(rows)
    if lang is not None:
        rows = rows.where(F.col("lang") == lang.strip().lower())
    if rows.isEmpty():
        raise ValueError(f"no chunks in {pattern}")
    # The load order breaks ties: file names by their rank, then the place in the file.
    files = rows.select("file").distinct().withColumn("_no", F.row_number().over(Window.orderBy("file")))  # a row per file
    numbered = rows.join(broadcast_if_small(files), "file")
    return numbered.select((F.shiftleft(F.col("_no").cast("long"), 31) + F.col("pos")).alias("ord"), "doc_id", "title", "category", "lang", "content")


def load_questions(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, pos, query, expected, lang) of YAML question sets; rows without a question are left out, none is an error."""
    pick = lambda f, i, r: (f, i, _text(r.get("query")), [str(x) for x in r.get("expected") or []], _text(r.get("lang")))
    rows = _records(pattern, spark, QUESTION_SCHEMA, pick).where(~is_blank(F.col("query"))).withColumn("lang", T.case_lang(F.col("lang")))
    if rows.isEmpty():
        raise ValueError(f"no questions in {pattern}")
    return rows


def load_synonyms(path: str) -> dict[str, dict[str, list[str]]]:
    """Nested synonym tables; a key or value that YAML read as something else than a string is an error."""
    tables = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    for lang, entries in tables.items():
        for key, values in (entries or {}).items():
            if not isinstance(key, str) or not isinstance(values, list) or not all(isinstance(v, str) for v in values):
                raise TypeError(f"{lang}: {key!r} must be a string with a list of strings; quote it")
    return tables


def after_marker(text: str, marker: str) -> str:
    """The part of a file after the line that holds a marker; a missing marker is an error."""
    at = text.find(marker)
    if at < 0:
        raise ValueError(f"marker {marker!r} is missing")
    return text[text.find("\n", at) + 1 :] if "\n" in text[at:] else ""


def split_meta(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, items) of JSON rows (file, pos, json): the first record of a file may describe its run under _meta."""
    meta = F.get_json_object("json", "$._meta")
    return rows.where(meta.isNotNull()).select("file", meta.alias("meta")), rows.where(meta.isNull())


def read_items(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, pos, json): the records of YAML sheets as JSON, whatever their fields."""
    return _records(pattern, spark, ITEM_SCHEMA, lambda f, i, r: (f, i, json.dumps(r, ensure_ascii=False, default=str)))


def _scalar(value, indent: int) -> str:
    """One value of a sheet: text of several lines as a block, all else as JSON, which YAML reads alike."""
    if isinstance(value, str) and "\n" in value and value.replace("\n", "").isprintable() and not value.startswith(("\n", " ")):
        keep = {True: "", False: "-"}[value.endswith("\n")] if not value.endswith("\n\n") else "+"
        lines = value.removesuffix("\n").split("\n")
        return f"|{keep}\n" + "\n".join(" " * indent + line if line else "" for line in lines)
    return json.dumps(value, ensure_ascii=False, default=str)


def sheet_lines(rows: Iterable[dict], header: str = "") -> Iterator[str]:
    """The lines of a sheet: the header as comments, then a list of records with their fields in order."""
    yield from (f"# {line}" for line in header.splitlines())
    some = False
    for row in rows:
        for i, (name, value) in enumerate(row.items()):
            yield f"{'- ' if i == 0 else '  '}{json.dumps(name, ensure_ascii=False) if not name.isidentifier() else name}: {_scalar(value, 4)}"
        some = True
    if not some:
        yield "[]"


def write_items(df: DataFrame, path: str, header: str = "") -> None:
    """A sheet for people: rows as YAML in column order, long texts as blocks. For tables that a person can label."""
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(line + "\n" for line in sheet_lines((r.asDict(recursive=True) for r in df.toLocalIterator()), header))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, in a given order; only for exports of bounded size, as one task writes it."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


_SETTING = re.compile(r"""^[ \t]*(?:export[ \t]+)?(?P<name>[^\s#=][^=\n]*?)[ \t]*=[ \t]*(?:'(?P<single>[^'\n]*)'|"(?P<double>[^"\n]*)"|(?P<bare>[^\n]*?))[ \t\r]*$""", re.M)


def load_env_file(path: str) -> list[str]:
    """Sets the settings NAME=VALUE of a file that the environment lacks, and returns their names in order.

    Comments and other lines are passed over, `export` and outer quotes are allowed; a missing file sets nothing.
    """
    file = Path(path)
    found = {}
    for m in _SETTING.finditer(file.read_text(encoding="utf-8") if file.exists() else ""):
        value = next(v for v in m.group("single", "double", "bare") if v is not None)
        found.setdefault(m["name"], value)
    new = {name: value for name, value in found.items() if name not in os.environ}
    os.environ.update(new)
    return list(new)
