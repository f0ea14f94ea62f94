"""Splitting texts into tokens is most of the CPU time of an index: what it may look at, and how often."""

import re
import string

from pyspark.sql import functions as F

from weftlake.functions import text as T


def test_one_pass_for_words(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(T.latin_tokens(F.col("t")).alias("w"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("regexp_extract_all") == 1 and plan.count("regexp_replace") == 1  # the latter takes marks out
    assert "split(" not in plan and "lambda" not in plan


def test_ordinary_letters_pass_by_few_ranges():
    class_ = T._compatibility_tables()[3]
    first = class_[1 : class_.index("&&")]
    spans = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", first)]
    assert len(spans) < 15
    assert not any(a <= ord(c) <= b for a, b in spans for c in string.printable + "ếđかカ犬ー々〆")


def test_borders_of_letters_and_digits(spark):
    text = "1a2b3c a1b22cc3 9 z ab12cd3é4 12345abcde6f77gg ---x"
    wanted = [t for t in re.findall("[a-z]+|[0-9]+", text.replace("é", "e")) if len(t) > 1]
    assert spark.createDataFrame([(text,)], "t string").select(T.latin_tokens(F.col("t"))).first()[0] == wanted
