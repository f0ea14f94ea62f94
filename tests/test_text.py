import unicodedata

import pytest
from pyspark.sql import functions as F

from weftlake.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given, wanted", [("đặt vé máy bay", "dat ve may bay"), ("Đà Nẵng", "Da Nang"), (None, ""), ("", ""), ("ABC", "ABC"), (unicodedata.normalize("NFD", "Hủy vé"), "Huy ve")])
def test_remove_accents(spark, given, wanted):
    assert one(spark, given, T.remove_accents) == wanted


def test_normalise(spark):
    assert one(spark, "Hủy vé Đặt chỗ", T.normalise) == "huy ve dat cho"


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("20kg", ["20", "kg"]), ("mang 20kg hành lý", ["mang", "20", "kg", "hanh", "ly"]), ("a b hanh ly", ["hanh", "ly"]), ("hành lý 7kg", ["hanh", "ly", "kg"]), ("手荷物", ["手荷", "荷物"]), ("行李规定", ["行李", "李规", "规定"]),
        ("犬", ["犬"]), ("がか", ["がか"]), ("カード", ["カー", "ード"]), ("各々", ["各々"]), ("ﾍﾟｯﾄ", ["ペッ", "ット"]), (None, []), ("   ", []), ("!?", []),
    ],
)
def test_tokenize(spark, given, wanted):
    assert one(spark, given, T.tokenize) == wanted


def test_tokenize_mixed(spark):
    found = one(spark, "VNPAYで支払う", T.tokenize)
    assert "vnpay" in found and "支払" in found


@pytest.mark.parametrize("given", ["A", "đ", " ", "・", "゛"])
def test_not_cjk(spark, given):
    assert one(spark, given, T.contains_cjk) is False


def test_long_text(spark):
    assert len(one(spark, "hành lý " * 100_000, T.tokenize)) == 200_000


@pytest.mark.parametrize("given, wanted", [(" VI\t", "vi"), ("", None), ("  ", None), (None, None), ("　EN　", "en")])
def test_normalise_lang(spark, given, wanted):
    assert one(spark, given, T.normalise_lang) == wanted


def test_helpers(spark):
    assert one(spark, None, T.case_lang) == "vi"
    assert one(spark, "qwen:9b/t0", T.slug) == "qwen-9b-t0"
    assert one(spark, "postgres://u:secret@h/db", T.redact) == "postgres://u:***@h/db"
    assert one(spark, "hành lý", T.has_accents) is True and one(spark, "hanh ly", T.has_accents) is False


def test_compatibility_forms(spark):
    """As the full compatibility form, for whatever holds CJK characters."""
    import unicodedata

    texts = ["ｶﾞｲﾄﾞ", "か゛", "か\u3099く", "㋐㍿㌀", "豈更", "\U0002f800", "㈱旅", "abc", "ﾊﾟﾘ ﾎﾟｽﾄ", "⼀⿕"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.compatibility(F.col("t"))).collect()]
    keep = lambda s: [c for c in unicodedata.normalize("NFKC", s) if T._is_cjk(c)]
    assert [[c for c in g if T._is_cjk(c)] for g in got] == [keep(t) for t in texts]
