import pytest

from weftlake.llm import language, pairs


@pytest.fixture(scope="module")
def profiles():
    return language.fit(language._training([]))


FULL = ["The train leaves from platform 4 every morning.", "Tickets are sold at the counter next to the gate.", "You can change your seat until an hour before it leaves.", "Dogs must travel in a closed box on this line."]


def test_defects(spark, profiles):
    rows = [(f"f{i}", "When and where can I go?", a) for i, a in enumerate(FULL)]
    rows += [
        ("empty", "q is this", None), ("blank", "q is this", " ​"), ("null", "q is this", "N/A"), ("fence", "q is this", "```\n```"),
        ("copy", "How do I get my money back?", "how do i get my money back"), ("quoted", "How do I get my money back?", 'You asked: "How do I get my money back?"'), ("twice", "where is it", "where is it? where is it?"),
        ("refusal", "How do I get home", "Sorry, I do not have any details on that. Is there anything else?"), ("informs", "How do I get home", "Sorry for the trouble. The train leaves from platform 9 every morning."),
        ("cut", "When and where can I go?", "Dogs must travel in a closed box on this line. Tickets are sold at the coun"), ("dots", "When and where can I go?", "You can change your seat until…"),
        ("stop", "When and where can I go?", "Dogs must travel in a closed box on this line"), ("face", "When and where can I go?", "Dogs must travel in a closed box on this line 🙂"),
        ("lang", "When and where can I go with my dog?", "请提前到检票口，并打开二维码，谢谢您的支持。"), ("noq", None, "Tickets are sold at the counter next to the gate."), ("empty", "q is this", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, query string, tra_loi string, rule string")
    got = sorted((r.id, r.defect) for r in pairs.defects(df, "id", "query", "tra_loi", profiles).collect())
    assert got == sorted([("empty", "empty"), ("blank", "empty"), ("null", "empty"), ("fence", "empty"), ("copy", "copy"), ("quoted", "copy"), ("twice", "copy"), ("refusal", "refusal"), ("cut", "truncated"), ("dots", "truncated"), ("lang", "other_lang")])
    assert pairs.defects(df.where("false"), "id", "query", "tra_loi", profiles).collect() == []


def test_length_limit(spark):
    parts = spark.createDataFrame([(i, 100 + i % 40, None) for i in range(200)] + [(1000 + i, 77, "frag") for i in range(40)], "id long, length long, fragment string")
    assert [r.length for r in pairs.length_limits(parts).collect()] == [77]


@pytest.mark.parametrize("text, wanted", [("Done.", (None, None)), ("Done. And the", "and the"), ("Done. ✅", (None, None)), ("", (None, None)), ("see a@b.example now", "see a@b.example now")])
def test_unfinished(text, wanted):
    got = pairs.unfinished(text)
    assert got == wanted if isinstance(wanted, tuple) else got[0] == wanted


def test_frequent_length_is_not_truncated(spark, profiles):
    """A complete answer without its stop, and such a refusal, under many ids."""
    line, refusal = FULL[3].rstrip("."), "Sorry, I do not have any details on that"
    rows = [(f"f{i}", "When and where can I go?", a) for i, a in enumerate([*FULL, f"{refusal}. Is there anything else?"])]
    rows += [(f"{kind}{i}", "When and where can I go?", a) for kind, a in (("line", line), ("refusal", refusal)) for i in range(30)]
    got = {r.id: r.defect for r in pairs.defects(spark.createDataFrame(rows, "id string, query string, tra_loi string"), "id", "query", "tra_loi", profiles).collect()}
    assert got == {"f4": "refusal", **{f"refusal{i}": "refusal" for i in range(30)}}
