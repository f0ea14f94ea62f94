import pytest

from weftlake.llm import privacy as P


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("write to Ann.Lee+1@mail.example, please", [("email", "Ann.Lee+1@mail.example")]), ("mail x_y [at] m.test now", [("email", "x_y [at] m.test")]), ("a @ b . test", [("email", "a @ b . test")]), ("邮箱是k＠m.test。", [("email", "k＠m.test")]),
        ("call (+84) 984-555-028", [("phone", "(+84) 984-555-028")]), ("máy 0937 555 181, cảm ơn", [("phone", "0937 555 181")]), ("o985555307", [("phone", "o985555307")]), ("(229) 555-0112", [("phone", "(229) 555-0112")]), ("電話番号は０８０５２６４７４０１です", [("phone", "０８０５２６４７４０１")]),
        ("passport AR1616503", [("id_number", "AR1616503")]), ("booking TR-987897 and SE123456", []), ("hotline 1900 5550 or help@vexa.example", []), ("costs 39574880đ", []), (None, []),
        ("mình ở số 43 ngõ 16 đường Hoa Sim, phường Kim Sa", [("address", "43")]), ("I live at Apt 8A, 252 Old Quarry St, Port Lindley", [("address", "8")]), ("我住在青澜区长乐街175号", [("address", "175")]), ("住所は青葉口区若葉1-10-8です", [("address", "1")]), ("10番線の5号車ですか", []),
        ("my name is Nora P. Smith and my email is n@m.test", [("email", "n@m.test"), ("name", "Nora P. Smith")]), ("đặt cho Nguyễn Gia Khoa 2 vé", [("name", "Nguyễn Gia Khoa")]), ("đặt cho gia đình mình 2 vé", []), ("名前は東雲 航平です", [("name", "東雲 航平")]), ("给温雨桐订2张票", [("name", "温雨桐")]),
    ],
)
def test_nominations(text, wanted):
    assert sorted((k, v) for k, v, _, _, _, prior, *_ in P.propose(text or "") if prior >= P.PRIOR) == sorted(wanted)


def test_corpus_decides_what_is_weak(spark):
    rows = [("my name is Thea Drayle and my email is a@b.test",)] * 1 + [("Contact: Thea Drayle / 222-555-0139",), ("thanks, Thea Drayle",), ("thanks, that was all",), ("I have noted your kind request, please check",)]
    rows += [("hộ chiếu C2962669 bị sai",), ("hộ chiếu 091262056540 bị sai",), ("mã đơn 202190711113 đâu",), ("mã đơn 202190711114 đâu",), (None,), ("",), ("that was all for the day, thanks",)]
    df = spark.createDataFrame([("t", i, r[0], "clash") for i, r in enumerate(rows)], "tbl string, row_id long, content string, kind string")
    df = df.unionByName(df)
    got = {(r.row_id, r.kind, r.val) for r in P.findings(df).collect()}
    assert {(2, "name", "Thea Drayle"), (6, "id_number", "091262056540"), (5, "id_number", "C2962669")} <= got
    assert not any(r in (3, 4, 7, 8) for r, _, _ in got) and P.findings(df).count() == len(got)
    clean = {r.row_id: r.content for r in P.sanitise(df, P.findings(df)).collect()}
    assert clean[1] == "Contact: [NAME] / [PHONE]" and clean[3] == "thanks, that was all" and clean[9] is None and len(clean) == len(rows)
    assert P.findings(df.where("false")).collect() == []


def of(spark, *texts):
    return spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tbl string, row_id long, content string")


def test_forms_and_names_that_are_not_in_the_code(spark):
    """A name in a frame of no list is known by its words; a common phrase of capitals is none; unknown capitals stay."""
    known = [f"my name is {n} and I wait" for n in ("Thea Drayle", "Orla Venn", "Thea Venn", "Milo Drayle", "Orla Drayle")] * 3
    other = ["Regards, Orla Drayle wrote", "please ask Milo Venn about it", "the Harbour Line stops at Stone Gate", "Ask Quentin Obst today"] * 2
    got = {(r.row_id, r.val) for r in P.findings(of(spark, *known, *other)).collect() if r.kind == "name"}
    first = len(known)
    assert {(first, "Orla Drayle"), (first + 1, "Milo Venn")} <= got
    assert not any(v in ("Harbour Line", "Stone Gate", "The Harbour Line", "Quentin Obst", "Ask Quentin Obst") for _, v in got)


def test_the_corpus_overrules_a_form(spark):
    """A shape that never stands beside a word for its kind reveals nothing, however much it looks like a telephone."""
    serial = [f"serial 0912{i:06d} of the pump" for i in range(200)]
    assert P.findings(of(spark, *serial)).count() == 0
    assert P.findings(of(spark, *serial[:1])).count() == 1  # hardly shown by the corpus, the prior decides
    called = [f"please call 0912{i:06d} now" for i in range(60)]
    assert P.findings(of(spark, *called)).count() == 60


def test_places_and_bits(spark):
    text = "call 0937 555 181 or 0937 555 181, mail a@b.test"
    got = sorted((r.kind, r.start, r.stop, r.val) for r in P.findings(of(spark, text)).collect())
    assert got == [("email", 40, 48, "a@b.test"), ("phone", 5, 17, "0937 555 181"), ("phone", 21, 33, "0937 555 181")]
    assert all(r.bits > 0 for r in P.findings(of(spark, *[text] * 3, "no data here at all, just words and words")).collect())


def test_replaced_by_place():
    assert P.masked("An and Annex, An", [(0, 2, "name")]) == "[NAME] and Annex, An"  # too short to be looked for elsewhere
    assert P.masked("Thea Bo, Thea Bode, Thea Bo", [(0, 7, "name")]) == "[NAME], Thea Bode, [NAME]"
    assert P.masked("我叫王小明。王小明", [(2, 5, "name")]) == "我叫[NAME]。[NAME]"
    assert P.masked("a 1 b", [(2, 3, "phone"), (0, 5, "address")]) == "[ADDRESS]"


def test_long_text():
    assert [v for _, v, *_ in P.propose("lorem ipsum " * 50_000 + " write to a@b.test")] == ["a@b.test"]


def test_bits():
    assert P.disclosure_bits(8, 8, 1 / 16) == 4.0
