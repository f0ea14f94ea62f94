import pytest

from weftlake.llm import language as L


@pytest.fixture(scope="module")
def profiles():
    return L.fit(L._training([]))


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Xin cho hỏi chuyến tàu này khi nào đến nơi", ["vi"]), ("toi muon hoi ve chuyen di ngay mai co duoc khong", ["vi"]), ("When does this train arrive at the station", ["en"]), ("この電車は何時に着きますか", ["ja"]), ("这趟火车什么时候到站", ["zh"]),
        ("払戻手続方法、座席変更可否", ["ja"]), ("座位能保留几分钟", ["zh"]), ("When does this train arrive?\nこの電車は何時に着きますか", ["en", "ja"]), ("tôi muốn hỏi về chuyến đi ngày mai / 这趟火车什么时候到站", ["vi", "zh"]),
        (None, []), ("", []), ("  ", []), ("12:30 !!", []), ("ok", []), ("👍", []), ("AB-1234", []),
    ],
)
def test_classify(profiles, text, wanted):
    assert L.classify(profiles, [text])[0][0] == wanted


def test_batch_equals_single(profiles):
    texts = ["Hello, how are you today my friend", None, "这趟火车什么时候到站", "", "Tôi đi học ở trường này mỗi ngày"]
    assert [x[0] for x in L.classify(profiles, texts)] == [L.classify(profiles, [t])[0][0] for t in texts]


def test_bound_vectors_are_nearly_orthogonal():
    a, b = L.gram_vector((97 << 42) | (98 << 21) | 99), L.gram_vector((99 << 42) | (98 << 21) | 97)
    assert abs(int(a.astype(int) @ b.astype(int))) < 6 * L.DIMENSIONS**0.5 and int(a.astype(int) @ a.astype(int)) == L.DIMENSIONS


def test_memory_equals_full_vectors(profiles):
    import numpy as np

    units = L.Units(["hello there, this is a test"])
    codes, owner = units.grams()
    bundle = sum(L.gram_vector(int(c)).astype(float) for c in codes[owner == 0])
    n = (owner == 0).sum()
    assert np.allclose(profiles.cosines(units)[0], profiles.matrix @ bundle / np.sqrt(n * L.DIMENSIONS), atol=1e-4)


def test_tables(spark, profiles):
    df = spark.createDataFrame([(1, "When does this train arrive at the station", "x"), (2, None, "x"), (3, "When does this train arrive?\nこの電車は何時に着きますか", "x"), (1, "When does this train arrive at the station", "x")], "id long, text string, languages string")
    got = {r.id: r for r in L.detect(df, "id", "text", profiles).collect()}
    assert got[1].languages == ["en"] and got[2].languages == [] and got[2].confidence == 0.0 and got[3].mixed and got[1].confidence > 0.9
    parts = [(r.segment, r.lang) for r in L.segment(df.where("id = 3"), "id", "text", profiles).orderBy("segment").collect()]
    assert parts == [(0, "en"), (1, "ja")]
    assert L.detect(df.where("false"), "id", "text", profiles).collect() == [] and L.segment(df.where("false"), "id", "text", profiles).collect() == []


def test_long_text(profiles):
    assert L.classify(profiles, ["This is a long text about trains and stations. " * 20_000])[0][0] == ["en"]
