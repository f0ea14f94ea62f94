import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlake.llm import abuse as A
from weftlake.llm import abuse_texts as X

BACKGROUND = ["The bus leaves at noon. Please keep your seat during the ride. Tickets are sold at the counter.", "Xe chạy lúc trưa. Vé bán tại quầy. Hành lý gửi ở cửa sau.", "バスは正午に出ます。切符は窓口で買えます。", "大巴中午出发。车票在柜台出售。"] * 10


@pytest.fixture(scope="module")
def weights():
    return A.fit_on_texts(BACKGROUND)


def flagged(weights, *texts):
    s = weights.scores(weights.table(), [A.normalised(t) for t in texts])
    return list(s > 0)


def test_plain_and_disguised(weights):
    bad = ["fuck you and your train", "F U C K you and your train", "f*ck you and your ferry", "fuuuuck you and your coach", "ｆｕｃｋ you and your coach", "fu​ck you and your coach", "what fucking 1d10ts", "đ* ngu, làm ăn như chó", "do ngu, lam an nhu cho", "死・ね、クズ運転手", "你们这群傻*逼", "<p>you stupid morons, go to hell</p>"]
    assert all(flagged(weights, *bad))


def test_clean(weights):
    good = ["Sexual harassment on board can be reported to the crew at any time.", "My cocker spaniel slept in her crate.", "Bé ngủ ngu ngơ suốt chặng, thương lắm.", "手数料も馬鹿にならない金額です。", "请把垃圾带下车。", "The bus leaves at noon.", "Tickets are sold at the counter.", "12:30"]
    assert not any(flagged(weights, *good))


def test_held_out_accuracy():
    """Trained on words and frames alone; the whole sentences of the labelled text are kept from training."""
    w = A.fit_on_texts(BACKGROUND, own=False)
    recall = [np.mean(flagged(w, *group)) for group in X.ABUSIVE.values()]
    false = [np.mean(flagged(w, *group)) for group in X.CLEAN.values()]
    assert min(recall) > 0.85 and np.mean(recall) > 0.9 and max(false) < 0.3 and np.mean(false) < 0.15


def test_training_sentences_stand_in_no_table():
    from pathlib import Path

    import pyarrow.parquet as pq

    for path in Path("/root/testdata").glob("sf*/documents.parquet"):
        texts = "\n".join(t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t).lower()
        for group in [*X.ABUSIVE.values(), *X.CLEAN.values()]:
            assert not [s for s in group if s.lower() in texts], path


def test_saved_model(spark, weights, tmp_path):
    A.save(spark, weights, str(tmp_path / "m"))
    again = A.load(spark, str(tmp_path / "m"))
    texts = [A.normalised(t) for t in ("you stupid morons, go to hell", "The bus leaves at noon.")]
    assert np.allclose(weights.scores(weights.table(), texts), again.scores(again.table(), texts))


def test_worst_stretch_counts_not_length(weights):
    long = "The bus leaves at noon. " * 5000
    assert flagged(weights, long, long + "you stupid morons, go to hell " + long) == [False, True]


def test_runs_against_brute_force():
    rng = np.random.default_rng(1)
    gain = rng.normal(size=60).astype(np.float32)
    cps = np.full(60, 97)
    cps[[14, 15, 40, 59]] = 0
    gain[cps == 0] = 0
    top, (start, stop) = A._runs(gain, cps)
    bounds = [(0, 15), (15, 16), (16, 41), (41, 60)]
    for k, (a, b) in enumerate(bounds):
        best = max(gain[i : j + 1].sum() for i in range(a, b) for j in range(i, b))
        assert abs(top[k] - best) < 1e-3 and abs(gain[start[k] : stop[k] + 1].sum() - best) < 1e-3


def test_tables(spark, weights):
    df = spark.createDataFrame([(1, "you stupid morons, go to hell", "a", 1.0), (2, None, "a", 1.0), (3, "", None, 1.0), (4, "The bus leaves at noon.", "a", 1.0)], "doc_id long, text string, source string, score double")
    scored = A.score(df, "doc_id", "text", weights, keep=["source"])
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got[1] > 0.9 and got[2] == got[3] == 0.0 and got[4] < 0.5
    assert {(r.source, r.documents, r.abusive) for r in A.rates(scored, "source").collect()} == {("a", 3, 1), (None, 1, 0)}
    assert A.score(df.where("false"), "doc_id", "text", weights).collect() == []
    assert A.fit_on_sample(df.where("false"), "text").hashes.size > 0


def test_repeated_abuse_is_not_clean():
    """However many texts hold it, also behind a beginning that clean sentences share."""
    bad = ["those filthy liars can rot", "the clerk is a stupid lying pig", "đồ chó má lừa đảo"]
    tail = [f"Booking {c * 3} was kept." for c in "abcdefghijkl"]
    assert all(flagged(A.fit_on_texts(BACKGROUND, [f"{s}. {t}" for s in bad for t in tail]), *bad))
    start = "at the calder bay counter the"
    w = A.fit_on_texts(BACKGROUND, [f"{start} {x}. {t}" for x in ("man sold bread", "clerk is a stupid lying pig") for t in tail])
    assert flagged(w, f"{start} clerk is a stupid lying pig", f"{start} man sold bread") == [True, False]


def test_score_is_the_documents_own(spark, weights):
    """The same with other documents around it, in whatever order; these do not train."""
    rows = [(0, "The lying crooks at the counter should rot."), *((i, f"The counter should rotate. Booking {i} was kept.") for i in range(1, 12))]
    got = [A.score(spark.createDataFrame(part, "doc_id long, text string").coalesce(1), "doc_id", "text", weights).where("doc_id = 0").first().score for part in (rows[:1], rows, rows[::-1])]
    assert got[0] == got[1] == got[2]


def test_unlabelled_abuse_does_not_train():
    bad = "you are a stupid worthless moron"
    assert flagged(A.fit_on_texts(BACKGROUND, [bad] * 50 + BACKGROUND), bad) == [True]


def test_samples_by_hash(spark):
    df = spark.createDataFrame([(f"text {i % 40}",) for i in range(200)] + [(None,)], "t string")
    assert len(A.sample(df, "t", 10)) == 10 and A.sample(df, "t", 10) == A.sample(df.orderBy(F.desc("t")), "t", 10) and A.sample(df.where("false"), "t", 10) == []
