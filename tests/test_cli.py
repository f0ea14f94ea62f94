import json

from weftlake import cli

KB = "\n".join(f"- docId: d{i}\n  title: T{i}\n  content: {c}\n  lang: {lang}" for i, (c, lang) in enumerate([("hành lý xách tay bảy ký", "vi"), ("hoàn tiền về thẻ", "vi"), ("dogs travel in a box", "en"), ("refund to your card", "en")]))
GOLDEN = "- query: hanh ly xach tay\n  expected: [d0]\n- query: dogs in a box\n  expected: [d2]\n  lang: en\n"


def run(tmp_path, golden, *more):
    (tmp_path / "kb.yml").write_text(KB)
    (tmp_path / "golden.yml").write_text(golden)
    return cli.main(["--kb", str(tmp_path / "kb.yml"), "--golden", str(tmp_path / "golden.yml"), *more])


def test_passes(spark, tmp_path, capsys):
    assert run(tmp_path, GOLDEN, "--json") == cli.PASSED
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert {(r["config"], r["lang"], r["mrr"]) for r in rows} == {(c, x, 1.0) for c in ("BM25", "BM25 + lang") for x in ("vi", "en", "gộp")}


def test_below_and_bad_data(spark, tmp_path, capsys):
    assert run(tmp_path, GOLDEN + "- query: nothing like it\n  expected: [d3]\n  lang: en\n") == cli.BELOW
    assert "nothing like it" in capsys.readouterr().out
    assert run(tmp_path, "- query: x\n  expected: [zzz]\n") == cli.BAD_DATA


def test_vectors(spark, tmp_path, capsys):
    texts = ["T0. hành lý xách tay bảy ký", "T1. hoàn tiền về thẻ", "T2. dogs travel in a box", "T3. refund to your card", "hanh ly xach tay", "dogs in a box"]
    rows = [(t, [float(j == i % 4 if i < 4 else j == (0 if i == 4 else 2)) for j in range(4)]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "text string, embedding array<float>").write.parquet(str(tmp_path / "v"))
    assert run(tmp_path, GOLDEN, "--vectors", str(tmp_path / "v"), "--variants") == cli.PASSED
    assert "Rerank + lang" in capsys.readouterr().out
    spark.createDataFrame(rows[:3], "text string, embedding array<float>").write.parquet(str(tmp_path / "w"))
    assert run(tmp_path, GOLDEN, "--vectors", str(tmp_path / "w")) == cli.NO_VECTORS
