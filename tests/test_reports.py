import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from weftlake import reports
from weftlake.operators import prompts
from weftlake.sources import cache, endpoints, files, jdbc, models

KB = "\n".join(f"- docId: d{i}\n  title: T{i}\n  category: {k}\n  content: {c}\n  lang: en" for i, (c, k) in enumerate([("seats by the window", "SEAT"), ("dogs travel in a box", "PETS"), ("refund to your card", "PAY"), ("cats travel in a box", "PETS")]))
GOLDEN = "- query: dogs in a box\n  expected: [d1]\n  lang: en\n- query: money refund\n  expected: [d2]\n  lang: en\n- query: seats\n  expected: [d0]\n  lang: en\n"


@pytest.fixture()
def data(spark, tmp_path):
    (tmp_path / "kb.yml").write_text(KB)
    (tmp_path / "golden.yml").write_text(GOLDEN)
    texts = ["T0. seats by the window", "T1. dogs travel in a box", "T2. refund to your card", "T3. cats travel in a box", "dogs in a box", "money refund", "seats"]
    place = [0, 1, 2, 3, 3, 2, 0]
    spark.createDataFrame([(t, [float(j == p) + 0.7 * (j == 1 and p == 3) for j in range(4)]) for t, p in zip(texts, place, strict=True)], "text string, embedding array<float>").write.parquet(str(tmp_path / "v"))
    return ["--kb", str(tmp_path / "kb.yml"), "--golden", str(tmp_path / "golden.yml"), "--vectors", str(tmp_path / "v")]


def test_by_category(data, capsys):
    assert reports.main(["by-category", *data]) == reports.DONE
    out = capsys.readouterr().out.splitlines()
    assert out[0].split()[1] == "PETS" and out[3].split()[1] == "gộp" and "same category: 1" in out and "first hit from vector: 1" in out


def test_p1_diff(data, capsys):
    assert reports.main(["p1-diff", *data, "--lang", "en"]) == reports.DONE
    assert capsys.readouterr().out.strip() == ""


def test_embed_compare(data, capsys):
    assert reports.main(["embed-compare", *data]) == reports.DONE
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 3 and "least 0.00" in lines[1] and "plain" in lines[1]


def test_missing_vectors(spark, data, tmp_path):
    spark.read.parquet(data[-1]).limit(2).write.parquet(str(tmp_path / "few"))
    assert reports.main(["by-category", *data[:-1], str(tmp_path / "few")]) == reports.NO_VECTORS


def test_sheets(spark, tmp_path, capsys):
    items = "\n".join(f"- id: i{i}\n  query: q{i}\n  tra_loi: |\n    a{i}\n    b\n  nhan_tay: {h!r}\n  nhan_judge: bia" for i, h in enumerate(["bia", "", "co_can_cu"]))
    (tmp_path / "run.yml").write_text("- _meta:\n    model: m\n" + items)
    assert reports.main(["judge-check", "--items", str(tmp_path / "run.yml")]) == reports.BAD_DATA
    assert reports.main(["run-table", "--items", str(tmp_path / "run.yml")]) == reports.DONE
    assert "judged 3" in capsys.readouterr().out
    assert reports.main(["blind-sheet", "--items", str(tmp_path / "run.yml"), "--out", str(tmp_path / "blind.yml"), "--earlier", str(tmp_path / "run.yml")]) == reports.DONE
    got = [json.loads(r.json) for r in files.read_items(spark, str(tmp_path / "blind.yml")).orderBy("pos").collect()]
    assert [r["name"] for r in got] == ["c01", "c02", "c03"] and {r["id"]: r["nhan_tay"] for r in got} == {"i0": "bia", "i1": "", "i2": "co_can_cu"} and all(r["tra_loi"].endswith("\nb\n") for r in got)


def test_sheet_values_read_back():
    import yaml

    rows = [{"a": v, "odd name": 1} for v in ("x", "", "two\nlines", "end\n", "end\n\n", " lead\nx", "\nx", "a: b # c", "- x", "null", "1", "tab\tx\ny", "bell\x07\nx", None, 3, 2.5, True, ["x"], {"k": "v"})]
    assert yaml.safe_load("\n".join(files.sheet_lines(rows, "head"))) == rows and yaml.safe_load("\n".join(files.sheet_lines([]))) == []


def test_settings(tmp_path, monkeypatch):
    for name in ("WL_C", "WL_D", "WL_E", "WL_F"):
        monkeypatch.delenv(name, raising=False)
    (tmp_path / ".env").write_text("WL_C = a=b \n  export WL_D=\"x # y\"\n#WL_E=1\nWL_F=\nWL_C=later\n")
    assert files.load_env_file(str(tmp_path / ".env")) == ["WL_C", "WL_D", "WL_F"] and files.load_env_file(str(tmp_path / "none")) == []
    import os

    assert (os.environ["WL_C"], os.environ["WL_D"], os.environ["WL_F"]) == ("a=b", "x # y", "")
    for name in ("WL_C", "WL_D", "WL_F"):
        monkeypatch.delenv(name)
    with pytest.raises(LookupError):
        jdbc.database_url("WL_URL")


def test_prompt_variants(tmp_path):
    (tmp_path / "chat.txt").write_text("plain")
    (tmp_path / "chat_short.txt").write_text("short")
    assert prompts.template_of(str(tmp_path), "chat") == "plain" and prompts.template_of(str(tmp_path), "chat", "short") == "short"
    with pytest.raises(FileNotFoundError):
        prompts.template_of(str(tmp_path), "chat", "none")


def test_reply_keys(spark):
    assert cache.reply_key("u", {"b": {"y": 1, "x": 2}, "a": 3}) == cache.reply_key("u", {"a": 3, "b": {"x": 2, "y": 1}})
    df = spark.createDataFrame([("u", '{"b":1,"a":{"d":1,"c":2}}'), ("u", '{"a":{"c":2,"d":1},"b":1}'), ("u", "broken"), (None, "{}")], "url string, body string")
    keys = [r.key for r in cache.reply_keys(df, "url", "body").collect()]
    assert keys[0] == keys[1] and keys[2:] == [None, None]


class Service(BaseHTTPRequestHandler):
    busy = 1

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if Service.busy:
            Service.busy -= 1
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if "input" in body:
            reply = {"data": [{"index": i, "embedding": [float(len(t)), float(body.get("dimensions", 0))]} for i, t in reversed(list(enumerate(body["input"])))]}
        else:
            reply = {"choices": [{"message": {"content": body["messages"][1]["content"].upper()}}], "usage": {"completion_tokens": 2}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *args):
        pass


def test_endpoints(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        known = {"own": {"url": f"http://127.0.0.1:{server.server_port}/v1", "model": "m", "key_variables": ["A", "B"]}}
        e = endpoints.endpoint_of("own", known, {"B": "k"})
        assert e.key == "k" and e.available and not endpoints.endpoint_of("own", known, {"B": "changeme"}).available
        with pytest.raises(LookupError):
            endpoints.endpoint_of("other", known)
        quick = models.Policy(interval=0.0)
        assert models.with_retry(lambda: endpoints.Embeddings(e, 7)(["a", "bbb"]), quick) == [[1.0, 7.0], [3.0, 7.0]]
        got = models.complete(spark.createDataFrame([("1", "s", "hi")], "key string, system string, user string"), endpoints.Chat(e), quick).first()
        assert (got.text, got.completion_tokens, got.prompt_tokens, got.error) == ("HI", 2, None, None)
    finally:
        server.shutdown()
