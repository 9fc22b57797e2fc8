"""The runner, its jobs, reports and tables, and the client of recogniser services."""

import base64
import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udfs
from quillspark.operators import benchmark, boxes, detection, recognition, reporting
from quillspark.operators import experiments as E
from quillspark.plans.queries import CONFIG

NOW = datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture(scope="module")
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

        def do_GET(self):
            self.answer(200, {"status": "ok"})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            if body["options"].get("fail"):
                return self.answer(*body["options"]["fail"])
            texts = [base64.b64decode(x).decode().upper() + " " for x in body.get("images_base64", [])]
            if self.path == "/predict":
                return self.answer(200, {"text": base64.b64decode(body["image_base64"]).decode() + "!"})
            self.answer(200, {"texts": texts} if self.path == "/predict_batch" else {"loaded": True})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


@pytest.fixture
def images(tmp_path):
    for name, text in (("doc_1.png", "ala ma"), ("doc_2.png", "kota"), ("other.jpg", "x")):
        open(f"{tmp_path}/{name}", "w").write(text)
    open(f"{tmp_path}/labels.csv", "w").write("file_name,label,note\ndoc_1.png,ALA MA,\ngone.png,?,\ndoc_2.png,KOTY,\nother.png,007,\n")
    return str(tmp_path)


def test_client(service, images):
    url, asked = service
    client = udfs.Service(url + "/", {"a": 1})
    assert client.health() == {"status": "ok"} and client.load() == {"loaded": True} and asked[-1] == ("/load", {"options": {"a": 1}})
    assert client.predict(f"{images}/doc_2.png") == "kota!" and client.predict_batch([f"file:{images}/doc_1.png"]) == ["ALA MA"]
    before = len(asked)
    assert client.predict_images([]) == [] and len(asked) == before
    for fail, said in (([400, {"detail": "bad image"}], "bad image"), ([500, {"x": 1}], '{"x": 1}'), ([418, "plain"], "plain")):
        body = [fail[0], fail[1]] if not isinstance(fail[1], str) else [fail[0], fail[1]]
        with pytest.raises(udfs.ServiceError, match="HTTP"):
            udfs.Service(url, {"fail": body}).predict_batch([f"{images}/doc_1.png"])
        assert said in udfs.error_detail(fail[0], "/predict", fail[1] if isinstance(fail[1], str) else json.dumps(fail[1]))
    assert udfs.error_detail(502, "/load", " ") == "HTTP 502 from /load"
    with pytest.raises(udfs.ServiceError, match="object"):
        udfs.Service(url, {"fail": [200, ["x"]]}).load()
    with pytest.raises(FileNotFoundError):
        client.predict_batch([f"{images}/none.png"])


def test_run(spark, service, images, tmp_path):
    url, _ = service
    data = {"labels_csv": f"file://{images}/labels.csv", "images_dir": f"file://{images}"}
    config = {
        "experiment": {"name": "try it"}, "settings": {"auto_start_services": True, "export_overleaf_table": True},
        "models": [{"id": "m_1", "url": url}, {"id": "off", "enabled": False}, {"id": "ill", "url": None}],
        "datasets": [{"id": "words", "single_words": True, "limit": None, **data}, {"id": "one", **data}, {"id": "bad", **data, "labels_csv": f"file://{images}/no.csv"}],
    }

    def load(model):
        if not model["url"]:
            raise RuntimeError("not well")
        return udfs.http_recogniser(model["url"])

    told = []
    folder, outcomes = benchmark.run(spark, config, load, f"{tmp_path}/out", NOW, note=told.append)
    got = [(r.model, r.data_set, r.status) for r in outcomes.collect()]
    assert got == [("m_1", "words", "ok"), ("m_1", "one", "ok"), ("m_1", "bad", "data set failed"), ("ill", None, "model failed")]
    one = json.load(open(f"{folder}/m_1/words/summary_metrics.json"))
    assert one["metrics"]["word"]["count"] == 2 and one["metrics"]["word"]["cer"] == pytest.approx(1 / 10) and one["timing"]["prediction_samples"] == 2
    assert json.load(open(f"{folder}/m_1/one/summary_metrics.json"))["metrics"]["line"]["count"] == 1  # a limit that is not given is one
    assert spark.read.option("header", True).csv(f"{folder}/m_1/words/raw_predictions").count() == 2
    assert told[0]["m_1/words/metrics_level"] == "word" and told[0]["m_1/words/metrics/cer"] == pytest.approx(0.1)
    table = open(f"{folder}/overleaf_tables.tex").read()
    assert r"\caption{Wyniki dla datasetu words}" in table and r"Model & EMA & NPM & CER & WER & LevDist & AvgTimeS \\" in table
    assert r"m\_1 & 0.5000 & 1.0000 & 0.1000" in table and "ill & n/a & n/a" in table and table.count(r"\begin{table}") == 3
    _, none = benchmark.run(spark, config | {"settings": {}}, load, f"{tmp_path}/off", NOW)
    assert none.count() == 0


def test_recognition_needs_as_many_texts(spark):
    df = spark.createDataFrame([("a.png",), ("b.png",)], "image_path string")
    with pytest.raises(Exception, match="1 predictions for 2 samples"):
        udfs.recognise(df.coalesce(1), lambda: lambda paths: ["x"]).collect()
    assert [r.prediction for r in udfs.recognise(df, lambda: udfs.one_by_one(lambda p: p[0])).orderBy("image_path").collect()] == ["a", "b"]
    boxed = udfs.detect(spark.createDataFrame([(1, b"ab"), (2, b"")], "image_id long, content binary"), lambda: lambda c: [(i, 0, 2, 3, 0.5) for i in range(len(c))], ["image_id"])
    assert [tuple(r) for r in boxed.orderBy("pred").collect()] == [(1, 0, 0.0, 0.0, 2.0, 3.0, 0.5), (1, 1, 1.0, 0.0, 2.0, 3.0, 0.5)]


def test_jobs(spark):
    jobs = E.commands(E.matrix(spark, CONFIG), CONFIG, local=True)
    rows = jobs.orderBy("ord").collect()
    assert [(r.kind, r.exp_id) for r in rows[:3]] == [("train", "yolov8n_ft-raw"), ("predict", "yolov8n_ft-raw_eval-raw"), ("eval", "yolov8n_ft-raw_eval-raw")]
    assert rows[0].argv[:3] == ["python", "docker/ultralytics/cli.py", "train"] and len(rows) == 6 + 2 * 18
    done = spark.createDataFrame([("results/checkpoints/yolov8n_ft-raw/train/weights/best.pt",), ("results/metrics/mask_ft-raw_eval-raw.json",)], "path string")
    asked, log = [], []

    def execute(argv):
        asked.append(argv)
        if "surya" in " ".join(argv):
            raise OSError
        return int("kraken" in argv[1])

    out = E.run(jobs, done, execute, log=lambda *x: log.append(x))
    assert out["skip"] == ["train yolov8n_ft-raw", "eval mask_ft-raw_eval-raw"] and len(log) == len(asked) == len(rows) - 2
    assert len(out["failed"]) == 2 + 6 + 4 and ("train", "blla_ft-raw", "failed") in log  # kraken's runs, surya's predictions and evaluations
    assert len(E.run(jobs, done, execute, dry_run=True)["would"]) == len(rows) - 2
    assert len(E.run(E.selected(jobs, "mask", "train"), done, execute, force=True)["ok"]) == 2


def test_options():
    assert E.languages(" pl, en,,") == ["pl", "en"] and E.languages(" ,") == ["pl"]
    assert [E.as_bool(x) for x in (True, "Yes", "0", None, 2)] == [True, True, False, False, True] and E.as_bool(None, True)
    assert E.device("Auto", True) == "cuda" and E.device("cpu", False) == "cpu" and E.device("auto", False, must=False) == "cpu"
    for name, error in (("auto", RuntimeError), ("cuda", RuntimeError), ("tpu", ValueError)):
        with pytest.raises(error):
            E.device(name, False)
    assert [E.number_type(*x) for x in (("BFloat16",), ("auto",), ("auto", True), ("auto", True, True))] == ["bfloat16", "float32", "float16", "bfloat16"]
    assert E.base_url("trocr") == "http://localhost:8002" and E.base_url("trocr", "http://x/") == "http://x"
    assert [E.timeout(*x) for x in (("kraken",), ("trocr",), ("kraken", 5))] == [600.0, 60.0, 5.0]
    entry = E.service_entry("easyocr", {"easyocr_langs": "pl, en", "easyocr_device": "cpu", "trocr_device": "cuda", "http_base_url": None})
    assert entry == {"id": "easyocr", "base_url": "http://localhost:8001", "timeout": 60.0, "options": {"langs": ["pl", "en"], "device": "cpu"}}
    assert E.sample_limit({}) == 1 and E.sample_limit({"limit": None}) is None and [x["id"] for x in E.enabled([{"id": 1}, {"id": 2, "enabled": False}])] == [1]


def test_reports(spark):
    rows = [("d", "0", i, a, b) for i, (a, b) in enumerate((("ab", "ab"), ("abc", "abd")))]
    df = spark.createDataFrame(rows, "document_id string, line_id string, ord int, ground_truth string, prediction string")
    made = reporting.as_json(recognition.report(df, metrics=["ema", "cer"]), "m").withColumn("r", reporting.from_json(F.col("report")))
    got = made.select("r.*", reporting.at_level(F.col("r.metrics"), "line").alias("line"), reporting.at_level(F.col("r.metrics"), "page").alias("first")).first()
    assert got.model == "m" and got.metrics["word"]["ema"] == 0.5 and got.line["cer"] == pytest.approx(1 / 6) and got.first in got.metrics.values() and len(got.created_at) == 19
    assert reporting.event_line("go", "r1", b={"y": [1, "a\nb"], "x": None}, a=None, c=2) == "event=go request_id=r1 b={x:None,y:[1,a b]} c=2"
    assert T.latex("a_b%") == r"a\_b\%" and [T.four_decimals(x) for x in (None, float("nan"), 1, "x")] == ["n/a", "n/a", "1.0000", "x"]
    recognition.register_metric("first_letter", lambda: recognition.mean(F.substring("l", 1, 1) == F.substring("r", 1, 1)))
    try:
        assert recognition.evaluate(df, "word").first().first_letter == 1.0
    finally:
        recognition.METRICS.pop("first_letter")


def test_polygons_and_scores(spark):
    df = spark.createDataFrame([(1, [(1.0, 2.0), (5.0, 4.0)]), (2, [])], "image_id long, boundary array<struct<x: double, y: double>>")
    assert [(r.image_id, r.x, r.y, r.w, r.h, r.score) for r in boxes.lines_of_polygons(df).collect()] == [(1, 1.0, 2.0, 4.0, 2.0, 1.0)]


def test_operating_point(spark):
    """A missing score counts as 1, and the bound itself is kept."""
    df = spark.createDataFrame([(0, 0.25), (1, 0.2499), (2, None), (3, 0.9)], "pred long, score double")
    assert sorted(r.pred for r in detection.at_operating_point(df).collect()) == [0, 2, 3]


def test_first_key_of_nested_answers(spark):
    texts = ['{"result": {"text": "a"}}', '[{"label": "b"}]', '[[{"value": "c"}]]', '"d"', '{"x": 1}', '{"prediction": {"sentence": "e"}}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert [r[0] for r in df.select(T.first_key("j")).collect()] == ["a", "b", "c", "d", None, "e"]


def test_generated_text(spark):
    rows = ["<image> Read this. The answer", "User: Read this.\nAssistant: hello", "plain text", "A note. Assistant: kept", "  "]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(T.clean_generated("t", "Read this.")).collect()] == ["The answer", "hello", "plain text", "A note. Assistant: kept", ""]
