"""Arrow-batched functions where built-in ones do not reach: Unicode forms, recognisers, detectors."""

from __future__ import annotations

import base64
import json
import time
import unicodedata
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance by bit vectors: one step over whole words of bits for each element of b (Myers 1999, Hyyrö 2001)."""
    if a == b or not len(a) or not len(b):
        return 0 if a == b else max(len(a), len(b))
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    all_ = (1 << len(a)) - 1
    last, up, down, total = 1 << (len(a) - 1), all_, 0, len(a)
    for x in b:
        here = places.get(x, 0)
        level = (((here & up) + up) ^ up) | here | down
        more, less = (down | ~(level | up)) & all_, up & level
        total += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & all_, less << 1 & all_
        up, down = (less | ~(here | down | more)) & all_, more & (here | down)
    return total


def _distances(split: Callable[[str], Sequence]) -> Callable[[Column | str, Column | str], Column]:
    @F.pandas_udf(IntegerType())
    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(split(x), split(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return distances


#: For long texts, where filling the whole table of distances is slow: in characters, and in words of normalised texts.
long_edits = _distances(lambda text: text)
long_token_edits = _distances(lambda text: text.split(" ") if text else [])


@F.pandas_udf(StringType())
def six_decimals(v: pd.Series) -> pd.Series:
    return v.map(lambda x: f"{x:.6f}", na_action="ignore")


def unicode_form(form: str) -> Callable[[Column | str], Column]:
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t) if t is not None else None)

    return normal


def mock_recogniser(paths: list[str]) -> list[str]:
    """Deterministic stand-in for a model: the file's stem, blanks for underscores."""
    return [p.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("_", " ") for p in paths]


Loader = Callable[[], Callable[[list[str]], list[str]]]


def one_by_one(predict: Callable[[str], str]) -> Callable[[list[str]], list[str]]:
    """A recogniser of batches from one of single images."""
    return lambda paths: [predict(p) for p in paths]


def recognise(samples: DataFrame, load: Loader, batch: int = 8, seconds: bool = False) -> DataFrame:
    """samples (with image_path) and `prediction`; the model is loaded once a partition, batches are of `batch`.

    With `seconds`, each sample's part of the time that its batch took.
    """
    fields = [*samples.schema.fields, StructField("prediction", StringType()), *([StructField("seconds", DoubleType())] if seconds else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts: list[str] = []
            took: list[float] = []
            for at in range(0, len(frame), batch):
                part = list(frame["image_path"].iloc[at : at + batch])
                began = time.perf_counter()
                got = model(part)
                if len(got) != len(part):
                    raise RuntimeError(f"{len(got)} predictions for {len(part)} samples")
                texts += got
                took += [(time.perf_counter() - began) / len(part)] * len(part)
            frame = frame.assign(prediction=texts)
            yield frame.assign(seconds=took) if seconds else frame

    return samples.mapInPandas(run, StructType(fields))


#: What a service is asked (fixed formats): one image, several, or to load.
PREDICT = "image_base64 string, options map<string, string>"
PREDICT_BATCH = "images_base64 array<string>, options map<string, string>"
LOAD = "options map<string, string>"


def request(image: Column, options: Column) -> Column:
    """The body of a request for one image."""
    return F.to_json(F.struct(image.alias("image_base64"), options.alias("options")))


def parsed_request(body: Column, schema: str = PREDICT) -> Column:
    """Its parts; null where a body is of another form."""
    return F.from_json(body, schema)


class ServiceError(RuntimeError):
    """A service's answer that says what is wrong, or is none of the agreed form."""


class Service:
    """Client of a recogniser service: /health, /load, /predict and /predict_batch, images as base64."""

    def __init__(self, url: str, options: dict | None = None, timeout: float = 60.0) -> None:
        self.url, self.options, self.timeout = url.rstrip("/"), options or {}, timeout

    def _ask(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.url}{path}", data, {"Content-Type": "application/json"} if data else {})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                answer = json.loads(reply.read())
        except urllib.error.HTTPError as e:
            raise ServiceError(error_detail(e.code, path, e.read().decode("utf-8", "replace"))) from None
        except ValueError:
            raise ServiceError(f"{path}: the answer is no JSON") from None
        if not isinstance(answer, dict):
            raise ServiceError(f"{path}: the answer is no JSON object")
        return answer

    def health(self) -> dict:
        return self._ask("/health")

    def load(self) -> dict:
        return self._ask("/load", {"options": self.options})

    def predict(self, path: str) -> str:
        return str(self._ask("/predict", {"image_base64": encoded(path), "options": self.options}).get("text", "")).strip()

    def predict_batch(self, paths: list[str]) -> list[str]:
        return self.predict_images([open(local(p), "rb").read() for p in paths])

    def predict_images(self, images: list[bytes]) -> list[str]:
        """Texts of encoded images; nothing is asked for none."""
        if not images:
            return []
        body = {"images_base64": [base64.b64encode(x).decode() for x in images], "options": self.options}
        texts = self._ask("/predict_batch", body).get("texts", [])
        if not isinstance(texts, list):
            raise ServiceError("/predict_batch: texts are no list")
        return [str(t).strip() for t in texts]


def error_detail(code: int, path: str, body: str) -> str:
    """What a failed answer says: its `detail`, else its JSON object, else its text, else the bare code."""
    message = f"HTTP {code} from {path}"
    try:
        answer = json.loads(body)
    except ValueError:
        answer = None
    if isinstance(answer, dict):
        return f"{message}: {answer.get('detail') or json.dumps(answer, ensure_ascii=False)}"
    return f"{message}: {body.strip()}" if body.strip() else message


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def encoded(path: str) -> str:
    with open(local(path), "rb") as f:
        return base64.b64encode(f.read()).decode()


_services: dict[tuple[str, str], Service] = {}


def http_recogniser(base_url: str, options: dict | None = None, timeout: float = 60.0) -> Loader:
    """Loader of a service's client; a worker asks a service to load once for its options, and only if it is well."""

    def load() -> Callable[[list[str]], list[str]]:
        key = (base_url, json.dumps(options or {}, sort_keys=True))
        if key not in _services:
            service = Service(base_url, options, timeout)
            if (state := service.health()).get("status") != "ok":
                raise ServiceError(f"the service is not well: {state}")
            service.load()
            _services[key] = service
        return _services[key].predict_batch

    return load


#: What a detector finds on a page.
DETECTED = "array<struct<x: double, y: double, w: double, h: double, score: double>>"


def detect(pages: DataFrame, load: Callable[[], Callable[[bytes], list[tuple[float, float, float, float, float]]]], keys: list[str], content: str = "content") -> DataFrame:
    """(keys, pred, x, y, w, h, score): the boxes that a detector, loaded once a partition, finds on each page."""
    schema = StructType([pages.schema[k] for k in keys])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = load()
        for frame in frames:
            yield frame[keys].assign(boxes=[[dict(zip(("x", "y", "w", "h", "score"), map(float, b), strict=True)) for b in found(c)] for c in frame[content]])

    boxed = pages.select(*keys, content).mapInPandas(run, f"{schema.toDDL()}, boxes {DETECTED}")
    return boxed.select(*keys, F.posexplode("boxes").alias("pred", "b")).select(*keys, F.col("pred").cast("long").alias("pred"), "b.*")
