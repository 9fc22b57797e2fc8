"""Language of documents as a mixture whose proportions are found by expectation maximisation.

Letter trigrams, hashed to `BUCKETS`, are counted per language over all labelled training
documents. A document's trigrams are explained by a mixture of the languages; EM gives
the proportions, run until they stand still. The set of languages it is said to hold is
found by penalised likelihood: from the mixture of all, the language of the smallest
share is taken out, the rest fitted again, down to a single one, and the set whose
likelihood less a penalty for each language is largest is taken, as is any single language
that beats it. The language of the largest share in that set is predicted; of equal shares
the first by name.

The model has one number for each language and bucket, whatever the corpus, and goes
to the executors with the function. Documents train unless crc32 of their id as text is
0 modulo 5; prediction sees the text alone.

A null text, or one without letters, is `und` with score 0, as is every text when no
labelled document trains. Rows with null lang teach nothing. Repeated rows count and are
judged each. Texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import rows_of, table

BUCKETS = 1 << 15
SMOOTHING, PENALTY = 0.1, 2.0
#: EM ends when no proportion moves by DONE; it moves ever less, so ROUNDS only guards against rounding.
DONE, ROUNDS = 1e-4, 10_000


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter (general category L)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def word_parts() -> np.ndarray:
    """For each code point, whether it stands within words: letters and the marks on them."""
    table = letters().copy()
    table[[ord(m) for m in regex.findall(r"\p{M}", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))]] = True
    return table


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of the lowered text; word bounds count as one blank. Empty if no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letters()[points].any():
        return np.zeros(0, np.int64)
    inside = word_parts()[points]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    x = np.where(inside, points, 32)[keep].astype(np.uint32)
    x = np.concatenate(([np.uint32(32)], x, [np.uint32(32)]))
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)


def counted(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) of (text, lang), summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            for text, lang in rows_of(batch, ["text", "lang"]):
                np.add.at(counts[lang], trigrams(text), 1)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    return labelled.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Trigram probabilities of each language."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        self.p = ((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).T.astype(np.float64)
        self.log_p = np.log(self.p)

    def mixture(self, p: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Proportions of the columns of p that explain n best, from a first guess."""
        if len(share) == 1:
            return share
        total = n.sum()
        for _ in range(ROUNDS):
            new = share * ((n / (p @ share)) @ p) / total
            done = np.abs(new - share).max() < DONE
            share = new
            if done:
                break
        return share

    def languages(self, text: str | None) -> list[tuple[str, float]]:
        """The languages of the text with their proportions, first the largest; empty if undetermined."""
        found = trigrams(text) if text else np.zeros(0, np.int64)
        if not len(found) or not self.names:
            return []
        n = np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(n)
        n, p = n[at], self.p[at]
        price = PENALTY * np.log(n.sum() + 1)
        alone = n @ self.log_p[at]
        one = int(alone.argmax())
        best, chosen = alone[one] - price, (np.array([one]), np.ones(1))
        held = np.arange(len(self.names))
        share = np.full(len(held), 1 / len(held))
        while len(held) > 1:
            share = self.mixture(p[:, held], n, share)
            value = n @ np.log(p[:, held] @ share) - price * len(held)
            if value > best:
                best, chosen = value, (held, share)
            least = share.argmin()
            held, share = np.delete(held, least), np.delete(share, least)
            share = (share + 1e-6) / (share + 1e-6).sum()  # a share of nothing would stay so
        ranked = sorted(zip(chosen[1], chosen[0], strict=True), key=lambda x: (-x[0], x[1]))
        return [(self.names[i], float(min(1.0, s))) for s, i in ranked]


def trained(labelled: DataFrame) -> Model:
    """The model of (text, lang). What comes to the driver, as Arrow, is bounded by languages times BUCKETS, whatever the corpus."""
    rows = counted(labelled).toArrow()
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    found = langs.dictionary.to_pylist()
    names = sorted(found)
    place = np.array([names.index(x) for x in found], np.int64)
    counts = np.zeros((len(names), BUCKETS))
    if len(rows):
        counts[place[langs.indices.to_numpy()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(names, counts)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id and held_out, lang_pred, score, languages (array of lang and share)."""
    base = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    id_type = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.languages(t) for (t,) in rows_of(batch, ["text"])]
            first = [g[0] if g else ("und", 0.0) for g in got]
            columns = [pa.array([f[i] for f in first], k) for i, k in enumerate((pa.string(), pa.float64()))]
            listed = pa.array([[{"lang": x, "share": s} for x, s in g] for g in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, listed], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    return base.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def language_id(docs: DataFrame) -> DataFrame:
    train = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return identified(docs, trained(train))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("languages")
