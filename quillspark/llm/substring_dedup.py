"""Removal of word windows that occur more than once in a corpus.

Method: find recurring passages, confirm them, compile them into sharded Aho-Corasick
automata, and stream the documents through these to locate every occurrence.

1.  Each document's windows of `WINDOW` words fall into runs that share their smallest
    gram hash (their anchor). Equal windows have equal anchors, so only anchors that
    occur twice are followed. Anchors are counted with map-side combining and joined
    back, never gathered; a run is a few words wide whatever the document's length.
2.  Runs of an anchor that are equal throughout recur as a whole. Where runs of an
    anchor differ, their windows are counted one by one, each distinct run once. A
    distinct run is written out as text by one document that holds it; what recurs of
    it is a confirmed passage.
3.  Documents are dealt to shards of about `SHARD_BYTES`, near-copies mostly to one, by
    their smallest anchor; what is more than a shard of these is split at random. A document
    can only hold passages of its own anchors, so a posting of anchors and shards tells
    which passages each shard has to look for; those make its automata, of `MOST_LETTERS`
    letters at a time, two for each word. The documents of the shard are streamed through
    each, and the words under all matches are removed. The matches alone decide; a document
    whose anchors no other has meets no passage and is done before.

Windows are compared by 128 bits of hashes (anchor and window), passages literally.

Nulls and empty texts have no words: nothing removed, the hash of the empty string.
A null doc_id stays null. Repeated rows are each other's copies. Extra columns are not
read, whatever they are called. Very long texts are processed whole; a shard may then be
a single document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import rows_of, staged, table, utf8
from quillspark.llm.hashing import mixed, powers, rolled, word_hashes

WINDOW, GRAM = 35, 8
#: Packed bytes of a shard, and letters of an automaton.
SHARD_BYTES, MOST_LETTERS = 4 << 20, 2_000_000
RUN = "struct<m: long, rc: long, s: int, n: int, twice: boolean>"
PHRASE = "struct<m: long, rc: long, whole: boolean, weight: int, text: binary, windows: array<long>>"


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and anchor of every window."""
    hashes = word_hashes(words)
    return rolled(hashes, WINDOW), smallest(rolled(hashes, GRAM), WINDOW - GRAM + 1)


def runs(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first window, number of windows, and whether a window repeats within the document."""
    whole, anchor = windows(words)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.concatenate((first, [len(anchor)])))
    # all windows of a run in order: where lines repeat, a run is as long as the repetition
    up, down = powers(len(whole) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(whole) * up[: len(whole)])))
    content = mixed((sums[first + count] - sums[first]) * down[first] + count.astype(np.uint64))
    twice = np.zeros(len(first), bool)
    order = np.argsort(whole, kind="stable")
    same = np.flatnonzero(whole[order[1:]] == whole[order[:-1]])
    if len(same):
        again = np.concatenate((order[same], order[same + 1]))
        twice[np.searchsorted(first, again, side="right") - 1] = True
    return anchor[first].view(np.int64), content.view(np.int64), first.astype(np.int32), count.astype(np.int32), twice


def list_array(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), values)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, lengths = [], []
        for (text,) in rows_of(batch, ["text"]):
            words = text.split()
            if len(words) < WINDOW:
                lengths.append(0)
                continue
            parts.append(runs(words))
            lengths.append(len(parts[-1][0]))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] or [[] for _ in kinds]
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["m", "rc", "s", "n", "twice"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(lengths, values)], ["doc_id", "th", "runs"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([packer.compress(t) for (t,) in rows_of(batch, ["text"])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], ["doc_id", "th", "z"])


def written(words: list[bytes], run: dict, whole: np.ndarray | None) -> dict:
    """A distinct run as text, with the hashes of its windows where these are to be counted."""
    s, n = run["s"], run["n"]
    again = run["k"] > 1
    return {
        "m": run["m"], "rc": run["rc"], "whole": again, "weight": (2 if again else 1) if run["differ"] else 0,
        "text": b" ".join(words[s : s + n + WINDOW - 1]), "windows": whole[s : s + n].tolist() if run["differ"] else [],
    }


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without live anchors are done; the others go on with their anchors and write out the runs that fall to them."""
    unpacker = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_words", "kept_sha256", "z", "anchors", "phrases"]
    phrase = pa.struct([("m", pa.int64()), ("rc", pa.int64()), ("whole", pa.bool_()), ("weight", pa.int32()), ("text", pa.binary()), ("windows", pa.list_(pa.int64()))])
    for batch in batches:
        n_words, hashes, kept, phrases = [], [], [], []
        for z, anchors, firsts in rows_of(batch, ["z", "anchors", "firsts"]):
            words = unpacker.decompress(z).split() if z else []
            n_words.append(len(words))
            hashes.append(None if anchors else hashlib.sha256(b" ".join(words)).hexdigest())
            kept.append(z if anchors else None)
            whole = windows(words)[0].view(np.int64) if any(x["differ"] for x in firsts or ()) else None
            phrases.append([written(words, x, whole) for x in firsts or ()])
        columns = [pa.array(n_words, pa.int64()), pa.array(hashes, pa.string()), pa.array(kept, pa.binary())]
        anchors = batch.column(batch.schema.get_field_index("anchors"))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, anchors, pa.array(phrases, pa.list_(phrase))], names)


def passages(n_windows: int, found: list[int]) -> list[tuple[int, int]]:
    """Maximal word ranges (start, end) that the windows found cover without a gap between windows."""
    inside = np.zeros(n_windows + 2, np.int8)
    inside[np.array(found) + 1] = 1
    turn = np.flatnonzero(np.diff(inside))
    return [(int(a), int(b) + WINDOW - 1) for a, b in zip(turn[::2], turn[1::2], strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a run whose windows recur."""
    for batch in batches:
        ms, texts = [], []
        for m, text, found in rows_of(batch, ["m", "text", "found"]):
            words = text.split(b" ")
            for a, b in passages(len(words) - WINDOW + 1, found):
                ms.append(m)
                texts.append(b" ".join(words[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int64()), pa.array(texts, pa.binary())], ["m", "text"])


class Shard:
    """Documents, and the places in them where passages were found; passages are searched for by one automaton after the other.

    A word of the documents is two letters, told apart by their ranges, so a match begins
    and ends with a word.
    """

    def __init__(self) -> None:
        self.ids: list[object] = []
        self.packed: list[bytes] = []
        self.texts: list[str] = []
        self.edges: list[np.ndarray] = []  # by word: +1 where matches begin, -1 after their ends
        self.number: dict[bytes, int] = {}
        self.passages: list[list[bytes]] = []
        self.letters = 0

    def add_document(self, doc_id: object, packed: bytes) -> None:
        words = zstandard.ZstdDecompressor().decompress(packed).split()
        numbers = numbered(words, self.number)
        for i in np.flatnonzero(numbers < 0).tolist():
            numbers[i] = self.number.setdefault(words[i], len(self.number))
        self.ids.append(doc_id)
        self.packed.append(packed)
        self.texts.append(spelt(numbers))
        self.edges.append(np.zeros(len(words) + 1, np.int32))

    def add_passage(self, text: bytes) -> None:
        self.passages.append(text.split())
        self.letters += 2 * len(self.passages[-1])
        if self.letters >= MOST_LETTERS:
            self.search()

    def search(self) -> None:
        sizes = np.array([len(words) for words in self.passages], np.int64)
        numbers = numbered([w for words in self.passages for w in words], self.number)
        self.passages, self.letters = [], 0
        automaton = ahocorasick.Automaton()
        if len(numbers):
            first = np.cumsum(sizes) - sizes
            known = np.minimum.reduceat(numbers, first) >= 0  # others are not in this shard
            letters = spelt(np.maximum(numbers, 0))
            for a, n in zip(first[known].tolist(), sizes[known].tolist(), strict=True):
                automaton.add_word(letters[2 * a : 2 * (a + n)], n)
        if not len(automaton):  # an automaton without phrases cannot be searched
            return
        automaton.make_automaton()
        for text, edge in zip(self.texts, self.edges, strict=True):
            found = list(automaton.iter(text))
            if found:
                ends, sizes = np.array(found, np.int64).T
                ends = (ends + 1) // 2
                edge += np.bincount(ends - sizes, minlength=len(edge)).astype(np.int32)
                edge -= np.bincount(ends, minlength=len(edge)).astype(np.int32)

    def results(self) -> Iterator[tuple[object, int, int, str]]:
        """doc_id, n_words, n_removed, kept_sha256 of each document."""
        self.search()
        for doc_id, packed, edge in zip(self.ids, self.packed, self.edges, strict=True):
            words = zstandard.ZstdDecompressor().decompress(packed).split()
            gone = (np.cumsum(edge)[:-1] > 0).tolist()
            kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
            yield doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()


def numbered(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """Numbers of words, -1 for those that have none."""
    return np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))


def spelt(numbers: np.ndarray) -> str:
    """Two letters for each number: the high part, from 256 on and not a surrogate, and the low one, below 256."""
    high = 256 + (numbers >> 8)
    letters = np.empty(2 * len(numbers), np.uint32)
    letters[0::2], letters[1::2] = high + 0x800 * (high >= 0xD800), numbers & 255
    return letters.tobytes().decode("utf-32-le")


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, its documents before its passages."""
    shard, at, kind = Shard(), None, pa.null()

    def out(shard: Shard) -> pa.RecordBatch:
        columns = list(zip(*shard.results(), strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    for batch in batches:
        kind = batch.column(batch.schema.get_field_index("doc_id")).type
        for number, passage, doc_id, body in rows_of(batch, ["shard", "passage", "doc_id", "body"]):
            if number != at:
                if shard.ids:
                    yield out(shard)
                shard, at = Shard(), number
            if passage:
                shard.add_passage(body)
            else:
                shard.add_document(doc_id, body)
    if shard.ids:
        yield out(shard)


def confirmed(phrases: DataFrame) -> DataFrame:
    """(m, text): the distinct passages that recur, from the distinct runs (m, rc, whole, weight, text, windows)."""
    checks = phrases.filter("weight > 0").select("m", "rc", "weight", F.posexplode("windows").alias("i", "w"))
    recurring = checks.groupBy("m", "w").agg(F.sum("weight").alias("k")).filter("k > 1").select("m", "w")
    # staged, so that both sides of the join are exchanges and large partitions can be split
    found = checks.filter("weight = 1").join(staged(recurring, "passages-recurring"), ["m", "w"], "left_semi")
    found = found.groupBy("m", "rc").agg(F.collect_list("i").alias("found"))
    parts = phrases.filter("weight = 1").select("m", "rc", "text").join(found, ["m", "rc"]).mapInArrow(_cut, "m long, text binary")
    return phrases.filter("whole").select("m", "text").union(parts).distinct()


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {id_type}, th long"
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), utf8("text").alias("text"))
    by_doc = staged(base.mapInArrow(_runs, f"{key}, runs array<{RUN}>"), "passages-runs")
    each = by_doc.select("doc_id", "th", F.explode("runs").alias("r")).select("doc_id", "th", "r.*")

    anchors = each.groupBy("m").agg(F.count("*").alias("k"), F.min("rc").alias("low"), F.max("rc").alias("high"), F.max("twice").alias("again"))
    anchors = anchors.filter((F.col("k") > 1) | F.col("again"))
    # staged, so that both sides of each join are exchanges and large partitions can be split
    anchors = staged(anchors.select("m", ((F.col("low") != F.col("high")) | F.col("again")).alias("differ")), "passages-anchors")
    live = staged(each.drop("twice").join(anchors, "m"), "passages-live")
    distinct = live.groupBy("m", "rc").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "th", "s", "n", "differ")).alias("f"))
    run = F.struct("m", "rc", "f.s", "f.n", "f.differ", "k")
    # the anchors of a document, and the distinct runs that it is the first to hold
    lists = live.select("doc_id", "th", "m", F.lit(None).cast(distinct.select(run).schema[0].dataType).alias("run"))
    lists = lists.unionByName(distinct.select("f.doc_id", "f.th", F.lit(None).cast("long").alias("m"), run.alias("run")))
    lists = lists.groupBy("doc_id", "th").agg(F.collect_set("m").alias("anchors"), F.collect_list("run").alias("firsts"))
    packed = base.mapInArrow(_pack, f"{key}, z binary")
    on = packed["doc_id"].eqNullSafe(lists["doc_id"]) & (packed["th"] == lists["th"])
    met = packed.join(lists, on, "left").select(packed["doc_id"], "z", "anchors", "firsts")
    met = met.mapInArrow(_expand, f"doc_id {id_type}, n_words long, kept_sha256 string, z binary, anchors array<long>, phrases array<{PHRASE}>")
    met = staged(met.withColumns({"bytes": F.length("z"), "near": F.array_min("anchors"), "chance": F.rand(7)}), "passages-met")

    # where repeated rows write a run out each, it recurs as a whole, and more of its windows change nothing
    found = staged(confirmed(met.select(F.explode("phrases").alias("p")).select("p.*")), "passages-confirmed")
    live = met.filter("z IS NOT NULL")
    shards = max(1, -(-(live.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    live = live.withColumn("bucket", F.pmod(F.xxhash64("near"), F.lit(shards)))
    parts = staged(live.groupBy("bucket").agg(F.ceil(F.sum("bytes") / SHARD_BYTES).alias("parts")), "passages-shards")
    # with the parts of its bucket, any document may go to any of them, so repeated rows do not meet in one
    shard = F.struct("bucket", F.floor(F.col("chance") * F.col("parts")).alias("part"))
    dealt = lambda c: live.select("bucket", "chance", *c).join(parts, "bucket").withColumn("shard", F.xxhash64(shard))
    posted = dealt(["anchors"]).select("shard", F.explode("anchors").alias("m")).distinct().join(found, "m")
    bodies = dealt(["doc_id", "z"]).select("shard", F.lit(False).alias("passage"), "doc_id", F.col("z").alias("body"))
    bodies = bodies.unionByName(posted.select("shard", F.lit(True).alias("passage"), F.lit(None).cast(id_type).alias("doc_id"), F.col("text").alias("body")))
    # partitions grow in number with the shards, so that a task has few of these
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 2)
    located = bodies.repartition(tasks, "shard").sortWithinPartitions("shard", "passage").mapInArrow(_locate, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")
    done = met.filter("z IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return done.unionByName(located)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH base AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM base WHERE len(w) >= {WINDOW}),
windows AS (SELECT id, s, array_to_string(w[s : s + {WINDOW - 1}], ' ') AS v FROM places),
twice AS (SELECT id, s FROM (SELECT id, s, count(*) OVER (PARTITION BY v) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT id, s + o AS i FROM twice, range({WINDOW}) AS r(o)),
words AS (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM base),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (id)
"""
