"""Benchmark passages in documents, found in a latent space and confirmed word by word.

1.  One pass over all documents counts, for the words of the benchmark, the passages
    that hold them, and sums all passages' term vectors into `ROWS` random signed rows.
    With inverse document frequencies put on, the right singular vectors of these rows
    are a randomised SVD of the corpus's TF-IDF matrix of passages.
2.  A second pass folds every passage of every document into that space, a block of
    words at a time, and takes those whose cosine with a passage of an item is at least
    `COSINE` as candidates. Items are the query set, so they go to the executors.
3.  A candidate is confirmed by its longest common subsequence with the item: `COPY` of
    the item's words, or `PARAPHRASE` of them and the item's last words, its answer.
4.  A paraphrase between other words can lie under `COSINE`. So the second pass also looks
    up each item's rarest words: whatever holds `PARAPHRASE` of an item holds so many of
    them within one window. Such places are confirmed at every offset, so nothing that
    step 3 would accept in some window is missed, and a share is that of the best window.

What is gathered is ROWS sums for each partition, by row; the driver sees ROWS rows as
wide as the benchmark's vocabulary.

Terms weigh by the square of their inverse document frequency, smoothed so that a word of
all passages still counts. The models go to the executors for at most `ITEMS` items of `WORDS`
different words at a time, so what is sent is bounded; a larger benchmark takes further
passes.

Nulls: a null text or item has no words and matches nothing, nor does an item of fewer than
`LEAST_WORDS` words, which any text may hold by chance; hits of a row without doc_id have
none either. Repeated rows are each reported; repeated items too. Ids may be of any type.
Of equal shares in several windows one is reported. Texts are read whole. Extra columns are
ignored by `leaks` and kept by `decontaminated`, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.common import rows_of, table

BLOCK, ROWS, RANK = 16, 320, 256
COSINE, COPY, PARAPHRASE, ANSWER = 0.55, 0.8, 0.6, 4
#: Passages that are compared at a time, and blocks whose vectors are summed at a time.
CHUNK, PART = 2048, 512
#: Items that are searched for at a time, their different words, and the words that an item has at least.
ITEMS, WORDS, LEAST_WORDS = 5000, 1 << 16, 8
#: Of the fewest words that a confirmed window shares with an item, the part that is asked of its rarest words.
RARE = 0.3
#: Terms that are summed at a time.
MOST_TERMS = 500_000
MARKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII signs part them."""
    return text.lower().encode("utf-8", "replace").translate(MARKS).split() if text else []


def ids_of(words: Iterable[bytes], vocabulary: dict[bytes, int], n: int) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, n)


def gridded(held: list[list[bytes]], vocabulary: dict[bytes, int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words of texts (-1 outside the vocabulary), in rows of `width` that each belong to one text; the rows of each text; all ids."""
    sizes = np.array([len(words) for words in held], np.int64)
    ids = ids_of(chain.from_iterable(held), vocabulary, int(sizes.sum()))
    rows = np.maximum(1, -(-sizes // width))
    shift = width * (np.cumsum(rows) - rows) - (np.cumsum(sizes) - sizes)
    grid = np.full(int(rows.sum()) * width, -1, np.int32)
    grid[np.arange(len(ids)) + np.repeat(shift, sizes)] = ids
    return grid.reshape(-1, width), rows, ids


def _sketch(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums a partition's passages: row 0 to ROWS - 1 the signed sums, ROWS the passages by word, ROWS + 1 all passages."""
    width = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, passages = np.zeros(ROWS * width, np.float32), np.zeros(width, np.int64), 0
        texts, seeds, size = [], [], 0

        def add() -> None:
            nonlocal held, passages
            grid, count, _ = gridded(texts, vocabulary, 2 * BLOCK)
            within = np.arange(len(grid)) - np.repeat(np.cumsum(count) - count, count)
            mix = (within.astype(np.uint64) + np.repeat(np.array(seeds, np.uint64) << np.uint64(20), count)) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
            mix *= np.uint64(0xBF58476D1CE4E5B9)
            grid.sort(axis=1)
            known = grid >= 0
            ids = grid[known]
            of = np.repeat(np.arange(len(grid)), known.sum(axis=1))
            row, sign = (mix >> np.uint64(40)).astype(np.int64) % ROWS * width, np.where(mix >> np.uint64(63), 1.0, -1.0)
            np.add(rows, np.bincount(row[of] + ids, sign[of], ROWS * width), out=rows, casting="unsafe")
            known[:, 1:] &= grid[:, 1:] != grid[:, :-1]  # each word of a passage once
            held += np.bincount(grid[known], minlength=width)
            passages += len(grid)

        for batch in batches:
            for (text,) in zip(batch.column(0)):  # noqa: B905
                text = text.as_py()
                words = words_of(text)
                if words:
                    texts.append(words)
                    seeds.append(zlib.crc32(text.encode("utf-8", "replace")))
                    size += len(words)
                if size > MOST_TERMS:
                    add()
                    texts, seeds, size = [], [], 0
        if texts:
            add()
        if not passages:
            return
        pack = zstandard.ZstdCompressor(level=1).compress
        sums = [*rows.reshape(ROWS, width), held.astype(np.float32), np.full(1, passages, np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array(range(ROWS + 2), pa.int32()), pa.array([pack(x.astype(np.float64).tobytes()) for x in sums], pa.binary())], ["row", "z"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, sums = zstandard.ZstdDecompressor().decompress, {}
    for batch in batches:
        for row, z in rows_of(batch, ["row", "z"]):
            x = np.frombuffer(unpack(z))
            sums[row] = sums[row] + x if row in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "x"])


def folded(grid: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Latent vectors of the rows of grid: the sums of their words' vectors, one word of every row at a time."""
    ordered = -np.sort(-grid, axis=1)  # words of the vocabulary first
    count = (ordered >= 0).sum(axis=1)
    order = np.argsort(-count, kind="stable")
    ordered, many = ordered[order].T.copy(), np.searchsorted(-count[order], -np.arange(grid.shape[1]))
    out = np.zeros((len(grid), space.shape[1]), np.float32)
    part = np.empty((PART, space.shape[1]), np.float32)
    for at in range(0, len(grid), PART):
        for k, m in enumerate(many.tolist()):
            n = min(m - at, PART)
            if n <= 0:
                break
            np.take(space, ordered[k, at : at + n], axis=0, out=part[:n], mode="clip")
            out[at : at + n] += part[:n]
    back = np.empty_like(out)
    back[order] = out
    return back


def passages_folded(grid: np.ndarray, count: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Latent vectors of the passages of texts, two blocks each, one block apart; the last one of a text is a single block."""
    out = folded(grid, space)
    last = np.zeros(len(out), bool)
    last[np.cumsum(count) - 1] = True
    np.add(out[:-1], out[1:], out=out[:-1], where=~last[:-1, None])
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def common_subsequence(masks: dict[bytes, int], size: int, words: list[bytes], least: float) -> int:
    """Length of the longest common subsequence with the item whose word positions are in masks; 0 if under least."""
    return longest(list(map(masks.get, words)), size, least)


def longest(masks: list[int | None], size: int, least: float) -> int:
    """The same for a text given by the masks of its words."""
    held = list(filter(None, masks))
    if len(held) < least:  # a subsequence has no more words than these
        return 0
    full = v = (1 << size) - 1
    for m in held:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Search:
    """Everything the second pass needs; as large as the benchmark."""

    def __init__(self, items: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], space: np.ndarray, held: np.ndarray) -> None:
        self.items, self.vocabulary, self.space = items, vocabulary, space
        self.masks: list[dict[bytes, int]] = []
        queries, self.origin = [np.zeros((0, space.shape[1]), np.float32)], []
        for i, (_, words) in enumerate(items):
            masks: dict[bytes, int] = {}
            for k, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)
            found = passages_folded(*gridded([words], vocabulary, BLOCK)[:2], space)
            # a last passage of few words is within the one before it
            found = found[: max(1, len(found) - 1)]
            queries.append(found)
            self.origin += [(i, k * BLOCK) for k in range(len(found))]
        queries = np.concatenate(queries)
        self.queries = (queries / np.maximum(norms(queries), 1e-9)[:, None]).T.copy()
        #: Words of the windows in which an item is confirmed, and how many of its rarest words each holds at least.
        self.window = np.array([len(words) + 3 * BLOCK for _, words in items], np.int64)
        self.need = np.zeros(len(items), np.int64)
        posted: list[list[int]] = [[] for _ in vocabulary]
        for i, (_, words) in enumerate(items):
            least = next(k for k in range(len(words) + 1) if k / len(words) >= PARAPHRASE)
            self.need[i] = max(1, int(RARE * least))
            rarest = sorted(ids_of(words, vocabulary, len(words)).tolist(), key=lambda w: (held[w], w))[: len(words) - least + self.need[i]]
            for w in set(rarest):
                posted[w].append(i)
        self.posted = np.array([i for x in posted for i in x], np.int64)
        self.count = np.array([*map(len, posted), 0], np.int64)
        self.first = np.cumsum(self.count) - self.count

    def confirm(self, words: list[bytes], item: int, start: int) -> float | None:
        """Share of the item that stands near word `start`, if it is enough."""
        own = self.items[item][1]
        near = words[max(0, start - BLOCK) : start + len(own) + 2 * BLOCK]
        share = common_subsequence(self.masks[item], len(own), near, PARAPHRASE * len(own)) / len(own)
        if share >= COPY:
            return share
        if share >= PARAPHRASE and len(own) > ANSWER:
            answer = b" " + b" ".join(own[-ANSWER:]) + b" "
            if answer in b" " + b" ".join(near) + b" ":
                return share
        return None

    def places(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, lo, hi): the windows of texts (ids, -1 outside the vocabulary) that start at lo to hi may hold the item."""
        if not len(self.posted) or not texts:
            return
        gap = int(self.window.max())
        base = np.cumsum([0, *(len(ids) + gap for ids in texts)])
        ids = np.concatenate(texts)
        where = np.flatnonzero(self.count[ids])
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])[where]
        ids = ids[where]
        times = self.count[ids]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = self.posted[np.repeat(self.first[ids], times) + within]
        span = int(base[-1]) + gap
        key = item * span + np.repeat(where + gap * owner, times)
        key.sort()
        item = key // span
        last = np.arange(len(key)) + self.need[item] - 1
        at = np.flatnonzero(last < len(key))
        at = at[key[last[at]] - key[at] < self.window[item[at]]]
        if not len(at):
            return
        item, hi = item[at], key[at] % span
        lo = key[last[at]] % span - self.window[item] + 1
        owner = np.searchsorted(base, hi, side="right") - 1
        cut = np.flatnonzero((item[1:] != item[:-1]) | (owner[1:] != owner[:-1]) | (lo[1:] > hi[:-1])) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
        own = owner[begin]
        yield from zip(own.tolist(), item[begin].tolist(), np.maximum(lo[begin] - base[own], 0).tolist(), (hi[end] - base[own]).tolist(), strict=True)

    def best(self, words: list[bytes], item: int, lo: int, hi: int) -> float | None:
        """Largest share that is enough, of the windows that start at lo to hi."""
        own, size = self.items[item][1], int(self.window[item])
        part = words[lo : hi + size]
        masks = list(map(self.masks[item].get, part))
        most = longest(masks, len(own), PARAPHRASE * len(own)) / len(own)  # no window of the part has more
        if most < PARAPHRASE:
            return None
        n = ANSWER
        answers = [j for j in range(len(part) - n + 1) if part[j : j + n] == own[-n:]] if len(own) > n else []
        if most < COPY and not answers:
            return None
        found = 0.0
        middle = (hi - lo) / 2
        # a window that starts with a word the item lacks holds no more of it than the next one
        for j in sorted((j for j in range(hi - lo + 1) if masks[j] or j == hi - lo), key=lambda j: abs(j - middle)):
            share = longest(masks[j : j + size], len(own), PARAPHRASE * len(own)) / len(own)
            if share > found and (share >= COPY or (share >= PARAPHRASE and any(j <= a <= j + size - n for a in answers))):
                found = share
                if found >= most:
                    break
        return found or None

    def found(self, texts: Iterable[str | None]) -> Iterator[dict[int, float]]:
        """For each text, the confirmed items with the share of their words; whole texts, about CHUNK passages at a time."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1]) // BLOCK + 1
            if size >= CHUNK:
                yield from self._confirmed(held)
                held, size = [], 0
        if held:
            yield from self._confirmed(held)

    def _confirmed(self, held: list[list[bytes]]) -> Iterator[dict[int, float]]:
        grid, count, ids = gridded(held, self.vocabulary, BLOCK)
        known = np.split(ids, np.cumsum([len(words) for words in held])[:-1])
        owner = np.repeat(np.arange(len(held)), count)
        place = np.arange(len(grid)) - np.repeat(np.cumsum(count) - count, count)
        passages = passages_folded(grid, count, self.space)
        least = COSINE * np.maximum(norms(passages), 1e-9)
        out: list[dict[int, float]] = [{} for _ in held]
        for at in range(0, len(passages), CHUNK):
            p, q = np.nonzero(passages[at : at + CHUNK] @ self.queries >= least[at : at + CHUNK, None])
            for i, k in zip((p + at).tolist(), q.tolist(), strict=True):
                item, offset = self.origin[k]
                hits = out[owner[i]]
                if hits.get(item, 0) < 1 and (share := self.confirm(held[owner[i]], item, int(place[i]) * BLOCK - offset)):
                    hits[item] = max(share, hits.get(item, 0))
        for i, item, lo, hi in self.places(known):
            if out[i].get(item, 0) < 1 and (share := self.best(held[i], item, lo, hi)):
                out[i][item] = max(share, out[i].get(item, 0))
        yield from out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items of benchmark (item_id, text) that are long enough, as id and words, in blocks of at most ITEMS items and WORDS different words."""
    listed = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    parts = max(1, -(-listed.count() // ITEMS))
    block: list[tuple[object, list[bytes]]] = []
    known: set[bytes] = set()
    for part in range(parts):
        rows = listed.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else listed
        for r in rows.orderBy("item_id", "text").collect():
            words = words_of(r.text)
            if len(words) < LEAST_WORDS:
                continue
            if block and (len(block) >= ITEMS or len(known) + len(set(words) - known) > WORDS):
                yield block
                block, known = [], set()
            block.append((r.item_id, words))
            known.update(words)
    yield block


def latent_search(docs: DataFrame, items: list[tuple[object, list[bytes]]]) -> Search:
    """Both models of docs (text) for a block of items."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
    if not vocabulary:
        return Search([], {}, np.zeros((0, 1), np.float32), np.zeros(0))
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_sketch(vocabulary), "row int, z binary")
    sums = {r.row: np.frombuffer(r.x) for r in sums.repartition("row").mapInArrow(_total, "row int, x binary").collect()}
    if not sums:
        return Search([], {}, np.zeros((0, 1), np.float32), np.zeros(0))
    weight = np.log((2 + sums[ROWS + 1][0]) / (1 + sums[ROWS]))  # above 0 even for a word of all passages
    weight = weight * weight  # rare words, which name a passage, outweigh those that name a language
    matrix = np.stack([sums[i] for i in range(ROWS)]) * weight
    right = np.linalg.svd(matrix, full_matrices=False)[2][:RANK]
    return Search(items, vocabulary, np.ascontiguousarray((right * weight).T, np.float32), sums[ROWS])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): the items that stand in a document, with the share of their words found in order."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([base.schema["doc_id"], benchmark.schema["item_id"], StructField("share", DoubleType())])
    out = None
    for items in item_blocks(benchmark):
        found = base.mapInArrow(_leaks(docs.sparkSession.sparkContext.broadcast(latent_search(docs, items)), to_arrow_schema(schema)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks(sent: Broadcast[Search], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.found(x.as_py() for x in batch.column(1)) if sent.value.items else ()
            rows = [(d, sent.value.items[i][0], s) for d, hits in zip(batch.column(0).to_pylist(), found) for i, s in sorted(hits.items())]  # noqa: B905
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], ["doc_id", "item_id", "share"])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item."""
    out = docs
    for items in item_blocks(benchmark):
        out = out.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(latent_search(docs, items))), docs.schema)
    return out


def _clean(sent: Broadcast[Search]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not sent.value.items:
                yield batch
                continue
            texts = (x.as_py() for x in batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([not hits for hits in sent.value.found(texts)], pa.bool_()))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
