"""Near-duplicate documents by an inverted join on signature coordinates.

1.  Documents with the same shingle set are one class, told by 128 bits of set hashes;
    its smallest doc_id stands for it.
2.  A class is posted under each (coordinate, value) of its `K`-coordinate minhash
    signature. Two sets as alike as a link asks agree on fewer than `match` coordinates
    with a probability of 2e-7 at most (`least_matches`), so pairs below it are skipped:
    postings of one class, classes with fewer than match shared postings, and, by prefix
    filtering, all but the K - match + 1 rarest postings of a class never meet anything.
3.  In each posting that is left, every class is paired with the posting's most central
    class only; pairs with match agreeing coordinates are confirmed on full sets. Linked
    classes form components.
4.  Where a posting still holds several components, the classes outside its central one
    are compared with the others in blocks of bounded size, across components only and by
    a finer signature, and agreeing pairs are confirmed too. So no link between components
    is lost, and a group of copies costs rows in proportion to its size.

Nulls: a null or empty text has no shingles and is linked with nothing. Rows without
doc_id join the component of their copies, null if they have none. Ids may be of any type
that has an order. Repeated rows share doc_id and component and are all kept or all not.
Of classes alike in a posting the one with the smallest id is central. Extra columns are
not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import rows_of, staged, table, utf8
from quillspark.llm.components import components
from quillspark.llm.hashing import mixed, rolled, word_hashes

#: Words of a shingle, coordinates of the signature, and the least similarity of a link in per cent.
SHINGLE, K, PERCENT = 5, 64, 85
#: Coordinates of the finer signature for comparison in blocks.
FINE = 384
OUTSIDE, INSIDE = 256, 768
_random = np.random.default_rng(20)
FACTORS = _random.integers(1, 2**63, K + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 2**63, K + FINE, dtype=np.uint64)


class Threshold(NamedTuple):
    """Least similarity in per cent, and how many coordinates of both signatures must agree for it."""

    percent: int
    match: int
    fine: int


def least_matches(k: int, percent: int, miss: float = 2e-7) -> int:
    """The most coordinates of k that sets of this similarity agree on but for a probability of `miss`."""
    p, below, m = percent / 100, 0.0, 0
    while (below := below + comb(k, m) * p**m * (1 - p) ** (k - m)) <= miss:
        m += 1
    return m


def threshold(percent: int) -> Threshold:
    return Threshold(percent, least_matches(K, percent), least_matches(FINE, percent))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a short text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < SHINGLE:
        return rolled(hashes, len(words)) + np.uint64(len(words))
    return np.unique(rolled(hashes, SHINGLE))


def minima(found: np.ndarray, which: slice) -> np.ndarray:
    """Minima of the hash functions `which` over the shingles."""
    factors, shifts = FACTORS[which], SHIFTS[which]
    least = np.full(len(factors), np.uint64(2**64 - 1))
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * factors + shifts).min(axis=0), out=least)
    return mixed(least)


def signature(found: np.ndarray) -> np.ndarray:
    """K minima, each with its coordinate in the last bits."""
    return ((minima(found, slice(0, K)) & ~np.uint64(K - 1)) | np.arange(K, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, sig = [], [], [], []
        for (text,) in rows_of(batch, ["text"]):
            found = shingles(text)
            n.append(len(found))
            h1.append(int(found.sum().view(np.int64)))
            h2.append(int(mixed(found).sum().view(np.int64)))
            sig.append(signature(found) if len(found) else [])
        columns = [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "h1", "h2", "sig"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(t) for (t,) in rows_of(batch, ["text"])], pa.binary())], ["id", "z"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        found = [shingles(unpacker.decompress(z)) for (z,) in rows_of(batch, ["z"])]
        fine = [minima(x, slice(K, None)).astype(np.uint32).tobytes() for x in found]
        columns = [pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array(fine, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "shingles", "fine"])


def agreeing(outside: pa.Table, inside: pa.Table, at: Threshold) -> tuple[list, list]:
    """Pairs of rows in different components that may be links, each in the block of its first common posting only.

    Enough coordinates agree, the sizes allow a link, and so do the distances to the
    posting's pivot, as Jaccard distance obeys the triangle inequality.
    """
    read = lambda t, c: t.column(c).to_numpy()
    fine = lambda t: np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint32).reshape(-1, FINE)
    left, right = fine(outside), np.ascontiguousarray(fine(inside).T)
    n, m = read(outside, "n"), read(inside, "n")
    d, e = read(outside, "far"), read(inside, "far")
    home, other = read(outside, "component"), read(inside, "component")
    mine, theirs = read(outside, "id"), read(inside, "id")
    tokens = [frozenset(x) for x in outside.column("tokens").to_pylist()]
    listed = [frozenset(x) for x in inside.column("tokens").to_pylist()]
    apart = inside.column("apart").to_pylist()
    here = outside.column("token")[0].as_py() if len(outside) else None
    a, b = [], []
    for i in range(len(left)):
        fits = (other != home[i]) & (100 * np.minimum(n[i], m) >= at.percent * np.maximum(n[i], m))
        fits = np.flatnonzero(fits & ~(np.abs(d[i] - e) > 1.0001 - at.percent / 100))
        if len(fits):
            near = right[:, fits] if len(fits) < len(m) else right
            for j in fits[(near == left[i][:, None]).sum(axis=0) >= at.fine].tolist():
                if not (apart[j] and mine[i] > theirs[j]) and min(tokens[i] & listed[j]) == here:
                    a.append(mine[i])
                    b.append(theirs[j])
    return a, b


def _blocks(at: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by block (token, part, piece): each block's outside rows against its inside rows."""

    def met(rows: list[pa.Table]) -> pa.RecordBatch:
        block = pa.concat_tables(rows)
        outside = block.column("outside").to_numpy(zero_copy_only=False)
        pairs = agreeing(block.filter(pa.array(outside)), block.filter(pa.array(~outside)), at)
        return pa.RecordBatch.from_arrays([pa.array(x, block.schema.field("id").type) for x in pairs], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        last = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = np.stack([t.column(c).to_numpy() for c in ("token", "part", "piece")], axis=1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[lo])
                if key != last and parts:
                    yield met(parts)
                    parts = []
                last = key
                parts.append(t.slice(lo, hi - lo))
        if parts:
            yield met(parts)

    return run


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, far, linked) for pairs (a, b), from their full sets; far is the Jaccard distance."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(left, "a").join(right, "b")
    met = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    either = F.col("sum") - F.col("both")
    return met.select("a", "b", (1 - F.col("both") / either).alias("far"), (100 * F.col("both") >= percent * either).alias("linked"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of docs (doc_id, text); links are at least `percent` alike."""
    at = threshold(percent)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", utf8("text").alias("text"))
    signed = staged(docs.mapInArrow(_sign, f"doc_id {id_type}, n long, h1 long, h2 long, sig array<long>"), "near-signed")
    classes = signed.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"))
    classes = staged(classes, "near-classes")

    tokens = classes.filter("id IS NOT NULL").select("id", F.explode("sig").alias("token"))
    # staged, so that both sides of the join are exchanges and large partitions can be split
    shared = staged(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "near-shared")
    posted = tokens.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("p"), F.sum("df").alias("central"))
    useful = F.greatest(F.lit(0), F.lit(K - at.match + 1) - (K - F.size("p")))
    posted = posted.filter(F.size("p") >= at.match).select("id", "central", F.slice("p", F.lit(1), useful).alias("p"))
    heads = classes.select("id", "n", "sig").join(posted, "id").select("id", "n", "sig", "central", F.col("p.token").alias("tokens"))
    heads = staged(heads, "near-heads")

    listed = heads.select("id", "central", F.explode("tokens").alias("token"))
    pivots = listed.groupBy("token").agg(F.min(F.struct(F.negative("central").alias("c"), "id")).alias("top"), F.count("*").alias("m")).filter("m > 1")
    pivots = staged(pivots.select("token", F.col("top.id").alias("pivot"), "m"), "near-pivots")
    stars = listed.join(pivots, "token").filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    side = lambda a: heads.select(F.col("id").alias(a), F.col("n").alias(f"n_{a}"), F.col("sig").alias(f"sig_{a}"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    alike = F.size(F.array_intersect("sig_a", "sig_b")) >= at.match
    stars = staged(stars.join(side("a"), "a").join(side("b"), "b").filter(sizes & alike).select("a", "b"), "near-stars")

    packed = docs.filter("doc_id IS NOT NULL").mapInArrow(_pack, f"id {id_type}, z binary")
    sets = staged(packed.join(heads.select("id"), "id", "left_semi").mapInArrow(_sets, f"id {id_type}, shingles array<long>, fine binary"), "near-sets")
    stars = staged(compared(stars, sets, percent), "near-compared")
    links = stars.filter("linked").select("a", "b")
    found = components(links)

    rest = listed.join(pivots.filter("m > 2"), "token")
    labelled = found.select("id", "component")
    rest = rest.join(labelled, "id", "left").withColumn("component", F.coalesce("component", "id"))
    middle = pivots.filter("m > 2").join(labelled.select(F.col("id").alias("pivot"), "component"), "pivot", "left")
    middle = middle.select("token", F.coalesce("component", "pivot").alias("middle"))
    rest = rest.join(middle, "token").withColumn("outside", F.col("component") != F.col("middle")).drop("central", "middle")
    rest = staged(rest, "near-rest")
    counts = rest.filter("outside AND id <> pivot").groupBy("token").agg(F.count("*").alias("o"))
    rest = rest.filter("id <> pivot").join(counts, "token")
    rest = rest.join(stars.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "far"), ["id", "pivot"], "left")
    rest = rest.withColumn("far", F.coalesce("far", F.lit(float("nan")))).join(heads.select("id", "tokens"), "id").join(sets.select("id", F.size("shingles").cast("long").alias("n"), "fine"), "id")
    spread = lambda size: F.pmod(F.xxhash64("id"), F.ceil(size).cast("int")).cast("int")
    ways = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(size).cast("int") - 1))
    by_part, by_piece = F.col("o") / OUTSIDE, F.col("m") / INSIDE
    one = rest.filter("outside").withColumns({"part": spread(by_part), "apart": F.lit(True)}).withColumn("piece", ways(by_piece))
    two = rest.withColumns({"piece": spread(by_piece), "apart": F.col("outside"), "outside": F.lit(False)}).withColumn("part", ways(by_part))
    columns = ["token", "part", "piece", "outside", "apart", "id", "n", "component", "far", "tokens", "fine"]
    blocks = one.select(*columns).unionByName(two.select(*columns)).repartition("token", "part", "piece")
    blocks = blocks.sortWithinPartitions("token", "part", "piece")
    pairs = staged(blocks.mapInArrow(_blocks(at), f"a {id_type}, b {id_type}"), "near-pairs")
    more = staged(compared(pairs, sets, percent).filter("linked").select("a", "b"), "near-more")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    named = classes.join(found, "id", "left").select("n", "h1", "h2", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n", "h1", "h2").join(staged(named, "near-named"), ["n", "h1", "h2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without those that another document of their component stands for; rows without doc_id stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), percent).filter(~F.col("kept")).select("doc_id")
    return docs.join(staged(gone, "near-gone"), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Exact sets and all pairs that share a shingle; classes of equal sets are compared once.
ORACLE = f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT id, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda s: array_to_string(w[s : s + {SHINGLE - 1}], ' ')) END)) AS s FROM base),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each AS (SELECT c, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, count(*) AS common, any_value(a.n + b.n) AS total FROM each AS a JOIN each AS b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= {PERCENT} * (total - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, b FROM reach JOIN both_ways ON a = r),
homes AS (SELECT c, min(r) AS home FROM reach GROUP BY c)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(home, doc_id) AS component_id, doc_id = coalesce(home, doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN homes ON homes.c = classes.c
"""
