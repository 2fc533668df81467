"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are tokens: words in lower case (A-Z), cut at white space and ASCII punctuation.  Documents
and items that share a seed of ``seed`` tokens meet in a join.  For a pair, tiles are marked greedily: the longest matches
first, none over another, down to ``seed`` tokens, found by running Karp-Rabin at falling lengths.  An item leaks into a
document if tiles cover at least ``threshold`` of its tokens; as tiles may lie in any order, reordered passages count.
Items shorter than ``seed`` tokens match whole.

An item is indexed under its rarest seeds only: its seeds that most items share are left out as long as what they cover
together stays below the threshold.  A document that leaks the item holds one of the others, so nothing is lost, and a
phrase common to many items brings up none of them.  Documents are probed against a bit filter of the index, of at most
``FILTER_BITS`` bits, in the scan; only texts with a hit move, once for all copies of a text, to be joined by seed and tiled
in buckets.  A benchmark too large for the filter lets more texts through and changes no result.

A null or empty text, and an item without tokens, leak nothing.  A null doc_id or item_id is a value like others.  Items with
equal tokens are tiled once.  Rows with equal doc_id are one document; it leaks what any of its rows leaks.  Ties of equally
long matches go to the smaller place in the item, then in the text.  Texts are read whole, one at a time in memory.  Extra
columns are left aside; empty tables give no leaks.  Tokens and seeds are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tables import remove, saved

U = np.uint64
#: Tokens of a seed, share of an item that counts, most bits of the filter, bits that a seed gets below that, and sets.
SEED, THRESHOLD, FILTER_BITS, SEED_BITS, HASHES = 5, 0.5, 1 << 27, 64, 4
#: Bytes of text that a bucket tiles on average, and bytes of a piece of the filter.
BUCKET_BYTES, PIECE = 8 << 20, 1 << 13
GAP = C.IS_SPACE.copy()
GAP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SEEDS = pa.schema([("item", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("size", pa.int32()), ("h", pa.int64())])
SEEDS_DDL = "item long, n int, pos int, size int, h long"
HITS = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("text", pa.string()), ("hs", pa.list_(pa.int64()))])
OUT = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("item", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("doc_starts", pa.list_(pa.int64())), ("item_starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
OUT_DDL = "t1 long, t2 long, item long, coverage double, n_tiles long, doc_starts array<long>, item_starts array<long>, lengths array<long>"


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    return C.Texts(column).words(lower=True, separators=GAP)


def item_of(words: np.ndarray) -> int:
    """The name of an item's tokens."""
    return xxhash.xxh3_64_intdigest(words.tobytes()) >> 1


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token hash arrays: (doc start, item start, length), longest first; ties go to the
    smaller item start, then the smaller doc start."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    length = min(len(doc), len(item))
    while length >= least:
        # running Karp-Rabin: unmarked windows of this length that both sides hold
        at_i = _free_windows(free_i, length)
        at_d = _free_windows(free_d, length)
        hi, hd = C.windows(item, length)[at_i], C.windows(doc, length)[at_d]
        common = np.intersect1d(hi, hd)
        if not len(common):
            length = _next(doc, item, free_d, free_i, length - 1, least)
            continue
        at_i, at_d = at_i[np.isin(hi, common)], at_d[np.isin(hd, common)]
        where = defaultdict(list)
        for j, h in zip(at_d.tolist(), C.windows(doc, length)[at_d].tolist(), strict=True):
            where[h].append(j)
        for i, h in zip(at_i.tolist(), C.windows(item, length)[at_i].tolist(), strict=True):
            if not free_i[i : i + length].all():
                continue
            for j in where[h]:
                if free_d[j : j + length].all() and (doc[j : j + length] == item[i : i + length]).all():
                    free_d[j : j + length] = free_i[i : i + length] = False
                    out.append((j, i, length))
                    break
        length = _next(doc, item, free_d, free_i, length - 1, least)
    return out


def _free_windows(free: np.ndarray, length: int) -> np.ndarray:
    used = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(used[length:] == used[:-length]) if length <= len(free) else np.zeros(0, np.int64)


def _next(doc, item, free_d, free_i, most: int, least: int) -> int:
    """The largest length up to most at which unmarked windows match, by bisection; below least if there is none."""
    lo, hi = least - 1, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        a, b = _free_windows(free_i, mid), _free_windows(free_d, mid)
        if len(a) and len(b) and np.isin(C.windows(item, mid)[a], C.windows(doc, mid)[b]).any():
            lo = mid
        else:
            hi = mid - 1
    return lo


def send_seeds(seed: int):
    """The seeds of items: name of the item, its tokens, place, tokens and hash of the seed."""

    def f(batches):
        for batch in batches:
            words, first = tokens(batch.column("text"))
            out = {x: [] for x in SEEDS.names}
            for a, b in zip(first[:-1], first[1:], strict=True):
                if a < b:
                    size = min(seed, int(b - a))
                    h = C.windows(words[a:b], size).view(np.int64)
                    for x, v in zip(SEEDS.names, (np.full(len(h), item_of(words[a:b])), np.full(len(h), b - a), np.arange(len(h)), np.full(len(h), size), h), strict=True):
                        out[x].append(v)
            if out["h"]:
                yield from pa.table({f.name: pa.array(np.concatenate(out[f.name]), f.type) for f in SEEDS}, schema=SEEDS).to_batches()

    return f


def keep_rare(threshold: float):
    """Of each item's seeds, those that it is indexed under."""

    def f(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("item", "ascending"), ("n_items", "descending"), ("pos", "ascending")])
        pos, size, n = (rows.column(c).to_numpy() for c in ("pos", "size", "n"))
        keep = np.ones(rows.num_rows, bool)
        for i, j in C.runs(rows.column("item").to_numpy()):
            covered = np.zeros(int(n[i]), bool)
            for k in range(i, j):
                covered[pos[k] : pos[k] + size[k]] = True
                if covered.sum() >= threshold * n[i]:
                    break
                keep[k] = False
        return rows.select(["h", "item", "size"]).filter(pa.array(keep))

    return f


def bit_of(h: np.ndarray, k: int, n_bits: int) -> np.ndarray:
    return (C.mix(h + U(k * int(C.GOLDEN) % (1 << 64))) % U(n_bits)).astype(np.int64)


def filter_bits(n_bits: int):
    def f(batches):
        bits = np.zeros(n_bits, bool)
        for batch in batches:
            for k in range(HASHES):
                bits[bit_of(batch.column("h").to_numpy().view(U), k, n_bits)] = True
        packed = np.packbits(bits, bitorder="little")
        for i in range(0, len(packed), PIECE):
            if packed[i : i + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // PIECE], pa.int32()), pa.array([packed[i : i + PIECE].tobytes()], pa.binary())], names=["piece", "bits"])

    return f


def add_bits(rows: pa.Table) -> pa.Table:
    total = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("bits")])
    return pa.table({"piece": rows.column("piece").combine_chunks()[:1], "bits": pa.array([total.tobytes()], pa.binary())})


def probe(sizes: list[int], packed: np.ndarray, n_bits: int):
    """Texts with seeds whose bits the filter has, and the hashes of these."""

    def f(batches):
        for batch in C.portions(batches):
            texts, hits = C.Texts(batch.column("text")), defaultdict(list)
            words, first = texts.words(lower=True, separators=GAP)
            docs = C.doc_of(first)
            for size in sizes:
                h, ok = C.windows(words, size), C.inside(first, size)
                hit = np.flatnonzero(ok)
                for k in range(HASHES):
                    bit = bit_of(h[hit], k, n_bits)
                    hit = hit[(packed[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)]
                for i, j in C.runs(docs[hit]):
                    hits[int(docs[hit[i]])].append(h[hit[i:j]].view(np.int64))
            out = {x: [] for x in HITS.names}
            for d, hs in sorted(hits.items()):
                name = xxhash.xxh3_128_intdigest(texts.text(d))
                for x, v in zip(HITS.names, (batch.column("doc_id")[d].as_py(), (name >> 64) >> 1, (name & (1 << 64) - 1) >> 1, batch.column("text")[d].as_py(), np.unique(np.concatenate(hs))), strict=True):
                    out[x].append(v)
            yield from C.table_of(HITS, out).to_batches()

    return f


def tile(seed: int, threshold: float):
    """Tilings of a bucket's texts by the items that they share a seed with; those that reach the threshold."""

    def f(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        out = {x: [] for x in OUT.names}
        words, first = tokens(texts.column("text"))
        row = {t: i for i, t in enumerate(zip(texts.column("t1").to_pylist(), texts.column("t2").to_pylist(), strict=True))}
        item_words, item_first = tokens(pairs.column("item_text"))
        for k, (t1, t2, name) in enumerate(zip(*(pairs.column(c).to_pylist() for c in ("t1", "t2", "item")), strict=True)):
            doc, item = words[first[row[t1, t2]] : first[row[t1, t2] + 1]], item_words[item_first[k] : item_first[k + 1]]
            least = min(seed, len(item))
            can = np.zeros(len(item) + 1, np.int64)
            at = np.flatnonzero(np.isin(C.windows(item, least), C.windows(doc, least)))
            np.add.at(can, at, 1)
            np.add.at(can, at + least, -1)
            if (np.cumsum(can)[:-1] > 0).sum() < threshold * len(item):
                continue  # no tiling can cover more than its seeds
            got = tiles(doc, item, least)
            coverage = sum(n for _, _, n in got) / len(item)
            if coverage >= threshold:
                for x, v in zip(OUT.names, (t1, t2, name, coverage, len(got), [t[0] for t in got], [t[1] for t in got], [t[2] for t in got]), strict=True):
                    out[x].append(v)
        return C.table_of(OUT, out)

    return f


def name_items(batches):
    for batch in batches:
        words, first = tokens(batch.column("text"))
        names = [item_of(words[a:b]) if a < b else None for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column("item_id"), batch.column("text")], names=["item", "item_id", "text"])


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and the tiles' doc_starts, item_starts and lengths, in tokens, for each
    document and benchmark item that it leaks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    items = saved(items.mapInArrow(name_items, "item long, item_id long, text string").where("item IS NOT NULL"), "items")
    once = items.groupBy("item").agg(F.min("text").alias("text"))
    seeds = saved(once.select("text").mapInArrow(send_seeds(seed), SEEDS_DDL), "seeds")
    held = seeds.groupBy("h").agg(F.countDistinct("item").alias("n_items"))
    n_seeds = seeds.count()
    bucket = F.pmod(F.xxhash64("item"), F.lit(max(1, n_seeds // 1_000_000))).cast("int")
    index = seeds.join(held, "h").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(keep_rare(threshold), "h long, item long, size int")
    index = saved(index.distinct(), "index")
    sizes = sorted(r.size for r in index.select("size").distinct().collect())  # numbers up to seed
    n_bits = min(FILTER_BITS, max(8 * PIECE, 1 << math.ceil(math.log2(max(1, SEED_BITS * n_seeds)))))
    packed = np.zeros(n_bits // 8, np.uint8)
    # at most FILTER_BITS
    for r in index.select("h").mapInArrow(filter_bits(n_bits), "piece int, bits binary").groupBy("piece").applyInArrow(add_bits, "piece int, bits binary").toLocalIterator():
        packed[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.bits, np.uint8)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    hits = saved(texts.mapInArrow(probe(sizes, packed, n_bits), "doc_id long, t1 long, t2 long, text string, hs array<long>"), "hits")
    n_buckets = max(1, math.ceil(C.text_bytes(hits) / BUCKET_BYTES))
    dealt = F.pmod(F.col("t1"), F.lit(n_buckets)).cast("int").alias("bucket")
    found = hits.groupBy("t1", "t2").agg(F.any_value("text").alias("text"), F.any_value("hs").alias("hs"))
    pairs_ = saved(found.select("t1", "t2", F.explode("hs").alias("h")).join(index, "h").select("t1", "t2", "item").distinct(), "pairs")
    pairs = pairs_.join(once.withColumnRenamed("text", "item_text"), "item").select("t1", "t2", "item", "item_text", dealt)
    tiled = found.select("t1", "t2", "text", dealt).groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(tile(seed, threshold), OUT_DDL)
    tiled = saved(tiled, "tiled")
    members = saved(hits.select("doc_id", "t1", "t2").distinct(), "members")
    remove(hits, pairs_, seeds, index)
    out = tiled.join(members, ["t1", "t2"]).join(items.select("item", "item_id").distinct(), "item")
    return out.select("doc_id", "item_id", "coverage", "n_tiles", "doc_starts", "item_starts", "lengths")


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (of the largest coverage, the smallest such) and coverage (0 if none) for
    each doc_id of docs; rows with equal doc_id are one document here."""
    named = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    best = leaks(docs, benchmark, seed, threshold).groupBy("doc_id").agg(F.countDistinct(named).alias("n_items"), F.max(F.struct("coverage", (-F.col("item_id")).alias("i"))).alias("m"))
    best = best.select(F.col("doc_id").alias("_id"), "n_items", (-F.col("m.i")).alias("item_id"), F.col("m.coverage").alias("coverage"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(best, F.expr("doc_id <=> _id"), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
