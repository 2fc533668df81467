"""Spelling variant grouping: words one edit apart, found by Aho-Corasick automata over word halves.

If two words differ by one inserted, deleted or replaced code point, one half of either lies whole in the other: its first
half at the front or its second half at the end.  A word goes to two *shards*, by the code points at its front and at its
end (LEAST // 2 of them, which any half has).  A shard's automaton holds that half of all its words; all its words are
scanned, and a half counts where it stands at the front (or the end) of a word whose length differs by one at most.  The
rests of the words that share a half are halved once more, which leaves few pairs; their distance is verified.  A pair
that meets by both halves counts in the shard of first halves.

A shard sends a row a word: how many near words it has there, and the best of them; no list of pairs is made.  Shards
have about SHARD words.  The words of an end that HOT or more share are dealt by the whole half and the length instead,
each to the shards of the three lengths that it fits.  Words with one half in common stay in one task, as arrays of
about a hundred bytes a word.

Words are kept in Latin-1, where a code point is a byte.  Null texts have none; where doc_id is null nothing is deleted.
Columns other than doc_id and text are left aside, repeated rows count again, an empty table gives no rows.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tables import remove, saved

#: Letters of a word, after A-Z are lower-cased.
LETTERS = r"[a-zÀ-ÿ]"
#: Rows a shard, and words of one end from which on its words are dealt by whole halves.
SHARD, HOT = 25_000, 10_000
#: Longest word that is compared in a matrix, and pairs compared at once.
WIDE, PAIRS = 64, 1 << 17
ENTRY, SCAN = 1, 2
NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])
NEAR_DDL = "word string, n long, n_near long, best string, best_n long"


def word_counts(docs: DataFrame, least: int = 7, times: int = 2, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(word, n): runs of letters of at least `least` code points after the deletions, that occur `times` times or more."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate(F.col(f"`{column}`"), upper, upper.lower()), F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _half(word: Column, half: int, length: Column | None = None) -> Column:
    """A word's first or second half; length: the half that a word of that length would have in common with it."""
    n = F.length("word") if length is None else length
    k = F.floor(n / 2).cast("int")
    return F.substring(word, F.lit(1), k) if half == 0 else F.substring(word, F.length(word) - (n - k) + 1, n)


def _dealt(words: DataFrame, least: int, shard: int, hot: int) -> DataFrame:
    """(shard, word, n, role): shards 0, 2, ... are of first halves, 1, 3, ... of second ones."""
    total = words.count()
    shards = max(1, math.ceil(total / shard))
    end = least // 2
    word = F.col("word")
    parts = []
    for half in (0, 1):
        key = F.substring(word, F.lit(1), F.lit(end)) if half == 0 else F.substring(word, F.length(word) - end + 1, F.lit(end))
        rows = words.withColumn("end", key)
        place = lambda *c, half=half: (F.pmod(F.xxhash64(*c), F.lit(shards)) * 2 + half).cast("int").alias("shard")
        # at most total / limit ends, 4,096 or less
        limit = max(hot, total // 4096)
        if total > limit:
            much = F.broadcast(rows.groupBy("end").count().where(F.col("count") >= limit).select("end"))
            few, many = rows.join(much, "end", "left_anti"), rows.join(much, "end", "left_semi")
            length = F.explode(F.array(F.length(word) - 1, F.length(word), F.length(word) + 1)).alias("length")
            many = many.select("word", "n", length).where(F.col("length") >= least)
            role = F.when(F.col("length") == F.length(word), ENTRY | SCAN).otherwise(SCAN).alias("role")
            parts.append(many.select(place(F.col("length"), _half(word, half, F.col("length"))), "word", "n", role))
            rows = few
        parts.append(rows.select(place(F.col("end")), "word", "n", F.lit(ENTRY | SCAN).alias("role")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


class _Words:
    """Words end to end in Latin-1, and arrays of their first and last WIDE bytes."""

    def __init__(self, column):
        self.texts = column.to_pylist()
        self.length = np.array([len(w) for w in self.texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.joined = "".join(self.texts)
        self.data = np.frombuffer(self.joined.encode("latin-1"), np.uint8)
        self.ranges = C._Eights(self.data, False)
        width = int(min(WIDE, self.length.max()))
        cells = np.arange(width)
        last = max(len(self.data) - 1, 0)
        inside = cells < self.length[:, None]
        self.front = np.where(inside, self.data[np.minimum(self.start[:, None] + cells, last)], 0)
        self.back = np.where(inside, self.data[np.maximum((self.start + self.length - 1)[:, None] - cells, 0)], 0)

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common prefixes and suffixes of pairs of words."""
        out = []
        least = np.minimum(self.length[a], self.length[b])
        for cells in (self.front, self.back):
            differ = cells[a] != cells[b]
            out.append(np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), least), least))
        for i in np.flatnonzero(np.maximum(self.length[a], self.length[b]) > WIDE).tolist():
            x, y = self.texts[a[i]].encode("latin-1"), self.texts[b[i]].encode("latin-1")
            m = int(least[i])
            for side, (p, q) in enumerate(((x[:m], y[:m]), (x[len(x) - m :][::-1], y[len(y) - m :][::-1]))):
                differ = np.flatnonzero(np.frombuffer(p, np.uint8) != np.frombuffer(q, np.uint8))
                out[side][i] = differ[0] if len(differ) else m
        return out[0], out[1]


def _hits(words: _Words, entries: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each entry, scanned words, groups they hit): a group is the entries of one length with one half."""
    length = words.length[entries]
    k = length // 2
    at = words.start[entries] + (0 if half == 0 else k)
    size = k if half == 0 else length - k
    halves = [words.joined[s : s + n] for s, n in zip(at.tolist(), size.tolist(), strict=True)]
    number = {h: i for i, h in enumerate(dict.fromkeys(halves))}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for h, i in number.items():
        automaton.add_word(h, i)
    automaton.make_automaton()
    # halves of one length come from two lengths of words: an even and an odd one
    group = np.fromiter(map(number.__getitem__, halves), np.int64, len(halves)) * 2 + length % 2
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    there = np.zeros(2 * len(number), bool)
    there[group] = True
    who, hit = [], []
    for some in np.array_split(np.arange(len(words.texts)), max(1, len(words.joined) >> 18)):
        if not len(some):
            continue
        # a blank is in no half, so none reaches over two words
        text = " ".join(words.texts[i] for i in some.tolist())
        found = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
        start = words.start[some] - words.start[some[0]] + np.arange(len(some))
        u = np.searchsorted(start, found[:, 0], side="right") - 1
        place, n = found[:, 0] + 1 - sizes[found[:, 1]] - start[u], words.length[some[u]]
        fits = place == 0 if half == 0 else found[:, 0] + 1 == start[u] + n
        for odd in (0, 1):
            g, size = found[:, 1] * 2 + odd, sizes[found[:, 1]]
            own = 2 * size + odd if half == 0 else 2 * size - odd
            ok = fits & there[g] & (np.abs(own - n) <= 1)
            who.append(some[u[ok]])
            hit.append(g[ok])
    return group, np.concatenate(who), np.concatenate(hit)


def _pairs(words: _Words, entries: np.ndarray, scans: np.ndarray, half: int):
    """(scanned word, entry, common prefix) of the pairs one edit apart whose given half is whole, portion by portion, each
    pair once, a scanned word's pairs together."""
    group, who, hit = _hits(words, entries, half)
    some = scans[who]
    who, hit = who[some], hit[some]

    def parts(word, own):
        """The two ends of what is left of words beside a half, cut as the rest of a word of length own is: ranges."""
        k = own // 2
        rest = own - k if half == 0 else k
        first, last = (words.start[word] + k, words.start[word] + words.length[word]) if half == 0 else (words.start[word], words.start[word] + words.length[word] - (own - k))
        return (first, first + rest // 2), (last - (rest - rest // 2), last)

    def keys(word, own, g):
        return [C.mix(words.ranges.hashes(s, e) ^ C.mix(g.astype(C.U) * C.U(2) + C.U(side))) for side, (s, e) in enumerate(parts(word, own))]

    of_group = np.zeros(int(group.max()) + 1, np.int64)
    of_group[group] = words.length[entries]
    held = np.concatenate(keys(entries, words.length[entries], group))
    order = np.argsort(held, kind="stable")
    held, member = held[order], np.tile(entries, 2)[order]
    by = np.argsort(who, kind="stable")
    who, hit = who[by], hit[by]
    asked = np.stack(keys(who, of_group[hit], hit), axis=1).ravel()
    who = np.repeat(who, 2)
    low, high = np.searchsorted(held, asked), np.searchsorted(held, asked, side="right")
    ends = np.cumsum(high - low)
    at = 0
    while at < len(who):
        done = ends[at - 1] if at else 0
        end = max(int(np.searchsorted(ends, done + PAIRS, side="right")), at + 1)
        while end < len(who) and who[end] == who[end - 1]:  # all of a word at once
            end += 1
        n = (high - low)[at:end]
        u = np.repeat(who[at:end], n)
        w = member[np.repeat(low[at:end], n) + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)]
        code = np.unique((u * len(words.texts) + w)[u != w])
        u, w = code // len(words.texts), code % len(words.texts)
        prefix, suffix = words.common(u, w)
        near = prefix + suffix >= np.maximum(words.length[u], words.length[w]) - 1
        near &= (prefix >= words.length[w] // 2) if half == 0 else (prefix < words.length[w] // 2)
        yield u[near], w[near]
        at = end


def _shard(table: pa.Table) -> pa.Table:
    half = table.column("shard")[0].as_py() % 2
    role, n = table.column("role").to_numpy(), table.column("n").to_numpy()
    # a word may be here for several lengths; it is one word
    rows = table.select(["word", "n", "role"]).group_by("word").aggregate([("n", "max"), ("role", "max")])
    words, n, role = _Words(rows.column("word")), rows.column("n_max").to_numpy(), rows.column("role_max").to_numpy()
    entries = np.flatnonzero(role & ENTRY)
    out = {f.name: [] for f in NEAR}
    if len(entries):
        order = np.zeros(len(n), np.int64)
        order[sorted(range(len(n)), key=words.texts.__getitem__)] = np.arange(len(n))
        for u, w in _pairs(words, entries, (role & SCAN) > 0, half):
            best = np.lexsort((order[w], -n[w], u))
            u, w = u[best], w[best]
            for i, j in C.runs(u):
                out["word"].append(words.texts[u[i]])
                out["n"].append(int(n[u[i]]))
                out["n_near"].append(j - i)
                out["best"].append(words.texts[w[i]])
                out["best_n"].append(int(n[w[i]]))
    return pa.table(out, schema=NEAR)


def near_words(words: DataFrame, least: int = 7, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, best, best_n) of (word, n): the number of words one edit away, and the one with the largest n, the
    first in code-point order of several.  words is read twice or more; write it before."""
    dealt = _dealt(words, least, shard, hot)
    found = dealt.groupBy("shard").applyInArrow(_shard, NEAR_DDL)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), "best"))).alias("top")
    both = found.union(none).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return both.select("word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.n")).alias("best_n"))


def spelling_variants(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, key: str = "doc_id", column: str = "text", shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs.  form: the near word with the largest n, if that is ratio
    times the word's or more; root: the last of the word's forms' forms."""
    words = saved(word_counts(docs, least, times, key, column), "words")
    far = F.col("best_n") >= ratio * F.col("n")
    near = near_words(words, least, shard, hot).select("word", F.when(far, F.col("best")).alias("form"), "n", "n_near", F.when(far, F.col("best_n")).alias("form_n"))
    out = saved(near, "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    remove(words)
    # n grows ratio times a form, so no chain is longer than its logarithm; each round doubles the steps made
    roots, steps = out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1
    while times * ratio ** (steps + 1) <= most:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = saved(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        steps *= 2
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
