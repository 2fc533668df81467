"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text is a row of symbols, one a character at first.  The agenda holds the adjacent pairs whose union is a piece, ordered
by the piece's score, then by place; its top is merged, which puts up to two new pairs on the agenda, until it is empty.
What is no piece then becomes its bytes, or the unknown id.

Pairs never reach over certain places, which the vocabulary shows: around a character that no longer piece holds, and
before a run of word marks if no piece has a mark behind another character.  Between such places lie *chunks*; each has
its agenda of its own, with the same result as one agenda for the text.  A task keeps the ids of the last chunks it met
(at most ``KEPT``), and takes the new chunks of a portion of texts together: each round merges the tops of all their
agendas in arrays; chunks of over ``SHORT`` symbols have a heap each.

All ids of new chunks, and all decoded texts, are compared with the sentencepiece library, batch by batch; a difference is
an error.  A library's file is read on the driver and broadcast (under a megabyte), so executors need no copy of it.

A null text is an empty one, and has no ids.  Columns other than the key and the text are left aside, equal keys are rows
of their own, an empty table gives no rows.  A text of any length is read whole; memory follows the longest one.
Normalisers with rules, marks as suffixes, and user symbols with blanks are refused.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import common as C

#: Chunks whose ids a task keeps, in two generations.
KEPT = 400_000
#: Symbols up to which chunks are merged together in arrays.
SHORT = 48
#: Text bytes whose new chunks are taken together.
PORTION = 4 << 20
MARK = "▁"
#: Above every rank.
NEVER = np.int32(2**31 - 1)
#: Fixed values of the file format: types of a piece, and the merge type of a model.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE, MERGES = 1, 2, 3, 4, 5, 6, 2
ENCODED = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

codecs.register_error("arborflow-bytes", lambda e: ("�", e.start + 1))


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: integers, and bytes for all else."""
    at = 0

    def integer() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = integer()
        if tag & 7 == 0:
            yield tag >> 3, integer()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or integer()
        yield tag >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """A model file's pieces and settings, and the tables that merging needs."""

    def __init__(self, model: bytes):
        fields = list(_fields(model))
        pieces = [dict(_fields(v)) for n, v in fields if n == 1]
        trainer = dict(_fields(b"".join(v for n, v in fields if n == 2)))
        norm = dict(_fields(b"".join(v for n, v in fields if n == 3)))
        self.texts = [p.get(1, b"").decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]) for p in pieces]
        self.prefix, self.squeeze, escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), norm.get(5, 1)
        self.fallback, self.unknown_text = bool(trainer.get(35, 0)), trainer.get(44, " ⁇ ".encode()).decode()
        users = sorted((t for t, k in zip(self.texts, self.kinds, strict=True) if k == USER), key=len, reverse=True)
        if trainer.get(3, 1) != MERGES or norm.get(2) or trainer.get(24, 0) or not escape or any(MARK in t or " " in t for t in users):
            raise ValueError("only merge-type models without normaliser rules, marked in front of words, are read")
        self.unknown = self.kinds.index(UNKNOWN)
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.bytes = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}

        self.ids = {t: i for i, (t, k) in reversed(list(enumerate(zip(self.texts, self.kinds, strict=True)))) if k in (NORMAL, USER, UNUSED)}
        self.unused = UNUSED in self.kinds
        merged = [t for t in self.ids if len(t) > 1]
        letters = sorted(set(chain.from_iterable(merged)))
        #: Symbols: every piece, and every letter of one.
        self.symbols = list(dict.fromkeys([*self.ids, *letters]))
        self.symbol = {t: i for i, t in enumerate(self.symbols)}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        rank = np.array([order[scores[self.ids[t]]] if t in self.ids else 0 for t in self.symbols], np.int32)
        user = set(users)
        pairs = {}
        for t in merged:
            for cut in range(1, len(t)):
                a, b = self.symbol.get(t[:cut]), self.symbol.get(t[cut:])
                if a is not None and b is not None and t[:cut] not in user and t[cut:] not in user:
                    pairs[a * len(self.symbols) + b] = self.symbol[t]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_unions = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.rank, self.pairs = rank, pairs
        self.outputs = [self._output(t) for t in self.symbols]
        self.piece_bytes = [self._rendered(i) for i in range(len(self.texts))]

        alone = "|".join(map(re.escape, users))
        # letters of a word and other characters are chunks apart, but for those that some piece puts side by side
        word, beside = {x: x.isalnum() for x in letters}, set()
        for t in merged:
            for a, b in zip(t, t[1:]):
                if MARK not in (a, b) and word[a] != word[b]:
                    beside |= {a, b}
        held = lambda kind: "[" + "".join(re.escape(x) for x in letters if x != MARK and (x in beside if kind is None else x not in beside and word[x] == kind)) + "]"
        some = [k for k in (True, False, None) if held(k) != "[]"]
        last = f"(?!{held(None)})" if None in some else ""
        every = "|".join(map(held, some)) or "(?!)"
        lead = f"(?!{alone})" if users else ""
        runs = [f"(?:{lead}{held(k)})++{last}" for k in some if k is not None] + [f"(?:{lead}(?:{every}))++"]
        run = f"(?:{'|'.join(runs)})"
        if self.unused:  # the way that an unused piece is cut again depends on the whole text
            pattern = f"(?:(?!{alone}).)+" if users else ".+"
        elif any(re.search(f"[^{MARK}]{MARK}", t) for t in merged):
            pattern = f"(?:{lead}(?:{MARK}|{every}))+|."
        else:
            pattern = f"{MARK}*{run}|{MARK}+|."
        self.chunks = re.compile((f"{alone}|" if users else "") + pattern, re.DOTALL).findall
        #: Chunks can be put side by side with this between them, and none of their pairs changes.
        self.guard = None if "\n" in letters or self.unused or any("\n" in t for t in users) else "\n"
        self.users = user

    def _output(self, text: str) -> tuple[int, ...]:
        """The ids of a symbol that no merge changes any more."""
        if text in self.ids:
            return (self.ids[text],)
        return tuple(self.bytes[b] for b in text.encode()) if self.fallback else (self.unknown,)

    def _rendered(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.texts[i][1:-1], 16)])
        return b"" if kind == CONTROL else (self.unknown_text if kind == UNKNOWN else self.texts[i].replace(MARK, " ")).encode()

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = (MARK if self.prefix and text else "") + text.replace(" ", MARK)
        return text.rstrip(MARK) if self.squeeze else text

    def one(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk by its agenda, a heap."""
        if chunk in self.users:
            return (self.ids[chunk],)
        base, pairs, rank = len(self.symbols), self.pairs, self.rank
        at = [self.symbol.get(x, -1) for x in chunk]  # -1: never merged
        spans = list(chunk) if self.unused or -1 in at else None
        after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
        after[-1] = -1
        agenda, undone = [], {}

        def put(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and at[i] >= 0 and at[j] >= 0:
                union = pairs.get(at[i] * base + at[j])
                if union is not None:
                    heapq.heappush(agenda, (int(rank[union]), i, at[i], at[j], union))
                    if self.unused:
                        undone[union] = at[i], at[j]

        for i in range(len(at) - 1):
            put(i, i + 1)
        gone = bytearray(len(at))
        while agenda:
            _, i, a, b, union = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j < 0 or at[i] != a or at[j] != b:
                continue
            at[i], gone[j], after[i] = union, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            put(before[i], i)
            put(i, after[i])

        def out(symbol: int):
            if self.unused and symbol in undone and self.kinds[self.ids[self.symbols[symbol]]] == UNUSED:
                left, right = undone[symbol]
                return [*out(left), *out(right)]
            return self.outputs[symbol]

        ids, i = [], 0
        while i >= 0:
            ids += out(at[i]) if at[i] >= 0 else self._output(spans[i])
            i = after[i]
        return tuple(ids)

    def many(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The ids of each chunk: in every round the tops of all agendas are merged."""
        out: list = [None] * len(chunks)
        short = []
        for i, c in enumerate(chunks):
            if len(c) == 1:
                s = self.symbol.get(c)
                out[i] = self._output(c) if s is None else self.outputs[s]
            elif len(c) > SHORT or self.unused or c in self.users:
                out[i] = self.one(c)
            else:
                short.append(i)
        # a chunk of several characters holds letters of pieces only
        letters = np.fromiter(map(self.symbol.__getitem__, chain.from_iterable(chunks[i] for i in short)), np.int32)
        sizes = np.array([len(chunks[i]) for i in short], np.int64)
        starts = np.cumsum(sizes) - sizes
        for low, high in ((1, 4), (4, 8), (8, 12), (12, 20), (20, SHORT)):
            mine = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(mine):
                continue
            cells = np.full((len(mine), int(sizes[mine].max())), -1, np.int32)
            inside = np.arange(cells.shape[1]) < sizes[mine][:, None]
            cells[inside] = letters[np.repeat(starts[mine], sizes[mine]) + np.nonzero(inside)[1]]
            self._merged(cells)
            for i, row in zip(mine.tolist(), cells.tolist(), strict=True):
                out[short[i]] = self.outputs[row[0]] if row[1] < 0 else tuple(chain.from_iterable(self.outputs[x] for x in row if x >= 0))
        return out

    def _unions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The union of each pair of symbols; -1 where there is none, or no symbol."""
        out = np.full(a.shape, -1, np.int32)
        both = (a >= 0) & (b >= 0)
        if len(self.pair_keys):
            hit, where = C.found(a[both].astype(np.int64) * len(self.symbols) + b[both], self.pair_keys)
            out[both] = np.where(hit, self.pair_unions[where], -1)
        return out

    def _merged(self, cells: np.ndarray) -> None:
        """Merges the rows of cells, symbols followed by -1, in place.  Each row loses a symbol a round until its agenda is
        empty, and then leaves."""
        ranked = lambda union: np.where(union >= 0, self.rank[union], NEVER)
        rows, sym = np.arange(len(cells)), cells.copy()
        union = self._unions(sym[:, :-1], sym[:, 1:])
        rank = ranked(union)
        while len(rows):
            at = rank.argmin(axis=1)  # the leftmost of equal ranks
            who = np.arange(len(rows))
            going = rank[who, at] < NEVER
            if not going.all():
                cells[rows[~going]] = -1
                cells[rows[~going], : sym.shape[1]] = sym[~going]
                rows, sym, union, rank, at, who = rows[going], sym[going], union[going], rank[going], at[going], who[: going.sum()]
            if sym.shape[1] == 2 or not len(rows):
                cells[rows] = -1
                cells[rows, 0] = union[:, 0] if len(rows) else -1
                return
            top = union[who, at]
            later = np.arange(sym.shape[1] - 1) > at[:, None]
            sym = np.where(later, sym[:, 1:], sym[:, :-1])
            union, rank = np.where(later[:, :-1], union[:, 1:], union[:, :-1]), np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
            sym[who, at] = top
            for side in (at - 1, at):
                some = np.flatnonzero((side >= 0) & (side < sym.shape[1] - 1))
                place = side[some]
                union[some, place] = u = self._unions(sym[some, place], sym[some, place + 1])
                rank[some, place] = ranked(u)

    def decode(self, ids) -> str:
        """The text of ids.  One word mark in front goes if the model put it there."""
        if not self.controls.isdisjoint(ids):  # bytes on their two sides make no character
            parts, at = [""], 0
            for i in [*(k for k, x in enumerate(ids) if x in self.controls), len(ids)]:
                parts.append(self._decode(ids[at:i], not any(parts) if self.squeeze else self.controls.issuperset(ids[:at])))
                at = i + 1
            return "".join(parts)
        return self._decode(ids, True)

    def _decode(self, ids, front: bool) -> str:
        out = b"".join(map(self.piece_bytes.__getitem__, ids))
        if front and (self.prefix or self.squeeze):
            for i in ids:
                if self.kinds[i] in (BYTE, UNKNOWN) or not self.texts[i].startswith(MARK):
                    break
                out = out[1:]
                if not self.squeeze or len(self.texts[i]) > 1:
                    break
        return out.decode("utf-8", "arborflow-bytes")


class Coder:
    """A vocabulary with the ids of chunks met lately, and the library beside it."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _learn(self, chunks: set[str], check: bool) -> None:
        """Puts the ids of all chunks among the young."""
        old, young = self.old, self.young
        new = []
        for c in chunks:
            ids = old.get(c)
            if ids is None:
                new.append(c)
            else:
                young[c] = ids
        if not new:
            return
        found = self.vocabulary.many(new)
        if check:
            self._check(new, found)
        young.update(zip(new, found, strict=True))

    def _check(self, chunks: list[str], ids: list[tuple[int, ...]]) -> None:
        v = self.vocabulary
        bar = v.guard
        side_by_side = bar.join(["", *chunks]).replace(MARK, " ")
        want = self.library.encode(side_by_side, num_threads=1)
        between = v.many([bar])[0]
        got = [*v.many([MARK])[0]] if v.prefix else []
        for i in ids:
            got += between
            got += i
        if got != want:
            raise ValueError("ids differ from the sentencepiece library's")

    def encode(self, texts: list[str], check: str | None) -> list[array]:
        """Ids of texts.  check: "chunks" compares those of new chunks with the library, "texts" those of all texts."""
        v = self.vocabulary
        by_chunks = check == "chunks" and v.guard is not None and not v.squeeze and v.fallback
        cut = [v.chunks(v.normal(t)) for t in texts]
        if len(self.young) > KEPT // 2:
            self.old, self.young = self.young, {}
        missing = set().union(*cut).difference(self.young)
        if missing:
            self._learn(missing, by_chunks)
        get, out = self.young.__getitem__, []
        for c in cut:
            ids = array("i", chain.from_iterable(map(get, c)))
            if not v.fallback:  # a run of unknown symbols is one
                ids = array("i", (x for k, x in enumerate(ids) if x != v.unknown or k == 0 or ids[k - 1] != v.unknown))
            out.append(ids)
        if check and not by_chunks and [x.tolist() for x in out] != self.library.encode(texts, num_threads=1):
            raise ValueError("ids differ from the sentencepiece library's")
        return out

    def decode(self, ids: list, check: str | None) -> list[str]:
        out = [self.vocabulary.decode(x) for x in ids]
        if check and out != self.library.decode([list(x) for x in ids], num_threads=1):
            raise ValueError("texts differ from the sentencepiece library's")
        return out


_coders: dict[str, Coder] = {}


def coder(model: bytes) -> Coder:
    """The process's coder of a model."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(model)
    return _coders[name]


def sentence_pieces(docs: DataFrame, model: str, key: str = "doc_id", column: str = "text", check: str | None = "chunks") -> DataFrame:
    """(key, ids, decoded) of every text: its ids by the model file at a path, and these ids' text."""
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def f(batches):
        own = coder(shared.value)
        for part in C.portions(batches, most=PORTION):
            gc.disable()  # millions of new tuples and strings, and no cycle among them
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = own.encode(texts, check)
            gc.enable()
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in ids])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.record_batch([part.column("key"), lists, pa.array(own.decode(ids, check), pa.string())], schema=ENCODED)

    rows = docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS key", f"CAST(`{column}` AS STRING) AS text")
    return rows.mapInArrow(f, "key long, ids array<int>, decoded string").withColumnRenamed("key", key)


def decoded_pieces(rows: DataFrame, model: str, key: str = "doc_id", column: str = "ids", check: bool = True) -> DataFrame:
    """(key, decoded) of rows with ids; null ids, and null among them, are none."""
    with open(model, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def f(batches):
        own = coder(shared.value)
        for batch in batches:
            ids = [[i for i in x or () if i is not None] for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(own.decode(ids, check), pa.string())], ["key", "decoded"])

    some = rows.selectExpr(f"CAST(`{key}` AS BIGINT) AS key", f"CAST(`{column}` AS ARRAY<INT>) AS ids")
    return some.mapInArrow(f, "key long, decoded string").withColumnRenamed("key", key)
