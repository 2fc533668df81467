"""Substring dedup by fixed-block anchors.

A window of ``window`` words holds a whole block of ``window // 2 + 1`` words at a multiple of that length, so the
index of non-overlapping blocks, probed with every rolling window of a block's length, misses no repeat.  The full
windows around a hit name their first place: the smallest document (and place in it) of equal windows.  Neighbouring
windows with neighbouring first places make a hit, which is then extended word by word in both directions to a maximal
repeat: each hit's words go to the document that it names, once a batch however many documents have it, and are
compared there.  The documents stay with the batch that asks: a passage in a third of all documents costs the batch of the
first one its words once a batch.  Only words of repeats confirmed in that way go.

A stretch of repeated windows is sent with each hit, ``REACH`` words to either side of the hit at most.  What a hit leaves
uncovered the next one of the same alignment covers, and repeats of one alignment that touch are one; only where over
2 * REACH words in the middle of a repeat name a still earlier document it stays in two pieces.  A window that a document
holds several times makes one hit, and its other places in the document go with it.

Nulls and empty texts have no words; a null doc_id counts as larger than all others; rows with equal doc_id do not
repeat each other.  Candidates are found by 64-bit hashes; the words themselves decide, so a collision can only leave a
repeat in.  Very long texts are read in pieces; a batch holds the hashes of its words.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from . import common as C

U = np.uint64
#: Words beyond a hit that are sent for its extension.
REACH = 64
SENT = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("fp", pa.binary()), ("anchor", pa.binary()), ("many", pa.binary())])
LIVE = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("fp", pa.binary())])
FULL = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("at", pa.binary()), ("ids", pa.binary())])
FIRST = pa.schema([("batch", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("at", pa.binary()), ("source", pa.binary())])
#: A question to the batch of a hit's first document (text), or the asking batch's note of who has the hit (docs and starts).
ASKED = pa.schema([("batch", pa.int32()), ("sender", pa.int32()), ("number", pa.int32()), ("text", pa.binary()), ("hit", pa.int32()), ("n", pa.int32()), ("first_doc", pa.int64()), ("first_at", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary())])
#: An answer to the batch that asked, or its note.
REPEATS = pa.schema([("batch", pa.int32()), ("number", pa.int32()), ("first_doc", pa.int64()), ("first_at", pa.int32()), ("skip", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary())])
REPEATS_DDL = "batch int, number int, first_doc long, first_at int, skip int, n int, h long, docs binary, starts binary"
_REPEAT = pa.struct([("start", pa.int64()), ("first_doc", pa.int64()), ("first_start", pa.int64()), ("length", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("repeats", pa.list_(_REPEAT))])
DDL = {"sent": "batch int, bucket int, fp binary, anchor binary, many binary", "live": "batch int, bucket int, fp binary", "full": "batch int, bucket int, h binary, doc binary, at binary, ids binary"}
DDL |= {"first": "batch int, h binary, doc binary, at binary, source binary", "asked": "batch int, sender int, number int, text binary, hit int, n int, first_doc long, first_at int, docs binary, starts binary"}
DDL |= {"out": "doc_id long, n_words long, n_removed long, kept string, starts array<long>, ends array<long>, repeats array<struct<start:long,first_doc:long,first_start:long,length:long>>"}


def block_size(window: int) -> int:
    return (window + 1) // 2


def _probes(words: np.ndarray, first: np.ndarray, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """bucket << 32 | fingerprint of each rolling window of a block's length, and whether it lies in one document."""
    h = C.windows(words, block)
    return ((h >> U(32)) % U(buckets)) << U(32) | (h & U(0xFFFFFFFF)), C.inside(first, block)


def send_blocks(block: int, buckets: int):
    def f(docs: pa.Table) -> pa.Table:
        words, first = C.Texts(docs.column("text")).words()
        keys, ok = _probes(words, first, block, buckets)
        place = np.arange(len(keys)) - first[C.doc_of(first)[: len(keys)]]
        k = np.sort((keys << U(1) | (place % block != 0).astype(U))[ok])  # anchors first among equals
        at = C.groups(k >> U(1))
        many = np.diff(np.append(at, len(k))) > 1
        k = k[at]
        anchor, k = (k & U(1)) == 0, k >> U(1)
        rows = {x: [] for x in SENT.names}
        batch = docs.column("batch")[0].as_py()
        for b, i, j in C.buckets_of(k >> U(32)):
            for x, v in zip(SENT.names, (batch, b, k[i:j].astype(np.uint32).tobytes(), np.packbits(anchor[i:j]).tobytes(), np.packbits(many[i:j]).tobytes()), strict=True):
                rows[x].append(v)
        return C.table_of(SENT, rows)

    return f


def find_live(sent: pa.Table) -> pa.Table:
    """Fingerprints of a bucket that occur at an anchor and at another place."""
    n = C.sizes(sent.column("fp"), 4)
    fp = C.joined(sent.column("fp"), np.uint32)
    bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(m)) for x, m in zip(sent.column(c), n, strict=True)])
    order = np.argsort(fp, kind="stable")
    at = C.groups(fp[order])
    size = np.diff(np.append(at, len(fp)))
    live = np.maximum.reduceat(bits("anchor")[order], at).astype(bool) & ((size > 1) | np.maximum.reduceat(bits("many")[order], at).astype(bool))
    hit = np.zeros(len(fp), bool)
    hit[order] = np.repeat(live, size)
    rows = {x: [] for x in LIVE.names}
    for batch, bucket, i, m in zip(sent.column("batch").to_pylist(), sent.column("bucket").to_pylist(), np.cumsum(n) - n, n, strict=True):
        if (mine := fp[i : i + m][hit[i : i + m]]).size:
            for x, v in zip(LIVE.names, (batch, bucket, mine.tobytes()), strict=True):
                rows[x].append(v)
    return C.table_of(LIVE, rows)


def _narrow(n: int):
    """The type for numbers below n."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def send_windows(window: int, block: int, buckets: int):
    """The distinct windows of a batch near live anchors, each with its first place in the batch."""

    def f(docs: pa.Table, live: pa.Table) -> pa.Table:
        rows = {x: [] for x in FULL.names}
        if docs.num_rows and live.num_rows:
            keys_live = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32).astype(U) | U(b) << U(32) for x, b in zip(live.column("fp"), live.column("bucket").to_pylist(), strict=True)]))
            words, first = C.Texts(docs.column("text")).words()
            keys, ok = _probes(words, first, block, buckets)
            hit = np.concatenate([[0], np.cumsum(C.found(keys, keys_live)[0] & ok)])
            full, whole = C.windows(words, window), C.inside(first, window)
            wide = window - block + 1  # anchors that a window can hold
            near = hit[np.minimum(np.arange(len(full)) + wide, len(hit) - 1)] > hit[: len(full)]
            pick = np.flatnonzero(near & whole)
            row = C.doc_of(first)[pick]
            names, doc = np.unique(C.ids(docs), return_inverse=True)  # so a document's number has the order of its id
            h, doc, at = full[pick], doc[row].astype(np.uint32), (pick - first[row]).astype(np.uint32)
            bucket = (h >> U(40)) % U(buckets)
            order = np.lexsort((at, doc, h, bucket))
            h, doc, at, bucket = h[order], doc[order], at[order], bucket[order]
            least = C.groups(h)
            h, doc, at, bucket = h[least], doc[least], at[least], bucket[least]
            batch = docs.column("batch")[0].as_py()
            for b, i, j in C.buckets_of(bucket):
                used, mine = np.unique(doc[i:j], return_inverse=True)
                for x, v in zip(FULL.names, (batch, b, h[i:j].tobytes(), mine.astype(_narrow(len(used))).tobytes(), at[i:j].tobytes(), names[used].tobytes()), strict=True):
                    rows[x].append(v)
        return C.table_of(FULL, rows)

    return f


def find_first(sent: pa.Table) -> pa.Table:
    """For each window that a batch sent, the first place of all batches and that place's batch, where it is not in the
    batch's own first document."""
    n = C.sizes(sent.column("h"), 8)
    h, at = C.joined(sent.column("h"), U), C.joined(sent.column("at"), np.uint32)
    doc = np.concatenate([np.frombuffer(i.as_buffer(), np.int64)[np.frombuffer(d.as_buffer(), _narrow(len(i.as_buffer()) // 8))] for i, d in zip(sent.column("ids"), sent.column("doc"), strict=True)])
    source = np.repeat(sent.column("batch").to_numpy().astype(np.int32), n)
    order = np.lexsort((at, doc, h))
    head = C.groups(h[order])
    first = np.empty(len(h), np.int64)
    first[order] = np.repeat(order[head], np.diff(np.append(head, len(h))))
    rows = {x: [] for x in FIRST.names}
    for batch, i, m in zip(sent.column("batch").to_pylist(), np.cumsum(n) - n, n, strict=True):
        mine = np.arange(i, i + m)
        mine = mine[first[mine] != mine]
        if len(mine):
            to = first[mine]
            for x, v in zip(FIRST.names, (batch, h[mine].tobytes(), doc[to].tobytes(), at[to].tobytes(), source[to].tobytes()), strict=True):
                rows[x].append(v)
    return C.table_of(FIRST, rows)


def _hits(docs: pa.Table, firsts: pa.Table, words: np.ndarray, first: np.ndarray, window: int):
    """The batch's hits: first word, windows, row, the batch, document and place that it repeats, the first and last window
    of its stretch, and whether its row has windows that occur in it more than once."""
    h, whole = C.windows(words, window), C.inside(first, window)
    pick = np.flatnonzero(whole)
    row = C.doc_of(first)[pick]
    doc, at = C.ids(docs)[row], pick - first[row]
    fh = C.joined(firsts.column("h"), U)
    by = np.argsort(fh)
    there, where = C.found(h[pick], fh[by])
    where = by[where] if len(by) else where
    # the first place: what the bucket said, or else the smallest of the batch's own
    own = np.arange(len(pick))
    order = np.argsort(h[pick], kind="stable")
    same = h[pick][order][1:] == h[pick][order][:-1]
    some = order[np.append(same, False) | np.append(False, same)] if len(pick) else order
    some = some[np.lexsort((at[some], doc[some], h[pick][some]))]
    head = C.groups(h[pick][some])
    own[some] = np.repeat(some[head], np.diff(np.append(head, len(some))))
    to_doc, to_at = doc[own], at[own]
    batch = np.full(len(pick), docs.column("batch")[0].as_py(), np.int64)
    if there.any():
        w = where[there]
        to_doc[there], to_at[there] = C.joined(firsts.column("doc"), np.int64)[w], C.joined(firsts.column("at"), np.uint32)[w]
        batch[there] = C.joined(firsts.column("source"), np.int32)[w]
    hit = np.flatnonzero(to_doc < doc)
    pick, row, to_doc, to_at, batch, h = pick[hit], row[hit], to_doc[hit], to_at[hit], batch[hit], h[pick[hit]]
    gap = np.ones(len(pick), bool)  # a stretch of windows, one after the other
    gap[1:] = (np.diff(pick) != 1) | (np.diff(row) != 0)
    begin = pick[np.maximum.accumulate(np.where(gap, np.arange(len(pick)), 0))]
    end = pick[(np.append(np.flatnonzero(gap)[1:], len(pick)) - 1)[np.cumsum(gap) - 1]] if len(pick) else begin
    # a window that its document has already had needs no hit of its own; cut() finds it again
    order = np.lexsort((pick, h, row))
    one = np.ones(len(pick), bool)
    one[order[1:]] = (np.diff(h[order]) != 0) | (np.diff(row[order]) != 0)
    again = np.zeros(len(first), bool)
    again[row[~one]] = True
    pick, row, to_doc, to_at, batch, begin, end = (x[one] for x in (pick, row, to_doc, to_at, batch, begin, end))
    new = np.ones(len(pick), bool)
    new[1:] = (np.diff(pick) != 1) | (np.diff(row) != 0) | (np.diff(to_doc) != 0) | (np.diff(to_at) != 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(pick)))
    return pick[head], n, row[head], batch[head], to_doc[head], to_at[head], begin[head], end[head], again[row[head]]


def ask(window: int):
    """Each hit with the words around it, to the batch that holds its first place; equal ones of a batch once."""

    def f(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        out: dict[tuple, list] = {}
        if docs.num_rows:
            texts = C.Texts(docs.column("text"))
            words, first = texts.words()
            ids, now, split = C.ids(docs), -1, []
            for p, n, row, batch, doc, at, begin, end, again in zip(*(x.tolist() for x in _hits(docs, firsts, words, first, window)), strict=True):
                if row != now:
                    now, split, base = row, texts.text(row).split(), int(first[row])
                a, b = max(begin, p - REACH) - base, min(end, p + n - 1 + REACH) + window - base
                key = (batch, b" ".join(split[a:b]), p - base - a, n, doc, at)
                out.setdefault(key, []).append((int(ids[row]), 2 * a + again))
        sender = docs.column("batch")[0].as_py() if docs.num_rows else 0
        rows = {x: [] for x in ASKED.names}
        for number, ((batch, text, hit, n, doc, at), who) in enumerate(out.items()):
            d, s = np.array(who, np.int64).T  # twice the start, and 1 if the document repeats windows within itself
            for values in ((batch, sender, number, text, hit, n, doc, at, None, None), (sender, sender, number, None, None, None, None, None, d.tobytes(), s.astype(np.int32).tobytes())):
                for x, v in zip(ASKED.names, values, strict=True):
                    rows[x].append(v)
        return C.table_of(ASKED, rows)

    return f


def extended(text: list[bytes], hit: int, other: list[bytes], at: int) -> tuple[int, int]:
    """(from, to) in text of the longest equal run through text[hit] and other[at]; empty if these differ."""
    most = min(len(text) - hit, len(other) - at)
    if text[hit : hit + most] == other[at : at + most]:
        to = hit + max(most, 0)
    else:
        to = hit + next(i for i in range(most) if text[hit + i] != other[at + i])
    most = min(hit, at)
    if text[hit - most : hit] == other[at - most : at]:
        return hit - most, to
    return hit - next(i for i in range(most) if text[hit - 1 - i] != other[at - 1 - i]), to


def digest(words: list[bytes]) -> int:
    """A signed 63-bit digest of words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1


def extend(window: int):
    """Compares hits with the words of the documents that they name; yields confirmed maximal repeats."""

    def f(docs: pa.Table, asked: pa.Table) -> pa.Table:
        rows = {x: [] for x in REPEATS.names}
        if docs.num_rows and asked.num_rows:
            texts, of = C.Texts(docs.column("text")), {}
            for i, d in enumerate(C.ids(docs).tolist()):
                of.setdefault(d, []).append(i)
            note = pc.is_valid(asked.column("docs"))
            for number, who, starts in zip(*(asked.filter(note).column(c) for c in ("number", "docs", "starts")), strict=True):
                for x, v in zip(REPEATS.names, (docs.column("batch")[0].as_py(), number.as_py(), None, None, None, None, None, who.as_py(), starts.as_py()), strict=True):
                    rows[x].append(v)
            now, split = None, []
            asked = asked.filter(pc.invert(note)).sort_by("first_doc")
            for k in range(asked.num_rows):
                sender, number, text, hit, n, doc, at = (asked.column(c)[k] for c in ASKED.names[1:8])
                if doc.as_py() != now:
                    now = doc.as_py()
                    split = [texts.text(i).split() for i in of.get(now, [])]
                mine, hit, at = text.as_py().split(b" "), hit.as_py(), at.as_py()
                for other in split:  # rows with equal doc_id: each that agrees
                    if at >= len(other):
                        continue
                    a, b = extended(mine, hit, other, at)
                    if b - a >= window and a <= hit and b >= hit + n.as_py() - 1 + window:
                        for x, v in zip(REPEATS.names, (sender.as_py(), number.as_py(), now, at - hit + a, a, b - a, digest(mine[a:b]), None, None), strict=True):
                            rows[x].append(v)
                        break
        return C.table_of(REPEATS, rows)

    return f


def joined(found: list[dict]) -> list[dict]:
    """Repeats of a document in the order of their starts; those of one alignment with one document that touch are one."""
    out: dict[tuple, list] = {}
    for x in sorted(found, key=lambda x: x["start"]):
        runs = out.setdefault((x["first_doc"], x["start"] - x["first_start"]), [])
        if runs and x["start"] <= runs[-1]["start"] + runs[-1]["length"]:
            runs[-1]["length"] = max(runs[-1]["length"], x["start"] + x["length"] - runs[-1]["start"])
        else:
            runs.append(dict(x))
    return sorted((x for runs in out.values() for x in runs), key=lambda x: (x["start"], x["first_doc"], x["first_start"]))


def cut(window: int):
    def f(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        of: dict[int, set] = {}
        note = pc.is_valid(repeats.column("docs"))
        answers: dict[int, tuple] = {}
        for number, *answer in zip(*(repeats.filter(pc.invert(note)).column(c).to_pylist() for c in REPEATS.names[1:7]), strict=True):
            answers[number] = answer
        for number, who, starts in zip(*(repeats.filter(note).column(c) for c in ("number", "docs", "starts")), strict=True):
            if (answer := answers.get(number.as_py())) is not None:
                first_doc, first_at, skip, n, h = answer
                for d, s in zip(np.frombuffer(who.as_buffer(), np.int64).tolist(), np.frombuffer(starts.as_buffer(), np.int32).tolist(), strict=True):
                    of.setdefault(d, set()).add((s + 2 * skip, first_doc, first_at, n, h))
        texts = C.Texts(docs.column("text"))
        rows = {x: [] for x in OUT.names}
        for i, (doc_id, d) in enumerate(zip(docs.column("doc_id").to_pylist(), C.ids(docs).tolist(), strict=True)):
            w, found, again = texts.text(i).split(), [], False
            stay = np.ones(len(w), bool)
            for s, first_doc, first_at, n, h in sorted(of.get(d, ())):
                s, again = s >> 1, again or s & 1
                # of rows with equal doc_id, those that have the words there
                if digest(w[s : s + n]) == h:
                    stay[s : s + n] = False
                    found.append({"start": s, "first_doc": first_doc, "first_start": first_at, "length": n})
            if again and found:
                held = {hash(tuple(w[j : j + window])): j for x in found for j in range(x["start"], x["start"] + x["length"] - window + 1)}
                for j in range(len(w) - window + 1):
                    if (k := held.get(hash(tuple(w[j : j + window])))) is not None and w[j : j + window] == w[k : k + window]:
                        stay[j : j + window] = False
            found = joined(found)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (~stay).view(np.int8), [0]]))) if found else np.zeros(0, np.int64)
            kept = b" ".join(compress(w, stay.tolist()) if found else w)
            for x, v in zip(OUT.names, (doc_id, len(w), int(len(w) - stay.sum()), kept, edge[::2], edge[1::2], found), strict=True):
                rows[x].append(v)
        return C.table_of(OUT, rows)

    return f


def substring_dedup(docs: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), starts and ends of the removed word
    spans, and repeats (start, first_doc, first_start, length: maximal runs of words that a document with a smaller key
    holds as well), for each row of docs.  A word goes if a window of ``window`` words over it also starts in a document
    with a smaller key."""
    if window < 2:
        raise ValueError("window must be 2 words or more")
    block = block_size(window)
    plan = C.Plan(docs, text, key)
    buckets = plan.buckets(1 / 6)
    sent = plan.emit(send_blocks(block, buckets), DDL["sent"])
    live = C.decide(sent, find_live, DDL["live"])
    full = plan.answer(live, send_windows(window, block, buckets), DDL["full"])
    firsts = C.decide(full, find_first, DDL["first"])
    asked = plan.answer(firsts, ask(window), DDL["asked"])
    repeats = plan.answer(asked, extend(window), REPEATS_DDL)
    return plan.answer(repeats, cut(window), DDL["out"])
