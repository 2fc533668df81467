"""Merge-type vocabularies against the sentencepiece library, and against merging pair by pair."""

import hashlib
import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from arborflow.llm import queries as Q
from arborflow.llm.sentencepieces import BYTE, CONTROL, MARK, NORMAL, UNKNOWN, UNUSED, USER, Coder, Vocabulary, decoded_pieces, sentence_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abcd .,\n" + MARK + "é東😀x"


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for tag, v in fields:
        if isinstance(v, float):
            out += number(tag << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += number(tag << 3) + number(v)
        else:
            out += number(tag << 3 | 2) + number(len(v)) + v
    return out


def model(seed, fallback=True, prefix=True, squeeze=False, unused=False, users=(), spanning=False, ties=False):
    """A small model file with random pieces over LETTERS."""
    r = random.Random(seed)
    texts = list(dict.fromkeys(LETTERS.replace(" ", "").replace("\n", "").replace("x", "")))
    texts = [t for t in texts if t not in users]
    whole = {*texts, *users}
    while len(texts) < 60:
        t = "".join(r.choice("abcd.,é" + MARK * (spanning or 0)) for _ in range(r.randrange(2, 5)))
        t = r.choice(["", MARK, MARK * 2]) + t
        if t not in whole:
            whole.add(t)
            texts.append(t)
    pieces = [(b"<unk>", 0.0, UNKNOWN), (b"<s>", 0.0, CONTROL), (b"</s>", 0.0, CONTROL)]
    if fallback:
        pieces += [(f"<0x{b:02X}>".encode(), 0.0, BYTE) for b in range(256)]
    pieces += [(u.encode(), 0.0, USER) for u in users]
    order = list(range(len(texts)))
    r.shuffle(order)
    pieces += [(t.encode(), float(-(o // 3 if ties else o)), UNUSED if unused and len(t) > 1 and r.random() < 0.3 else NORMAL) for t, o in zip(texts, order)]
    trainer = message((3, 2), (35, int(fallback)), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))
    return b"".join(message((1, message((1, t), (2, s), (3, k)))) for t, s, k in pieces) + message((2, trainer), (3, message((1, b"identity"), (3, int(prefix)), (4, int(squeeze)))))


def texts(seed, letters=LETTERS, n=60):
    r = random.Random(seed)
    out = ["", " ", "  ", "\n", "a", " a", "a ", "\n a", MARK, "x", "xx", "abcd" * 50, "a b  c   d", "xx東xx"]
    return out + ["".join(r.choice(letters) for _ in range(r.randrange(1, 90))) for _ in range(n)]


CASES = {
    "plain": {}, "ties": {"ties": True}, "no bytes": {"fallback": False}, "no prefix": {"prefix": False}, "squeezed": {"squeeze": True},
    "unused": {"unused": True}, "users": {"users": ("ab", "abc", ".", "c\nd")}, "marks inside": {"spanning": True},
    "all": {"unused": True, "users": ("b,", "da"), "spanning": True, "ties": True, "fallback": False, "squeeze": True},
}


@pytest.mark.parametrize("how", CASES.values(), ids=CASES.keys())
def test_as_the_library(how):
    for seed in range(12):
        m = model(seed, **how)
        coder, library = Coder(m), sentencepiece.SentencePieceProcessor(model_proto=m)
        some = texts(seed)
        for check in ("texts", "chunks", None):
            got = [x.tolist() for x in coder.encode(some, check)]
            assert got == library.encode(some)
        assert coder.decode(got, check="texts") == library.decode(got)
        r = random.Random(seed)
        ids = [[r.randrange(library.get_piece_size()) for _ in range(r.randrange(12))] for _ in range(300)]
        assert coder.decode(ids, None) == library.decode(ids)


def test_agenda_in_arrays_and_in_heaps():
    with open(PATH, "rb") as f:
        v = Vocabulary(f.read())
    r = random.Random(4)
    chunks = ["".join(r.choice("abcdeinrst,.é") for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    chunks = [x for c in chunks for x in v.chunks(MARK * r.randrange(3) + c)]

    def plain(chunk):  # the best pair of all, the leftmost first, until there is none
        parts = list(chunk)
        while True:
            pairs = [(int(v.rank[v.symbol[a + b]]), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in v.ids]
            if not pairs:
                return tuple(v.ids[p] for p in parts)
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    want = [plain(c) for c in chunks]
    assert v.many(chunks) == want == [v.one(c) for c in chunks]


ODD = [None, "", " ", "plain words.", "tab\there\r\nand\n\nlines  of   blanks ", "naïve <s> </s> <unk> <0x41> ▁ 東京 😀\U0010ffff\x00\x01", "ﬁ Å Á", "a" * 200_000, "w " * 50_000, "é" * 70_000]


def test_query_table(spark, tmp_path):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD)] + [(3, "again", "", "", ""), (None, "a null id", "", "", ""), (3, "again", "", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, key string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, Q.op12_sentencepieces(spark, str(tmp_path)).collect()), key=order) == sorted(want, key=order)
    out = sentence_pieces(df, PATH, check="texts")
    back = decoded_pieces(out.select("doc_id", "ids"), PATH)
    assert sorted(map(str, back.collect())) == sorted(map(str, out.select("doc_id", "decoded").collect()))
    assert sentence_pieces(df.where("false"), PATH).collect() == []


def test_whole_texts_of_a_table(spark):
    d = "/root/testdata/sf0.01"
    out = sentence_pieces(spark.read.parquet(f"{d}/documents.parquet"), PATH, check="texts")
    assert out.where("decoded IS NULL").count() == 0
    got = Q.op12_sentencepieces(spark, d)
    assert got.agg(F.sum("n_tokens")).first()[0] == out.agg(F.sum(F.size("ids"))).first()[0]


def test_other_models_are_refused():
    broken = message((1, message((1, b"<unk>"), (3, UNKNOWN)))) + message((2, message((3, 1))))
    with pytest.raises(ValueError):
        Vocabulary(broken)
