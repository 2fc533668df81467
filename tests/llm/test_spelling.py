"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from arborflow.llm import queries as Q
from arborflow.llm.spelling import spelling_variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=7, times=2, ratio=10):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= times}
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, some in around.items():
        if some:
            best = min(some, key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), c, len(around[w]), n.get(form.get(w))) for w, c in n.items()}


def check(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "w", 1, "r") for d, t in rows], "doc_id long, text string, word string, n int, root string").repartition(3)
    got = spelling_variants(df, **how).collect()
    assert {r.word: tuple(r)[1:] for r in got} == plain(rows, **{k: v for k, v in how.items() if k in ("least", "times", "ratio")})
    assert len({r.word for r in got}) == len(got)
    return got


def corpus(seed, letters="abé", n=700, length=(7, 10)):
    """Words over few letters, so that many are near; some occur by the hundred."""
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(*length))) for _ in range(n)]
    weight = [r.choice((1, 1, 1, 2, 5, 20, 250)) for _ in words]
    return [(i, r.choice((" ", ",", "\n", "1", "ж", "×÷ ")).join(r.choices(words, weight, k=120))) for i in range(100)]


ODD = [(500, None), (501, ""), (None, "nullword nullword nullward nullward"), (None, "nullword"), (7, "Again AGAIN Againer againer AGAINER"), (7, "Again AGAIN Againer againer AGAINER"), (502, "é" * 5000 + " " + "é" * 5000 + " " + "é" * 5001 + " " + "é" * 5001), (503, "ÀÉÎÕÜßÿ àéîõüßÿ ÀÉÎÕÜßÿ àéîõüßÿ ÀÉÎÕÜßÿx ÀÉÎÕÜßÿx İstanbulKſK")]


@pytest.mark.parametrize("seed,letters,length", [(1, "abé", (7, 10)), (2, "ab", (7, 9)), (3, "abcdefghij", (7, 14)), (4, "aÿ", (62, 67))])
def test_all_pairs(spark, seed, letters, length):
    rows = corpus(seed, letters, length=length) + ODD
    got = check(spark, rows)
    assert sum(r.n_near for r in got) > 50 or letters == "abcdefghij" or length[0] > 60


@pytest.mark.parametrize("shard,hot", [(40, 10**9), (40, 15), (10**6, 1)])
def test_shards_and_hot_ends(spark, shard, hot):
    """Several shards, and words dealt by whole halves: the same rows."""
    check(spark, corpus(5) + [(900 + i, f"thesame{w} thesame{w} thesam{w} thesam{w}") for i, w in enumerate("aab abb bab bba cab acc abc".split())], shard=shard, hot=hot)


def test_near_long_words_and_chains(spark):
    base = "abcdefghij" * 9
    words = [base, base[:40] + "x" + base[40:], base[:-1], "z" + base[1:], base[:-1] + "zz"]
    rows = [(i, f"{w} {w}") for i, w in enumerate(words)]
    rows += [(50, "chainlinkaaa " * 2000), (51, "chainlinkaab " * 200), (52, "chainlinkabb " * 20), (53, "chainlinkbbb " * 2), (54, "tiesonea " * 30 + "tiesoneb " * 30 + "tiesonec " * 3)]
    got = {r.word: r for r in check(spark, rows)}
    assert got["chainlinkbbb"].root == "chainlinkaaa" and got["tiesonec"].form == "tiesonea"


def test_other_settings_and_empty(spark):
    rows = corpus(6)
    check(spark, rows, least=5, times=3, ratio=2)
    assert check(spark, [(1, "no such")]) == [] and check(spark, []) == []


def test_query(spark, tmp_path):
    rows = corpus(8) + ODD
    spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, form string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op13_spelling(spark, str(tmp_path)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain(rows)
