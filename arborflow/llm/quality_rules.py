"""Quality rules: text statistics in Spark expressions, and a learned decision list over them.

Sequential covering learns the list from labelled statistics: a rule grows by the threshold condition that adds most
information about bad documents (FOIL gain) on one part of the labelled rows, is pruned back on the other part, and is
kept while its precision there is high enough; the rows that it covers are then set aside.  The list is emitted as one
ordered Spark CASE expression.  Learning sees at most ``SAMPLE`` labelled rows, as counts of binned statistics; the
statistics themselves are computed over all documents and whole texts.

A null text has no words.  Rows without a label are scored like any other and teach nothing; a doc_id with several labels
counts as bad if one of them says so, and a label counts for all rows of its doc_id.  Ties between conditions go to the
first feature and the least threshold.  An empty table gives no rows.  Without labels no rule fires.  Columns of docs come
back in one column, so their names clash with nothing.  A text's words are held as arrays in its row, some ten times its
bytes, so a row's text must stay well below the 2 GB that an array may take.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import saved

#: Most labelled rows that learning sees, taken in the order of a hash of their id.
SAMPLE = 20_000
#: A rule must reject bad documents with at least this precision on the rows held out for pruning.
PRECISION = 0.9
MAX_RULES, MAX_CONDITIONS, BINS = 12, 3, 24
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Statistics that a rule may test.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "punct_share", "line_words")


def _gone(text: Column, chars: str) -> Column:
    """Number of the text's characters that are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """row (all columns of docs, of any name), word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words and the features
    that rules test."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    out = out.withColumns({"_words": words, "_lines": lines})
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    starts = lambda: F.when(F.col("n_words") >= window, F.sequence(F.lit(0), (F.col("n_words") - window).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_wh", F.transform(starts(), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(window)])))
    # Windows whose hashes all differ are all different.  In other texts the places with hashes that occur again are
    # compared by their words, so only these are built.
    hashed = F.array_sort(F.zip_with("_wh", starts(), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_hs", F.when(F.size(F.array_distinct("_wh")) < F.size("_wh"), hashed))
    again = lambda x, j: F.coalesce(F.get("_hs", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_hs", j + 1)["h"] == x["h"], F.lit(False))
    at = F.array_sort(F.transform(F.filter("_hs", again), lambda x: F.struct(F.array_join(F.slice("_words", x["i"] + 1, window), " ").alias("s"), x["i"].alias("i"))))
    out = out.withColumn("_at", at)
    same = lambda x, j: F.coalesce(F.get("_at", j - 1)["s"] == x["s"], F.lit(False)) | F.coalesce(F.get("_at", j + 1)["s"] == x["s"], F.lit(False))
    out = out.withColumn("_twice", F.array_sort(F.transform(F.filter("_at", same), lambda x: x["i"])))
    covered = F.aggregate("_twice", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")), lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(window))).alias("n"), i.alias("last")), lambda a: a["n"])
    n = F.greatest(F.col("n_words"), F.lit(1))
    out = out.withColumns({
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": _gone(t, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "_distinct": F.size(F.array_distinct("_h")),
        "_upper": _gone(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "_digits": _gone(t, "0123456789"), "_punct": _gone(t, ".,;:!?'\"()-"),
    }).withColumns({
        "mean_word": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / n, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n, "distinct_share": F.col("_distinct") / n, "upper_share": F.col("_upper") / F.greatest("word_chars", F.lit(1)),
        "digit_share": F.col("_digits") / F.greatest("word_chars", F.lit(1)), "punct_share": F.col("_punct") / n, "line_words": F.col("n_words") / F.greatest(F.size("_lines"), F.lit(1)),
    })
    # as a generator's row, which no filter passes, so a filter on a statistic does not compute them all again
    return out.select("row", F.inline(F.array(F.struct(*COUNTS, *FEATURES[1:]))))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


class Rule(list):
    """A conjunction of (feature, is_at_least, threshold)."""

    def column(self) -> Column:
        out = F.lit(True)
        for feature, up, x in self:
            out = out & (F.col(feature) >= F.lit(x) if up else F.col(feature) < F.lit(x))
        return out

    def covers(self, bins: tuple, cuts: list[list[float]]) -> bool:
        return all((bins[k := FEATURES.index(f)] > cuts[k].index(x)) == up for f, up, x in self)


def _grow(rows: list, cuts: list[list[float]]) -> Rule:
    """rows: (bins, bad, good).  A bin b of a feature holds values of cuts[b - 1] to below cuts[b]."""
    rule = Rule()
    while len(rule) < MAX_CONDITIONS:
        bad, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if not bad or not good:
            break
        was, best = math.log2(bad / (bad + good)), (0.0, None)
        for k, feature in enumerate(FEATURES):
            b, g = [0] * (len(cuts[k]) + 1), [0] * (len(cuts[k]) + 1)
            for bins, p, q in rows:
                b[bins[k]] += p
                g[bins[k]] += q
            low_b = low_g = 0
            for i, x in enumerate(cuts[k]):
                low_b, low_g = low_b + b[i], low_g + g[i]
                for up, p, q in ((False, low_b, low_g), (True, bad - low_b, good - low_g)):
                    if p >= 5 and (gain := p * (math.log2(p / (p + q)) - was)) > best[0] + 1e-9:
                        best = (gain, (feature, up, x))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if Rule([best[1]]).covers(r[0], cuts)]
    return rule


def _counts(rule: Rule, rows: list, cuts) -> tuple[int, int]:
    hit = [r for r in rows if rule.covers(r[0], cuts)]
    return sum(r[1] for r in hit), sum(r[2] for r in hit)


def _prune(rule: Rule, rows: list, cuts) -> Rule:
    """The rule without those conditions, one at a time, whose removal betters (bad - good) / (bad + good) on rows held
    out most, or leaves it as good."""
    worth = lambda r: (lambda b, g: (b - g) / (b + g) if b + g else -1.0)(*_counts(r, rows, cuts))
    while len(rule) > 1:
        less = max((Rule(rule[:i] + rule[i + 1 :]) for i in reversed(range(len(rule)))), key=worth)
        if worth(less) < worth(rule):
            break
        rule = less
    return rule


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts a feature reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: F.col(feature) >= x)) if cuts else F.lit(0)


def learn(stats: DataFrame, label: str = "quality", key: str = "doc_id") -> list[Rule]:
    """Rules that reject documents, from rows of statistics() that carry a 0/1 label (0: bad)."""
    seen = stats.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("y"), *FEATURES)
    seen = saved(seen.orderBy(F.xxhash64(F.col(key), F.lit(6)), key).limit(SAMPLE), "labelled")
    at = [i / BINS for i in range(1, BINS)] + [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998]
    first = seen.agg(*[F.percentile(f, at).alias(f) for f in FEATURES]).first()
    cuts = [sorted({float(x) for x in first[f] or []}) for f in FEATURES]
    held = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 0
    bins = [_bin(f, c) for f, c in zip(FEATURES, cuts, strict=True)]
    counted = seen.groupBy(held.alias("held"), F.array(*bins).alias("bins")).agg(F.sum(1 - F.col("y")).alias("bad"), F.sum("y").alias("good")).collect()
    grow, prune = ([(tuple(r.bins), r.bad, r.good) for r in sorted(counted, key=lambda r: r.bins) if bool(r.held) == h] for h in (False, True))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and sum(r[1] for r in grow):
        rule = _grow(grow, cuts)
        if not rule:
            break
        rule = _prune(rule, prune, cuts)
        (b, g), (b2, g2) = _counts(rule, prune, cuts), _counts(rule, grow, cuts)
        if b + b2 < 5 or b2 < PRECISION * (b2 + g2) or b < PRECISION * (b + g):
            break
        rules.append(rule)
        grow, prune = ([r for r in rows if not rule.covers(r[0], cuts)] for rows in (grow, prune))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that fires, from 1; 0 if the document is kept."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(i)) if out is None else out.when(rule.column(), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text") -> DataFrame:
    """row (all columns of docs), its statistics, base_failed, rule (0: none fires) and kept."""
    marked = labels.select(F.col(key).alias("_id"), F.col(label).alias("_y")).where("_id IS NOT NULL").groupBy("_id").agg(F.min("_y").alias("_y"))
    sample = marked.where(F.col("_y").isin(0, 1)).orderBy(F.xxhash64(F.col("_id"), F.lit(6)), "_id").limit(SAMPLE)
    known = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), F.expr("_key = _id")).select("_id", "_y", "_text")  # bounded by SAMPLE rows
    rules = learn(statistics(known, "_text").select("row.*", *COUNTS, *FEATURES[1:]).drop("_text"), "_y", "_id")
    out = statistics(docs, text).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
