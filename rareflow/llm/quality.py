"""Quality rules joined by weak supervision, with DataFrame functions only.

Each rule looks at a few features of a text and votes good, bad, or abstains. Expectation-maximisation estimates how
accurate each rule is, from nothing but how the rules agree: the counts of the vote patterns (at most 3 to the number of
rules, whatever the corpus) are all it needs. A document is kept if its posterior probability of good quality reaches
a threshold; no single rule can reject a document by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep

SYMBOLS = "#*$%&|<>"
_SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs without ASCII white space."""
    return F.filter(F.split(text, _SPACE_CLASS), lambda w: w != "")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id (or __row, as it is), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules look at besides."""
    text = F.col("text")
    ident = "__row" if whole else "doc_id"
    rows = docs.select(F.col("__row") if whole else F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    rows = rows.select(
        ident, words_of(text).alias("words"), F.length(bare).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.length(F.regexp_replace(bare, "[^A-Z]", "")).alias("n_upper"),
        F.length(F.regexp_replace(bare, "[^0-9]", "")).alias("n_digits"),
        F.length(F.regexp_replace(bare, "[^.!?]", "")).alias("n_stops"),
    )
    # The 3-word windows' hashes are sorted with their places; equal neighbours are repeats, and sorted places cover
    # min(3, distance to the next) words each. n log n in the words of one text, and nothing leaves the row.
    rows = rows.withColumn("windows", F.when(F.size("words") >= 3, F.sort_array(F.expr(
        "transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) as h, i as at))"))))
    rows = rows.withColumn("places", F.sort_array(F.expr(
        "transform(filter(windows, (w, i) -> (i > 0 and get(windows, i - 1).h = w.h) or coalesce(get(windows, i + 1).h = w.h, false)), w -> w.at)")))
    covered = F.expr("aggregate(transform(places, (p, i) -> least(3, coalesce(get(places, i + 1) - p, 3))), 0, (a, x) -> a + x)")
    return rows.select(
        ident, F.size("words").cast("long").alias("n_words"), *[F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_upper", "n_digits", "n_stops",
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. Most rules know one kind of junk and abstain on all else."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def bad(*signs: Column) -> Column:
        seen = signs[0]
        for s in signs[1:]:
            seen = seen | s
        return F.when(seen, -1).otherwise(0)

    symbols, stops, upper = F.col("n_symbols") / n, F.col("n_stops") / n, F.col("n_upper") / chars
    variety = F.col("n_distinct") / F.sqrt(n)
    return {
        "short": bad(F.col("n_words") < 50),
        "word_length": bad(F.col("word_chars") / n < 2, F.col("word_chars") / n > 20),
        "symbols": bad(symbols > 0.3),
        "dup_lines": bad(F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "repeats": bad(F.col("n_repeat_words") > 0.5 * F.col("n_words")),
        "upper": bad(upper > 0.5),
        "digits": bad(F.col("n_digits") / chars > 0.4),
        "stops": bad(stops > 1),
        "prose": F.when((stops >= 0.01) & (stops <= 0.5) & (symbols <= 0.05) & (upper <= 0.2), 1).otherwise(0),
        "variety": F.when(variety >= 4, 1).when(variety < 2, -1).otherwise(0),
    }


#: What a rule is thought to be like before the votes are seen: the probability of each vote given good and given bad.
PRIOR = {1: (0.50, 0.30), 0: (0.49, 0.45), -1: (0.01, 0.25)}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, weight: float = 0.02) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM for the share of good documents and, for each rule and vote, its probability given good and given bad.

    Rules are taken as independent given the class. PRIOR is the start, and stays in each estimate with ``weight`` of
    the documents' number, so that a class which no document shows keeps its meaning.
    """
    rules, total = len(patterns[0][0]) if patterns else 0, sum(c for _, c in patterns)
    prior = weight * total
    share, tables = 0.5, [PRIOR] * rules
    for _ in range(rounds):
        good = []
        for votes_cast, _ in patterns:
            x = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes_cast))
            good.append(1 / (1 + math.exp(-max(-500.0, min(500.0, x)))))
        before, share = share, (sum(g * c for g, (_, c) in zip(good, patterns)) + prior / 2) / (total + prior) if total else 0.5
        n_good = sum(g * c for g, (_, c) in zip(good, patterns))
        tables = []
        for r in range(rules):
            table = {}
            for vote, (if_good, if_bad) in PRIOR.items():
                here = [(g, c) for g, (p, c) in zip(good, patterns) if p[r] == vote]
                g, b = sum(g * c for g, c in here), sum((1 - g) * c for g, c in here)
                table[vote] = ((g + prior * if_good) / (n_good + prior), (b + prior * if_bad) / (total - n_good + prior)) if total else (if_good, if_bad)
            tables.append(table)
        if abs(share - before) < 1e-9:
            break
    return share, tables


def scored(voted: DataFrame, names: list[str], share: float, tables: list[dict[int, tuple[float, float]]], threshold: float, min_words: int, max_repeat_percent: int) -> DataFrame:
    """Adds base_failed, posterior and kept to rows with votes and features."""
    log_odds = F.lit(math.log(share / (1 - share)))
    for name, table in zip(names, tables):
        log_odds = log_odds + F.when(F.col(name) == 1, math.log(table[1][0] / table[1][1])).when(F.col(name) == -1, math.log(table[-1][0] / table[-1][1])).otherwise(math.log(table[0][0] / table[0][1]))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-log_odds))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def with_votes(narrow: DataFrame) -> tuple[DataFrame, list[str], float, list[dict[int, tuple[float, float]]]]:
    """Votes of kept features, and what EM makes of the counts of their patterns."""
    rules = votes()
    names = [f"vote_{r}" for r in rules]
    voted = narrow.select("*", *[v.alias(f"vote_{r}") for r, v in rules.items()])
    patterns = [(tuple(r[c] for c in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    return voted, names, *fit(patterns)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, min_words: int = 50,
                  max_repeat_percent: int = 50) -> DataFrame:
    """One row per input row: doc_id, the counts of ``features``, base_failed, posterior, kept.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of the words in
    repeated 3-word windows. ``kept``: not base_failed and posterior >= ``threshold``. Null text has no words and
    fails; null ids and repeated rows are kept as rows of their own; an empty table gives an empty result; other
    columns are ignored. The texts are read once; the narrow features are written, counted by vote pattern, and scored.
    """
    voted, names, share, tables = with_votes(keep(features(docs, id_col, text_col)))
    return scored(voted, names, share, tables, threshold, min_words, max_repeat_percent).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def drop_low_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns; rows are judged one by one.

    Whole rows travel with their features through one written table, so no join moves the texts.
    """
    whole = features(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row")), "__row", f"__row.{text_col}", whole=True)
    voted, names, share, tables = with_votes(keep(whole))
    return scored(voted, names, share, tables, threshold, min_words, max_repeat_percent).where("kept").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
