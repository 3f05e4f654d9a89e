"""Quality rules that vote or abstain, weighed by expectation-maximisation.

DataFrame functions only; the driver iterates over counts of vote patterns, of
which there are at most 3 ** len(RULES) whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

MIN_WORDS = 50
#: Percent of words in repeated 3-word windows above which a text fails.
MAX_REPEAT = 50

#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "as", "on", "at", "by", "from", "this", "are",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "im", "für", "ein", "eine", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "en", "du", "dans", "est", "que", "pour",
    "el", "los", "las", "y", "una", "con", "por", "del", "se",
)

#: name: (votes bad if true, votes good if true); neither: the rule abstains.
#: Expressions over the columns of ``features``. Several rules see the same
#: defect from different sides, so that EM has agreement to learn from.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "letters": ("n_letters < 0.75 * word_chars", "n_letters >= 0.9 * word_chars"),
    "function_words": ("n_function < 0.03 * n_words", "n_function >= 0.1 * n_words"),
    "punctuation": ("n_stops < 0.03 * n_words or n_stops > 0.4 * n_words", "n_stops between 0.08 * n_words and 0.3 * n_words"),
    "word_length": ("word_chars < 3.0 * n_words or word_chars > 7.5 * n_words", "word_chars between 4.3 * n_words and 6.5 * n_words"),
    "capitals": ("n_capitals > 0.3 * n_letters", "n_capitals between 0.002 * n_letters and 0.1 * n_letters"),
    "dup_lines": ("n_dup_lines > 0.1 * n_lines", "false"),
    "variety": ("n_distinct < 0.6 * n_words and n_words < 2000", "n_distinct >= 0.7 * n_words"),
    "repeats": ("n_repeat_words > 0.1 * n_words", "n_repeat_words <= 0.01 * n_words"),
}
#: What EM starts from: the share of good texts and, for each class, how often
#: a rule votes bad or good. The starting values count as PRIOR_TEXTS texts
#: beside those of the corpus, however many these are.
PRIOR_GOOD, PRIOR_TEXTS, ROUNDS = 0.85, 20.0, 200
START_GOOD, START_BAD = {-1: 0.03, 1: 0.8}, {-1: 0.5, 1: 0.3}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, first ones included.

    Windows are compared by a 64-bit hash. Where few hashes repeat, their
    windows are looked up in the list of these; else hashes are sorted with
    their positions. Either way a text costs n log n at most.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def few(h: Column, twice: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda p: p.isNotNull())

    def many(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        near = lambda s, x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])
        hits = _let(ordered, lambda s: F.filter(s, lambda x, i: near(s, x, i)))
        return F.sort_array(F.transform(hits, lambda x: x["p"]))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        twice = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i - 1).eqNullSafe(x))))
        places = _let(twice, lambda t: F.when(F.size(t) == 0, F.array().cast("array<int>")).when(F.size(t) <= 16, few(h, t)).otherwise(many(h)))
        return _let(places, cover)

    return F.when(n >= 4, _let(hashes, count)).otherwise(0).cast("long")


def features(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and counts of every whole text; null is an empty text."""
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    pieces = F.split(F.col("_text"), blank, -1)
    text, words = F.col("_text"), F.col("_words")
    split = documents.select(*keep, text_or_empty().alias("_text")).select(
        *keep, "_text", F.size(pieces).alias("_n_pieces"), F.array_remove(pieces, "").alias("_words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(word)).alias("_lines")
    )
    return split.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        (F.length(text) - F.col("_n_pieces") + 1).cast("long").alias("word_chars"),
        (F.size(F.split(text, "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        repeated_words(words).alias("n_repeat_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS))).cast("long").alias("n_function"),
        F.size(F.filter(words, lambda w: F.right(w, F.lit(1)).isin(".", ",", ";", ":"))).cast("long").alias("n_stops"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def votes(counted: DataFrame) -> DataFrame:
    """One column of votes per rule: 1 good, -1 bad, 0 abstains."""
    return counted.withColumns({f"v_{k}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for k, (bad, good) in RULES.items()})


Model = tuple[float, list[dict[int, float]], list[dict[int, float]]]


def _full(vote: dict[int, float]) -> dict[int, float]:
    return vote | {0: 1 - vote[-1] - vote[1]}


def _starting(rule: tuple[str, str]) -> tuple[dict[int, float], dict[int, float]]:
    if rule[1] == "false":  # it never votes good
        return _full(START_GOOD | {1: 0.0}), _full(START_BAD | {1: 0.0})
    return _full(START_GOOD), _full(START_BAD)


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> Model:
    """Share of good texts and, by class, how often each rule casts each vote.

    EM over counts of vote patterns, for rules that given the class vote
    independently of one another; a rule's accuracy is the share of its votes
    that agree with the class. Nothing ties a bad vote to the bad class but the
    starting values, which count as PRIOR_TEXTS texts; without texts they are
    the result.
    """
    start = [_starting(r) for r in RULES.values()]
    good, on_good, on_bad = PRIOR_GOOD, [a for a, _ in start], [b for _, b in start]
    total = sum(n for _, n in patterns)
    if not total:
        return good, on_good, on_bad
    for_good, for_bad = PRIOR_TEXTS * PRIOR_GOOD, PRIOR_TEXTS * (1 - PRIOR_GOOD)
    for _ in range(ROUNDS):
        mass = 0.0
        cast = [({-1: 0.0, 0: 0.0, 1: 0.0}, {-1: 0.0, 0: 0.0, 1: 0.0}) for _ in start]
        for vote, n in patterns:
            p = posterior(vote, (good, on_good, on_bad))
            mass += n * p
            for j, v in enumerate(vote):
                cast[j][0][v] += n * p
                cast[j][1][v] += n * (1 - p)
        before = good
        good = (mass + for_good) / (total + PRIOR_TEXTS)
        on_good = [{v: (got[0][v] + for_good * s[0][v]) / (mass + for_good) for v in s[0]} for got, s in zip(cast, start, strict=True)]
        on_bad = [{v: (got[1][v] + for_bad * s[1][v]) / (total - mass + for_bad) for v in s[1]} for got, s in zip(cast, start, strict=True)]
        if abs(good - before) < 1e-9:
            break
    return good, on_good, on_bad


def accuracies(model: Model) -> dict[str, float]:
    """The share of each rule's votes that agree with the class."""
    good, on_good, on_bad = model
    out = {}
    for k, g, b in zip(RULES, on_good, on_bad, strict=True):
        right, wrong = good * g[1] + (1 - good) * b[-1], good * g[-1] + (1 - good) * b[1]
        out[k] = right / (right + wrong) if right + wrong else 0.5
    return out


def posterior(vote: tuple[int, ...], model: Model) -> float:
    good, on_good, on_bad = model
    odds = math.log(good / (1 - good))
    for v, g, b in zip(vote, on_good, on_bad, strict=True):
        odds += math.log(max(g[v], 1e-9) / max(b[v], 1e-9))
    return 1 / (1 + math.exp(-odds))


def learn(voted: DataFrame) -> Model:
    """EM over all texts that the base rules leave to the vote.

    Only counts of vote patterns, 3 ** len(RULES) at most, reach the driver.
    """
    names = [f"v_{k}" for k in RULES]
    found = voted.where(~base_failed()).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate(sorted((tuple(r[c] for c in names), r["n"]) for r in found))


def with_posterior(voted: DataFrame, model: Model, out: str = "p_good") -> DataFrame:
    good, on_good, on_bad = model
    odds = F.lit(math.log(good / (1 - good)))
    for k, g, b in zip(RULES, on_good, on_bad, strict=True):
        weigh = {v: math.log(max(g[v], 1e-9) / max(b[v], 1e-9)) for v in (-1, 0, 1)}
        odds = odds + F.when(F.col(f"v_{k}") < 0, weigh[-1]).when(F.col(f"v_{k}") > 0, weigh[1]).otherwise(weigh[0])
    return voted.withColumn(out, 1 / (1 + F.exp(-odds)))


def judge_documents(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior quality and verdict of every document.

    A null text counts as empty and, like any text of under 50 words, fails.
    Rows are judged by their text alone: repeated rows get the same verdict,
    doc_id may be null, an empty table gives no rows, other columns are not read.
    The counts, a few numbers a row, are written once and read twice.
    """
    voted = votes(materialise(features(documents), "rule_counts"))
    kept = ~base_failed() & (F.col("p_good") >= threshold)
    return with_posterior(voted, learn(voted)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), kept.alias("kept"), F.round("p_good", 6).alias("p_good"), *(f"v_{k}" for k in RULES),
    )


def keep_good(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with all their columns and repeated rows.

    A null or empty text fails the base rule and goes, as do all texts of under
    50 words; a very long text is judged whole. Repeated rows and ties get the
    same verdict and stay as often as they are there; doc_id may be null; an
    empty table gives no rows; other columns, whatever their names, travel in
    one struct and are not read. The rows are written once with their counts, so
    that texts are counted once.
    """
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"), F.col("text"))
    voted = votes(materialise(features(packed, ("_row",)), "rule_rows"))
    kept = with_posterior(voted, learn(voted)).where(~base_failed() & (F.col("p_good") >= threshold))
    return kept.select("_row.*")
