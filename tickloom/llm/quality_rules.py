"""Quality rules as weak supervision.

Each rule looks at a few counts of a text and votes good (1), junk (-1) or abstains (0). Expectation-maximisation over
the table of vote patterns estimates how often each rule is right; a document is kept if the posterior probability of
being good, given all its votes, is at least one half. Everything that touches texts is a DataFrame expression.

Defined results: a null or blank text has no words, fails the base rules and is not kept. Repeated rows are judged one
by one. With an empty table the accuracies stay at their starting values. Other columns pass through apply_rules().
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
START_ACCURACY = 0.8
START_PRIOR = 0.9
#: A rule is never taken as worse than this, so the two classes cannot change places, nor as certain.
ACCURACY_RANGE = (0.6, 0.98)
PRIOR_RANGE = (0.02, 0.98)
ROUNDS = 50

_STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint,n_upper:bigint,n_digits:bigint>"


def _covered(positions: Column) -> Column:
    """Words covered by the 3-word windows that start at these sorted positions."""
    step = lambda p, i: F.when(i + 1 < F.size(positions), F.least(F.lit(3), F.get(positions, i + 1) - p)).otherwise(3)
    return F.aggregate(F.transform(positions, step), F.lit(0), lambda a, x: a + x)


def _repeated(hashes: Column) -> Column:
    def among(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(ordered, i)["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), _covered)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, among))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, the first window included."""
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, _repeated))


def text_stats(text: Column) -> Column:
    """One struct of counts for a text; see _STATS for its fields."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))

    def counts(words: Column) -> Column:
        return let(
            lines,
            lambda ls: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                only("#*$%&|<>").cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                only("A-Z").cast("long").alias("n_upper"),
                only("0-9").cast("long").alias("n_digits"),
            ),
        )

    return let(words_of(text), counts).cast(_STATS)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _vote(good: Column, junk: Column) -> Column:
    return F.when(junk, -1).when(good, 1).otherwise(0)


#: Rule name -> vote from the struct of text_stats().
RULES = {
    "length": lambda s: _vote(s["n_words"] >= 80, s["n_words"] < MIN_WORDS),
    "word_length": lambda s: _vote(s["word_chars"].between(3 * s["n_words"], 10 * s["n_words"]), (s["word_chars"] > 14 * s["n_words"]) | (s["word_chars"] < 2 * s["n_words"])),
    "symbols": lambda s: _vote(100 * s["n_symbols"] <= 2 * s["n_words"], 10 * s["n_symbols"] > s["n_words"]),
    "repeated_lines": lambda s: _vote(s["n_dup_lines"] == 0, 10 * s["n_dup_lines"] > 3 * s["n_lines"]),
    "repeated_windows": lambda s: _vote(100 * s["n_repeat_words"] <= 15 * s["n_words"], 100 * s["n_repeat_words"] > 40 * s["n_words"]),
    "capitals": lambda s: _vote(100 * s["n_upper"] <= 15 * s["word_chars"], 100 * s["n_upper"] > 40 * s["word_chars"]),
    "digits": lambda s: _vote(100 * s["n_digits"] <= 3 * s["word_chars"], 100 * s["n_digits"] > 25 * s["word_chars"]),
}


@dataclass(frozen=True)
class LabelModel:
    prior: float = START_PRIOR
    accuracy: dict[str, float] = field(default_factory=lambda: dict.fromkeys(RULES, START_ACCURACY))

    def log_odds(self, votes: dict) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(v * math.log(self.accuracy[k] / (1 - self.accuracy[k])) for k, v in votes.items())

    def posterior(self, s: Column) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, rule in RULES.items():
            odds = odds + rule(s) * F.lit(math.log(self.accuracy[name] / (1 - self.accuracy[name])))
        return 1 / (1 + F.exp(-odds))


def fit(stats: DataFrame, column: str = "stats") -> LabelModel:
    """EM over the vote patterns. Spark counts the patterns, of which there are at most 3 ** len(RULES)."""
    votes = stats.select(*(rule(F.col(column)).alias(name) for name, rule in RULES.items()))
    patterns = [(r.asDict(), r["count"]) for r in votes.groupBy(*RULES).count().orderBy(*RULES).collect()]
    patterns = [({k: v for k, v in p.items() if k != "count"}, n) for p, n in patterns]
    model, total = LabelModel(), sum(n for _, n in patterns)
    if not total:
        return model
    clip = lambda x, bounds: min(max(x, bounds[0]), bounds[1])
    for _ in range(ROUNDS):
        good = [1 / (1 + math.exp(-model.log_odds(p))) for p, _ in patterns]
        accuracy = {}
        for name in RULES:
            right = START_ACCURACY + sum(n * (g if p[name] > 0 else 1 - g) for (p, n), g in zip(patterns, good) if p[name])
            accuracy[name] = clip(right / (1 + sum(n for p, n in patterns if p[name])), ACCURACY_RANGE)
        prior = clip(sum(n * g for (_, n), g in zip(patterns, good)) / total, PRIOR_RANGE)
        model = LabelModel(prior, accuracy)
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept for every row of docs. Texts are read once."""
    stats = stored(docs.select(F.col(id_col).alias("doc_id"), text_stats(F.col(text_col)).alias("stats")), "quality")
    model, s = fit(stats), F.col("stats")
    posterior = model.posterior(s)
    return stats.select(
        "doc_id", *(s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(s).alias("base_failed"), (~base_failed(s) & (posterior >= 0.5)).alias("kept"), posterior.alias("posterior"),
    )


def apply_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns and no shuffle of texts: one pass to fit, one to filter."""
    model = fit(docs.select(text_stats(F.col(text_col)).alias("stats")))
    return docs.where(let(text_stats(F.col(text_col)), lambda s: ~base_failed(s) & (model.posterior(s) >= 0.5)))
