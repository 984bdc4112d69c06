"""Text quality by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.llm.tables import written

#: The six characters that separate words.
SPACE = " \t\n\u000b\f\r"
_GAP = "[\\x20\\x09-\\x0D]"


def with_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with counts over the whole text; a null text counts as empty.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines (equal to
    an earlier line), n_repeat_words (words inside three-word windows found twice or more), n_upper,
    n_marks (exclamation marks), n_symbol_runs, n_other (neither letter nor space), n_closed (lines that
    end like a sentence). Existing columns of these
    names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    df = docs.withColumn("__w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_GAP}+")))
    n = F.size("__w")
    df = df.withColumn("__l", F.filter(F.split(text, "\n"), lambda l: F.btrim(l, F.lit(SPACE)) != ""))
    # hashes of the three-word windows; sorted together with their places only where two are equal
    df = df.withColumn("__h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform(F.col("__h"), lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed))
    twice = F.filter(F.col("__s"), lambda x, i: x["h"].eqNullSafe(F.get("__s", i - 1)["h"]) | x["h"].eqNullSafe(F.get("__s", i + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    # a window at p adds the words that the window before it has not covered
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]
    ended = F.filter("__l", lambda l: F.rtrim(l).rlike("[.!?…][\"')\\]»”]?$"))
    counts = {
        "n_words": n, "word_chars": F.char_length(text) - F.regexp_count(text, F.lit(_GAP)),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")), "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")), "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")), "n_marks": F.regexp_count(text, F.lit("!")),
        "n_symbol_runs": F.regexp_count(text, F.lit("[#*$%&|<>]+")), "n_other": F.regexp_count(text, F.lit("[^\\p{L}\\p{M}\\s]")), "n_closed": F.size(ended),
    }
    names = [c for c in docs.columns if c not in counts]
    return df.select(*names, *[c.cast("long").alias(k) for k, c in counts.items()])


@dataclass(frozen=True)
class Rule:
    """A rule votes good where ``good`` holds, bad where ``bad`` holds, and abstains elsewhere."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0).cast("tinyint").alias(self.name)


def default_rules() -> list[Rule]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    length, symbols, same = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / lines
    repeated, upper = F.col("n_repeat_words") / words, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    marks, closed = F.col("n_marks") / words, F.col("n_closed") / lines
    runs, other = F.col("n_symbol_runs") / words, F.col("n_other") / F.greatest(F.col("word_chars"), F.lit(1))
    return [
        Rule("vote_length", F.col("n_words") >= 100, F.col("n_words") < 50),
        Rule("vote_word_length", length.between(3.5, 7), (length < 2.5) | (length > 8)),
        Rule("vote_symbols", symbols <= 0.02, symbols > 0.1),
        Rule("vote_symbol_runs", runs <= 0.01, runs > 0.15),
        Rule("vote_other", other <= 0.08, other > 0.1),
        Rule("vote_same_lines", same <= 0.1, same > 0.4),
        Rule("vote_repeats", repeated <= 0.1, repeated > 0.3),
        Rule("vote_capitals", upper <= 0.1, upper > 0.3),
        Rule("vote_marks", marks <= 0.02, marks > 0.1),
        Rule("vote_closed", closed >= 0.7, closed < 0.3),
    ]


@dataclass(frozen=True)
class Estimate:
    """Share of good documents and, per rule, how often a vote is right on good and on bad ones."""

    prior: float
    on_good: list[float]
    on_bad: list[float]

    def posterior(self, names: list[str]) -> Column:
        """Probability that a document with these votes is good; a rule that abstains says nothing."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, g, b in zip(names, self.on_good, self.on_bad):
            odds = odds + F.when(F.col(name) == 1, math.log(g / (1 - b))).when(F.col(name) == -1, math.log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, names: list[str], rounds: int = 40, tolerance: float = 1e-3) -> Estimate:
    """Expectation-maximisation over the vote patterns of all rows of ``votes``.

    Rows with equal votes are counted first, so a round reads at most 3^rules rows whatever the size
    of the table. Each rule has two accuracies, since most rules see only one kind of bad text. It starts
    from rules that seldom blame good texts and miss most bad ones; ten pseudo-votes of that kind define
    the result for an empty table. A rule is held to blame one to two good texts in a hundred: without
    that bound the estimate would rather call one kind of junk good than give the bad class two kinds,
    and with it no single vote decides alone.
    """
    patterns = written(votes.groupBy(*names).agg(F.count("*").alias("__n")).coalesce(1), "patterns")
    now = Estimate(0.8, [0.98] * len(names), [0.4] * len(names))
    for _ in range(rounds):
        scored = patterns.withColumn("__g", now.posterior(names) * F.col("__n")).withColumn("__b", F.col("__n") - F.col("__g"))

        def total(weight: str, where: Column) -> Column:
            return F.coalesce(F.sum(F.when(where, F.col(weight))), F.lit(0.0)).cast("double")

        wanted = [total("__g", F.lit(True)), total("__b", F.lit(True))]
        for name in names:
            wanted += [total("__g", F.col(name) == 1), total("__g", F.col(name) != 0), total("__b", F.col(name) == -1), total("__b", F.col(name) != 0)]
        sums = list(scored.agg(*[c.alias(f"s{i}") for i, c in enumerate(wanted)]).first())
        good, bad, rest = sums[0], sums[1], sums[2:]
        bounded = [(min(0.99, max(0.98, (rest[i] + 9.8) / (rest[i + 1] + 10))), min(0.95, max(0.05, (rest[i + 2] + 4) / (rest[i + 3] + 10))))
                   for i in range(0, len(rest), 4)]
        new = Estimate((good + 8) / (good + bad + 10), [g for g, _ in bounded], [b for _, b in bounded])
        change = max(abs(a - b) for a, b in zip([new.prior, *new.on_good, *new.on_bad], [now.prior, *now.on_good, *now.on_bad]))
        now = new
        if change < tolerance:
            break
    return now


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5,
          rules: Callable[[], list[Rule]] = default_rules) -> DataFrame:
    """(id, counts, base_failed, kept, quality, votes) for every row of ``docs``.

    ``base_failed``: under 50 words, or more than half of the words in repeated three-word windows.
    ``quality`` is the posterior probability of a good text; ``kept`` needs it to reach ``threshold``
    and the base not to fail. Null and empty texts have zero counts and fail the base. Null ids,
    repeated rows and other columns do not matter: every row is judged by its own text, and every row
    counts in the estimate. An empty table gives an empty table.
    """
    chosen = rules()
    names = [r.name for r in chosen]
    text = F.col(text_col).alias("__text")
    # a few numbers per document, written once so that the texts are read once
    signals = written(with_signals(docs.select(F.col(id_col).alias("__id"), text), "__text").drop("__text"), "signals")
    votes = signals.select("*", *[r.vote() for r in chosen])
    fitted = estimate(votes, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = fitted.posterior(names)
    out = votes.withColumn("quality", quality).withColumn("base_failed", failed)
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", *names)
