"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one measure of a document and votes good or bad or abstains. How often a rule is
right is not assumed but estimated: expectation-maximisation on the counts of vote patterns (a table
bounded by the rules, whatever the corpus) finds the accuracies and the share of good documents that
explain best how the rules agree. A document's posterior probability of being good replaces the
demand that it pass every rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import written

WINDOW = 8
_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
_BLANK_LETTERS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word of letters, perhaps quoted and with one mark behind it.
_NATURAL = r"^[\"'(\[¿¡«„“]?\p{L}[\p{L}'’-]*[\"')\]»”]?[.,;:!?]?[\"')\]»”]?$"


@dataclass(frozen=True)
class Rule:
    """Votes good up to ``good`` and bad from ``bad`` on (with ``high`` the other way round);
    abstains in between, where the measure is null, and on a side whose bound is None."""

    measure: str
    good: float | None
    bad: float | None
    high: bool = False

    def vote(self) -> Column:
        value, no = F.col(self.measure), F.lit(False)
        good = no if self.good is None else value >= self.good if self.high else value <= self.good
        bad = no if self.bad is None else value <= self.bad if self.high else value >= self.bad
        return F.when(good, 1).when(bad, -1).otherwise(0)


RULES = (
    Rule("natural_share", 0.90, 0.60, high=True),
    Rule("letter_share", 0.90, 0.78, high=True),
    Rule("closed_share", None, 0.05, high=True),
    Rule("symbol_share", None, 0.10),
    Rule("upper_share", None, 0.40),
    Rule("exclamation_share", None, 0.30),
    Rule("repeat_share", None, 0.25),
    Rule("duplicate_line_share", None, 0.30),
    Rule("distinct_share", None, 0.18, high=True),
    Rule("word_length_gap", None, 5.0),
)


@dataclass(frozen=True)
class RuleModel:
    """``start``: accuracy at first. ``weight``: strength of that belief as a share of the
    documents, which keeps a rule that never disagrees from being trusted without limit."""

    rules: tuple[Rule, ...] = RULES
    start: float = 0.85
    weight: float = 0.02
    threshold: float = 0.5
    tolerance: float = 1e-9
    max_rounds: int = 10_000


@dataclass
class Fitted:
    good_share: float
    accuracy: list[float] = field(default_factory=list)
    rounds: int = 0

    def log_odds(self) -> list[float]:
        return [math.log(a / (1 - a)) for a in self.accuracy]


def fit(patterns: list[tuple[tuple[int, ...], int]], model: RuleModel) -> Fitted:
    """Accuracies and the share of good documents, by expectation-maximisation over patterns of
    votes and their numbers. A rule is right no less often than by chance, and good documents are
    no minority. Raises if the rounds do not settle."""
    n_rules, total = len(model.rules), sum(n for _, n in patterns)
    fitted = Fitted(0.85, [model.start] * n_rules)
    if not total:
        return fitted
    belief = max(model.weight * total, 1.0)
    while fitted.rounds < model.max_rounds:
        fitted.rounds += 1
        odds, prior = fitted.log_odds(), math.log(fitted.good_share / (1 - fitted.good_share))
        right, cast, good = [0.0] * n_rules, [0.0] * n_rules, 0.0
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, prior + sum(v * o for v, o in zip(votes, odds))))))
            good += n * p
            for k, vote in enumerate(votes):
                if vote:
                    cast[k] += n
                    right[k] += n * (p if vote > 0 else 1 - p)
        share = min(max((good + 0.85 * belief) / (total + belief), 0.5), 1 - 1e-6)
        accuracy = [
            min(max((r + model.start * belief) / (c + belief), 0.5), 1 - 1e-6) for r, c in zip(right, cast)
        ]
        moved = max(abs(share - fitted.good_share), *(abs(a - b) for a, b in zip(accuracy, fitted.accuracy)))
        fitted.good_share, fitted.accuracy = share, accuracy
        if moved < model.tolerance:
            return fitted
    raise RuntimeError(f"no settled rule accuracies after {model.max_rounds} rounds")


def measures(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and measures of its whole text (null counts as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANK_LETTERS))
    split = documents.select(
        F.col(id_col), text.alias("text"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS)).alias("words"),
    )

    def without(letters: str) -> Column:
        return F.char_length("text") - F.char_length(F.translate("text", letters, ""))

    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_BLANK_LETTERS)) != "")
    n_windows = F.size("words") - WINDOW + 1
    windows = F.when(n_windows > 0, F.transform(
        F.sequence(F.lit(1), n_windows), lambda at: F.xxhash64(F.slice("words", at, WINDOW))
    )).otherwise(F.array().cast("array<long>"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    counted = split.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - without(_BLANK_LETTERS)).cast("long").alias("word_chars"),
        without(_SYMBOLS).cast("long").alias("n_symbols"),
        without(upper).alias("n_upper"), without(lower).alias("n_lower"), without("!").alias("n_exclaimed"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size(F.filter("words", lambda word: word.rlike(_NATURAL))).alias("n_natural"),
        without(_MARKS).alias("n_marks"),
        F.size(F.split("text", r"[.!?](?=\s|$)")).alias("n_closed"),
        lines.alias("lines"), windows.alias("windows"),
    )
    counted = counted.withColumns({
        "n_lines": F.size("lines"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "ordered": F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, at: F.struct(h.alias("h"), at.alias("at")))),
        ),
    }).drop("lines", "windows")
    # Neighbours in the order by hash that are equal: places of windows that occur twice.
    last = F.size("ordered") - 1
    equal = F.zip_with(
        F.slice("ordered", F.lit(1), last), F.slice("ordered", F.lit(2), last),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])),
    )
    places = counted.withColumn("places", F.when(
        F.col("ordered").isNotNull(),
        F.array_sort(F.array_distinct(F.flatten(F.filter(equal, lambda pair: pair.isNotNull())))),
    )).drop("ordered")
    count = F.size("places")
    gaps = F.zip_with(
        F.slice("places", F.lit(1), count - 1), F.slice("places", F.lit(2), count - 1),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    repeated = F.when(F.col("places").isNull(), 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda n, g: n + g))
    return places.withColumn("n_repeat_words", repeated.cast("long")).drop("places")


def judge_quality(
    documents: DataFrame, model: RuleModel | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 20 words, or over 30 % of them in repeated windows), quality (posterior
    probability of being good) and kept (not base_failed, and quality at the threshold or above).

    A document on which all rules abstain has the estimated share of good ones as its quality. Null,
    empty and blank texts have no words and fail the base. Null ids and repeated rows are kept. An
    empty table gives an empty result; other columns are not read.
    """
    model = model or RuleModel()
    n = F.col("n_words")
    # Null without words, so that rules abstain.
    measured = written(measures(documents, id_col=id_col, text_col=text_col)).withColumns({
        "natural_share": F.when(n > 0, F.col("n_natural") / n),
        "letter_share": F.when(n > 0, 1 - F.col("n_marks") / F.col("word_chars")),
        "symbol_share": F.when(n > 0, F.col("n_symbols") / n),
        "repeat_share": F.when(n > 0, F.col("n_repeat_words") / n),
        "exclamation_share": F.when(n > 0, F.col("n_exclaimed") / n),
        "duplicate_line_share": F.when(F.col("n_lines") > 1, F.col("n_dup_lines") / F.col("n_lines")),
        # Long texts repeat their words; the square root takes that out.
        "distinct_share": F.when(n > 0, F.least(
            F.lit(1.0), F.col("n_distinct") / n * F.greatest(F.lit(1.0), F.sqrt(n / 200.0)))),
        "upper_share": F.when(F.col("n_upper") + F.col("n_lower") > 0,
                              F.col("n_upper") / (F.col("n_upper") + F.col("n_lower"))),
        "word_length_gap": F.when(n > 0, F.abs(F.col("word_chars") / n - 5.5)),
        "closed_share": F.when(n > 0, F.least(F.lit(1.0), (F.col("n_closed") - 1) / (n / 40.0))),
    })
    names = [f"vote_{k}" for k in range(len(model.rules))]
    voted = measured.withColumns({v: rule.vote() for v, rule in zip(names, model.rules)})
    patterns = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** rules at most
    fitted = fit([(tuple(p[:-1]), p[-1]) for p in patterns], model)
    log_odds = F.lit(math.log(fitted.good_share / (1 - fitted.good_share)))
    for name, weight in zip(names, fitted.log_odds()):
        log_odds = log_odds + F.col(name) * F.lit(weight)
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    quality = 1 / (1 + F.exp(-log_odds))
    return voted.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), quality.alias("quality"),
        (~failed & (quality >= model.threshold)).alias("kept"),
    )
