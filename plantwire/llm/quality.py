"""Quality of documents by weak supervision: rules vote or abstain, a latent class model weighs them.

Each rule says good (true), bad (false) or nothing (null). Expectation-maximisation finds, per
rule, how often it is right on good documents and on each kind of junk, and the share of each;
the posterior probability of good decides. Only DataFrame functions are used: features are
built in one projection per text, and the model is fitted on counts of vote patterns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stages

WINDOW = 8
MIN_WORDS = 20
SPACE = r"[\\x20\\x09-\\x0D]+"
FEATURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_shouts",
]
#: Rule: (bad if, good if); neither: abstains. Written over the feature columns.
RULES = {
    "length": (f"n_words < {MIN_WORDS}", "n_words >= 50"),
    "word_length": ("word_chars < 2.5 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "repeated_lines": ("n_lines >= 5 AND n_dup_lines > 0.3 * n_lines", "n_lines >= 3 AND n_dup_lines <= 0.05 * n_lines"),
    "repeated_words": ("n_repeat_words > 0.3 * n_words", "n_words >= 50 AND n_repeat_words <= 0.1 * n_words"),
    "capitals": ("n_upper > 0.3 * word_chars", "n_upper <= 0.15 * word_chars"),
    "shouting": ("n_shouts > 0.1 * n_words", "n_shouts <= 0.02 * n_words"),
    "line_ends": ("n_lines >= 3 AND n_ended_lines < 0.1 * n_lines", "n_ended_lines >= 0.5 * n_lines"),
}


def _let(value: str, name: str, body: str) -> str:
    """SQL in which ``name`` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str) -> str:
    """Words in windows found twice or more. Windows are compared by hash, neighbours in sorted order."""
    windows = (
        f"transform(sequence(1, size(c) - {WINDOW - 1}), i -> xxhash64(slice(c, i, {WINDOW})))"
    )
    sorted_places = "sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    # flags[k]: entry k equals the one before it; a place counts if its own or the next flag is set
    flags = "zip_with(slice(s, 2, size(s) - 1), slice(s, 1, size(s) - 1), (a, b) -> a.x = b.x)"
    twice = "zip_with(concat(array(false), f), concat(f, array(false)), (a, b) -> a OR b)"
    places = "sort_array(transform(filter(zip_with(s, t, (a, b) -> if(b, a.i, null)), p -> p IS NOT NULL), p -> p))"
    covered = (
        f"aggregate({places}, struct(0 AS n, -{WINDOW} AS at), "
        f"(a, p) -> struct(a.n + least({WINDOW}, p - a.at) AS n, p AS at), a -> a.n)"
    )
    exact = _let(sorted_places, "s", _let(flags, "f", _let(twice, "t", covered)))
    some = _let(windows, "h", f"if(size(array_distinct(h)) = size(h), 0, {exact})")
    hashed = _let(f"transform({words}, w -> xxhash64(w))", "c", some)
    return f"if(size({words}) < {WINDOW + 1}, 0, {hashed})"


def _parts(text: str) -> dict[str, str]:
    """SQL of the struct or number that each group of features of a text comes from."""
    words = "struct(size(w) AS n_words, aggregate(w, 0L, (a, x) -> a + char_length(x)) AS word_chars, " + _repeat_words("w") + " AS n_repeat_words)"
    lines = (
        "struct(size(l) AS n_lines, size(l) - size(array_distinct(l)) AS n_dup_lines, "
        r"size(filter(l, x -> x rlike '[.!?:;\"]\\s*$')) AS n_ended_lines)"
    )
    marks = rf"regexp_replace({text}, '[^#*$%&|<>!]+', '')"
    return {
        "_w": _let(rf"filter(split({text}, '{SPACE}'), x -> x <> '')", "w", words),
        "_l": _let(rf"filter(split({text}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')", "l", lines),
        "_m": _let(marks, "m", "struct(char_length(m) AS n, char_length(replace(m, '!', '')) AS n_symbols)"),
        "_upper": rf"char_length(regexp_replace({text}, '[^\\p{{Lu}}]+', ''))",
    }


def _feature(name: str, of: str = "") -> str:
    """SQL of a feature from the groups, which are columns or fields of ``of``."""
    places = {"n_symbols": "_m.n_symbols", "n_shouts": f"_m.n - {of}_m.n_symbols", "n_upper": "_upper"}
    lines = ("n_lines", "n_dup_lines", "n_ended_lines")
    return f"CAST({of}{places.get(name, f'_l.{name}' if name in lines else f'_w.{name}')} AS LONG)"


def features(docs: DataFrame, *carry: Column) -> DataFrame:
    """``carry`` and the FEATURES of every whole text (null: no words), one row for each input row."""
    names = docs.select(*carry).columns
    row = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text")).select(
        *names, *[F.expr(sql).alias(part) for part, sql in _parts("_text").items()]
    )
    return row.select(*names, *[F.expr(_feature(c)).alias(c) for c in FEATURES])


def _vote(bad: str, good: str) -> str:
    return f"CASE WHEN {bad} THEN false WHEN {good} THEN true END"


_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words"
_NAME = re.compile(rf"\b({'|'.join(FEATURES)})\b")


@dataclass
class Accuracies:
    """Latent classes: the first is good, each other one is a kind of junk that one rule leads.

    ``share``: part of all documents in each class; ``good_vote``: per class and rule, how often
    the rule votes good when it votes.
    """

    rules: list[str]
    share: list[float]
    good_vote: list[list[float]]

    def weights(self, votes: Sequence[bool | None]) -> list[float]:
        """Joint probability of each class with these votes; abstentions say nothing."""
        out = []
        for share, good in zip(self.share, self.good_vote, strict=True):
            for vote, p in zip(votes, good, strict=True):
                share *= 1.0 if vote is None else p if vote else 1 - p
            out.append(share)
        return out

    def posterior(self, of: str = "") -> str:
        """SQL of the probability of the good class; the votes are columns or fields of ``of``."""
        joint = []
        for share, good in zip(self.share, self.good_vote, strict=True):
            cases = [f"CASE WHEN {of}{rule} THEN {p!r}D WHEN NOT {of}{rule} THEN {1 - p!r}D ELSE 1D END" for rule, p in zip(self.rules, good, strict=True)]
            joint.append(" * ".join([f"{share!r}D", *cases]))
        return _let(f"array({', '.join(joint)})", "j", "j[0] / aggregate(slice(j, 2, size(j) - 1), j[0], (a, x) -> a + x)")


def fit(votes: DataFrame, rules: list[str], rounds: int = 100, tolerance: float = 1e-6, least_on_good: float = 0.99) -> Accuracies:
    """Accuracies by expectation-maximisation over all rows of ``votes``.

    The rows meet in counts of vote patterns, at most three to the number of rules whatever the
    input, and only those come to the driver. Class k of junk starts from rule k voting bad.
    Rules are written to fail few good documents: no estimate of their votes on the good class
    falls under ``least_on_good``. Shares are smoothed by one row spread over all outcomes.
    """
    counts = [(row[:-1], row[-1]) for row in votes.groupBy(*rules).agg(F.count("*")).collect()]
    kinds = range(len(rules) + 1)
    now = Accuracies(
        rules,
        [0.8] + [0.2 / len(rules)] * len(rules),
        [[least_on_good] * len(rules)] + [[0.1 if r == k else 0.95 for r in range(len(rules))] for k in range(len(rules))],
    )
    for _ in range(rounds):
        size = [1.0 / len(kinds) for _ in kinds]
        voted = [[1.0] * len(rules) for _ in kinds]
        good = [[0.5] * len(rules) for _ in kinds]
        for pattern, n in sorted(counts, key=str):
            joint = now.weights(pattern)
            total = sum(joint)
            for k in kinds:
                part = n * joint[k] / total
                size[k] += part
                for r, vote in enumerate(pattern):
                    if vote is not None:
                        voted[k][r] += part
                        good[k][r] += part * vote
        rates = [[g / v for g, v in zip(*pair, strict=True)] for pair in zip(good, voted, strict=True)]
        rates[0] = [max(least_on_good, x) for x in rates[0]]
        new = Accuracies(rules, [x / sum(size) for x in size], rates)
        moved = max(abs(a - b) for old, fresh in zip([now.share, *now.good_vote], [new.share, *new.good_vote], strict=True) for a, b in zip(old, fresh, strict=True))
        now = new
        if moved < tolerance:
            break
    return now


def judge(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Features, base verdict and posterior of every document.

    ``docs``: doc_id, text; other columns are ignored. Returns doc_id, the FEATURES,
    base_failed (fewer than MIN_WORDS words, or over 30 % of words in repeated windows),
    quality (posterior probability of good, rounded to nine digits) and kept: not base_failed
    and quality of ``threshold`` or more. One row for each input row, repeated or not; a null
    text has no words, so it fails; a null doc_id stays null. An empty table gives no rows.
    """
    rows = Stages(docs.sparkSession, "quality").write(features(docs, F.col("doc_id")), "features")
    return _verdicts(rows, fit(_votes(rows, rules).select(*rules), list(rules)), rules, threshold)


def _votes(rows: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    return rows.select("*", *[F.expr(_vote(*rule)).alias(name) for name, rule in rules.items()])


def _verdicts(rows: DataFrame, model: Accuracies, rules: dict[str, tuple[str, str]], threshold: float) -> DataFrame:
    return _votes(rows, rules).select(
        *rows.columns, F.expr(_FAILED).alias("base_failed"), F.round(F.expr(model.posterior()), 9).alias("quality")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Documents that ``judge`` would keep, with all their columns, whatever their names.

    The features are built twice, once to fit the model and once beside the text, so that no
    text is shuffled or written and every row, repeated doc_id or not, is judged on its own text.
    The verdict is one expression in which every value is bound once: as columns, a filter on it
    would be moved below them and repeat their expressions wherever they are used.
    """
    model = fit(_votes(features(docs), rules).select(*rules), list(rules))
    parts = ", ".join(f"{sql} AS {name}" for name, sql in _parts("t").items())
    counted = ", ".join(f"{_feature(c, 'p.')} AS {c}" for c in FEATURES)
    votes = ", ".join(f"{_NAME.sub(r'f.\1', _vote(*rule))} AS {name}" for name, rule in rules.items())
    good = _let(f"struct({votes})", "v", f"round({model.posterior('v.')}, 9) >= {threshold!r}D")
    judged = _let(f"struct({counted})", "f", f"NOT ({_NAME.sub(r'f.\1', _FAILED)}) AND {good}")
    return docs.filter(F.expr(_let("coalesce(text, '')", "t", _let(f"struct({parts})", "p", judged))))
