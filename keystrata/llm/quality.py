"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a predicate that names documents to reject, and a cost: the steps that it takes on a document (words
or bytes visited, weighted by what is done there). On a bounded sample (``SAMPLE`` documents that pass the base
rule) the mean cost and the share of rejections of each rule are estimated; rules then run in the order of rejections
per cost, and a document rejected by one is not shown to the next. The order changes the work
and never the verdict, for a document is kept only if no rule rejects it. Only flags and costs of the sample reach
the driver. ``keep``, which needs no figures of what it drops, runs the cascade before the dearest figure, repeated windows.

Base figures: n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_dup_lines
(lines with a word that equal an earlier line) and n_repeat_words (words inside 8-word windows found
twice or more in the text). Each word is hashed once and a window by the hashes of its words; repeated windows
are found by sorting them, only where some hash occurs twice.

Defined results: null or empty text has no words and fails the base rule. Long texts are judged whole. Repeated rows
each get their verdict. Rules that tie in rejections per cost run in the order in which they are listed; with an empty
table, or one of failures alone, all do. Other columns, whatever their names, pass through; columns of the
names added here are replaced."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
WINDOW = 8
MIN_WORDS = 20
#: Largest share of repeated words, in percent.
MAX_REPEATED = 30
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the figures that one look at each word or line gives, and ``_q_text``, ``_q_words`` and ``_q_lines``."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.drop(*[c for c in _ADDED if c in docs.columns]).withColumn("_q_text", t)
    trimmed = F.btrim("_q_text", F.lit(_SPACES))
    df = df.withColumn("_q_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    bare = F.col("_q_text")
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    df = df.withColumns(
        {
            "_q_lines": F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "n_symbols": (F.octet_length("_q_text") - F.octet_length(bare)).cast("long"),
        }
    )
    return df.withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))


def _repeats(df: DataFrame) -> DataFrame:
    """``df`` of ``_counts`` with n_repeat_words and base_failed."""
    n = F.size("_q_words")
    df = df.withColumn("_q_hashes", F.when(n >= WINDOW, F.transform("_q_words", lambda w: F.xxhash64(w))))
    # more than one mention of the hashes keeps their definition from being put into the lambda, to be evaluated for each window
    m = F.size("_q_hashes")
    windows = F.transform(F.sequence(F.lit(1), m - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_q_hashes", i, WINDOW)))
    df = df.withColumn("_q_windows", F.when(m >= WINDOW, windows))
    twice = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    df = df.withColumn("_q_sorted", F.when(twice, F.sort_array(F.transform("_q_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    places = F.sort_array(F.transform(F.filter("_q_sorted", lambda s, j: F.coalesce(F.when(j > 0, F.get("_q_sorted", j - 1)["h"] == s["h"]), F.lit(False)) | F.coalesce(F.get("_q_sorted", j + 1)["h"] == s["h"], F.lit(False))), lambda s: s["i"]))
    df = df.withColumn("_q_places", F.when(F.col("_q_sorted").isNotNull(), places))
    covered = F.aggregate(
        F.transform("_q_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_q_places", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return df.withColumn("base_failed", failed).drop("_q_hashes", "_q_windows", "_q_sorted", "_q_places")


def figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base figures, and ``_q_text``, ``_q_words`` and ``_q_lines`` for the rules."""
    return _repeats(_counts(docs, text_col))


def _where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns where they stand. A plain filter would be pushed below them with their
    definitions put in, nested array functions included, and evaluate those once for each element; a
    column that isn't deterministic holds it back."""
    return df.withColumn("_q_row", F.monotonically_increasing_id()).where(condition & (F.col("_q_row") >= 0)).drop("_q_row")


class Rule(NamedTuple):
    rejects: Column
    cost: Column


def rules() -> dict[str, Rule]:
    """By name, over the columns of ``figures``. Never null. A cost is a number of steps: 1 for figures that are there,
    and for each word 1 to look at it, 4 to put it into a set, 12 to match a pattern; a step scans 16 bytes."""
    n = F.col("n_words")
    one = F.lit(1.0)
    return {
        "symbols": Rule(F.col("n_symbols") * 10 > n, one),
        "shouting": Rule(F.col("n_words") < 5 * (F.octet_length("_q_text") - F.octet_length(F.replace("_q_text", F.lit("!"), F.lit("")))), 1 + F.octet_length("_q_text") / 16.0),
        "word length": Rule((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n), one),
        "repeated lines": Rule(F.col("n_dup_lines") * 2 > F.size("_q_lines"), one),
        "letters": Rule(F.size(F.filter("_q_words", lambda w: w.rlike(r"\p{L}"))) * 2 < n, 1.0 + 12 * n),
        "stuttering": Rule(F.size(F.filter("_q_words", lambda w, i: (i > 0) & (w == F.get("_q_words", i - 1)))) * 3 > n, 1.0 + n),
        "distinct words": Rule((n >= 50) & (F.size(F.array_distinct("_q_words")) * 20 < n), F.when(n >= 50, 1.0 + 4 * n).otherwise(one)),
    }


def cascade_order(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[str]:
    """Rule names by rejections per cost on ``sample`` documents that the base rule keeps, taken from as few partitions
    as hold so many. What is collected is a flag and a cost a rule and document."""
    by_name = rules()
    passed = _where(figures(docs.select(F.col(text_col).alias("t")), "t"), ~F.col("base_failed"))
    flags = [c for r in by_name.values() for c in (r.rejects.cast("double"), r.cost.cast("double"))]
    rows = passed.select(F.array(*flags).alias("x")).limit(sample).collect()
    total = max(1, len(rows))
    hits, costs = ([sum(r["x"][2 * i + j] for r in rows) for i in range(len(by_name))] for j in (0, 1))
    worth = {name: (hits[i] + 0.5) / max(1.0, costs[i] / total) for i, name in enumerate(by_name)}
    return sorted(by_name, key=lambda name: -worth[name])


def _passes(order: list[str], first: Column | None = None) -> Column:
    """The cascade as one lazy expression: each rule is asked only if those before it let the document pass."""
    by_name = rules()
    verdict = F.when(F.lit(False) if first is None else first, F.lit(False))
    for name in order:
        verdict = verdict.when(by_name[name].rejects, F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """``docs`` with the base figures, base_failed and kept."""
    order = order or cascade_order(docs, text_col)
    return figures(docs, text_col).withColumn("kept", _passes(order, F.col("base_failed"))).drop("_q_text", "_q_words", "_q_lines")


def keep(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    order = order or cascade_order(docs, text_col)
    own = docs.select(F.col(text_col).alias("_q_own_text"), F.struct(*docs.columns).alias("_q_own"))
    few = F.col("n_words") < MIN_WORDS
    left = _where(_counts(own, "_q_own_text").withColumn("_q_kept", _passes(order, few)), F.col("_q_kept"))
    return _where(_repeats(left), ~F.col("base_failed")).select("_q_own.*")
