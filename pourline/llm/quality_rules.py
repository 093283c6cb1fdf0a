"""Quality rules: a table of thresholds compiled into one Spark projection.

Only built-in column functions run here.  Each rule of ``RULES`` names a
measure and the closed interval it must lie in; ``compile_rules`` turns the
table into one boolean column per rule, so a rule can be added, dropped or moved
without touching the measures.

Defined results: a null text counts as empty; an empty text has zero words and
fails the base test; rows with equal ids or texts are judged one by one; a null
id passes through.  Texts of any length are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be at by this from not "
    "le la les de des du et en un une est que qui dans pour par sur au "
    "der die das und ist von den mit dem ein eine nicht zu auf im sich "
    "el los las del y es una por con para se su lo"
).split()
SYMBOL = "[#*$%&|<>]"
#: Up to so many different repeated windows of a text are looked up one by one.
FEW_REPEATS = 24
SPACE, NOT_SPACE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A measure (a column name of ``measures``) must lie in [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", 50, 2_000_000),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.2),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("line_repeats", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.5),
)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and every measure that the contract and the rule table use."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    cut = base.select(
        "doc_id",
        "body",
        F.array_remove(F.split("body", f"{SPACE}+"), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
    )
    hashed = cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•]\s"))).alias("n_bullets"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipses"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, STOP_WORDS)))).alias("n_stop_words"),
        F.when(
            F.size("words") >= 3,
            F.slice(
                F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
                F.lit(1),
                F.size("words") - 2,
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    sorted_windows = hashed.withColumn("sorted", F.sort_array("windows"))
    repeated = sorted_windows.withColumn(
        "repeated",
        F.when(F.size(F.array_distinct("sorted")) < F.size("sorted"), F.array_distinct(F.filter("sorted", lambda h, i: (i > 0) & (F.get("sorted", i - 1) == h)))),
    ).drop("sorted")
    # A text repeats few different windows, as a rule: those are looked up one by one; otherwise one sort of (window, place) finds them.
    marked = repeated.withColumn(
        "ordered",
        F.when(
            F.size("repeated") > FEW_REPEATS,
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).withColumn(
        "places",
        F.when(
            F.size("repeated") <= FEW_REPEATS,
            F.filter(
                F.transform("windows", lambda h, i: F.when(F.array_contains("repeated", h), i)),
                lambda i: i.isNotNull(),
            ),
        ),
    )
    same = lambda x, i: F.coalesce(F.get("ordered", i)["h"] == x["h"], F.lit(False))
    sorted_places = F.sort_array(
        F.transform(
            F.filter("ordered", lambda x, i: same(x, i + 1) | (F.when(i > 0, same(x, i - 1)).otherwise(False))),
            lambda x: x["i"],
        )
    )
    places = F.coalesce(F.col("places"), sorted_places)
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    per = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("n_stop_words").cast("long").alias("n_stop_words"),
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_bullets", "n_lines").alias("bullet_line_ratio"),
        per("n_ellipses", "n_lines").alias("ellipsis_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column per rule: whether the measure lies in its interval."""
    out = {}
    for rule in rules:
        held = F.lit(True)
        if rule.low is not None:
            held = held & (F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            held = held & (F.col(rule.measure) <= rule.high)
        out[rule.name] = held
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures, the base verdict, the names of the rules that failed, and the final verdict.

    base_failed: fewer than 50 words, or more than half of the words lie in a
    3-word window that occurs twice or more in the text.
    """
    checks = compile_rules(rules)
    failed = F.filter(F.array(*[F.when(~held, F.lit(name)) for name, held in checks.items()]), lambda x: x.isNotNull())
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, doc_id, text).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(failed) == 0)).alias("kept"),
        F.array_join(failed, ",").alias("failed_rules"),
    )
