"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in column expression and every rule a row of a table
(measure, least, most), so the whole operator is a chain of projections over
the scan: no user function, no shuffle, no join.

Defined results: a null text counts as empty; an empty text has zero for every
count, fails ``n_words < 20`` and is rejected; repeated rows are judged one by
one; columns of the input pass through unless they carry one of the names that
the operator returns, which replace them; an empty table gives an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for with this on are by be as was at or from an not "
    "der die das und den von zu mit sich des im für auf ist ein eine dem nicht auch "
    "le la les de des et en un une que qui dans pour sur par au avec est du "
    "el los las y del se por con para una su al es como no"
).split()


class Rule(NamedTuple):
    """A document passes if ``least <= measure <= most``; None: no bound."""

    name: str
    measure: str
    least: float | None
    most: float | None


#: Production thresholds; all measures are ratios or lengths of whole texts.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 1.5, 15.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.3),
    Rule("shouting_per_word", "shouts_per_word", None, 0.3),
    Rule("stop_word_share", "stop_share", 0.02, None),
    Rule("adjacent_repeat_share", "adjacent_repeat_share", None, 0.2),
    Rule("repeated_line_share", "dup_line_share", None, 0.5),
)


#: What the operator adds.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "shouts_per_word",
    "stop_share", "dup_line_share", "adjacent_repeat_share", "base_failed", "failed_rules", "kept",
)


def _ratio(a: Column | str, b: Column | str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1)) if isinstance(a, str) else a / F.greatest(b, F.lit(1))


def _paired(name: str, step: int):
    return lambda h, i: F.xxhash64(h, F.get(name, i + step))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts and the ratios that rules refer to; internal columns start with ``__q``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    one = docs.withColumns({
        "__q_words": F.filter(F.split(body, SPLIT), lambda w: w != ""),
        "__q_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)),
    })
    n = F.size("__q_words")
    two = one.withColumns({
        "__q_n": n.cast("long"),
        "word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "__q_nl": F.size("__q_lines").cast("long"),
        "__q_stop": F.size(F.filter("__q_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "__q_shout": F.regexp_count(body, F.lit("!")).cast("long"),
        "__q_hash": F.transform("__q_words", lambda w: F.xxhash64(w)),
    }).drop("__q_lines", "__q_words")
    two = two.withColumn("__q_adjacent", F.size(F.filter("__q_hash", lambda h, i: h == F.get("__q_hash", i - 1))).cast("long"))
    # hashes of 1, 2, 4 and then 8 words from each place
    for step in (1, 2, 4):
        two = two.withColumn("__q_hash", F.transform("__q_hash", _paired("__q_hash", step)))
    two = two.withColumn("__q_hash", F.slice("__q_hash", 1, F.greatest(F.col("__q_n").cast("int") - (WINDOW - 1), F.lit(0))))
    # only texts in which some window comes back sort their windows
    three = two.withColumn(
        "__q_order",
        F.when(
            F.size(F.array_distinct("__q_hash")) < F.size("__q_hash"),
            F.sort_array(F.transform("__q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("__q_hash")
    size = F.size("__q_order")
    last = F.col("__q_order")
    four = three.withColumn(
        "__q_places",
        F.when(
            last.isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
                        lambda j: ((j > 0) & (F.get(last, j)["h"] == F.get(last, j - 1)["h"])) | (F.get(last, j)["h"] == F.get(last, j + 1)["h"]),
                    ),
                    lambda j: F.get(last, j)["i"],
                )
            ),
        ),
    ).drop("__q_order")
    places = F.col("__q_places")
    five = four.withColumn(
        "n_repeat_words",
        F.when(
            places.isNotNull(),
            F.aggregate(
                places,
                F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
                lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")),
                lambda a: a["sum"],
            ),
        ).otherwise(F.lit(0).cast("long")),
    ).drop("__q_places")
    return five.withColumns({
        "n_words": F.col("__q_n"),
        "mean_word_chars": _ratio("word_chars", "__q_n"),
        "symbols_per_word": _ratio("n_symbols", "__q_n"),
        "shouts_per_word": _ratio("__q_shout", "__q_n"),
        "stop_share": _ratio("__q_stop", "__q_n"),
        "dup_line_share": _ratio("n_dup_lines", "__q_nl"),
        "adjacent_repeat_share": _ratio("__q_adjacent", "__q_n"),
    }).drop("__q_n", "__q_nl", "__q_stop", "__q_shout", "__q_adjacent")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row fails, as one array expression."""
    failed = []
    for r in rules:
        outside = F.lit(False)
        if r.least is not None:
            outside = outside | (F.col(r.measure) < r.least)
        if r.most is not None:
            outside = outside | (F.col(r.measure) > r.most)
        failed.append(F.when(outside, F.lit(r.name)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Documents with base counts, ``base_failed``, ``failed_rules`` and the verdict ``kept``."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = (
        measures(docs, text)
        .withColumns({"base_failed": base, "failed_rules": compile_rules(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
    own = [c for c in judged.columns if c in MEASURES]
    # results pass a generator, or a filter on them would be pushed down and every measure written out anew inside it
    return judged.select(*[c for c in judged.columns if c not in MEASURES], F.inline(F.array(F.struct(*own))))
