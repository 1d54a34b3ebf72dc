"""Rule tables compiled to expressions: filters, categories, importance, relevance, routing, search."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T


class ImportanceRule(NamedTuple):
    """(subject and action) or scene, unless a negative word; ``boosts`` adds once; the level can't pass ``cap``."""

    name: str
    subjects: tuple[str, ...]
    actions: tuple[str, ...]
    scenes: tuple[str, ...]
    negative: tuple[str, ...]
    base: int
    boosts: tuple[tuple[tuple[str, ...], int], ...]
    cap: str


#: Levels in order of severity, thresholds and additions.
LEVELS = ("critical", "important", "normal")
CRITICAL, IMPORTANT, OFFICIAL, TIER_ONE, SEVERAL = 85, 65, 5, 3, 5


def validate_rules(rules: list[ImportanceRule]) -> list[str]:
    """Problems of a rule table; empty if it is sound."""
    out, names = [], [r.name for r in rules]
    out += [f"duplicate rule {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    for r in rules:
        if r.cap not in LEVELS:
            out.append(f"{r.name}: unknown level {r.cap}")
        if not 0 <= r.base <= 100:
            out.append(f"{r.name}: base {r.base} outside 0..100")
        if not r.scenes and not (r.subjects and r.actions):
            out.append(f"{r.name}: needs subjects with actions, or scenes")
    return out


def importance(df: DataFrame, body: Column, rules: list[ImportanceRule], official: Column, tier_one: Column, highest: bool = False) -> DataFrame:
    """Adds ``rules_hit, score, level, best_rule``.

    By default the best rule is the one with the greatest (level order, score),
    as the level order counts from critical = 0 this takes the *mildest* level;
    ``highest`` takes the most severe instead.
    """
    entries = []
    for i, r in enumerate(rules):
        matched = ((T.any_of(body, list(r.subjects)) & T.any_of(body, list(r.actions))) | T.any_of(body, list(r.scenes))) & ~T.any_of(body, list(r.negative))
        add = F.lit(r.base)
        for words, points in r.boosts:
            add = add + F.when(T.any_of(body, list(words)), points).otherwise(0)
        entries.append(F.when(matched, F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("name"), add.alias("points"))))
    hit = F.array_compact(F.array(*entries))
    one = df.withColumn("__hit", hit)
    extra = F.when(official, OFFICIAL).when(tier_one, TIER_ONE).otherwise(0) + F.when(F.size("__hit") >= 2, SEVERAL).otherwise(0)
    caps = F.array(*[F.lit(LEVELS.index(r.cap)) for r in rules])

    def scored(h: Column) -> Column:
        score = F.least(F.greatest(h["points"] + F.col("__extra"), F.lit(0)), F.lit(100))
        raw = F.when(score >= CRITICAL, 0).when(score >= IMPORTANT, 1).otherwise(2)
        order = F.greatest(raw, F.get(caps, h["i"]))
        return F.struct((-order if highest else order).alias("order"), score.alias("score"), (-h["i"]).alias("first"), h["name"].alias("name"))

    two = one.withColumn("__extra", extra).withColumn("__best", F.array_max(F.transform("__hit", scored)))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.abs(F.col("__best.order")) + 1)
    return two.withColumns({
        "rules_hit": F.size("__hit").cast("long"),
        "score": F.coalesce(F.col("__best.score"), F.lit(0)).cast("long"),
        "level": F.coalesce(level, F.lit("normal")),
        "best_rule": F.coalesce(F.col("__best.name"), F.lit("")),
    }).drop("__hit", "__extra", "__best")


def content_filter(df: DataFrame, body: Column, category: Column, default: list[str], by_category: dict[str, list[str]], enabled: bool = True) -> DataFrame:
    """Adds ``blocked_by`` (words found, joined) and ``blocked``; nothing is blocked when disabled."""
    found = T.hits(body, default)
    for name, words in by_category.items():
        found = F.when(category == name, F.array_distinct(F.concat(T.hits(body, default), T.hits(body, words)))).otherwise(found)
    return df.withColumn("blocked_by", F.array_join(found, "|")).withColumn("blocked", F.lit(enabled) & (F.col("blocked_by") != ""))


def category(body: Column, families: list[tuple[str, list[str]]], fallback: Column) -> Column:
    """The first family, in order, with a word in the text."""
    out = None
    for name, words in families:
        out = F.when(T.any_of(body, words), name) if out is None else out.when(T.any_of(body, words), name)
    return out.otherwise(fallback)


def relevance(body: Column, direct: list[str], region: list[str], strong: list[str], other: list[str]) -> Column:
    """direct, region_strong, region_other, region, other or none."""
    d, r, s, o = (T.any_of(body, w) for w in (direct, region, strong, other))
    return F.when(d, "direct").when(r & s, "region_strong").when(r & o, "region_other").when(r, "region").when(o, "other").otherwise("none")


def place_match(body: Column, region: list[str], people: list[str], parties: list[str], issues: list[str], context: list[str], exclude: list[str]) -> Column:
    """Struct of matched, score and level: people 3, parties 2, context 2, issues 1 (an issue is context as well); high from 5, medium from 3."""
    p, q, i = T.any_of(body, people), T.any_of(body, parties), T.any_of(body, issues)
    c = T.any_of(body, context) | i
    matched = (T.any_of(body, region) | p | q | i) & (~T.any_of(body, exclude) | c)
    score = F.when(p, 3).otherwise(0) + F.when(q, 2).otherwise(0) + F.when(c, 2).otherwise(0) + F.when(i, 1).otherwise(0)
    level = F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")
    return F.struct(matched.alias("matched"), F.when(matched, score).otherwise(0).cast("long").alias("score"), F.when(matched, level).otherwise("none").alias("level"))


def event_type(body: Column, table: list[tuple[str, list[str], list[str], str | None]]) -> Column:
    """The type with most words found, the earlier of equals; a negative word or a missing required one rules a type out."""
    scored = []
    for i, (name, words, negative, required) in enumerate(table):
        n = F.size(T.hits(body, words))
        good = (n > 0) & ~T.any_of(body, negative)
        if required:
            good = good & T.any_of(body, [required])
        scored.append(F.when(good, F.struct(n.alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name"))))
    return F.coalesce(F.array_max(F.array_compact(F.array(*scored)))["name"], F.lit("unknown"))


def search(df: DataFrame, query: str, fields: dict[str, int], strict: bool = False) -> DataFrame:
    """Rows that match enough query tokens: ``matched``, ``relevance`` (each token's best field, summed) and ``mode``."""
    words = list(dict.fromkeys(w for w in query.lower().split() if w))
    per = [F.greatest(*[F.when(F.contains(F.lower(F.col(f)), F.lit(w)), points).otherwise(0) for f, points in fields.items()], F.lit(0)) for w in words]
    matched = sum((F.when(p > 0, 1).otherwise(0) for p in per), F.lit(0))
    need = len(words) if strict else max(1, len(words) // 2 + 1)
    mode = F.when(F.col("matched") == len(words), "strict").otherwise("relaxed")
    return df.withColumns({"matched": matched.cast("long"), "relevance": sum(per, F.lit(0)).cast("long")}).where(F.col("matched") >= need).withColumn("mode", mode)


def route(completeness: Column, cluster: Column, source: Column, risk: Column, duplicate: Column) -> Column:
    """duplicate, auto_reject, hold, context_only or review_required, by the first rule that holds."""
    return (
        F.when(duplicate >= 0.9, "duplicate").when(completeness < 0.2, "auto_reject").when((completeness < 0.4) | (source < 0.3), "hold")
        .when(cluster < 0.35, "context_only").when(risk >= 0.6, "hold").otherwise("review_required")
    )


#: Points of a search hit by field, beside those for the whole query in the title, all words in it, an actor, its place and the type.
HIT_POINTS = {"summary": 15, "actors": 12, "issues": 12, "notes": 3}
TITLE_QUERY, TITLE_WORDS, ACTOR, MAIN_ACTOR, SIDE_ACTOR, TYPE_POINTS = 100, 80, 35, 35, 20, 25


def event_search(df: DataFrame, query: str, title: str, actors: str, types: tuple[str, dict[str, list[str]]], fields: dict[str, str], other: tuple[str, ...] = ()) -> DataFrame:
    """Additive search: ``matched, relevance, mode``; mode irrelevant (relevance 0) if too few words match.

    ``actors`` is a list column. ``fields`` maps the names of ``HIT_POINTS`` to
    text columns; ``other`` columns count as matches without points. More than
    half of the words relax a search, if one of those in the title or among the
    actors is an actor, or none is there.
    """
    words = list(dict.fromkeys(query.split()))
    named = F.array_join(F.coalesce(F.col(actors), F.array().cast("array<string>")), " ")
    at = lambda c, w: F.contains(F.coalesce(c, F.lit("")), F.lit(w))
    texts = {n: F.col(c) for n, c in fields.items()} | {"actors": named}
    head = F.coalesce(F.col(title), F.lit(""))
    per = [at(head, w) | at(texts["actors"], w) | any_(at(c, w) for c in [*texts.values(), *map(F.col, other)]) for w in words]
    matched = sum((p.cast("int") for p in per), F.lit(0))
    person = any_(at(head, w) | at(named, w) for w in words)
    relaxed = (matched >= max(1, len(words) // 2 + 1)) & (any_(at(named, w) for w in words) | ~person)
    mode = F.when(matched >= len(words), "strict").when(relaxed, "relaxed").otherwise("irrelevant")
    score = F.when(F.contains(head, F.lit(" ".join(words))), TITLE_QUERY).when(all_(at(head, w) for w in words), TITLE_WORDS).otherwise(0)
    # the first word that names an actor counts, more if the title begins with that actor
    hit = F.lit(0)
    for w in reversed(words):
        hit = F.when(at(named, w), ACTOR + F.when(_leads(head, F.col(actors), w), MAIN_ACTOR).otherwise(SIDE_ACTOR)).otherwise(hit)
    score = score + hit
    kind, table = types
    for name, typical in table.items():
        if any(t in " ".join(words) for t in typical):
            score = score + F.when(F.col(kind) == name, TYPE_POINTS).otherwise(0)
    for w in words:
        for n, c in texts.items():
            score = score + F.when(at(c, w), HIT_POINTS[n]).otherwise(0)
    return df.withColumns({"matched": matched.cast("long"), "mode": mode}).withColumn("relevance", F.when(F.col("mode") == "irrelevant", 0).otherwise(score).cast("long"))


def _leads(head: Column, actors: Column, word: str) -> Column:
    return F.exists(F.coalesce(actors, F.array().cast("array<string>")), lambda a: F.startswith(head, a) & F.contains(a, F.lit(word)))


def any_(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


#: What a candidate without a label needs for review.
REVIEW = {"cluster_confidence": 0.35, "source_confidence": 0.30, "completeness": 0.40}


def route_candidate(label: Column, fact: Column, statement: Column, duplicate: Column, date_basis: Column, sources: Column, risk: Column, scores: dict[str, Column]) -> Column:
    """Struct of ``route`` and ``reasons``: labels decide first, then duplicates, then what an event or a statement lacks; candidates without a label need their scores."""
    unknown, none = F.coalesce(date_basis, F.lit("")) == "unknown", F.coalesce(sources, F.lit(0)) == 0
    lacks = lambda named: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    event = lacks({"direct_event_without_observed_fact": ~fact, "date_unknown": unknown, "no_valid_source": none})
    said = lacks({"direct_statement_without_actor_statement": ~statement, "direct_statement_risk_too_low": F.coalesce(risk, F.lit("low")) == "low", "date_unknown": unknown, "no_valid_source": none})
    plain = lacks({"no_observed_fact_no_statement": ~fact & ~statement, "date_unknown": unknown, **{f"low_{n}": scores[n] < least for n, least in REVIEW.items()}})
    verdict = lambda route, reasons: F.struct(F.lit(route).alias("route"), reasons.alias("reasons"))
    one = lambda reason: F.array(F.lit(reason))
    held = lambda reasons, good: F.when(F.size(reasons) > 0, verdict("hold", reasons)).otherwise(verdict("review_required", one(good)))
    name = F.coalesce(label, F.lit(""))
    return (
        F.when(name.isin("irrelevant", "collection_error"), verdict("auto_reject", F.array(F.concat(F.lit("relevance_label_"), name))))
        .when((name == "contextual") & ~fact & ~statement, verdict("hold", one("contextual_without_actionable_assertion")))
        .when(name == "contextual", verdict("context_only", one("contextual_no_direct_event_or_statement")))
        .when(duplicate, verdict("duplicate_candidate", one("formal_duplicate_or_existing_candidate")))
        .when(name == "direct_event", held(event, "direct_event_eligible"))
        .when(name == "direct_statement", held(said, "direct_statement_eligible"))
        .otherwise(held(plain, "eligible_for_review"))
    )


def gates(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Adds ``failed_gates`` and ``passed``: every named condition must hold; unknown counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items()]))
    return df.withColumn("failed_gates", F.array_join(failed, "|")).withColumn("passed", F.col("failed_gates") == "")


def errors(named: dict[str, Column]) -> Column:
    """Names of the conditions that hold, joined; for validations."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()])), "|")
