"""Decisions with their reasons: relevance, labels, publication gates, poll inclusion, release rules and golden checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a publication policy allows unless it says otherwise.
TERMINAL = ("published", "rejected", "merged", "withdrawn")
APPROVALS = ("approve", "approve_with_edits", "approve_as_subevent")


def words_in(text: Column, words: tuple[str, ...]) -> Column:
    """Words of a table that the text contains, in the table's order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.array().cast("array<string>")


@dataclass(frozen=True)
class Tables:
    """Words of a relevance decision: direct ones, two parties and their relation, contexts, entities and topics."""

    direct: tuple[str, ...]
    first: tuple[str, ...]
    second: tuple[str, ...]
    pair_first: tuple[str, ...]
    pair_second: tuple[str, ...]
    cross: tuple[str, ...]
    strong: tuple[str, ...]
    entities: tuple[str, ...] = ()
    topics: tuple[tuple[str, tuple[str, ...]], ...] = ()


def relevance_decision(title: Column, summary: Column, source: Column, t: Tables) -> Column:
    """``relevant, tier, reason, keywords, entities, topics, input_hash``: the first rule that fits.

    Direct words come first, then the first party with a strong context, both
    parties of a pair, the first party with the second (relevant), either alone
    (not relevant). At most five words are named in a reason. Null texts are blank.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.lower(F.concat_ws(" ", blank(title), blank(summary)))
    hits = {n: words_in(text, getattr(t, n)) for n in ("direct", "first", "second", "pair_first", "pair_second", "cross")}
    strong = F.array_intersect(hits["cross"], F.array(*[F.lit(w) for w in t.strong]))
    topics = F.array_compact(F.array(*[F.when(F.size(words_in(text, w)) > 0, F.lit(n)) for n, w in t.topics])) if t.topics else F.array().cast("array<string>")
    topics = F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit("international")))
    named = lambda c: F.array_join(F.slice(c, 1, 5), ", ")
    some = lambda n: F.size(hits[n]) > 0
    end = F.concat(F.lit("; topics="), F.array_join(topics, ","))
    every = F.array_distinct(F.concat(*hits.values()))
    digest = F.sha2(F.concat_ws("\x1f", blank(title), blank(summary), blank(source)), 256)

    def decided(relevant: bool, tier: str, *reason: Column | str) -> Column:
        why = F.concat(*[F.lit(r) if isinstance(r, str) else r for r in reason])
        return F.struct(F.lit(relevant).alias("relevant"), F.lit(tier).alias("tier"), why.alias("reason"), every.alias("keywords"), words_in(text, t.entities).alias("entities"), topics.alias("topics"), digest.alias("input_hash"))

    return (
        F.when(some("direct"), decided(True, "direct", "direct entity or context: ", named(hits["direct"]), end)).when(some("first") & (F.size(strong) > 0), decided(True, "first_party", "first party with context: ", named(strong), end))
        .when(some("pair_first") & some("pair_second"), decided(True, "pair", "relation: ", named(hits["pair_first"]), " and ", named(hits["pair_second"]), end)).when(some("first") & some("second"), decided(True, "second_party", "second party linked to first: ", named(hits["second"]), end))
        .when(some("first"), decided(False, "first_party", "first party without context")).when(some("second"), decided(False, "second_party", "second party without context")).otherwise(decided(False, "other", "no relation"))
    )


def relevance_label(e: dict[str, Column]) -> Column:
    """``label`` and ``reasons`` from evidence: region, actors, election, action, phrase, statement, media, uncertain, national, other_race, internal, empty, broken.

    ``actors`` is an array, ``phrase`` the text of the action (blank if none), the
    others are conditions; null ones don't hold.
    """
    on = {k: F.coalesce(v, F.lit(False)) for k, v in e.items() if k not in ("actors", "phrase")}
    actors, phrase = F.coalesce(e["actors"], F.array().cast("array<string>")), F.coalesce(e["phrase"], F.lit(""))
    people, acts = F.size(actors) > 0, on["action"] | (phrase != "")
    clean, near = ~on["national"] & ~on["other_race"], on["region"] | people
    base = [
        F.when(on["region"], F.lit("region_evidence")), F.when(on["election"], F.lit("election_evidence")), F.when(people, F.concat(F.lit("actor_evidence:"), F.array_join(actors, ","))), F.when(phrase != "", F.concat(F.lit("action_evidence:"), phrase)),
        F.when(on["national"], F.lit("negative_evidence:national_topic")), F.when(on["other_race"], F.lit("negative_evidence:other_race")), F.when(on["internal"], F.lit("negative_evidence:party_internal")),
    ]
    verdict = lambda label, why: F.struct(F.lit(label).alias("label"), F.array_append(F.array_compact(F.array(*base)), F.lit(why)).alias("reasons"))
    return (
        F.when(on["empty"], verdict("collection_error", "no_valid_text")).when(on["broken"], verdict("collection_error", "collection_error_marker")).when(on["other_race"] & ~near, verdict("irrelevant", "other_race_elsewhere"))
        .when(on["uncertain"], verdict("contextual", "uncertain_report_not_direct")).when(near & on["statement"] & on["election"] & clean, verdict("direct_statement", "actor_region_statement_election"))
        .when(on["region"] & acts & ~on["national"], verdict("direct_event", "region_plus_direct_action")).when(people & acts & clean, verdict("direct_event", "actor_plus_direct_action"))
        .when(near & (~clean | on["internal"] | on["media"] | ~((phrase != "") | on["statement"])), verdict("contextual", "related_but_not_direct")).when(people & on["statement"] & ~on["election"], verdict("contextual", "statement_without_election_context"))
        .when(on["election"] & on["national"], verdict("contextual", "election_background_national")).otherwise(verdict("irrelevant", "no_direct_relation"))
    )


def publication_gates(candidates: DataFrame, facts: DataFrame, sources: DataFrame, decisions: DataFrame, formal: DataFrame, policy: dict[str, tuple[str, ...]]) -> DataFrame:
    """``id, decision, reasons``: candidates against eleven gates; ``reasons`` lists the gates that fail, in order.

    ``candidates``: ``id, risk, label, date, basis, precision, confidence, type, valid,
    duplicate, review, key``; ``facts``: ``id`` of candidates with an observed fact;
    ``sources``: ``id, formal, status``; ``decisions``: ``id, decision``; ``formal``: the ``key``
    of each published event, against which duplicates are looked for once more.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fact = facts.select(F.col("id").alias("f_id")).distinct()
    bad = ~F.coalesce((F.coalesce("formal", F.lit("")) != "") & F.col("status").isin(*policy["source_status"]), F.lit(False))
    source = sources.groupBy(F.col("id").alias("s_id")).agg(F.count_if(bad).alias("s_bad"))
    approved = decisions.where(F.col("decision").isin(*APPROVALS)).select(F.col("id").alias("d_id")).distinct()
    known = formal.where("key is not null").select(F.col("key").alias("k_key")).distinct()
    rows = candidates.join(fact, F.col("id") == F.col("f_id"), "left").join(source, F.col("id") == F.col("s_id"), "left").join(approved, F.col("id") == F.col("d_id"), "left").join(known, F.col("key") == F.col("k_key"), "left")
    gates = {
        "risk_level_low": text("risk").isin(*policy["risk"]), "relevance_direct_event": text("label").isin(*policy["label"]), "has_observed_fact": F.col("f_id").isNotNull(),
        "date_explicit": F.col("date").isNotNull() & ~text("basis").isin(*policy["forbidden_basis"]) & (text("precision") != "unknown") & (text("confidence") != "unknown"), "event_type_known": ~text("type").isin("", "unknown"),
        "validation_ready": F.coalesce("valid", F.lit(False)), "duplicate_status_no_match": text("duplicate") == "no_match", "duplicate_recheck_clean": F.col("k_key").isNull(), "sources_resolved": F.coalesce(F.col("s_bad") == 0, F.lit(False)),
        "no_terminal_status": ~text("review").isin(*TERMINAL), "no_approve_decision": F.col("d_id").isNull(),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in gates.items()]))
    return rows.select("id", F.when(F.size(failed) == 0, "eligible").otherwise("rejected").alias("decision"), failed.alias("reasons"))


def poll_inclusion(polls: DataFrame, referenced: DataFrame, start: Column, end: Column) -> DataFrame:
    """The polls that a report uses, with ``role``: ``period`` if published or finished within it, ``context`` if a snapshot refers to one.

    ``polls``: ``poll_id, release, field_end``; ``referenced``: ``poll_id``. Both roles at once are ``period``.
    """
    within = lambda c: F.coalesce(F.col(c).cast("date").between(start, end), F.lit(False))
    refs = referenced.select(F.col("poll_id").alias("__p")).distinct()
    role = F.when(within("release") | within("field_end"), "period").when(F.col("__p").isNotNull(), "context")
    return polls.join(refs, F.col("poll_id") == F.col("__p"), "left").withColumn("role", role).where("role is not null").drop("__p")


def release_issues(events: DataFrame, existing: DataFrame, sources: DataFrame, actors: DataFrame, election: str, types: tuple[str, ...], restricted: tuple[str, ...], statuses: tuple[str, ...], phrases: tuple[str, ...]) -> DataFrame:
    """``event_id, severity, check, detail``: what keeps events from being released, a row for each fault.

    ``events``: ``event_id, election_id, type, status, title, summary, occurred, basis``, arrays
    ``date_sources, source_ids, actors, claims, readings, limits`` and text ``significance``;
    ``existing`` and ``sources`` and ``actors`` hold the known ``id``. Ids that occur twice are
    faults of each; an id that exists already is one as well.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    items = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    inside = lambda c: F.exists(items(c), lambda x: (F.coalesce(x, F.lit("")) != "") & F.contains(text("summary"), x))
    flat = {
        "event_id_present": text("event_id") == "", "election_id_valid": text("election_id") != election, "event_type_valid": ~text("type").isin(*types), "event_type_unrestricted": text("type").isin(*restricted), "fact_status_valid": ~text("status").isin(*statuses),
        "claims_not_in_summary": inside("claims"), "readings_not_in_summary": inside("readings"), "significance_not_in_title": (text("significance") != "") & F.contains(text("title"), F.substring(text("significance"), 1, 50)),
        "occurred_valid": F.col("occurred").try_cast("timestamp").isNull(), "date_basis_present": text("basis") == "", "date_sources_present": F.size(items("date_sources")) == 0, "no_date_conflict": text("basis") == "date_conflict_hold",
    }
    line = lambda severity, check, detail: F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), detail.alias("detail"))
    none = F.lit("")
    silent = (F.size(items("limits")) == 0) & (F.size(items("claims")) == 0) & (F.size(items("readings")) == 0)
    faults = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), line("error", k, none)) for k, v in flat.items()], F.when(silent, line("warning", "limits_present", none))))
    said = F.transform(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text("title"), p)), lambda p: line("error", "title_phrase", p))
    own = events.select("event_id", F.explode(F.concat(faults, said)).alias("i")).select("event_id", "i.*")
    twice = events.where(text("event_id") != "").groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id", F.lit("error").alias("severity"), F.lit("event_id_unique").alias("check"), F.col("n").cast("string").alias("detail"))

    def unresolved(column: str, known: DataFrame, check: str, severity: str = "error") -> DataFrame:
        there = known.select(F.col("id").alias("__id")).distinct()
        each = events.select("event_id", F.explode(F.array_distinct(items(column))).alias("detail")).where("detail <> ''")
        return each.join(there, F.col("detail") == F.col("__id"), "left_anti").select("event_id", F.lit(severity).alias("severity"), F.lit(check).alias("check"), "detail")

    again = events.select("event_id").distinct().join(existing.select(F.col("id").alias("__id")).distinct(), F.col("event_id") == F.col("__id"), "left_semi").select("event_id", F.lit("error").alias("severity"), F.lit("event_is_new").alias("check"), F.lit("").alias("detail"))
    return own.unionByName(twice).unionByName(unresolved("source_ids", sources, "sources_resolve")).unionByName(unresolved("actors", actors, "actors_valid")).unionByName(again)


def snapshots_before_events(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """``snapshot, event``: events that a snapshot rests on though they are later than it; ``snapshots``: ``snapshot, as_of, event_ids``; ``events``: ``event, occurred``."""
    each = snapshots.select("snapshot", "as_of", F.explode(F.array_distinct("event_ids")).alias("event"))
    return each.join(events, "event").where(F.col("occurred") > F.col("as_of")).select("snapshot", "event")


def golden_search(ranks: DataFrame, golden: DataFrame) -> DataFrame:
    """``query, kind, item, ok``: rules about search results. ``ranks``: ``query, item, rank``; ``golden``: ``query, kind, item, other, most``.

    Kinds: ``include`` and ``exclude`` an item, ``first`` (rank 1), ``before`` (item
    before other, both found), ``most`` (no more results than that).
    """
    own = ranks.select(F.col("query").alias("q1"), F.col("item").alias("i1"), F.col("rank").alias("r1"))
    second = ranks.select(F.col("query").alias("q2"), F.col("item").alias("i2"), F.col("rank").alias("r2"))
    sizes = ranks.groupBy(F.col("query").alias("q3")).agg(F.count("*").alias("n"))
    rows = golden.join(own, (F.col("query") == F.col("q1")) & (F.col("item") == F.col("i1")), "left").join(second, (F.col("query") == F.col("q2")) & (F.col("other") == F.col("i2")), "left").join(sizes, F.col("query") == F.col("q3"), "left")
    ok = F.when(F.col("kind") == "include", F.col("r1").isNotNull()).when(F.col("kind") == "exclude", F.col("r1").isNull()).when(F.col("kind") == "first", F.col("r1") == 1).when(F.col("kind") == "before", F.col("r1") < F.col("r2")).when(F.col("kind") == "most", F.coalesce("n", F.lit(0)) <= F.col("most"))
    return rows.select("query", "kind", "item", F.coalesce(ok, F.lit(False)).alias("ok"))


def adjudication(pairs: DataFrame) -> DataFrame:
    """One row: ``n, missing, agreed, agreement, precision, recall`` of ``expected`` and ``predicted`` labels.

    A wrong label is a false positive and a false negative at once; a missing
    prediction is a false negative only. Rates of nothing are 0.
    """
    right = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False))
    counted = pairs.where("expected is not null").agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isNull()).alias("missing"), F.count_if(right).alias("agreed"))
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    agreed, n = F.col("agreed"), F.col("n")
    return counted.select("n", "missing", "agreed", rate(agreed, n).alias("agreement"), rate(agreed, n - F.col("missing")).alias("precision"), rate(agreed, n).alias("recall"))
