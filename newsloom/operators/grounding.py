"""Grounding of claims in evidence: cited ids, relations of what is cited, numbers, dates, attribution, and overlap of texts.

``claims``: ``claim, kind, text``. ``refs``: ``claim, kind, ref`` (kind: event,
poll, source, gap or dimension). ``evidence``: ``kind, id, text, dates``
(an array of days as text). ``links``: ``kind, id, source``. All ids are text.
Containment is by counting: an anti-join finds what is missing for "all", a
semi-join what is there for "some"; a claim meets only what it cites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.storage import cut, only

#: What cites facts, what marks a statement as somebody's.
FACTS = ("event", "poll")
ATTRIBUTION = ("表示", "称", "指出", "指称", "宣称", "声称", "指控", "公开指控", "重申")
#: Tokens of the left side that are broadcast at most, some 20 bytes each.
FEW = 500_000
NUMBER, DAY = r"\d[\d,]*(?:\.\d+)?%?", r"\d{4}-\d{2}-\d{2}"


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring letters, digits and Chinese characters."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z\\x{4e00}-\\x{9fff}]+", "")
    n = F.length(bare)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(bare, i, F.lit(2)))))


def overlap_pairs(left: DataFrame, right: DataFrame, percent: int, same: bool = False) -> DataFrame:
    """``a, b, common, smaller``: pairs of token sets with 100 * common >= percent * (size of the smaller).

    ``left`` and ``right``: ``id, tokens``; ``same``: both are one table, and each
    pair comes once (a < b). The smaller set of a pair has at least c = ceil(percent
    / 100 of its size) tokens in common, so one is among its n - c + 1 rarest: these
    are joined with all tokens of the sets that aren't smaller. (Prefixes of both
    sides, right for Jaccard, would lose pairs, as the larger set bounds nothing.)
    Sets without tokens match nothing. Each text is read once: of the right side only
    tokens of the left stay, with the full size of their set; tokens that one side
    lacks are the rarest of all and are left out. Left sides of up to ``FEW`` tokens
    are broadcast, larger ones are joined by shuffles.
    """
    column = F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))

    def exploded(frame: DataFrame, name: str) -> DataFrame:
        # the size has a projection of its own, as the rows of an explode would carry the whole set else; Spark infers a filter from a plain explode, which makes the sets anew
        return frame.select(F.col("id").alias(name), column.alias("s")).select(name, F.size("s").alias(f"n{name}"), "s").select(name, f"n{name}", F.explode_outer("s").alias("token")).where("token is not null")

    one = cut(exploded(left, "a"))
    two = one if same else cut(only(exploded(right, "b"), one.select("token"), "token", FEW))
    common_in = two.groupBy("token").agg(F.count("*").alias("df")).where(f"df > {int(same)}")
    small = one.limit(FEW + 1).count() <= FEW
    hint = F.broadcast if small else lambda df: df

    def ranked(tokens: DataFrame, name: str) -> DataFrame:
        need = F.ceil(F.col(f"n{name}") * percent / 100)
        rows = tokens.join(hint(common_in), "token").groupBy(name, f"n{name}").agg(F.array_sort(F.collect_list(F.struct("df", "token")))["token"].alias(f"s{name}"))
        return cut(rows.withColumn(f"p{name}", (F.size(f"s{name}") - need + 1).cast("int")))

    a = ranked(one, "a")
    b = a.toDF("b", "nb", "sb", "pb") if same else ranked(two, "b")
    whole = {name: f.select(name, f"n{name}", F.explode(f"s{name}").alias("token")) for name, f in (("a", a), ("b", b))}
    prefix = {name: f.where(f"p{name} > 0").select(name, f"n{name}", F.explode(F.slice(f"s{name}", 1, F.col(f"p{name}"))).alias("token")) for name, f in (("a", a), ("b", b))}
    met = whole["b"].join(hint(prefix["a"]), "token").where("na <= nb").select("a", "b").unionByName(prefix["b"].join(hint(whole["a"]), "token").where("nb < na").select("a", "b"))
    if same:
        met = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # each right set travels once to all it has met
    pairs = met.groupBy("b").agg(F.collect_set("a").alias("met")).join(b.drop("pb"), "b").select("b", "nb", "sb", F.explode("met").alias("a")).join(hint(a.drop("pa")), "a")
    shared, smaller = F.size(F.array_intersect("sa", "sb")), F.least("na", "nb")
    return pairs.where(100 * shared >= percent * smaller).select("a", "b", shared.cast("long").alias("common"), smaller.cast("long").alias("smaller"))


def issues(claims: DataFrame, refs: DataFrame, evidence: DataFrame, links: DataFrame, days: tuple[str, ...] = ()) -> DataFrame:
    """``claim, issue, detail``, a row for each thing that isn't grounded; grounded claims have none.

    Issues: ``unknown_<kind>`` (a cited id that doesn't exist), ``missing_source``
    (events or polls but no source), ``item_without_source`` (a cited event or
    poll none of whose sources is cited), ``source_without_item`` (a cited source
    of no cited event or poll, in claims that cite any), ``number_not_in_evidence``
    and ``date_not_in_evidence`` (of the claim's text; ``days`` are allowed to
    all). Defined results: repeated refs count once; null refs and null texts
    don't count; an unknown id has no links and no text.
    """
    cited = cut(refs.where("claim is not null and ref is not null").select("claim", "kind", "ref").distinct())
    known = evidence.select(F.col("kind").alias("ek"), F.col("id").alias("ei")).distinct()
    unknown = cited.join(known, (F.col("kind") == F.col("ek")) & (F.col("ref") == F.col("ei")), "left_anti").select("claim", F.concat(F.lit("unknown_"), "kind").alias("issue"), F.col("ref").alias("detail"))
    items, sources = cited.where(F.col("kind").isin(*FACTS)), cited.where("kind = 'source'").select("claim", F.col("ref").alias("source"))
    citing = items.select("claim").distinct()
    bare = citing.join(sources, "claim", "left_anti").select("claim", F.lit("missing_source").alias("issue"), F.lit("").alias("detail"))
    ties = links.select(F.col("kind").alias("lk"), F.col("id").alias("li"), F.col("source").alias("ls")).distinct()
    # a claim's own pairs are few, the links of an item may be many
    tied = cut(items.join(sources, "claim").join(ties, (F.col("kind") == F.col("lk")) & (F.col("ref") == F.col("li")) & (F.col("source") == F.col("ls")), "left_semi").select("claim", "kind", "ref", "source"))
    alone = items.join(sources.select("claim").distinct(), "claim", "left_semi").join(tied, ["claim", "kind", "ref"], "left_anti").select("claim", F.lit("item_without_source").alias("issue"), F.concat_ws(":", "kind", "ref").alias("detail"))
    loose = sources.join(citing, "claim", "left_semi").join(tied, ["claim", "source"], "left_anti").select("claim", F.lit("source_without_item").alias("issue"), F.col("source").alias("detail"))
    text = claims.select("claim", F.coalesce("text", F.lit("")).alias("text"))
    mentioned = lambda pattern: text.select("claim", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("v"))
    numbers = mentioned(NUMBER)
    bodies = cited.join(evidence.select(F.col("kind").alias("ek"), F.col("id").alias("ei"), F.coalesce("text", F.lit("")).alias("body")), (F.col("kind") == F.col("ek")) & (F.col("ref") == F.col("ei"))).select("claim", "body")
    there = numbers.join(bodies, "claim").where(F.contains("body", F.col("v")) | F.contains("body", F.regexp_replace("v", ",", ""))).select("claim", "v")
    no_number = numbers.join(there, ["claim", "v"], "left_anti").select("claim", F.lit("number_not_in_evidence").alias("issue"), F.col("v").alias("detail"))
    dated = cited.join(evidence.select(F.col("kind").alias("ek"), F.col("id").alias("ei"), F.explode("dates").alias("v")), (F.col("kind") == F.col("ek")) & (F.col("ref") == F.col("ei"))).select("claim", F.substring("v", 1, 10).alias("v"))
    no_day = mentioned(DAY).where(~F.col("v").isin(*days) if days else F.lit(True)).join(dated, ["claim", "v"], "left_anti").select("claim", F.lit("date_not_in_evidence").alias("issue"), F.col("v").alias("detail"))
    out = unknown
    for more in (bare, alone, loose, no_number, no_day):
        out = out.unionByName(more)
    return out


def unattributed(claims: DataFrame, refs: DataFrame, said: DataFrame, percent: int = 55, terms: tuple[str, ...] = ATTRIBUTION) -> DataFrame:
    """``claim, issue, assertion``: claims that repeat a cited statement or allegation without its speaker and a word of saying.

    ``said``: ``id, event, kind, speaker, text`` of assertions. Only assertions of
    events that the claim cites count, where the overlap of bigrams reaches
    ``percent``; issues are ``statement_as_fact`` and ``allegation_as_fact``.
    """
    own = said.where(F.col("kind").isin("actor_statement", "allegation")).select(F.col("id").alias("assertion"), "event", F.col("kind").alias("said_as"), F.trim(F.coalesce("speaker", F.lit(""))).alias("speaker"), bigrams(F.col("text")).alias("sb"))
    text = claims.select("claim", F.coalesce("text", F.lit("")).alias("text"), bigrams(F.col("text")).alias("sa"))
    cited = refs.where("kind = 'event'").select("claim", F.col("ref").alias("event")).distinct().join(own, "event").join(text, "claim")
    smaller = F.least(F.size("sa"), F.size("sb"))
    close = (smaller > 0) & (100 * F.size(F.array_intersect("sa", "sb")) >= percent * smaller)
    marked = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains("text", t))
    fair = (F.col("speaker") != "") & F.contains("text", "speaker") & marked
    return cited.where(close & ~fair).select("claim", F.when(F.col("said_as") == "allegation", "allegation_as_fact").otherwise("statement_as_fact").alias("issue"), "assertion")


def evidence_reuse(refs: DataFrame, unit: str = "claim") -> DataFrame:
    """``kind, ref, n``: evidence that more than one unit cites."""
    return refs.where("ref is not null").groupBy("kind", "ref").agg(F.countDistinct(unit).alias("n")).where("n > 1")
