"""Names: resolving sources against known ones, by ordered steps with a fuzzy last one, and names within texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.operators import match

#: Names of a table that may travel to every task; larger tables are joined.
FEW = 200_000


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Compatibility form without outer blanks, runs of blanks as one space."""
    return names.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


def bag(name: Column) -> Column:
    """Characters of a name with the number of times that they came before: a multiset as a set."""
    at = lambda i: F.substring(name, i, F.lit(1))
    before = lambda i: F.substring(name, F.lit(1), i - 1)
    n = F.length(name)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(at(i), (i - 1 - F.length(F.replace(before(i), at(i), F.lit("")))).cast("string"))))


def fuzzy_pairs(left: DataFrame, right: DataFrame, percent: int = 85) -> DataFrame:
    """``a, b, ratio``: distinct names of both sides whose ratio of matching blocks is ``percent`` / 100 or more.

    ``left`` and ``right`` have ``name``. Matching blocks can't hold more
    characters than the bags have in common, so at ratio t names of lengths m and n
    share t (m + n) / 2 of their bag, at least m t / (2 - t) whatever n is. The
    rarest m - that + 1 elements of each bag are joined, then lengths and whole
    bags bound the ratio, and only what is left is compared. Blank names match none.
    """
    sides = {}
    for name, frame in (("a", left), ("b", right)):
        sides[name] = frame.select(F.col("name").alias(name)).where(F.length(name) > 0).distinct().withColumn(f"s{name}", bag(F.col(name)))
    each = {k: f.select(k, F.size(f"s{k}").alias(f"n{k}"), F.explode(f"s{k}").alias("token")) for k, f in sides.items()}
    rarity = each["a"].select("token").unionByName(each["b"].select("token")).groupBy("token").agg(F.count("*").alias("df"))

    def prefix(k: str) -> DataFrame:
        ranked = each[k].join(rarity, "token").groupBy(k, f"n{k}").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
        n = F.col(f"n{k}")
        return ranked.select(k, f"n{k}", F.explode(F.slice("r", 1, (n - F.ceil(n * percent / (200 - percent)) + 1).cast("int"))["token"]).alias("token"))

    met = prefix("a").join(prefix("b"), "token").where(f"200 * least(na, nb) >= {percent} * (na + nb)").select("a", "b").distinct()
    common = F.size(F.array_intersect("sa", "sb"))
    close = met.join(sides["a"], "a").join(sides["b"], "b").where(200 * common >= percent * (F.size("sa") + F.size("sb")))
    return close.select("a", "b", match.sequence_ratio("a", "b").alias("ratio")).where(F.col("ratio") >= percent / 100)


def resolve_sources(candidates: DataFrame, known: DataFrame, aliases: dict[str, str], suffixes: tuple[str, ...] = (), percent: int = 85) -> DataFrame:
    """``id, source, status, basis, ratio`` of each candidate: the first step that finds a known source.

    ``candidates`` and ``known``: ``id, name, domain``. Steps: domain, exact name,
    alias, name without a suffix, then the best ratio of ``percent`` / 100 or more
    (ties: the smaller id). Names are compared in compatibility form. Status is
    ``exact``, ``normalized_match``, ``possible_match``, ``new_candidate_source``, or
    ``unresolved`` for a candidate without name and domain; of several known
    sources with one key the smallest id counts.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))

    def bare(name: Column) -> Column:
        out = name
        for s in reversed(suffixes):
            out = F.when(name.endswith(s) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
        return out

    rows = candidates.select("id", nfkc(blank("name")).alias("name"), blank("domain").alias("domain"))
    formal = known.select(F.col("id").alias("source"), nfkc(blank("name")).alias("fname"), blank("domain").alias("fdomain"))
    keyed = lambda key, name: formal.groupBy(key.alias(name)).agg(F.min("source").alias(f"{name}_id")).where(F.col(name) != "")
    other = F.lit(None).cast("string")
    for alias, name in aliases.items():
        other = F.when(F.col("name") == alias, name).otherwise(other)
    out = rows.withColumns({"other": other, "plain": bare(F.col("name"))})
    by_domain, by_name, by_plain = keyed(F.col("fdomain"), "k1"), keyed(F.col("fname"), "k2"), keyed(bare(F.col("fname")), "k4")
    by_alias = by_name.withColumnsRenamed({"k2": "k3", "k2_id": "k3_id"})
    for table, own, key in ((by_domain, "domain", "k1"), (by_name, "name", "k2"), (by_alias, "other", "k3"), (by_plain, "plain", "k4")):
        out = out.join(table, F.col(own) == F.col(key), "left")
    found = F.coalesce("k1_id", "k2_id", "k3_id", "k4_id")
    open_ = out.where(found.isNull() & (F.col("name") != ""))
    pairs = fuzzy_pairs(open_.select("name"), formal.select(F.col("fname").alias("name")), percent)
    best = pairs.join(by_name, F.col("b") == F.col("k2")).groupBy("a").agg(F.max(F.struct("ratio", (-F.col("k2_id")).alias("low"))).alias("m"))
    full = out.join(best, F.col("name") == F.col("a"), "left")
    basis = (
        F.when(F.col("k1_id").isNotNull(), "domain_exact").when(F.col("k2_id").isNotNull(), "name_exact").when(F.col("k3_id").isNotNull(), "alias_match").when(F.col("k4_id").isNotNull(), "normalized_name_match")
        .when(F.col("m").isNotNull(), "fuzzy_name_match").when((F.col("name") == "") & (F.col("domain") == ""), "no_name_no_domain").otherwise("none")
    )
    status = (
        F.when(F.col("basis").isin("domain_exact", "name_exact"), "exact").when(F.col("basis").isin("alias_match", "normalized_name_match"), "normalized_match").when(F.col("basis") == "fuzzy_name_match", "possible_match")
        .when(F.col("basis") == "no_name_no_domain", "unresolved").otherwise("new_candidate_source")
    )
    source = F.coalesce(found, F.when(F.col("m").isNotNull(), -F.col("m.low")))
    return full.select("id", source.alias("source"), basis.alias("basis"), F.when(found.isNull(), F.col("m.ratio")).alias("ratio")).withColumn("status", status).select("id", "source", "status", "basis", "ratio")


def names_in_texts(texts: DataFrame, names: DataFrame, few: int = FEW) -> DataFrame:
    """``id, name, n``: how often each name of a table stands in each text, overlapping places included.

    ``texts``: ``id, text``; ``names``: ``name``. The names are counted first: up to
    ``few`` of them travel to the tasks as one automaton, which reads each text
    once; more are joined with the substrings of the texts that have a name's
    length. Blank names are left out; repeated names count once; letter case counts.
    """
    table = names.where(F.length("name") > 0).select("name").distinct()
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    if table.limit(few + 1).count() <= few:
        words = [r["name"] for r in table.collect()]
        return _scanned(rows, words)
    lengths = [r["n"] for r in table.select(F.length("name").alias("n")).distinct().collect()]  # as many as there are lengths
    n = F.explode(F.array(*[F.lit(k) for k in lengths]))
    spans = rows.select("id", "text", n.alias("k")).where(F.length("text") >= F.col("k"))
    parts = spans.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("k") + 1), lambda i: F.substring("text", i, F.col("k")))).alias("name"))
    return parts.join(table, "name").groupBy("id", "name").agg(F.count("*").alias("n"))


def _scanned(rows: DataFrame, words: list[str]) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        if words:
            automaton.make_automaton()
        for frame in frames:
            out = []
            for key, text in zip(frame["id"], frame["text"], strict=True):
                counts: dict[str, int] = {}
                for _, w in automaton.iter(text) if words else ():
                    counts[w] = counts.get(w, 0) + 1
                out += [(key, w, n) for w, n in counts.items()]
            yield pd.DataFrame(out, columns=["id", "name", "n"])

    return rows.mapInPandas(scan, f"id {kind}, name string, n bigint")


def organisations(text: Column, suffixes: tuple[str, ...], actions: tuple[str, ...], noise: tuple[str, ...] = ()) -> Column:
    """Names of 2 to 12 Chinese characters that end in a suffix right before a word of action; names with noise words are left out."""
    ends = "|".join(sorted(suffixes, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(f"([\\x{{4e00}}-\\x{{9fff}}]{{2,12}}?(?:{ends}))(?={'|'.join(actions)})"), F.lit(1))
    return F.filter(found, lambda x: ~F.exists(F.array(*[F.lit(w) for w in noise]), lambda w: F.contains(x, w))) if noise else found


def persons(text: Column, surnames: str, stops: str = "", tails: tuple[str, ...] = ()) -> Column:
    """Names of three Chinese characters, wherever a surname stands, overlapping ones included; not two surnames, no stop characters, no tails."""
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.contains(F.lit(surnames), F.substring(text, i, F.lit(1))) & (i <= n - 2))
    three = F.transform(starts, lambda i: F.substring(text, i, F.lit(3)))

    def fits(x: Column) -> Column:
        rest = F.substring(x, F.lit(2), F.lit(2))
        plain = x.rlike("^[\\x{4e00}-\\x{9fff}]{3}$") & ~F.contains(F.lit(surnames), F.substring(x, F.lit(2), F.lit(1)))
        plain = plain & ~rest.isin(*tails) if tails else plain
        return plain & (F.length(F.translate(rest, stops, "")) == 2) if stops else plain

    return F.filter(three, fits)
