"""Event clustering: chained dates, layered candidate clusters, order-dependent cliques and the events they make.

Greedy passes over an order are run in parallel: a row is decided as soon as no
earlier undecided row can touch it, so each round decides all local minima of
the order at once. The result is that of the sequential pass. Rounds follow the
longest chain of rows that wait for each other, not the number of rows; a
counter is all that reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.operators import dedup
from newsloom.storage import cut

DAY = 86_400_000_000


def date_islands(df: DataFrame, keys: list[str], ts: str, days: int, name: str = "bucket") -> DataFrame:
    """Adds the number of each row's date bucket within its keys, from 1.

    A row joins a bucket if any member is at most ``days`` whole days away. Rows
    without a time are near to every row and join the first bucket. Days are
    aggregated first, so a key with many rows is as many rows as it has days.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"__t": t, "__day": F.floor(t / DAY)})
    by_day = rows.where("__t is not null").groupBy(*keys, "__day").agg(F.min("__t").alias("__low"), F.max("__t").alias("__high"))
    order = W.partitionBy(*keys).orderBy("__day")
    apart = F.coalesce(F.floor((F.col("__low") - F.lag("__high").over(order)) / DAY) > days, F.lit(True))
    numbered = by_day.withColumn("__new", apart.cast("long")).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__day").alias("__d"), F.sum("__new").over(order).alias("__bucket"))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__day") == F.col("__d")]
    return rows.join(numbered, on, "left").select(*df.columns, F.coalesce("__bucket", F.lit(1).cast("long")).alias(name))


def _order(t: Column, key: Column) -> Column:
    """Rows without a time come last; ties by the key as text."""
    return F.struct(F.coalesce(t, F.lit((1 << 62))).alias("t"), key.cast("string").alias("s"))


def _posts(rows: DataFrame, width: int | None) -> DataFrame:
    """``place, t, key, block`` of each key of the rows; blocks of time are as wide as the window."""
    block = F.lit(0).cast("long") if width is None else F.floor(F.col("t") / width)
    return rows.select("place", "t", block.alias("block"), F.explode("keys").alias("key"))


def _near_heads(rows: DataFrame, heads: DataFrame, width: int | None) -> DataFrame:
    """``place, head``: the heads before each row that it shares a key with, less than ``width`` microseconds away.

    Heads of one key are that far apart, so a row meets two at most by each of its keys.
    """
    posts = _posts(heads, width)
    if width is None:  # the first of a key is before a row if any is
        ahead = posts.groupBy("key", "block").agg(F.min("place").alias("head"), F.min("t").alias("ht"))
    else:
        ahead = posts.select("key", F.explode(F.array("block", F.col("block") + 1)).alias("block"), F.col("place").alias("head"), F.col("t").alias("ht"))
    close = F.lit(True) if width is None else F.col("t") - F.col("ht") < width
    return _posts(rows, width).join(ahead, ["key", "block"]).where((F.col("head") < F.col("place")) & close).select("place", "head")


def _waiting(rows: DataFrame, width: int | None) -> DataFrame:
    """``place`` of the rows that have another before them that shares a key, less than ``width`` microseconds away: of each key the last one before tells."""
    posts = rows.select("place", "t", F.explode("keys").alias("key"))
    last = F.lag("t").over(W.partitionBy("key").orderBy("place"))
    waits = last.isNotNull() if width is None else F.col("t") - last < width
    return posts.select("place", waits.alias("waits")).where("waits").select("place").distinct()


def greedy_heads(nodes: DataFrame, posts: DataFrame, width: int | None) -> DataFrame:
    """``id, ord, status, head``: each row in the order of ``ord`` joins the first head that it shares a key with, or is one itself.

    ``nodes``: ``id, ord, status, head``, ``status`` 1 for rows that are heads
    beforehand and 0 for others; ``posts``: ``id, key``. Pairs are never formed:
    rows meet in the posting list of a key. A row with any head before it can't
    be one and keeps nobody waiting, whichever its first head will be; first
    heads are looked up at the end, when all heads are known.
    """
    # places are ids that rise along the order, as the parts of a sort do
    placed = cut(nodes.orderBy("ord").withColumn("place", F.monotonically_increasing_id()))
    shared = cut(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.monotonically_increasing_id().alias("number")))
    listed = posts.join(shared, "key").groupBy("id").agg(F.collect_list("number").alias("keys")).withColumnRenamed("id", "__id")
    rows = cut(placed.join(listed, F.col("id") == F.col("__id"), "left").select(
        "place", F.col("ord.t").alias("t"), "status", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys")))
    live, new = rows.where("status = 0"), rows.where("status = 1")
    heads = [new]
    while live.limit(1).count():
        if new.limit(1).count():
            live = cut(live.join(_near_heads(live, new, width).select("place").distinct(), "place", "left_anti"))
        waiting = _waiting(live, width).withColumnRenamed("place", "__place")
        told = cut(live.join(waiting, F.col("place") == F.col("__place"), "left").select("place", "t", F.when(F.col("__place").isNull(), 1).otherwise(0).alias("status"), "keys"))
        live, new = told.where("status = 0"), told.where("status = 1")
        heads.append(new)
    all_ = cut(reduce(DataFrame.unionByName, heads).select("place", "t", "keys"))
    others = rows.where("status = 0").join(all_, "place", "left_anti")
    first = _near_heads(others, all_, width).groupBy("place").agg(F.min("head").alias("near"))
    joins = first.join(placed.select(F.col("place").alias("near"), F.col("ord").alias("__head")), "near").select(F.col("place").alias("__place"), "__head")
    joined = placed.join(joins, F.col("place") == F.col("__place"), "left")
    found = F.when(F.col("status") != 0, F.col("head")).otherwise(F.coalesce("__head", "ord"))
    return cut(joined.select("id", "ord", F.when((F.col("status") == 0) & F.col("__head").isNotNull(), 2).otherwise(1).alias("status"), found.alias("head")))


def phrase_heads(clusters: DataFrame, days: int = 7, least: int = 6) -> DataFrame:
    """``id, merged``: clusters merged with the first one before whose anchor is near in time, has the same actor and action and shares a run of ``least`` characters.

    ``clusters``: ``id, ts, title, actor, action`` of their anchors; blanks in
    titles don't count. Anchors without a time come last and are near to all.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    bare = F.regexp_replace(F.coalesce("title", F.lit("")), "\\s+", "")
    n = F.length(bare) - least + 1
    grams = F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(bare, i, F.lit(least)))))
    rows = cut(clusters.select("id", _order(t, F.col("id")).alias("ord"), "ts", F.struct(F.coalesce("actor", F.lit("")).alias("actor"), F.coalesce("action", F.lit("")).alias("action")).alias("same"), grams.alias("grams")))
    posts = rows.select("id", "ts", F.explode("grams").alias("gram"), "same").select("id", "ts", F.struct("same", "gram").alias("key"))
    nodes = rows.select("id", "ts", "ord", F.lit(0).alias("status"), F.lit(None).cast(rows.schema["ord"].dataType).alias("head"))
    dated = greedy_heads(nodes.where("ts is not null").drop("ts"), posts.where("ts is not null").drop("ts"), (days + 1) * DAY)
    late = nodes.where("ts is null").drop("ts")
    if late.limit(1).count():
        everyone = greedy_heads(late.unionByName(dated.where("status = 1")), posts.drop("ts").join(dated.where("status = 2").select("id"), "id", "left_anti"), None)
        dated = everyone.unionByName(dated.where("status = 2"))
    ids = dated.select(F.col("ord").alias("__ord"), F.col("id").alias("merged"))
    return dated.join(ids, F.col("head") == F.col("__ord")).select("id", "merged")


def layered_clusters(articles: DataFrame, days: int = 7, least: int = 6) -> DataFrame:
    """``id, cluster, layer, merged``: candidate clusters in layers; ``cluster`` is the id of the anchor, the earliest article.

    ``articles``: ``id, url, title, actor, action, issue, ts``. The first row of a
    URL stays (blank URLs all stay). Rows with an action are grouped by actor,
    action and issue, and split into chained date buckets (layer ``dates``); the
    others by title, letters and digits only, 50 at most (``title``, or
    ``single``). At last clusters that share a phrase are merged (``merged``).
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = dedup.first_wins(articles, F.col("url"), "id").where("not is_duplicate").select(
        "id", "ts", "title", blank("actor").alias("actor"), blank("action").alias("action"), blank("issue").alias("issue"))
    acts = date_islands(rows.where("action <> ''"), ["actor", "action", "issue"], "ts", days).withColumn("group", F.struct("actor", "action", "issue", "bucket", F.lit("").alias("name")))
    name = F.substring(F.regexp_replace(blank("title"), "[^\\p{L}\\p{N}_]", ""), 1, 50)
    said = rows.where("action = ''").withColumn("bucket", F.lit(0).cast("long")).withColumn("group", F.struct(F.lit("").alias("actor"), F.lit("").alias("action"), F.lit("").alias("issue"), "bucket", name.alias("name")))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    all_ = cut(acts.unionByName(said).withColumn("ord", _order(t, F.col("id"))))
    anchors = all_.groupBy("group").agg(F.min_by(F.struct("id", "ts", "title", "actor", "action"), "ord").alias("a"), F.count("*").alias("n"))
    merged = phrase_heads(anchors.select("a.*"), days, least).withColumnsRenamed({"id": "__cluster"})
    layer = F.when(F.col("action") != "", "dates").when(F.col("n") > 1, "title").otherwise("single")
    placed = all_.select("id", "action", "group").join(anchors.select("group", F.col("a.id").alias("cluster"), "n"), "group")
    found = placed.join(merged, F.col("cluster") == F.col("__cluster"))
    return found.select("id", F.col("merged").alias("cluster"), layer.alias("layer"), (F.col("merged") != F.col("cluster")).alias("merged"))


def greedy_cliques(df: DataFrame, key: str, seq: str, edges: DataFrame) -> DataFrame:
    """``key, cluster``: cliques in the order of ``seq`` (ties: ``key``); a row joins the first cluster all of whose members it matches.

    A cluster is named by its first member. The first undecided row within two
    edges opens a cluster and takes, in order, those of its neighbours that match
    all taken before; clusters of one round can't touch, and a row meets only its
    neighbours, never its component. Edges are ``a, b`` in either direction.
    """
    pairs = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x is not null and y is not null and x <> y")
    rows = df.select(F.col(key).alias("id"), F.struct(F.col(seq).alias("seq"), F.col(key).alias("key")).alias("ord"))
    order = lambda end: rows.withColumnsRenamed({"id": end, "ord": f"o{end}"})
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().join(order("x"), "x").join(order("y"), "y")
    links, done = cut(both), []
    while links.limit(1).count():
        own = links.groupBy("x").agg(F.min("ox").alias("ox"), F.min("oy").alias("oy")).select("x", "ox", F.least("ox", "oy").alias("low"))
        lows = own.select(F.col("x").alias("y"), F.col("low").alias("far"))
        two = links.select("x", "ox", "y").join(lows, "y").groupBy("x").agg(F.min("ox").alias("ox"), F.min("far").alias("far"))
        heads = cut(two.where("ox <= far").select("x"))
        near = links.join(heads.withColumnRenamed("x", "head"), F.col("x") == F.col("head")).select("head", "y", "oy")
        mine = near.select(F.col("head").alias("hz"), F.col("y").alias("z"))
        inner = links.select(F.col("x").alias("y"), F.col("y").alias("z")).join(near.select("head", "y"), "y").join(mine, "z").where("head = hz").groupBy("head", "y").agg(F.collect_set("z").alias("near"))
        empty = F.array().cast(inner.schema["near"].dataType)
        groups = near.join(inner, ["head", "y"], "left").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("oy", "y", F.coalesce("near", empty).alias("near")))).alias("rows"))
        taken = F.aggregate("rows", empty, lambda acc, r: F.when(F.size(F.array_except(acc, r["near"])) == 0, F.array_append(acc, r["y"])).otherwise(acc))
        clusters = groups.select("head", F.explode(F.array_append(taken, F.col("head"))).alias("id"))
        found = cut(clusters.select("id", F.col("head").alias("cluster")))
        done.append(found)
        gone = found.select("id")
        links = cut(links.join(gone, F.col("x") == gone["id"], "left_anti").join(gone, F.col("y") == gone["id"], "left_anti"))
    placed = rows.select("id", F.lit(None).cast(rows.schema["id"].dataType).alias("cluster")).limit(0)
    for found in done:
        placed = placed.unionByName(found)
    named = placed.withColumnsRenamed({"id": "__id", "cluster": "__cluster"})
    return df.select(key).join(named, F.col(key) == F.col("__id"), "left").select(key, F.coalesce("__cluster", F.col(key)).alias("cluster"))


def same_event_edges(articles: DataFrame, hours: int = 24, percent: int = 55, features: int = 2) -> DataFrame:
    """Pairs ``a, b`` (in order of id) of articles that report the same event.

    ``articles``: ``id, ts, url`` (canonical, blank if none), and the sets
    ``tokens``, ``entities``, ``groups``, ``places`` (entities that exclude each
    other) and ``core`` (tokens that count). Equal URLs match. Otherwise times
    are at most ``hours`` apart, an entity and a group are shared, places don't
    conflict, the Jaccard similarity of tokens is ``percent`` / 100 or more, and
    shared core tokens and groups are ``features`` or more. Candidates share an
    entity, a group, a token of their prefixes by rarity, and a stretch of time.
    """
    width = hours * 3_600_000_000
    rows = articles.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.coalesce("url", F.lit("")).alias("url"), *[F.array_distinct(c).alias(c) for c in ("tokens", "entities", "groups", "places", "core")])
    each = rows.select("id", F.explode("tokens").alias("token"))
    ranked = each.join(each.groupBy("token").agg(F.count("*").alias("df")), "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s"))
    n = F.size("s")
    head = ranked.select("id", F.transform(F.slice("s", 1, (n - F.ceil(n * percent / 100) + 1).cast("int")), lambda x: x["token"]).alias("prefix"))
    keyed = rows.where("t is not null").join(head, "id").select("id", "t", F.explode("entities").alias("entity"), "groups", "prefix").select("id", "t", "entity", F.explode("groups").alias("group"), "prefix")
    keyed = keyed.select("id", "t", "entity", "group", F.explode("prefix").alias("token")).withColumn("block", F.floor(F.col("t") / width))
    keys = ["entity", "group", "token", "block"]
    left = keyed.withColumnsRenamed({"id": "a", "t": "ta"})
    right = keyed.withColumnsRenamed({"id": "b", "t": "tb"}).withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    pairs = left.join(right, keys).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= width)).select("a", "b").distinct()
    one = rows.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("tokens", "groups", "places", "core")])
    two = rows.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("tokens", "groups", "places", "core")])
    common = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - common("tokens")
    conflict = (F.size("places_a") > 0) & (F.size("places_b") > 0) & ~((common("places") == F.size("places_a")) & (common("places") == F.size("places_b")))
    alike = pairs.join(one, "a").join(two, "b").where((100 * common("tokens") >= percent * union) & ~conflict & (common("core") + common("groups") >= features)).select("a", "b")
    urls = rows.where("url <> ''").select("url", "id")
    same = urls.withColumnRenamed("id", "a").join(urls.withColumnRenamed("id", "b"), "url").where("a < b").select("a", "b")
    return alike.unionByName(same).distinct()


def events_of(articles: DataFrame, clusters: DataFrame, version: str) -> DataFrame:
    """``cluster, event_id, canonical, n, first_ts, last_ts`` of each cluster.

    ``articles`` as in ``same_event_edges``, with ``priority`` (of the source, low
    first), ``seq`` and ``names`` (identity tokens of the title). The id hashes
    the version, the UTC day of the first article (or ``time-unknown``), the URL
    of a single article, sorted entities and groups, and the tokens that all
    members share, or else the canonical URL. The canonical article is the
    earliest, then the one of the best source, then the first.
    """
    rows = articles.join(clusters.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).drop("__id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    best = F.min_by(F.struct("id", "url"), F.struct(F.coalesce(t, F.lit(1 << 62)), "priority", "seq"))
    base = rows.groupBy("cluster").agg(best.alias("best"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    listed = lambda c: rows.select("cluster", F.explode(c).alias("v")).distinct().groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias(f"__{c}"))
    counted = rows.select("cluster", F.explode(F.array_distinct("names")).alias("v")).groupBy("cluster", "v").agg(F.count("*").alias("k"))
    shared = counted.join(base.select("cluster", "n"), "cluster").where("k = n").groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("__names"))
    full = base.join(listed("entities"), "cluster", "left").join(listed("groups"), "cluster", "left").join(shared, "cluster", "left")
    url = F.coalesce("best.url", F.lit(""))
    named = F.coalesce("__names", F.when(url != "", url), F.lit("content-unknown"))
    day = F.date_from_unix_date(F.floor(F.unix_micros(F.col("first_ts").cast("timestamp")) / DAY).cast("int"))
    text = F.concat_ws(
        "\x1f", F.lit(version), F.coalesce(day.cast("string"), F.lit("time-unknown")), F.concat(F.lit("canonical="), F.when(F.col("n") == 1, url).otherwise("")),
        F.concat(F.lit("entities="), F.coalesce("__entities", F.lit(""))), F.concat(F.lit("groups="), F.coalesce("__groups", F.lit(""))), F.concat(F.lit("tokens="), named))
    return full.select("cluster", F.concat(F.lit("evt_"), F.sha2(text, 256)).alias("event_id"), F.col("best.id").alias("canonical"), "n", "first_ts", "last_ts")


def relationship(actor_a: Column, actor_b: Column, ts_a: Column, ts_b: Column, action_a: Column, action_b: Column, answers: Column, days: int = 7) -> Column:
    """How two clusters, by their anchors, belong together: ``relation`` and its ``reason``.

    ``answers``: one of them holds an allegation and the other a statement. A
    missing time is near to none; a missing actor is nobody's.
    """
    close = F.coalesce(F.abs(F.floor((F.unix_micros(ts_a.cast("timestamp")) - F.unix_micros(ts_b.cast("timestamp"))) / DAY)) <= days, F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit(""))
    same = (blank(actor_a) != "") & (blank(actor_a) == blank(actor_b))
    other = (blank(action_a) != "") & (blank(action_b) != "") & (blank(action_a) != blank(action_b))
    pair = lambda relation, reason: F.struct(F.lit(relation).alias("relation"), F.lit(reason).alias("reason"))
    return (
        F.when(same & close & other, pair("possible_subevent", "same_actor_close_date_different_action")).when(same & close, pair("related_event", "same_actor_close_date"))
        .when(close & F.coalesce(answers, F.lit(False)), pair("related_event", "allegation_response_close_date")).when(~close, pair("separate_event", "date_window_exceeded"))
        .otherwise(pair("separate_event", "different_primary_actor"))
    )


def candidate_ids(articles: DataFrame, clusters: DataFrame, marker: str = "news", prefix: str = "cand", length: int = 10) -> DataFrame:
    """``cluster, anchor, candidate_id``: ids that depend on a cluster's anchor only: the marker, its id, its URL and its day.

    The anchor is the earliest member, those without a time last, ties by the id
    as text. ``articles``: ``id, url, ts``; ``clusters``: ``id, cluster``.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.coalesce(F.date_from_unix_date(F.floor(t / DAY).cast("int")).cast("string"), F.lit(""))
    rows = articles.select("id", F.coalesce("url", F.lit("")).alias("url"), day.alias("day"), _order(t, F.col("id")).alias("ord")).join(clusters.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"))
    anchors = rows.groupBy("cluster").agg(F.min_by(F.struct("id", "url", "day"), "ord").alias("a"))
    key = F.concat_ws("|", F.lit(marker), F.col("a.id").cast("string"), "a.url", "a.day")
    return anchors.select("cluster", F.col("a.id").alias("anchor"), F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(key, 256), 1, length)).alias("candidate_id"))
