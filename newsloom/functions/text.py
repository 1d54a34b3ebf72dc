"""Text expressions: containment, tokens, similarity, cleaning, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of token sets.
STOP = ("the", "a", "an", "of", "and", "to", "in", "on", "for", "is", "at", "by", "with", "as")


def hits(text: Column, words: list[str]) -> Column:
    """Words found in the text as substrings, letter case aside, in the order given."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), F.lower(w)))


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w.lower()))
    return out


def tokens(text: Column) -> Column:
    """Lower-case ASCII tokens; dotted acronyms count as one."""
    dotless = F.regexp_replace(F.lower(text), r"\b([a-z])\.([a-z])\.", "$1$2")
    return F.regexp_extract_all(dotless, F.lit("[a-z0-9]+"), F.lit(0))


def has_phrase(text: Column, phrase: str) -> Column:
    """The phrase's tokens stand next to each other among the text's."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), F.array_join(tokens(F.lit(phrase)), " "), F.lit(" ")))


def token_set(text: Column) -> Column:
    """Distinct tokens without stop words, plural ``s`` cut off words over three letters."""
    stemmed = F.transform(tokens(text), lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    return F.array_distinct(F.filter(stemmed, lambda t: ~t.isin(*STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def bigrams(text: Column) -> Column:
    """Distinct character pairs of the text's letters and digits."""
    bare = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "")
    n = F.length(bare)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(bare, i, F.lit(2)))))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))


def clean_summary(html: Column, most: int = 150) -> Column:
    """Without tags and runs of spaces; over ``most`` characters cut after its last full sentence there, else hard."""
    bare = collapse(F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "))
    head = F.substring(bare, F.lit(1), F.lit(most))
    sentence = F.regexp_extract(head, "^(.*[.!?])", 1)
    return F.when(F.length(bare) <= most, bare).when(sentence != "", sentence).otherwise(head)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), F.lit(1), F.lit(n))


#: Classes of secrets, by pattern.
SECRETS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ip_address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("assigned_secret", r"(?i)(api[_-]?key|secret|token|password)\s*[=:]\s*[^\s]{8,}"),
    ("long_hex", r"\b[0-9a-f]{32,}\b"),
    ("private_key", r"BEGIN [A-Z ]*PRIVATE KEY"),
)


def secret_classes(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in SECRETS]))


def message_parts(text: Column, most: int = 4000, numbered: str = "{i}/{n}") -> Column:
    """A message as parts of at most ``most`` characters, broken at line ends.

    A short message is one part. Otherwise the first line heads each part, with
    the part's number; the other lines fill the parts in order, and a line too
    long for a part is cut, its link kept if that fits.
    """
    lines = F.split(text, "\n", -1)
    head = lines[0]
    room = F.greatest(F.lit(most) - F.length(head) - 60, F.lit(20))
    link_at = lambda x: F.locate("http", x)
    link = lambda x: F.substring(x, link_at(x), F.length(x))
    dots = lambda x: F.concat(F.substring(x, F.lit(1), room - 3), F.lit("..."))
    kept = lambda x: F.concat(F.substring(x, F.lit(1), room - F.length(link(x)) - 4), F.lit("..."), link(x))
    cut_line = lambda x: F.when(F.length(x) + 1 <= room, x).when(link_at(x) == 0, dots(x)).when(F.length(link(x)) < room - 10, kept(x)).otherwise(dots(link(x)))
    body = F.transform(F.slice(lines, 2, F.size(lines)), cut_line)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, line: Column) -> Column:
        full = state["open"].isNotNull() & (F.length(state["open"]) + 1 + F.length(line) + 1 > room)
        joined = F.when(state["open"].isNull(), line).otherwise(F.concat(state["open"], F.lit("\n"), line))
        return F.struct(F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"), F.when(full, line).otherwise(joined).alias("open"))

    parts = F.aggregate(body, empty, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    before, _, after = numbered.partition("{i}")
    between, _, end = after.partition("{n}")
    # bound once, so that the fold isn't repeated for each part
    named = F.flatten(F.transform(F.array(parts), lambda all_: F.transform(all_, lambda p, i: F.concat(
        head, F.lit("\n" + before), (i + 1).cast("string"), F.lit(between), F.size(all_).cast("string"), F.lit(end + "\n\n"), p))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(named)


def chinese_characters(text: Column) -> Column:
    """How many Chinese characters a text has; null as none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x{4e00}-\\x{9fff}]", ""))


def phrase_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, one hyphen or apostrophe within allowed."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"), F.lit(0)), F.lower)


def without_information(text: Column, phrases: tuple[str, ...], rest: int = 4) -> Column:
    """Whether a text says nothing once stock phrases are taken out: fewer than ``rest`` letters, digits or Chinese characters are left."""
    bare = F.coalesce(text, F.lit(""))
    for p in sorted(phrases, key=len, reverse=True):
        bare = F.replace(bare, F.lit(p), F.lit(""))
    return F.length(F.regexp_replace(bare, "[^0-9A-Za-z\\x{4e00}-\\x{9fff}]", "")) < rest


def with_terms(text: Column, terms: dict[str, str]) -> Column:
    """English terms replaced where no ASCII letter or digit touches them, longer ones first, letter case aside."""
    out = text
    for term in sorted(terms, key=len, reverse=True):
        out = F.regexp_replace(out, f"(?i)(?<![A-Za-z0-9]){term}(?![A-Za-z0-9])", terms[term])
    return out
