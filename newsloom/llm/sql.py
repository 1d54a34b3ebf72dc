"""DuckDB statements with the same rows as the llm queries, where SQL can express them."""

from __future__ import annotations

from newsloom.llm.chat import END, START
from newsloom.llm.licenses import COPYRIGHT, KNOWN, MARKS, SPELLINGS
from newsloom.llm.queries import HARD_TURN
from newsloom.llm.quality_rules import RULES, STOP_WORDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_rules_sql(source: str = "documents", columns: str | None = None) -> str:
    """Base counts and the verdict; ``columns``: what to return instead of the query's columns."""
    stop = ", ".join(_text(w) for w in STOP_WORDS)
    rules = " or ".join(
        f"{r.measure} {op} {bound}" for r in RULES for op, bound in (("<", r.least), (">", r.most)) if bound is not None
    )
    return f"""
with q_w as (
  select row_number() over () as q_row, *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from {source}
), q_win as (
  select q_row, unnest(win) as win, generate_subscripts(win, 1) as pos
  from (select q_row, list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) as win from q_w where len(ws) >= 8)
), q_rep as (
  select q_row, count(distinct place) as n
  from (select q_row, unnest(range(pos, pos + 8)) as place from (select *, count(*) over (partition by q_row, win) as c from q_win) where c > 1)
  group by q_row
), q_adj as (
  select q_row, count(*) filter (where same) as n
  from (select q_row, unnest(list_transform(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as same from q_w) group by q_row
), q_m as (
  select q_w.*, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(q_rep.n, 0)::bigint as n_repeat_words,
    length(array_to_string(ws, '')) / greatest(len(ws), 1) as mean_word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) / greatest(len(ws), 1) as symbols_per_word,
    length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) / greatest(len(ws), 1) as shouts_per_word,
    len(list_filter(ws, lambda w: lower(w) in ({stop}))) / greatest(len(ws), 1) as stop_share,
    (len(ls) - len(list_distinct(ls))) / greatest(len(ls), 1) as dup_line_share,
    coalesce(q_adj.n, 0) / greatest(len(ws), 1) as adjacent_repeat_share
  from q_w left join q_rep using (q_row) left join q_adj using (q_row)
), q_v as (
  select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed, ({rules}) as rule_failed from q_m
)
select {columns or "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and not rule_failed) as kept"}
from q_v"""


def chat_sql() -> str:
    hard = ", ".join(f"(-1, {i}, '{role}', {_text(HARD_TURN)})" for i, role in enumerate(("user", "assistant")))
    frame = len(START) + 1 + len(END)
    return f"""
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(body)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(body, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum({frame} + length(role) + length(body) + len(regexp_extract_all(body, '<\\\\*\\|')))::bigint as formatted_chars
from (
  select conv_id, turn, role, coalesce(text, '') as body from conversations
  union all select * from (values {hard}) as hard(conv_id, turn, role, body)
) group by conv_id"""


def _canonical(column: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({column}), '{COPYRIGHT}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def license_sql() -> str:
    known = ", ".join(f"({_text(name)}, {_text(body)})" for name, body in KNOWN)
    marks = " or ".join(f"contains(lower(line), '{m}')" for m in MARKS)
    return f"""
with names as (
  select sha256({_canonical('body')}) as digest, min(license) as license from (values {known}) as k(license, body) group by 1
), found as (
  select doc_id, string_agg(distinct license, '|' order by license) as notices
  from (select doc_id, sha256({_canonical('line')}) as digest from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where {marks})
  join names using (digest) group by doc_id
)
select d.doc_id, d.digest, names.license, coalesce(found.notices, '') as notices
from (select doc_id, sha256({_canonical("coalesce(text, '')")}) as digest from documents) d
left join names using (digest) left join found using (doc_id)"""


def centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round written out: all distances, then floors of exact means."""
    assign = """a{i} as (
  select r, arg_min(n, (d, n)) as n, min(d) as d from (
    select x.r, c.n, sum((x.v - c.v) * (x.v - c.v))::bigint as d from x join c{i} c using (dim) group by x.r, c.n
  ) group by r)"""
    update = """c{j} as (
  select c.n, c.dim, coalesce(m.v, c.v) as v from c{i} c left join (
    select a.n, x.dim, floor(sum(x.v)::double / count(*))::bigint as v from x join a{i} a using (r) group by a.n, x.dim
  ) m using (n, dim))"""
    steps = ", ".join([t for i in range(rounds) for t in (assign.format(i=i), update.format(i=i, j=i + 1))] + [assign.format(i=rounds)])
    return f"""
with kept as (
  select row_number() over () as r, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0
), x as (
  select r, generate_subscripts(embedding, 1) as dim, floor(256 * unnest(embedding)::double)::bigint as v from kept
), seeds as (
  select r, row_number() over (order by sha256('2:' || vec_id)) - 1 as n from kept qualify n < {k}
), c0 as (
  select n, dim, v from x join seeds using (r)
), {steps}, s as (
  select n, sum(d)::bigint as cluster_inertia from a{rounds} group by n
), h as (
  select n, sha256(string_agg(v::varchar, ',' order by dim)) as centroid_sha256 from c{rounds} group by n
)
select vec_id, n::int as cluster, d as distance, cluster_inertia, (select sum(d)::bigint from a{rounds}) as inertia, centroid_sha256
from a{rounds} join kept using (r) join s using (n) join h using (n)"""


def audit_sql() -> str:
    return """
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), firsts as (
  select body, min(doc_id) as least from w group by body
), m as (
  select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body), 'D': regexp_matches(body, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} as f
  from w join firsts using (body) left join (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by 1) using (doc_id)
), h as (
  select part, f.A::int + 2 * f.B::int + 4 * f.C::int + 8 * f.D::int + 16 * f.E::int as mask, count(*) as n, sum(good) as good, sum(bad) as bad from m group by all
), l as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as l(x, b)
), o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from l a, l b, l c, l d, l e where a.b + b.b + c.b + d.b + e.b = 31 and len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
), s as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, range(1, 6) as r(step)
), t as (
  select part, filter_order, step, bit, coalesce(sum(n) filter (where mask & (before + bit) = 0), 0)::bigint as kept, coalesce(sum(n) filter (where mask & before = 0 and mask & bit > 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where mask & before > 0 and mask & bit > 0), 0)::bigint as redundant, coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where mask & before = 0 and mask & bit > 0), 0)::bigint as good_lost, coalesce(sum(bad) filter (where mask & before = 0 and mask & bit > 0), 0)::bigint as toxic_lost
  from h, s group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from t"""


ORACLE = {
    "op2_quality_rules": quality_rules_sql(),
    "op8_chat_format": chat_sql(),
    "op9_license_scan": license_sql(),
    "op12_centroid_clusters": centroid_sql(),
    "op13_filter_audit": audit_sql(),
}
