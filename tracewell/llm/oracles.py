"""SQL for the queries of this subpackage that DuckDB can answer."""

from __future__ import annotations

import string

from tracewell.llm.rules import POLICIES, RULES, bit, mask

_SPACE = r"[\x09-\x0D ]"
_TEXTS = "texts as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents)"
_WORDS = rf"list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '')"

OP2 = """with c as (select vec_id, r, unnest(embedding) as x, unnest(range(len(embedding))) as i from (select *, row_number() over () as r from embeddings where embedding is not null)),
s as (select vec_id, r, i, cast(floor(1024 * cast(x as double)) as bigint) as x from c where r not in (select r from c where x is null or not isfinite(x))),
scores as (select q.vec_id as query_id, q.r as own, d.vec_id, cast(sum(q.x * d.x) as bigint) as score from s q join s d on q.i = d.i and q.r <> d.r where q.vec_id % 100 = 0 group by q.vec_id, q.r, d.vec_id, d.r)
select query_id, cast(row_number() over (partition by own order by score desc, vec_id) as int) as rank, vec_id, score from scores qualify rank <= 10"""

OP3 = f"""with recursive {_TEXTS}, split as (select r, {_WORDS.replace("(t,", f"(translate(t, '{string.ascii_uppercase}', '{string.ascii_lowercase}'),")} as w from texts),
words as (select r, unnest(w) as word, unnest(range(len(w))) as k, len(w) as n from split),
grams as (select r, n, k, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o as g from words window o as (partition by r order by k)),
shingles as (select distinct r, g from grams where g is not null union select r, array_to_string(w, ' ') from split where len(w) between 1 and 3),
sizes as (select texts.r, doc_id, count(g) as n from texts left join shingles on texts.r = shingles.r group by all),
shared as (select a.r as a, b.r as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.r < b.r group by all),
linked as (select x.doc_id as a, y.doc_id as b from shared join sizes x on shared.a = x.r join sizes y on shared.b = y.r where 100 * c >= 85 * (x.n + y.n - c)),
links as (select a, b from linked union select b, a from linked),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, n as n_shingles, least(doc_id, (select min(b) from reach where reach.a = doc_id)) as component_id from sizes"""

_BITS = " + ".join(f"case when {p} then {bit(r)} else 0 end" for r, p in RULES.items())
OP6 = rf"""with {_TEXTS}, split as (select doc_id, r, t, {_WORDS} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) as lines from texts),
words as (select r, unnest(w) as word, unnest(range(len(w))) as k from split),
windows as (select r, k, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o as g from words window o as (partition by r order by k)),
found as (select r, k, g is not null and count(*) over (partition by r, g) > 1 as twice from windows),
covered as (select r, twice or coalesce(lag(twice, 1) over o, false) or coalesce(lag(twice, 2) over o, false) as yes from found window o as (partition by r order by k)),
repeats as (select r, count(*) as n from covered where yes group by r),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '{_SPACE}', '', 'g')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words, len(lines) as n_lines from split left join repeats on split.r = repeats.r),
book as (select *, cast({_BITS} as bigint) as rule_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (rule_bits & {mask("base-1")}) <> 0 as base_failed, (rule_bits & {mask("base-1") | mask("strict-1")}) = 0 as kept, rule_bits from book"""

assert set(POLICIES["base-1"]) <= set(POLICIES["strict-1"])
ORACLES = {"op2_topk_search": OP2, "op3_ngram_jaccard_join": OP3, "op6_quality_rules": OP6}
