"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import string

from furlong.llm import quality_rules as Q

EXACT_DEDUP = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""

WORD = r"[^\x20\x09-\x0D]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(of: str, chars: str) -> str:
    return f"length({of}) - length(regexp_replace({of}, '[{chars}]', '', 'g'))"


_CHARS = "cast(coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0) as bigint)"

QUALITY_RULES = f"""
with d as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), parts as (
    select *, regexp_extract_all(text, '{WORD}+') as words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines
    from d
), judged as (
    select *, list_filter(lines, lambda x:
               100 * ({_count("x", Q.SYMBOLS + "!{}")}) <= 8 * length(x)
               and {_count("x", Q.SEPARATORS)} < {Q.MENU}
               and regexp_matches(x, {_quoted(Q.SENTENCE_END)})
               and not (length(x) <= 120 and regexp_matches(x, {_quoted(Q.FURNITURE)}))) as good
    from parts
), placed as (
    select r, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from parts
), eight as (
    select r, i, lead(word, 7) over o as last,
           concat_ws(' ', word, {", ".join(f"lead(word, {k}) over o" for k in range(1, Q.WINDOW))}) as words
    from placed window o as (partition by r order by i)
), counted as (
    select r, i, count(*) over (partition by r, words) as n from eight where last is not null
), covered as (
    select r, least({Q.WINDOW}, coalesce(lead(i) over (partition by r order by i) - i, {Q.WINDOW})) as n from counted where n > 1
), repeated as (
    select r, sum(n) as n from covered group by r
), stats as (
    select doc_id, len(words) as n_words, {_CHARS.format("words")} as word_chars,
           {_count("text", Q.SYMBOLS)} as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
           cast(coalesce(n, 0) as bigint) as n_repeat_words, len(lines) as n_lines, len(good) as n_good_lines,
           {_CHARS.format("lines")} as line_chars, {_CHARS.format("good")} as good_chars
    from judged left join repeated using (r)
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * good_chars >= 50 * line_chars as kept
from stats
"""

#: All pairs that share a shingle are counted, without bands or sketches.
NEAR_DEDUP = f"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}+') as words
    from documents
), placed as (
    select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i, len(words) as n_words from d
), pairs as (
    select doc_id, n_words, word, lead(word) over (partition by doc_id order by i) as next from placed
), shingles as (
    select distinct doc_id, concat_ws(' ', word, next) as shingle from pairs where next is not null or n_words = 1
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), edges as (
    select a, b from links union all select b, a from links
), reach(doc_id, other) as (
    select a, b from edges union select reach.doc_id, edges.b from reach join edges on other = a
), least_one as (
    select doc_id, min(other) as other from reach group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) as component_id,
       d.doc_id <= coalesce(other, d.doc_id) as kept
from d left join sizes on sizes.doc_id = d.doc_id left join least_one on least_one.doc_id = d.doc_id
"""


SUBSTRING_DEDUP = f"""
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}+') as words from documents
), placed as (
    select r, doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from d
), windows as (
    select r, doc_id, word, i, case when lead(word, 12) over o is not null then
           concat_ws(' ', word, {", ".join(f"lead(word, {k}) over o" for k in range(1, 13))}) end as words
    from placed window o as (partition by r order by i)
), judged as (
    select r, i, word, words is not null and min(doc_id) over (partition by words) < doc_id as later from windows
), covered as (
    select r, i, word, coalesce(max(case when later then i end) over (partition by r order by i rows between 12 preceding and current row), -99) >= i - 12 as gone
    from judged
), kept as (
    select r, count_if(gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as text from covered group by r
)
select doc_id, len(words) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (r)
"""


def _clusters(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    near = """assigned{0} as materialized (
    select r, vec_id, q, cast(least_one % {k} as int) as cluster, cast(least_one // {k} as bigint) as distance from (
        select r, vec_id, v.q, min(cast(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as hugeint) * {k} + c.n) as least_one
        from v cross join centroids{0} c group by r, vec_id, v.q)
)"""
    moved = """centroids{1} as materialized (
    select n, coalesce(m.q, c.q) as q from centroids{0} c left join (
        select cluster, list(cast((total - ((total % held) + held) % held) // held as bigint) order by i) as q from (
            select cluster, i, sum(x) as total, count(*) as held
            from (select cluster, unnest(q) as x, unnest(range(1, {dim} + 1)) as i from assigned{0}) group by cluster, i) group by cluster
    ) m on m.cluster = c.n
)"""
    steps = [near.format(0, k=k)]
    for i in range(rounds):
        steps += [moved.format(i, i + 1, dim=dim), near.format(i + 1, k=k)]
    return f"""
with v as materialized (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}
), centroids0 as materialized (
    select n, q from (select row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), q) - 1 as n, q from v) where n < {k}
), {", ".join(steps)}
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from assigned{rounds} join centroids{rounds} c on c.n = cluster
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY_RULES, "op7_minhash_near_dedup": NEAR_DEDUP, "op9_exact_dedup": EXACT_DEDUP,
        "op11_substring_dedup": SUBSTRING_DEDUP, "op12_centroid_clustering": _clusters(),
    }
