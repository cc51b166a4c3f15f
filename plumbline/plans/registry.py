"""Queries by name, with the SQL that says the same, and the SQL of what many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import lexicon as lx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(rows: list) -> str:
    """A list of rows for a VALUES clause; None is NULL."""

    def one(x) -> str:
        if x is None:
            return "null"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(one, x)) + "]"
        return repr(x).lower() if isinstance(x, bool) else repr(x)

    return ", ".join("(" + ", ".join(map(one, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


CONTENT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
TITLE = f"case when trim(split_part({CONTENT}, '.', 1)) <> '' then substr(trim(split_part({CONTENT}, '.', 1)), 1, 160) else substr({CONTENT}, 1, 160) end"
SOURCE_ID = "cast(regexp_extract(source, '(\\d+)$', 1) as int)"
RAW = f"raw as (select doc_id as news_raw_id, {SOURCE_ID} as source_id, source, {TITLE} as title_raw, {CONTENT} as content_raw, 'https://' || source || '.example/' || doc_id as original_url, timestamp '2024-01-01' + to_minutes(doc_id) as published_at from documents)"
_CLEAN = "title_raw || chr(10) || content_raw"
for _p in ("<[^>]+>", "https?://\\S+|www\\.\\S+", "[@#][\\p{L}\\p{N}_]+", "[^\\p{L}\\p{N}_\\s.,;:!?-]", "\\s+"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', ' ', 'g')"
CLEANED = f"cleaned as (select *, trim({_CLEAN}) as clean_text from raw)"


def _count(markers: list[str]) -> str:
    return " + ".join(f"cast(contains(' ' || lower(clean_text) || ' ', '{m}') as int)" for m in markers)


PROCESSED = f"""processed as (select *, case when {_count(lx.SPANISH_MARKERS)} >= 2 then 'es' when {_count(lx.ENGLISH_MARKERS)} >= 2 then 'en' when trim(clean_text) <> '' then 'unknown' else 'empty' end as language,
    len(list_filter(string_split(clean_text, ' '), lambda x: x <> '')) as token_count from cleaned)"""
BASE = f"with {RAW}, {CLEANED}, {PROCESSED}"
NEWS = "news as (select doc_id as news_id, source, cast(regexp_extract(source, '(\\d+)$', 1) as int) as source_id, case when doc_id % 11 <> 0 then timestamp '2024-01-01' + to_minutes(doc_id) end as published_at, round(((doc_id * 7919) % 10000) / 10000.0, 4) as fake_score from documents)"

_STOP = ", ".join(f"'{w}'" for w in lx.STOPWORDS)


def token_list(text: str) -> str:
    """A text's cluster tokens, repeats included."""
    normal = f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')"
    normal = f"regexp_replace(lower(regexp_replace(regexp_replace({normal}, '([A-Za-z0-9_])-([A-Za-z0-9_])', '\\1\\2', 'g'), '([A-Za-z0-9_])-([A-Za-z0-9_])', '\\1\\2', 'g')), '[^a-z0-9_\\s]', ' ', 'g')"
    return f"list_filter(string_split(trim(regexp_replace({normal}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ({_STOP}) and (length(w) > 2 or regexp_matches(w, '[0-9]')))"


def isoformat(x: str) -> str:
    return f"case when epoch_us({x}) % 1000000 = 0 then strftime({x}, '%Y-%m-%dT%H:%M:%S') else strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') end"


# --- same-story clusters -----------------------------------------------------------------------------
SETS = "ok as (select news_raw_id as id, title_raw, clean_text from processed where token_count >= 50)"
# every pair that shares a token; similarities below the threshold are needed for the representatives
SIMS = f"""{BASE}, {SETS},
    bw as (select id, w, row_number() over (partition by id order by i) as pos from (select id, w, min(i) as i from (select id, unnest(l) as w, generate_subscripts(l, 1) as i from (select id, {token_list("clean_text")} as l from ok)) group by id, w)),
    tw as (select id, unnest(list_distinct(x)) as w from (select id, {token_list("title_raw")} as x from ok)),
    nb as (select id, count(*) as n, count(*) filter (pos <= 120) as l from bw group by id), nt as (select id, count(*) as n from tw group by id),
    pb as (select a.id as a, b.id as b, count(*) as o, count(*) filter (a.pos <= 120 and b.pos <= 120) as l from bw a join bw b on a.w = b.w and a.id < b.id group by 1, 2),
    pt as (select a.id as a, b.id as b, count(*) as t from tw a join tw b on a.w = b.w and a.id < b.id group by 1, 2),
    parts as (select coalesce(pb.a, pt.a) as a, coalesce(pb.b, pt.b) as b, coalesce(o, 0) as o, coalesce(l, 0) as l, coalesce(t, 0) as t from pb full join pt on pb.a = pt.a and pb.b = pt.b),
    shares as (select p.a, p.b, case when p.o = 0 then 0 else p.o / (x.n + y.n - p.o) end as body, case when p.l = 0 then 0 else p.l / (x.l + y.l - p.l) end as lead, case when p.t = 0 then 0 else p.t / least(u.n, v.n) end as title
        from parts p join nb x on x.id = p.a join nb y on y.id = p.b left join nt u on u.id = p.a left join nt v on v.id = p.b),
    sims as (select a, b, round_even(greatest(body, case when title >= 0.35::double then 0.65::double * title + (1 - 0.65::double) * greatest(lead, body) else greatest(lead, body) end), 4) as sim from shares)"""
NEAR = f"""{SIMS}, near as (select a, b, sim from sims where sim >= 0.40::double)"""
_RECURSIVE = NEAR.replace("with raw", "with recursive raw", 1)


def _walk(k: str, which: str) -> str:
    """One article after the other: it founds a cluster unless an earlier founder is near."""
    return f"""places{k} as (select id, row_number() over (order by id) as r from ok where {which.format(c="id")}),
    earlier{k} as (select p.r, p.id, coalesce((select list(n.a) from near n where n.b = p.id and {which.format(c="n.a")}), []) as n from places{k} p),
    walk{k} as (select 0::bigint as r, []::bigint[] as f union all select e.r, case when list_has_any(f, e.n) then f else list_append(f, e.id) end from walk{k} join earlier{k} e on e.r = walk{k}.r + 1),
    founders{k} as (select unnest(f) as id from (select f from walk{k} order by r desc limit 1))"""


def _joined(k: str, which: str) -> str:
    return f"""clusters{k} as (select id, id as leader, 1.0::double as sim from founders{k} union all
        select n.b, arg_max(n.a, (n.sim, -n.a)), max(n.sim) from near n join founders{k} f on f.id = n.a where {which.format(c="n.b")} and n.b not in (select id from founders{k}) group by n.b)"""


FOUND = f"{_RECURSIVE}, {_walk('', '{c} >= 0')}, {_joined('', '{c} >= 0')}"
def mean4(s: str, n: str) -> str:
    """A mean of four-place numbers given by their sum in ten-thousandths, to four places, halves to even."""
    return f"({s} // {n} + case when 2 * ({s} % {n}) > {n} or (2 * ({s} % {n}) = {n} and ({s} // {n}) % 2 = 1) then 1 else 0 end) / 10000.0"


_SUM = "sum(cast(round(coalesce(s.sim, 0) * 10000) as bigint))"


def means(clusters: str) -> str:
    return f"""pairs as (select x.leader, x.id, y.id as peer from {clusters} x join {clusters} y on x.leader = y.leader and x.id <> y.id),
    means as (select p.leader, p.id, {mean4(_SUM, "count(*)")} as mean from pairs p left join sims s on s.a = least(p.id, p.peer) and s.b = greatest(p.id, p.peer) group by 1, 2),
    members as (select c.leader, c.id, coalesce(m.mean, 1.0) as mean from {clusters} c left join means m on m.leader = c.leader and m.id = c.id)"""


MEANS = means("clusters")
# clusters of the articles whose id three doesn't divide are known; the others come
GROWN = f"""{_RECURSIVE}, {_walk('1', '{c} % 3 <> 0')}, {_joined('1', '{c} % 3 <> 0')},
    both_ways as (select a, b, sim from near union all select b, a, sim from near), seeds as (select n.b as id, f.id as seed, n.sim from both_ways n join founders1 f on f.id = n.a where n.b % 3 = 0),
    places2 as (select id, row_number() over (order by id) as r, id in (select id from seeds) as known from ok where id % 3 = 0),
    earlier2 as (select p.r, p.id, p.known, coalesce((select list(n.a) from near n where n.b = p.id and n.a % 3 = 0), []) as n from places2 p),
    walk2 as (select 0::bigint as r, []::bigint[] as f union all select e.r, case when e.known or list_has_any(f, e.n) then f else list_append(f, e.id) end from walk2 join earlier2 e on e.r = walk2.r + 1),
    founders2 as (select id, (select max(id) from founders1) + row_number() over (order by id) as cluster_id from (select unnest(f) as id from (select f from walk2 order by r desc limit 1))),
    choices as (select id, seed as cluster_id, sim, 0 as late, seed as place from seeds union all select n.b, f.cluster_id, n.sim, 1, f.id from near n join founders2 f on f.id = n.a where n.b % 3 = 0 and n.b not in (select id from founders2)),
    every as (select id, leader as cluster_id from clusters1 union all select id, cluster_id from founders2 union all select id, arg_max(cluster_id, (sim, -late, -place)) from choices group by id)"""
