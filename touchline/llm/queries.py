"""Queries over the driver's tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import chat, decontaminate, html_text, language_model, lattice, mixing, ngram_join, periodic_runs, quality, substring, token_index, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.gather_turns(_table(spark, sf_dir, "conversations"))
    return chat.format_preferences(chat.reply_pairs(turns))


def op4_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_index.token_ids(_table(spark, sf_dir, "documents"), token_index.tokenizer_file())
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report_runs(_table(spark, sf_dir, "documents"))


def op12_bit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_main_text": op2_main_text,
    "op3_preference_format": op3_preference_format,
    "op4_token_index": op4_token_index,
    "op5_lattice_dedup": op5_lattice_dedup,
    "op6_warc_index": op6_warc_index,
    "op7_quality_score": op7_quality_score,
    "op8_benchmark_hits": op8_benchmark_hits,
    "op9_interpolated_lm": op9_interpolated_lm,
    "op10_source_mix": op10_source_mix,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_bit_whitening": op12_bit_whitening,
    "op13_substring_dedup": op13_substring_dedup,
}


def _runs_sql(levels: int = 18) -> str:
    """Runs by names of 2**k words, doubled level by level: within a run, words of a whole period come next one smallest period on.

    ``levels`` bounds periods to 2**(levels - 1), so texts to 2**(levels + 1) words.
    """
    table = "select b, b as c from (select cast(unnest(range(256)) as bigint) as b)"
    for _ in range(8):
        table = f"select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from ({table})"
    parts = ["g0 as materialized (select r, n, i, hash(x) as g from word where n >= 6)"]
    for k in range(levels):
        if k:
            half = 1 << (k - 1)
            parts.append(f"g{k} as materialized (select r, n, i, g from (select r, n, i, case when i + {2 * half} <= n then hash(g, lead(g, {half}) over (partition by r order by i)) end as g from g{k - 1} where n >= {4 * half + 4}) where g is not null)")
        parts.append(f"q{k} as (select r, i, q from (select r, i, lead(i) over (partition by r, g order by i) - i as q from g{k}) where q <= {1 << k} and 2 * q > {1 << k})")
        parts.append(f"s{k} as (select r, min(i) as start, count(*) - 1 + {1 << k} + q as length, q as period from (select r, i, q, i - row_number() over (partition by r, q order by i) as o from q{k}) group by r, q, o)")
    found = " union all ".join(f"select * from s{k}" for k in range(levels))
    return f"""
with tab as (select list(c order by b) as tab from ({table})),
d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
h as (
  select r, doc_id, w, len(w) as n, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) as h from d, tab),
a as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, (h // 10) % 8 as m from h),
e as (select r, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + m)) end + 1]) end as w from a),
word as materialized (select r, n, unnest(range(n)) as i, unnest(w) as x from e),
{", ".join(parts)},
run as materialized (select * from ({found}) where length >= greatest(6, 4 * period)),
best as (select * from (select *, row_number() over (partition by r order by length desc, start, period) as place from run) where place = 1),
told as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as t from run group by r),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from run),
kept as (
  select word.r, string_agg(x, ' ' order by i) as t from word semi join run on run.r = word.r
  where not exists (select 1 from gone where gone.r = word.r and gone.i = word.i) group by word.r)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, cast(1000 * length // period as bigint) as exponent_milli,
  sha256(coalesce(told.t, '')) as runs_sha256, sha256(coalesce(kept.t, array_to_string(w, ' '))) as collapsed_sha256
from e left join best on best.r = e.r left join told on told.r = e.r left join kept on kept.r = e.r
"""

SQL: dict[str, str] = {
    "op1_ngram_join": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select distinct doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as k from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (
  select x, y from common join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
edge as (select x as a, y as b from link union all select y, x from link),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edge e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.c as component_id
from d left join n using (doc_id) join (select a, min(b) as c from reach group by a) r on r.a = d.doc_id
""",
    "op3_preference_format": r"""
with t as (
  select conv_id, coalesce(role, 'user') as role, coalesce("text", '') as txt,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce("text", '')) as pos
  from conversations where conv_id is not null),
last_reply as (select conv_id, max(pos) as pos from t where role = 'assistant' group by conv_id),
other as (
  select t.conv_id, arg_max(t.txt, t.pos) as txt from t join last_reply l on l.conv_id = t.conv_id
  where t.role = 'assistant' and t.pos < l.pos group by t.conv_id),
both_sides as (
  select t.conv_id, t.pos, t.role, t.txt as a, case when t.pos = l.pos then coalesce(o.txt, '') else t.txt end as b
  from t join last_reply l on l.conv_id = t.conv_id and t.pos <= l.pos left join other o on o.conv_id = t.conv_id),
split_at as (
  select conv_id, least(coalesce(min(case when a <> b then pos end) - 1, max(pos)), max(pos) - 1) as n_prefix from both_sides group by conv_id),
parts as (
  select s.*, p.n_prefix, '<|' || role || '|>' || chr(10) as head from both_sides s join split_at p using (conv_id)),
tails as (
  select *, sum(length(head || a) + 8) over w as a_end, sum(length(head || b) + 8) over w as b_end from parts
  where pos > n_prefix window w as (partition by conv_id order by pos)),
prompts as (
  select conv_id, string_agg(head || a || '<|end|>' || chr(10), '' order by pos) as prompt from parts where pos <= n_prefix group by conv_id)
select t.conv_id as pair_id, cast(any_value(t.n_prefix) as bigint) as n_prefix, coalesce(any_value(p.prompt), '') as prompt,
  string_agg(head || a || '<|end|>' || chr(10), '' order by pos) as chosen,
  coalesce(string_agg(cast(a_end - 8 - length(a) as bigint) || ':' || cast(a_end as bigint), ',' order by pos) filter (where role = 'assistant'), '') as chosen_mask,
  string_agg(head || b || '<|end|>' || chr(10), '' order by pos) as rejected,
  coalesce(string_agg(cast(b_end - 8 - length(b) as bigint) || ':' || cast(b_end as bigint), ',' order by pos) filter (where role = 'assistant'), '') as rejected_mask
from tails t left join prompts p on p.conv_id = t.conv_id group by t.conv_id
""",
    "op10_source_mix": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) as size,
    md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null')) as k from documents),
s as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 as r from d group by source),
w as (select *, case r when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as stop from s),
l as (
  select *, sum(source_size) over () - coalesce(sum(stop) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_words,
    sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as left_weight from w),
f as (select *, left_words * weight >= stop * left_weight as stops from l),
g as (
  select *, sum(source_size) over () - sum(case when stops then stop else 0 end) over () as free_words,
    sum(case when stops then 0 else weight end) over () as free_weight from f),
t as (select source, source_size, case when stops then cast(stop as double) else cast(weight * free_words as double) / cast(free_weight as double) end as target from g),
b as (
  select *, cast(floor(target + 0.5) as bigint) as budget, case when source_size > 0 then cast(floor(target + 0.5) as bigint) // source_size else 0 end as epochs from t),
o as (
  select doc_id, size, source_size, target, epochs, budget - epochs * source_size
    - coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as room
  from d join b on d.source is not distinct from b.source)
select doc_id, cast(size as bigint) as size, source_size, target, cast(epochs * size + greatest(0, least(room, size)) as bigint) as taken from o
""",
    "op8_benchmark_hits": r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (
  select distinct item_id, regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as k from i where len(w) > 0)),
lens as (select distinct n from win),
occ as (
  select r, k, n, array_to_string(w[k : k + n - 1], ' ') as g
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, lens where len(w) >= n)),
hit as (select occ.r, occ.k, occ.n, win.item_id from occ join win on occ.n = win.n and occ.g = win.g),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hit) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from hit) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (r) left join items using (r)
""",
    "op6_warc_index": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as response_id from p group by html),
x as (
  select page_id, g.response_id, octet_length(encode(html)) as payload_bytes, from_hex(sha1(html)) as raw
  from p join g using (html)),
b as (
  select *, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(
      ((get_bit(bits, k * 5) * 16 + get_bit(bits, k * 5 + 1) * 8 + get_bit(bits, k * 5 + 2) * 4 + get_bit(bits, k * 5 + 3) * 2 + get_bit(bits, k * 5 + 4))) as int) + 1, 1), '' order by k)
      from (select cast(unnest(range(0, 32)) as int) as k)) as payload_digest
  from (select *, cast(raw as bit) as bits from x))
select page_id, payload_bytes, payload_digest, case when page_id = response_id then 'response' else 'revisit' end as record_type,
  case when page_id <> response_id then response_id end as refers_to from b
""",
    "op11_periodic_runs": _runs_sql(),
    "op13_substring_dedup": r"""
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as k, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select r, k, i, array_to_string(w[i : i + 19], ' ') as g from (select r, k, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
later as (select r, i from (select r, i, row(k, i) > min(row(k, i)) over (partition by g) as late from win) where late),
gone as (select distinct r, unnest(range(i, i + 20)) as i from later),
kept as (
  select w.r, string_agg(x, ' ' order by w.i) as t from (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d where r in (select r from gone)) w
  where not exists (select 1 from gone where gone.r = w.r and gone.i = w.i) group by w.r),
n as (select r, count(*) as n from gone group by r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(case when n is null then array_to_string(w, ' ') else coalesce(t, '') end) as kept_sha256
from d left join n using (r) left join kept using (r)
""",
}
