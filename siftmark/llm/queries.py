"""Registered queries of this subpackage, with SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm import (
    attribution, bytenet, decontamination, hardneg, lines, packing, periodic, quality, runindex, sharding, simhash, warc, windows,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decontamination_digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = decontamination.find_matches(docs.select("doc_id", "text"), benchmark, **options)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.withColumn("n_hit", decontamination.n_hit()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, added_tokens=True))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_verdicts(docs, labels).drop("n_lines")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.repeat_digests(table(spark, sf_dir, "documents"))


def op7_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), TOKENIZER, rule="most", added_tokens=True)


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hardneg.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.with_repeated_tails(table(spark, sf_dir, "documents")))


def op13_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bytenet.quality_scores(docs, bytenet.fit(docs, table(spark, sf_dir, "labels")))


def _quality_sql() -> str:
    """The rules as rows of a VALUES list; windows are compared as texts, tails by lgamma."""
    grid = ", ".join(
        f"('{rule}', {i}, {cut}, '{value}', '{base}', {str(too_much).lower()})"
        for rule, (value, base, cuts, too_much) in quality.RULES.items() for i, cut in enumerate(cuts)
    )
    values = " ".join(f"when '{m}' then {m}" for m in quality.MEASURES)
    rules = len(quality.RULES)
    rate = 0.02 / rules
    return rf"""
    with split as (
      select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
      from documents
    ), windows as (
      select doc_id, i, array_to_string(w[i:i + 7], ' ') as win
      from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from split)
    ), repeated as (
      select doc_id, i, lag(i) over (partition by doc_id order by i) as before from (
        select doc_id, i, count(*) over (partition by doc_id, win) as n from windows) where n > 1
    ), covered as (
      select doc_id, sum(least(8, i - coalesce(before, i - 8))) as n from repeated group by doc_id
    ), lines as (
      select doc_id, count(*) as n, count(distinct line) as d
      from (select doc_id, unnest(string_split(text, chr(10))) as line from split)
      where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
    ), m as (
      select doc_id, lang, cast(len(w) as bigint) as n_words,
             cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             coalesce(l.n, 0) as n_lines, coalesce(l.n - l.d, 0) as n_dup_lines,
             cast(coalesce(c.n, 0) as bigint) as n_repeat_words
      from split left join lines l using (doc_id) left join covered c using (doc_id)
    ), b as (
      select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
    ), grid(rule, place, cutoff, measure, base, too_much) as (values {grid}
    ), tested as (
      select b.*, q.quality = 1 as good
      from b join (select doc_id, min(quality) as quality from labels
                   where quality is not null group by doc_id) q using (doc_id)
      where not base_failed
    ), hits as (
      select lang, rule, place, cutoff, good,
             case when too_much then 1000 * v > cutoff * t else 1000 * v < cutoff * t end as hit
      from (select tested.*, grid.*, case measure {values} end as v, case base {values} end as t
            from tested cross join grid)
    ), counted as (
      select lang, rule, place, cutoff, count(*) filter (good) as n_good, count(*) filter (not good) as n_bad,
             count(*) filter (good and hit) as k, count(*) filter (not good and hit) as caught
      from hits group by all
    ), tails as (
      select *, case when k >= n_good * {rate} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
            + i * ln({rate}) + (n_good - i) * ln(1 - {rate})))) end as p,
        caught * n_good - 10 * k * n_bad as gain
      from counted
    ), best as (
      select lang, rule, cutoff from tails
      where p <= 0.05 / ((select count(distinct lang) from tested) * {rules}) and gain > 0
      qualify row_number() over (partition by lang, rule order by gain desc, place) = 1
    ), rejected as (
      select distinct doc_id
      from (select b.*, grid.*, case measure {values} end as v, case base {values} end as t
            from b join best using (lang) join grid using (rule, cutoff))
      where case when too_much then 1000 * v > cutoff * t else 1000 * v < cutoff * t end
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and r.doc_id is null as kept
    from b left join (select doc_id, doc_id as hit_id from rejected) r using (doc_id)
    """.replace("r.doc_id is null", "r.hit_id is null")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECONTAMINATION_SQL = rf"""
    with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    i as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    item_windows as (
      select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as win
      from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as p
            from i where len(w) > 0)),
    sizes as (select distinct n from item_windows),
    doc_windows as (
      select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as win
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d cross join sizes)),
    hits as (select doc_id, p, n, item_id from doc_windows join item_windows using (n, win)),
    hit_words as (
      select doc_id, count(distinct q) as n_hit
      from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
    hit_items as (
      select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
      from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join hit_words using (doc_id) left join hit_items using (doc_id)
    """
_WINDOW_SQL = r"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    windows as (
      select doc_id, p, array_to_string(w[p:p + 19], ' ') as win
      from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from d)),
    later as (
      select doc_id, p from windows
      qualify row_number() over (partition by win order by doc_id, p) > 1),
    gone as (select distinct doc_id, unnest(range(p, p + 20)) as place from later),
    words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from d),
    marked as (
      select words.*, gone.place is not null as removed
      from words left join gone on words.doc_id = gone.doc_id and words.place = gone.place),
    kept as (
      select doc_id, count(*) filter (removed) as n_removed,
             string_agg(word, ' ' order by place) filter (not removed) as text
      from marked group by doc_id)
    select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from d left join kept using (doc_id)
    """
#: The CRC-32 of the decimal doc_id, then runs as islands of places that equal the one a period later.
_RUNS_SQL = r"""
    with codes as (
      select list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k:
        case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as code),
    d as (
      select row_number() over () as r, doc_id, w, len(w) as n, h // 10 as g, coalesce(h % 10 = 0, false) as hit
      from (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
               xor(list_reduce(list_transform(regexp_extract_all(hex(cast(doc_id as varchar)), '..'),
                     lambda x: cast('0x' || x as bigint)),
                   lambda c, b: xor(code[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) as h
        from documents, codes)),
    places as (
      select r, n, w, unnest(range(0, n)) as i, hit, g % n as a,
             1 + (n - g % n) // (3 + g % 8) as p from d where n > 0),
    words as (
      select r, n, i, case when hit and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as word from places),
    equal as (
      select x.r, x.i, y.i - x.i as p from words x join words y on x.r = y.r and x.word = y.word
      and y.i > x.i and 4 * (y.i - x.i) <= x.n),
    islands as (
      select r, p, min(i) as s, count(*) + p as l
      from (select *, i - row_number() over (partition by r, p order by i) as island from equal) group by r, p, island),
    runs as (
      select r, s, l, min(p) as p from islands where l >= 6 and l >= 4 * p group by r, s, l),
    told as (
      select r, count(*) as n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' order by s, p) as lines,
             min(struct_pack(minus := -l, s := s, p := p)) as best from runs group by r),
    dropped as (select distinct r, unnest(range(s + p, s + l)) as i from runs),
    kept as (
      select words.r, string_agg(word, ' ' order by words.i) filter (dropped.i is null) as text
      from words left join dropped on words.r = dropped.r and words.i = dropped.i group by words.r)
    select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, -best.minus as length, best.p as period,
           cast(floor(1000 * -best.minus / best.p) as bigint) as exponent_milli,
           sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
    from d left join told using (r) left join kept using (r)
    """
_NEGATIVES_SQL = """
    with v as (
      select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
      from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
      select a.r as anchor, a.vec_id as anchor_id, b.r, b.vec_id, a.label = b.label as same,
             cast(list_dot_product(a.q, b.q) as bigint) as score
      from v a join v b on a.r <> b.r where a.vec_id % 100 = 0),
    positives as (
      select anchor, anchor_id, r as positive, vec_id as positive_id, score as positive_score from scored where same
      qualify row_number() over (partition by anchor order by score desc, vec_id, r) <= 5),
    ranked as (
      select p.anchor_id, p.positive_id, n.vec_id as negative_id, positive_score, n.score as negative_score,
             cast(row_number() over (partition by anchor, positive order by n.score desc, n.vec_id, n.r) as integer) as rank
      from positives p join scored n using (anchor, anchor_id)
      where not n.same and 80 * positive_score <= 100 * n.score and 100 * n.score <= 100 * positive_score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5
    """
_SHARD_SQL = """
    with codes as (
      select list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k:
        case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as code),
    d as (
      select doc_id, cast(strlen(coalesce(text, '')) as bigint) + 16 as size,
             xor(list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
                   lambda x: cast('0x' || x as bigint)),
                 lambda c, b: xor(code[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) as text_crc32
      from documents, codes),
    scored as (
      select doc_id, s, -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || '/' || s), 1, 13)
                              as bigint) + 0.5) / 4503599627370496.0) as score
      from documents, range(0, 41) t(s)),
    placed as (
      select doc_id, cast(arg_min(s, score) filter (s < 40) as integer) as shard,
             cast(arg_min(s, score) as integer) as grown_shard
      from scored group by doc_id)
    select doc_id, size, text_crc32, 'key' as law, shard,
           row_number() over (partition by shard order by doc_id) - 1 as slot, grown_shard
    from d join placed using (doc_id)
    """

QUERIES = {
    "op1_suffix_decontamination": (op1_suffix_decontamination, _DECONTAMINATION_SQL),
    "op2_binary_packing": (op2_binary_packing, None),
    "op3_line_dedup": (op3_line_dedup, None),
    "op4_quality_rules": (op4_quality_rules, _quality_sql()),
    "op5_simhash": (op5_simhash, None),
    "op6_run_index_dedup": (op6_run_index_dedup, None),
    "op7_offset_token_counts": (op7_offset_token_counts, None),
    "op8_window_dedup": (op8_window_dedup, _WINDOW_SQL),
    "op9_warc": (op9_warc, None),
    "op10_rendezvous_shards": (op10_rendezvous_shards, _SHARD_SQL),
    "op11_hard_negatives": (op11_hard_negatives, _NEGATIVES_SQL),
    "op12_periodic_runs": (op12_periodic_runs, _RUNS_SQL),
    "op13_byte_network": (op13_byte_network, None),
}


def registered() -> dict:
    return QUERIES
