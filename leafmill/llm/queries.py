"""The registered query of each operator, over whole tables, and its SQL where there is one."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    decontam, hmm, infill, language, mixing, neardup, rules, sharding, tokenbin, topk, toxicity,
    vqtree, warc,
)
from leafmill.llm.common import shared_folder

OLD_SHARDS, SHARDS = 32, 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs.filter(~out))
    return language.identify(docs, model).withColumn("held_out", out)


def old_shard() -> Column:
    """The layout before resharding: 32 shards by a hash of the id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)).cast("int")


def op2_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    sharding.reshard(docs, old_shard(), OLD_SHARDS, SHARDS, path)
    return sharding.read_shards(docs, path).select(
        "doc_id",
        sharding.row_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op4_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rules.statistics(_table(spark, sf_dir, "documents"))
    verdict = rules.fit(stats, _table(spark, sf_dir, "labels")).column()
    failed = rules.base_failed()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict).alias("kept"),
    )


# Shares of the mix. A source's domain is the number in its name modulo 4.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}
MIX_WEIGHTS = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": SOURCE_WEIGHTS}


def mix_levels() -> dict[str, Column]:
    number = F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as bigint)")
    domain = F.concat(F.lit("domain"), (F.coalesce(number, F.lit(0)) % 4).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(
        docs, mix_levels(), MIX_WEIGHTS, budget_share=0.9, max_epochs=2, seed=17
    ).select(
        "doc_id", "domain", "lang", "source", "epoch", "leaf_budget", "n_tokens", "taken_tokens"
    )


def op6_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(~out))
    return toxicity.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", "predicted", "weight", "n_words"
    )


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = tokenbin.write_ids(_table(spark, sf_dir, "documents"), folder, path, end_id=1)
    return tokenbin.read_ids(manifest, folder, tokenbin.id_bytes(path))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, manifest, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(
        _table(spark, sf_dir, "documents"), language.held_out(F.col("doc_id"), 5, 1)
    )


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op11_swar_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    text = infill.restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"),
    )


QUERY_STEP = 50


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", topk.quantised(F.col("embedding")).alias("vec"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0), k=5)


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vqtree.compress(_table(spark, sf_dir, "embeddings"))
    digest = None if books is None else vqtree.books_sha256(books)
    return vqtree.with_label_error(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256")
    )


def _for_workers(
    query: Callable[[SparkSession, str], DataFrame],
) -> Callable[[SparkSession, str], DataFrame]:
    """Python workers on this machine find the package also if only the driver's path has it."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        find_package(spark)
        return query(spark, sf_dir)

    return run


def find_package(spark: SparkSession) -> None:
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_language_ecoc": op1_language_ecoc,
        "op2_min_cost_resharding": op2_min_cost_resharding,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_decision_list_quality": op4_decision_list_quality,
        "op5_hierarchical_mixing": op5_hierarchical_mixing,
        "op6_lexicon_toxicity": op6_lexicon_toxicity,
        "op7_token_ids": op7_token_ids,
        "op8_warc_round_trip": op8_warc_round_trip,
        "op9_hidden_markov_scores": op9_hidden_markov_scores,
        "op10_spaced_seed_decontamination": op10_spaced_seed_decontamination,
        "op11_swar_infill": op11_swar_infill,
        "op12_exact_top_k": op12_exact_top_k,
        "op13_cover_tree_codes": op13_cover_tree_codes,
    }
    return {name: _for_workers(query) for name, query in found.items()}


def _level_sql(above: str, name: str, parent: list[str], level: str, weights: dict) -> str:
    """One level of water-filling, written as plain windows."""
    below = ", ".join([*parent, level])
    over = f"partition by {', '.join(parent)}" if parent else ""
    cases = " ".join(f"when '{k}' then {v}.0" for k, v in weights.items())
    join = " and ".join(f"l.{c} = p.{c}" for c in parent) or "true"
    return f"""
    {name}_w as (
      select {", ".join(f"l.{c}" for c in [*parent, level])},
        cast(sum(l.tokens) * 2 as double) as cap,
        cast(case l.{level} {cases} else 1.0 end as double) as w, any_value(p.b) as b
      from leaves l join {above} p on {join} group by all),
    {name}_line as (
      select *, (b - coalesce(sum(cap) over ({over} order by cap / w, {level}
          rows between unbounded preceding and 1 preceding), 0.0))
        / sum(w) over ({over} order by cap / w, {level}
          rows between current row and unbounded following) as line
      from {name}_w),
    {name} as (
      select {below}, greatest(least(cap, w * max(line) over ({over})), 0.0) as b
      from {name}_line),"""


OP5_SQL = f"""
with docs as (
  select doc_id,
    'domain' || coalesce(try_cast(regexp_extract(source, '[0-9]+') as bigint), 0) % 4 as domain,
    coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens
  from documents),
leaves as (
  select domain, lang, source, sum(n_tokens)::bigint as tokens from docs group by all),
root as (select floor(sum(tokens) * 0.9::double) as b from leaves),
{_level_sql("root", "domains", [], "domain", DOMAIN_WEIGHTS)}
{_level_sql("domains", "langs", ["domain"], "lang", LANG_WEIGHTS)}
{_level_sql("langs", "sources", ["domain", "lang"], "source", SOURCE_WEIGHTS)}
plan as (
  select l.*, floor(b)::bigint as leaf_budget,
    case when tokens = 0 then 0 else floor(b)::bigint // tokens end as full_epochs,
    case when tokens = 0 then 0 else floor(b)::bigint % tokens end as rest
  from leaves l join sources using (domain, lang, source)),
epochs as (
  select d.*, p.leaf_budget, p.full_epochs, p.rest, e.epoch,
    md5('17-' || e.epoch || '-' || d.doc_id) as key
  from docs d join plan p using (domain, lang, source)
    join (select unnest(range(0, 3)) as epoch) e on e.epoch <= p.full_epochs),
placed as (
  select *, coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch
    order by key rows between unbounded preceding and 1 preceding), 0) as start
  from epochs)
select doc_id, domain, lang, source, epoch::bigint as epoch, leaf_budget, n_tokens,
  (case when epoch < full_epochs then n_tokens else least(n_tokens, rest - start) end)::bigint
    as taken_tokens
from placed where epoch < full_epochs or start < rest
"""


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[p:p + 3], ' ') as s
  from words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as u(p) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * c >= 80 * (p.n + q.n - c)),
edges as (select x, y from links union all select y, x from links),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on e.x = r.y),
lowest as (select x as doc_id, min(y) as low from reach group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles,
  least(d.doc_id, coalesce(low, d.doc_id)) as component_id, d.doc_id <= coalesce(low, d.doc_id) as kept
from documents d left join sizes using (doc_id) left join lowest using (doc_id)
"""

# Base 32 of a SHA-1: four letters for every five hex digits, which are 20 bits.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = " || ".join(
    f"substr('{_BASE32}', (('0x' || substr(h, {5 * k + 1}, 5))::bigint >> {shift}) % 32 + 1, 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)
OP8_SQL = f"""
with payloads as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
firsts as (select *, min(page_id) over (partition by payload) as first_id from payloads)
select page_id, octet_length(encode(payload))::bigint as payload_bytes, {_LETTERS} as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from firsts
"""

_TOKENS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _seeds_sql(source: str, key: str) -> str:
    """A row per position and mask: the mask's number and the tokens under its ones."""
    selects = []
    for number, mask in enumerate(decontam.MASKS):
        kept = " || ' ' || ".join(f"t[p + {k}]" for k, bit in enumerate(mask) if bit == "1")
        selects.append(
            f"select {key}, p, {number} as mask, {kept} as seed"
            f" from {source}, unnest(range(1, len(t) - {len(mask)} + 2)) as u(p)"
        )
    return " union all ".join(selects)


# On every diagonal with a seed all windows are tried; the longest good one is cut to its equal pairs.
OP10_SQL = f"""
with d as (select doc_id, {_TOKENS_SQL} as t from documents where doc_id is not null),
b as (select distinct item_id, {_TOKENS_SQL} as t from benchmark where item_id is not null),
ds as ({_seeds_sql("d", "doc_id")}),
bs as ({_seeds_sql("b", "item_id")}),
hits as (select distinct doc_id, item_id, ds.p - bs.p as diagonal from ds join bs using (mask, seed)),
pairs as (
  select doc_id, item_id, diagonal, least({decontam.MIN_TOKENS}, len(b.t)) as least_tokens, i, (d.t[i + diagonal] = b.t[i])::int as eq
  from hits join d using (doc_id) join b using (item_id), unnest(range(1, len(b.t) + 1)) as u(i)
  where i + diagonal between 1 and len(d.t)),
sums as (
  select *, sum(eq) over (partition by doc_id, item_id, diagonal order by i) as total from pairs),
windows as (
  select x.doc_id, x.item_id, x.diagonal, x.least_tokens, x.i as low, y.i as high,
    row_number() over (partition by x.doc_id, x.item_id, x.diagonal order by y.i - x.i desc, x.i) as n
  from sums x join sums y on x.doc_id = y.doc_id and x.item_id = y.item_id and x.diagonal = y.diagonal
    and y.i - x.i + 1 >= x.least_tokens
  where 5 * (y.total - x.total + x.eq) >= 4 * (y.i - x.i + 1)),
equal as (
  select w.doc_id, w.item_id, w.diagonal, any_value(w.least_tokens) as least_tokens, any_value(low) as low,
    min(i) filter (eq = 1) as first_eq, max(i) filter (eq = 1) as last_eq, sum(eq)::bigint as n_equal
  from windows w join pairs p on p.doc_id = w.doc_id and p.item_id = w.item_id and p.diagonal = w.diagonal
    and p.i between w.low and w.high
  where n = 1 group by all),
cut as (
  select *, least(first_eq, greatest(low, last_eq + 1 - least_tokens)) as a from equal),
judged as (
  select *, greatest(last_eq + 1, a + least_tokens) as z from cut)
select doc_id, item_id, doc_start::int as doc_start, doc_end::int as doc_end, item_start::int as item_start,
  n_tokens::int as n_tokens, n_equal::int as n_equal, n_overlaps from (
  select doc_id, item_id, a + diagonal - 1 as doc_start, z + diagonal - 1 as doc_end, a - 1 as item_start,
    z - a as n_tokens, n_equal, count(*) over (partition by doc_id, item_id) as n_overlaps,
    row_number() over (partition by doc_id, item_id
      order by n_equal desc, z - a, a + diagonal, a desc, z + diagonal desc) as best
  from judged)
where best = 1
"""

OP11_SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u
  from documents),
hashed as (
  select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
  from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from hashed),
parts as (
  select doc_id, n, form, text, coalesce(array_to_string(u[1:a], ''), '') as prefix,
    coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:n], ''), '') as suffix
  from cut)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""

_USABLE_SQL = """embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0"""
_FLOORED_SQL = "[floor(256 * x::double)::bigint for x in embedding]"

OP12_SQL = f"""
with v as (
  select vec_id, {_FLOORED_SQL} as q from embeddings where vec_id is not null and {_USABLE_SQL}),
pairs as (
  select a.vec_id as query_id, b.vec_id as vec_id,
    list_inner_product(a.q::double[], b.q::double[])::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {QUERY_STEP} = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::bigint as rank
  from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""


def _round_sql(n: int, move: bool) -> str:
    """Assignment of the parts to codebook ``n`` and, for a round, the codebook that follows."""
    sql = f"""
near{n} as (
  select vec_id, label, p, any_value(x) as x, min(d * 64 + e) % 64 as e, min(d) as d from (
    select s.*, b.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])::bigint as d
    from parts s join book{n} b using (p))
  group by vec_id, label, p)"""
    if move:
        sql += f""",
mean{n} as (
  select p, e, list(m order by i) as c from (
    select p, e, i, floor(sum(x[i])::double / count(*))::bigint as m
    from near{n}, unnest(range(1, len(x) + 1)) as u(i) group by p, e, i)
  group by p, e),
book{n + 1} as (
  select b.p, b.e, coalesce(m.c, b.c) as c from book{n} b left join mean{n} m using (p, e))"""
    return sql


OP13_SQL = f"""
with v as (
  select vec_id, label, {_FLOORED_SQL} as q from embeddings where {_USABLE_SQL}),
parts as (
  select vec_id, label, p, q[p * (len(q) // 16) + 1:(p + 1) * (len(q) // 16)] as x
  from v, unnest(range(16)) as u(p)),
book0 as (
  select p, e, c from (
    select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts)
  where e < 64),{_round_sql(0, True)},{_round_sql(1, True)},{_round_sql(2, False)},
coded as (
  select vec_id, label, string_agg(printf('%02x', e::bigint), '' order by p) as code,
    sum(d)::bigint as error
  from near2 group by vec_id, label),
digest as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book2)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  codebooks_sha256
from coded, digest
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_hierarchical_mixing": OP5_SQL,
        "op3_minhash_near_dedup": OP3_SQL,
        "op8_warc_round_trip": OP8_SQL,
        "op10_spaced_seed_decontamination": OP10_SQL,
        "op11_swar_infill": OP11_SQL,
        "op12_exact_top_k": OP12_SQL,
        "op13_cover_tree_codes": OP13_SQL,
    }
