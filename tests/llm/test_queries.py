"""Which queries have SQL, and that they agree with it on the smallest tables."""

import pytest

from leafmill.llm import queries

# A classifier, crc32, a tokenizer or a trained model cannot be written in SQL.
WITHOUT_SQL = {
    "op1_language_ecoc", "op2_min_cost_resharding", "op4_decision_list_quality", "op6_lexicon_toxicity",
    "op7_token_ids", "op9_hidden_markov_scores",
}
TABLES = {
    "op3_minhash_near_dedup": ["documents"],
    "op8_warc_round_trip": ["pages"],
    "op10_spaced_seed_decontamination": ["documents", "benchmark"],
}


def test_the_others_have_sql():
    assert set(queries.registered()) - set(queries.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", TABLES)
def test_query_matches_its_sql(spark, same_as_sql, name):
    same_as_sql(queries.registered()[name], queries.oracle_sql()[name], *TABLES[name])


# Base columns of op4, whose verdict is a learned model.
OP4_BASE_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
grams as (
  select doc_id, p, array_to_string(w[p:p + 7], ' ') as g from w, unnest(range(1, len(w) - 6)) as u(p)),
again as (select doc_id, p from grams qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct p + k) as n from again, unnest(range(8)) as u(k) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
copies as (
  select doc_id, count(*) - count(distinct line) as n from lines
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id)
select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
  coalesce(copies.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
  len(w) < 20 or 100 * coalesce(covered.n, 0) > 30 * len(w) as base_failed
from w left join copies using (doc_id) left join covered using (doc_id)
"""


def test_base_columns_of_quality_match_their_sql(spark, same_as_sql):
    base = lambda s, d: queries.op4_decision_list_quality(s, d).drop("kept")
    same_as_sql(base, OP4_BASE_SQL, "documents")
