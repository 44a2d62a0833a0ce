"""Queries of the text-data problems (p8 to p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbar.llm import mixing, quality, tokenizer
from quillbar.llm.words import COMMON
from quillbar.plans import Registry
from quillbar.sources.tables import table

R = Registry()


# ---- 8: encoding with a public tokenizer
@R.add("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


# ---- 9: mixing sources to target weights
@R.add("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """One row per selected document: doc_id, source, n_tokens, uses."""
    return mixing.selection(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


@R.add("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), t), t)


@R.add("p9_slots")
def p9_slots(spark: SparkSession, d: str) -> DataFrame:
    """One row per use of a document, with its output shard and slot."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


# ---- 10: text quality statistics
def _shares_sql() -> str:
    return ", ".join(
        f"len(list_filter(bare, lambda w: w in ({', '.join(repr(w) for w in words)}))) / nullif(len(words), 0) as s_{lang}" for lang, words in COMMON.items()
    )


_SP = r"[\s\pZ\x{feff}]"
_P10_SQL = rf"""
with a as (
  select doc_id, text, list_filter(regexp_split_to_array(text, '{_SP}+'), lambda w: w <> '') as words,
    list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '{_SP}+$', '')), lambda x: x <> '') as lines
  from documents
), b as (
  select *, list_transform(words, lambda w: lower(regexp_replace(w, '^[^\pL]+|[^\pL]+$', '', 'g'))) as bare from a
), c as (select *, {_shares_sql()} from b),
e as (select *, greatest(s_en, s_de, s_fr) as best from c)
select doc_id,
  case when best >= 0.1 then case when s_en = best then 'en' when s_de = best then 'de' else 'fr' end else 'und' end as language,
  cast(len(words) as int) as word_count,
  round(length(regexp_replace(text, '{_SP}', '', 'g')) / nullif(len(words), 0), 6) as mean_word_length,
  case when len(words) > 0 then round(length(regexp_replace(text, '[\pL\pN\s\pZ\x{{feff}}]', '', 'g')) / length(text), 6) end as symbol_ratio,
  case when len(words) > 0 then round(len(list_filter(lines, lambda x: regexp_matches(x, '{quality.CLOSING}'))) / nullif(len(lines), 0), 6) end as closed_line_share,
  round(best, 6) as common_word_share
from e
"""


@R.add("p10_statistics", _P10_SQL)
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents")).drop("text")


@R.add("p10_scores")
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.outlier_scores(quality.statistics(table(spark, d, "documents")).drop("text"))


@R.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents")).select(F.col("doc_id"))
