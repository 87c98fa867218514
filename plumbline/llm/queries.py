"""Queries of the problems p2, p8, p9 and p10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.values import NO_VALUE_CODES, NO_VALUE_WORDS, has_word, number_or_null
from plumbline.llm.mixing import mixture
from plumbline.llm.quantiles import merge, quantiles, sketch, within_bounds
from plumbline.llm.sentences import sentences
from plumbline.llm.tokens import token_ids
from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
PROBS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
DETECTOR, DAILY = ("city", "detid"), ("city", "detid", "day")


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utd19_u").select("city", F.when(has_word(F.col("detid")), F.col("detid")).alias("detid"), "day", number_or_null(F.col("flow")).alias("flow"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of flow per detector and per city; the cities' sketches are merged from the detectors'."""
    by_detector = sketch(_flows(spark, d), DETECTOR, "flow")
    by_city = merge(by_detector, ("city",)).where("city is not null")
    one = quantiles(by_detector.where("city is not null and detid is not null"), DETECTOR, PROBS)
    all_ = quantiles(by_city, ("city",), PROBS).withColumn("detid", F.lit(None).cast("string"))
    return one.withColumn("field", F.lit("detector")).unionByName(all_.withColumn("field", F.lit("city")))


def p2_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The form in which days are combined: one sketch a detector and day."""
    return sketch(_flows(spark, d), DAILY, "flow")


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """Every group's count and median, null where it was compacted, and if the true ranks of all its percentiles are within the stated bound."""
    flows = _flows(spark, d)
    told = p2_percentiles(spark, d)
    parts = []
    for field, keys in (("detector", DETECTOR), ("city", ("city",))):
        own = told.where(F.col("field") == field)
        good = within_bounds(flows, own, keys, "flow", PROBS)
        median = own.select(*keys, F.when(F.col("rank_bound") == 0, F.col("q_50")).alias("median"))
        cols = [F.lit(field).alias("field"), "city", "detid" if "detid" in keys else F.lit(None).cast("string").alias("detid"), "n", "median", "within"]
        parts.append(good.join(median, list(keys)).select(*cols))
    return parts[0].unionByName(parts[1])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_shares_full(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mixture as large as the corpus: small sources run short, their part goes to the others."""
    docs = table(spark, d, "documents")
    return mixture(docs, table(spark, d, "mix_targets"), total="corpus")[1]


def p9_mixture_full(spark: SparkSession, d: str) -> DataFrame:
    """The documents of that mixture."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), total="corpus")[0]


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """What the report says of the sources themselves."""
    return p9_shares(spark, d).select("source", "target_share", "max_repeats", "n_docs")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), table(spark, d, "doc_cells"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), table(spark, d, "doc_cells"), with_text=False)


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_percentiles, p2_sketches, p2_check, p8_ids, p9_mixture, p9_shares, p9_shares_full, p9_mixture_full, p9_sources, p10_found, p10_sentences)}
#: A group of more values than a sketch's level holds is compacted.
LEVEL = 1024
_CODES = ", ".join(f"{c:g}" for c in NO_VALUE_CODES)
_WORDS = ", ".join(f"'{w}'" for w in NO_VALUE_WORDS)
SQL: dict[str, str] = {
    "p2_check": f"""with f as (select city, case when coalesce(lower(regexp_replace(detid, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')) not in ({_WORDS}), false) then detid end as detid, flow from utd19_u where city is not null and coalesce(isfinite(flow) and flow not in ({_CODES}), false)),
g as (select 'detector' as field, city, detid, list_sort(list(flow)) as v from f where detid is not null group by city, detid union all select 'city', city, null, list_sort(list(flow)) from f group by city)
select field, city, detid, len(v)::bigint as n, case when len(v) <= {LEVEL} then v[greatest(ceil(0.5::double * len(v)), 1)::bigint] end as median, true as within from g""",
    "p9_sources": """select t.source, t.target_share, t.max_repeats, count(d.doc_id) as n_docs from (select source, sum(target_share) as target_share, max(max_repeats) as max_repeats from mix_targets where source is not null group by source) t
  left join documents d on d.source = t.source and d.text <> '' group by all""",
}
