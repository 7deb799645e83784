"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import quantiles
from quernel.llm.bpe import count_tokens, encode_column
from quernel.llm.mixing import Plan, Target, mix, plan_of, report
from quernel.llm.repetition import STRATA, Cutoff, cutoff_report, labelled_holdout, repetition, risk_controlled_cutoffs, screened
from quernel.llm.top_n import cluster, top_n
from quernel.plans.scratch import materialize
from quernel.sources.parquet import read_parquet

#: The folder of public vocabularies, a parameter of the queries that need one.
TOKENIZERS = "/opt/tokenizers"
TOP = 5
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
LEAST_CHARS, LEAST_SHARE = 80, 0.35
#: Documents of the labelled holdout.
HOLDOUT = 12_000
CUTOFFS = tuple(round(0.05 * i, 2) for i in range(1, 8))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _valid_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with units_sold in 0..20000 and the category of their brand."""
    brands = _table(spark, sf_dir, "brands").select("brand", "category")
    sales = _table(spark, sf_dir, "fmcg_sales").where(F.col("units_sold").between(0, 20000)).select("load_id", "sku", "brand", "sale_id", "units_sold")
    return sales.join(brands, "brand")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _valid_sales(spark, sf_dir).where(F.col("sku").isNotNull())
    table = cluster(items, ("category", "sku"), "units_sold", ("sale_id",))
    return top_n(spark, table, TOP).select("category", "sku", "sale_id")


_LOAD = ("load_id", "category")


def _load_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state per load and category, written as it would be kept from day to day."""
    sales = _valid_sales(spark, sf_dir).where(F.col("category").isNotNull())
    return materialize(quantiles.states_of(sales, _LOAD, "units_sold"), "load-states")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each load and category and, with load_id NULL, of each category put together from its loads.

    The stated rank_error holds for all rows of the result together.
    """
    loads = _load_states(spark, sf_dir)
    n_loads, n_categories = loads.agg(F.count(F.lit(1)), F.count_distinct("category")).first()
    answers = (n_loads + n_categories) * len(PERCENTILES)
    whole = quantiles.percentiles(quantiles.merge_states(loads, ("category",)), ("category",), PERCENTILES, answers)
    single = quantiles.percentiles(loads, _LOAD, PERCENTILES, answers)
    return single.unionByName(whole.select(F.lit(None).cast("long").alias("load_id"), *whole.columns))


def p3_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each load and category; groups of at most quantiles.K values are exact."""
    return quantiles.percentiles(_load_states(spark, sf_dir), _LOAD, PERCENTILES)


def p3_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of categories straight from the rows."""
    sales = _valid_sales(spark, sf_dir).where(F.col("category").isNotNull())
    return quantiles.percentiles(quantiles.states_of(sales, ("category",), "units_sold"), ("category",), PERCENTILES)


def _true_ranks(sales: DataFrame, answers: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """For each answer of a group the values below it and the values up to it, by one exact scan."""
    wide = answers.groupBy(*by).agg(
        F.first("n_values").alias("n_values"), F.first("rank_error").alias("rank_error"), *[F.first(F.when(F.col("percentile") == p, F.col("estimate")), True).alias(f"e{i}") for i, p in enumerate(PERCENTILES)]
    )
    v = F.col("units_sold")
    counts = [F.sum(F.when(c, 1).otherwise(0)).alias(f"{n}{i}") for i in range(len(PERCENTILES)) for n, c in (("lt", v < F.col(f"e{i}")), ("le", v <= F.col(f"e{i}")))]
    found = sales.join(wide, list(by)).groupBy(*by, "n_values", "rank_error").agg(F.count(F.lit(1)).alias("_n"), *counts)
    rows = F.inline(F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"lt{i}").alias("_lt"), F.col(f"le{i}").alias("_le")) for i, p in enumerate(PERCENTILES)]))
    return found.select(*by, "n_values", "rank_error", "_n", rows)


def p3_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact ranks of each answer of ``p3_percentiles`` come within its stated error of the percentile."""
    found = materialize(p3_percentiles(spark, sf_dir), "percentiles")
    sales = _valid_sales(spark, sf_dir).where(F.col("category").isNotNull()).select(*_LOAD, "units_sold")
    single = _true_ranks(sales, found.where(F.col("load_id").isNotNull()), _LOAD)
    whole = _true_ranks(sales.drop("load_id"), found.where(F.col("load_id").isNull()).drop("load_id"), ("category",))
    ranks = single.unionByName(whole.withColumn("load_id", F.lit(None).cast("long")))
    # The rank that is asked for is a whole one, and the first at least.
    target, slack = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("_n"))), F.col("rank_error") * F.col("_n")
    within = (F.col("_n") == F.col("n_values")) & (target > F.col("_lt") - slack) & (target <= F.col("_le") + slack)
    return ranks.select("load_id", "category", "percentile", "n_values", within.alias("within"))


def p7_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return encode_column(_table(spark, sf_dir, "documents"), ["doc_id"], "text", f"{tokenizers}/byte_bpe_50k.tiktoken")


def _sized(spark: SparkSession, sf_dir: str, tokenizers: str) -> tuple[DataFrame, list[Target]]:
    documents = count_tokens(_table(spark, sf_dir, "documents"), ["doc_id", "source"], "text", f"{tokenizers}/byte_bpe_50k.tiktoken")
    targets = [Target(r["source"], r["target_weight"] or 0.0, r["max_repeats"] or 0) for r in _table(spark, sf_dir, "mix_targets").collect()]  # a row per source of the mix
    return documents.select("doc_id", F.when(F.col("source").isNotNull(), F.array("source")).otherwise(F.array()).alias("sources"), "n_tokens"), targets


def p8_found(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    documents, targets = _sized(spark, sf_dir, tokenizers)
    _, plan, _ = plan_of(documents, targets)
    short = [(s,) for s, quota in plan.quotas.items() if plan.reached[s] < quota]
    return spark.createDataFrame(short, "source string")


def _mix(spark: SparkSession, sf_dir: str, tokenizers: str) -> tuple[DataFrame, Plan, list[Target]]:
    documents, targets = _sized(spark, sf_dir, tokenizers)
    selected, plan = mix(documents, targets, "doc_id")
    return selected, plan, targets


def p8_mix(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return _mix(spark, sf_dir, tokenizers)[0]


def p8_shares(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return report(*_mix(spark, sf_dir, tokenizers))


#: Sets of documents by length in characters, with weight and repeats: every document is in one of them and in a source.
LENGTHS = (("short", 0.25, 2), ("long", 0.3, 1))
SHORT_CHARS = 120


def p8_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of all documents and of the mix, in characters, where sources overlap with sets by length."""
    documents = _table(spark, sf_dir, "documents").where(F.length("text") > 0)
    n = F.length("text").cast("long")
    sources = F.array_compact(F.array(F.col("source"), F.when(n < SHORT_CHARS, "short").otherwise("long")))
    targets = [Target(r["source"], (r["target_weight"] or 0.0) / 2, r["max_repeats"] or 0) for r in _table(spark, sf_dir, "mix_targets").collect()]  # a row per source of the mix
    _, plan, _ = plan_of(documents.select("doc_id", sources.alias("sources"), n.alias("n_tokens")), targets + [Target(*x) for x in LENGTHS])
    return spark.createDataFrame([(plan.total, sum(plan.reached.values()))], "total long, routed long")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_table(spark, sf_dir, "documents"), ["doc_id"], "text").select("doc_id", "n_units", "n_repeated", "share")


def _long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text").where(F.length("text") >= LEAST_CHARS)


def _cutoffs(documents: DataFrame) -> dict[str, Cutoff]:
    """A cutoff for every stratum; the stated share where the holdout has no document of it."""
    holdout = labelled_holdout(documents, "doc_id", "text", LEAST_SHARE, HOLDOUT)
    return {s: Cutoff(LEAST_SHARE, 0, 1.0) for s in STRATA} | risk_controlled_cutoffs(holdout, CUTOFFS, LEAST_SHARE)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose score reaches their stratum's cutoff are measured exactly; the stated share decides on these."""
    documents = _long_enough(spark, sf_dir)
    cutoffs = {s: c.cutoff for s, c in _cutoffs(documents).items()}
    return screened(documents, ["doc_id"], "text", cutoffs).where(F.col("share") >= LEAST_SHARE).select("doc_id")


def p9_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guaranteed and measured false rejection of the cutoffs, and what they find, outside the holdout."""
    documents = _long_enough(spark, sf_dir)
    return cutoff_report(documents, "doc_id", "text", _cutoffs(documents), LEAST_SHARE, HOLDOUT)


QUERIES = {f.__name__: f for f in (p1_found, p3_percentiles, p3_loads, p3_direct, p3_within_bound, p7_ids, p8_found, p8_mix, p8_shares, p8_overlap, p9_found, p9_shares, p9_cutoffs)}

_REPETITION = r"""
WITH w AS (SELECT doc_id, text, length(text) AS n_chars, regexp_extract_all(lower(text), '\p{L}+') AS words FROM documents),
s AS (SELECT doc_id, n_chars, words, array_to_string(words, '') AS letters FROM w),
h AS (SELECT doc_id, n_chars, words, letters, length(letters) - length(regexp_replace(letters, '[\p{Han}\p{Hiragana}\p{Katakana}ー]', '', 'g')) AS han FROM s),
u AS (SELECT doc_id, n_chars, CASE WHEN 2 * han > length(letters) THEN 8 ELSE 4 END AS run, CASE WHEN 2 * han > length(letters) THEN string_split(letters, '') ELSE words END AS units FROM h),
g AS (SELECT doc_id, run, unnest(list_transform(range(1, len(units) - run + 2), lambda i: {'i': i, 'gram': array_to_string(units[i : i + run - 1], ' ')}), recursive := true) FROM u),
k AS (SELECT doc_id, run, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS nth FROM g),
c AS (SELECT doc_id, COUNT(DISTINCT i + j) AS n_repeated FROM (SELECT doc_id, i, unnest(range(0, run)) AS j FROM k WHERE nth > 1) GROUP BY doc_id),
d AS (SELECT u.doc_id, n_chars, COALESCE(len(units), 0) AS n_units, COALESCE(n_repeated, 0) AS n_repeated, CASE WHEN len(units) > 0 THEN COALESCE(n_repeated, 0) / len(units) ELSE 0.0 END AS share
  FROM u LEFT JOIN c ON u.doc_id = c.doc_id)
"""

SQL = {
    "p1_found": """
WITH d AS (SELECT DISTINCT b.category, s.sku, s.sale_id, s.units_sold FROM fmcg_sales s JOIN brands b ON s.brand = b.brand WHERE s.sku IS NOT NULL AND s.units_sold BETWEEN 0 AND 20000),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category, sku ORDER BY units_sold DESC, sale_id) AS place FROM d)
SELECT category, sku, sale_id FROM r WHERE place <= 5""",
    # Exact, which the estimates are too where no load has more than quantiles.K values of a category.
    "p3_loads": f"""
WITH g AS (SELECT s.load_id, b.category, list_sort(list(s.units_sold)) AS v, COUNT(*) AS n_values FROM fmcg_sales s JOIN brands b ON s.brand = b.brand
  WHERE s.units_sold BETWEEN 0 AND 20000 AND b.category IS NOT NULL GROUP BY s.load_id, b.category)
SELECT load_id, category, percentile, CAST(v[CAST(GREATEST(1, CEIL(percentile * n_values)) AS BIGINT)] AS DOUBLE) AS estimate, n_values, CAST(0 AS DOUBLE) AS rank_error
FROM g, (SELECT unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in PERCENTILES)}]) AS percentile) p""",
    "p3_within_bound": f"""
SELECT s.load_id, b.category, p.percentile, COUNT(*) AS n_values, TRUE AS within
FROM fmcg_sales s JOIN brands b ON s.brand = b.brand, (SELECT unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in PERCENTILES)}]) AS percentile) p
WHERE s.units_sold BETWEEN 0 AND 20000 AND b.category IS NOT NULL GROUP BY GROUPING SETS ((s.load_id, b.category, p.percentile), (b.category, p.percentile))""",
    # The smallest cut over all sets of sources, which the largest flow equals.
    "p8_overlap": f"""
WITH t AS (SELECT row_number() OVER (ORDER BY source) - 1 AS place, * FROM (SELECT source, CAST(target_weight AS DECIMAL(18,9)) / 2 AS w, max_repeats AS r FROM mix_targets
  UNION ALL {' UNION ALL '.join(f"SELECT '{s}', {w}, {r}" for s, w, r in LENGTHS)})),
d AS (SELECT doc_id, length(text) AS n, source, CASE WHEN length(text) < {SHORT_CHARS} THEN 'short' ELSE 'long' END AS kind FROM documents WHERE length(text) > 0),
q AS (SELECT t.*, ceil(CAST(w * (SELECT SUM(n) FROM d) AS DECIMAL(30,9))) AS quota FROM t),
p AS (SELECT row_number() OVER () AS p, source, kind, SUM(n) AS n FROM d GROUP BY source, kind),
a AS (SELECT p.p, p.n, q.place, p.n * q.r AS room FROM p JOIN q ON q.source = p.source OR q.source = p.kind WHERE q.w > 0),
m AS (SELECT p, MAX(room) AS most FROM a GROUP BY p),
u AS (SELECT unnest(range(0, CAST(pow(2, (SELECT COUNT(*) FROM t)) AS BIGINT))) AS subset),
c AS (SELECT subset, p, SUM(CASE WHEN (subset >> place) & 1 = 1 THEN room ELSE 0 END) AS room FROM u, a GROUP BY subset, p),
f AS (SELECT subset, SUM(LEAST(c.room, m.most)) AS flow FROM c JOIN m ON c.p = m.p GROUP BY subset),
k AS (SELECT f.subset, f.flow + (SELECT COALESCE(SUM(quota), 0) FROM q WHERE (f.subset >> place) & 1 = 0 AND w > 0) AS cut FROM f)
SELECT CAST((SELECT SUM(n) FROM d) AS BIGINT) AS total, CAST(MIN(cut) AS BIGINT) AS routed FROM k""",
    "p9_found": _REPETITION + "SELECT doc_id FROM d WHERE n_chars >= 80 AND share >= 0.35",
    "p9_shares": _REPETITION + "SELECT doc_id, n_units, n_repeated, share FROM d",
}
