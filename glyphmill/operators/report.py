"""Quality reports by grouping sets: exact counts and sums, and sketches that later reports can be merged with.

One pass partially aggregates each grouping set within its task, so what is exchanged is a row for
each task and group, however many rows a group has. Quantiles come from KLL sketches and
distinct counts from HLL sketches, both of a fixed size; reports of parts (days, shards) merge
into the report of the whole without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketch sizes: KLL's k (rank error about 1.65 / k ** 0.9 at most, 0.7 % here) and HLL's log2 of buckets (error about 1.04 / 2 ** 6, 1.6 %).
KLL_K, HLL_LG = 400, 12


def grouping_sets(dims: list[str]) -> list[list[str]]:
    """All subsets of the dimensions, from all to none."""
    out = [[]]
    for d in dims:
        out += [[*s, d] for s in out]
    return sorted(out, key=lambda s: (-len(s), [dims.index(d) for d in s]))


def quality_report(df: DataFrame, dims: list[str], *, flags: dict[str, Column], measures: dict[str, Column], distinct: dict[str, Column] | None = None, sets: list[list[str]] | None = None) -> DataFrame:
    """A row for each group of each set: ``level`` (which dimensions the set leaves out, as bits of the last to the first), the dimensions, rows, n_FLAG, and of each measure (whole numbers) values_M, sum_M, least_M, most_M and its KLL sketch kll_M; of each distinct value an HLL sketch hll_D.

    Null dimensions are groups of their own, told from left-out ones by ``level``.
    """
    columns = [*(F.col(d) for d in dims), *(F.coalesce(c, F.lit(False)).alias(f"f_{n}") for n, c in flags.items()), *(c.cast("long").alias(f"m_{n}") for n, c in measures.items()), *(c.alias(f"d_{n}") for n, c in (distinct or {}).items())]
    rows = df.select(*columns)
    found = rows.groupingSets([[F.col(d) for d in s] for s in (sets or grouping_sets(dims))], *dims)
    aggregates = [F.grouping_id(*dims).cast("long").alias("level"), F.count("*").alias("rows"), *(F.count_if(f"f_{n}").alias(f"n_{n}") for n in flags)]
    for n in measures:
        m = f"m_{n}"
        aggregates += [F.count(m).alias(f"values_{n}"), F.sum(m).alias(f"sum_{n}"), F.min(m).alias(f"least_{n}"), F.max(m).alias(f"most_{n}"), F.kll_sketch_agg_bigint(m, F.lit(KLL_K)).alias(f"kll_{n}")]
    aggregates += [F.hll_sketch_agg(f"d_{n}", F.lit(HLL_LG)).alias(f"hll_{n}") for n in distinct or {}]
    return found.agg(*aggregates)


def merged(reports: Iterable[DataFrame], dims: list[str]) -> DataFrame:
    """The report of all rows together, from the reports of disjoint parts."""
    first, *rest = list(reports)
    for r in rest:
        first = first.unionByName(r)
    how = {"rows": F.sum, "n": F.sum, "values": F.sum, "sum": F.sum, "least": F.min, "most": F.max, "kll": lambda c: F.kll_merge_agg_bigint(c, F.lit(KLL_K)), "hll": F.hll_union_agg}
    keys = ["level", *dims]
    return first.groupBy(*keys).agg(*(how[c.split("_")[0]](c).alias(c) for c in first.columns if c not in keys))


def read_off(report: DataFrame, quantiles: list[float]) -> DataFrame:
    """The report with estimates in place of its sketches: q_M (an array, as ``quantiles``; null without values) and about_D."""
    out = []
    for c in report.columns:
        if c.startswith("kll_"):
            value = [F.kll_sketch_get_quantile_bigint(c, F.lit(float(q))) for q in quantiles]
            out.append(F.when(F.col(f"values_{c[4:]}") > 0, F.array(*value)).alias(f"q_{c[4:]}"))
        elif c.startswith("hll_"):
            out.append(F.hll_sketch_estimate(c).alias(f"about_{c[4:]}"))
        else:
            out.append(F.col(c))
    return report.select(*out)
