"""Hybrid retrieval: semantic and lexical hits merged, weighted, grouped by path and cut to a context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import ranking, text

EMPTY_CONTEXT = "No relevant context found for this query."
OVERHEAD = 20
THRESHOLD = 0.25


def merge(semantic: DataFrame, lexical: DataFrame, weight: float = 0.7, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """Hits of both legs by key, with semantic_score, lexical_score (presence) and combined_score.

    Both carry `pos`, their rank from 0. strict keeps the legs apart, as two hits of one chunk."""
    s = semantic.select(key, "source_id", "repo", "path", "snippet", F.col("score").alias("semantic_score"), F.col("pos").alias("__sp"))
    l = lexical.select(key, "source_id", "repo", "path", "snippet", F.col("pos").alias("__lp"))  # noqa: E741
    if strict:
        s = s.withColumn(key, F.concat(F.lit("semantic:"), F.col(key).cast("string")))
        l = l.withColumn(key, F.concat(F.lit("lexical:"), F.col(key).cast("string")))  # noqa: E741
    l = l.select(key, *[F.col(c).alias(f"__{c}") for c in ("source_id", "repo", "path", "snippet")], "__lp")  # noqa: E741
    both = s.join(l, key, "full_outer")
    for c in ("source_id", "repo", "path", "snippet"):
        both = both.withColumn(c, F.coalesce(c, f"__{c}"))
    presence = F.when(F.col("__lp").isNotNull(), ranking.PRESENCE).otherwise(0.0)
    both = both.withColumns({"semantic_score": F.coalesce("semantic_score", F.lit(0.0)), "lexical_score": presence, "leg": F.when(F.col("__sp").isNull(), 1).otherwise(0), "pos": F.coalesce("__sp", "__lp")})
    combined = F.col("semantic_score") * weight + F.col("lexical_score") * (1.0 - weight)
    return both.withColumn("combined_score", combined).select(key, "source_id", "repo", "path", "snippet", "semantic_score", "lexical_score", "combined_score", "leg", "pos")


def in_repos(rows: DataFrame, repos: Sequence[str] | None) -> DataFrame:
    """With several repositories, rows that name one in path, repo or source; a single one is an equality filter of the legs."""
    if not repos or len(repos) < 2:
        return rows
    hit = F.lit(False)
    for r in repos:
        for c in ("path", "repo", "source_id"):
            hit = hit | F.coalesce(F.col(c).contains(r), F.lit(False))
    return rows.where(hit)


def _order(key: str = "doc_id") -> list[Column]:
    return [F.desc("combined_score"), F.asc("leg"), F.asc("pos")]


def best_per_path(merged: DataFrame) -> DataFrame:
    """The best chunk of each path, and the rank of the path by it. As many rows as the legs fetched."""
    own = Window.partitionBy("path").orderBy(*_order())
    best = merged.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
    return best.withColumn("path_rank", F.row_number().over(Window.orderBy(*_order())))


def budgeted(best: DataFrame, most: int = 6000) -> DataFrame:
    """Paths in order while the characters before them are below the budget; the last snippet may be cut.

    Only the snippet that crosses the budget is cut, so the sum over the whole snippets before it is exact."""
    rows = best.withColumn("snippet", text.strip(F.col("snippet"))).where("snippet <> ''")
    cost = F.length("snippet") + F.length("path") + OVERHEAD
    before = F.coalesce(F.sum(cost).over(Window.orderBy("path_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__before", before).where(F.col("__before") < most)
    left = (F.lit(most) - F.col("__before")).cast("int")
    cut = F.when(F.length("snippet") > left, F.concat(F.left("snippet", left), F.lit("..."))).otherwise(F.col("snippet"))
    return rows.withColumn("snippet", cut).withColumns({"chars": F.length("snippet"), "cost": F.length("snippet") + F.length("path") + OVERHEAD}).drop("__before")


def context(used: DataFrame) -> DataFrame:
    """One row: the context text, how many sources it has and its length as counted against the budget."""
    block = F.concat(F.lit("### "), F.col("path"), F.lit(" (score: "), F.format_number("combined_score", 2), F.lit(")\n"), F.col("snippet"))
    parts = used.select("path_rank", block.alias("block"), "cost")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("path_rank", "block"))), lambda b: b["block"])
    out = parts.agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("sources_in_context"), F.coalesce(F.sum("cost"), F.lit(0)).alias("context_chars"))
    return out.select(F.when(F.size("blocks") > 0, F.array_join("blocks", "\n\n")).otherwise(EMPTY_CONTEXT).alias("context"), "sources_in_context", "context_chars")


def sources(used: DataFrame) -> DataFrame:
    return used.select("path_rank", "path", "source_id", F.bround("combined_score", 3).alias("score"), "chars")
