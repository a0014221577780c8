"""What has to be made anew: artifacts know the fingerprints of what they were made of, and what isn't made of what is there now is stale, with all that follows from it.

Artifacts are rows (doc_id, page, stage, hash, used): hash is the fingerprint of the artifact, used maps each stage that it was made of to the fingerprint that was
read. A stage of a document as a whole has page 0 and reads all pages: used has the fingerprint of all of them together (pages_hash)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.steps import written

#: Which stage reads which; the last is one of the whole document.
EDGES = (("ingest", "ocr"), ("ocr", "classify"), ("classify", "names"), ("ocr", "names"), ("names", "meta"), ("ocr", "meta"), ("names", "places"), ("ocr", "places"), ("classify", "aggregate"), ("meta", "aggregate"), ("places", "aggregate"))
WHOLE = ("aggregate",)
#: Passes over the names of a page, for a graph of their own. The filter and what it filters are made apart from the other branch.
PASSES = (("pass1", "pass1_filter"), ("recall", "recall_filter"), ("pass1_filter", "merged"), ("recall_filter", "merged"), ("merged", "verify"), ("verify", "rule_filter"))
ARTIFACTS = "doc_id string, page int, stage string, hash string, used map<string,string>"


def followers(spark: SparkSession, edges: Iterable[tuple[str, str]] = EDGES) -> DataFrame:
    """(stage, follower): all stages that follow from a stage, over any number of steps; by recursive SQL."""
    told = ", ".join(f"('{a}', '{b}')" for a, b in edges)
    return spark.sql(f"with recursive edge(a, b) as (values {told}), reach(a, b) as (select a, b from edge union all select r.a, e.b from reach r join edge e on e.a = r.b) select distinct a as stage, b as follower from reach")


def pages_hash(artifacts: DataFrame) -> DataFrame:
    """(doc_id, stage, hash): the fingerprint of a stage's artifacts over all pages of a document, whatever their order; a sum of 64-bit hashes, which partial sums make up."""
    each = F.xxhash64("page", "hash").cast("decimal(38,0)")
    return artifacts.groupBy("doc_id", "stage").agg(F.sum(each).alias("s"), F.count("*").alias("n")).select("doc_id", "stage", F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")).alias("hash"))


def stale(artifacts: DataFrame, edges: Iterable[tuple[str, str]] = EDGES, whole: Iterable[str] = WHOLE) -> DataFrame:
    """(doc_id, page, stage, because) of the artifacts that have to go: because names the first stage, by letter, that isn't there any more as it was read."""
    edges, whole = list(edges), list(whole)
    of_pages = ~F.col("stage").isin(*whole)
    reads = artifacts.select("doc_id", "page", "stage", F.explode("used").alias("up", "was"))
    own = artifacts.where(of_pages).select("doc_id", "page", F.col("stage").alias("up"), F.col("hash").alias("now"))
    all_pages = pages_hash(artifacts.where(of_pages)).select("doc_id", F.col("stage").alias("up"), F.col("hash").alias("now"))
    changed = reads.where(of_pages).join(own.hint("merge"), ["doc_id", "page", "up"], "left").unionByName(reads.where(~of_pages).join(all_pages.hint("merge"), ["doc_id", "up"], "left").select("doc_id", "page", "up", "stage", "was", "now"))
    direct = changed.where(~F.col("was").eqNullSafe(F.col("now"))).groupBy("doc_id", "page", "stage").agg(F.min("up").alias("because"))
    follow = followers(artifacts.sparkSession, edges)
    later = direct.join(F.broadcast(follow), "stage")  # as many rows as the graph has pairs of stages
    page = F.when(F.col("follower").isin(*whole), 0).otherwise(F.col("page")) if whole else F.col("page")
    both = direct.unionByName(later.select("doc_id", page.alias("page"), F.col("follower").alias("stage"), "because"))
    there = artifacts.select("doc_id", "page", "stage")
    return both.groupBy("doc_id", "page", "stage").agg(F.min("because").alias("because")).join(there.hint("merge"), ["doc_id", "page", "stage"], "left_semi")


def to_make(pages: DataFrame, artifacts: DataFrame, edges: Iterable[tuple[str, str]] = EDGES, whole: Iterable[str] = WHOLE) -> DataFrame:
    """ST6, ST7: (doc_id, page, stage) that are missing or stale, for pages (doc_id, page); a stage behind a missing one is to be made, too."""
    edges, whole = list(edges), list(whole)
    stages = sorted({s for e in edges for s in e})
    grid = pages.select("doc_id", "page").distinct()
    by_page = grid.withColumn("stage", F.explode(F.array(*(F.lit(s) for s in stages if s not in whole))))
    asked = by_page.unionByName(grid.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.explode(F.array(*map(F.lit, whole))).alias("stage"))) if whole else by_page
    keys = ["doc_id", "page", "stage"]
    # Joins are by sorting: fingerprints are small as files, so that Spark would bring them to the driver to broadcast them, where they are large.
    artifacts = written(artifacts)
    missing = asked.join(artifacts.hint("merge"), keys, "left_anti")
    follow = F.broadcast(followers(pages.sparkSession, edges))
    page = F.when(F.col("follower").isin(*whole), 0).otherwise(F.col("page")) if whole else F.col("page")
    behind = missing.join(follow, "stage").select("doc_id", page.alias("page"), F.col("follower").alias("stage"))
    return missing.unionByName(behind).unionByName(stale(artifacts, edges, whole).select(*keys)).join(asked.hint("merge"), keys, "left_semi").distinct()
