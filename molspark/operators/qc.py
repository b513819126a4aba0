"""QC curves, thresholds and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import hash_order, hash_share
from ..sources.shared import materialise


def _sampled_umis(df: DataFrame, n: int, reps: int, seed: int) -> DataFrame:
    """(rep, umi): ``n`` UMIs for each repetition in the order of a seeded hash."""
    umis = df.select("umi").distinct().select("umi", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    w = Window.partitionBy("rep").orderBy(hash_order(seed, F.col("rep"), F.col("umi")), "umi")
    return umis.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def anchor_stats(df: DataFrame, start: str, end: str, n: int, reps: int = 1, seed: int = 0) -> DataFrame:
    """Per sampled UMI the shares of reads with the start and the end anchor, and its reads."""
    s = F.col("r2_seq")
    per = df.groupBy("umi").agg(F.avg(s.contains(start).cast("int")).alias("start"), F.avg(s.contains(end).cast("int")).alias("end"), F.count("*").alias("reads"))
    return _sampled_umis(df, n, reps, seed).join(per, "umi")


def double_anchor(df: DataFrame, start: str, end: str, n: int, reps: int = 3, seed: int = 0) -> DataFrame:
    """Per repetition the share of sampled on-target UMIs with reads that hold each anchor."""
    per = anchor_stats(df.where("ont"), start, end, n, reps, seed)
    return per.groupBy("rep").agg(F.count("*").alias("umis"), F.avg(((F.col("start") > 0) & (F.col("end") > 0)).cast("int")).alias("both"))


def saturation_curve(df: DataFrame, sizes: list[int], reps: int = 3, threshold: int = 1, seed: int = 0) -> DataFrame:
    """Distinct UMIs with at least ``threshold`` reads, and reads per UMI, against the number of sampled reads, averaged over repetitions.

    Samples are nested: a read has a hash place in each repetition and is in every sample of at least that size.  The place is
    its hash's share of all reads, so no global order is needed.  ``velocity`` is new UMIs a new read; ``smooth`` its mean over 10.
    """
    total = df.agg(F.count("*").alias("total"))
    u = hash_share(F.concat_ws(":", F.col("rep").cast("string"), "read_id", "umi"), seed)
    reads = df.select("umi", "read_id", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).crossJoin(F.broadcast(total))
    placed = reads.withColumn("place", u * F.col("total")).withColumn("size", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda s: s > F.col("place"))))
    per = placed.groupBy("rep", "size", "umi").agg(F.count("*").alias("n"))
    one = per.groupBy("rep", "size").agg(F.sum((F.col("n") >= threshold).cast("long")).alias("umis"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))
    curve = one.groupBy("size").agg(*(F.avg(c).alias(c) for c in ("umis", "mean", "median", "least", "most")))
    w = Window.orderBy("size")  # a row a sample size
    velocity = (F.col("umis") - F.lag("umis").over(w)) / (F.col("size") - F.lag("size").over(w))
    return curve.withColumn("velocity", velocity).withColumn("smooth", F.avg("velocity").over(w.rowsBetween(-9, 0)))


def reads_per_umi_depths(df: DataFrame, read_id: str = "read_id", n: int = 5, seed: int = 0) -> DataFrame:
    """``reads_per_umi_ecdf`` at ``n`` depths that divide the reads evenly: ``depth`` 1 to n.

    A read is in all depths above its hash place, so deeper samples hold the shallower ones, and no global order is needed.
    """
    place = hash_share(F.col(read_id), seed)
    deep = df.select("umi", F.explode(F.sequence((F.floor(place * n) + 1).cast("int"), F.lit(n))).alias("depth"))
    hist = deep.groupBy("depth", "umi").agg(F.count("*").alias("reads")).groupBy("depth", "reads").agg(F.count("*").alias("umis"))
    w = Window.partitionBy("depth")  # a row a distinct number of reads
    below = w.orderBy(F.desc("reads")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("depth", "reads", "umis", (F.sum("umis").over(below) / F.sum("umis").over(w)).alias("at_least"))


def reads_per_umi_ecdf(df: DataFrame) -> DataFrame:
    """Share of UMIs with at least each number of reads."""
    hist = df.groupBy("umi").agg(F.count("*").alias("reads")).groupBy("reads").agg(F.count("*").alias("umis"))
    w = Window.orderBy(F.desc("reads")).rowsBetween(Window.unboundedPreceding, 0)  # a row a distinct number of reads
    total = hist.agg(F.sum("umis").alias("total"))
    return hist.crossJoin(F.broadcast(total)).select("reads", "umis", (F.sum("umis").over(w) / F.col("total")).alias("at_least"))


def knee_threshold(df: DataFrame, min_reads: int = 1, method: str = "chord", seed: int = 42) -> DataFrame:
    """A number of reads that parts real UMIs from noise, from the ranked curve of reads per UMI: one row, ``threshold``.

    ``chord``: the point farthest from the chord between the curve's ends in log10 rank and log10 reads, or, if none is off it, as ``drop``.
    ``drop``: the number behind the steepest fall of log10 reads from one UMI to the next (ties: the largest).  ``kmeans``: two means on log rank and
    log reads, cut halfway, in log10, between the groups; the number itself if there is one alone.
    UMIs with equal reads share a point, at the last of their ranks (``kmeans``: weighted by their number), so the curve has a row a distinct number of reads.
    """
    if method not in ("chord", "drop", "kmeans"):
        raise ValueError(f"unknown method: {method}")
    hist = df.groupBy("umi").agg(F.count("*").alias("reads")).where(F.col("reads") >= min_reads).groupBy("reads").agg(F.count("*").alias("umis"))
    w = Window.orderBy(F.desc("reads")).rowsBetween(Window.unboundedPreceding, 0)
    curve = hist.select(F.log10("reads").alias("y"), F.log10(F.sum("umis").over(w)).alias("x"), "reads", "umis")
    fall = F.col("y") - F.lag("y").over(Window.orderBy(F.desc("reads")))
    falls = F.when(F.col("fall").isNotNull(), F.struct(F.round("fall", 9), -F.col("reads")))
    drop = curve.withColumn("fall", fall).agg(F.coalesce(F.min_by("reads", falls), F.max("reads")).alias("threshold"))
    if method == "drop":
        return drop
    if method == "kmeans":
        return _two_means(curve, seed)
    ends = curve.agg(F.min_by("x", "x").alias("x0"), F.min_by("y", "x").alias("y0"), F.max("x").alias("x1"), F.max_by("y", "x").alias("y1"))
    d = F.abs((F.col("y1") - F.col("y0")) * F.col("x") - (F.col("x1") - F.col("x0")) * F.col("y") + F.col("x1") * F.col("y0") - F.col("y1") * F.col("x0"))
    far = curve.crossJoin(F.broadcast(ends)).agg(F.max_by("reads", F.struct(F.round(d, 9), "reads")).alias("knee"), F.max(F.round(d, 9)).alias("off"))
    return far.crossJoin(drop).select(F.when(F.col("off") > 0, F.col("knee")).otherwise(F.col("threshold")).alias("threshold"))


def _two_means(curve: DataFrame, seed: int) -> DataFrame:
    """The cut between two clusters of the points (x, y), each weighted by its UMIs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = materialise(curve, "knee-curve")
    if points.count() < 2:
        return points.agg(F.max("reads").cast("double").alias("threshold"))
    placed = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(points)
    model = KMeans(k=2, seed=seed, weightCol="umis").fit(placed)
    groups = model.transform(placed).groupBy("prediction").agg((F.sum(F.col("y") * F.col("umis")) / F.sum("umis")).alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"))
    cut = groups.agg(F.max_by("low", "mean").alias("signal"), F.min_by("high", "mean").alias("noise"))
    return cut.select(F.pow(F.lit(10.0), (F.col("signal") + F.col("noise")) / 2).alias("threshold"))


def bin_values(col: Column, breaks: list[float], labels: list[str]) -> Column:
    """The label of the interval (a, b] that holds the value; beyond the last break the last label."""
    out = F.when(col <= breaks[0], labels[0])
    for b, label in zip(breaks[1:], labels[1:], strict=False):
        out = out.when(col <= b, label)
    return out.when(col.isNotNull(), labels[-1])


def valid_ont_crosstab(df: DataFrame) -> DataFrame:
    """Reads by sample, validity and target."""
    return df.groupBy("sample_id", "valid_umi", "ont").agg(F.count("*").alias("reads"))


def metrics_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """``{step}_{metric}`` columns of a long (sample_id, step, metric, value) table."""
    return long.withColumn("name", F.concat_ws("_", "step", "metric")).groupBy("sample_id").pivot("name", names).agg(F.first("value"))


def metrics_long(wide: DataFrame, names: list[str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names)))
    return wide.select("sample_id", each.alias("x")).select("sample_id", F.split_part("x.name", F.lit("_"), F.lit(1)).alias("step"), F.expr("substr(x.name, instr(x.name, '_') + 1)").alias("metric"), F.col("x.value").alias("value"))


def coverage_and_validity(wide: DataFrame) -> DataFrame:
    """Reads per UMI and percent of valid UMIs of each sample, most valid first."""
    valid, invalid = F.col("preprocess_n_valid"), F.col("preprocess_n_invalid")
    return wide.select("sample_id", (F.col("parquet_total_reads") / F.col("parquet_total_umis")).alias("reads_per_umi"), (100 * valid / (valid + invalid)).alias("valid_pct")).orderBy(F.desc("valid_pct"), "sample_id")


def metacell_metadata(cells: DataFrame, samples: list[str]) -> DataFrame:
    """Per metacell its size and UMIs, and per sample cells, share and log10 UMIs side by side."""
    aggs = []
    for s in samples:
        hit = F.col("sample") == s
        aggs += [F.sum(hit.cast("long")).alias(f"cells_{s}"), F.avg(hit.cast("int")).alias(f"share_{s}"), F.coalesce(F.log10(F.sum(F.when(hit, F.col("umis")))), F.lit(0.0)).alias(f"log_umis_{s}")]
    return cells.groupBy("metacell").agg(F.count("*").alias("size"), F.avg("umis").alias("mean_umis"), F.median("umis").alias("median_umis"), *aggs)


def cell_gene_filter(counts: DataFrame, excluded: str, least: int = 500, most: int = 20_000, max_share: float = 0.03) -> DataFrame:
    """Cells with UMIs in range and a share of genes that match ``excluded`` of at most ``max_share``."""
    per = counts.groupBy("cell").agg(F.sum("umis").alias("umis"), (F.sum(F.when(F.col("gene").rlike(excluded), F.col("umis")).otherwise(0)) / F.sum("umis")).alias("excluded_share"))
    return per.where(F.col("umis").between(least, most) & (F.col("excluded_share") <= max_share))


def module_similarity(similarity: DataFrame, modules: DataFrame) -> DataFrame:
    """Mean similarity of genes for each pair of modules."""
    a, b = (modules.select(F.col("gene").alias(g), F.col("module").alias(m)) for g, m in (("gene1", "module1"), ("gene2", "module2")))
    return similarity.join(a, "gene1").join(b, "gene2").groupBy("module1", "module2").agg(F.avg("similarity").alias("similarity"))
