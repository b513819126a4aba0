"""Text, table and JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tabulate_reads(df: DataFrame, *, modality: str = "single-cell", cbc_len: int = 16, umi_len: int = 10, layout: bool = False) -> DataFrame:
    """Barcodes of read 1 with qualities, read 2 as ``seq``; single-molecule reads have no cell.

    ``layout``: range-partitioned and sorted by barcodes, for lookups; rows need a read 2 longer than the barcodes.
    """
    n = 0 if modality == "single-molecule" else cbc_len
    out = df.select("read_id", F.substring("r1_seq", 1, n).alias("cbc"), F.substring("r1_seq", n + 1, umi_len).alias("umi"), F.substring("r1_qual", 1, n).alias("cbc_qual"),
                    F.substring("r1_qual", n + 1, umi_len).alias("umi_qual"), F.col("r2_seq").alias("seq"), F.col("r2_qual").alias("seq_qual"))
    if modality == "single-molecule":
        out = out.drop("cbc", "cbc_qual")
    if not layout:
        return out
    keys = [c for c in ("cbc", "umi") if c in out.columns]
    return out.where(F.length("seq") > n + umi_len).repartitionByRange(*keys, "read_id").sortWithinPartitions(*keys)


def sam_scan(spark: SparkSession, path: str) -> DataFrame:
    """Alignment text as a table, tags as a map; header lines are left out."""
    f = F.split("value", "\t")
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v"))))
    rows = spark.read.text(path).where("value not like '@%'")
    return rows.select(f[0].alias("name"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("long").alias("pos"), f[5].alias("cigar"), f[9].alias("sequence"), f[10].alias("quality_scores"),
                       F.when(F.size(f) > 11, tags).otherwise(F.create_map().cast("map<string,string>")).alias("tags"))


def table_scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet tables under each other, columns by name."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def table_sink(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    """Write Parquet; files of at most ``rows_per_file`` rows."""
    writer = df.write
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def features_csv_scan(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """The feature table; ``marks`` as an array; optionally some kinds only."""
    df = spark.read.csv(path, header=True, schema="feature string, seq string, left_flank string, right_flank string, marks string, kind string")
    df = df.withColumn("marks", F.when(F.col("marks").isNotNull(), F.split("marks", "\\|")))
    return df if kinds is None else df.where(F.col("kind").isin(kinds))


def fasta_refs(spark: SparkSession, path: str, anchor1: str, anchor2: str) -> DataFrame:
    """References as ``mod_{name}`` with the sequence from the first anchor up to the second; an unreadable header raises."""
    entry = spark.read.option("lineSep", ">").text(path).where("trim(value) != ''")
    head, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.upper(F.regexp_replace(F.expr("substr(value, instr(value, '\n') + 1)"), "\\s", ""))
    name = F.regexp_extract(head, "^v?([0-9]+mer)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, f"^.*?{anchor1}", anchor1), f"{anchor2}.*$", anchor2)
    return entry.select(F.when(name != "", F.concat(F.lit("mod_"), name)).otherwise(F.raise_error(F.concat(F.lit("no reference name in "), head))).alias("mod"), seq.alias("seq"))


def to_fasta(read_id: Column | str, seq: Column | str) -> Column:
    return F.concat(F.lit(">"), read_id, F.lit("\n"), seq)


def to_fastq(read_id: Column | str, seq: Column | str, qual: Column | str | None = None) -> Column:
    """A record of four lines; without a quality every base gets ``I``."""
    best = F.repeat(F.lit("I"), F.length(seq))
    return F.concat(F.lit("@"), read_id, F.lit("\n"), seq, F.lit("\n+\n"), best if qual is None else F.coalesce(qual, best))


def summary_json_scan(spark: SparkSession, pattern: str) -> DataFrame:
    """``sample_id, step, timestamp, metric, value`` of run summaries; the sample is named by the two folders above the file."""
    step = "struct<timestamp:string,metrics:map<string,double>>"
    files = spark.read.option("wholetext", True).text(pattern).select(F.input_file_name().alias("file"), F.from_json("value", f"map<string,{step}>").alias("j"))
    parts = F.split("file", "/")
    sample = F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2))
    steps = files.select(sample.alias("sample_id"), F.explode("j").alias("step", "s")).where("s.metrics is not null")
    return steps.select("sample_id", "step", "s.timestamp", F.explode("s.metrics").alias("metric", "value"))


def tabix_tsv_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="readid string, start long, end long, cbc string, umi string, seq string, qual string")


def counts_mtx_scan(spark: SparkSession, folder: str, sample_id: str) -> DataFrame:
    """A cell by gene count folder (matrix, barcodes, features) as ``cbc, gene, count, sample_id``; names are joined by line number."""
    def names(name: str, col: str) -> DataFrame:
        return spark.read.csv(f"{folder}/{name}", sep="\t", schema=f"i long, {col} string")

    triplets = spark.read.csv(f"{folder}/matrix", sep=" ", schema="g long, c long, count long")
    return triplets.join(names("features", "gene").withColumnRenamed("i", "g"), "g").join(names("barcodes", "cbc").withColumnRenamed("i", "c"), "c").select(
        F.regexp_replace("cbc", "-1$", "").alias("cbc"), "gene", "count", F.lit(sample_id).alias("sample_id"))


def barcode_list_scan(spark: SparkSession, path: str) -> DataFrame:
    """Barcodes without their lane suffix."""
    return spark.read.text(path).select(F.regexp_replace("value", "-1$", "").alias("cbc"))


def run_summary_upsert(summary: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each (sample, step): timestamp, metrics, output files."""
    w = Window.partitionBy("sample_id", "step").orderBy(F.desc("timestamp"))
    return summary.unionByName(new, allowMissingColumns=True).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
