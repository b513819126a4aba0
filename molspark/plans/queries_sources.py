"""Queries of the sources and sinks: files are written from the tables by our own sinks and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..sources import arrow_files as af
from ..sources import fastq as fq
from ..sources import files as f
from ..sources.shared import session_folder
from .registry import Inputs, query


def _folder(t: Inputs, name: str) -> str:
    return f"{session_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, col: str, path: str, gzip: bool = False) -> str:
    writer = df.select(F.col(col).alias("value")).write
    (writer.option("compression", "gzip") if gzip else writer).text(path)
    return path


@query("fastq_scan", "SELECT read_id AS rid, reverse(translate(r2_seq, 'ACGT', 'TGCA')) AS seq, reverse(repeat('I', length(r2_seq))) AS qual FROM fx_reads")
def fastq_scan(t: Inputs) -> DataFrame:
    path = _text(t.fx_reads.withColumn("v", f.to_fastq("read_id", "r2_seq")), "v", _folder(t, "fastq"), gzip=True)
    return fq.fastq_scan(t.spark, path, rc=True)


#: Reads of one packed file: what a task sorts and reads doesn't grow with the table.
FILE_READS = 250_000


@query("paired_fastq_scan", "SELECT read_id, r1_seq, r1_qual, r2_seq, repeat('I', length(r2_seq)) AS r2_qual FROM fx_reads")
def paired_fastq_scan(t: Inputs) -> DataFrame:
    files = max(4, -(-t.fx_reads.count() // FILE_READS))  # a fixed number, so that both writes deal alike
    dealt = t.fx_reads.repartition(files, "read_id").sortWithinPartitions("read_id", "r1_seq", "r2_seq")
    one = _text(dealt.withColumn("v", f.to_fastq("read_id", "r1_seq", "r1_qual")), "v", _folder(t, "r1"), gzip=True)
    two = _text(dealt.withColumn("v", f.to_fastq("read_id", "r2_seq")), "v", _folder(t, "r2"), gzip=True)
    return fq.paired_fastq_scan(t.spark, one, two)


@query("tabulate_reads", """SELECT read_id, substr(r1_seq, 1, 16) AS cbc, substr(r1_seq, 17, 10) AS umi, substr(r1_qual, 1, 16) AS cbc_qual, substr(r1_qual, 17, 10) AS umi_qual, r2_seq AS seq, repeat('I', length(r2_seq)) AS seq_qual FROM fx_reads""")
def tabulate_reads(t: Inputs) -> DataFrame:
    return f.tabulate_reads(t.fx_reads.withColumn("r2_qual", F.repeat(F.lit("I"), F.length("r2_seq"))), layout=True)


@query("sam_scan", "SELECT umi AS name, 0 AS flag, concat('chr', CAST(cluster AS STRING)) AS rname, CAST(umi_reads AS BIGINT) AS pos, '20M' AS cigar, seq AS sequence, cbc AS cr, concat(cbc, '-1') AS cb FROM fx_mols")
def sam_scan(t: Inputs) -> DataFrame:
    line = F.concat_ws("\t", "umi", F.lit("0"), F.concat(F.lit("chr"), F.col("cluster").cast("string")), F.col("umi_reads").cast("string"), F.lit("60"), F.lit("20M"), F.lit("*"), F.lit("0"), F.lit("0"), "seq",
                       F.repeat(F.lit("I"), F.length("seq")), F.concat(F.lit("CR:Z:"), "cbc"), F.concat(F.lit("CB:Z:"), "cbc", F.lit("-1")))
    path = _text(t.fx_mols.withColumn("v", line), "v", _folder(t, "sam"))
    s = f.sam_scan(t.spark, path)
    return s.select("name", "flag", "rname", "pos", "cigar", "sequence", F.col("tags")["CR"].alias("cr"), F.col("tags")["CB"].alias("cb"))


@query("table_scan_sink", "SELECT umi, cbc, umi_reads FROM fx_mols")
def table_scan_sink(t: Inputs) -> DataFrame:
    paths = [_folder(t, "part") for _ in range(2)]
    for path, cond in zip(paths, ("wt", "not wt"), strict=True):
        f.table_sink(t.fx_mols.where(cond).select("umi", "cbc", "umi_reads"), path)
    return f.table_scan(t.spark, *paths)


@query("arrow_scan_sink", "SELECT umi, cbc, umi_reads FROM fx_mols")
def arrow_scan_sink(t: Inputs) -> DataFrame:
    """Two appends to one folder of Arrow files; of the columns written, three are read back."""
    path = _folder(t, "arrow")
    for cond in ("wt", "not wt"):
        af.arrow_sink(t.fx_mols.where(cond), path)
    return af.arrow_scan(t.spark, path, ["umi", "cbc", "umi_reads"])


@query("sql_text_functions", """SELECT read_id, reverse(translate(r2_seq, 'ACGTMKRYVBacgtvb', 'TGCAKMYRBVtgcabv')) AS rc, hamming(substr(r1_seq, 1, 10), substr(r1_seq, 11, 10)) AS apart,
  round(list_avg(list_transform(string_split(r1_qual, ''), lambda c: ascii(c) - 33)), 6) AS quality, round(length(regexp_replace(r2_seq, '[^GC]', '', 'g')) / length(r2_seq), 6) AS gc,
  len(list_distinct(list_transform(range(1, length(r2_seq) - 6), lambda i: substr(r2_seq, CAST(i AS BIGINT), 8)))) AS n_kmers,
  CASE WHEN regexp_matches(r2_seq, 'CATCTTAG.*?GACAGG') THEN regexp_extract(r2_seq, 'CATCTTAG(.*?)GACAGG', 1) END AS inner_seq FROM fx_reads""")
def sql_text_functions(t: Inputs) -> DataFrame:
    """A query in SQL text by the functions of ``functions.sql``."""
    sql_functions.register(t.spark)
    return t.spark.sql("""SELECT read_id, reverse_complement(r2_seq) AS rc, hamming(substr(r1_seq, 1, 10), substr(r1_seq, 11, 10)) AS apart, round(mean_quality(r1_qual), 6) AS quality,
        round(gc_share(r2_seq), 6) AS gc, size(array_distinct(kmers(r2_seq, 8))) AS n_kmers, between_anchors(r2_seq, 'CATCTTAG', 'GACAGG') AS inner_seq FROM {reads}""", reads=t.fx_reads)


@query("features_csv_scan", "SELECT concat(feature, '_', n_name) AS feature, seq, kind, 2 AS n_marks FROM fx_features, (SELECT n_name FROM nation) AS n WHERE kind = 'EDITED_TARGET'")
def features_csv_scan(t: Inputs) -> DataFrame:
    path = _folder(t, "features")
    t.fx_features.crossJoin(t.nation.select("n_name")).select(F.concat_ws("_", "feature", "n_name").alias("feature"), "seq", "left_flank", "right_flank", F.lit("ACTGT|TAAGT").alias("marks"), "kind").write.csv(path, header=True)
    return f.features_csv_scan(t.spark, path, ["EDITED_TARGET"]).select("feature", "seq", "kind", F.size("marks").alias("n_marks"))


@query("fasta_refs", "SELECT DISTINCT concat('mod_', CAST(cluster AS STRING), 'mer') AS mod, concat('ACGT', translate(spacer, 'T', 'G'), 'TTTT') AS seq FROM fx_mols")
def fasta_refs(t: Inputs) -> DataFrame:
    d = t.fx_mols.select("cluster", "spacer").distinct().withColumn("v", f.to_fasta(F.concat(F.lit("v"), F.col("cluster").cast("string"), F.lit("mer_x")), F.concat(F.lit("ccACGT"), F.lower(F.translate("spacer", "T", "G")), F.lit("TTTTcc"))))
    return f.fasta_refs(t.spark, _text(d, "v", _folder(t, "fasta")), "ACGT", "TTTT")


@query("to_fasta", "SELECT concat('>', read_id, chr(10), r2_seq) AS r2_seq_fasta FROM fx_reads")
def to_fasta(t: Inputs) -> DataFrame:
    return t.fx_reads.select(f.to_fasta("read_id", "r2_seq").alias("r2_seq_fasta"))


@query("to_fastq", "SELECT concat('@', read_id, chr(10), r1_seq, chr(10), '+', chr(10), r1_qual) AS r1_seq_fastq FROM fx_reads")
def to_fastq(t: Inputs) -> DataFrame:
    return t.fx_reads.select(f.to_fastq("read_id", "r1_seq", "r1_qual").alias("r1_seq_fastq"))


@query("summary_json_scan", "SELECT concat('run/', sample_id) AS sample_id, 'parse' AS step, '2024-01-01' AS timestamp, 'reads' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fx_mols GROUP BY sample_id")
def summary_json_scan(t: Inputs) -> DataFrame:
    path = _folder(t, "summaries") + "/run"
    d = t.fx_mols.groupBy("sample_id").agg(F.count("*").alias("n"))
    body = F.concat(F.lit('{"parse":{"timestamp":"2024-01-01","metrics":{"reads":'), F.col("n").cast("string"), F.lit('}},"skip":{"timestamp":"2024-01-02"}}'))
    d.select(F.col("sample_id").alias("s"), body.alias("value")).write.partitionBy("s").text(path)
    return f.summary_json_scan(t.spark, f"{path}/*/*").withColumn("sample_id", F.regexp_replace("sample_id", "s=", ""))


@query("chunked_sink", "SELECT umi, raw_ibar FROM fx_mols")
def chunked_sink(t: Inputs) -> DataFrame:
    path = _folder(t, "chunks")
    f.table_sink(t.fx_mols.select("umi", "raw_ibar"), path, 1000)
    return f.table_scan(t.spark, path)


@query("tabix_tsv_scan", "SELECT umi AS readid, CAST(umi_reads AS BIGINT) AS start, CAST(umi_reads + 1 AS BIGINT) AS \"end\", cbc, umi, seq, repeat('I', 20) AS qual FROM fx_mols")
def tabix_tsv_scan(t: Inputs) -> DataFrame:
    d = t.fx_mols.select(F.col("umi").alias("readid"), "umi_reads", (F.col("umi_reads") + 1).alias("e"), "cbc", "umi", "seq", F.repeat(F.lit("I"), F.lit(20)).alias("qual"))
    path = _folder(t, "tabix")
    d.write.option("sep", "\t").option("compression", "gzip").csv(path)
    return f.tabix_tsv_scan(t.spark, path)


@query("aligned_fasta_pairs", "SELECT concat('mm_h_', umi, '_', CAST(umi_reads AS STRING)) AS name, spacer AS ref_seq, seq AS read_seq, umi, umi_reads AS count FROM fx_mols")
def aligned_fasta_pairs(t: Inputs) -> DataFrame:
    name = F.concat_ws("_", F.lit("mm"), F.lit("h"), "umi", F.col("umi_reads").cast("string"))
    both = F.concat_ws("\n", f.to_fasta(name, F.lower("seq")), f.to_fasta(F.lit("ref"), "spacer"))
    return fq.aligned_fasta_pairs(t.spark, _text(t.fx_mols.withColumn("v", both), "v", _folder(t, "pairs")))


@query("counts_mtx_scan", "SELECT cbc, raw_ibar AS gene, count(*) AS count, 's1' AS sample_id FROM fx_mols GROUP BY 1, 2")
def counts_mtx_scan(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    folder = _folder(t, "mtx")
    n = t.fx_mols.groupBy("cbc", "raw_ibar").agg(F.count("*").alias("n"))
    lists = {"barcodes": ("cbc", F.concat("cbc", F.lit("-1"))), "features": ("raw_ibar", F.col("raw_ibar"))}
    for name, (col, shown) in lists.items():
        ids = n.select(col).distinct().select(F.row_number().over(Window.orderBy(col)).alias(name), col)  # a row a cell or gene
        ids.select(name, shown).write.option("sep", "\t").csv(f"{folder}/{name}")
        n = n.join(ids, col)
    n.select("features", "barcodes", "n").write.option("sep", " ").csv(f"{folder}/matrix")
    return f.counts_mtx_scan(t.spark, folder, "s1")


@query("barcode_list_scan", "SELECT DISTINCT cbc FROM fx_mols")
def barcode_list_scan(t: Inputs) -> DataFrame:
    d = t.fx_mols.select(F.concat("cbc", F.lit("-1")).alias("v")).distinct()
    return f.barcode_list_scan(t.spark, _text(d, "v", _folder(t, "barcodes")))


@query("run_summary_sink", "SELECT sample_id, 'parse' AS step, '2024-01-02' AS timestamp, CAST(count(*) AS DOUBLE) AS reads FROM fx_mols GROUP BY 1")
def run_summary_sink(t: Inputs) -> DataFrame:
    path = _folder(t, "runs")

    def rows(day: str) -> DataFrame:
        return t.fx_mols.groupBy("sample_id").agg(F.create_map(F.lit("reads"), F.count("*").cast("double")).alias("metrics")).select("sample_id", F.lit("parse").alias("step"), F.lit(day).alias("timestamp"), "metrics")

    f.run_summary_upsert(rows("2024-01-01"), rows("2024-01-02")).write.json(path)
    back = t.spark.read.schema("sample_id string, step string, timestamp string, metrics map<string,double>").json(path)
    return back.select("sample_id", "step", "timestamp", F.col("metrics")["reads"].alias("reads"))
