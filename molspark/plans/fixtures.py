"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (base table, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "fx_reads": ("lineitem", """
SELECT concat(CAST(l_orderkey AS STRING),'-',CAST(l_partkey AS STRING),'-',CAST(l_suppkey AS STRING),'-',CAST(l_linenumber AS STRING)) AS read_id,
  concat(substr(translate(md5(concat('u',CAST(l_orderkey AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,12),
         substr(translate(md5(concat('s',CAST(l_orderkey % 4 AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,6),
         CASE WHEN l_linenumber = 5 THEN 'TTTTTTTTTTTTT' ELSE 'GGCACACTGTCCT' END) AS r1_seq,
  repeat('I', 31) AS r1_qual,
  concat('GAGACTGCATGG',
         substr(translate(md5(concat('i',CAST(l_orderkey % 50 AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,14),
         CASE WHEN l_linenumber = 3 THEN 'AGAAGCCGTGAGCCGGTCTA' ELSE 'AGAAGCCGTGTGCCGGTCTA' END,
         'CATCTTAGTCATTAC',
         CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ACTGT' WHEN 2 THEN 'TAAGT' ELSE 'AGGAA' END,
         'GACAGGTGTTCGTTG',
         CASE WHEN l_linenumber = 6 THEN '' WHEN l_linenumber = 7 THEN 'ATCGTGCGGACGAGACAGCAATCGTGCGGACGAGACAGCA' ELSE 'ATCGTGCGGACGAGACAGCA' END,
         'CAGACTGAGCACG',
         CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'CTATC' ELSE 'CGATT' END,
         'ACTTGGCAGAGGAAAGGAAGCCCTGCTTCCTCCAGA',
         'AATCCTAGCACCGGTTCGCC',
         'TTTAGTGAGGGT') AS r2_seq
FROM lineitem
"""),
    "fx_mols": ("lineitem", """
SELECT concat('S',CAST(l_suppkey % 4 AS STRING)) AS sample_id,
  substr(translate(md5(concat('c',CAST(l_orderkey % 200 AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,16) AS cbc,
  substr(translate(md5(concat('m',CAST(l_orderkey AS STRING),'-',CAST(l_partkey AS STRING),'-',CAST(l_linenumber AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,10) AS umi,
  substr(translate(md5(concat('i',CAST(l_partkey % 40 AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,6) AS raw_ibar,
  substr(translate(md5(concat('p',CAST(l_partkey % 40 AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,20) AS spacer,
  CASE WHEN l_returnflag = 'N' THEN substr(translate(md5(concat('p',CAST(l_partkey % 40 AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,20)
       ELSE substr(translate(md5(concat('e',CAST(l_partkey % 40 AS STRING),'-',CAST(l_orderkey % 5 AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,20) END AS seq,
  l_returnflag = 'N' AS wt,
  CAST(l_quantity AS INT) AS umi_reads,
  CAST(ceil(l_quantity * 0.8) AS INT) AS umi_dom_reads,
  CAST(l_partkey % 3 AS INT) + 1 AS cluster,
  CASE WHEN l_orderkey % 10 = 0 THEN 'doublet' ELSE 'singlet' END AS doublet_prediction
FROM lineitem
"""),
    "fx_plates": ("part", """
SELECT CAST(floor(p_partkey / 24) AS BIGINT) AS plate, concat('PO_',CAST(p_partkey AS STRING),'_x') AS id,
  CASE WHEN p_partkey % 2 = 0 THEN 'i5' ELSE 'i7' END AS primer_end,
  concat('aatgatacggcgaccaccga',lower(substr(translate(md5(concat('x',CAST(p_partkey AS STRING))),'0123456789abcdef','ACGTACGTACGTACGT'),1,8)),'acactctttccctacacgac') AS seq
FROM part
"""),
    "fx_cigar": ("lineitem", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  concat(CAST(10 + l_linenumber AS STRING),'M',CAST(1 + l_orderkey % 3 AS STRING),CASE WHEN l_orderkey % 2 = 0 THEN 'D' ELSE 'I' END,'20M') AS cigar_str
FROM lineitem
"""),
    "fx_tree_alleles": ("orders", """
SELECT concat('t',CAST(CAST(floor(o_custkey / 64) AS BIGINT) AS STRING)) AS tree_id, concat('n',CAST(64 + o_custkey % 64 AS STRING)) AS leaf,
  concat('r',CAST(1 + o_orderkey % 6 AS STRING)) AS site,
  min_by(CAST(floor(o_totalprice) AS BIGINT) % 4 - 1, o_orderkey) AS state FROM orders GROUP BY 1,2,3
"""),
    "fx_tree_edges": ("customer", """
SELECT DISTINCT tree_id, concat('n',CAST(CAST(floor(node / 2) AS BIGINT) AS STRING)) AS parent, concat('n',CAST(node AS STRING)) AS child
FROM (SELECT concat('t',CAST(CAST(floor(c_custkey / 64) AS BIGINT) AS STRING)) AS tree_id, CAST(floor((64 + c_custkey % 64) / d) AS BIGINT) AS node
  FROM customer CROSS JOIN (VALUES (1),(2),(4),(8),(16),(32)) AS up(d)) AS e
"""),
    "fx_features": ("", """
SELECT * FROM (VALUES
  (1,'META01','AGAAGCCGTGTGCCGGTCTA','','','META'),
  (2,'META02','ATCGTGCGGACGAGACAGCA','','','META'),
  (3,'META03','AATCCTAGCACCGGTTCGCC','','','META'),
  (4,'RNF2','CATCTTAGTCATTACGACAGGTGTTCGTTG','CATCTTAGTCATTAC','GACAGGTGTTCGTTG','EDITED_TARGET'),
  (5,'HEK3','CAGACTGAGCACGACTTGGCAGAGGAAAGGAAGCCCTGCTTCCTCCAGA','CAGACTGAGCACG','ACTTGGCAGAGGAAAGGAAGCCCTGCTTCCTCCAGA','EDITED_TARGET')
) AS t(ord, feature, seq, left_flank, right_flank, kind)
"""),
    "fx_long": ("lineitem", """
SELECT read_id AS name,
  CASE WHEN right(read_id, 1) IN ('2', '4') THEN reverse(translate(concat(r1_seq, r2_seq), 'ACGT', 'TGCA')) ELSE concat(r1_seq, r2_seq) END AS sequence,
  substr(repeat(md5(read_id), 12), 1, length(r1_seq) + length(r2_seq)) AS quality_scores
FROM ({fx_reads}) AS r
"""),
    "fx_guides": ("lineitem", """
SELECT concat('S', CAST(l_suppkey % 4 AS STRING)) AS sample_id,
  substr(translate(md5(concat('c', CAST(l_orderkey % 200 AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) AS cbc,
  substr(translate(md5(concat('m', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 10) AS umi,
  concat('ACTG', CASE WHEN l_linenumber = 2 THEN 'TTTCTTATATCGG' ELSE 'TTTCTTATATGGG' END,
    CASE WHEN l_returnflag = 'N' THEN substr(translate(md5(concat('p', CAST(l_partkey % 40 AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 20)
      ELSE substr(translate(md5(concat('e', CAST(l_partkey % 40 AS STRING), '-', CAST(l_orderkey % 5 AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 18) END,
    'GGGTTAGAGCTAGA', substr(translate(md5(concat('i', CAST(l_partkey % 40 AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6),
    'AATAGCAAGTTAACCTAAGGCTAGTCCGTTATCAACTTGAAAAAG') AS seq
FROM lineitem
"""),
    "fx_segments": ("lineitem", """
SELECT CAST(l_orderkey AS STRING) AS umi, concat('META0', CAST(1 + l_linenumber % 3 AS STRING)) AS start_meta,
  concat('META0', CAST(1 + (l_linenumber + 1 + l_suppkey % 2) % 3 AS STRING)) AS end_meta,
  concat(CASE l_linenumber % 3 WHEN 0 THEN 'AGAAGCCGTGTGCCGGTCTA' WHEN 1 THEN 'ATCGTGCGGACGAGACAGCA' ELSE 'AATCCTAGCACCGGTTCGCC' END,
    'CATCTTAGTCATTAC', CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ACTGT' WHEN 2 THEN 'TAAGT' ELSE 'AGGAA' END, 'GACAGGTGTTCGTTG',
    substr(translate(md5(concat('g', CAST(l_partkey % 7 AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(5 + l_partkey % 7 AS INT)),
    CASE (l_linenumber + 1 + l_suppkey % 2) % 3 WHEN 0 THEN 'AGAAGCCGTGTGCCGGTCTA' WHEN 1 THEN 'ATCGTGCGGACGAGACAGCA' ELSE 'AATCCTAGCACCGGTTCGCC' END) AS segment_seq
FROM lineitem
"""),
}


def sql_of(name: str) -> str:
    """The view's SQL with the views that it reads put in."""
    sql = VIEWS[name][1].strip()
    for other in VIEWS:
        sql = sql.replace("{" + other + "}", VIEWS[other][1].strip())
    return sql


def oracle(sql: str) -> str:
    """``sql`` with the views that it names in front."""
    used = [n for n in VIEWS if n in sql]
    views = ", ".join(f"{n} AS ({sql_of(n)})" for n in used)
    if not used:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql[15:]}"
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"


#: A table up to this size is dealt to all cores: it may be one row group, and so one task, and dealing it costs little.  Larger ones Spark splits itself.
SMALL_BYTES = 64 << 20


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; one of at most SMALL_BYTES, by the statistics of its plan, is dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = VIEWS[name][0]
    if base:
        base_table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(sql_of(name))
