"""Registered queries over tree sequences and call files that Spark has written and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genealogy, het
from ..sources import adapters as A
from ..sources import blocks, text, trees
from ..sources.scratch import shared_folder
from .queries import SIZE
from .registry import query

FILE_SPAN = 1 << 16  # positions that a file of the written tree sequences holds
PAIRS = [(2 * i, 2 * i + 1) for i in range(A.HAPLOIDS // 2)]


def tree_files(spark, d) -> str:
    """Lineages and mutations as tree sequence files, one for each contig's spans."""
    name = lambda span: F.concat_ws("-", "contig", span)
    edges = genealogy.in_spans(A.lineages(spark, d), "contig", FILE_SPAN)
    rows = edges.select(name("span").alias("name"), F.lit("edge").alias("kind"), F.col("left").alias("a"), F.col("right").alias("b"), F.col("parent").cast("double").alias("c"), F.col("child").cast("double").alias("d"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("ancestral"))
    muts = A.mutations(spark, d).withColumn("span", F.floor(F.col("pos") / FILE_SPAN))
    rows = rows.union(muts.select(name("span"), F.lit("mutation"), F.col("pos").cast("double"), F.col("node").cast("double"), F.col("id").cast("double"), F.lit(None).cast("double"), "state", "ancestral"))
    folder = shared_folder(spark, "trees")
    trees.write_files(rows.withColumn("length", F.lit(float(A.sequence_length(spark, d)))), folder).agg(F.sum("bytes")).collect()
    return folder


def tree_counts(spark, d):
    folder = tree_files(spark, d)
    contig = F.substring_index(F.substring_index("file", "/", -1), "-", 1)  # of a name contig-span.trees
    edges, muts = (rows.withColumn("contig", contig).drop("file") for rows in (trees.edges_of(spark, folder), trees.mutations_of(spark, folder)))
    return genealogy.site_counts(edges, muts, PAIRS, "contig", FILE_SPAN)


@query("s10_tree_windows", f"""WITH RECURSIVE {A.LINES} SELECT x.contig, CAST(x.sample // 2 AS BIGINT) AS pair, CAST(x.pos // {SIZE} AS BIGINT) AS win, count(*) AS n_het
 FROM gt x JOIN gt y ON y.contig = x.contig AND y.pos = x.pos AND y.sample = x.sample + 1 WHERE x.sample % 2 = 0 AND x.allele <> y.allele GROUP BY 1, 2, 3""")
def s10_windows(spark, d):
    """Sites at which pairs differ, from edges and mutations of tree sequence files."""
    return genealogy.pair_differences(tree_counts(spark, d), "contig", SIZE)


@query("s10_tree_spectrum", f"""WITH RECURSIVE {A.LINES}, n AS (SELECT contig, pos, allele, count(*) AS k FROM gt WHERE allele <> 'A' GROUP BY 1, 2, 3)
 SELECT contig, k, count(*) AS n_sites FROM n WHERE k < {A.HAPLOIDS} GROUP BY 1, 2""")
def s10_spectrum(spark, d):
    return genealogy.spectrum(tree_counts(spark, d), A.HAPLOIDS, "contig")


GENOTYPES = f"g AS (SELECT o_orderkey, n.range AS nth, s.range AS sample, (o_custkey + s.range + n.range) % 2 AS a0, CASE WHEN (o_orderkey + s.range) % 11 = 0 THEN NULL ELSE (o_custkey // 3 + s.range) % 2 END AS a1 FROM orders, range(3) n, range(1, {A.SAMPLES + 1}) s WHERE n.range <= o_orderkey % 3)"


@query("a3_repeated_records", f"WITH {GENOTYPES}, r AS (SELECT o_orderkey, nth, CAST(sum(a0 + coalesce(a1, 0)) AS BIGINT) AS k FROM g GROUP BY 1, 2) SELECT '1' AS contig, k, count(*) AS n_sites FROM r WHERE k BETWEEN 1 AND {A.PLOIDS - 1} GROUP BY k")
def a3_repeated(spark, d):
    """The spectrum of a call file in which a position and its alleles stand on one, two or three lines."""
    key, sample = F.col("o_orderkey"), lambda i: F.lit(i)
    rows = A.table(spark, d, "orders").select(key, "o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), key % 3)).alias("nth"))
    side = lambda i: F.concat_ws("|", ((F.col("o_custkey") + sample(i) + F.col("nth")) % 2).cast("string"), F.when((key + sample(i)) % 11 == 0, ".").otherwise(((F.floor(F.col("o_custkey") / 3) + sample(i)) % 2).cast("string")))
    fixed = [F.lit("1"), (key * 10).cast("string"), *map(F.lit, (".", "A", "T", ".", ".", ".", "GT"))]
    lines = rows.select(F.concat_ws("\t", *fixed, *(side(i) for i in range(1, A.SAMPLES + 1))).alias("value"))
    names = [f"s{i}" for i in range(1, A.SAMPLES + 1)]
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    folder = shared_folder(spark, "vcf")
    lines.write.text(folder)
    spark.range(1).select(F.lit(head).alias("value")).write.mode("append").text(folder)
    return het.spectrum(text.read_vcf(spark, folder, names), A.PLOIDS)


@query("s2_indexed_region", f"""WITH {A.CALLS}, e AS (SELECT max(pos) // 4 AS lo, max(pos) * 3 // 4 AS hi FROM calls), s AS (SELECT DISTINCT contig, pos FROM calls, e WHERE contig = 'R' AND pos > lo AND pos <= hi)
 SELECT s.contig, s.pos, CAST(n.range AS VARCHAR) AS sample, CAST(a0 AS INT) AS a0, CAST(a1 AS INT) AS a1 FROM s CROSS JOIN range(1, {A.SAMPLES + 1}) n LEFT JOIN calls c ON c.contig = s.contig AND c.pos = s.pos AND c.sample = n.range""")
def s2(spark, d):
    """The middle half of a contig, from the blocks that the indexes of its files have for it."""
    calls = A.calls(spark, d)
    genotype = F.struct("sample", F.concat_ws("|", "a0", "a1").alias("gt"))
    sites = calls.groupBy("contig", "pos").agg(F.map_from_entries(F.collect_list(genotype)).alias("gt"))  # a sample has one call of a site
    names = [str(i) for i in range(1, A.SAMPLES + 1)]
    columns = [F.coalesce(F.col("gt")[F.lit(i).cast("long")], F.lit("./.")) for i in range(1, A.SAMPLES + 1)]
    value = F.concat_ws("\t", "contig", F.col("pos").cast("string"), *map(F.lit, (".", "A", "T", ".", ".", ".", "GT")), *columns)
    rows = sites.select(F.concat_ws("-", "contig", F.floor(F.col("pos") / FILE_SPAN)).alias("name"), "contig", "pos", value.alias("value"))
    head = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    folder = shared_folder(spark, "calls")
    blocks.write_call_files(rows, head, folder).agg(F.sum("bytes")).collect()
    end = calls.agg(F.max("pos").alias("n")).first().n or 0
    within = ("R", end // 4, end * 3 // 4)
    found = text.calls_of_lines(blocks.read_lines(spark, folder, within), names, names, within)
    return found.select("contig", "pos", "sample", "a0", "a1")
