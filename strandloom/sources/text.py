"""Text sources of sequences and calls: PSMC-FASTA, VCF, and simulator output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bcf, blocks

def decode_symbols(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """(keys, win, ob): K is 1, N is -1, any other symbol 0."""
    symbols = rows.select(*keys, F.posexplode(F.split(sequence, "")).alias("_i", "_s")).filter("_s <> ''")
    ob = F.when(F.col("_s") == "K", 1).when(F.col("_s") == "N", -1).otherwise(0)
    return symbols.select(*keys, F.col("_i").cast("long").alias("win"), ob.cast("long").alias("ob"))


def psmcfa_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, record, contig, start, symbols): a file's lines, with their records by number and where in these they begin.

    Files are read in splits. A split's headers and symbols are counted by
    itself; with one row for each split, the counts of earlier splits and the
    end of their last header are carried to it. No task holds a file or record.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value"))
    head = F.startswith("value", F.lit(">"))
    rows = raw.withColumn("_head", head.cast("long")).withColumn("symbols", F.when(head, "").otherwise(F.regexp_replace("value", r"\s", "")))
    own = Window.partitionBy("file", "_at").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_records", F.sum("_head").over(own)).withColumn("_end", F.sum(F.length("symbols")).over(own))
    rows = rows.withColumn("_from", F.max(F.when(head, F.col("_end"))).over(own))
    splits = rows.groupBy(F.col("file").alias("_f"), F.col("_at").alias("_a")).agg(F.max("_records").alias("_r"), F.max("_end").alias("_e"), F.max("_from").alias("_h"))
    earlier = Window.partitionBy("_f").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0))
    splits = splits.select("_f", "_a", before("_r").alias("_r0"), before("_e").alias("_e0"), "_h").withColumn("_h0", F.max(F.col("_e0") + F.col("_h")).over(earlier)).drop("_h")
    met = rows.join(splits, (F.col("file") == F.col("_f")) & (F.col("_at") == F.col("_a")))
    start = F.col("_e0") + F.col("_end") - F.length("symbols") - F.coalesce(F.col("_e0") + F.col("_from"), F.col("_h0"))
    met = met.select("file", (F.col("_r0") + F.col("_records")).alias("record"), start.alias("start"), "symbols", "_head", "value")
    names = met.filter("_head = 1").select(F.col("file").alias("_f"), F.col("record").alias("_n"), F.regexp_extract("value", r"^>(\S+)", 1).alias("contig"))
    lines = met.filter("symbols <> ''").join(names, (F.col("file") == F.col("_f")) & (F.col("record") == F.col("_n")))
    return lines.select("file", "record", "contig", F.col("start").cast("long").alias("start"), "symbols")


def windows_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, win, ob) of lines (start, symbols)."""
    rows = decode_symbols(lines, [*keys, "start"], "symbols")
    return rows.select(*keys, (F.col("start") + F.col("win")).alias("win"), "ob")


def read_psmcfa(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, contig, win, ob): one record a contig."""
    return windows_of(psmcfa_lines(spark, paths), ["file", "contig"])


def vcf_lengths(spark: SparkSession, path: str) -> dict[str, int]:
    """The contigs of the header and their lengths; those without a length are left out."""
    if path.endswith(".bcf"):
        return bcf.read_head(path)[0].lengths
    if blocks.is_blocked(path):
        lines = spark.createDataFrame([(x,) for x in blocks.head_lines(path)], "value string")
    else:
        lines = spark.read.text(path)
    return {r.contig: r.length for r in header_lengths(lines).collect()}  # a row for each header line


def header_lengths(lines: DataFrame) -> DataFrame:
    """(contig, length) from the contig lines of a header."""
    part = lambda key: F.regexp_extract("value", rf"[<,]{key}=([^,>]+)", 1)
    rows = lines.filter(F.startswith("value", F.lit("##contig=<"))).select(part("ID").alias("contig"), part("length").try_cast("long").alias("length"))
    return rows.filter(F.col("length").isNotNull())


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """The samples of the header line, of which a file has one."""
    if path.endswith(".bcf"):
        return bcf.read_head(path)[0].samples
    if blocks.is_blocked(path):
        found = [x for x in blocks.head_lines(path) if x.startswith("#CHROM")]
        if not found:
            raise ValueError("the file has no header line")
        return found[0].split("\t")[9:]
    head = spark.read.text(path).filter(F.startswith("value", F.lit("#CHROM"))).first()
    if head is None:
        raise ValueError("the file has no header line")
    return head.value.split("\t")[9:]


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None, region: str | None = None) -> DataFrame:
    """calls(record, contig, pos, ref, alt, sample, a0, a1); a missing allele is null.

    region is contig:start-end and takes positions above start up to end. A
    haploid genotype has its one allele and a missing one. record tells the
    lines of the file apart, whose positions and alleles may repeat.

    A block-compressed file is read in splits, and with an index beside it a
    region reads only the blocks that the index has for it. A binary file
    (.bcf) is read through its index, or else by one task. Files compressed
    otherwise are one task's, plain ones are split.
    """
    header = vcf_samples(spark, path)
    wanted = header if samples is None else samples
    if not wanted or any(not isinstance(s, str) for s in wanted):
        raise ValueError("samples must be a list of names that is not empty")
    if absent := sorted(set(wanted) - set(header)):
        raise ValueError(f"samples not in the file: {', '.join(absent)}")
    within = None if region is None else parse_region(region)
    if path.endswith(".bcf"):
        return bcf.read_bcf(spark, path, wanted, within)
    lines = blocks.read_lines(spark, path, within) if blocks.is_blocked(path) else spark.read.text(path)
    return calls_of_lines(lines, header, wanted, within)


def calls_of_lines(lines: DataFrame, header: list[str], wanted: list[str], within: tuple[str, int, int] | None = None) -> DataFrame:
    """The wanted samples' calls in the data lines (value) of a file whose samples are header's."""
    fields = F.split("value", "\t")
    rows = lines.filter(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(F.monotonically_increasing_id().alias("record"), fields.alias("f"))
    rows = rows.select("record", F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), "f")
    if within is not None:
        contig, start, end = within
        rows = rows.filter((F.col("contig") == contig) & (F.col("pos") > start) & (F.col("pos") <= end))
    picked = F.array(*[F.struct(F.lit(s).alias("sample"), F.split(F.col("f")[9 + header.index(s)], ":")[0].alias("gt")) for s in wanted])
    long = rows.select("record", "contig", "pos", "ref", "alt", F.explode(picked).alias("x")).select("record", "contig", "pos", "ref", "alt", "x.sample", F.split("x.gt", r"[/|]").alias("g"))
    allele = lambda i: F.get("g", F.lit(i)).try_cast("int")
    return long.select("record", "contig", "pos", "ref", "alt", "sample", allele(0).alias("a0"), allele(1).alias("a1"))


def parse_region(region: str) -> tuple[str, int, int]:
    import re

    found = re.fullmatch(r"(\w+):(\d+)-(\d+)", region)
    if not found or int(found[2]) >= int(found[3]):
        raise ValueError(f"not a region, contig:start-end with start below end: {region}")
    return found[1], int(found[2]), int(found[3])


def read_simulated(spark: SparkSession, path: str) -> DataFrame:
    return parse_simulated(spark.read.text(path))


def parse_simulated(lines: DataFrame) -> DataFrame:
    """calls from the transposed text of a coalescent simulator, haplotypes paired as they stand."""
    rows = lines.select(F.split(F.trim("value"), r"\s+").alias("f"), "value")
    rows = rows.filter(F.regexp_like("value", F.lit(r"^\s*[0-9.]+\s+[0-9.eE+-]+(\s+[01])+\s*$")))
    genotype = F.slice("f", 3, F.size("f"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(genotype) / 2).cast("int") - 1), lambda i: F.struct(F.element_at(genotype, 2 * i + 1).cast("int").alias("a0"), F.element_at(genotype, 2 * i + 2).cast("int").alias("a1")))
    long = rows.select((1 + F.floor(F.col("f")[0].cast("double"))).cast("long").alias("pos"), F.posexplode(pairs).alias("sample", "g"))
    return long.select("pos", F.col("sample").cast("long").alias("sample"), "g.a0", "g.a1")


def vcf_lines(calls: DataFrame) -> DataFrame:
    """One data line for each site, its samples by number; for write.text."""
    genotype = F.concat_ws("|", F.coalesce(F.col("a0").cast("string"), F.lit(".")), F.coalesce(F.col("a1").cast("string"), F.lit(".")))
    sites = calls.groupBy("contig", "pos").agg(F.array_sort(F.collect_list(F.struct("sample", genotype.alias("gt")))).alias("_g"))
    fixed = [F.col("contig"), F.col("pos").cast("string"), *[F.lit(x) for x in (".", "A", "T", ".", "PASS", ".", "GT")]]
    return sites.select(F.concat_ws("\t", *fixed, F.array_join(F.transform("_g", lambda x: x["gt"]), "\t")).alias("value"))
