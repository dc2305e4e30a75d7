"""Cross-site boilerplate lines by distinct-site spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: A line of so many words or more needs so many sites: short lines recur by chance, long passages do not.
TIERS = ((0, 10), (3, 5), (50, 3))


def sites_needed(line: Column, tiers: tuple[tuple[int, int], ...] = TIERS) -> Column:
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    needed = F.lit(tiers[0][1])
    for least, sites in tiers[1:]:
        needed = F.when(words >= least, sites).otherwise(needed)
    return needed


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str, tiers: tuple[tuple[int, int], ...] = TIERS) -> DataFrame:
    """Each line that is not blank: its document, position, hashes, site, and how many sites make it boilerplate.

    A document is known by id and text hash, so rows that share an id but not a
    text are kept apart. A line is known by two hashes, 96 bits together.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("doc_hash"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    rows = rows.filter(F.trim("line") != "")
    return rows.select("doc", "doc_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), sites_needed(F.col("line"), tiers).alias("needed"))


def boilerplate(lines: DataFrame, margin: float = 0.3, lg_k: int = 12) -> DataFrame:
    """(h1, h2, first): lines on as many sites as they need, or more, and where each is first.

    HyperLogLog sketches of the sites are built for each line and merged by
    aggregation, before and after the shuffle. Estimates at least `margin` above
    the threshold are boilerplate, and those as far below are not; the margin is
    many standard errors of a sketch of 2 ** lg_k registers. The lines between
    get exact distinct counts, from (line, site) pairs aggregated first.
    """
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")
    first = F.min(F.struct("doc", "doc_hash", "pos")).alias("first")
    spread = lines.groupBy("h1", "h2").agg(sketch, F.count("site").alias("n"), first, F.max("needed").alias("needed"))
    spread = materialize(spread.filter(F.col("n") >= F.col("needed")).filter(F.col("sites") > F.col("needed") * (1 - margin)), "spread")
    sure = spread.filter(F.col("sites") >= F.col("needed") * (1 + margin))
    near = spread.filter(F.col("sites") < F.col("needed") * (1 + margin)).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first", F.col("needed").alias("_needed"))
    seen = lines.filter("site is not null").groupBy("h1", "h2", "site").agg(F.count(F.lit(1)).alias("_"))
    exact = seen.join(near.select("_h1", "_h2"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left_semi")
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("sites"))
    exact = exact.join(near, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(F.col("sites") >= F.col("_needed"))
    return sure.select("h1", "h2", "first").union(exact.select("h1", "h2", "first"))


def without_boilerplate(docs: DataFrame, tiers: tuple[tuple[int, int], ...] = TIERS, margin: float = 0.3, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", spread: int = 16, counts: bool = True) -> DataFrame:
    """docs with its columns, the text cleaned, and n_lines, n_removed after them.

    A line, as it stands between line feeds, is boilerplate if it occurs on as
    many distinct sites as lines of its length need, or more. It is removed
    wherever it stands but at its first place, by id and position, so that no
    content is lost from the whole. Blank lines stay. The join on lines salts
    the hot ones `spread` ways.

    A null text stays null, without lines; a null site is no site; a text of any
    length is one of its lines' documents. Rows with equal id and text get equal
    results. Documents keep their other columns, whatever their names; n_lines
    and n_removed replace columns of those names, and without `counts` they are
    left out and such columns kept. An empty table gives an empty result.
    """
    lines = materialize(line_table(docs, id_col, text_col, site_col, tiers), "lines")
    common = boilerplate(lines, margin).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_s"))
    salt = F.pmod(F.xxhash64("doc", "doc_hash", "pos"), F.lit(spread)).cast("int")
    hits = lines.withColumn("_salt", salt).join(common, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("_salt") == F.col("_s")))
    own = F.struct("doc", "doc_hash", "pos")
    gone = hits.filter(~own.eqNullSafe(F.col("first"))).groupBy(F.col("doc").alias("_doc"), F.col("doc_hash").alias("_hash")).agg(F.collect_set("pos").alias("_gone"))
    # the input's columns in one, so that no name clashes
    whole = docs.select(F.struct(*docs.columns).alias("_in"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    whole = whole.withColumn("_text_hash", F.xxhash64(F.coalesce("_text", F.lit(""))))
    met = whole.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left")
    text = F.col("_text")
    parts = F.split(text, "\n", -1)
    cleaned = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n"))
    added = {"n_lines": F.size(F.filter(parts, lambda x: F.trim(x) != "")), "n_removed": F.size("_gone")} if counts else {}
    none = {"n_lines": text, "n_removed": F.col("_gone")}
    kept = [cleaned.alias(c) if c == text_col else F.col("_in")[c].alias(c) for c in docs.columns if c not in added]
    return met.select(*kept, *[F.when(none[k].isNull(), 0).otherwise(v).cast("long").alias(k) for k, v in added.items()])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
s AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM d),
l AS (SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
f AS (SELECT * FROM l WHERE trim(line, ' ') <> ''),
b AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM f GROUP BY line
      HAVING count(DISTINCT source) >= CASE WHEN len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 THEN 3 WHEN len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3 THEN 5 ELSE 10 END),
m AS (SELECT l.doc_id, l.pos, l.line, trim(l.line, ' ') <> '' AS counted, b.line IS NOT NULL AND {'d': l.doc_id, 'p': l.pos} <> b.first AS gone
      FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, CAST(count(*) FILTER (counted) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM m GROUP BY doc_id
"""
