"""Sites and genes: containment, nearest gene, place relative to the gene, and coordinate liftover.

Containment is an equi-join on bins of positions with the range as a residual; the
nearest gene on each side is a sweep over the sorted union of sites and gene ends, in
tiles, as a chromosome may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions.expressions import clean_chromosome

BIN = 1 << 17
#: A site is its place.
SITE = "struct<chr:string,pos:bigint>"


def overlapping(sites: DataFrame, genes: DataFrame, bin_size: int = BIN) -> DataFrame:
    """All pairs of a site (``chr, pos`` and more) and a gene (``chr, start, end`` and more) that holds it, both ends included."""
    left = sites.withColumn("_bin", F.floor(F.col("pos") / bin_size))
    spans = F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))
    right = genes.where("start <= end").withColumn("_bin", F.explode(spans))
    return left.join(right, ["chr", "_bin"]).where((F.col("start") <= F.col("pos")) & (F.col("pos") <= F.col("end"))).drop("_bin")


def relation(pos: Column, start: Column, end: Column, strand: Column, promoter_upstream: int = 1500, proximal_cutoff: int = 200,
             promoter_downstream: int = 500, distal_promoter_max: int = 5000) -> Column:
    """A struct ``(relation, distance)`` of a site to a gene; a missing strand is ``+``. Up- and downstream follow the strand."""
    plus = F.coalesce(strand, F.lit("+")) == "+"
    tss = F.when(plus, start).otherwise(end)
    d = F.when(plus, pos - tss).otherwise(tss - pos)  # negative: upstream
    where = (F.when((pos >= start) & (pos <= end), "gene_body").when((d >= -proximal_cutoff) & (d <= 0), "proximal_promoter")
             .when((d > 0) & (d <= promoter_downstream), "promoter_downstream").when((d >= -promoter_upstream) & (d < -proximal_cutoff), "distal_promoter")
             .when((d >= -distal_promoter_max) & (d < -promoter_upstream), "distal_upstream").otherwise("intergenic"))
    return F.struct(where.alias("relation"), F.when(where == "gene_body", F.lit(0)).otherwise(F.abs(pos - tss)).cast("bigint").alias("distance_bp"))


def _beside(sites: DataFrame, genes: DataFrame, edge: str, after: bool) -> DataFrame:
    """For each site, the gene order of the nearest gene whose ``edge`` is before it (or after it), first in gene order on ties."""
    key = F.col("pos") if not after else -F.col("pos")
    place = F.col(edge) if not after else -F.col(edge)
    # Ties in the edge: the smallest gene order must be the last one seen.
    points = genes.groupBy("chr", place.alias("key")).agg(F.min("gene_ord").alias("gene_ord")).select("chr", "key", "gene_ord", F.lit(None).cast(SITE).alias("site"))
    asks = sites.select("chr", key.alias("key"), F.lit(None).cast("bigint").alias("gene_ord"), F.col("site"))
    both = points.unionByName(asks).withColumn("_tile", F.floor(F.col("key") / (1 << 22)))
    last = both.where("gene_ord is not null").groupBy("chr", "_tile").agg(F.max_by("gene_ord", "key").alias("_g"))
    tiles = both.select("chr", "_tile").distinct().join(last, ["chr", "_tile"], "left")
    carried = tiles.select("chr", "_tile", F.last("_g", ignorenulls=True).over(Window.partitionBy("chr").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    seen = F.last("gene_ord", ignorenulls=True).over(Window.partitionBy("chr", "_tile").orderBy("key", F.col("gene_ord").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    swept = both.withColumn("_seen", seen).where("site is not null").join(F.broadcast(carried), ["chr", "_tile"])
    return swept.select("site", F.coalesce("_seen", "_c").alias("gene_ord")).where("gene_ord is not null")


def map_to_genes(dms: DataFrame, genes: DataFrame, key: str = "probe_id", max_distance: int = 1_000_000, **cutoffs) -> DataFrame:
    """``dms`` (``key, chr, pos``) with ``nearest_gene, relation, distance_bp``.

    A gene that holds the site wins (the first in gene order of several); else the nearest by distance to its ends,
    the first in gene order on ties, if at most ``max_distance`` away; else no gene and ``intergenic``. On a
    chromosome without genes all three are null. ``genes``: ``gene_ord, chr, start, end, gene_symbol`` and maybe ``strand``.
    """
    if "strand" not in genes.columns:
        genes = genes.withColumn("strand", F.lit(None).cast("string"))
    genes = genes.select("gene_ord", clean_chromosome("chr").alias("chr"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "gene_symbol", "strand")
    rows = dms.withColumn("chr", clean_chromosome("chr"))
    sites = rows.select("chr", F.col("pos").cast("bigint").alias("pos")).distinct().withColumn("site", F.struct("chr", "pos"))
    held = overlapping(sites, genes).groupBy("site").agg(F.min("gene_ord").alias("gene_ord"))
    rest = sites.join(held, "site", "left_anti")
    near = _beside(rest, genes, "end", False).unionByName(_beside(rest, genes, "start", True))
    near = near.join(sites, "site").join(genes, ["chr", "gene_ord"])
    d = F.greatest(F.col("start") - F.col("pos"), F.col("pos") - F.col("end"))
    best = near.groupBy("site").agg(F.min(F.struct(d.alias("d"), "gene_ord")).alias("b")).where(F.col("b.d") <= max_distance).select("site", F.col("b.gene_ord").alias("gene_ord"))
    chosen = held.unionByName(best).join(genes.drop("chr"), "gene_ord")
    known = genes.select("chr").distinct().withColumn("_known", F.lit(True))
    out = rows.withColumn("site", F.struct("chr", F.col("pos").cast("bigint").alias("pos"))).join(chosen, "site", "left").join(F.broadcast(known), "chr", "left")
    r = relation(F.col("pos").cast("bigint"), F.col("start"), F.col("end"), F.col("strand"), **cutoffs)
    out = out.withColumn("_r", F.when(F.col("gene_ord").isNotNull(), r))
    return out.select(*dms.columns, F.col("gene_symbol").alias("nearest_gene"), F.coalesce("_r.relation", F.when(F.col("_known"), F.lit("intergenic"))).alias("relation"), F.col("_r.distance_bp").alias("distance_bp"))


def chain_blocks(lines: list[str]) -> list[tuple]:
    """``chr, start, end, to_chr, to_start, to_size, to_strand`` of the aligned blocks of a chain file's lines."""
    out, head = [], None
    for line in lines:
        part = line.split()
        if not part or part[0].startswith("#"):
            continue
        if part[0] == "chain":
            head = part
            here, there = int(part[5]), int(part[10])
            continue
        size = int(part[0])
        out.append((head[2], here, here + size, head[7], there, int(head[8]), head[9]))
        if len(part) == 3:
            here, there = here + size + int(part[1]), there + size + int(part[2])
    return out


def liftover(regions: DataFrame, blocks: DataFrame, chr_col: str = "chr", start_col: str = "start", end_col: str = "end") -> DataFrame:
    """``regions`` in other coordinates, with ``lifted``: both ends fall into blocks of one chromosome.

    ``blocks`` come from :func:`chain_blocks`; of several for a position, the first by target. Regions that can't
    be lifted keep null coordinates.
    """
    rows = regions.withColumn("_id", F.struct(chr_col, start_col, end_col))
    b = blocks.withColumn("chr", clean_chromosome("chr")).withColumn("end", F.col("end") - 1)

    def end_of(column: str, name: str) -> DataFrame:
        at = rows.select("_id", clean_chromosome(chr_col).alias("chr"), F.col(column).cast("bigint").alias("pos")).distinct()
        hit = overlapping(at, b)
        there = F.col("to_start") + F.col("pos") - F.col("start")
        there = F.when(F.col("to_strand") == "-", F.col("to_size") - 1 - there).otherwise(there)
        return hit.groupBy("_id").agg(F.min(F.struct(clean_chromosome("to_chr").alias("c"), there.alias("p"))).alias(name))

    both = rows.join(end_of(start_col, "_s"), "_id", "left").join(end_of(end_col, "_e"), "_id", "left")
    ok = F.coalesce(F.col("_s.c") == F.col("_e.c"), F.lit(False))
    others = [c for c in regions.columns if c not in (chr_col, start_col, end_col)]
    return both.select(F.when(ok, F.col("_s.c")).alias(chr_col), F.when(ok, F.least("_s.p", "_e.p")).alias(start_col), F.when(ok, F.greatest("_s.p", "_e.p")).alias(end_col), *others, ok.alias("lifted"))
