"""Command line: convert, filter, metrics, tile, gene, genescore, features, combine, doublets."""

from __future__ import annotations

import argparse
import glob
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import matrix, qc
from .session import LEVELS, local_session, set_verbosity
from .sources import formats, genomes

log = logging.getLogger("tessera")


def _paths(patterns: list[str]) -> list[str]:
    found = [p for x in patterns for p in (sorted(glob.glob(x)) or [x])]
    return list(dict.fromkeys(found))


def _bundle(x: DataFrame, path: str, obs: DataFrame | None = None, var: DataFrame | None = None) -> None:
    """Writes a matrix with all its cells and features, also those without a value, and what is known about them."""
    cells = x.select("cell").distinct() if obs is None else obs
    features = x.select("feature").distinct() if var is None else var
    formats.MatrixBundle(x, cells, features).write(path)


def _obs(spark: SparkSession, a: argparse.Namespace, cells: DataFrame) -> DataFrame:
    """The cells with their metrics, under the names that the matrix has."""
    if a.metrics:
        cells = cells.join(formats.read_metrics(spark, a.metrics), "barcode", "left")
    return _named(cells.withColumnRenamed("barcode", "cell"), a.prefix)


def _cells(spark: SparkSession, a: argparse.Namespace, frags: DataFrame) -> DataFrame:
    metrics = formats.read_metrics(spark, a.metrics) if a.metrics else None
    return qc.passing_cells(frags, metrics, a.query, a.min_fragments)


def _named(x: DataFrame, prefix: str | None) -> DataFrame:
    return qc.add_prefix(x, prefix, "cell")


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    if len(a.input) == 1 and a.output.endswith(".parquet"):
        formats.make_parquet(spark, a.input[0], a.output, separator=a.separator, prefix=a.prefix, partitions=a.partitions)
    else:
        formats.make_parquet_batch(spark, _paths(a.input), a.output, separator=a.separator, prefixes=a.prefix)


def metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    frags = formats.read_fragments(spark, a.input)
    tss = qc.tss_of(formats.read_transcripts(spark, a.annotation))
    sizes = genomes.sizes_frame(spark, a.genome) if a.genome else None
    formats.write_csv(qc.compute_metrics(frags, tss, a.window, a.smooth, a.min_fragments, sizes), a.output)


def filter_command(spark: SparkSession, a: argparse.Namespace) -> None:
    sizes = genomes.sizes_frame(spark, a.genome) if a.genome else None
    table = formats.read_metrics(spark, a.metrics) if a.metrics else None
    for path in _paths(a.input):
        out = a.output if len(a.input) == 1 and not a.output_dir else f"{a.output_dir or a.output}/{path.rstrip('/').rsplit('/', 1)[-1]}"
        kept = qc.filter_fragments(formats.read_fragments(spark, path), metrics=table, query=a.query, min_fragments=a.min_fragments, prefix=a.prefix, chrom_sizes=sizes)
        if kept.isEmpty():
            raise ValueError(f"no cell of {path} passes the filter")
        formats.write_fragments(kept, out)


def tile(spark: SparkSession, a: argparse.Namespace) -> None:
    sizes = genomes.sizes_frame(spark, a.genome)
    frags = formats.read_fragments(spark, a.input)
    cells = _cells(spark, a, frags)
    x = matrix.tile_matrix(frags, sizes, a.tile_size, a.min_fragments, tuple(a.exclude), a.strategy, cells)
    start = F.col("tile") * a.tile_size
    end = F.least(start + a.tile_size, F.col("size")).cast("string")
    named = x.join(F.broadcast(sizes), "chrom").select(F.col("barcode").alias("cell"), F.concat("chrom", F.lit(":"), start.cast("string"), F.lit("-"), end).alias("feature"), "value")
    tiles = matrix.tile_dimension(sizes, a.tile_size, tuple(a.exclude)).withColumnRenamed("name", "feature")
    _bundle(_named(named, a.prefix), a.output, _obs(spark, a, cells), tiles)


def gene(spark: SparkSession, a: argparse.Namespace) -> None:
    frags = formats.read_fragments(spark, a.input)
    domains = matrix.gene_domains(formats.read_transcripts(spark, a.annotation), a.upstream, a.downstream, not a.no_body)
    table = formats.read_metrics(spark, a.metrics) if a.metrics else None
    x = matrix.gene_matrix(frags, domains, a.min_fragments, table, a.query, tuple(a.exclude))
    genes = domains.groupBy(F.col("id").alias("feature")).agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"))
    known = frags.join(F.broadcast(domains.select("chrom").distinct()), "chrom", "left_semi")
    cells = _obs(spark, a, qc.passing_cells(known, table, a.query, a.min_fragments))
    _bundle(_named(x.select(F.col("barcode").alias("cell"), F.col("id").alias("feature"), "value"), a.prefix), a.output, cells, genes)


def genescore(spark: SparkSession, a: argparse.Namespace) -> None:
    frags = formats.read_fragments(spark, a.input)
    read = formats.read_gene_csv if a.annotation.endswith(".csv") else formats.read_genes
    genes = read(spark, a.annotation).filter(~F.col("chrom").isin(*a.exclude)) if a.exclude else read(spark, a.annotation)
    # Names that several genes share are told apart by their place.
    genes = matrix.unique_names(genes.withColumn("place", F.concat_ws(":", "chrom", F.col("lo").cast("string"))), key="place").drop("place")
    domains, cells = matrix.gene_score_domains(genes, use_tss=a.use_tss), _cells(spark, a, frags)
    x = matrix.gene_scores(frags, domains, model=a.model, cells=cells)
    named = _named(x.select(F.col("barcode").alias("cell"), F.col("symbol").alias("feature"), "value"), a.prefix)
    _bundle(named, a.output, _obs(spark, a, cells), genes.withColumnRenamed("symbol", "feature"))


def features(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [formats.MatrixBundle.read(spark, p) for p in _paths(a.input)]
    if len(parts) > 1:
        _bundle(matrix.select_features_multi([p.x for p in parts], a.n_features, a.filter_lower, a.filter_upper), a.output)
        return
    chosen = matrix.select_features(parts[0].x, a.n_features, a.filter_lower, a.filter_upper)
    formats.MatrixBundle(parts[0].x, parts[0].obs, parts[0].var.join(chosen, "feature", "left")).write(a.output)


def combine(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = _paths(a.input)
    parts = {p.rstrip("/").rsplit("/", 1)[-1]: formats.MatrixBundle.read(spark, p) for p in paths}
    first = next(iter(parts.values())).var.select("feature")
    for name, p in parts.items():
        other = p.var.select("feature")
        if not first.exceptAll(other).isEmpty() or not other.exceptAll(first).isEmpty():
            raise ValueError(f"the features of {name} differ from the first input's")
    x = matrix.combine({n: p.x for n, p in parts.items()})
    cells = None
    for n, p in parts.items():
        one = p.obs.withColumn("source_file", F.lit(n))
        cells = one if cells is None else cells.unionByName(one, allowMissingColumns=True)
    _bundle(x, a.output, cells, next(iter(parts.values())).var)


def doublets(spark: SparkSession, a: argparse.Namespace) -> None:
    frags = formats.read_fragments(spark, a.input)
    if a.genome:
        frags = frags.join(F.broadcast(genomes.sizes_frame(spark, a.genome).select("chrom")), "chrom", "left_semi")
    repeats = formats.read_bed(spark, a.repeats) if a.repeats else None
    out = qc.detect_doublets(frags, min_fragments=a.min_fragments, expected=a.expected, q_threshold=a.q_threshold, repeats=repeats)
    formats.write_csv(out, a.output or f"{a.input.rstrip('/')}.doublets")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--verbosity", default="info", choices=sorted(LEVELS))
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, many: bool = False, output: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("input", nargs="+" if many else None)
        c.add_argument("-o", "--output", required=output)
        c.add_argument("--prefix")
        return c

    def cells(c: argparse.ArgumentParser) -> None:
        c.add_argument("--min-fragments", type=int, default=100)
        c.add_argument("--metrics")
        c.add_argument("--query")
        c.add_argument("--exclude", nargs="*", default=[])

    c = add("convert", convert, many=True)
    c.add_argument("--separator", default="\t")
    c.add_argument("--partitions", type=int)
    c = add("metrics", metrics)
    c.add_argument("-a", "--annotation", required=True)
    c.add_argument("-g", "--genome")
    c.add_argument("--window", type=int, default=2000)
    c.add_argument("--smooth", type=int, default=11)
    c.add_argument("--min-fragments", type=int, default=100)
    c = add("filter", filter_command, many=True, output=False)
    cells(c)
    c.add_argument("-g", "--genome")
    c.add_argument("--output-dir")
    c = add("tile", tile)
    cells(c)
    c.set_defaults(exclude=list(matrix.EXCLUDED))
    c.add_argument("-g", "--genome", required=True)
    c.add_argument("--tile-size", type=int, default=5000)
    c.add_argument("--strategy", choices=("unique", "count", "binarize"), default="unique")
    c = add("gene", gene)
    cells(c)
    c.add_argument("-a", "--annotation", required=True)
    c.add_argument("--upstream", type=int, default=2000)
    c.add_argument("--downstream", type=int, default=0)
    c.add_argument("--no-body", action="store_true")
    c = add("genescore", genescore)
    cells(c)
    c.add_argument("-a", "--annotation", required=True)
    c.add_argument("--use-tss", action="store_true")
    c.add_argument("--model", default="exp(-abs(x)/5000) + exp(-1)")
    c = add("features", features, many=True)
    c.add_argument("-n", "--n-features", type=int, default=500000)
    c.add_argument("--filter-lower", type=float, default=0.005)
    c.add_argument("--filter-upper", type=float, default=0.005)
    add("combine", combine, many=True)
    c = add("doublets", doublets, output=False)
    c.add_argument("-g", "--genome")
    c.add_argument("--repeats")
    c.add_argument("--min-fragments", type=int, default=100)
    c.add_argument("--expected", type=int, default=2)
    c.add_argument("--q-threshold", type=float, default=0.01)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; user errors are logged and give 1."""
    a = parser().parse_args(args)
    set_verbosity(a.verbosity)
    try:
        a.run(spark or SparkSession.getActiveSession() or local_session(), a)
    except (ValueError, FileNotFoundError, OSError) as e:
        log.error("%s", e)
        return 1
    except Exception as e:
        if type(e).__name__ != "AnalysisException":
            raise
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
