"""Command line: files or a stored session in, report, matrix, session and figure out."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from . import __version__, figure, report
from .session import Session, parse_files
from .sources import discovery, side_inputs

LOG = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("geneloom", description="Compares gene clusters.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("files", nargs="*", help="GenBank or GFF3 files, or folders of them")
    g = p.add_argument_group("input")
    g.add_argument("-r", "--ranges", nargs="+", help="scaffold:start-end; features outside are left out")
    g.add_argument("-gf", "--gene_functions", help="CSV file of gene,function")
    g.add_argument("-cm", "--colour_map", help="CSV file of function,colour")
    g.add_argument("-dso", "--dont_set_origin", action="store_true", help="leave circular records as they are")
    g.add_argument("-asc", "--as_separate_clusters", action="store_true", help="each record is a cluster")
    g = p.add_argument_group("alignment")
    g.add_argument("-na", "--no_align", action="store_true")
    g.add_argument("-i", "--identity", type=float, default=0.3, help="least identity of a link")
    g.add_argument("-j", "--jobs", type=int, default=0, help="cores of a local Spark, 0 for all")
    g = p.add_argument_group("output")
    g.add_argument("-s", "--session", help="JSON file: read if it is there, written otherwise or with new files")
    g.add_argument("-ji", "--json_indent", type=int)
    g.add_argument("-f", "--force", action="store_true", help="overwrite the report")
    g.add_argument("-o", "--output", help="report file")
    g.add_argument("-p", "--plot", nargs="?", const=True, default=False, help="figure page, or a local server without a path")
    g.add_argument("-dl", "--delimiter")
    g.add_argument("-dc", "--decimals", type=int, default=2)
    g.add_argument("-hl", "--hide_link_headers", action="store_true")
    g.add_argument("-ha", "--hide_aln_headers", action="store_true")
    g.add_argument("-mo", "--matrix_out", help="CSV file of the normalised distance matrix")
    g.add_argument("-ufo", "--use_file_order", action="store_true", help="clusters in input order in the figure")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> Session | None:
    """One comparison; None if there was nothing but an empty figure to make. SystemExit without usable files."""
    ranges = side_inputs.parse_ranges(args.ranges) if args.ranges else None
    functions = side_inputs.read_functions(spark, args.gene_functions) if args.gene_functions else None
    colours = side_inputs.read_colours(spark, args.colour_map) if args.colour_map else None
    stored = bool(args.session) and os.path.exists(args.session)
    paths = discovery.find_files(args.files)
    if not paths and (args.files or not stored):
        if args.plot and not args.files:
            figure.plot(figure.BLANK, None if args.plot is True else args.plot)
            return None
        LOG.error("no files found")
        raise SystemExit(1)
    session = Session.load(spark, args.session) if stored else Session(spark)
    if paths:
        session.add_clusters(parse_files(spark, paths, ranges, not args.dont_set_origin, args.as_separate_clusters))
        if not args.no_align:
            session.align(args.identity)
        session.build_groups(functions, colours)
    if session.alignments.isEmpty():
        LOG.info("no alignments were made")
    else:
        text = report.format_report(session, args.decimals, not args.hide_aln_headers, not args.hide_link_headers, args.delimiter)
        if not args.output:
            print(text)
        elif not report.write_text(text, args.output, args.force):
            print(text)
            LOG.warning("%s is there already; --force overwrites it", args.output)
        if args.matrix_out:
            report.write_text(report.format_matrix(session, normalise=True, as_distance=True), args.matrix_out, force=True)
    if args.session and (paths or not stored):
        session.save(args.session, args.json_indent)
    if args.plot:
        figure.plot_clusters(session, None if args.plot is True else args.plot, args.use_file_order)
    return session


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(levelname)s - %(message)s", datefmt="%H:%M:%S")
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("geneloom").config("spark.sql.session.timeZone", "UTC")
    if not os.environ.get("SPARK_REMOTE") and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master(f"local[{args.jobs or '*'}]").config("spark.sql.shuffle.partitions", str(args.jobs or os.cpu_count()))
    run(builder.getOrCreate(), args)


if __name__ == "__main__":
    main(sys.argv[1:])
