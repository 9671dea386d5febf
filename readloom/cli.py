"""Run a script over a file of reads: ``python -m readloom.cli reads.fq -s script.mb``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from readloom.lang.compile import compile_script, of_kind
from readloom.lang.syntax import ScriptError, parse
from readloom.operators.aggregates import count_effect, mean_effect, report_counts, report_means
from readloom.operators.matching import MODES
from readloom.operators.relations import as_read, with_reverse_complement, zip_pairs
from readloom.sinks.files import print_lines, write_files
from readloom.sources import registry

STDIN_KINDS = ["fa", "fasta", "fq", "fastq", "sam", "bam", "csv", "tsv", "list", "txt"]


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description="Process sequencing reads with a script.")
    p.add_argument("reads", nargs="?", metavar="READS", help="file of reads; 'stdin' means FASTA on standard input")
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("-s", "--script-file", metavar="F.mb")
    one.add_argument("-r", "--run", metavar="CODE")
    p.add_argument("-f", "--stdin-format", choices=STDIN_KINDS, help="read standard input in this format")
    p.add_argument("-p", "--paired-with", metavar="FILE")
    p.add_argument("--with-reverse-complement", action="store_true")
    p.add_argument("-e", "--error", type=float, default=0.0, help="error rate of terms without one of their own")
    p.add_argument("-t", "--threads", type=int, default=1)
    p.add_argument("-a", "--args", help="'name = value, ...', seen by the script as args")
    p.add_argument("-o", "--output-directory", default=".")
    p.add_argument("-m", "--match-mode", choices=MODES, default="all")
    p.add_argument("--debug", action="store_true", help="print the script's tree and plans")
    return p


def reads_of(spark: SparkSession, path: str, kind: str | None = None, paired: str | None = None, both_strands: bool = False) -> DataFrame:
    """``_row_id, read`` of a file, of pairs, or of both strands (which tables don't have)."""
    kind = registry.FORMATS.get(kind, kind) or registry.format_of(path)
    rows = registry.scan(spark, path, kind)
    if paired:
        if registry.format_of(paired) != kind:
            raise ValueError("files of a pair have to be of one type")
        from pyspark.sql import functions as F

        return zip_pairs(rows, registry.scan(spark, paired, kind)).select("_row_id", F.struct("r1", "r2").alias("read"))
    reads = as_read(rows)
    return with_reverse_complement(reads) if both_strands and kind not in ("csv", "tsv") else reads


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    o, err = options().parse_args(argv), sys.stderr
    out = out or sys.stdout
    if o.paired_with and o.with_reverse_complement:
        print("error: --paired-with and --with-reverse-complement don't go together", file=err)
        return 1
    if o.script_file and not o.script_file.endswith(".mb"):
        print(f"error: {o.script_file}: a script's name ends in .mb", file=err)
        return 1
    if not o.reads and not o.stdin_format:
        print("error: name a file of reads, or a format for standard input", file=err)
        return 1
    script = open(o.script_file).read() if o.script_file else o.run
    own = spark is None
    spark = spark or SparkSession.builder.master(f"local[{max(1, o.threads)}]").appName("readloom").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        path, kind = o.reads, None
        if o.stdin_format or path == "stdin":
            kind = o.stdin_format or "fasta"
            path = registry.spool(kind)
        reads = reads_of(spark, path, kind, o.paired_with, o.with_reverse_complement)
        program = compile_script(spark, script, reads, args=o.args, error=o.error, mode=o.match_mode)
        if o.debug:
            print(parse(script), file=out)
            for name in ("stdout", "out", "count", "mean"):
                if (df := getattr(program, name)) is not None:
                    print(f"-- {name}\n{df._jdf.queryExecution().toString()}", file=out)
        finish(program, o.output_directory, registry.header(spark, path, kind), " ".join(argv or sys.argv[1:]), out)
        return 0
    except ScriptError as e:
        line = script.count("\n", 0, e.start) + 1
        print(f"error: {e.message}\n  line {line}, characters {e.start}-{e.end}: {script[e.start : e.end]}", file=err)
        return 1
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=err)
        return 1
    finally:
        if own:
            spark.stop()


def finish(program, folder: str, header: str = "", command: str = "", out=None) -> None:
    """Run the effects: lines in input order, then files, counts and means.  Several kinds are evaluated together, once a frame of the script, and kept until the last has been written."""
    out = out or sys.stdout
    kinds = [k for k in ("stdout", "out", "count", "mean") if getattr(program, k) is not None]
    events = program.events.persist(StorageLevel.MEMORY_AND_DISK) if len(kinds) > 1 else None
    rows = {k: getattr(program, k) if events is None else of_kind(events, k) for k in kinds}
    try:
        if "stdout" not in rows or not print_lines(rows["stdout"], ["_row_id", "_seq"], out):
            out.write("\n")
        if "out" in rows:
            write_files(rows["out"].select("filename", "_row_id", "_seq", "body"), folder, header, command)
        if "count" in rows:
            report_counts(count_effect(rows["count"]), folder, out)
        if "mean" in rows:
            report_means(mean_effect(rows["mean"]), folder, out)
    finally:
        if events is not None:
            events.unpersist()


if __name__ == "__main__":
    sys.exit(main())
