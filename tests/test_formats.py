"""Formats: what is written is what is read."""

import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

from readloom.sinks import files
from readloom.sources import bam, registry, text
from readloom.sources.text import SAM_COLUMNS


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("_row_id").select(*columns).collect()]


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">r1 an x > y\nACG\nTT\n>r2\n\n>r3\tq\r\nA\r\nC\r\n")
    assert rows(registry.scan(spark, str(p)), "_row_id", "id", "desc", "seq") == [(0, "r1", "an x > y", "ACGTT"), (1, "r2", "", ""), (2, "r3", "q", "AC")]
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(p.read_bytes()))
    assert rows(registry.scan(spark, str(tmp_path / "a.fa.gz")), "id", "seq") == [("r1", "ACGTT"), ("r2", ""), ("r3", "AC")]


def test_fastq_over_many_partitions(spark, tmp_path):
    want = [(f"r{i}", f"d {i}", "ACGTN"[: i % 6] * 3, "@+>I#"[: i % 6] * 3) for i in range(700)]
    p = tmp_path / "a.fq"
    p.write_text("".join(f"@{i} {d}\n{s}\n+\n{q}\n" for i, d, s, q in want))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        df = text.fastq(spark, str(p))
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 10
        assert rows(df, "_row_id", "id", "desc", "seq", "qual") == [(i, *w) for i, w in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def split_small(spark, size):
    for key, value in (("spark.sql.files.maxPartitionBytes", size), ("spark.sql.files.openCostInBytes", "1b")):
        spark.conf.set(key, value)


def test_a_folder_of_split_files_is_read_in_order(spark, tmp_path):
    """Files of unlike sizes, whose splits Spark would take by size."""
    want, n = [], 0
    for k, records in enumerate((300, 900, 40, 500)):
        own = [(f"r{n + i}", "ACGTN"[: (n + i) % 6] * 7, "@+>I#"[: (n + i) % 6] * 7) for i in range(records)]
        (tmp_path / f"part-{k}.fq").write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in own))
        want += own
        n += records
    (tmp_path / "a.fa").write_text("".join(f">{i}\n{s}\n" for i, s, _ in want))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    split_small(spark, "9000b")
    try:
        df = text.fastq(spark, f"{tmp_path}/*.fq")
        assert rows(df, "_row_id", "id", "seq", "qual") == [(i, *w) for i, w in enumerate(want)]
        pair = text.fasta(spark, f"{tmp_path}/a.fa")
        assert [tuple(r) for r in df.alias("x").join(pair.alias("y"), "_row_id").where("x.id <> y.id or x.seq <> y.seq").collect()] == []
        stale = text.lines(spark, f"{tmp_path}/*.fq")
        split_small(spark, "5000b")  # splits that weren't counted are an error, not another number
        with pytest.raises(Exception, match="split otherwise"):
            stale.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_splits_do_not_follow_the_parallelism(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(5000)))
    df = text.lines(spark, str(tmp_path / "a.txt"))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "37")
    try:
        assert rows(df, "seq") == [(str(i),) for i in range(5000)] and spark.conf.get("spark.sql.files.minPartitionNum")
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_a_broken_fastq_aborts(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r\nACG\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        text.fastq(spark, str(tmp_path / "a.fq")).collect()


SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\nq1\t99\tchr1\t7\t60\t3M1I4M\t=\t100\t-42\tACGTNACG\tIIIIHHHH\tNM:i:1\tXA:Z:a b\tXF:f:1.5\tXB:B:c,1,-2\tXC:A:k\nq2\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*\n"


def test_sam_and_bam(spark, tmp_path):
    p = tmp_path / "a.sam"
    p.write_text(SAM)
    assert text.sam_header(spark, str(p)) == SAM[: SAM.index("q1")]
    df = registry.scan(spark, str(p))
    got = rows(df, *SAM_COLUMNS)
    assert got[0] == ("q1", 99.0, "chr1", 7.0, 60.0, "3M1I4M", "=", 100.0, -42.0, "ACGTNACG", "IIIIHHHH", "NM:i:1\tXA:Z:a b\tXF:f:1.5\tXB:B:c,1,-2\tXC:A:k")
    assert got[1][4] == -1.0 and got[1][11] == "" and rows(df, "id", "desc")[0] == ("q1", got[0][11])

    read = F.struct(*SAM_COLUMNS)
    kind = df.select(read).schema[0].dataType
    out = df.select(F.explode(F.array(F.lit("o.sam"), F.lit("o.bam"))).alias("filename"), "_row_id", files.as_sam(read, kind).alias("body"))
    files.write_files(out, str(tmp_path), text.sam_header(spark, str(p)), "cmd")
    lines = (tmp_path / "o.sam").read_text().splitlines()
    assert lines[3].startswith("@PG\tID:readloom\t") and lines[4:] == SAM.splitlines()[3:]
    again = registry.scan(spark, str(tmp_path / "o.bam"))
    want = [(*g[:6], "chr1" if g[6] == "=" else g[6], *g[7:]) for g in got]
    assert rows(again, *SAM_COLUMNS) == want
    assert registry.header(spark, str(tmp_path / "o.bam")).startswith("@HD")


def test_bam_errors():
    with pytest.raises(ValueError, match="bad tag"):
        bam.encode(dict.fromkeys(SAM_COLUMNS, "*") | {"flag": 0, "pos": 0, "mapq": 0, "pnext": 0, "tlen": 0, "tags": "XX:Q:1"}, {})
    with pytest.raises(ValueError, match="doesn't name"):
        bam.encode(dict.fromkeys(SAM_COLUMNS, "*") | {"flag": 0, "pos": 0, "mapq": 0, "pnext": 0, "tlen": 0, "tags": "", "rname": "chr9"}, {})
    with pytest.raises(ValueError, match="not a BAM"):
        bam.read_header(io.BytesIO(b"abcd"))
    data = io.BytesIO()
    bam.write(data, "@SQ\tSN:c\tLN:5\n", [])
    assert data.getvalue().endswith(bam.END_BLOCK)


def test_tables_are_strings_and_ragged_rows_abort(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,\n2,x\n")
    assert rows(registry.scan(spark, str(tmp_path / "t.csv")), "a", "b") == [("1", ""), ("2", "x")]
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert registry.field_types(spark, str(tmp_path / "t.tsv")) == {"a": "Str", "b": "Str"}
    (tmp_path / "r.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        registry.scan(spark, str(tmp_path / "r.csv")).collect()


def test_file_types():
    assert registry.format_of("x/y.fastq.gz") == "fastq" and registry.format_of("a.b.sam") == "sam"
    with pytest.raises(ValueError):
        registry.format_of("reads")
    path = registry.spool("fa", io.BytesIO(b">r\nA\n"))
    assert path.startswith("file://") and path.endswith("stdin.fa")


def test_partitioned_output(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", 1, "x"), ("b.txt", 0, "y"), ("a.txt", 0, "z")], "filename string, _row_id long, body string")
    files.write_partitioned(df.coalesce(1), f"{tmp_path}/o")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/o/filename=a.txt").collect()] == ["z", "x"]


def test_streamed_counts(spark, tmp_path):
    from readloom.streaming.watch import fasta_stream, route, running_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\nAC\nG\n>b\nACG\n")
    (tmp_path / "in" / "b.fa").write_text(">c\nT\n")
    stream = fasta_stream(spark, str(tmp_path / "in"))
    q = running_counts(stream, F.col("seq")).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("seen").collect()) == [("ACG", 2), ("T", 1)]
    got = []
    route(stream, str(tmp_path / "ck"), lambda df, _: got.extend(r["id"] for r in df.collect())).awaitTermination()
    assert sorted(got) == ["a", "b", "c"]


def test_names_stay_in_the_folder(spark, tmp_path):
    (tmp_path / "out").mkdir()
    put = lambda name: files.write_files(spark.createDataFrame([(name, 0, "x")], "filename string, _row_id long, body string"), str(tmp_path / "out"))
    put("a/../b.txt")
    put("sub/c.txt")
    for bad in ("../x.txt", "a/../../x.txt", "/x.txt", "", "sub/"):
        with pytest.raises(Exception, match="isn't the name of a file"):
            put(bad)
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.txt")) == ["out/b.txt", "out/sub/c.txt"]


def test_streams_of_all_text_formats(spark, tmp_path):
    from pyspark.sql import functions as F

    from readloom.streaming import watch

    for kind, first, second in (("fq", "@a x\nACG\n+\nIII\n@b\n\n+\n\n", "@c y z\r\nTT\r\n+\r\n@@\r\n"), ("sam", SAM, "q9\t0\tchr1\t1\t9\t1M\t*\t0\t0\tA\tI\n"), ("fa", ">a x\nAC\nGT\n>b\nT\n", ">c\nG\n")):
        folder = tmp_path / kind
        folder.mkdir()
        (folder / "1").write_bytes(first.encode())
        (folder / "2").write_bytes(second.encode())
        stream = {"fq": watch.fastq_stream, "sam": watch.sam_stream, "fa": watch.fasta_stream}[kind](spark, str(folder), 1)
        got = []
        watch.route(stream, str(tmp_path / f"{kind}-state"), lambda df, n, got=got: got.extend(map(tuple, df.select("id", "seq").collect()))).awaitTermination()
        assert sorted(got) == {"fq": [("a", "ACG"), ("b", ""), ("c", "TT")], "sam": [("q1", "ACGTNACG"), ("q2", "*"), ("q9", "A")], "fa": [("a", "ACGT"), ("b", "T"), ("c", "G")]}[kind]
    stream = watch.fasta_stream(spark, str(tmp_path / "fa"), 1).select(F.concat("id", F.lit(".txt")).alias("filename"), F.lit(0).alias("_row_id"), F.col("seq").alias("body"))
    watch.route(stream, str(tmp_path / "out-state"), watch.files_of_batches(str(tmp_path / "out"))).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.txt")) == ["a.txt", "b.txt", "c.txt"] and len(list((tmp_path / "out").iterdir())) == 2


def test_files_by_name_on_any_file_system(spark, tmp_path):
    """By Spark's writer alone, as where tasks can't open paths; the same files as by path."""
    rows = [(f"{'sub/' * (i % 2)}x y={i % 3}.txt", i, f"line {i}") for i in range(40)] + [("a.sam", i, f"q{i}\t0\tchr1\t1\t9\t1M\t*\t0\t0\tA\tI") for i in range(3)]
    df = spark.createDataFrame(rows, "filename string, _row_id long, body string").repartition(3)
    for folder, write in (("one", lambda f: files.write_files(df, f, SAM[: SAM.index("q1")])), ("two", lambda f: files.write_anywhere(df, f"file://{f}", SAM[: SAM.index("q1")]))):
        (tmp_path / folder).mkdir()
        write(str(tmp_path / folder))
    content = lambda folder: {str(p.relative_to(tmp_path / folder)): p.read_text() for p in (tmp_path / folder).rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert content("one") == content("two") and len(content("two")) == 7
    assert text.sam_header(spark, str(tmp_path / "two" / "a.sam")).endswith("PN:readloom\n")
    for bad in ("../x.txt", "a/../x.txt", "/x", "", "b/", "c.bam", None):
        with pytest.raises(Exception, match="isn't the name of a file"):
            files.write_anywhere(spark.createDataFrame([(bad, 0, "x")], "filename string, _row_id long, body string"), f"file://{tmp_path}/two")
    assert content("one") == content("two")


def test_the_command_line_reads_standard_input(spark, monkeypatch, capsys):
    from types import SimpleNamespace

    from readloom import cli

    for kind, data in (("fasta", b">r1 d\nACGT\n>r2\nGG\n"), ("fastq", b"@r1 d\nACGT\n+\nIIII\n@r2\n\n+\n\n"), ("sam", SAM.encode())):
        monkeypatch.setattr("sys.stdin", SimpleNamespace(buffer=io.BytesIO(data)))
        assert cli.main(["-f", kind, "-r", "read.id.stdout!()"], spark) == 0
        assert capsys.readouterr().out.split() == {"sam": ["q1", "q2"]}.get(kind, ["r1", "r2"])


def test_ranges_of_an_alignment_file_are_read_apart(spark, tmp_path):
    import random

    rng = random.Random(2)
    header = "@SQ\tSN:chr1\tLN:100000\n@SQ\tSN:chr2\tLN:100000\n"
    lines = []
    for i in range(4000):
        n = rng.randint(0, 300) if i % 500 else 90_000  # records over several blocks, too
        seq = "".join(rng.choice("ACGTN") for _ in range(n)) or "*"
        lines.append({"qname": f"q{i}", "flag": "0", "rname": rng.choice(["chr1", "chr2", "*"]), "pos": str(rng.randint(1, 9999)), "mapq": "60", "cigar": f"{n}M" if n else "*", "rnext": "*", "pnext": "0", "tlen": "0", "seq": seq, "qual": "".join(chr(rng.randint(34, 70)) for _ in seq) if n else "*", "tags": f"NM:i:{i}"})
    with open(tmp_path / "a.bam", "wb") as f:
        bam.write(f, header, lines)
    assert (tmp_path / "a.bam").stat().st_size > 700_000
    want = [(i, x["qname"], x["seq"], x["qual"], x["tags"]) for i, x in enumerate(lines)]
    for size in (100_000, 1 << 30):
        df = bam.bam(spark, str(tmp_path / "a.bam"), size)
        assert df.rdd.getNumPartitions() > 5 or size > 100_000
        assert rows(df, "_row_id", "qname", "seq", "qual", "tags") == want
    with open(tmp_path / "a.bam", "rb") as f:
        first = bam.first_record(f, 0, 2)
        blocks = bam.Blocks(f, first)
        got = bam.decode(blocks.read(bam.struct.unpack("<i", blocks.read(4))[0]), ["chr1", "chr2"])
        assert got["qname"] in {x["qname"] for x in lines}
    reader = bam._Reader(str(tmp_path / "a.bam"), 100_000)
    a, b = (p.value for p in reader.partitions()[:2])
    with pytest.raises(ValueError, match="don't lead"):
        list(reader.read(bam.InputPartition((0, a[1], (b[1][0], b[1][1] + 1)))))


def test_the_rows_of_one_name_are_dealt_among_tasks(spark, tmp_path, monkeypatch):
    """What the largest task of a writer has doesn't grow with a name, and pieces make the same file."""
    header = "@SQ\tSN:c\tLN:1000000\n"
    lines = spark.range(4000).selectExpr("id as _row_id", "concat('q', id, '\t0\tc\t', id + 1, '\t9\t4M\t*\t0\t0\tACGT\tIIII') as body").repartition(3)
    named = lambda ext: lines.select(F.lit(f"all.{ext}").alias("filename"), "_row_id", "body").unionByName(lines.where("_row_id < 5").select(F.lit(f"few.{ext}").alias("filename"), "_row_id", "body"))
    want = [f"q{i}\t0\tc\t{i + 1}\t9\t4M\t*\t0\t0\tACGT\tIIII" for i in range(4000)]
    seen, dealt = [], files._dealt

    def watched(rows, order):
        out = dealt(rows, order)
        seen.append(max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()))
        return out

    monkeypatch.setattr(files, "_dealt", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for ext in ("txt", "sam", "bam"):
            for folder, write in ((tmp_path / f"one-{ext}", lambda f: files.write_files(named(ext), str(f), header)), (tmp_path / f"two-{ext}", lambda f: files.write_anywhere(named(ext), f"file://{f}", header))):
                if ext == "bam" and folder.name.startswith("two"):
                    continue
                folder.mkdir()
                write(folder)
                assert sorted(x for x in os.listdir(folder) if not x.endswith(".crc")) == [f"all.{ext}", f"few.{ext}"]
                for name, rows in (("all", want), ("few", want[:5])):
                    path = f"{folder}/{name}.{ext}"
                    if ext == "bam":
                        assert bam.bam_header(path) == files.program_line(header)
                        assert [r["qname"] for r in bam.bam(spark, path).orderBy("_row_id").collect()] == [x.split("\t")[0] for x in rows]
                    else:
                        with open(path) as f:
                            assert f.read() == (files.program_line(header) if ext == "sam" else "") + "".join(f"{x}\n" for x in rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) == 5 and max(seen) < 2500


def test_records_of_ranges_are_counted_without_being_decoded(tmp_path):
    header = "@SQ\tSN:c\tLN:1000000\n"
    path = str(tmp_path / "a.bam")
    with open(path, "wb") as f:
        bam.write(f, header, (files._bam_row(f"q{i}\t0\tc\t{i + 1}\t9\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:{i % 7}") for i in range(20_000)))
    ranges = [p.value for p in bam._Reader(path, 20_000).partitions()]
    assert len(ranges) > 2
    assert [bam.record_count(path, *r[1:]) for r in ranges] == [sum(1 for _ in bam._Reader(path, 20_000).read(p)) for p in bam._Reader(path, 20_000).partitions()]
    assert sum(bam.record_count(path, *r[1:]) for r in ranges) == 20_000
