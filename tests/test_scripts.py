"""Scripts: the results that the language has to give, errors and their places, and what files come of it."""

import io

import pytest

from readloom.cli import main
from readloom.lang.compile import compile_script, of_kind
from readloom.lang.syntax import ScriptError, parse

#: A read and its qualities, scripts with the lines they print, and errors with their places and texts.
SEQ = "AAAAAAAAAGGGGCCCCCCCCCCCC"
QUAL = "!@#$%^&*&^%$#@#$%^&*^%^&*"


@pytest.fixture(scope="module")
def fasta(spark):
    return spark.createDataFrame([(0, (SEQ, "read1", ""))], "_row_id long, read struct<seq:string,id:string,desc:string>")


@pytest.fixture(scope="module")
def fastq(spark):
    return spark.createDataFrame([(0, (SEQ, "read1", "", QUAL))], "_row_id long, read struct<seq:string,id:string,desc:string,qual:string>")


def printed(spark, reads, code, **more):
    out = compile_script(spark, code, reads, **more).stdout
    return [r["value"] for r in out.orderBy("_row_id", "_seq").collect()]


GOLDEN = [
    ("read.id |> stdout!()", ["read1"]),
    ("a = 'hello'; b = 10; c = '{a} and {b}'; c |> stdout!()", ["hello and 10"]),
    ("if read matches [_ GGGG rest:_] => {rest.seq |> stdout!()}", ["CCCCCCCCCCCC"]),
    ("if read matches [_ GGGG rest:|3| _] => {rest.seq |> stdout!()}", ["CCC"]),
    ("if read matches [first:|3| _] => {first.seq |> stdout!()}", ["AAA"]),
    ("if read matches [_ last:|3|] => {last.seq |> stdout!()}", ["CCC"]),
    ("rec = { a = read.id }; 'hello'.stdout!()", ["hello"]),
    ("rec = { a = read.id }; rec.a.stdout!()", ["read1"]),
    ("rec = { a = read.seq.len() }; if rec.a > 10 { 'long'.stdout!() }", ["long"]),
    ("f = (n: Num = 7) => n; if f() > 5 { 'greater'.stdout!() }", ["greater"]),
    ("f = (n: Num = 7) => n; if f(n = 1) > 5 { 'greater'.stdout!() }", []),
    ("f = (n: Num = 3) => n; if f() > 5 { 'greater'.stdout!() }", []),
    ("\n        if read matches [_] => 'a' |> stdout!()\n        'b' |> stdout!()\n        ", ["a", "b"]),
]
#: Cases of our own.
OWN = [
    ("2 * 3 ^ 2 |> to_str() |> stdout!()", ["36"]),
    ("[1, 2.5].stdout!(); { b = 1, a = 'x' }.stdout!(); (0 / 0).stdout!(); (1 == 'a').stdout!(); ([1] == [1]).stdout!()", ["[1, 2.5]", "{ a = x, b = 1 }", "NaN", "false", "false"]),
    ("if read matches { [ACGT _] => 'x'.stdout!()\n [AAA r:|2| _] => r.seq.stdout!() }", ["AA"]),
    ("if 3 matches { 2 => 'two'.stdout!(), 3 => 'three'.stdout!() }", ["three"]),
    ("if { a = 1, b = true } matches {a = 1, b = true} => 'both'.stdout!()", ["both"]),
    ("if read.id matches x:_ => x.stdout!()", ["read1"]),
    ("f = (s: Str) => s.to_lower(); f(read.seq.slice(0, 2)).stdout!()", ["aa"]),
    ("t = [{ n = 'x', s = 'GGGG' }, { n = 'y', s = 'TTTT' }]\nif read matches [_ b.s rest:_] for b in t => '{b.n}{rest.seq.len()}'.stdout!()", ["x12"]),
    ("if read matches [_ -b.s rest:_] for b in [{ s = 'CCCC' }] => rest.seq.stdout!()", ["CCCCCCCCCCCC"]),
    ("if read matches [_ GGCG ~ 0.3 rest:_] => if rest matches [GC _ x:|2|] => x.seq.stdout!()", ["CC"]),
    ("'nothing'.stdout!() # not hing", ["nothing"]),
    ("ACGT.stdout!(); (-ACGG).stdout!(); 'a\\tb'.stdout!()", ["ACGT", "CCGT", "a\tb"]),
]


@pytest.mark.parametrize("code,want", [*GOLDEN, *OWN])
def test_lines(spark, fasta, code, want):
    assert printed(spark, fasta, code) == want


def test_a_trimmed_read_and_its_reverse_complement(spark, fastq):
    body = lambda code: [tuple(r) for r in compile_script(spark, code, fastq).out.select("filename", "body").collect()]
    assert body("if read matches [start:|10| _] => start.out!('trimmed.fq')") == [("trimmed.fq", f"@read1\nAAAAAAAAAG\n+\n{QUAL[:10]}")]
    assert body("if read matches [start:|10| _] => (-start).out!('trimmed.fq')") == [("trimmed.fq", f"@read1\nCTTTTTTTTT\n+\n{QUAL[:10][::-1]}")]


#: Fixed values, as above.
ERRORS = [
    ("f = (n: Num = 3) => n; if f(m = 1) > 5 { 'greater'.stdout!() }", 26, 34, "found optional argument named 'm'; only expected optional arguments { n: Num }"),
    ("f = (n: Num = 3) => n; if f(n = true) > 5 { 'greater'.stdout!() }", 32, 36, "mismatched types: expected Num, found Bool"),
    ("f = (n: Num = true) => n; if f() > 5 { 'greater'.stdout!() }", 14, 18, "mismatched types: expected Num, found Bool"),
]


@pytest.mark.parametrize("code,start,end,message", ERRORS)
def test_errors_and_where(spark, fasta, code, start, end, message):
    with pytest.raises(ScriptError) as e:
        compile_script(spark, code, fasta)
    assert (e.value.start, e.value.end, e.value.message) == (start, end, message)


@pytest.mark.parametrize("code", ["x = 1; x = 2", "len = 1", "(-read).seq.stdout!()", "nope.stdout!()", "read.nope.stdout!()", "1 + 'a'", "read.id", "if read.id { }", "if read matches [_ read.seq _] => 1.stdout!()", "'a".ljust(3), "f(", "if read matches [ |"])
def test_scripts_that_are_wrong(spark, fasta, code):
    with pytest.raises(ScriptError):
        compile_script(spark, code, fasta)


def test_spans_of_statements():
    stmts = parse("\n        a = 1\n        b = 2; c = 'hello'\n    ").stmts
    assert [(s.name, s.start, s.end) for s in stmts] == [("a", 9, 14), ("b", 23, 28), ("c", 30, 41)]


def test_command_line_counts_means_files_and_order(spark, tmp_path):
    fq = tmp_path / "r.fq"
    fq.write_text("".join(f"@r{i} d{i}\n{'ACGT' * (i + 1)}\n+\n{'I' * 4 * (i + 1)}\n" for i in range(5)))
    (tmp_path / "codes.csv").write_text("name,seq\nodd,ACGTACGTACGT\neven,TTTT\n")
    code = f"""codes = csv('{tmp_path}/codes.csv')
read.id.stdout!()
read.seq.len().mean!(name = 'length')
(read.seq.len() > 8).count!(name = 'long')
if read matches [c.seq rest:_] for c in codes => rest.out!('{{c.name}}.fq')
read.out!('all.fa')
"""
    out = io.StringIO()
    assert main([str(fq), "-r", code, "-o", str(tmp_path)], spark, out) == 0
    text = out.getvalue()
    assert text.startswith("r0\nr1\nr2\nr3\nr4\n") and "\t2\tfalse\n\t3\ttrue" in text and "\t12.00 ± 5.66" in text
    assert (tmp_path / "long.csv").read_text() == "value,count\nfalse,2\ntrue,3\n"
    assert (tmp_path / "stats.csv").read_text().startswith("name,mean,variance\nlength,12.0,5.65")
    assert (tmp_path / "odd.fq").read_text() == "@r2 d2\n\n+\n\n@r3 d3\nACGT\n+\nIIII\n@r4 d4\nACGTACGT\n+\nIIIIIIII\n"
    assert (tmp_path / "all.fa").read_text().count(">") == 5


def test_command_line_strands_pairs_and_errors(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">x first one\nAAC\nC\n>y\nGG\n")
    (tmp_path / "b.fa").write_text(">p\nT\n")
    out = io.StringIO()
    assert main([str(tmp_path / "a.fa"), "-r", "read.seq.stdout!()", "--with-reverse-complement"], spark, out) == 0
    assert out.getvalue() == "AACC\nGGTT\nGG\nCC\n"
    out = io.StringIO()
    assert main([str(tmp_path / "a.fa"), "-p", str(tmp_path / "b.fa"), "-r", "'{read.r1.id}{read.r2.id}'.stdout!()"], spark, out) == 0
    assert out.getvalue() == "xp\n"
    out = io.StringIO()
    assert main([str(tmp_path / "a.fa"), "-r", "if args.on { read.desc.stdout!() }", "-a", "on = false"], spark, out) == 0
    assert out.getvalue() == "\n"
    assert main([str(tmp_path / "a.fa"), "-r", "1 + true"], spark, out) == 1
    assert "expected Num, found Bool" in capsys.readouterr().err
    assert main([str(tmp_path / "a.fa"), "-s", "x.txt"], spark, out) == 1
    assert main([str(tmp_path / "a.fa"), "-p", str(tmp_path / "b.fa"), "--with-reverse-complement", "-r", "1.stdout!()"], spark, out) == 1


def test_effects_of_a_frame_share_one_search(spark):
    """Three effects in a match body: one scan and one Arrow search for all of them, and the same rows as one by one."""
    rows = spark.createDataFrame([(i, (s, f"r{i}", "")) for i, s in enumerate(["AAGATTACACC", "CCGATAACATT", "TTTT", "GATTACAGATTACA"])], "_row_id long, read struct<seq: string, id: string, desc: string>")
    code = "if read matches [_ GATTACA~0.2 rest:_] => { rest.seq.stdout!(); if rest.seq.len() > 2 { rest.seq.count!(name = 'tails') }; read.id.stdout!(); rest.seq.len().mean!(name = 'n'); rest.out!('{read.id}.fa') }"
    program = compile_script(spark, code, rows)
    plan = program.events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan ") == 1
    for kind, alone in (("stdout", "rest.seq.stdout!(); read.id.stdout!()"), ("count", "if rest.seq.len() > 2 { rest.seq.count!(name = 'tails') }"), ("mean", "rest.seq.len().mean!(name = 'n')"), ("out", "rest.out!('{read.id}.fa')")):
        own = getattr(compile_script(spark, f"if read matches [_ GATTACA~0.2 rest:_] => {{ {alone} }}", rows), kind)
        plain = lambda df: sorted(repr(tuple(r)) for r in df.drop("_seq").collect())
        assert plain(of_kind(program.events, kind)) == plain(getattr(program, kind)) == plain(own) != []
