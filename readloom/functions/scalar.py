"""Scalar functions of the script language as Column builders.

Numbers are 32-bit floats, strings are ASCII; every builder stays inside the JVM.  What aborts a run (a slice out of
range, the minimum of no numbers) raises through ``raise_error``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.bind import let

#: Complement of IUPAC codes, position by position, and amino acids by codon in the order T, C, A, G.
BASES = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENTS = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
CODON_ORDER = "TCAG"
AMINO = "FFLLSSSSYY--CC-WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def num(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


# Arithmetic: IEEE on 32-bit floats.


def plus(a: Column, b: Column) -> Column:
    return num(num(a) + num(b))


def minus(a: Column, b: Column) -> Column:
    return num(num(a) - num(b))


def times(a: Column, b: Column) -> Column:
    return num(num(a) * num(b))


def divide(a: Column, b: Column) -> Column:
    """``x / 0`` is infinite with the sign of x, ``0 / 0`` is NaN."""
    a, b = num(a), num(b)
    nowhere = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, num(nowhere)).otherwise(num(a / F.when(b != 0, b)))


def modulo(a: Column, b: Column) -> Column:
    """Truncated remainder, with the sign of the dividend; NaN where the divisor is 0."""
    a, b = num(a), num(b)
    return F.when(b == 0, num(F.lit(float("nan")))).otherwise(num(a % F.when(b != 0, b)))


def power(a: Column, b: Column) -> Column:
    return num(F.pow(num(a), num(b)))


def negative(a: Column) -> Column:
    return num(-num(a))


def round_half_away(a: Column) -> Column:
    return num(F.round(num(a)))


def floor(a: Column) -> Column:
    return num(F.floor(num(a)))


def ceil(a: Column) -> Column:
    return num(F.ceil(num(a)))


# Comparison.


def number_equal(a: Column, b: Column) -> Column:
    """NaN equals nothing."""
    return (num(a) == num(b)) & ~F.isnan(num(a))


# Strings: lengths and positions in bytes, from 0.


def length(s: Column) -> Column:
    return num(F.octet_length(s))


def _position(x: Column) -> Column:
    return F.round(num(x)).cast("int")


def slice_(s: Column, start: Column, end: Column) -> Column:
    """From ``start`` to before ``end``; out of range aborts."""
    a, b = _position(start), _position(end)
    fits = (a >= 0) & (a <= b) & (b <= F.length(s))
    return F.when(fits, F.substring(s, a + 1, b - a)).otherwise(F.raise_error(F.lit("slice out of range")).cast("string"))


def find_first(s: Column, part: Column) -> Column:
    return num(F.instr(s, part) - 1)


def find_last(s: Column, part: Column) -> Column:
    back = F.instr(F.reverse(s), F.reverse(part))
    return num(F.when(F.instr(s, part) == 0, F.lit(-1)).otherwise(F.length(s) - F.length(part) - back + 1))


def lookup(s: Column, key: Column, kv_sep: Column | None = None, sep: Column | None = None) -> Column:
    """What follows ``key`` and ``kv_sep``, up to the next ``sep``; empty if there is no such key."""
    mark = F.concat(key, F.lit("=") if kv_sep is None else kv_sep)
    at = F.instr(s, mark)
    tail = F.substring(s, at + F.length(mark), F.length(s))
    return F.when(at == 0, F.lit("")).otherwise(F.split_part(tail, F.lit(" ") if sep is None else sep, F.lit(1)))


def to_upper(s: Column) -> Column:
    return F.upper(s)


def to_lower(s: Column) -> Column:
    return F.lower(s)


def str_concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def distance(a: Column, b: Column) -> Column:
    return num(F.levenshtein(a, b))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, BASES, COMPLEMENTS))


def translate(seq: Column, stop: Column | str = "-", illegal: Column | str = "?") -> Column:
    """Amino acids of the codons from the first base on; one or two bases left over are dropped."""
    stop, illegal = (x if isinstance(x, Column) else F.lit(x) for x in (stop, illegal))

    # A codon's place counts its bases from 1 in base 5; 0 is any other letter, whose places hold NUL.
    order = [None, *CODON_ORDER]
    letters = F.array(*(F.lit("\0" if None in (x, y, z) else AMINO[16 * CODON_ORDER.index(x) + 4 * CODON_ORDER.index(y) + CODON_ORDER.index(z)]) for x in order for y in order for z in order))

    def amino(codon: Column) -> Column:
        x, y, z = (F.instr(F.lit(CODON_ORDER), F.substring(codon, k, 1)) for k in (1, 2, 3))
        return F.get(letters, x * 25 + y * 5 + z)

    found = F.transform(F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0)), amino)
    return F.replace(F.replace(F.array_join(found, ""), F.lit("-"), stop), F.lit("\0"), illegal)


def to_num(s: Column) -> Column:
    """The number a string is; anything else aborts."""
    value = s.try_cast("float")
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), s)).cast("float")).otherwise(value)


def to_qscores(qual: Column) -> Column:
    """Phred scores of a quality string; a byte under 33 aborts."""
    scores = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: num(F.ascii(c) - 33))
    return let(scores, lambda xs: F.when(F.array_min(xs) < 0, F.raise_error(F.lit("quality below 33")).cast("array<float>")).otherwise(xs))


# Lists.


def _some(xs: Column, value) -> Column:
    empty = F.raise_error(F.lit("empty list")).cast("float")
    return let(xs, lambda some: F.when(F.size(some) < 1, empty).otherwise(num(value(some))))


def list_min(xs: Column) -> Column:
    return _some(xs, F.array_min)


def list_max(xs: Column) -> Column:
    return _some(xs, F.array_max)


def list_mean(xs: Column) -> Column:
    total = lambda some: F.aggregate(some, num(F.lit(0.0)), lambda a, x: num(a + x))
    return _some(xs, lambda some: total(some) / F.size(some))


def contains(xs: Column, x: Column) -> Column:
    return F.array_contains(xs, x)


# Reads: structs with at least a field seq.


def fields(read_type) -> list[str]:
    return [f.name for f in read_type.fields]


def read_reverse_complement(read: Column, names: list[str]) -> Column:
    out = read.withField("seq", reverse_complement(read["seq"]))
    return out.withField("qual", F.reverse(read["qual"])) if "qual" in names else out


def tag(read: Column, names: list[str], text: Column, prefix: Column | None = None) -> Column:
    """Adds to the description, and to the tags where a read has them."""
    more = F.concat(F.lit(" ") if prefix is None else prefix, text)
    out = read.withField("desc", F.concat(read["desc"], more))
    return out.withField("tags", F.concat(read["tags"], more)) if "tags" in names else out


def rename(read: Column, names: list[str], new: Column) -> Column:
    out = read.withField("id", new)
    return out.withField("qname", new) if "qname" in names else out


def concat_reads(a: Column, a_names: list[str], b: Column, b_names: list[str]) -> Column:
    """Joined sequences, and qualities if both have them; other fields are those of the second."""
    out = b.withField("seq", F.concat(a["seq"], b["seq"]))
    return out.withField("qual", F.concat(a["qual"], b["qual"])) if "qual" in a_names and "qual" in b_names else out


def slice_read(read: Column, names: list[str], start: Column, end: Column) -> Column:
    """The read with sequence and quality from ``start`` to before ``end``."""
    out = read.withField("seq", F.substring(read["seq"], start + 1, end - start))
    return out.withField("qual", F.substring(read["qual"], start + 1, end - start)) if "qual" in names else out


# Alignment flags.

#: Predicates by bit.
FLAGS = ["paired", "mapped_in_proper_pair", "unmapped", "mate_unmapped", "reverse_strand", "mate_reverse_strand", "first_in_pair", "second_in_pair", "not_primary_alignment", "fails_platform_quality_checks", "pcr_or_optical_duplicate", "supplementary_alignment"]


def flag(name: str, value: Column) -> Column:
    """Whether a flag's bit is set; the number is rounded and held within 16 bits first."""
    whole = F.greatest(F.lit(0), F.least(F.lit(65535), F.coalesce(F.round(num(value)).cast("double"), F.lit(0.0)))).cast("int")
    return whole.bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0


# Display.


def number_text(x: Column) -> Column:
    """Whole numbers without a point, never an exponent, ``inf`` and ``NaN``."""
    x = num(x)
    plain = x.cast("string")
    small = F.regexp_replace(plain.cast("decimal(38,30)").cast("string"), "0+$", "")
    whole = (x == F.floor(F.when(F.abs(x) < 9e18, x).otherwise(0.0))) & (F.abs(x) < 9e18)
    huge = F.format_string("%.0f", x.cast("double"))
    return (
        F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
        .when((x == 0) & plain.startswith("-"), "-0")
        .when(whole, F.when(F.abs(x) < 9e18, x).cast("bigint").cast("string"))
        .when(F.abs(x) >= 9e18, huge)
        .when(plain.contains("E"), F.when(plain.contains("E"), small)).otherwise(plain)
    )
