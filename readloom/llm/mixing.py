"""Mixing a corpus to target weights of its domains, by soft membership.

A classifier learnt from a labelled table gives each text posteriors of the domains.  A document then adds its tokens to
every domain in those proportions, and nonnegative rates are sought, one a document, with which the expected tokens of
all domains match their targets: least squares by projected gradient steps.  In a step each document's rate moves
along its own posteriors by one vector that all share, so an iterate is known from the vectors so far: a pass computes
rates from them and sums what they give, and no state of the size of the corpus is rewritten.

Tokens are those of a tokenizers file, as the corpus is packed by it; without one they are white-space words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import drop, each_batch, kept_as, may_be_in, partitions, record_batch, sieve, small_batches, table, tidy
from readloom.llm.packing import ByteEncoder

#: Labelled texts of a domain at least where not all are learnt from; buckets of hashed runs of characters; passes at most and the relative error that ends them.
FEWEST, BUCKETS = 20, 1 << 11
#: Steps of learning at most, a pass each, and steps that a direction is made from.
STEPS, MEMORY = 25, 8
PASSES, CLOSE = 40, 1e-4
#: Parts of the direct step that a pass tries.
PARTS = (1.0, 0.5, 0.2, 0.05)
GRAM, SHAPES = 3, 6


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed runs of GRAM characters, shares of kinds of characters and of repeated words and lines."""
    text = text or ""
    out = np.zeros(BUCKETS + SHAPES)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) >= GRAM:
        n = len(points) - GRAM + 1
        with np.errstate(over="ignore"):
            h = points[:n] * np.uint32(0x9E3779B1)
            for i in range(1, GRAM):
                h = (h ^ points[i : n + i]) * np.uint32(0x85EBCA6B)
        out[:BUCKETS] = np.sqrt(np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS) / n)
    words = text.split()
    if words:
        few = np.bincount(np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127), minlength=128) / len(text)
        lines = text.split("\n")
        out[BUCKETS:] = few[65:91].sum(), few[48:58].sum(), few[33:48].sum() + few[58:65].sum() + few[91:97].sum() + few[123:127].sum(), few[127], 1 - len(set(words)) / len(words), 1 - len(set(lines)) / len(lines)
    return out


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


LEARNT = pa.schema([("y", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])


def _learnt(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Domains and features, with a constant, of rows of LEARNT, which has those that aren't 0."""
    at, x = (batch.column(i).to_pylist() for i in (1, 2))
    out = np.zeros((batch.num_rows, BUCKETS + SHAPES + 1), np.float32)
    out[np.repeat(np.arange(len(at)), [len(b) // 2 for b in at]), np.frombuffer(b"".join(at), "<u2")] = np.frombuffer(b"".join(x), "<f4")
    out[:, -1] = 1
    return np.asarray(batch.column(0)), out


def fit(rows: DataFrame, names: list[str], n: int, penalty: float = 2.5e-5) -> Domains:
    """Multinomial logistic regression on all ``n`` rows of LEARNT by L-BFGS; a pass gives the loss and its gradient, a row of fixed size a task."""
    spark, k = rows.sparkSession, len(names)
    shape = (BUCKETS + SHAPES + 1, k)
    schema = pa.schema([("s", pa.binary())])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(w.astype(np.float32))  # a matrix of fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + w.size)
            for batch in batches:
                if batch.num_rows:
                    y, x = _learnt(batch)
                    z = x @ shared.value
                    z -= z.max(axis=1, keepdims=True)
                    p = np.exp(z)
                    all_of = p.sum(axis=1, keepdims=True)
                    own = np.arange(len(y)), y
                    total[0] += float((np.log(all_of[:, 0]) - z[own]).sum(dtype=np.float64))
                    p /= all_of
                    p[own] -= 1
                    total[1:] += (x.T @ p).ravel()
            yield record_batch({"s": [total.tobytes()]}, schema)

        got = sum(np.frombuffer(r["s"]) for r in rows.coalesce(partitions(spark)).mapInArrow(tidy(run), "s binary").collect()) / n
        shared.destroy()
        return float(got[0] + penalty / 2 * (w**2).sum()), got[1:].reshape(shape) + penalty * w

    w = np.zeros(shape)
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    passes = 1
    while passes < STEPS and np.abs(slope).max() > 1e-6:
        move, taken = -slope, []
        for s, y in reversed(past):
            taken.append(float((s * move).sum() / (s * y).sum()))
            move = move - taken[-1] * y
        move = move * (float((past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2).sum()) if past else 1.0)
        for (s, y), a in zip(past, reversed(taken)):
            move = move + s * (a - float((y * move).sum() / (s * y).sum()))
        part, down = 1.0, float((slope * move).sum())
        while True:
            new, after = loss(w + part * move)
            passes += 1
            if new <= value + 1e-4 * part * down or passes >= STEPS:
                break
            part /= 4
        if new >= value:
            break
        if ((after - slope) * move).sum() > 0:
            past = [*past, (part * move, after - slope)][-MEMORY:]
        w, value, slope = w + part * move, new, after
    return Domains(names, w)


def shares_of(counts: dict[str, int], sample: int) -> int:
    """The most rows of a domain with which all domains have about ``sample`` rows in all, FEWEST at least."""
    left, most = sample, max(counts.values(), default=0)
    for k, n in enumerate(sorted(counts.values())):
        if n * (len(counts) - k) > left:
            most = left // (len(counts) - k)
            break
        left -= n
    return max(FEWEST, most)


def learn(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample: int | None = None) -> Domains:
    """A classifier of all domains of ``labelled`` (id, domain), from all its texts; with ``sample`` from about so many in all or FEWEST of each domain, those with the smallest hashes of ids.

    Constants are corrected for how much more of a domain was drawn.  Of several domains of one id the first by name counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = labelled.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(domain_col).cast("string")).alias("domain"))
    own = some = table(own, "domains")
    counts = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
    names = sorted(counts) or ["all"]
    if sample is not None and counts:
        most = shares_of(counts, sample)
        bounds = spark.createDataFrame([(d, int(min(1.0, most / n) * (1 << 30))) for d, n in counts.items()], "domain string, most long")
        some = own.join(F.broadcast(bounds), "domain").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("most")).select("id", "domain")
    found = spark.sparkContext.broadcast(sieve(some))  # of bounded size
    kind = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def labelled_only(batch: pa.RecordBatch) -> dict | None:
        keep = may_be_in(found.value, np.asarray(batch.column(0)))
        return dict(zip(kind.names, batch.take(pa.array(keep)).columns)) if len(keep) else None

    def described(batch: pa.RecordBatch) -> dict:
        at, x = [], []
        for text in batch.column(1).to_pylist():
            own = features(text).astype("<f4")
            held = np.flatnonzero(own)
            at.append(held.astype("<u2").tobytes())
            x.append(own[held].tobytes())
        return {"y": [names.index(d) for d in batch.column(0).to_pylist()], "at": at, "x": x}

    # Texts without a domain aren't shuffled.
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    few = texts.mapInArrow(each_batch(labelled_only, kind), "id long, text string").join(some, "id").select("domain", "text")
    rows = table(few.mapInArrow(each_batch(described, LEARNT), "y int, at binary, x binary"), "learnt")
    drawn = np.zeros(len(names))
    for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect():
        drawn[r["y"]] = r["n"]
    if drawn.sum():
        out = fit(rows, names, int(drawn.sum()))
        drawn /= drawn.sum()
        share = np.array([counts[d] for d in names]) / sum(counts.values())
        out.weights[-1] += np.where(drawn > 0, np.log(share / np.where(drawn > 0, drawn, 1.0)), 0.0)
    else:
        out = Domains(names, np.zeros((BUCKETS + SHAPES + 1, len(names))))
    drop(rows, own)
    found.destroy()
    return out


def members(docs: DataFrame, domains: Domains, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, p``: tokens (without the end mark of packing) and posteriors of every row."""
    small_batches(docs.sparkSession)
    spec = None
    if tokenizer_path is not None:
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((domains, spec))  # a matrix of fixed size, and as large as the vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])
    encoder: list[ByteEncoder] = []

    def described(batch: pa.RecordBatch) -> dict:
        own, file = shared.value
        if file is not None and not encoder:
            encoder.append(ByteEncoder(file))
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n = [len(encoder[0].encode(x)) if file is not None else len(x.split()) for x in texts]
        return {"doc_id": batch.column(0), "n_tokens": n, "p": list(own.posteriors(np.stack([features(x) for x in texts])))}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each_batch(described, schema), "doc_id long, n_tokens long, p array<double>")


def _matrix(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("n_tokens")).astype(np.float64), np.asarray(batch.column("p").flatten()).reshape(-1, k)


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far: all begin at 1."""
    rate = np.ones(len(p))
    for y in steps:
        rate = np.maximum(0.0, rate - p @ y)
    return rate


def _summed(rows: DataFrame, k: int, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of a vector of ``size``: a row a task reaches the aggregation, and one the driver."""
    schema = pa.schema([("i", pa.int32()), ("x", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fn(*_matrix(batch, k))
        yield record_batch({"i": np.arange(size, dtype=np.int32), "x": total}, schema)

    out = np.zeros(size)
    for i, x in rows.select("n_tokens", "p").mapInArrow(tidy(run), "i int, x double").groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def tempered(natural: np.ndarray, names: list[str], power: float = 0.7) -> np.ndarray:
    """Target weights: natural shares to a power, which lifts small domains; those named ``.../low`` count for a quarter."""
    w = natural**power * np.array([0.25 if n.endswith("/low") else 1.0 for n in names])
    return w / w.sum() if w.sum() else w


def mix(rows: DataFrame, names: list[str], targets: Callable[[np.ndarray, list[str]], np.ndarray] | dict[str, float], *, passes: int = PASSES) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps whose rates bring the expected tokens of ``rows`` (see :func:`members`) to the target weights; the totals reached and wanted.

    The rate of a document with ``n`` tokens and posteriors ``p`` is weighted by ``n``, so documents of like posteriors get like
    rates whatever their lengths.  A pass tries several steps at once and the best is taken: the plain one, over the largest
    eigenvalue of the sum of ``n p p'``, never makes the error larger; parts of the inverse of that sum over documents whose
    rate isn't 0 reach the targets at once where no other bound is met.  It ends when the error is CLOSE to none, when no
    step makes it smaller (the targets can't be reached), or after ``passes``.  A domain without tokens can't be reached and gets none.
    """
    k = len(names)

    def sums(tried: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each list of steps, the totals and the sum of ``n p p'`` over documents whose rate isn't 0: one pass."""

        def own(n: np.ndarray, p: np.ndarray) -> np.ndarray:
            out = []
            before = rates_of(p, tried[0][:-1])  # all lists but their last steps are the same
            for steps in tried:
                rate = np.maximum(0.0, before - p @ steps[-1]) if steps else before
                out += [(n * rate) @ p, ((p * (n * (rate > 0))[:, None]).T @ p).ravel()]
            return np.concatenate(out)

        got = _summed(rows, k, own, len(tried) * (k + k * k)).reshape(len(tried), -1)
        return [(x[:k], x[k:].reshape(k, k)) for x in got]

    if isinstance(targets, dict) and (unknown := sorted(set(targets) - set(names))):
        raise ValueError(f"targets of unknown domains: {', '.join(unknown)}")
    ((natural, gram),) = sums([[]])
    weights = np.array([targets.get(x, 0.0) for x in names]) if isinstance(targets, dict) else targets(natural / max(natural.sum(), 1e-300), names)
    weights = np.where(natural > 0, weights, 0.0)
    wanted = weights / weights.sum() * natural.sum() if weights.sum() else natural
    plain = 1 / max(float(np.linalg.eigvalsh(gram).max()), 1e-300)
    steps: list[np.ndarray] = []
    reached = natural
    while len(steps) < passes and np.abs(reached - wanted).sum() > CLOSE * max(wanted.sum(), 1e-300):
        error = reached - wanted
        direct = np.linalg.pinv(gram, rcond=1e-9) @ error
        tried = [*(part * direct for part in PARTS), *(part * plain * error for part in (1.0, 8.0))]
        totals = sums([[*steps, y] for y in tried])
        best = min(range(len(tried)), key=lambda i: float(((totals[i][0] - wanted) ** 2).sum()))
        if float(((totals[best][0] - wanted) ** 2).sum()) >= (1 - 1e-6) * float((error**2).sum()):
            break
        steps.append(tried[best])
        reached, gram = totals[best]
    return steps, reached, wanted


def rated(rows: DataFrame, names: list[str], steps: list[np.ndarray], seed: int = 11) -> DataFrame:
    """``doc_id, domain, n_tokens, rate, copies``: the likeliest domain, the rate, and the rate rounded up or down at random by id."""
    schema = pa.schema([("doc_id", pa.int64()), ("domain", pa.string()), ("n_tokens", pa.int64()), ("rate", pa.float64())])

    def run(batch: pa.RecordBatch) -> dict:
        _, p = _matrix(batch, len(names))
        return {"doc_id": batch.column("doc_id"), "domain": [names[i] for i in p.argmax(axis=1)], "n_tokens": batch.column("n_tokens"), "rate": rates_of(p, steps)}

    out = rows.select("doc_id", "n_tokens", "p").mapInArrow(each_batch(run, schema), "doc_id long, domain string, n_tokens long, rate double")
    return out.withColumn("copies", rounded(seed))


def rounded(seed: int) -> Column:
    """``rate`` rounded up with its fraction as the probability, drawn by id."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long")


def drawn(docs: DataFrame, domains: Domains, steps: list[np.ndarray], keep: list[str], *, text_col: str = "text", id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """The columns ``keep`` of every document as often as :func:`rated` says, row by row: posteriors are computed again, so nothing is joined or shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((domains, list(steps)))  # a matrix of fixed size and a vector a pass
    schema = pa.schema([("doc_id", pa.int64()), ("rate", pa.float64())])

    def run(batch: pa.RecordBatch) -> dict:
        own, moves = shared.value
        p = own.posteriors(np.stack([features(x) for x in batch.column(1).to_pylist()]))
        return {"doc_id": batch.column(0), "rate": rates_of(p, moves), "kept": batch.column(2)}

    kept, kind = kept_as(docs, keep)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept).mapInArrow(each_batch(run, schema), "doc_id long, rate double" + kind)
    copies = rounded(seed).cast("int")
    return out.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).select("kept.*")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the queries: a language and a quality name a domain."""
    both = docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id")
    return both.where("lang is not null and quality is not null").select("doc_id", F.concat("lang", F.when(F.col("quality") > 0, "/high").otherwise("/low")).alias("domain"))


def gap(reached: np.ndarray, wanted: np.ndarray) -> float:
    """How far the totals reached are from those wanted, as a share of these."""
    return float(np.abs(reached - wanted).sum() / max(wanted.sum(), 1e-300))


def mixed(docs: DataFrame, labelled: DataFrame, targets: Callable | dict[str, float] = tempered, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """:func:`rated` of every row of ``docs``, and ``gap``: the share of the wanted totals by which the rates miss them.

    A null or empty text has no tokens, doesn't count in any domain and gets the rate of its posteriors.  Repeated rows are
    rated alike; an empty table gives no rows.
    """
    domains = learn(docs, labelled, id_col=id_col, text_col=text_col)
    rows = table(members(docs, domains, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path), "members")
    steps, reached, wanted = mix(rows, domains.names, targets)
    out = table(rated(rows, domains.names, steps).withColumn("gap", F.lit(gap(reached, wanted))), "rated")
    drop(rows)
    return out
