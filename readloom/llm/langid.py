"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of masks serves all languages, however many: bit ``l`` of a slot says that language ``l`` set it, so the AND of an n-gram's
slots is the mask of all languages whose filter contains it.  A text's n-grams are counted by language; as a filter
with fill ``f`` and ``k`` hashes answers wrongly with probability ``f ** k``, each count is corrected for that, and the
language with the largest corrected count wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import drop, each_batch, held_out, kept_as, record_batch, small_batches, table, tidy

GRAM = 4
HASHES = 2
SLOTS_BITS = 20
#: Different n-grams that a task sums before it sends them.
HELD = 1 << 20
#: A language's filter takes the n-grams that make up this share of its n-grams at least, and whose share is this part of the largest share any language has.
LEAST_SHARE, LEAST_PART = 1e-5, 0.2
UNKNOWN = "und"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_hashes(text: str) -> np.ndarray:
    """Hashes of the n-grams of a lower-cased text whose characters other than letters count as one space, spaces at both ends."""
    lower = text.lower()
    points = np.frombuffer(f" {lower} ".encode("utf-32-le"), np.uint32)
    letter = _letters()[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    points = np.where(letter, points, 32)[keep].astype(np.uint64)
    if len(points) < GRAM:
        points = np.concatenate([points, np.full(GRAM - len(points), 32, np.uint64)])
    out = points[: len(points) - GRAM + 1].copy()
    for i in range(1, GRAM):
        out *= np.uint64(1_000_003)
        out += points[i : len(points) - GRAM + 1 + i]
    return out


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000))
    return _table[0]


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    a = hashes * _M1
    b = hashes * _M2
    shift = np.uint64(64 - SLOTS_BITS)
    return [a >> shift, (a + b) >> shift][:HASHES]


def counted(texts: list[str], at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of texts and how often each occurs; counts of some texts at a time are merged."""
    found, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for lo in range(0, len(texts), at_once):
        new, times = np.unique(np.concatenate([*map(gram_hashes, texts[lo : lo + at_once])]), return_counts=True)
        found, n = merged((found, n), (new, times))
    return found, n


def merged(*counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([n for _, n in counts]), minlength=len(found)).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # a slot's words, as many as its bits take
    wrong: np.ndarray  # of each language, how often an n-gram that it lacks is found

    @classmethod
    def of(cls, texts: dict[str, list[str]]) -> Filters:
        return cls.of_shares({name: (found, n / max(1, n.sum())) for name, (found, n) in ((name, counted(own)) for name, own in texts.items())})

    @classmethod
    def of_shares(cls, own: dict[str, tuple[np.ndarray, np.ndarray]]) -> Filters:
        """From n-grams of each language, sorted, and their shares; those below LEAST_SHARE may be left out, as no filter takes them and no larger share is among them."""
        languages = sorted(own)
        grams, shares = [own[name][0] for name in languages], [own[name][1] for name in languages]
        everything, at = np.unique(np.concatenate(grams or [np.empty(0, np.uint64)]), return_inverse=True)
        most = np.zeros(len(everything))
        np.maximum.at(most, at, np.concatenate(shares or [np.empty(0)]))
        width = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
        bits = 8 * np.dtype(width).itemsize
        masks = np.zeros((1 << SLOTS_BITS, -(-len(languages) // bits) or 1), width)
        wrong, start = [], 0
        for i, (found, share) in enumerate(zip(grams, shares)):
            top = most[at[start : start + len(found)]]
            start += len(found)
            for where in slots(found[(share >= LEAST_SHARE) & (share >= LEAST_PART * top)]):
                masks[where, i // bits] |= width(1 << i % bits)
            wrong.append((np.count_nonzero(masks[:, i // bits] >> width(i % bits) & width(1)) / len(masks)) ** HASHES)
        return cls(languages, masks, np.array(wrong))

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """N-grams of the text that each language has, without those found wrongly; and how many n-grams there are."""
        hashes = gram_hashes(text)
        where = slots(hashes)
        mask = self.masks[where[0]]
        for x in where[1:]:
            mask &= self.masks[x]
        if mask.dtype == np.uint8:
            by_mask = np.bincount(mask[:, 0], minlength=256)
            hits = np.array([by_mask[_with_bit(i)].sum() for i in range(len(self.languages))], np.float64)
        else:
            word, bits = mask.dtype.type, 8 * mask.dtype.itemsize
            hits = np.array([np.count_nonzero(mask[:, i // bits] >> word(i % bits) & word(1)) for i in range(len(self.languages))], np.float64)
        return np.maximum(0.0, (hits - len(hashes) * self.wrong) / (1 - self.wrong)), len(hashes)

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and the share of the corrected counts that is its own; ties go to the first by name."""
        if not text or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        n, _ = self.counts(text)
        total = n.sum()
        best = int(np.argmax(n))
        return self.languages[best], float(n[best] / total) if total else 1 / len(self.languages)


_bits: dict[int, np.ndarray] = {}


def _with_bit(i: int) -> np.ndarray:
    if i not in _bits:
        _bits[i] = np.flatnonzero(np.arange(256) >> i & 1)
    return _bits[i]


def _summed(code: dict[str, int]):
    """N-grams of texts (``lang, text``) summed by language in a task, as many rows as it has different ones or a few times that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def put() -> Iterator[pa.RecordBatch]:
            for name, (found, n) in held.items():
                yield record_batch({"l": np.full(len(found), code[name], np.int32), "gram": found.view(np.int64), "n": n}, COUNTED)
            held.clear()

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(name, []).append(text)
            for name, own in texts.items():
                new = counted(own)
                held[name] = merged(held[name], new) if name in held else new
            if sum(len(found) for found, _ in held.values()) > HELD:
                yield from put()
        yield from put()

    return run


COUNTED = pa.schema([("l", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from the n-grams of all texts with a language that aren't held out.

    They are summed in tasks and by a shuffle; the driver gets those that make up LEAST_SHARE of a language's, so 1 / LEAST_SHARE
    of each language at most.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # a row a language
    found = rows.mapInArrow(tidy(_summed({name: i for i, name in enumerate(names)})), "l int, gram long, n long")
    grams = table(found.groupBy("l", "gram").agg(F.sum("n").alias("n")), "grams", compact=True)
    totals = {r["l"]: r["n"] for r in grams.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for i, name in enumerate(names):
        own = grams.where((F.col("l") == i) & (F.col("n") / F.lit(float(totals[i])) >= LEAST_SHARE)).select("gram", "n").toArrow()
        gram, n = own.column("gram").to_numpy().view(np.uint64), own.column("n").to_numpy()
        order = np.argsort(gram)
        out[name] = gram[order], n[order] / totals[i]
    drop(grams)
    return Filters.of_shares(out)


def identify(docs: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, and the columns to ``keep`` as a struct ``kept``; ``und`` with score 0 where the text is null or has no letter.  Repeated rows stay repeated; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2 ** SLOTS_BITS words
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predicted(batch: pa.RecordBatch) -> dict:
        found = [shared.value.predict(x) for x in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]} | ({"kept": batch.column(3)} if keep else {})

    kept, kind = kept_as(docs, keep)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), *kept).mapInArrow(each_batch(predicted, schema), "doc_id long, held_out boolean, lang_pred string, score double" + kind)
