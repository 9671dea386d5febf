"""Token counts with a whole-token shortcut.

A vocabulary string that, standing alone, the tokenizer encodes as exactly one token needs no merging when it
turns up as a pre-token.  The driver proves this once for each vocabulary entry by running the BPE model on it;
executors then count such pre-tokens by one look-up and run the merges only for the others, whose counts a
bounded cache keeps.

Texts with a code point outside the blocks of ``SETTLED``, on which two pattern libraries of different Unicode
versions may disagree, are counted by the tokenizer itself, so the result always equals the library's.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import each_batch, small_batches

#: White space of the normalizer, as code points of the Unicode property White_Space.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Blocks whose classes have been the same in all versions of Unicode that the libraries may hold.
SETTLED = r"\x00-߿ऀ-෿Ḁ-⁯₠-₿℀-⏿─-⯿　-ヿ一-鿿가-힣\U0001f300-\U0001f6d5"
CACHE = 400_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordCounter:
    """Counts tokens as a lower-casing, white-space-dropping BPE with word ends does."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]] if spec["normalizer"] else []
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("this counter knows NFC, white space and lower case, then a pattern whose matches are kept")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        self.odd = regex.compile(f"[^{SETTLED}]")
        self.letters = str.maketrans({i: c for i, c in enumerate(byte_letters())})
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.whole = self.prove(spec["model"]["vocab"]) if whole is None else whole
        self.counts: dict[str, int] = _Counts(self)

    def merged(self, word: str) -> int:
        return len(self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))

    def prove(self, vocab: dict[str, int]) -> frozenset[str]:
        """The pre-tokens that the model encodes as one token."""
        back, found = {c: i for i, c in enumerate(byte_letters())}, set()
        for entry in vocab:
            if not self.suffix or entry.endswith(self.suffix):
                try:
                    word = bytes(back[c] for c in entry.removesuffix(self.suffix)).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if word and self.pattern.fullmatch(word) and self.merged(word) == 1:
                    found.add(word)
        return frozenset(found)

    def count(self, text: str) -> int:
        if not text.isascii() and self.odd.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        parts = self.special.split(text) if "<|" in text else [text]
        total = len(parts) - 1
        for part in parts:
            if not part.isascii():
                part = self.spaces.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ")
            total += sum(map(self.counts.__getitem__, self.pattern.findall(part.lower())))
        if len(self.counts) > CACHE + len(self.whole):
            self.counts = _Counts(self)
        return total


class _Counts(dict):
    def __init__(self, counter: WordCounter):
        super().__init__(dict.fromkeys(counter.whole, 1))
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self[word] = self.counter.merged(word)
        return n


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null text counts as empty; a repeated row is counted again; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    # A vocabulary has a fixed size, so the broadcast is bounded by its file.
    shared = docs.sparkSession.sparkContext.broadcast((spec, WordCounter(spec).whole))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    own: list[WordCounter] = []

    def counted(batch: pa.RecordBatch) -> dict:
        if not own:
            own.append(WordCounter(*shared.value))
        texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
        n = [own[0].count(x) for x in texts]
        return {"doc_id": batch.column(0), "n_bytes": [len(x) if x.isascii() else len(x.encode()) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each_batch(counted, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
