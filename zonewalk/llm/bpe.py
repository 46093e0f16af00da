"""Byte-pair encoding by per-prefix dynamic programming.

For every prefix of a piece of text, the last token of the prefix's encoding is unique. It is found among the vocabulary
tokens that end there (an automaton with suffix links over the vocabulary yields them): the one that is compatible with
the last token of the shorter prefix that it extends. Following the back-pointers from the end gives the exact ids.
Two tokens are compatible if merging never joins bytes across their border: undoing their merges from the latest to the
earliest, the two parts that touch must never form a pair that would have merged while both were there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.llm.common import chunks

#: Pieces that a worker remembers; when full, it starts anew.
REMEMBERED = 300_000
#: The pattern of byte-level pre-tokenisation, and the classes it stands on for text within Latin-1.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\t-\r \x85\xa0"}
#: Letters and numbers that Unicode has only since version 17; the tokenizers library counts them as neither.
SINCE_17 = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb"
    "\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3"
    "\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96"
    "\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4"
    "\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
NEVER = 1 << 40


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones for themselves, others from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _pattern(letter: str, number: str, space: str, other: str) -> str:
    """PIECES with its classes given."""
    marks = {r"[^\s\p{L}\p{N}]": other, r"\p{L}": letter, r"\p{N}": number, r"\s": space, r"\S": f"(?!{space})[\\s\\S]"}
    return re.sub("|".join(map(re.escape, marks)), lambda m: marks[m[0]], PIECES)


class Vocabulary(dict):
    """A byte-level BPE vocabulary from a tokenizers JSON file; as a dict, pieces (Latin-1 views of UTF-8) with their ids as bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: bytes([b]) for b, letter in _byte_letters().items()}
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for text, i in ids.items():
            self.bytes_of[i] = b"".join(byte_of[c] for c in text)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(self.bytes_of)  # rank and halves
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = r
            if self.made[whole][0] < 0:
                self.made[whole] = (r, left, right)
        self.automaton = ahocorasick.Automaton()
        for text, i in ids.items():
            if text not in self.special:
                word = self.bytes_of[i].decode("latin-1")
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        letter, number, space = LATIN.values()
        self.latin = re.compile(_pattern(f"[{letter}]", f"[{number}]", f"[{space}]", f"[^{space}{letter}{number}]")).findall
        new = f"[{SINCE_17}]"
        self.any = regex.compile(_pattern(rf"[\p{{L}}--{new}]", rf"[\p{{N}}--{new}]", r"\s", rf"[[^\s\p{{L}}\p{{N}}]||{new}]"), regex.V1).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a, b next to each other stay as they are under merging."""
        until, strict = NEVER, False
        while True:
            r = self.rank.get((a, b), NEVER)
            if r < until or (strict and r == until):
                return False
            (ra, _, a_right), (rb, b_left, _) = self.made[a], self.made[b]
            if ra < 0 and rb < 0:
                return True
            # Undo what merged last; of equal merges the right one came later, and yields to one across the border.
            if rb >= ra:
                until, strict, b = rb, True, b_left
            else:
                until, strict, a = ra, False, a_right

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace").decode("latin-1")
        last, fits = [-1] * (len(data) + 1), self.fits
        for end, (token, size) in self.automaton.iter(data):
            end += 1
            before = end - size
            if last[end] >= 0 or (before and last[before] < 0):
                continue
            if before:
                pair = (last[before], token)
                ok = fits.get(pair)
                if ok is None:
                    ok = self.compatible(*pair)
                    if len(fits) > 2_000_000:
                        fits.clear()
                    fits[pair] = ok
                if not ok:
                    continue
            last[end] = token
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        ids = np.array(out[::-1], dtype="<u4").tobytes()
        if len(piece) < 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def _ordinary(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            pieces = self.latin(text)
        except UnicodeEncodeError:
            pieces = self.any(text)
        return b"".join(map(self.__getitem__, pieces))

    def encode(self, text: str, special: bool = True) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. special: whether special tokens' strings in the text become their ids."""
        if not special or not self.at_special:
            return self._ordinary(text)
        parts = self.at_special.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self._ordinary(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, special tokens included, as UTF-8; bytes that are no UTF-8 become U+FFFD."""
        names = self.bytes_of
        return b"".join([names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker."""
    return Vocabulary(path)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of `docs` (doc_id, text).

    `path` names a tokenizers JSON file that every executor has. Null text counts as empty: no tokens. Strings of
    special tokens in a text become their ids. An empty table gives an empty result; repeated rows each get one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part, texts in chunks(batches):
            counts, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = words.encode(t.decode("utf-8", "replace"))
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(words.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """(doc_id, ids) with ids as an array of integers, for use beside `decode_ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part, texts in chunks(batches):
            ids = [np.frombuffer(words.encode(t.decode("utf-8", "replace"), special), dtype="<u4").astype(np.int32) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part in batches:
            texts = [words.decode(np.array(x or [], dtype="<u4").tobytes()).decode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
