"""Byte-pair encoding and decoding of whole texts, by merges in a priority queue.

A tokenizer file of the tokenizers library gives the vocabulary, the merges in order of rank, and how a
text is normalised and split into words; those two steps are the library's own. Each word is encoded here:
its symbols form a doubly linked list, the ranks of neighbouring pairs stand in a priority queue, and an
entry whose pair has changed meanwhile is stale and skipped. Decoding concatenates vocabulary strings.

Texts stay in the partition they are read in. What a worker keeps of earlier words is bounded by bytes; a
long word is encoded in n log n steps and not kept.

Defined cases: a null text is an empty one and has no ids, an empty text decodes to an empty one; ids of
documents may be null or repeated, each row is encoded for itself; other columns are left out. Strings of
added tokens in a text become those tokens, as in the library.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K

IDS, TEXTS = "doc_id long, ids binary", "doc_id long, ids binary, decoded string"
KEEP_BYTES, LONG_WORD = 128 << 20, 64
# The steps before the merges for which the expressions below are exact.
PLAIN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
# Latin letters and common punctuation: nothing there composes or depends on the release of Unicode.
_OTHER = regex.compile(r"[^\x00-įı-ɏ‐-‧]")
_SPACE = r"\t-\r \x85\xa0"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_WORD_ASCII = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself if it is visible
    Latin-1, otherwise the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    table = {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge neighbouring symbols, the lowest rank first and from the left among equals, until none is left
    to merge. ``ranks`` gives (rank, merged symbol) of a pair."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    queue = [(*found, i) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
    heapify(queue)
    while queue:
        rank, made, i = heappop(queue)
        j = after[i]
        if j < 0 or symbols[i] < 0 or ranks.get((symbols[i], symbols[j])) != (rank, made):
            continue  # stale: one of the two has been merged with another symbol
        symbols[i], symbols[j] = made, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if found := ranks.get((made, symbols[k])):
                heappush(queue, (*found, i))
        h = before[i]
        if h >= 0 and (found := ranks.get((symbols[h], made))):
            heappush(queue, (*found, h))
    return [s for s in symbols if s >= 0]


class Words(dict):
    """Ids of a word as little-endian unsigned 32-bit integers, filled in when a word is first met."""

    def __init__(self, spell, ranks, suffix: str, vocabulary: dict[str, int]):
        super().__init__()
        self.spell, self.ranks, self.suffix, self.vocabulary, self.room = spell, ranks, suffix, vocabulary, KEEP_BYTES

    def __missing__(self, word: str) -> bytes:
        symbols = list(self.spell(word))
        if symbols:
            symbols[-1] += self.suffix
        get = self.vocabulary.get
        ids = merge([i for s in symbols if (i := get(s)) is not None], self.ranks)
        found = np.array(ids, "<u4").tobytes()
        if len(word) <= LONG_WORD:
            self.room -= 300 + 4 * len(word) + len(found)
            if self.room < 0:
                self.clear()
                self.room = KEEP_BYTES
            self[word] = found
        return found


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        model = steps["model"]
        unlike = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)}
        if model["type"] != "BPE" or unlike:
            raise ValueError(f"not a plain BPE model: {model['type']} {unlike}")
        if (steps["decoder"] or {"type": None})["type"] not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {steps['decoder']}")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ranks = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        suffix, alphabet = model.get("end_of_word_suffix") or "", byte_alphabet()
        self.plain = all(steps[k] == v for k, v in PLAIN_STEPS.items())
        self.raw = Words(lambda w: [alphabet[b] for b in w.encode()], ranks, suffix, vocabulary)
        self.split = Words(str, ranks, suffix, vocabulary)  # words as the library's split gives them
        added = steps["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if added else None
        size = 1 + max([*vocabulary.values(), *(t["id"] for t in added)])
        strings = [""] * size
        for token, i in vocabulary.items():
            strings[i] = token
        self.strings = strings
        self.bytewise = steps["decoder"] is not None
        if self.bytewise:
            back = {c: b for b, c in enumerate(alphabet)}
            self.strings = [bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s in strings]
        for t in added:
            self.strings[t["id"]] = t["content"].encode() if self.bytewise else t["content"]

    def _words(self, text: str) -> list[bytes]:
        if self.plain and text.isascii():
            return list(map(self.raw.__getitem__, _WORD_ASCII.findall(text.lower())))
        if self.plain and not _OTHER.search(text):
            return list(map(self.raw.__getitem__, _WORD.findall(text.lower())))
        normal = self.tokenizer.normalizer
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)
        return [self.split[word] for word, _ in words]

    def encode(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return b"".join(self._words(text))
        out = []
        for part in self.marks.split(text):
            out += [self.added[part]] if part in self.added else self._words(part) if part else []
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(strings).decode("utf-8", "replace") if self.bytewise else " ".join(strings)


@lru_cache(maxsize=1)
def coder_of(path: str) -> Coder:
    """One per Python worker, which Spark keeps from task to task."""
    return Coder(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text, ...): ids are little-endian unsigned 32-bit integers."""

    def run(batches):
        coder = coder_of(tokenizer)
        for rows, data, bounds in K.pieces(batches):
            whole = data.tobytes()
            ids = [coder.encode(whole[a:b].decode()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, IDS)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of encoded rows (doc_id, ids, ...); null ids decode to an empty text."""

    def run(batches):
        coder = coder_of(tokenizer)
        for batch in batches:
            ids = batch.column(1)
            low = 0
            while low < len(ids):  # a few MB of text at a time
                high, size = low, 0
                while high < len(ids) and size < K.PIECE:
                    size += len(ids[high].as_buffer() or b"") if ids[high].is_valid else 0
                    high += 1
                texts = [coder.decode(i or b"") for i in ids.slice(low, high - low).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), ids.slice(low, high - low), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )
                low = high

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")).mapInArrow(run, TEXTS)


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
