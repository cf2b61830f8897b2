"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A vocabulary file of the `tokenizers` format with BPE merges, word ends, NFC and
lower-casing, and byte-level characters is read as data; its path is a
parameter. Text is cut into words by the file's pattern; in each word, a segment
tree has a leaf for every adjacent pair, whose key is the pair's rank and place.
The root is the least key: the leftmost pair of the lowest rank. Merging it
updates the leaves beside it in logarithmic time, until no pair can be merged;
so a word of n characters takes n log n however long it is. Each worker keeps
the words it has met, up to a bounded number, since text repeats them. Decoding
goes from ids alone: each id's symbol, joined by spaces, as the library does for a
file without a decoder.

Defined results: null is empty text, with no ids and an empty decoded text;
added tokens in a text are those tokens, as in the library; characters without a
symbol are dropped, as there; an id that the file doesn't have has no symbol; no
rows give none; equal rows each get theirs; other columns are kept as they are.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "word_bpe_49k.json"
_NONE = 1 << 62


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: bytes that print
    stand for themselves, the others for the characters from 256 on in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    own = set(prints)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairTree:
    """Segment tree of minima over the keys of adjacent pairs."""

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        tree = [_NONE] * (2 * size)
        tree[size : size + len(keys)] = keys
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        self.tree = tree

    def root(self) -> int:
        return self.tree[1]

    def put(self, at: int, key: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, most_words: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "Sequence" or spec.get("decoder"):
            raise ValueError(f"{path}: only BPE files with a split pattern and without a decoder")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError(f"{path}: its pre-tokenizer isn't a split pattern followed by bytes")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: its normalizer isn't NFC, white space and lower case")
        # White space is outside of every match, so folding it to one space changes nothing.
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.ids: dict[str, int] = model["vocab"]
        self.text_of = {i: s for s, i in self.ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.characters = byte_characters()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find_added = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.most_words, self.known = most_words, {}

    def merge(self, symbols: list[int]) -> list[int]:
        """symbols with the leftmost pair of the lowest rank merged, again and again."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        get = merges.get
        bits = n.bit_length()
        keys = [_NONE] * (n - 1)
        some = False
        for i in range(n - 1):
            found = get((symbols[i], symbols[i + 1]))
            if found:
                keys[i], some = found[0] << bits | i, True
        if not some:
            return symbols
        tree, mask = PairTree(keys), (1 << bits) - 1
        symbols = list(symbols)
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        while (key := tree.root()) != _NONE:
            i = key & mask
            j = after[i]
            symbols[i] = merges[symbols[i], symbols[j]][1]
            symbols[j] = -1
            k = after[j]
            after[i] = k
            if j < n - 1:
                tree.put(j, _NONE)
            if k >= 0:
                before[k] = i
                found = get((symbols[i], symbols[k]))
                tree.put(i, found[0] << bits | i if found else _NONE)
            else:
                tree.put(i, _NONE)
            p = before[i]
            if p >= 0:
                found = get((symbols[p], symbols[i]))
                tree.put(p, found[0] << bits | p if found else _NONE)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        found = self.known.get(word)
        if found is None:
            characters = [self.characters[b] for b in word.encode("utf-8", "surrogatepass")]
            characters[-1] += self.end
            ids = self.merge([i for i in map(self.ids.get, characters) if i is not None])
            found = pack(f"<{len(ids)}I", *ids)
            if len(word) <= 64:
                if len(self.known) >= self.most_words:
                    self.known.clear()
                self.known[word] = found
        return found

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-casing goes by character: no final form
                text = text.replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def encode(self, text: str | None) -> bytes:
        """As word(), for a whole text."""
        text = text or ""
        parts = []
        if self.find_added and any(x in text for x in self.added):
            done = 0
            for m in self.find_added.finditer(text):
                parts += map(self.word, self.words(text[done : m.start()]))
                i = self.added[m.group()]
                parts.append(pack("<I", i))
                done = m.end()
            parts += map(self.word, self.words(text[done:]))
        else:
            parts = map(self.word, self.words(text))
        return b"".join(parts)

    def decode(self, ids: list[int]) -> str:
        return " ".join([s for s in map(self.text_of.get, ids) if s is not None])


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, text: str = "text", keep_text: bool = False, arrays: bool = False) -> DataFrame:
    """docs, without text unless kept, with __sc_n and __sc_ids.

    Ids are an array of integers, or packed in 32 bits each, little-endian.

    The executors need the vocabulary file at the same path."""
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = [encode(x) for x in b.column(text).to_pylist()]
                n = [len(x) // 4 for x in ids]
                if arrays:
                    flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
                    packed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat))
                else:
                    packed = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64()), packed], names=[*names, "__sc_n", "__sc_ids"])

    new = [T.StructField("__sc_n", T.LongType()), T.StructField("__sc_ids", T.ArrayType(T.IntegerType()) if arrays else T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([*fields, *new]))


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with one more column, __sc_text: the text of ids, an array of integers or packed in 32 bits each; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out = [None if x is None else decode(np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x) for x in b.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "__sc_text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__sc_text", T.StringType())]))
