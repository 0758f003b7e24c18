"""Token counts of whole texts for a byte-level merge vocabulary, without encoding what is in the vocabulary as it stands.

Proof. ``Vocabulary`` runs the merges of the file once over each of its own strings and keeps those that come out as the
one token they are. A stretch of text that equals such a string counts as one token without any merging, because merges
never look beyond their stretch.

Counting. A batch of texts is cut into stretches (the pattern of byte-level vocabularies: contractions, runs of letters,
numbers or other characters with at most one space before them, white space) by comparing the classes of neighbouring
characters in whole columns. Which characters are letters, numbers and white space is asked of the library itself, once
for each character met. The stretches of a batch are dictionary-encoded; a distinct stretch that is proven counts one,
and only the other distinct ones are merged, by the library. Special strings of the file are found first and count as one
token, as the library does by default.

Texts are read once and nothing is exchanged. A worker holds one piece of ``PIECE`` bytes: longer texts are cut before a
single space between two visible ASCII characters, where a stretch always begins. The vocabulary, whose size the file
bounds, is sent to the workers as text, so that only the driver reads the file.

Nulls, ties, edges: a null or empty text has 0 bytes and tokens; ids are passed through, null or repeated; repeated rows
are counted each; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import table

LIMIT = 1024
PIECE = 4 << 20
#: Merged stretches that a worker remembers, and the longest of them.
REMEMBERED, SHORT = 200_000, 100
CUT = re.compile(rb"[!-~](?= [!-~])")
LETTER, NUMBER, OTHER, SPACE, SPECIAL = 1, 2, 3, 4, 5


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level merge vocabulary with the strings that are proven to be one token."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        told = json.loads(definition)
        split, model, added = told["pre_tokenizer"] or {}, told["model"], told["added_tokens"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told["normalizer"]
        if not plain or model["type"] != "BPE" or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only byte-level merges without normalisation and with plain special strings are counted here")
        tokenizer = Tokenizer.from_str(definition)
        self.model, self.splitter = tokenizer.model, tokenizer.pre_tokenizer
        self.letters = dict(enumerate(byte_letters()))
        back = {c: b for b, c in self.letters.items()}
        proven = [v for v in model["vocab"] if len(self.model.tokenize(v)) == 1 and all(c in back for c in v)]
        self.whole = pa.array([bytes(back[c] for c in v) for v in proven], pa.large_binary())
        self.specials = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, self.specials))) if self.specials else None
        self.cuttable = not any(b" " in s for s in self.specials)
        self.classes = np.zeros(0x110000, np.uint8)
        self.known: dict[str, int] = {}

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        """The class of each character, by how the library splits it from a letter, a number and a sign."""
        found = self.classes[points]
        if not found.all():
            for point in np.unique(points[found == 0]).tolist():
                joins = [len(self.splitter.pre_tokenize_str(c + chr(point))) == 1 for c in "a1!"]
                self.classes[point] = (joins.index(True) if any(joins) else 3) + 1
            found = self.classes[points]
        return found

    def merged(self, stretches: pa.Array) -> list[int]:
        """How many tokens the merges leave of each stretch."""
        ends = np.cumsum(pc.binary_length(stretches).to_numpy()).tolist()
        shown = b"".join(stretches.to_pylist()).decode("latin-1").translate(self.letters)
        known, merge, out, start = self.known, self.model.tokenize, [], 0
        if len(known) > REMEMBERED:
            known.clear()
        for end in ends:
            own = shown[start:end]
            n = known.get(own)
            if n is None:
                n = len(merge(own))
                if end - start <= SHORT:
                    known[own] = n
            out.append(n)
            start = end
        return out

    def starts(self, points: np.ndarray, first: np.ndarray, special: np.ndarray) -> np.ndarray:
        """Where a stretch begins, by character. first: begins a text, or what stands beside a special string."""
        n = len(points)
        kind = self.classes_of(points)
        kind[special] = SPECIAL
        begins = first.copy()
        begins[1:] |= kind[1:] != kind[:-1]
        # the last of some white space goes with what follows if it is a blank, and else stands alone
        after = np.flatnonzero(begins[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1
        begins[after - 1] = True
        begins[after[points[after - 1] == 32]] = False
        # contractions
        quote = np.flatnonzero(begins & (points == 39) & ~special)
        at = lambda k: np.where(quote + k < n, points[np.minimum(quote + k, n - 1)], 0)
        inside = lambda k: (quote + k < n) & ~first[np.minimum(quote + k, n - 1)]
        one, two = at(1), at(2)
        short = inside(1) & np.isin(one, [ord(c) for c in "stmd"])
        long = inside(1) & inside(2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        begins[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        begins[ends[ends < n]] = True
        return begins

    def count(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text; text i is data[offsets[i]:offsets[i + 1]]."""
        if not data:
            return np.zeros(len(offsets) - 1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        places = np.flatnonzero((raw & 0xC0) != 0x80)
        first, special = np.zeros(len(points), bool), np.zeros(len(points), bool)
        heads = np.searchsorted(places, offsets[:-1])
        first[heads[heads < len(points)]] = True
        if self.special and any(s in data for s in self.specials):
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for m in self.special.finditer(data[start:end]):
                    a, b = np.searchsorted(places, [start + m.start(), start + m.end()])
                    special[a:b] = True
                    first[a] = True
                    if b < len(first):
                        first[b] = True
        begins = places[self.starts(points, first, special)]
        ends = np.append(begins, len(data)).astype(np.int64)
        stretches = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = stretches.dictionary_encode()
        alone = pc.is_in(coded.dictionary, value_set=pa.concat_arrays([self.whole, pa.array(self.specials, pa.large_binary())]))
        lengths = np.ones(len(coded.dictionary), np.int64)
        rest = np.flatnonzero(~alone.to_numpy(zero_copy_only=False))
        lengths[rest] = self.merged(coded.dictionary.take(pa.array(rest)))
        sums = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy(zero_copy_only=False)])])
        return np.diff(sums[np.searchsorted(begins, offsets)])

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text, a piece at a time."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        n_bytes, n_tokens = np.diff(offsets), np.zeros(len(texts), np.int64)
        data = memoryview(texts.buffers()[2] or b"")
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            own = offsets[i : j + 1] - offsets[i]
            whole = bytes(data[offsets[i] : offsets[j]])
            if len(whole) <= PIECE or not self.cuttable:
                n_tokens[i:j] = self.count(whole, own)
            else:  # one long text
                at = 0
                while at < len(whole):
                    cut = CUT.search(whole, at + PIECE)
                    end = cut.end() if cut else len(whole)
                    n_tokens[i] += self.count(whole[at:end], np.array([0, end - at]))[0]
                    at = end
            i = j
        return n_bytes, n_tokens


_known: dict[int, Vocabulary] = {}


def vocabulary(packed: bytes) -> Vocabulary:
    """The vocabulary of a packed definition, made once per worker."""
    key = hash(packed)
    if key not in _known:
        _known.clear()
        _known[key] = Vocabulary(zlib.decompress(packed).decode())
    return _known[key]


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row of (doc_id, text).

    ``path`` is the file of the vocabulary on the driver.
    """
    with open(path, "rb") as file:
        packed = zlib.compress(file.read())
    Vocabulary(zlib.decompress(packed).decode())  # a file that cannot be counted fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(packed)
        for batch in batches:
            n_bytes, n_tokens = own.counts(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, folder: str, name: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return counted(table(spark, folder, "documents"), public_tokenizers.path(name))
