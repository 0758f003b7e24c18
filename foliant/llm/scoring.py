"""Language-model scores by deleted interpolation of bigrams.

P(w | v) = a(b) c(v,w)/c(v) + l(b) c(w)/N + u(b) / (V+1), where b is the bucket of the context's count c(v), on a scale of
powers of two. The weights of each bucket are learned by expectation-maximisation on deleted counts: each training token
is predicted from all other training tokens, that is with one taken off its own counts.

Counting. Documents are dealt into batches of bounded size. A batch sends each distinct word and word pair once, as a
64-bit hash with its count in training documents, packed by part of the hash space. A part adds the counts up and
answers each batch in the order asked, so that no key travels back. The batch then knows the counts of all its tokens,
which are kept as packed numbers, and sums for learning and scores are one pass over these. A key that occurs everywhere
is one entry per batch. All parts, batches and sums grow in number with the corpus and not in size.

Learning needs how many training tokens have which bucket and which pair of estimates; estimates are grouped on a
logarithmic scale, which bounds that table, and only it reaches the driver.

Nulls, ties, edges: a null or empty text is its end token alone; a null id counts as empty and so is held out; repeated
rows count as often as they occur; with no training tokens all tokens have the probability 1 / (V+1) = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import MIX, encoded_words, mixed, table, word_hashes
from foliant.llm.packing import by_part, pack_keys, pack_numbers, unpack_keys, unpack_numbers
from foliant.session import materialise

FOLDS = 10
ALPHA = 0.1
#: Bytes of text in a batch, on average, and about as many bytes of requests in a part.
BATCH_BYTES = 6 << 20
ROUNDS = 60
#: Steps for each doubling of an estimate when estimates are grouped.
STEPS = 2
START_KEY, END_KEY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class Tokens:
    """The tokens of some texts, and the distinct keys that they ask for, ordered by part."""

    def __init__(self, texts: list[str | None], parts: int):
        lowered = pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string()))
        counts, codes, words = encoded_words([x.encode("utf-8", "surrogatepass") for x in lowered.to_pylist()])
        n = len(words)  # code n: the end of a text, n + 1: its start
        hashes = np.concatenate([word_hashes(words), [END_KEY, START_KEY]])
        self.lengths = counts + 1
        self.ends = np.cumsum(self.lengths)
        self.words = np.insert(codes, np.cumsum(counts), n) if len(texts) else codes
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[np.concatenate([[0], self.ends[:-1]]) if len(texts) else []] = n + 1
        self.pairs = mixed(hashes[before] * MIX + hashes[self.words])
        self.word_keys, word_of = by_part(mixed(hashes), parts)
        self.word_at = word_of[self.words]
        self.before_at = word_of[before]
        self.pair_keys, self.pair_at = by_part(self.pairs, parts)
        self.word_parts, self.pair_parts = (k % np.uint64(parts) for k in (self.word_keys, self.pair_keys))


ASKED = "batch long, part long, words binary, word_counts binary, pairs binary, pair_counts binary"


def _asked(parts: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tokens = Tokens(rows.column("text").to_pylist(), parts)
        learns = np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool), tokens.lengths)
        n_words, n_pairs = (np.bincount(at[learns], minlength=len(keys)) for at, keys in ((tokens.word_at, tokens.word_keys), (tokens.pair_at, tokens.pair_keys)))
        starts = learns & np.isin(np.arange(len(tokens.words)), np.concatenate([[0], tokens.ends[:-1]]))
        n_words += np.bincount(tokens.before_at[starts], minlength=len(tokens.word_keys))  # the start of a text is counted as a context
        every = np.union1d(tokens.word_parts, tokens.pair_parts)
        cut = lambda keys, at, p: slice(*np.searchsorted(at, [p, p + np.uint64(1)]))
        out = []
        for p in every:
            w, q = cut(tokens.word_keys, tokens.word_parts, p), cut(tokens.pair_keys, tokens.pair_parts, p)
            out.append((key[0].as_py(), int(p), pack_keys(tokens.word_keys[w], parts), pack_numbers(n_words[w]), pack_keys(tokens.pair_keys[q], parts), pack_numbers(n_pairs[q])))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64()] + [pa.binary()] * 4, strict=True)], names=["batch", "part", "words", "word_counts", "pairs", "pair_counts"])

    return run


ANSWERS = "batch long, part long, words binary, pairs binary"


def _answered(parts: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Add up the counts of a part's keys and answer every batch in the order that it asked.

        A word's answer is twice its count, plus one for the one batch that is to count it as a member of the vocabulary.
        """
        answers = []
        for keys, counts in (("words", "word_counts"), ("pairs", "pair_counts")):
            asked = [unpack_keys(x, key[0].as_py(), parts) for x in rows.column(keys).to_pylist()]
            given = np.concatenate([unpack_numbers(x) for x in rows.column(counts).to_pylist()])
            flat = np.concatenate(asked)
            distinct, first, at = np.unique(flat, return_index=True, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, at, given)
            back = total[at]
            if keys == "words":
                back = back * 2
                back[first[(total > 0) & (distinct != mixed(np.array([START_KEY]))[0])]] += 1
            answers.append([pack_numbers(x) for x in np.split(back, np.cumsum([len(a) for a in asked])[:-1])])
        return pa.table([rows.column("batch"), rows.column("part"), pa.array(answers[0], pa.binary()), pa.array(answers[1], pa.binary())], names=["batch", "part", "words", "pairs"])

    return run


COUNTED = "doc_ids array<bigint>, held_out array<boolean>, lengths binary, words binary, pairs binary, first long, owned long, train_tokens long"


def _counted(parts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(docs.column("text").to_pylist(), parts)
        answers = answers.sort_by("part")
        words, pairs = (np.concatenate([unpack_numbers(x) for x in answers.column(c).to_pylist()]) for c in ("words", "pairs"))
        owned, words = int((words & 1).sum()), words >> 1
        held = docs.column("held_out").to_pylist()
        train = int(tokens.lengths[~np.array(held, bool)].sum())
        first = int(words[tokens.before_at[0]])
        row = (docs.column("doc_id").to_pylist(), held, pack_numbers(tokens.lengths), pack_numbers(words[tokens.word_at]), pack_numbers(pairs[tokens.pair_at]), first, owned, train)
        kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_())] + [pa.binary()] * 3 + [pa.int64()] * 3
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names="doc_ids held_out lengths words pairs first owned train_tokens".split())

    return run


def counted(docs: DataFrame) -> DataFrame:
    """One row per batch: its documents, and for each of their tokens the training counts of the word and of the pair."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // BATCH_BYTES))
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0
    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("long").alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    asked = dealt.groupBy("batch").applyInArrow(_asked(n), ASKED)
    answers = asked.groupBy("part").applyInArrow(_answered(n), ANSWERS)
    return materialise(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_counted(n), COUNTED), "counted")


class _Batch:
    """Counts of the tokens of one stored row, and of their contexts."""

    def __init__(self, row: dict):
        self.ids, self.held, self.first = row["doc_ids"], np.array(row["held_out"], bool), row["first"]
        self.lengths, self.words, self.pairs = (unpack_numbers(row[c]) for c in ("lengths", "words", "pairs"))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.contexts = np.empty_like(self.words)
        self.contexts[1:] = self.words[:-1]
        self.contexts[self.starts] = self.first


def bucket(contexts: np.ndarray) -> np.ndarray:
    """0 for contexts not seen, else one more than the whole part of the binary logarithm of the count."""
    return np.where(contexts > 0, np.floor(np.log2(np.maximum(contexts, 1))) + 1, 0).astype(np.int64)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=(a > 0) & (b > 0))


GROUPS = "bucket long, pair_step long, word_step long, n double, pair double, word double"


def _grouped(total: int):
    def steps(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Batch(row)
                learns = np.repeat(~b.held, b.lengths)
                context, pair, word = (x[learns] - 1 for x in (b.contexts, b.pairs, b.words))
                p2, p1 = _ratio(pair, context), _ratio(word, np.full(len(word), max(total - 1, 0)))
                code, at = np.unique((bucket(context) << 32) - (steps(p2) - 1 << 16) - (steps(p1) - 1), return_inverse=True)
                sums = [np.bincount(at, w, len(code)) for w in (np.ones(len(p2)), p2, p1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code >> 32, code >> 16 & 0xFFFF, code & 0xFFFF, *sums)], names=["bucket", "pair_step", "word_step", "n", "pair", "word"])

    return run


def learned(groups: list[tuple], uniform: float) -> dict[int, tuple[float, float, float]]:
    """The weights of each bucket; buckets of contexts that only occur once share the weights of unseen ones."""
    out = {}
    data = np.array(groups, float).reshape(-1, 4)
    for b in np.unique(data[:, 0]).astype(int):
        rows = data[data[:, 0] == b]
        n = rows[:, 1]
        p = np.stack([rows[:, 2] / n, rows[:, 3] / n, np.full(len(n), uniform)])
        weights = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
        for _ in range(ROUNDS):
            parts = weights[:, None] * p
            weights = (parts / np.maximum(parts.sum(0), 1e-300) * n).sum(1) / n.sum()
        weights = np.maximum(weights, [1e-6 if b else 0, 1e-6, 1e-6])  # nothing that was never needed is impossible
        out[int(b)] = tuple(weights / weights.sum())
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(total: int, vocabulary: int, weights: dict[int, tuple[float, float, float]]):
    known = sorted(weights)
    lookup = np.array([weights[max([k for k in known if k <= b], default=known[0])] if known else (0.0, 0.0, 1.0) for b in range(66)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Batch(row)
                w = lookup[bucket(b.contexts)]
                p = w[:, 0] * _ratio(b.pairs, b.contexts) + w[:, 1] * _ratio(b.words, np.full(len(b.words), total)) + w[:, 2] / (vocabulary + 1)
                base = np.log10((b.words + ALPHA) / (total + ALPHA * (vocabulary + 1)))
                sums = [np.add.reduceat(x, b.starts) for x in ((b.words > 0).astype(np.int64), base, np.log10(p))]
                columns = [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(sums[0]), pa.array(np.full(len(b.ids), total)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def scored(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model learned from those that are not held out."""
    batches = counted(docs)
    total, vocabulary = batches.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("owned"), F.lit(0))).first()
    cells = batches.mapInArrow(_grouped(total), GROUPS).groupBy("bucket", "pair_step", "word_step").agg(*[F.sum(c).alias(c) for c in ("n", "pair", "word")])
    weights = learned(cells.select("bucket", "n", "pair", "word").collect(), 1 / (vocabulary + 1))
    return batches.mapInArrow(_scored(total, vocabulary, weights), SCORES)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents").select("doc_id", "text"))
