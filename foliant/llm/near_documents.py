"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A shingle is ``SHINGLE`` consecutive plain words (all words of a shorter text), weighted by how often the text has it
times an inverse document frequency, so that passages which many documents share count little. Frequencies are counted
for each shingle (as a 64-bit hash) over all documents: documents are dealt into batches of bounded size, a batch sends
its distinct shingles packed by part of the hash space, and a part answers each batch in the order asked. Only packed
numbers come back, and parts and batches grow in number with the corpus and not in size.

Consistent weighted sampling draws ``BANDS * ROWS`` samples (shingle, quantised weight) of each text; two texts draw the
same sample with a probability of their weighted Jaccard similarity, sum of minima over sum of maxima. Texts that agree
on all rows of a band are candidates. Candidates are verified by their exact weighted similarity.

Most texts need no samples. A shingle that no other text has is in no intersection: if such shingles hold more than a
share of 1 - 0.8 of a text's weight, nothing is similar enough to it, whatever the rest. The exact frequencies tell these
shingles, so such texts are settled before they are sampled, and what others can have in common with a text bounds the
similarity of every pair.

A band bucket may hold very many texts. They are not paired with each other: in each round a bucket has a few leaders,
those of the least seeded hashes in its largest component, with whom its texts of other components are compared. What
links joins components, and rounds go on with other leaders while they find links (``FRUITFUL``). Every band has its own leaders. A
group of near copies is so connected with a few comparisons for each text. What is then still apart in a bucket is
settled without leaders: all its texts of different components are held against each other by their samples, in blocks
of bounded size, and what agrees in enough samples is verified. So no candidate is left out.

Equal texts (as plain words) are one text from the start, and copies are never expanded.

Nulls, ties, edges: null, empty and wordless texts are no one's copy; repeated rows are copies; the class of a text is
the smallest id in its group, where null ids do not count. Texts are looked up by a hash of theirs, so that one without an
id is compared and links others like any text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import MIX, PLAIN, encoded_words, fresh, mixed, table, word_hashes
from foliant.llm.components import components
from foliant.llm.packing import by_part, pack_keys, pack_numbers, unpack_keys, unpack_numbers
from foliant.session import materialise

SHINGLE = 5
#: A character of a plain word.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
LEAST = 0.8
BANDS, ROWS = 10, 3
#: Bytes of text in a batch whose shingles are counted together, on average.
BATCH_BYTES = 4 << 20
#: Candidates that agree in fewer of all samples are not looked at: of pairs with a similarity of 0.8 or more, fewer than one in a million does.
LEAST_AGREEING = 13
#: Leaders of a bucket in each round after the first.
LEADERS = 4
#: Rounds with leaders go on while one finds at least this many links for each entry left in an open bucket.
FRUITFUL = 0.001
#: Texts in a block when the rest of a bucket is compared.
BLOCK = 512
#: Ids of texts that are sent to all executors to find or drop these, 8 bytes each; more of them are joined by a shuffle.
MOST_SENT = 1 << 20
#: Shingles that are sampled at once, to stay within the processor's cache.
SLICE = 16_384
#: Share of a sum of weights by which it may be off.
SLACK = 1e-9


def _plain(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN) if text else b""


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes | None]]:
    """The distinct shingles of each text as hashes, how often each occurs, and a digest of the text's words."""
    counts, codes, words = encoded_words([_plain(t) for t in texts])
    hashes = word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * MIX + hashes[k : len(hashes) - size + 1 + k]
    rolled = mixed(rolled)
    found, often, keys, at = [], [], [], 0
    for n in counts:
        own = hashes[at : at + n]
        if n >= size:
            values = rolled[at : at + n - size + 1]
        else:
            value = np.zeros(1, np.uint64)
            for h in own:
                value = value * MIX + h
            values = mixed(value + np.uint64(n)) if n else value[:0]
        distinct, count = np.unique(values, return_counts=True)
        found.append(distinct)
        often.append(count)
        keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
        at += n
    return found, often, keys


def _asked(parts: int, size: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """How many texts of a batch have each of its shingles, by part."""
        keys, at = _batch_keys(shingles(rows.column("text").to_pylist(), size)[0], parts)
        counts = np.bincount(at, minlength=len(keys))
        every, starts = np.unique(keys % np.uint64(parts), return_index=True)
        cuts = [slice(*x) for x in zip(starts, [*starts[1:], len(keys)], strict=True)]
        columns = [
            pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            pa.array(every.astype(np.int64)),
            pa.array([pack_keys(keys[x], parts) for x in cuts], pa.binary()),
            pa.array([pack_numbers(counts[x]) for x in cuts], pa.binary()),
        ]
        return pa.table(columns, names=["batch", "part", "keys", "counts"])

    return run


def _answered(parts: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Add up the counts of a part's shingles and answer every batch in the order that it asked."""
        asked = [unpack_keys(x, key[0].as_py(), parts) for x in rows.column("keys").to_pylist()]
        distinct, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, np.concatenate([unpack_numbers(x) for x in rows.column("counts").to_pylist()]))
        back = np.split(total[at], np.cumsum([len(x) for x in asked])[:-1])
        return pa.table([rows.column("batch"), rows.column("part"), pa.array([pack_numbers(x) for x in back], pa.binary())], names=["batch", "part", "counts"])

    return run


def _batch_keys(found: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a batch, ordered by part, and the place of each text's shingles among them."""
    return by_part(np.concatenate([*found, np.empty(0, np.uint64)]), parts)


def weights_of(often: np.ndarray, counts: np.ndarray, documents: int) -> np.ndarray:
    """The weights of a text's shingles: how often it has each, times ln(1 + documents / documents that have it)."""
    return often * np.log1p(documents / counts)


def _uniform(values: np.ndarray, seed: int) -> list[np.ndarray]:
    """Three numbers in (0, 1) for each value."""
    z = mixed(values + np.uint64(seed * int(MIX) % (1 << 64)))
    low = np.uint64((1 << 21) - 1)
    return [(((z >> np.uint64(s)) & low).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21) for s in (0, 21, 42)]


def signatures(found: list[np.ndarray], weights: list[np.ndarray], samples: int = BANDS * ROWS) -> np.ndarray:
    """The samples of each text that has shingles, as 64-bit hashes."""
    out = np.zeros((len(found), samples), np.uint64)
    sizes = np.array([len(f) for f in found])
    some = np.flatnonzero(sizes)
    at = 0
    while at < len(some):
        ends = np.cumsum(sizes[some[at : at + 1024]])
        take = some[at : at + max(1, int(np.searchsorted(ends, SLICE, "right")))]
        at += len(take)
        values = np.concatenate([found[i] for i in take])
        log_weight = np.log(np.concatenate([weights[i] for i in take])).astype(np.float32)
        lengths = sizes[take]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for k in range(samples):
            u1, u2, shift = _uniform(values, 2 * k + 1)
            v1, v2, _ = _uniform(values, 2 * k + 2)
            r = -np.log(u1 * u2)
            step = np.floor(log_weight / r + shift)
            rank = np.log(-np.log(v1 * v2)) - r * (step - shift) - r
            least = np.minimum.reduceat(rank, starts)
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            _, first = np.unique(np.searchsorted(starts, hits, "right"), return_index=True)
            hits = hits[first]
            out[take, k] = mixed(values[hits] + step[hits].astype(np.int64).astype(np.uint64) * MIX)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two texts, each given by sorted shingles and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def signed(rows: DataFrame, documents: int, parts: int, size: int, least: float = LEAST) -> DataFrame:
    """(doc_id, digest, key, samples, weight, low, alone, counts) of each row; no key without words.

    ``weight`` is that of all shingles, ``counts`` in how many documents each of them occurs, packed, in the order of ``shingles``;
    ``low`` is the least of these, and ``alone`` the weight of the shingles that have it. No samples are drawn of a text
    that nothing else can be similar to.
    """

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found, often, keys = shingles(docs.column("text").to_pylist(), size)
        distinct, at = _batch_keys(found, parts)
        given = np.concatenate([*map(unpack_numbers, answers.sort_by("part").column("counts").to_pylist()), np.empty(0, np.int64)])
        if len(given) != len(distinct):
            raise ValueError("the documents of a batch have changed while their shingles were counted")
        counts = np.split(given[at], np.cumsum([len(x) for x in found])[:-1])
        weighed = [weights_of(n, c, documents) for n, c in zip(often, counts, strict=True)]
        low = np.array([c.min() if len(c) else 0 for c in counts], np.int64)
        weight = np.array([w.sum() for w in weighed])
        alone = np.array([w[c == n].sum() for w, c, n in zip(weighed, counts, low, strict=True)])
        partners = np.flatnonzero((low > 1) | (weight - alone >= least * weight * (1 - SLACK)))  # a frequency of 1: no copies either
        drawn = signatures([found[i] for i in partners], [weighed[i] for i in partners]).view(np.int64)
        samples: list[np.ndarray | None] = [None] * len(keys)
        for i, row in zip(partners.tolist(), drawn, strict=True):
            samples[i] = None if keys[i] is None else row
        columns = [docs.column("doc_id"), docs.column("digest"), pa.array(keys, pa.binary()), pa.array(samples, pa.list_(pa.int64()))]
        columns += [pa.array(weight, pa.float64()), pa.array(low), pa.array(alone, pa.float64()), pa.array([pack_numbers(c) for c in counts], pa.binary())]
        return pa.table(columns, names=["doc_id", "digest", "key", "samples", "weight", "low", "alone", "counts"])

    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("long").alias("batch"), "doc_id", F.xxhash64("text").alias("digest"), "text")
    asked = dealt.groupBy("batch").applyInArrow(_asked(parts, size), "batch long, part long, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answered(parts), "batch long, part long, counts binary")
    schema = "doc_id long, digest long, key binary, samples array<bigint>, weight double, low long, alone double, counts binary"
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def _verified(documents: int, least: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("a", "b"):  # a text is in many pairs
                text, key = (batch.column(f"{c}_{side}").dictionary_encode() for c in ("text", "key"))
                both = text.indices.to_numpy().astype(np.int64) * len(key.dictionary) + key.indices.to_numpy()
                _, first, at = np.unique(both, return_index=True, return_inverse=True)
                rows = batch.take(pa.array(first))
                found, often, keys = shingles(rows.column(f"text_{side}").to_pylist(), size)
                wanted = zip(found, often, keys, rows.column(f"key_{side}").to_pylist(), rows.column(f"counts_{side}").to_pylist(), strict=True)
                weighed = [(f, weights_of(n, unpack_numbers(c), documents)) if k == w else None for f, n, k, w, c in wanted]  # hashes may be shared by other texts
                sides.append([weighed[i] for i in at])
            links = [x is not None and y is not None and similarity(x, y) >= least for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


def classes(docs: DataFrame, least: float = LEAST, size: int = SHINGLE) -> DataFrame:
    """(doc_id, key, class_id) of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    documents, bytes_ = rows.agg(F.count_if(F.rlike("text", F.lit(WORD))), F.sum(F.octet_length("text"))).first()
    signs = materialise(signed(rows, documents, max(1, -(-(bytes_ or 0) // BATCH_BYTES)), size, least), "signed")
    kept = [F.first(c).alias(c) for c in ("samples", "weight", "low", "alone", "counts")]
    texts = signs.filter("samples is not null").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.min("digest").alias("digest"), F.count(F.lit(1)).alias("copies"), *kept)
    # what only the copies of a text have is not shared with any other
    shared_weight = F.col("weight") - F.when(F.col("low") == F.col("copies"), F.col("alone")).otherwise(0.0)
    texts = texts.withColumn("common", shared_weight * (1 + SLACK)).drop("low", "alone", "copies")
    texts = materialise(texts.withColumn("gid", F.monotonically_increasing_id()), "texts")

    bands = F.posexplode(F.array(*[F.xxhash64(F.lit(b), *[F.col("samples")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)]))
    buckets = texts.filter(F.col("common") >= least * F.col("weight")).select(bands.alias("band", "bucket"), "gid")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = materialise(buckets.join(shared, "bucket"), "buckets").withColumn("component", F.col("gid"))

    named = texts.select("gid", F.col("gid").alias("component"))
    tested, number, last = None, 0, False
    while True:
        pairs = _rest_pairs(buckets, texts, least=least) if last else _next_pairs(buckets, number)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        new = materialise(_linked_pairs(pairs, texts, rows, documents, least, size), "verified")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        number += 1
        links = new.count()
        if not links:
            if last:
                break
            last = True
            continue
        joined = materialise(components(new), "components").select(F.col("node").alias("component"), F.col("component").alias("into"))
        renamed = F.coalesce("into", "component").alias("component")
        named = materialise(named.join(joined, "component", "left").select("gid", renamed), "named")
        labelled = buckets.join(joined, "component", "left").select("bucket", "band", "gid", renamed)
        still = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        if last:
            break
        buckets = materialise(labelled.join(still.select("bucket"), "bucket", "left_semi"), "buckets")
        last = links < FRUITFUL * buckets.count()

    whole = texts.select("gid", "key", "least_id").join(named, "gid")
    ids = whole.groupBy("component").agg(F.min("least_id").alias("class_id"))
    members = whole.join(ids, "component").select("key", "class_id", "component")
    out = signs.select("doc_id", "key").join(members, "key", "left")
    return out.select("doc_id", "key", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _next_pairs(buckets: DataFrame, number: int) -> DataFrame:
    """(a, b, of_a, of_b): texts to be compared in round ``number``, and their components.

    The leaders of a bucket are of its largest component, so that comparisons go to the texts that are not yet in it.
    """
    sizes = buckets.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "component")).alias("largest")
    several = sizes.groupBy("bucket").agg(largest, F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("bucket", F.col("largest.component").alias("leads"))
    open_buckets = buckets.join(several, "bucket")
    seeds = [number * LEADERS + i for i in range(LEADERS if number else 1)]
    least = [F.min(F.struct(F.xxhash64(F.lit(seed), F.col("bucket"), F.col("gid")), "gid"))["gid"] for seed in seeds]
    leaders = open_buckets.filter("component = leads").groupBy("bucket").agg(F.array_distinct(F.array(*least)).alias("leaders"))
    pairs = open_buckets.filter("component <> leads").join(leaders, "bucket").select("gid", "component", "leads", F.explode("leaders").alias("leader"))
    turned = F.col("gid") > F.col("leader")
    in_order = lambda x, y: (F.when(turned, y).otherwise(x), F.when(turned, x).otherwise(y))
    a, b = in_order(F.col("gid"), F.col("leader"))
    of_a, of_b = in_order(F.col("component"), F.col("leads"))
    return pairs.select(a.alias("a"), b.alias("b"), of_a.alias("of_a"), of_b.alias("of_b")).distinct()


def _rest_pairs(buckets: DataFrame, texts: DataFrame, block: int = BLOCK, least: float = LEAST) -> DataFrame:
    """(a, b, of_a, of_b): all texts of different components of a bucket that agree in enough samples.

    Each bucket is cut into blocks: those of its largest component are compared with all others, but not with each other.
    Where the band of a bucket and the weights of texts are known, a pair is given by the first band that it shares, and
    only if the weights allow it.
    """
    buckets = buckets if "band" in buckets.columns else buckets.withColumn("band", F.lit(-1))
    texts = texts if "common" in texts.columns else texts.withColumns({"weight": F.lit(1.0), "common": F.lit(1.0)})
    sizes = buckets.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda n: F.ceil(n / block)
    cut = whole.filter("parts > 1").select(
        "bucket", F.col("largest.component").alias("leads"), blocks(F.col("largest.n")).alias("n_lead"), blocks(F.col("n") - F.col("largest.n")).alias("n_other")
    )
    held = buckets.join(cut, "bucket").join(texts.select("gid", "samples", "weight", "common"), "gid")
    leads, among = F.col("component") == F.col("leads"), F.xxhash64("gid")
    own = F.when(leads, F.col("n_other") + F.pmod(among, "n_lead")).otherwise(F.pmod(among, "n_other"))
    to = F.when(leads, F.col("n_other") - 1).otherwise(F.col("n_other") + F.col("n_lead") - 1)
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), to)))
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    held = held.select(cell.alias("cell"), "gid", "component", "samples", "band", "weight", "common", (F.col("own") <= F.col("other")).alias("one"), (F.col("own") >= F.col("other")).alias("two"))
    return held.repartition("cell").sortWithinPartitions("cell").mapInArrow(_agreeing(least), "a long, b long, of_a long, of_b long").distinct()


COLUMNS = ("cell", "gid", "component", "samples", "band", "weight", "common", "one", "two")


def _agreeing(least: float):
    """Rows sorted by cell: each row marked ``one`` with each row marked ``two`` of the cell, if they agree enough."""

    def compare(cell, gid, component, samples, band, weight, common, one, two) -> list[np.ndarray]:
        found = [np.empty((0, 4), np.int64)]
        edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            left, right = start + np.flatnonzero(one[start:end]), start + np.flatnonzero(two[start:end])
            for at in range(0, len(left), BLOCK):
                x = left[at : at + BLOCK]
                same = np.zeros((len(x), len(right)), np.uint8)
                for k in range(samples.shape[1]):
                    same += samples[x, k][:, None] == samples[right, k]
                i, j = np.nonzero((same >= LEAST_AGREEING) & (component[x][:, None] != component[right]))
                i, j = x[i], right[j]
                both = np.minimum(common[i], common[j])
                kept = both >= (weight[i] + weight[j] - both) * (least - SLACK)
                kept &= (gid[i] < gid[j]) | ~(two[i] & one[j])  # else the pair is also seen the other way round
                i, j = i[kept], j[kept]
                if len(i) and band[start] >= 0:
                    agree = (samples[i] == samples[j]).reshape(len(i), BANDS, ROWS).all(axis=2)
                    first = agree.any(axis=1) & (agree.argmax(axis=1) == band[start])
                    i, j = i[first], j[first]
                i, j = np.where(gid[i] < gid[j], i, j), np.where(gid[i] < gid[j], j, i)
                found.append(np.stack([gid[i], gid[j], component[i], component[j]], axis=1))
        return list(np.concatenate(found).T)

    def sent(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in compare(*columns)], names=["a", "b", "of_a", "of_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            samples = batch.column("samples").flatten().to_numpy().reshape(batch.num_rows, -1)
            new = [samples if n == "samples" else batch.column(n).to_numpy(zero_copy_only=False) for n in COLUMNS]
            rows = new if kept is None else [np.concatenate(pair) for pair in zip(kept, new, strict=True)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last cell may go on in the next batch
            yield sent([c[:whole] for c in rows])
            kept = [c[whole:] for c in rows]
        if kept is not None:
            yield sent(kept)

    return run


def _sent(ids: DataFrame) -> DataFrame:
    """Written ids, to be sent to all executors while they are few enough."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def _linked_pairs(pairs: DataFrame, texts: DataFrame, rows: DataFrame, documents: int, least: float, size: int) -> DataFrame:
    """The components (a, b) of texts that are similar enough, judged first by their samples and then by the texts."""
    named = {"gid": "", "digest": "digest_", "samples": "samples_", "weight": "weight_", "common": "common_"}
    one, other = (texts.select(*[F.col(c).alias(f"{prefix}{s}") for c, prefix in named.items()]) for s in "ab")
    agreeing = F.size(F.filter(F.zip_with("samples_a", "samples_b", lambda x, y: x == y), lambda x: x))
    # the sum of minima is at most what both can share, and the sum of maxima is all weight without it
    both = F.least("common_a", "common_b")
    possible = both >= (F.col("weight_a") + F.col("weight_b") - both) * (least - SLACK)
    close = pairs.join(one, "a").join(other, "b").filter(possible & (agreeing >= LEAST_AGREEING)).drop("samples_a", "samples_b", "weight_a", "weight_b", "common_a", "common_b")
    close = materialise(close, "close")
    ends = [F.struct(F.col(s).alias("gid"), F.col(f"digest_{s}").alias("digest")) for s in "ab"]
    wanted = _sent(materialise(close.select(F.explode(F.array(*ends)).alias("end")).select("end.*").distinct(), "wanted"))
    found = rows.select(F.xxhash64("text").alias("digest"), "text").join(wanted.select("digest"), "digest", "left_semi").distinct()
    whole = texts.select("gid", "key", "counts").join(wanted, "gid").join(found, "digest")
    for s in "ab":
        side = whole.select(F.col("gid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("key", "counts", "text")])
        close = close.join(side, s)
    close = close.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"), *[f"{c}_{s}" for c in ("key", "counts", "text") for s in "ab"])
    return close.mapInArrow(_verified(documents, least, size), "a long, b long").distinct()


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The document of the smallest id of each group, whole and unchanged; of repeated rows one stays.

    Documents without an id are kept. Where several texts share an id, they stay if one of them is the first of its group.
    """
    (doc,) = fresh(docs, "class_doc")
    rows = materialise(classes(docs, least), "classes")
    by_id = rows.groupBy(F.col("doc_id").alias(doc)).agg(F.max(F.col("doc_id") == F.col("class_id")).alias("first"))
    gone = _sent(materialise(by_id.filter("not first").select(doc), "gone"))
    kept = docs.join(gone, F.col("doc_id") == F.col(doc), "left_anti")
    again = rows.filter("key is not null").groupBy(F.col("doc_id").alias(doc), "key").count().filter("count > 1").select(doc).distinct()
    again = materialise(again, "repeated")
    if again.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col(doc))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = classes(table(spark, folder, "documents"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
