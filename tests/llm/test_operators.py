"""The text operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, components, decontaminate, line_runs, mixing, near_documents, near_vectors, quality, repeats, scoring, sharding

DOC = "doc_id long, text string, source string, size string"
PASSAGE = "a passage of more than fifty bytes that several of the documents share, word by word"
TEXTS = [
    (0, f"first {PASSAGE} and more", "b"),
    (1, f"second\n{PASSAGE}\nthird line\nfourth line\nfifth", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, f"{PASSAGE} {PASSAGE} größe größe größe", "a"),
    (4, f"{PASSAGE} {PASSAGE} größe größe größe", "a"),
    (5, "x" * 300, "c"),
    (6, "y" + "x" * 120, "c"),
    (7, "new\nthird line\nfourth line\nfifth\n\nthird line\nfourth line\nfifth", "b"),
    (8, "word " * 3000 + PASSAGE, "a"),
    (None, f"no id {PASSAGE}", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in TEXTS], DOC).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_mixing(docs, empty):
    sizes = mixing.measured(docs)
    rows = mixing.copies(sizes, mixing.plan(sizes), keep=("source_size", "target")).collect()
    words = {r.doc_id: r.size for r in rows}
    assert words[2] == words[3] == 0 and words[8] == 3000 + len(PASSAGE.split())
    total, by_source, targets, taken = sum(r["size"] for r in rows), Counter(), {}, Counter()
    for r in rows:
        by_source[r.source] += r["size"]
        targets[r.source] = r.target
        taken[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 3
    weight, left, want = {"a": 5, "b": 2, "c": 1, None: 5}, float(total), {}
    open_ = set(weight)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * by_source[s]}
        want |= {s: 3 * by_source[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(3 * by_source[s] for s in full)
        open_ = open_ - full if full else set()
    assert targets == pytest.approx(want) and all(taken[s] <= targets[s] + 1e-6 for s in taken)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.copies(sizes, mixing.plan(sizes), keep=("source_size", "target")).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mixed_documents(empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), (F.col("id") % 97 + 1).alias("size"))
    out = mixing.copies(rows, mixing.plan(rows), keep=("target",)).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect()
    assert all(abs(r.n - r.t) <= 2 for r in out)


def test_mix_fills_until_nothing_fits(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"s{int(rng.integers(0, 9))}", int(x)) for i, x in enumerate(np.concatenate([rng.integers(1, 40, 300), rng.integers(500, 4000, 60), [0, 0, 0]]))]
    rows += [(1000, "big", 5000), (1001, "big", 40), (1002, "big", 30), (1003, "big", 7), (1004, None, 90), (1004, None, 10), (1005, None, 3)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.copies(sizes, mixing.plan(sizes), keep=("target", "source_size")).collect()
    assert len(out) == len(rows)
    units, taken, targets = {}, Counter(), {}
    for r in out:
        unit = units.setdefault((r.source, r.doc_id), [0, r.copies])
        unit[0] += r.size
        assert unit[1] == r.copies <= 3
        taken[r.source] += r.copies * r.size
        targets[r.source] = (r.target, r.source_size)
    for source, (target, size) in targets.items():
        room = target - taken[source]
        assert room > -1e-6
        whole = int(target / size + 1e-12) if size else 0
        left = [n for (s, _), (n, c) in units.items() if s == source and c == whole and n > 0]
        assert all(n > room for n in left) or taken[source] >= target - 1e-6


def test_chat(spark):
    odd = "<|im_end|> <\\|x and \\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "there"), (1, 2, "user", odd), (2, 0, "user", "hi"), (2, 1, "assistant", "there"), (2, 2, "assistant", None), (3, 0, "user", "hi"), (3, 1, "assistant", "there")]
    rows += [(4, 0, "us\\er\n<|", "x" * 5000), (4, None, "assistant", odd), (None, 1, "user", "a"), (5, 1, "user", "t"), (5, 1, "user", "t"), (6, 0, "user", "hi"), (6, 1, "assistant", "other")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.packed(table)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), role, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.formatted(r, t)) for _, r, t in turns)
    nodes = sorted(out.nodes.collect(), key=lambda n: n.offset)
    at = 0
    for n in nodes:  # one sequence without gaps, parents before children
        assert n.offset == at and n.length == len(n.formatted)
        at += n.length
    assert sum(n.formatted.count("hi<") for n in nodes) == 1
    assert chat.digests(chat.packed(table.limit(0))).count() == 0


def test_chats_with_one_first_turn_are_read_back_turn_by_turn(spark):
    """A first turn that all share, and a long conversation that others leave at every depth: as many rows as turns."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 else f"{c} {t}") for c in range(300) for t in range(3)]
    rows += [(1000 + c, t, "user", "hello" if t == 0 else f"long {t}" if t < c else f"own {c}") for c in range(1, 40) for t in range(c + 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.packed(table)
    back = chat.unpacked(out)
    assert back.count() == len(rows) and out.nodes.filter("depth = 0").count() == 1
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "segment" in plan and "depth" in plan and " >= " not in plan.split("Join Inner")[1].split("\n")[0]
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    for c in (0, 299, 1001, 1039):
        own = [(r, t) for i, _, r, t in sorted(rows) if i == c]
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()


def test_quality(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(80)]
    make = lambda bad: " ".join(rng.choice(words, 60)) + {2: "", 1: " x!! y!! z!!" * 8, 0: " vile"}[bad]
    grades = [int(g) for g in rng.choice([0, 1, 2, 2], 600)]
    docs = spark.createDataFrame([(i, make(g), "clash") for i, g in enumerate(grades)] + [(9000, None, ""), (9001, "", "")], "doc_id long, text string, tail string")
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, g in enumerate(grades) if i < 400] + [(401, None, None)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.good_documents(docs, labels).collect()}
    right = [(i in kept) == (g == 2) for i, g in enumerate(grades) if i >= 400]
    assert sum(right) / len(right) > 0.95 and quality.good_documents(docs, labels).columns == docs.columns
    assert quality.good_documents(docs, labels.limit(0)).count() == docs.count()


def test_repeats(docs, empty):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed_spans(docs).collect()), key=str)
    rows = [(math.inf if i is None else i, (t or "").encode()) for i, t, _ in TEXTS]
    first = {}
    for i, data in rows:
        for p in range(len(data) - 49):
            s = data[p : p + 50]
            first[s] = min(first.get(s, math.inf), i)
    want = []
    for (i, data), (doc_id, _, _) in zip(rows, TEXTS, strict=True):
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        want.append((doc_id, len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert repeats.removed_spans(empty).count() == 0


@pytest.mark.parametrize("block_words", [200_000, 5])
def test_decontamination(spark, docs, empty, block_words):
    items = spark.createDataFrame([(1, PASSAGE), (2, "GRÖSSE größe"), (10, "größe, GRößE"), (3, None), (4, "..."), (5, "x"), (None, "fourth line")], "item_id long, text string")
    out = decontaminate.matches(docs, items, block_words=block_words).collect()

    def judge(text):
        doc, hit, found = decontaminate.plain_words(text), set(), set()
        for r in items.collect():
            words = decontaminate.plain_words(r.text)
            n = min(10, len(words))
            for a in range(len(words) - n + 1 if n else 0):
                for b in range(len(doc) - n + 1):
                    if doc[b : b + n] == words[a : a + n]:
                        hit |= set(range(b, b + n))
                        found |= {str(r.item_id)} if r.item_id is not None else set()
        return len(doc), len(hit), sorted(found)

    for r in out:
        n, hit, found = judge(r.text)
        assert (r.found.n_words, sum(w.end - w.start for w in r.found.words), r.found["items"]) == (n, hit, found)
        for w, c in zip(r.found.words, r.found.chars, strict=True):
            assert len(decontaminate.plain_words(r.text[c.start : c.end])) == w.end - w.start
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.clean_documents(docs, items).columns == docs.columns
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == docs.count()


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 6))
    data = [(i, [float(x) for x in (centres[i % 40] + rng.normal(size=6) * 0.08) * (1 + i % 3)], i % 2) for i in range(600)]
    data += [(1000 + i, data[3][1], 1) for i in range(5)] + [(2000, None, 1), (2001, [0.0] * 6, 1), (2002, [math.nan] * 6, 1), (2003, data[3][1], None), (2004, [1.0, None], 0), (2005, [1.0, 2.0], 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    ok = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in data if i < 2000]
    x = np.array([v / np.linalg.norm(v) for _, v, _ in ok])
    linked = (x @ x.T >= 0.98) & (np.array([l for *_, l in ok])[:, None] == np.array([l for *_, l in ok]))
    np.fill_diagonal(linked, False)
    low = np.arange(len(ok))
    for _ in range(len(ok)):
        new = np.minimum(low, np.where(linked, low, len(ok)).min(1))
        if (new == low).all():
            break
        low = new
    want = {i: (int(n), ok[c][0]) for (i, _, _), n, c in zip(ok, linked.sum(1), low, strict=True)} | {i: (0, i) for i, *_ in data if i >= 2000}
    for cell in (4000, 60):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.linked(table, cell_rows=cell, pivots=8).collect()}
        assert got == want
    assert near_vectors.linked(table.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (200, 100), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}


def test_sharding(spark, docs, empty):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    out = sharding.placed(rows).collect()
    for r in out:
        assert r.grown_shard in (r.shard, 40)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(40))
    texts = {i: t for i, t, _ in TEXTS}
    for r in out:
        if r.doc_id in (None, 2, 4) and r["size"] != 18:
            data = (texts[r.doc_id] or "").encode()
            assert r["size"] == len(data) + 16 and (r.text_crc32 == zlib.crc32(data) or texts[r.doc_id] is None)
    weighted = Counter(r.s for r in sharding.assign(rows, [3.0, 1.0], into="s").collect())
    assert 2.5 < weighted[0] / weighted[1] < 3.6
    assert sharding.placed(empty).count() == 0 and sharding.assign(docs, into="size").count() == len(TEXTS)


def test_near_documents(spark, empty):
    rng = np.random.default_rng(3)
    base = [[f"v{x}" for x in rng.integers(0, 5000, 120)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(30):
        for k in (1, 2):
            copy = list(base[i])
            copy[rng.integers(0, 120)] = "changed"
            rows.append((100 * k + i, " ".join(copy).title()))
    rows += [(400, " ".join(base[0])), (400, " ".join(base[0])), (500, None), (501, ""), (502, "..."), (503, "two words"), (504, "Two, words!"), (505, "word " * 20000), (None, "two words")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {r.doc_id: r.class_id for r in near_documents.classes(table).collect()}
    want = {i: (i % 100 if i is not None and i < 400 else i) for i, _ in rows} | {400: 0, 504: 503, None: 503}
    assert got == want
    kept = near_documents.one_of_each(table).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [*range(30), 500, 501, 502, 503, 505] and len(kept) == 36
    assert near_documents.classes(empty).count() == 0
    doubled = near_documents.one_of_each(table.filter("doc_id = 400"))
    assert doubled.count() == 1 and doubled.columns == table.columns


def test_scoring(docs, empty):
    got = sorted(scoring.scored(docs).collect(), key=str)
    split = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (t or "").split()] + [None]
    train = [split(t) for i, t, _ in TEXTS if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    words = Counter(w for d in train for w in d)
    total, vocabulary = sum(words.values()), len(words)
    base = {}
    for i, t, _ in TEXTS:
        base[i] = (len(split(t)), sum(words[w] > 0 for w in split(t)), sum(math.log10((words[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in split(t)))
    for r in got:
        n, known, score = base[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(score)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10 == 0) and r.score <= 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert scoring.scored(empty).count() == 0
    weights = scoring.learned([(0, 10.0, 0.0, 1.0), (3, 5.0, 2.5, 0.1), (3, 5.0, 0.0, 0.2)], 0.01)
    assert all(sum(w) == pytest.approx(1) and min(w) >= 0 for w in weights.values()) and weights[0][0] == 0


def test_line_runs(docs, empty):
    out = line_runs.without_repeats(docs.filter("doc_id is not null"))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.text) for r in out.collect()}
    assert got[7] == (8, 6, 2, "new\n") and got[1][1] == 0 and got[2] == (0, 0, 0, None) and got[3][:3] == (1, 0, 0)
    assert got[8][1] == 0 and set(docs.columns) <= set(out.columns) and line_runs.without_repeats(empty).count() == 0


def test_line_runs_by_words(spark):
    rng = np.random.default_rng(4)
    passage = [" ".join(f"p{k}" for k in range(23)), " ".join(f"q{k}" for k in range(46))]
    lines = ["a", "b c", *passage, "w " * 51, "v " * 30, "u " * 25, ""]
    rows = [(1, "one\n" + "\n".join(passage)), (2, "\n\n".join(passage) + "\ntwo"), (3, None), (4, passage[1] + "\n" + passage[0]), (5, passage[0])]
    rows += [(10 + i, "\n".join(f"own{i}" if rng.random() < 0.3 else str(rng.choice(lines)) for _ in range(rng.integers(1, 14)))) for i in range(60)]

    def removed():
        kept = {i: [(n, x.strip(" ")) for n, x in enumerate((t or "").split("\n")) if x.strip(" ")] for i, t in rows}
        first, gone = {}, {i: set() for i, _ in rows}
        for span in (1, 2, 3):
            for i in sorted(kept):
                for at in range(len(kept[i]) - span + 1):
                    run = kept[i][at : at + span]
                    words = sum(x.count(" ") + 1 for _, x in run)
                    if span == 3 or words >= 50:
                        doc, place = first.setdefault(tuple(x for _, x in run), (i, at))
                        if doc != i or at >= place + span:
                            gone[i] |= {n for n, _ in run}
        return {i: sorted(x) for i, x in gone.items() if x}

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed()
    assert {r.doc_id: r.removed for r in line_runs.repeated_lines(docs).collect()} == want
    assert want.get(2) == [0, 2] and 4 not in want and 5 not in want
    clash = line_runs.without_repeats(docs.withColumn("n_lines", F.lit(7)).withColumn("n_runs", F.lit("x")))
    assert clash.filter("n_lines <> 7 or n_runs <> 'x'").isEmpty() and {"_n_lines", "n_removed", "_n_runs"} <= set(clash.columns)
    got = {r.doc_id: (r.n_removed, r.text) for r in line_runs.without_repeats(docs).collect()}
    assert got[1] == (0, rows[0][1]) and got[2] == (2, "\ntwo")


def test_near_documents_count_each_shingle(spark):
    rng = np.random.default_rng(5)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, " ".join(f"n{x}" for x in rng.integers(0, 10**9, 400)) + f" {shared}") for i in range(400)] + [(900, None), (901, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, often, _ = near_documents.shingles([t for _, t in rows])
    df = Counter(int(x) for own in found for x in own)
    for parts in (1, 7):
        got = {r.doc_id: r for r in near_documents.signed(docs, 400, parts, near_documents.SHINGLE).collect()}
        for (i, _), own, n in zip(rows, found, often, strict=True):
            counts = [df[int(x)] for x in own]
            assert near_documents.unpack_numbers(bytes(got[i].counts)).tolist() == counts
            assert got[i].weight == pytest.approx(sum(k * math.log1p(400 / c) for k, c in zip(n, counts, strict=True)))
    # two texts of the passage and a word of their own, whose rare shingle agrees in its low bits with one of the passage
    hot = {int(x) & 0xFFFF for x in near_documents.shingles([shared])[0][0]}
    own = []
    while len(own) < 2:
        text = f"{shared} o{rng.integers(0, 10**9)}"
        rare = [x for x in near_documents.shingles([text])[0][0] if int(x) not in df]
        own += [(1000 + len(own), text)] if int(rare[0]) & 0xFFFF in hot else []
    both = spark.createDataFrame(rows + own, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_documents.classes(both).filter("doc_id >= 1000").collect()} == {1000: 1000, 1001: 1001}


def test_near_documents_without_an_id_link_others(spark):
    rng = np.random.default_rng(6)
    some = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    one, others = some(300), [(10 + i, " ".join(some(50))) for i in range(30)]
    bridge = one[:285] + some(15)
    far = some(15) + bridge[15:]
    alone = some(120)
    rows = [(1, " ".join(one)), (None, " ".join(bridge)), (2, " ".join(far)), (None, " ".join(alone)), (None, " ".join([*alone[:119], "other"])), *others]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in near_documents.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), *[(i, i) for i, _ in others]], key=str)
    apart = {r.doc_id: r.class_id for r in near_documents.classes(docs.filter("doc_id is not null")).collect()}
    assert apart[1] == 1 and apart[2] == 2


def test_near_documents_compare_the_rest_of_a_bucket(spark):
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 3, (90, 30))
    component = [1000 + int(c) for c in rng.choice([0, 0, 0, 0, 1, 2, 3, 4], 90)]
    bucket_of = [int(b) for b in rng.integers(0, 4, 90)]
    texts = spark.createDataFrame([(i, [int(x) for x in samples[i]]) for i in range(90)], "gid long, samples array<long>")
    buckets = spark.createDataFrame([(b, i, component[i]) for i, b in enumerate(bucket_of)] + [(9, 5, 1), (9, 6, 1)], "bucket long, gid long, component long")
    close = lambda i, j: int((samples[i] == samples[j]).sum()) >= near_documents.LEAST_AGREEING
    want = {
        (i, j, component[i], component[j])
        for i in range(90)
        for j in range(i + 1, 90)
        if bucket_of[i] == bucket_of[j] and component[i] != component[j] and close(i, j)
    }
    assert want
    for block in (4, 512):
        got = near_documents._rest_pairs(buckets, texts, block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert near_documents._rest_pairs(buckets.limit(0), texts).count() == 0
