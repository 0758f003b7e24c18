"""Token counts against the library that the vocabulary is for."""

import random

import pytest

from foliant.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

PIECES = ["'s", "'re", "'l", "'", "''", "I'll", " ", "  ", "\n", "\t ", " ", " ", "\x1c", "\x85", "é", "ß", "漢字", "🙂", "١٢", "½", "x" * 40, "word", "Word", "123", "--", "...", "<|endoftext|>", "<|endof", "text|>", "é", "​", "\x00", "ll", "ve", "t"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_against_the_library(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(1, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(1500)]
    texts += [None, "", " ", "\n\n", "<|endoftext|>", "same", "same", "a" * 30_000, "word " * 300_000]
    rows = [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    tokenizer = library()
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows]
    got = [tuple(r) for r in token_counts.counted(docs, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.counted(docs.limit(0), PATH).count() == 0


def test_long_texts_are_cut_between_stretches(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choices([*PIECES, " a ", " b"], k=rng.randrange(0, 200))) for _ in range(300)]
    own = token_counts.Vocabulary(open(PATH).read())
    tokenizer = library()
    n_bytes, n_tokens = own.counts(pa.array(texts, pa.large_string()))
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]
    assert n_tokens.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_only_proven_strings_are_taken_whole():
    own = token_counts.Vocabulary(open(PATH).read())
    tokenizer = library()
    for stretch in own.whole.to_pylist():
        text = stretch.decode("utf-8", "replace")
        if text.encode() == stretch and len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert len(tokenizer.encode(text, add_special_tokens=False).ids) == 1
    with pytest.raises(ValueError):
        token_counts.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json")).read())
