import random

import pytest

from cardloom.llm.token_counts import count_tokens

SCHEMA = "doc_id long, text string, n_tokens string, n_bytes int"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def made():
    rng = random.Random(3)
    bits = ["the", " the", "'s", "'LL", "\u3000", "\xa0", " ", "   ", "\n", "\r\n", "\t", "é", "e\u0301", "\U0001f600", "日本", "<|endoftext|>", "123", "4567", "a" * 30, "-", "...", "\u0085", "Ωβ", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.choice([0, 1, 3, 20, 200]))) for _ in range(150)]
    return [*texts, None, "", " ", "<|endoftext|>", "x" * 70_000, "word " * 60_000, " " * 5_000, texts[3], texts[3]]


def test_counts_equal_the_library(spark, path):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(path), made()
    rows = [(i if i % 10 else None, t, "own", 0) for i, t in enumerate(texts)]
    got = sorted(((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(spark.createDataFrame(rows, SCHEMA), path).collect()))
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got == sorted((str(d), len((t or "").encode()), k, k > 1024) for (d, t, *_), k in zip(rows, n, strict=True))


def test_empty_table(spark, path):
    assert count_tokens(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_long_words_are_cut_and_counted_exactly(path):
    """Words of a million letters and of periods that no chunk's length fits take seconds, not minutes."""
    import time

    from tokenizers import Tokenizer

    from cardloom.llm.token_counts import counter

    library, model, rng = Tokenizer.from_file(path), counter(path), random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 300_001, "abcdefg" * 20_000, "xyzzy" * 3_000 + "".join(rng.choices("ab", k=50_000)), "é" * 9_000, "-=" * 40_000, "9" * 5_000]
    start = time.process_time()
    got = model.count_texts([f"so {w} on" for w in words]).tolist()
    assert time.process_time() - start < 60
    assert got == [len(library.encode(f"so {w} on", add_special_tokens=False).ids) for w in words]
