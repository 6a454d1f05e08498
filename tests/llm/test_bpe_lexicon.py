import hashlib
import random

import numpy as np
import pytest

from cardloom.llm.bpe_lexicon import Lexicon, compile_lexicon, decode_ids, digests, encode_texts, frequent_words, tokenizer

SCHEMA = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def made(n=400):
    rng = random.Random(12)
    bits = [
        "the", " the", "The ", "running ", "'s", "'LL ", "''s", "!'s", "　", "\xa0", " ", "\n", "é", "é", "ΣΑΣ ", "ΟΔΟΣ", "İI", "ẞß", "\U0001f600", "日本 ", "<|endoftext|>", "<|startoftext|>", "<|endof", "123",
        "½²", "Ⅷ", "a" * 30, "-", "...", "\u0085", "\x1c", "xͅ", "\x00", "ǅ", "‍", "Ᲊ", "Ƛ", "\U00010d50", "\U0001e5d0", "̈", "가", "가", "क्षि", "İ", "ſ", "ﬁ", " ", "don't", "I'VE", "w0rd", "_", "¿",
    ]
    return ["".join(rng.choices(bits, k=rng.choice([0, 1, 3, 20, 200]))) for _ in range(n)]


def test_encoding_and_decoding_equal_the_library(spark, path, library):
    texts = [*made(), None, "", " ", "<|endoftext|>", "x" * 30_000, "ab" * 5_000, "word " * 60_000]
    texts += texts[3:6]
    rows = [(i if i % 10 else None, t, "own", 0) for i, t in enumerate(texts)]
    encoded = decode_ids(encode_texts(spark.createDataFrame(rows, SCHEMA), path, share=1e-3), path)
    got = sorted(((str(r.doc_id), r.ids, r.decoded) for r in encoded.collect()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == sorted((str(d), ids, library.decode(ids, skip_special_tokens=False)) for (d, *_), ids in zip(rows, want, strict=True))
    at_once = encode_texts(spark.createDataFrame(rows, SCHEMA), path, share=1e-3, decoded=True)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in at_once.collect()) == got
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = sorted(map(tuple, digests(encoded).collect()), key=str)
    assert rows == sorted(((None if d == "None" else int(d), len(ids), sha(" ".join(map(str, ids))), sha(text)) for d, ids, text in got), key=str)


def test_every_code_point_that_is_known_splits_as_in_the_library(path, library):
    model = tokenizer(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}{chr(c)}!" for c in points[at : at + 4096])
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        assert ["".join(model.letters[b] for b in w.encode()) for w in model.words([text])[0]] == [w for w, _ in found]


def test_merges_equal_the_library(path, library):
    model, rng = tokenizer(path), random.Random(4)
    for _ in range(3000):
        word = "".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 40)))
        want = library.encode(word, add_special_tokens=False).ids
        raw = word.encode()
        assert model.merge(word) == want == model._merge_long([model.inner[b] for b in raw[:-1]] + [model.last[raw[-1]]])


def held_ids(lexicon, words):
    known, sizes, ids = lexicon.look_up(words)
    ends = np.cumsum(sizes)
    return [ids[e - n : e].tolist() if k else None for k, n, e in zip(known, sizes, ends, strict=True)]


def test_lexicon_gives_exactly_its_words():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 9))).encode() for _ in range(2000)})
    held = {w: tuple(rng.choices(range(3), k=rng.randrange(1, 5))) for w in words if rng.random() < 0.5}
    lexicon = Lexicon(np.frombuffer(compile_lexicon(sorted(held.items())), dtype=np.int64))
    assert held_ids(lexicon, words) == [list(held[w]) if w in held else None for w in words]
    assert held_ids(Lexicon(np.frombuffer(compile_lexicon([]), dtype=np.int64)), [b"a", b""]) == [None, None]
    with pytest.raises(ValueError):
        compile_lexicon([(b"b", (1,)), (b"a", (2,))])


def test_lexicon_is_minimal():
    """Suffixes are shared: 26 stems with the same endings need one copy of the endings."""
    endings = ("", "s", "ed", "ing")
    entries = sorted((bytes([c]) + e.encode(), (c, 7, len(e))) for c in range(97, 123) for e in endings)
    lexicon = Lexicon(np.frombuffer(compile_lexicon(entries), dtype=np.int64))
    assert len(lexicon.final) == 6  # the start, one for all stems, "e", "i", "in", and the end
    assert held_ids(lexicon, [w for w, _ in entries]) == [list(ids) for _, ids in entries]


def test_frequent_words_follow_the_share(spark, path):
    docs = spark.createDataFrame([(i, "common words here " * 20 + f"rare{'x' * (i % 7)}") for i in range(40)] + [(99, None)], "doc_id long, text string")
    assert {r.word for r in frequent_words(docs, path, share=0.1).collect()} == {"common", "words", "here"}
    assert {r.word for r in frequent_words(docs, path, share=1e-3).collect()} > {"rare", "rarex"}


def test_empty_table(spark, path):
    assert digests(decode_ids(encode_texts(spark.createDataFrame([], SCHEMA), path), path)).count() == 0
