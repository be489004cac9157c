import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm.packing import ChunkEncoder, best_fit, pack_documents
from quire.llm.tokenizer_files import tokenizer_path

TRICKY = ["it's we'LL 12 a1b2 don't!'s ΑΣ İstanbul ñ  \t x y ſtrange ĲK ŉ café café ́x ½ ² ª º µ \x85z <|endoftext|> <|a", "", "'s 's'",
          "日本語 text 한국어", "soft­hy", "ẞ ß ǅ ﬁ", "a\x1cb\x1fc", "Ÿ ÿ Ā ŸA", "a​b ‍", "K Å K", "x" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x180), 0x3A3, 0x301, 0x4E00, 0x2028, 9, 10, 13]]
    texts = TRICKY + ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(1500)] + [" ".join(TRICKY) * 3]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for encoder in (ChunkEncoder(tokenizer_path()), ChunkEncoder(tokenizer_path(), max_chunks=50, slice_chars=20)):
        for a in range(0, len(texts), 100):  # the table of known chunks is emptied on the way
            assert [x.tolist() for x in encoder.encode(texts[a:a + 100])] == want[a:a + 100]


class CountedModel:
    def __init__(self, model, fails=()):
        self.model, self.seen, self.fails = model, [], fails

    def tokenize(self, word):
        self.seen.append(word)
        if word in self.fails:
            raise ValueError(word)
        return self.model.tokenize(word)


def test_a_known_word_is_not_encoded_again(tokenizer):
    texts = ["alpha beta gamma-beta, Alpha"] * 5
    encoder = ChunkEncoder(tokenizer_path())
    encoder.model = model = CountedModel(encoder.model)
    first = encoder.encode(texts)
    assert sorted(model.seen) == sorted({"alpha", "beta", "gamma", "-", ","})
    encoder.shrink(100)  # drops nothing that was met more than once
    again = ["alpha, BETA. beta-alpha"]
    assert encoder.encode(again)[0].tolist() == tokenizer.encode(again[0], add_special_tokens=False).ids
    assert "alpha" not in model.seen[5:] and "beta" not in model.seen[5:]
    assert first[0].tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_chunks_are_whole_after_a_failure(tokenizer):
    texts = ["one two-three", "four, five \u4e00 one"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = ChunkEncoder(tokenizer_path())
    whole = encoder.model
    encoder.model = CountedModel(whole, fails=("three",))
    with pytest.raises(ValueError):
        encoder.encode(texts)
    encoder.model = whole
    assert [x.tolist() for x in encoder.encode(texts)] == want


def check(rows, pieces, tokenizer, capacity):
    want = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            want.append((doc, k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes())))
    assert sorted(map(str, want)) == sorted(str((p.doc_id, p.piece, p.start, p.length, p.ids_crc32)) for p in pieces)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(p.length for p in pieces) / capacity


def test_round_trip_and_few_sequences(docs_of, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "Gamma", "delta."], k=int(rng.expovariate(1 / 60))))) for i in range(400)]
    for rows_per_task in (200_000, 40):
        out = pack_documents(docs_of(rows), tokenizer_path(), capacity=256, rows_per_task=rows_per_task).collect()
        n, least = check(rows, out, tokenizer, 256)
        assert n <= 1.1 * least + 1


def test_hard_rows(docs_of, hard, tokenizer):
    out = pack_documents(docs_of(hard), tokenizer_path(), with_ids=True).collect()
    check(hard, out, tokenizer, 2048)
    assert all(len(r.ids) == r.length for r in out)
    assert pack_documents(docs_of([]), tokenizer_path()).collect() == []


def test_large_pieces_that_fit_nowhere_end(docs_of, tokenizer):
    rows = [(i, "word " * 39) for i in range(200)]  # 40 of 64 tokens each: no two fit together
    out = pack_documents(docs_of(rows), tokenizer_path(), capacity=64, rows_per_task=20).collect()
    assert check(rows, out, tokenizer, 64)[0] == 200


def test_best_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 3000)
    bins, offsets, fills = best_fit(sizes, 100)
    assert (np.bincount(bins, sizes) == fills).all() and fills.max() <= 100
    assert len(fills) <= 1.02 * sizes.sum() / 100 + 1
    assert best_fit(np.array([60, 40, 50, 50]), 100)[2].tolist() == [100, 100]
