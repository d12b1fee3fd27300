"""Packing plans of lengths held once each."""

def test_best_fit_looks_at_all_lengths():
    from reelgrid.llm.packing import plan

    counts = {n: 1 for n in range(20, 101)}
    bins = sum(n for _, n in plan(counts, 2048))
    assert bins <= -(-sum(counts) // 2048) + 1


def test_parts_are_the_tokenizers():
    """Texts cut into parts have the numbers of whole texts, and words with punctuation behind them are not learnt apart."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from reelgrid.llm.packing import WordTokens

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words, rng = Tokenizer.from_file(path), WordTokens(path), random.Random(1)
    signs = "abcXYZ'''sStTrReEvmldD019.,!?-\t\n\x0b\x0c\r \x1c\x00\x7f<|endoftext|>_\"`H\u0331\u0301\xe9\xc9\u3000\x85\u4e2d\u212a\u0130\u2014   "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|ENDOFTEXT|> x", "<|startoftext|> hi", "x" * 600, "It's I'LL we've 'tis ''s ..'s 1234 a1b2", "H\u0331 h\u0331 \xc9t\xe9's \u4e2d\u6587\u2014,", ""]
    for text, got in zip(texts, words.texts([t.encode() for t in texts]), strict=True):
        assert got == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    words = WordTokens(path)
    list(words.texts([b"Word word, word. (word) word's WORD", "w\u00e9 Word; word!".encode()]))
    assert sum(b"word" in k.lower() for k in words.known) == 1
