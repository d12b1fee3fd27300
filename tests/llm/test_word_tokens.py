"""A worker's tasks share what they have learnt of a tokenizer."""


def test_learnt_once(monkeypatch):
    import public_tokenizers

    from reelgrid.llm.packing import WordTokens, word_tokens

    path, learnt, encode = public_tokenizers.path("word_bpe_49k.json"), [], WordTokens._encode
    monkeypatch.setattr(WordTokens, "_encode", lambda self, parts: learnt.extend(parts) or encode(self, parts))
    first = list(word_tokens(path).texts([b"shared words, learnt once"]))
    assert b"shared" in learnt
    learnt.clear()
    assert list(word_tokens(path).texts([b"shared words, learnt once"])) == first and not learnt
