"""Short chunks are merged directly and equal both the automaton's tiling and the library."""

import struct

import sentencepiece

from doorstep.llm import pieces as P

TEXTS = ["", " ", "the quick brown fox", "aaaaaaaaaaaaaaaaaaaaaaa", "Ünïcödé façade 日本語 x", "a\nb\t c  d",
         "tokenization of internationalization", "word" * 40, "zzzz🙂zz 1234567890 12.50"]


def test_short_chunks_equal_the_tiling_and_the_library():
    code, model = P.Encoder(P.model_path()), sentencepiece.SentencePieceProcessor(model_file=P.model_path())
    for text in TEXTS:
        ids = code.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == model.encode(text, add_bos=True, add_eos=True)
    word = P.BLANK + "internationalization"
    assert code.pieces.merged(word) == code.pieces.tiled(_longest(code.pieces, word), 0, len(word))


def _longest(pieces, text):
    out = [-1] * len(text)
    for last, i in pieces.find.iter(text):
        out[last - pieces.length[i] + 1] = i
    return out


def test_ordinary_words_need_no_pairs_of_pieces():
    code = P.Encoder(P.model_path())
    code.encode("an ordinary sentence of international words")
    assert not code.pieces.fits
