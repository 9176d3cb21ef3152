"""Token counts, encoding and decoding against public tokenizers and brute force."""

import random

import pytest

from uttermark.llm import sentencepieces, token_counts
from uttermark.llm.unigram import DEFAULT_MODEL, MARK, Vocabulary, chunks, load

ALPHABET = ["a", "b", "th", "the", " ", "  ", "\n", "é", "日", MARK, "€", "🎉", "q", "Z", "ing"]


def texts(n=400, most=25, seed=1):
    rng = random.Random(seed)
    return ["", " ", MARK] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return load(DEFAULT_MODEL)


def brute(text, vocabulary):
    """Best segmentation of the whole text by trying every last piece, longest first."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    best = [(0.0, [])]
    for end in range(1, len(marked) + 1):
        found = None
        for start in range(end):
            piece = vocabulary.pieces.get(marked[start:end])
            if piece is not None:
                step = (best[start][0] + piece[1], best[start][1] + [piece[0]])
            elif start == end - 1:
                raw = marked[start:end].encode()
                step = (best[start][0] + vocabulary.unknown_score, best[start][1] + [vocabulary.bytes_at + b for b in raw])
            else:
                continue
            if found is None or step[0] > found[0]:
                found = step
        best.append(found)
    return best[-1][1]


def test_against_brute_force(vocabulary):
    counter, encoder = token_counts.CountOnly(vocabulary), sentencepieces.Encoder(vocabulary)
    cases = texts()
    for text, ids in zip(cases, encoder.texts(cases)):
        want = brute(text, vocabulary)
        assert ids.tolist() == want and counter.text(text) == len(want), text


def test_against_unigram_tokenizer(vocabulary):
    """The same vocabulary and scores in a public unigram tokenizer with exact sums."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, models

    model = SentencePieceProcessor(model_file=DEFAULT_MODEL)
    pairs = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    other = Tokenizer(models.Unigram(pairs, unk_id=0, byte_fallback=True))
    counter, encoder = token_counts.CountOnly(vocabulary), sentencepieces.Encoder(vocabulary)
    cases = [t for t in texts(seed=2) if t]
    for text, ids in zip(cases, encoder.texts(cases)):
        want = other.encode(MARK + text.replace(" ", MARK)).ids
        assert ids.tolist() == want and counter.text(text) == len(want), text


def test_against_sentencepiece(tmp_path):
    """The library itself on short texts, with scores whose sums its 32-bit numbers hold exactly."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(DEFAULT_MODEL, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, own = SentencePieceProcessor(model_file=str(path)), load(str(path))
    counter, encoder = token_counts.CountOnly(own), sentencepieces.Encoder(own)
    cases = texts(seed=3)
    for text, ids in zip(cases, encoder.texts(cases)):
        want = library.encode(text)
        assert ids.tolist() == want and counter.text(text) == len(want), text
        assert sentencepieces.text_of_ids(encoder.vocabulary, ids.tolist()) == text.replace(MARK, " ")


def test_ties_and_vocabularies_without_bytes():
    own = Vocabulary({MARK: (0, -1.0), "a": (1, -1.0), "aa": (2, -2.0), MARK + "a": (3, -2.0)}, (MARK.encode(), b"a", b"aa", b""), None, 9)
    # Equal scores: the earliest start of the last piece wins.
    assert sentencepieces.Encoder(own).texts(["aa", "x"])[0].tolist() == brute("aa", own)
    assert sentencepieces.Encoder(own).texts(["x"])[0].tolist() == [0, 9]
    assert token_counts.CountOnly(own).text("x") == 2


def test_pieces_may_not_cross_blanks(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(DEFAULT_MODEL, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    proto.pieces[500].piece = f"a{MARK}b"
    path = tmp_path / "crossing.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        load(str(path))


def test_chunks():
    assert chunks("") == [] and chunks("a b") == [MARK + "a", MARK + "b"]
    assert chunks("  a ") == [MARK * 3 + "a", MARK]


ROWS = [(1, "the cat"), (1, "the cat"), (None, None), (3, ""), (4, "x" * 50_000), (5, "日本 " * 3000)]


def test_tables(rows, vocabulary):
    docs = rows([(i, t, "n") for i, t in ROWS], "doc_id long, text string, N_TOKENS string")
    counted = token_counts.token_counts(docs).collect()
    counter = token_counts.CountOnly(vocabulary)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted) == sorted((i or 0, counter.text(t or "")) for i, t in ROWS)
    assert all((r.chars_per_token is None) == (r.n_tokens == 0) for r in counted)
    coded = sentencepieces.encode(docs)
    decoded = sentencepieces.decode(coded).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in decoded) == sorted((i or 0, t or "") for i, t in ROWS)
    assert all(r.n_ids == len(r.ids) == counter.text(r.decoded) for r in decoded)


def test_empty_tables(rows):
    docs = rows([], "doc_id long, text string")
    assert token_counts.token_counts(docs).count() == 0
    assert sentencepieces.decode(sentencepieces.encode(docs)).count() == 0


def test_null_ids_decode_to_null(rows):
    got = sentencepieces.decode(rows([(1, None)], "doc_id long, ids array<int>")).first()
    assert got.decoded is None
