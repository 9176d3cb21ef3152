"""A unigram vocabulary and how texts become marked chunks."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

MARK = "▁"  # fixed value: stands for a blank
PENALTY = 10.0  # fixed value: an unknown character scores this much less than the lowest piece
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = re.compile(f"{MARK}*[^{MARK}]*")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ids and scores, as a unigram model reads them; ``bytes_at`` is the id of byte 0, if bytes have ids."""

    pieces: dict[str, tuple[int, float]]
    texts: tuple[bytes, ...]
    bytes_at: int | None
    unknown: int

    @property
    def unknown_score(self) -> float:
        return min(score for _, score in self.pieces.values()) - PENALTY


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read a piece model's normal pieces, scores and byte ids.  Scores are taken as the file has them.

    The driver reads the file and tasks get the vocabulary with their code; its size is that of the file.
    Pieces must bear the mark for a blank at their start only, so that chunks can be scored one by one.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=os.fspath(path))
    size = model.get_piece_size()
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
    names = [model.id_to_piece(i) for i in range(size)]
    pieces = {names[i]: (i, model.get_score(i)) for i in range(size) if not special[i]}
    crossing = [p for p in pieces if not re.fullmatch(f"{MARK}*[^{MARK}]*", p)]
    if crossing:
        raise ValueError(f"pieces with a blank after other characters: {crossing[:3]}")
    in_bytes = [i for i in range(size) if model.is_byte(i)]
    texts = [b"" if special[i] else names[i].encode() for i in range(size)]
    for byte, i in enumerate(in_bytes):
        texts[i] = bytes([byte])
    if in_bytes and in_bytes != list(range(in_bytes[0], in_bytes[0] + 256)):
        raise ValueError("the 256 byte pieces must have consecutive ids")
    return Vocabulary(pieces, tuple(texts), in_bytes[0] if in_bytes else None, model.unk_id())


def chunks(text: str) -> list[str]:
    """The marked chunks of a text: runs of marks with what follows.  No piece crosses from one into the next.

    A blank is put before the text, as the tokenizer does; the empty text has no chunk.
    """
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " ":
        return CHUNK.findall(MARK + text.replace(" ", MARK))[:-1]
    return [MARK + word for word in text.split(" ")]
