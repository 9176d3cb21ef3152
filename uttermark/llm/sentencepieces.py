"""SentencePiece encoding and decoding by shared-prefix Viterbi over a trie of the distinct words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.llm.unigram import DEFAULT_MODEL, MARK, Vocabulary, chunks, load

BLOCK_CHARACTERS = 4_000_000


class Encoder:
    """Best segmentations of many marked words at once.

    The sorted words are the depth-first order of their trie: each shares a prefix with the word before it,
    and the forward scores of that prefix, kept on a stack, hold for both, since the best way to reach a
    character depends on the characters before it alone.  Last pieces are tried from the shortest on, as long
    as some piece ends so; of equal scores the earliest start wins, which is the tokenizer's rule.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pieces = vocabulary, vocabulary.pieces
        self.unknown = vocabulary.unknown_score
        self.endings = {piece[i:] for piece in self.pieces for i in range(len(piece))}

    def _unknown_ids(self, character: str) -> list[int]:
        if self.vocabulary.bytes_at is None:
            return [self.vocabulary.unknown]
        return [self.vocabulary.bytes_at + b for b in character.encode("utf-8", "surrogatepass")]

    def words(self, distinct: Iterable[str]) -> tuple[list[str], list[int], list[int]]:
        """The words in order, how many ids each has, and the ids of all of them one after another."""
        pieces, endings, unknown = self.pieces, self.endings, self.unknown
        scores, starts, last = [0.0], [0], [-1]  # by depth: best score, start of the last piece and its id, -1 for none
        ordered = sorted(distinct)
        sizes: list[int] = []
        found: list[int] = []
        before = ""
        for word in ordered:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del scores[shared + 1 :], starts[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                ending = word[start:end]
                best, chosen, own = (None, 0, -1) if ending in pieces else (scores[start] + unknown, start, -1)
                while ending in endings:
                    piece = pieces.get(ending)
                    if piece is not None:
                        reached = scores[start] + piece[1]
                        if best is None or reached >= best:
                            best, chosen, own = reached, start, piece[0]
                    if not start:
                        break
                    start -= 1
                    ending = word[start:end]
                scores.append(best)
                starts.append(chosen)
                last.append(own)
            ids: list[int] = []
            end = len(word)
            while end:
                start, own = starts[end], last[end]
                if own < 0:
                    ids += self._unknown_ids(word[start:end])[::-1]
                else:
                    ids.append(own)
                end = start
            sizes.append(len(ids))
            found += ids[::-1]
            before = word
        return ordered, sizes, found

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [chunks(t) for t in texts]
        ordered, lengths, found = self.words(set(chain.from_iterable(split)))
        if not ordered:
            return [np.zeros(0, np.int32) for _ in texts]
        place = {c: i for i, c in enumerate(ordered)}
        sizes, flat = np.array(lengths, np.int64), np.array(found, np.int32)
        starts = np.cumsum(sizes) - sizes
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        ends = np.cumsum(sizes[at])
        ids = flat[np.repeat(starts[at] - (ends - sizes[at]), sizes[at]) + np.arange(ends[-1])]
        return np.split(ids, np.append(0, ends)[np.cumsum(counts)[:-1]])


def text_of_ids(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The text of ids: pieces and bytes joined, marks as blanks, without the blank put in front."""
    texts = vocabulary.texts
    raw = b"".join([texts[i] for i in ids]).replace(MARK.encode(), b" ")
    return raw.decode("utf-8", "replace").removeprefix(" ")


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= BLOCK_CHARACTERS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, ids, n_ids), one row per row of ``docs``, without a shuffle; null and empty texts have no ids.

    Each task sorts the distinct words of a block of texts of bounded size.  Scores are summed exactly, so
    that a word has the same ids in every text.  No special ids are added.  Ids of documents may be null or
    repeated; other columns are not read.
    """
    vocabulary = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _blocks(texts):
                got = encoder.texts([t or "" for t in texts[start:stop]])
                offsets = np.cumsum([0] + [len(x) for x in got]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), ids], ["doc_id", "ids"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    coded = slim.mapInArrow(run, f"doc_id {kind}, ids array<int>")
    return coded.select(F.col("doc_id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_ids"))


def decode(coded: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """Add the text of each list of ids; a null list gives a null text.  A column named ``out``, in any case, is replaced.

    Blanks and the mark that stands for them come back as blanks; all else comes back as it was.
    """
    vocabulary = load(model)
    kept = [name for name in coded.columns if name.lower() != out.lower()]
    place = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            texts = [text_of_ids(vocabulary, x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, out])

    schema = coded.select(*kept).schema.add(out, "string")
    return coded.select(*kept).mapInArrow(run, schema)
