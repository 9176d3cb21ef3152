"""Token counts without tokens: count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.llm.unigram import DEFAULT_MODEL, Vocabulary, chunks, load

MOST_REMEMBERED = 300_000


class CountOnly:
    """Number of tokens of the best segmentation of a chunk; neither pieces nor back links are kept.

    The automaton names all pieces that end at a character, longest first.  Only a better score replaces the
    best one so far, so that of equal ones the earliest start, the longest last piece, wins: the tokenizer's
    rule.  A character that is no piece of its own may be unknown, and then counts as its UTF-8 bytes where
    the vocabulary has bytes, else as one token.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces, self.unknown = vocabulary.pieces, vocabulary.unknown_score
        self.in_bytes = vocabulary.bytes_at is not None
        self.known: dict[str, int] = {}

    def count(self, chunk: str) -> int:
        scores, counts = [0.0], [0]
        matches = self.automaton.iter(chunk)
        match = next(matches, None)
        for end, character in enumerate(chunk):
            best, tokens = None, 0
            while match is not None and match[0] == end:
                length, score = match[1]
                start = end + 1 - length
                reached = scores[start] + score
                if best is None or reached > best:
                    best, tokens = reached, counts[start] + 1
                match = next(matches, None)
            if character not in self.pieces:
                reached = scores[end] + self.unknown
                if best is None or reached > best:
                    best = reached
                    tokens = counts[end] + (len(character.encode("utf-8", "surrogatepass")) if self.in_bytes else 1)
            scores.append(best)
            counts.append(tokens)
        return counts[-1]

    def text(self, text: str) -> int:
        """Tokens of a whole text.  Counts of chunks seen lately are remembered, in bounded memory."""
        total, known = 0, self.known
        for chunk, times in Counter(chunks(text)).items():
            tokens = known.get(chunk)
            if tokens is None:
                if len(known) >= MOST_REMEMBERED:
                    known.clear()
                tokens = self.count(chunk)
                if len(chunk) <= 64:
                    known[chunk] = tokens
            total += tokens * times
        return total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_chars, chars_per_token), one row per row of ``docs``, without a shuffle.

    Tokens are those of the unigram tokenizer with the vocabulary and scores of ``model``, no special ones
    counted.  Sums of scores are exact, so that chunks count alone as within their text.  Null and empty
    texts have no token and a null ratio.  Ids may be null or repeated; other columns are not read.
    """
    vocabulary = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = CountOnly(vocabulary)
        for batch in batches:
            counts = [counter.text(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    length = F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), length.alias("n_chars"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    counted = slim.mapInArrow(run, f"doc_id {kind}, n_chars long, n_tokens long")
    ratio = F.when(F.col("n_tokens") > 0, F.col("n_chars") / F.col("n_tokens"))
    return counted.select(F.col("doc_id").alias(id_col), "n_tokens", "n_chars", ratio.alias("chars_per_token"))
