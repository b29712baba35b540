"""Unigram token counts by dynamic programming over a trie of pre-tokens.

Each word of a text, with the word mark in front, is a pre-token. A task inserts its
distinct pre-tokens in a trie; the forward score of a node - the best unigram score of a
segmentation of its prefix, and the number of pieces in it - is computed once, from the
scores of the nodes above, and so shared by every pre-token with that prefix. Terminal
counts are stored, and a text is the sum over its words.

Pieces come from a public vocabulary file whose path is a parameter. That file orders its
pieces by merge rank and holds no probabilities, so the unigram score of the piece of rank
r is Zipf's -log(r + 2), kept as a whole number of millionths so that ties are exact; of
equal scores the segmentation with fewer pieces counts. A character without a piece
falls back to one byte token for each of its bytes. Nothing is trained.

Defined results: null text counts as empty and has no tokens; repeated rows are each
returned; an empty table gives no rows; other columns are ignored. The trie is dropped and
begun anew beyond MOST_NODES nodes, and pre-tokens of more than LONGEST characters are
scored along one path without being kept, so memory is bounded; results don't depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MOST_NODES = 600_000
UNIT = 1_000_000
PIECE_BITS = 32
PIECE_MASK = (1 << PIECE_BITS) - 1
#: Added to the cost of a byte token, beyond the rarest piece.
BYTE_PENALTY = 10 * UNIT


class Pieces:
    """Whole-number costs of the pieces of a vocabulary file.

    A forward score is one number: the cost in the high bits and the number of pieces in
    the low ones, so that sums add both and the smaller of two is the better.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.cost = {model.id_to_piece(i): (round(math.log(rank + 2) * UNIT) << PIECE_BITS) + 1 for rank, i in enumerate(normal)}
        self.byte_cost = ((round(math.log(len(normal) + 2) * UNIT) + BYTE_PENALTY) << PIECE_BITS) + 1
        lengths: dict[str, set[int]] = {}
        for piece in self.cost:
            lengths.setdefault(piece[-2:], set()).add(len(piece))
        #: Lengths of the pieces that end in these two characters.
        self.lengths = {tail: sorted(n) for tail, n in lengths.items()}

    def forward(self, text: str, end: int, best: list[int]) -> int:
        """The score of text[:end], from those of all shorter prefixes."""
        cost = self.cost
        single = cost.get(text[end - 1])
        if single is None:
            single = len(text[end - 1].encode("utf-8")) * self.byte_cost
        found = best[end - 1] + single
        for n in self.lengths.get(text[end - 2 : end], ()) if end > 1 else ():
            if n > end:
                break
            c = cost.get(text[end - n : end])
            if c is not None and best[end - n] + c < found:
                found = best[end - n] + c
        return found


class Trie(dict):
    """Terminal scores by word; a missing word is inserted along its path."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.edges: dict[tuple[int, str], int] = {}
        self.forward = [0]

    def __missing__(self, word: bytes) -> int:
        text = MARK + word.decode("utf-8")
        if len(self.forward) > MOST_NODES:
            self._clear()
        edges, forward, node, path = self.edges, self.forward, 0, [0]
        for end, char in enumerate(text, 1):
            below = edges.get((node, char))
            if below is None:
                score = self.pieces.forward(text, end, path)
                if len(forward) > 2 * MOST_NODES:  # one word too long to be held: its end has no nodes
                    path.append(score)
                    continue
                below = edges[node, char] = len(forward)
                forward.append(score)
            node = below
            path.append(forward[node])
        if len(forward) <= 2 * MOST_NODES:
            self[word] = path[-1]
        return path[-1]


_tries: dict[str, Trie] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and the texts' unigram log score for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tries:
            _tries[path] = Trie(Pieces(path))
        trie = _tries[path]
        for batch in batches:
            words_n, tokens_n, scores = [], [], []
            for text in batch.column("body").to_pylist():
                words = (text or b"").split()
                total = sum([trie[w] for w in words])
                words_n.append(len(words))
                tokens_n.append(total & PIECE_MASK)
                scores.append(-(total >> PIECE_BITS) / UNIT)
            yield pa.record_batch([batch.column("doc_id"), pa.array(words_n, pa.int64()), pa.array(tokens_n, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "log_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, log_score double")
