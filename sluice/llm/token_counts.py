"""Operator 7: token counts by dynamic programming shared over a trie of pre-tokens.

A text is cut into words; a pre-token is the mark `▁` and a word. Its segmentation is
the one of highest total log probability under a unigram model of the vocabulary, ties to fewer
tokens. Forward scores depend on a prefix alone, so the distinct new pre-tokens of all texts of
a batch are entered into one trie, by sorting them: its nodes are walked depth first with the
forward scores of the path from the root on a stack, and each node is computed once. At a
terminal the token count is stored under its word, and documents add up stored counts.
Stored counts are kept for later batches in two generations, of which the older is dropped
once the younger is full; a word in use is moved to the younger.

The model: public vocabulary files state an order of their pieces and no
probabilities, so a piece of rank r (from 1) has probability 1 / r, scaled to sum to 1
(Zipf). A character that no piece holds counts as its UTF-8 bytes, each at BYTE_RANKS
times the vocabulary's size.

Defined cases: null, empty and blank texts have no words and no tokens; a null doc_id
stays null; words of any length are segmented whole (long ones are not remembered);
repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

MARK = "▁"
BYTE_RANKS = 8
#: Words of a generation, and bytes of the longest that is remembered.
REMEMBERED, LONGEST = 200_000, 64


class Unigram:
    """Log probabilities of pieces, and the forward dynamic programme over a trie."""

    def __init__(self, pieces: list[str]):
        total = sum(1 / r for r in range(1, len(pieces) + 1))
        self.score: dict[str, float] = {}
        for r, piece in enumerate(pieces, 1):
            self.score.setdefault(piece, -math.log(r * total))
        self.byte = -math.log(BYTE_RANKS * len(pieces) * total)
        #: each ending of a piece -> its score, or 0 if it is not a piece itself (scores are negative)
        self.endings: dict[str, float] = {}
        for piece in self.score:
            for k in range(len(piece)):
                self.endings.setdefault(piece[k:], 0.0)
        self.endings |= self.score
        #: token counts of words (UTF-8): the younger and the older generation
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        #: nodes of tries that were computed
        self.nodes = 0

    def learn(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """Token counts of distinct words, by a walk over their trie."""
        best, count, before = [0.0], [0], ""
        endings, score, found = self.endings, self.score, {}
        for token, word in sorted((MARK + w.decode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(before), len(token))
            while shared < most and before[shared] == token[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            self.nodes += len(token) - shared
            for i in range(shared + 1, len(token) + 1):
                top, least, j = -math.inf, 0, i - 1
                while j >= 0 and (s := endings.get(token[j:i])) is not None:
                    if s:
                        v = best[j] + s
                        if v > top or v == top and count[j] + 1 < least:
                            top, least = v, count[j] + 1
                    j -= 1
                if token[i - 1] not in score:
                    n = len(token[i - 1].encode("utf-8", "surrogatepass"))
                    v = best[i - 1] + n * self.byte
                    if v > top or v == top and count[i - 1] + n < least:
                        top, least = v, count[i - 1] + n
                best.append(top)
                count.append(least)
            found[word] = count[-1]
            before = token
        return found

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(words, tokens) of each text of a batch."""
        # bytes are split at the six ASCII blanks
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        used = set().union(*split)
        known = {w: self.young[w] for w in used & self.young.keys()}
        known |= {w: self.old[w] for w in (used & self.old.keys()) - known.keys()}
        known |= self.learn(used - known.keys())
        out = [(len(words), sum(map(known.__getitem__, words))) for words in split]
        self.young |= {w: n for w, n in known.items() if len(w) <= LONGEST}
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return out


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece file in its order."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@lru_cache(1)
def unigram(path: str) -> Unigram:
    return Unigram(read_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row; `vocabulary` is the file's path on every machine."""
    def run(parts: Iterator[list[list]]) -> Iterator[list]:
        model = unigram(vocabulary)
        for ids, texts in parts:
            yield [ids, *zip(*model.counts(texts))]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(rows, run, "doc_id long, n_words long, n_tokens long")
