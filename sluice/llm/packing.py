"""Operator 9: order-preserving packing of documents into token sequences.

Each partition's documents, in their order, are one stream of tokens. The stream may be
cut at ends of documents or sentences (and inside a sentence only where it is longer than
MOST_ITEM). Window cuts come from dynamic programming over these places:
    f[j] = min over i, S[j] - S[i] <= size, of f[i] + (size - (S[j] - S[i])) + penalty[j]
(the last window of a stream is not padded). The minimum of f[i] + S[i] over the sliding range is the head of a monotone queue, so
the time is linear. What is left at the end of a partition is cut into sequences whose
lengths are powers of two, which need no padding.

Partitions are independent: no shuffle, and a lost one is packed again alike, since a
scan gives its rows in the same order. `sequence_id` holds the partition in its
upper bits. Memory holds about BLOCK tokens and one document.

Defined cases: a null or empty text is the closing id alone; a null doc_id stays null;
repeated rows are packed each; texts of any length are cut into as many pieces as they need; of
equally good cuts the earliest is taken; `size` is 1 or more, and places are never farther apart than it; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces

SIZE = 4096
CLOSE = 2
CLOSING = CLOSE.to_bytes(4, "little")
#: Tokens packed at a time; the last, still open window goes on with the next block.
BLOCK = 1 << 20
#: Longest item between two places of the dynamic programme.
MOST_ITEM = 64
#: Penalties in padding tokens: a cut inside a document, and one inside a sentence.
IN_DOCUMENT, IN_SENTENCE = 2, 12
#: Rows of a batch that are encoded together, if not too long.
PART_ROWS = 4000
#: Different words that are looked up at a time.
WORDS = 1 << 16
#: Words that are not letters and signs, and runs of letters, whose ids a worker remembers (about 130 MB), and the longest of them.
REMEMBERED, LETTERS, LONGEST = 250_000, 400_000, 64
#: Signs that may follow a word's letters, and how many runs of them are remembered.
SIGNS, SIGN_RUNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 5000
#: The characters by which a byte-level file names bytes: those not printed are moved up. The space stays, to part words.
_MOVED = [b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
BYTE_SIGNS = np.arange(256, dtype="<u4")
BYTE_SIGNS[_MOVED] = 256 + np.arange(len(_MOVED))
BYTE_SIGNS[32] = 32

#: A row per piece; `ids` holds its tokens as little-endian 32-bit numbers.
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts by a word-level BPE file whose pre-tokens never hold white space.

    A text's ids are those of its space-separated words in a row, so many texts are split at
    once by Arrow and each of their different words is encoded once. A word of letters, perhaps with signs
    behind them, is put together from the ids of both, which are remembered; letters not yet
    known go straight to the file's model, other words through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab()
        #: tokens that close a sentence
        self.stops = np.zeros(max(vocab.values()) + 1, bool)
        self.stops[[i for t, i in vocab.items() if t.endswith("</w>") and t[:-4].strip(".!?") == "" != t[:-4]]] = True
        self.ids: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        # in a file that takes letters otherwise, all words go through the whole tokenizer
        every = [c for c in map(chr, range(0x250)) if c.lower().isalpha() and max(c.lower()) < "\u0250"]
        every.append("".join(every))
        self.by_model = self._encode(every) == self._by_model([c.lower() for c in every])

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids by the whole tokenizer."""
        out = []
        for k in range(0, len(words), 4096):
            found = self.tokenizer.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)
            out += [np.array(f.ids, "<u4").tobytes() for f in found]
        return out

    def _by_model(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case runs of letters, each a pre-token."""
        out = []
        for k in range(0, len(words), 1024):
            shown = BYTE_SIGNS[np.frombuffer(" ".join(words[k : k + 1024]).encode(), np.uint8)]
            found = list(map(self.model.tokenize, shown.tobytes().decode("utf-32-le").split(" ")))
            raw = np.array([t.id for f in found for t in f], "<u4").tobytes()
            stops = list(accumulate(4 * len(f) for f in found))
            out += [raw[at:stop] for at, stop in zip([0, *stops], stops)]
        return out

    def _runs(self, stems: list[str]) -> Iterable[tuple[str, bytes]]:
        """Ids of those that are runs of letters, which NFC leaves alone and of which lowering one does not depend on others."""
        runs, lower = [], []
        for stem in stems:
            low = stem.lower()
            if not low or self.by_model and low.isalpha() and len(stem) <= LONGEST and (low.isascii() or max(low) < "\u0250"):
                runs.append(stem)
                lower.append(low)
        return zip(runs, self._by_model(lower))

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of different words."""
        whole, stems = strings(words), strings(pc.ascii_rtrim(words, SIGNS))
        heads = remembered(self.letters, stems, LETTERS, self._runs)
        signs = [w[len(s) :] for w, s in zip(whole, stems)]
        tails = remembered(self.signs, signs, SIGN_RUNS, lambda new: zip(new, self._encode(new)))
        odd = [k for k, head in enumerate(heads) if head is None]
        for k, ids in zip(odd, remembered(self.ids, [whole[k] for k in odd], REMEMBERED, lambda new: zip(new, self._encode(new)))):
            heads[k], tails[k] = ids, b""
        return pc.binary_join_element_wise(pa.array(heads, pa.large_binary()), pa.array(tails, pa.large_binary()), pa.scalar(b"", pa.large_binary()))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins and the last ends, ends of sentences)."""
        # no special token, whose case counts
        plain = pc.and_not(pc.string_is_ascii(texts), pc.match_substring(texts, "<|"))
        texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = words.offsets.to_numpy()
        words = words.flatten().dictionary_encode()
        some = [self._words(words.dictionary.slice(k, WORDS)) for k in range(0, len(words.dictionary) or 1, WORDS)]
        found = pa.concat_arrays(some).take(words.indices)
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int64, len(found) + 1)[bounds - bounds[0]] // 4
        ids = np.frombuffer(data or b"", "<u4", int(at[-1]))
        return ids, at, np.flatnonzero(self.stops[ids]) + 1

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """(ids as little-endian 32-bit numbers, ends of sentences in ids)."""
        ids, _, ends = self.encode_all(pa.array([text]))
        return ids.tobytes(), ends


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def remembered(memory: dict[str, bytes], words: list[str], most: int, encode: Callable[[list[str]], Iterable]) -> list[bytes | None]:
    """Each word's ids; `encode` gives pairs for those that `memory` lacks, which holds about `most` and no long ones."""
    out = list(map(memory.get, words))
    new = {word for word, ids in zip(words, out) if ids is None}
    if new:
        if len(memory) + len(new) > most:
            memory.clear()
        memory.update(encode(list(new)))
        out = [memory.get(word) if ids is None else ids for word, ids in zip(words, out)]
        for word in new:
            if len(word) > LONGEST:
                memory.pop(word, None)
    return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def places(ends: np.ndarray, total: int | np.ndarray, most: int = MOST_ITEM) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of `total` tokens may be cut, and each cut's penalty; the last is its end.
    No two are more than `most` tokens apart. `total` may also be the ends of many documents in a row."""
    stops = np.atleast_1d(total)
    at = np.searchsorted(ends, stops)  # the closing id is behind the last sentence
    ends = np.insert(ends, at, stops)
    cost = np.full(len(ends), IN_DOCUMENT)
    cost[at + np.arange(len(stops))] = 0
    gaps = np.diff(ends, prepend=0)
    parts = (gaps - 1) // most + 1
    last = np.cumsum(parts)
    every = np.repeat(ends - gaps - (last - parts) * most, parts) + most * np.arange(1, last[-1] + 1)
    every[last - 1] = ends
    costs = np.full(len(every), IN_SENTENCE)
    costs[last - 1] = cost
    return every, costs


def windows(at: list[int], cost: list[int], size: int) -> list[int]:
    """The cuts of least padding plus penalties; `at` are the places after 0, the last
    is the end. The last window is open, or ends in powers of two: it has no padding."""
    g = [0] * (len(at) + 1)  # f + S of each place
    back = [0] * (len(at) + 1)
    where = [0, *at]
    queue = deque([0])
    for j in range(1, len(where)):
        low = where[j] - size
        while where[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        v = g[i] + size + cost[j - 1]
        g[j] = v
        back[j] = i
        while queue and g[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    j = len(at)
    k = j - 1
    while k > 0 and where[k - 1] >= where[j] - size:
        k -= 1
    back[j] = min(range(k, j), key=lambda i: g[i] - where[i])
    cuts = []
    while j:
        cuts.append(where[j])
        j = back[j]
    return cuts[::-1]


def powers(n: int, size: int) -> list[int]:
    """Lengths that add up to n: all powers of two, the largest first."""
    out = [size] * (n // size)
    return out + [1 << b for b in range(n.bit_length() - 1, -1, -1) if (n % size) >> b & 1]


class Stream:
    """The packing of one partition."""

    def __init__(self, first_sequence: int, size: int):
        if size < 1:
            raise ValueError(f"a sequence has 1 token or more, not {size}")
        self.size, self.sequence = size, first_sequence
        # (doc_id, ids, tokens already packed, all tokens, places, penalties)
        self.open: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, ids: bytes, ends: np.ndarray) -> Iterator[tuple]:
        yield from self.add_all([doc_id], np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]), ends)

    def add_all(self, doc_ids: list, ids: np.ndarray, at: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """Documents in a row, as `Encoder.encode_all` gives them."""
        number = np.arange(len(at))
        closed = at + number  # with the closing id behind each document
        ends = ends + np.searchsorted(at[1:], ends)
        where, cost = places(ends, closed[1:], min(MOST_ITEM, self.size))
        split = np.searchsorted(where, closed, "right").tolist()
        at, closed = at.tolist(), closed.tolist()
        for k, doc_id in enumerate(doc_ids):
            total = closed[k + 1] - closed[k]
            mine = slice(split[k], split[k + 1])
            self.open.append((doc_id, ids[at[k] : at[k + 1]].tobytes() + CLOSING, 0, total, where[mine] - closed[k], cost[mine]))
            self.tokens += total
            if self.tokens >= BLOCK:
                yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Pieces of the open documents; all but the last window's, if not `last`."""
        if not self.open:
            return
        at, cost, base = [], [], 0
        for _, _, done, total, where, penalty in self.open:
            left = where > done
            at.append(where[left] - done + base)
            cost.append(penalty[left])
            base += total - done
        cuts = windows(np.concatenate(at).tolist(), np.concatenate(cost).tolist(), self.size)
        if last:
            start = cuts[-2] if len(cuts) > 1 else 0
            tail = powers(cuts[-1] - start, self.size)
            cuts = cuts[:-1] + [start + int(s) for s in np.cumsum(tail)]
        else:
            cuts = cuts[:-1]
        k, begin = 0, 0  # the window, and its first token
        base = 0
        rest = []
        for doc_id, ids, done, total, where, penalty in self.open:
            while done < total and k < len(cuts):
                here = min(total - done, cuts[k] - base)
                yield doc_id, done, here, ids[4 * done : 4 * (done + here)], total, self.sequence, base - begin
                done += here
                base += here
                if base == cuts[k]:
                    begin = base
                    k += 1
                    self.sequence += 1
            if done < total:
                rest.append((doc_id, ids, done, total, where, penalty))
        self.open = rest
        self.tokens = sum(r[3] - r[2] for r in rest)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece; `tokenizer` is the path of the vocabulary file on every machine."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[list]:
        encode = encoder(tokenizer).encode_all
        stream = Stream(TaskContext.get().partitionId() << 40, size)
        for part in parts:
            out = list(stream.add_all(part.column(0).to_pylist(), *encode(part.column(1))))
            if out:
                yield zip(*out)
        out = list(stream.pack(True))
        if out:
            yield zip(*out)

    return map_pieces(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, PIECES, PART_ROWS)
