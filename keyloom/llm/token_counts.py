"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

A pre-token's best segmentation is a maximum over the last piece, given the best scores of its prefixes. Pre-tokens are
inserted in a trie, each node has the score and count of the best segmentation of its prefix, and a node is computed
once, however many pre-tokens share it. What a pre-token costs is the count at its last node.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, texts

SPACE = "▁"
_NODES = 300_000
_DEEP = 256  # characters of a pre-token that the trie holds; what follows needs only the last scores
_WORDS = 800_000
_RUN = 4096  # words between looks at the limits: 4096 * _DEEP nodes can come in between at most
_UNIT = 1 << 20
_COUNT = (1 << 32) - 1


def _value(score: int) -> int:
    """The value of one token of this score."""
    return (score << 32) - 1


def rank_scores(pieces: list[str]) -> dict[str, int]:
    """Whole-numbered log scores of a vocabulary in order of rank, by Zipf's law. Whole numbers make sums exact, so that
    ties are ties."""
    return {p: -round(_UNIT * math.log(i + 10)) for i, p in reversed([*enumerate(pieces)])}


def sentencepiece_scores(path: str) -> dict[str, int]:
    """The pieces of a model file without its control, unknown and byte pieces, scored by rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    return rank_scores([m.id_to_piece(i) for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))])


class Counter(dict):
    """A trie of pre-tokens, and the counts of whole pre-tokens as a dictionary that asks the trie for what it lacks.

    Nodes are numbered: one dictionary leads from a node and a character to the next node, one list has the value of the best
    segmentation of each node's prefix. A value is the score times 2**32 less the number of tokens, so one comparison prefers
    the higher score and then fewer tokens. A character that no piece has is its UTF-8 bytes. Pieces are kept by their last
    character first, so that those that end at a node are found by walking back from it until none goes on."""

    def __init__(self, scores: dict[str, int]):
        super().__init__()
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0) - 2 * _UNIT
        self.other = _value(self.byte)
        self.ends: dict = {}
        for piece, score in scores.items():
            at = self.ends
            for c in reversed(piece):
                at = at.setdefault(ord(c), {})
            at[-1] = _value(score)
        self.begin()

    def begin(self) -> None:
        """An empty trie."""
        self.after: dict[int, int] = {}
        self.values = [0]

    @property
    def nodes(self) -> int:
        return len(self.values)

    def _best(self, codes: Sequence[int], i: int, before: list[int]) -> int:
        """The value of the prefix that ends with character ``i``; ``before`` has those of the shorter ones, the nearest last."""
        c = codes[i]
        best, at, back, j = before[-1] + self.other * (1 if c < 128 else 2 if c < 2048 else 3 if c < 65536 else 4), self.ends.get(c), -1, i
        while at is not None:
            s = at.get(-1)
            if s is not None:
                s += before[back]
                if s > best:
                    best = s
            back -= 1
            j -= 1
            at = at.get(codes[j]) if j >= 0 else None
        return best

    def insert(self, word: str) -> int:
        """The number of tokens in the best segmentation: the highest score, of those the fewest tokens."""
        codes = [*map(ord, word)] if len(word) <= _DEEP else array("I", word.encode("utf-32-le"))
        after, values = self.after, self.values
        node, path = 0, [0]
        for i, c in enumerate(codes if len(codes) <= _DEEP else codes[:_DEEP]):
            edge = node << 21 | c
            node = after.get(edge)
            if node is None:
                node = after[edge] = len(values)
                values.append(self._best(codes, i, path))
            path.append(values[node])
        if len(codes) > _DEEP:  # a window of the last values goes on, so memory does not grow with a text without white space
            for i in range(_DEEP, len(codes)):
                path.append(self._best(codes, i, path))
                if len(path) > 4 * self.longest + 1024:
                    del path[: -self.longest - 1]
        return -path[-1] & _COUNT

    def __missing__(self, word: bytes) -> int:
        n = self.insert(SPACE + word.decode("utf-8", errors="replace"))
        if len(word) <= 4 * _DEEP:  # rare and large ones are not kept
            self[word] = n
        return n

    def count(self, words: list[bytes]) -> int:
        total = 0
        for at in range(0, len(words), _RUN):
            if self.nodes > _NODES:
                self.begin()
            if len(self) > _WORDS:
                self.clear()
            total += sum(map(self.__getitem__, words[at : at + _RUN]))
        return total


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) for every row, over whole texts.

    Pre-tokens are runs of bytes other than ASCII white space, each with the mark of a word's beginning before it. Null and
    empty texts have none. Repeated rows and null ids are counted like others, other columns are not read, and an empty
    table gives no rows. No shuffle; the trie and the counts of a worker are bounded and begin anew when full.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(sentencepiece_scores(path))
        counter = _counters[path]
        for batch in batches:
            words = n = None
            out = []
            for text in texts(batch.column(1)):
                words = text.split()
                n = counter.count(words)
                out.append((len(words), n))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], ["id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
