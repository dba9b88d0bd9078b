"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Failure links follow the published linear-time WordPiece matching: when no edge fits, the
automaton pops the longest pieces that the current node's string begins with and goes on at the node of what is left
of it, as a continuation. Here only the *number* of popped pieces is needed, so each node holds that number, summed up
beforehand: a text's count is a sum of integers and no piece is built. A word that greedy matching can't cover is one
unknown token, as usual.

A word is a run of characters that are no white space (``str.split``). Words repeat, so counts of short words are kept
per worker up to ``CACHE`` entries; long words always run through the automaton, which takes a step per character.

Defined results: null and empty texts count 0; repeated rows and null ids are counted row by row; an empty table gives
an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, field, texts

#: Word counts kept per worker, and the longest word kept.
CACHE, CACHED_LENGTH = 1 << 18, 64
_COUNTERS: dict[str, "Counter"] = {}


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one, from a public sentencepiece vocabulary (its word mark
    opens a word; control and byte pieces are left out)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inner = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            if piece.strip("▁"):
                first.append(piece[1:])
        else:
            inner.append(piece)
    return first, inner


class Counter(dict):
    """word -> number of tokens. ``self[word]`` looks into the cache and else runs the automaton."""

    def __init__(self, first: list[str], inner: list[str]):
        super().__init__()
        # Two roots: 0 where a word begins, 1 where it goes on. Nodes' strings are relative to their root.
        self.edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for ch in piece:
                    node = self.edges[node].get(ch) or self._grow(node, ch, final)
                final[node] = True
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = [0, 1]
        for u in queue:  # by depth
            for ch, v in self.edges[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, k = self.fail[u], self.popped[u]
                    while z >= 0 and ch not in self.edges[z]:
                        k += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edges[z][ch], k
                queue.append(v)

    def _grow(self, node: int, ch: str, final: list[bool]) -> int:
        self.edges[node][ch] = new = len(self.edges)
        self.edges.append({})
        final.append(False)
        return new

    def count(self, word: str) -> int:
        """Tokens of one word: linear in its length."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, total = 0, 0
        for ch in word:
            while True:
                to = edges[node].get(ch)
                if to is not None:
                    node = to
                    break
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
        while node != 1:  # what is left at the end is popped too, down to the bare continuation root
            if node <= 0:
                return 1 if node < 0 else 0
            total += popped[node]
            node = fail[node]
        return total

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def text(self, text: str) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = text.split()
        return len(words), sum(map(self.__getitem__, words))


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(*vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens)`` of every whole text."""
    path = path or model_file()

    def fn(batch: pa.RecordBatch) -> list:
        c = counter(path)
        found = [c.text(t) for t in texts(batch.column(1))]
        return [batch.column(0), [a for a, _ in found], [b for _, b in found]]

    return arrow_map(docs.select(id_col, text_col), fn, T.StructType([field(docs, id_col), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
