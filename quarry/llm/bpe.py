"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library does the merging. Long texts are cut before a single blank that stands between two characters
that are no white space: no match of the split pattern holds such a blank anywhere but at its start, and what follows
does not depend on what came before, so that the pieces' ids joined are the ids of the whole. Long runs of white space
never reach the pattern, whose look-ahead would need a stack as deep as the run: a run is one match, less its last
character if something follows, and is merged as one piece. Decoding joins the raw bytes of the ids, which is exact
for any ids, whether or not they form UTF-8.

Defined results: a null or empty text has no ids (an empty list); repeated rows and repeated or null ids are encoded
row by row; an empty table gives an empty result; columns other than the id and the text are ignored. Special tokens'
strings in a text are ordinary text. An id outside the rank file raises an error when decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, field, texts

#: Code points from which a text is cut into pieces of about that length.
PIECE = 1 << 16
#: White space characters from which a run is encoded outside the split pattern.
RUN = 1 << 12
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: What the split pattern takes for white space (Python's ``\s`` holds four control characters more).
_RUNS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN},}}")
_CODECS: dict[tuple[str, str], "Codec"] = {}


def rank_file() -> str:
    """The default rank file, of the public tokenizers installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at safe blanks, each piece at least ``size`` long but the last; whole if there is no safe blank."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.raw: list[bytes | None] = [None] * top
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.digits = [b"%d " % i for i in range(top)]

    def encode(self, text: str) -> list[int]:
        if len(text) < RUN:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _RUNS.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self._encode_pieces(text[at : run.start()])
            ids += self.encoding._core_bpe.encode_single_piece(text[run.start() : end].encode())
            at = end
        return ids + self._encode_pieces(text[at:])

    def _encode_pieces(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def ids_text(self, ids: list[int]) -> bytes:
        """The decimal ids, joined by one blank."""
        return b"".join(map(self.digits.__getitem__, ids))[:-1]


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and rank file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)`` for every row."""
    path, pattern = path or rank_file(), pattern or split_pattern()

    def fn(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        ids = [c.encode(t) for t in texts(batch.column(1))]
        return [batch.column(0), list(map(len, ids)), ids]

    schema = T.StructType([field(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return arrow_map(docs.select(id_col, text_col), fn, schema)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)``: the raw bytes of every row's ids (null ids: null bytes)."""
    path, pattern = path or rank_file(), pattern or split_pattern()

    def fn(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        return [batch.column(0), [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]]

    schema = T.StructType([field(encoded, id_col), T.StructField("bytes", T.BinaryType())])
    return arrow_map(encoded.select(id_col, ids_col), fn, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``(id, n_tokens, ids_sha256, decoded_sha256)``, and ``ids`` if they are kept."""
    path, pattern = path or rank_file(), pattern or split_pattern()

    def fn(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        counts, of_ids, of_bytes, kept = [], [], [], []
        for text in texts(batch.column(1)):
            ids = c.encode(text)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(c.ids_text(ids)).hexdigest())
            of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            if keep_ids:
                kept.append(ids)
        return [batch.column(0), counts, of_ids, of_bytes, *([kept] if keep_ids else [])]

    names = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    names += [("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    return arrow_map(docs.select(id_col, text_col), fn, T.StructType([field(docs, id_col), *(T.StructField(*x) for x in names)]))
