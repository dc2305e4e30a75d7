"""Token ids and token counts of whole texts."""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches

FRAGMENT = 1 << 18
BATCH_BYTES = 1 << 19
#: A worker keeps the lengths of words of KEPT_WORD bytes or less, KEPT_BYTES in all.
KEPT_WORD, KEPT_BYTES = 64, 1 << 27
ENTRY = 150  # bytes that an entry takes besides its word
# Fixed value: how a byte-level vocabulary cuts texts before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_tokenizers: dict[str, object] = {}
_encoders: dict[tuple[type, str], object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    """One tokenizer a worker; a batch is encoded by the calling thread alone."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def byte_alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the others from 256 on."""
    printable = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174]
    others = [i for i in range(256) if i not in printable]
    return {chr(i): i for i in printable} | {chr(256 + k): i for k, i in enumerate(others)}


class PieceIds:
    """Ids of a byte-level BPE file of the tokenizers library, with nothing kept between texts.

    The merges of such a file follow the order of its ids, so tiktoken's engine
    gives the same ids from the same vocabulary, several times faster; tests
    hold it against the library. It refuses very long runs of white space, and
    such texts go to the library itself. Strings of added tokens in a text stand
    for those tokens, as they do by default.
    """

    def __init__(self, path: str):
        import tiktoken

        encoder = self.encoder = _tokenizer(path)
        special = {token.content: i for i, token in encoder.get_added_tokens_decoder().items()}
        bytes_of = byte_alphabet()
        ranks = {bytes(map(bytes_of.__getitem__, token)): i for token, i in encoder.get_vocab(with_added_tokens=False).items() if token not in special}
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for text in texts:
            try:
                ids = self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                ids = np.array(self.encoder.encode(text, add_special_tokens=False).ids)
            yield ids.astype("<u4").tobytes()


class WordLengths:
    """Numbers of tokens of words between ASCII white space.

    For vocabularies whose pre-tokenizer drops white space and never crosses
    it. Long texts are read in fragments that end at white space, and a longer
    word is a fragment of its own; unseen words are encoded in batches of a
    bounded number of bytes. Only lengths are kept, of short words, in a bounded
    number of bytes.
    """

    def __init__(self, path: str):
        self.encoder, self.kept, self.held = _tokenizer(path), {}, 0

    def fragments(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > FRAGMENT:
            cut = max(text.rfind(c, at, at + FRAGMENT) for c in (b" ", b"\n", b"\t", b"\r"))
            if cut <= at:  # one very long word
                found = re.compile(rb"[ \t-\r]").search(text, at + FRAGMENT)
                cut = found.start() if found else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _lengths(self, words: list[bytes]) -> dict[bytes, int]:
        found = self.encoder.encode_batch_fast([x.decode() for x in words], add_special_tokens=False)
        return {word: len(x.ids) for word, x in zip(words, found, strict=True)}

    def _known(self, parts: list[list[bytes]]) -> dict[bytes, int]:
        """The lengths of all words of parts; short words are kept, long ones only returned."""
        if self.held > KEPT_BYTES:
            self.kept, self.held = {}, 0
        fresh, size, long_ = [], 0, {}

        def encode() -> None:
            for word, n in self._lengths(fresh).items():
                if len(word) <= KEPT_WORD:
                    self.kept[word] = n
                    self.held += len(word) + ENTRY
                else:
                    long_[word] = n

        for word in set().union(*parts).difference(self.kept):
            fresh.append(word)
            size += len(word)
            if size > BATCH_BYTES:
                encode()
                fresh, size = [], 0
        encode()
        return ChainMap(self.kept, long_) if long_ else self.kept

    def many(self, texts: list[bytes]) -> list[int]:
        out = [0] * len(texts)
        waiting: list[tuple[int, list[bytes]]] = []
        size = 0

        def flush() -> None:
            known = self._known([words for _, words in waiting])
            for i, words in waiting:
                out[i] += sum(map(known.__getitem__, words))
            waiting.clear()

        for i, text in enumerate(texts):
            for part in self.fragments(text):
                waiting.append((i, part.split()))
                size += len(part)
                if size > 2 * BATCH_BYTES:
                    flush()
                    size = 0
        flush()
        return out


def worker_cache(kind: type, path: str):
    """One encoder for all tasks of a worker, so that they share what it has seen."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text.

    path: a vocabulary of the tokenizers library that drops white space. Only
    lengths leave the Arrow function. A null text counts as empty: no bytes and
    no tokens. Repeated rows and null ids are counted like any other; other
    columns are not looked at; an empty table gives an empty result.
    """
    small_arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_cache(WordLengths, path)
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(lengths.many(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
