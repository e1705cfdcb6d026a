"""BPE encoding and decoding through tables of distinct words.

Texts are split into words; each distinct word is encoded once and its ids are joined back
at the word's positions.  Ids are decoded by a join with the pieces: here too each distinct
word's pieces are joined once.

The distinct words are those of a block of documents within a task, kept in a bounded table
that later blocks of the same worker reuse, and the joins are look-ups in it: nothing is shuffled and a lost
task is simply run again.  A table of the whole corpus, joined back by Spark, would have to send each block's
distinct words and word numbers through shuffles; the README has the figures.

Words of texts with plain Latin letters are found by one pattern; other texts are normalised and split by
the tokenizer's own steps, around strings of special tokens, and use the same kind of table.

Defined results: NULL is the empty text, which has no ids; strings of special tokens are
those tokens, as in the library; a NULL key comes out as NULL; repeated rows are encoded each; ties don't arise; a very
long text is split whole; an empty table gives no rows; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.common import texts
from veilspark.llm.vocab import LATIN_WORD, OTHER, library_tokenizer

#: Words a worker remembers at most; documents whose words are looked up together.
TABLE_WORDS = 300_000
BLOCK_CHARS = 1_000_000


class WordTable:
    """word -> (its ids as little-endian 32-bit integers, its pieces joined by spaces). ``split`` words are written in the letters of bytes already."""

    def __init__(self, name: str) -> None:
        self.name, self.table, self.split_table = name, {}, {}
        tokenizer = library_tokenizer(name)
        self.piece = {i: p for p, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        special = [t.content for _, t in sorted(tokenizer.get_added_tokens_decoder().items()) if t.special and not t.normalized]
        self.special = {t: self.row([tokenizer.token_to_id(t)]) for t in special}
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def row(self, ids: list[int]) -> tuple[bytes, str]:
        return pack(ids), " ".join([self.piece[i] for i in ids])

    def add(self, words: set[str]) -> None:
        new = list(words - self.table.keys())
        if len(self.table) + len(new) > TABLE_WORDS:
            self.table.clear()
            new = list(words)
        for word, e in zip(new, library_tokenizer(self.name).encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.table[word] = self.row(e.ids)

    def rows_of(self, text: str) -> Iterator[tuple[bytes, str]]:
        """The rows of any text's words, split by the tokenizer's own steps."""
        tokenizer = library_tokenizer(self.name)
        for part in self.around.split(text) if self.around else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(part)):
                if word not in self.split_table:
                    if len(self.split_table) >= TABLE_WORDS:
                        self.split_table.clear()
                    self.split_table[word] = self.row([t.id for t in tokenizer.model.tokenize(word)])
                yield self.split_table[word]


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    return packed.tobytes()


def normal(text: str) -> str:
    """As the vocabulary's normaliser on texts without ``OTHER`` characters: composed already, so lower case only."""
    return text.lower()


@lru_cache(maxsize=2)
def word_table(name: str) -> WordTable:
    return WordTable(name)


def encode_texts(texts_: list[str], name: str) -> Iterator[tuple[bytes, str]]:
    """(packed ids, decoded text) of each text."""
    table, at = word_table(name), 0
    while at < len(texts_):
        end, chars = at, 0
        while end < len(texts_) and chars < BLOCK_CHARS:
            chars, end = chars + len(texts_[end]), end + 1
        block = texts_[at:end]
        split = [None if OTHER.search(t) else LATIN_WORD.findall(normal(t)) for t in block]
        table.add(set().union(*(w for w in split if w)))
        for text, words in zip(block, split, strict=True):
            rows = list(table.rows_of(text)) if words is None else [table.table[w] for w in words]
            yield b"".join([r[0] for r in rows]), " ".join([r[1] for r in rows])
        at = end


DDL = "doc_id long, n_tokens long, ids binary, decoded string"


def bpe_encode(df: DataFrame, name: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit integers), decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = list(encode_texts(part.column(1).to_pylist(), name))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return texts(df, key, text).mapInArrow(run, DDL).withColumnRenamed("doc_id", key)


def bpe_digests(df: DataFrame, name: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and the SHA-256 of ids and of the decoded text, without sending either back to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(i) // 4, sha256(i).hexdigest(), sha256(d.encode("utf-8")).hexdigest()) for i, d in encode_texts(batch.column(1).to_pylist(), name)]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(df, key, text).mapInArrow(run, ddl).withColumnRenamed("doc_id", key)
