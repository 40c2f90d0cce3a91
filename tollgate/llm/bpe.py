"""Operator 6: BPE encoding and decoding through a distinct-word table.

Texts are split into words at the start of each run of white space, which no
match of the byte-level pre-tokenizer's pattern crosses, and at the strings of
special tokens.  Each distinct word is encoded once, in its shard; the ids
come back to the word's positions.  ``decode`` looks every id up in the
id-to-piece table (one row per vocabulary entry, a fixed size) and joins the
pieces' bytes.

Null text counts as empty; an empty text has no ids and decodes to ''.  Null
or repeated ids of documents are kept, one result row per input row; an empty
table gives an empty result.  Other columns are ignored."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, pack, unpack
from .dictionary import block_words, blocks_of, shard_values, sharded, texts_of, to_blocks

#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

def tokenizer(path: str):
    """The tokenizer of a vocabulary file, once per process."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return t

    return held("bpe", path, load)


def special_strings(path: str) -> list[str]:
    return sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)


def splitter(path: str):
    """text -> words whose encodings, one after the other, encode the text."""
    special = special_strings(path)
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def split(text: str) -> list[str]:
        if cut and any(s in text for s in special):
            out: list[str] = []
            for i, part in enumerate(cut.split(text)):
                out += [part] if i % 2 else _WORD.findall(part)
            return out
        return _WORD.findall(text)

    return split


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row."""
    dealt, n_blocks, n_shards = blocks_of(docs, id_col, text_col)

    def count(table: pa.Table) -> dict[str, int]:
        split = splitter(path)
        words: set[str] = set()
        for t in texts_of(table):
            words.update(split(t))
        return dict.fromkeys(words, 0)

    def value(shard, words, counts):
        t = tokenizer(path)
        ids, ends = [], [0]
        for i in range(0, len(words), 4096):
            for e in t.encode_batch(words[i : i + 4096], add_special_tokens=False):
                ids.append(e.ids)
                ends.append(ends[-1] + len(ids[-1]))
        flat = np.fromiter((x for one in ids for x in one), np.uint32, ends[-1])
        starts, n = np.array(ends[:-1], np.int64), np.diff(np.array(ends, np.int64))

        def packed(idx):
            return pack(np.concatenate([n[idx].astype(np.uint32), _gather(flat, starts[idx], n[idx])]))

        return packed

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        split = splitter(path)
        at: dict[str, int] = {}
        rows = [
            np.fromiter((at.setdefault(w, len(at)) for w in split(t)), np.int32) for t in texts_of(left)
        ]
        blobs = dict(zip(right.column("shard").to_pylist(), right.column("values").to_pylist()))
        n, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        flat, end = [np.zeros(0, np.uint32)], 0
        for s, words in enumerate(sharded(at, n_shards)):
            if words:
                got = unpack(blobs[s], np.uint32)
                lens, own = got[: len(words)].astype(np.int64), np.fromiter(map(at.__getitem__, words), np.int64)
                n[own], starts[own] = lens, end + np.cumsum(lens) - lens
                flat.append(got[len(words) :])
                end += len(flat[-1])
        ids = np.concatenate(flat)
        sizes = np.cumsum([0, *(int(n[idx].sum()) for idx in rows)])
        values = np.empty(sizes[-1], np.int32)
        for idx, lo, hi in zip(rows, sizes, sizes[1:]):
            values[lo:hi] = _gather(ids, starts[idx], n[idx])
        column = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))
        return pa.table({"id": left.column("id"), "ids": column})

    kind = docs.schema[id_col].dataType.simpleString()
    values = shard_values(block_words(dealt, n_shards, count), value)
    out = to_blocks(dealt, n_blocks, values, place, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def _gather(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start : start + n] of every pair, joined."""
    total = int(n.sum())
    ends = np.cumsum(n)
    return flat[np.arange(total) + np.repeat(starts - (ends - n), n)]


def id_pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes that each id stands for."""

    def load():
        t = tokenizer(path)
        # The byte-level alphabet: printable bytes stand for themselves, the
        # others for the characters from U+0100 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        table = [b""] * t.get_vocab_size(with_added_tokens=True)
        for piece, i in t.get_vocab(with_added_tokens=True).items():
            known = all(c in byte_of for c in piece)
            table[i] = bytes(byte_of[c] for c in piece) if known else piece.encode()
        return table

    return held("bpe", ("pieces", path), load)


def decode(ids: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text that each row's ids stand for (null ids: null)."""

    @F.pandas_udf("string")
    def pieces_of(column: pd.Series) -> pd.Series:
        table = id_pieces(path)
        return column.map(
            lambda x: None if x is None else b"".join([table[i] for i in x.tolist()]).decode("utf-8", "replace")
        )

    return ids.withColumn(out_col, pieces_of(F.col(ids_col)))
