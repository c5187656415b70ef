"""Encoding a corpus with a public tokenizer, and decoding it again.

Texts go to the ``tokenizers`` library in Arrow batches. A byte-level tokenizer
works on the UTF-8 bytes of the text, each shown as one printable character; the
offsets it gives back count characters, and a character of several bytes may be
split over tokens, whose offsets then all cover the whole character. Decoding
reverses the byte table over the ids, so split characters come back whole; only
a sequence cut in the middle of a character needs the replacement character.

Batches are bounded by characters, not by rows. A text longer than a piece is cut
where the tokenizer's own pre-tokenizer always cuts: before a single blank
between two characters that are not blanks. Such pieces give the same ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from importlib import util

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

DEFAULT = "byte_bpe_50k.json"
#: Characters of one call of the library, and of one piece of a long text.
BATCH_CHARS = 400_000
PIECE_CHARS = 200_000


def tokenizer_path(name: str = DEFAULT) -> str:
    """Place of a public tokenizer's file: a path, or a name in QUIRE_TOKENIZERS, the installed package or /opt/tokenizers."""
    if os.path.sep in name:
        return name
    folders = [os.environ.get("QUIRE_TOKENIZERS", "")]
    if (spec := util.find_spec("public_tokenizers")) and spec.origin:
        folders.append(os.path.dirname(spec.origin))
    folders.append("/opt/tokenizers")
    for f in folders:
        if f and os.path.exists(os.path.join(f, name)):
            return os.path.join(f, name)
    raise FileNotFoundError(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The printable character of each byte, by the public rule of byte-level BPE, reversed."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    table = byte_table()
    model = json.load(open(path))
    words = dict(model["model"]["vocab"]) | {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    out = [b""] * (max(words.values()) + 1)
    for w, i in words.items():
        out[i] = bytes(table[c] for c in w) if all(c in table for c in w) else w.encode()
    return out


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A long text cut before single blanks inside running text; whole where there is none."""
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while at > start + 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace() and at + 1 < len(text)):
            at -= 1
        if at <= start + 1:
            at = start + size
            while at < len(text) - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
                at += 1
            if at >= len(text) - 1:
                break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


def _batches(texts: list[str]) -> Iterator[list[str]]:
    batch, chars = [], 0
    for t in texts:
        if batch and chars + len(t) > BATCH_CHARS:
            yield batch
            batch, chars = [], 0
        batch.append(t)
        chars += len(t)
    if batch:
        yield batch


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of each text; none for empty and null."""
    t = _tokenizer(path)
    out: list[list[int]] = [[] for _ in texts]
    whose, flat = [], []
    for i, x in enumerate(texts):
        if x:
            for p in pieces(x):
                whose.append(i)
                flat.append(p)
    at = 0
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    for batch in _batches(flat):
        for e in encode(batch, add_special_tokens=False):
            i = whose[at]
            out[i] = out[i] + e.ids if out[i] else e.ids
            at += 1
    return out



def token_ids(text: Column, tokenizer: str = DEFAULT) -> Column:
    """Token ids as array<int>, without special tokens; an empty list for empty and null texts."""
    path = tokenizer_path(tokenizer)

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(encode_texts(texts.to_pylist(), path), pa.list_(pa.int32()))

    return ids(text)


def token_count(text: Column, tokenizer: str = DEFAULT) -> Column:
    """Number of tokens as int; 0 for empty and null."""
    path = tokenizer_path(tokenizer)

    @F.arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(x) for x in encode_texts(texts.to_pylist(), path)], pa.int32())

    return count(text)


def token_spans(text: Column, tokenizer: str = DEFAULT) -> Column:
    """array<struct<id, start, end>>: ids with character offsets into the text; a split character is covered by each of its tokens."""
    path = tokenizer_path(tokenizer)
    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<id:int,start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        t = _tokenizer(path)
        rows = []
        for x in texts.to_pylist():
            row, base = [], 0
            for p in pieces(x) if x else []:
                e = t.encode(p, add_special_tokens=False)
                row += [{"id": i, "start": a + base, "end": b + base} for i, (a, b) in zip(e.ids, e.offsets)]
                base += len(p)
            rows.append(row)
        return pa.array(rows, kind)

    return spans(text)


def decode_ids(ids: Column, tokenizer: str = DEFAULT) -> Column:
    """The text of an id list; the empty string for an empty list, null for null. Unknown ids raise."""
    path = tokenizer_path(tokenizer)

    @F.arrow_udf(StringType())
    def text(lists: pa.Array) -> pa.Array:
        table = _token_bytes(path)
        return pa.array([None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return text(ids)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT) -> DataFrame:
    """key and ids of every row. Repeated rows give repeated results; an empty table gives an empty one.

    Only the two columns are read, so others may have any name. Empty and null
    texts both give an empty list.
    """
    return documents.select(F.col(key), F.col(text_col).alias("_text")).select(key, token_ids(F.col("_text"), tokenizer).alias("ids"))
