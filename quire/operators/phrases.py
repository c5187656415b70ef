"""Meeting of texts and phrases.

A phrase is looked up by two neighbouring words of it, those that fewest phrases
have, so phrases that begin with one and the same word do not all meet the texts
that hold it. A bitmap of fixed size over the keys of all phrases drops most word
pairs of the texts before anything is shuffled; the texts themselves stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import cut

TOKEN = r"[\p{L}\p{N}_]+"
#: Bits of the bitmap as a power of two, lengths at which a second word counts by its beginning.
_BITS, _WIDTHS = 24, (1, 3, 6)
_ALONE, _LEFT = np.uint64(1), np.uint64(2)


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of two hashes; wraps around."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)


def _one(a: int, b: int) -> int:
    return int(_mix(np.array([a], "uint64"), np.array([b], "uint64")).view("int64")[0])


def _begin(word: str) -> str:
    """A word's beginning at the greatest of the fixed lengths that it has."""
    return word[: max(k for k in _WIDTHS if k <= len(word))]


def _phrase_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, key, letters, mark of every pair of words a phrase can be looked up by.

    The first word of three and more may be the end of a longer word of the text, so its
    pair is left out; of two words it counts, with a mark that ends of words matter.
    """
    for batch in batches:
        term, key, letters, mark = [], [], [], []
        for name, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(words) == 1:
                rows = [(_one(_hash(words[0]), 1), len(words[0]), None)]
            else:
                first = 0 if len(words) == 2 else 1
                end = _one(_hash(words[0]), 2) if first == 0 else None
                rows = [(_one(_hash(a), _hash(_begin(b))), len(a) + len(b), end) for a, b in zip(words[first:], words[first + 1 :])]
            for k, n, m in rows:
                term.append(name), key.append(k), letters.append(n), mark.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(key, pa.int64()), pa.array(letters, pa.int32()), pa.array(mark, pa.int64())], ["term", "key", "letters", "mark"])


def _text_keys(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, key of the words and pairs of words of each text that the bitmap lets through."""
    known: dict[str, tuple[list[int], list[int]]] = {}

    def there(keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - _BITS)
        return (bitmap[(at >> np.uint64(6)).astype("int64")] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def word(w: str) -> tuple[list[int], list[int]]:
        """Hashes of a word and its beginnings; hashes of its ends that begin a phrase of two words."""
        got = known.get(w)
        if got is None:
            ends = np.array([_hash(w[i:]) for i in range(1, len(w))], "uint64")
            got = known[w] = ([_hash(w), *(_hash(w[:k]) for k in _WIDTHS)], ends[there(_mix(ends, _LEFT))].tolist())
        return got

    for batch in batches:
        lists = batch.column(1)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        code, seen = coded.indices.to_numpy(zero_copy_only=False).astype("int64"), [word(w) for w in coded.dictionary.to_pylist()]
        hashes = np.array([s[0] for s in seen], "uint64").reshape(-1, 1 + len(_WIDTHS))
        alone = _mix(hashes[:, 0], np.full(len(seen), _ALONE))
        single = there(alone)[code]
        rows, keys = [row[single]], [alone[code[single]]]
        pair = np.flatnonzero(row[1:] == row[:-1])
        left, right, at = hashes[code[pair], 0], code[pair + 1], row[pair]
        ends = np.array([len(s[1]) for s in seen], "int64")
        if ends.any():
            more = ends[code[pair]]
            flat, start = np.array([e for s in seen for e in s[1]], "uint64"), np.cumsum(ends) - ends
            within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            left = np.concatenate([left, flat[np.repeat(start[code[pair]], more) + within]])
            right, at = np.concatenate([right, np.repeat(right, more)]), np.concatenate([at, np.repeat(at, more)])
        for k in range(1, 1 + len(_WIDTHS)):
            x = _mix(left, hashes[right, k])
            ok = there(x)
            rows.append(at[ok]), keys.append(x[ok])
        rows, keys = np.concatenate(rows), np.concatenate(keys).view("int64")
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[fresh])), pa.array(keys[fresh])], [batch.schema.names[0], "key"])


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits at the leading bits of all keys and marks, 2 MB however many there are."""
    at = keys.select(F.explode(F.array_compact(F.array("key", "mark"))).alias("k")).select(F.expr(f"shiftrightunsigned(k, {64 - _BITS})").alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), "uint64")
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view("uint64")
    return out


def met(texts: DataFrame, terms: DataFrame, key: str = "id") -> DataFrame:
    """key, term of every text that may hold a term, each pair once.

    texts: key, source_text; terms: term. Every text that holds the term in lower case and has its
    first word as a word is among them, with few others; the caller tests what it means by holding.
    """
    forms = terms.where("term is not null").select("term").distinct().select("term", tokens(F.col("term")).alias("_t")).where("size(_t) > 0")
    keys = forms.mapInArrow(_phrase_keys, "term string, key long, letters int, mark long")
    shared = keys.withColumn("_n", F.count("*").over(Window.partitionBy("key")))
    chosen = cut(shared.groupBy("term").agg(F.min_by(F.struct("key", "mark"), F.struct("_n", -F.col("letters"), "key")).alias("k")).select("term", "k.*"))
    kind = texts.schema[key].dataType.simpleString()
    said = texts.where("source_text is not null").select(key, tokens(F.col("source_text")).alias("_t"))
    found = said.mapInArrow(partial(_text_keys, bitmap=_bitmap(chosen)), f"{key} {kind}, key long")
    return found.join(chosen, "key").select(key, "term").distinct()
