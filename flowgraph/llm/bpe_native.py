"""The fold of ranked merges as a Spark expression: higher-order functions over the bytes of a word and a literal rank map.

Same ids as flowgraph.llm.bpe. It is meant for tables of distinct words: every word costs some hundred microseconds, so
that whole corpora go through bpe.encode (figures in the README).

Cases: a null word gives null, an empty one no ids.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of the literal rank map: a part is searched from its front, so they are kept small.
PARTS = 4096


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal, array<map<hex of the piece, rank>>; Catalyst folds the parsing away."""
    parts: list[dict[str, int]] = [{} for _ in range(PARTS)]
    for piece, rank in ranks.items():
        parts[zlib.crc32(piece.hex().encode()) % PARTS][piece.hex()] = rank
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>")


def word_ids(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids (array<int>) of a word, which is one match of the tokenizer's pattern."""
    known = rank_map(ranks)
    none = F.array().cast("array<int>")

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(known, (F.crc32(piece) % PARTS + 1).cast("int")), piece)

    def join_best(parts: Column, pairs: Column) -> Column:
        best = F.array_min(pairs)
        at = F.array_position(pairs, best).cast("int")
        joined = F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)))
        return F.when(best.isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), at - 1), joined, F.slice(parts, at + 2, F.size(parts))))

    def step(parts: Column, _: Column) -> Column:
        pair = lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1)))
        pairs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), pair)).otherwise(none)
        return F.element_at(F.transform(F.array(pairs), lambda found: join_best(parts, found)), 1)

    digits = F.lower(F.hex(F.encode(word, "UTF-8")))
    n = F.octet_length(word)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, (i * 2 - 1).cast("int"), F.lit(2)))
    folded = F.transform(F.aggregate(F.sequence(F.lit(1), n), each, step), rank)
    return F.when(n == 0, none).when(rank(digits).isNotNull(), F.array(rank(digits))).otherwise(folded)
