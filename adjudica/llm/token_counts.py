"""Counting tokens by byte-pair merges on a heap and a linked list, without forming an identifier."""

from __future__ import annotations

import functools
import heapq
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.llm.bpe import WordTable, byte_alphabet
from adjudica.llm.columns import id_and_text, map_batches


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Initial symbols minus merges.

    A heap holds the adjacent pairs that have a rank, lowest rank and leftmost first. A popped pair
    is stale if one of its symbols has changed. A merge puts the joined symbol in the left place,
    unlinks the right one and pushes the pairs on both sides.
    """
    size = len(symbols)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    rank = ranks.get
    heap = [
        (k, i, symbols[i], symbols[i + 1])
        for i in range(size - 1)
        if (k := rank((symbols[i], symbols[i + 1]))) is not None
    ]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= size or symbols[j] != right:
            continue
        symbols[i], symbols[j], after[i] = left + right, "", after[j]
        merges += 1
        following, previous = after[j], before[i]
        if following < size:
            before[following] = i
            if (k := rank((symbols[i], symbols[following]))) is not None:
                heapq.heappush(heap, (k, i, symbols[i], symbols[following]))
        if previous >= 0 and (k := rank((symbols[previous], symbols[i]))) is not None:
            heapq.heappush(heap, (k, previous, symbols[previous], symbols[i]))
    return size - merges


class CountTable(WordTable):
    """Tokens of a text, from the merge ranks in the vocabulary file alone."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        merges = vocabulary["model"]["merges"]
        self.ranks = {
            tuple(pair.split(" ") if isinstance(pair, str) else pair): k
            for k, pair in enumerate(merges)
        }
        self.to_alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.total = sum
        super().__init__(sorted(token["content"] for token in vocabulary["added_tokens"]))

    def value(self, word: str) -> int:
        return merged_length(
            [*word.encode().decode("latin-1").translate(self.to_alphabet)], self.ranks
        )

    def special_value(self, text: str) -> int:
        return 1


@functools.lru_cache(maxsize=1)
def _count_table(path: str) -> CountTable:
    return CountTable(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a byte-level byte-pair vocabulary in JSON, at the same place on
    every executor. Null text counts as empty: 0 bytes, 0 tokens. Strings of the vocabulary's special
    tokens count as one token each. Null ids and repeated rows stay as they are; an empty table gives
    none. One pass, no shuffle.
    """

    def work(batches):
        table = _count_table(vocabulary)
        for batch in batches:
            texts = [text or "" for text in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "n_bytes": [len(text.encode()) for text in texts],
                "n_tokens": [table.of_text(text) for text in texts],
            }

    counted = map_batches(id_and_text(docs), work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
