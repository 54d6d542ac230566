"""Operator 7: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import functools
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONGEST_WORD, bytes_of, documents, map_texts
from .pieces import Pieces, load, stretches, words_of

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Distinct words of at most `LONGEST_WORD` characters that a worker remembers; the memo starts anew beyond it. Some 350 bytes an entry at most.
MEMO_WORDS = 250_000


def count_word(word: str, p: Pieces) -> int:
    """Tokens of one word: initial symbols minus merges.

    The heap holds adjacent pairs by (rank, place); the list of symbols is linked by `before` and `after`. A popped
    pair counts only if both of its symbols are still the ones that were pushed. A character outside the
    vocabulary starts as one symbol for each UTF-8 byte and never merges.
    """
    get, merges, width = p.symbols.get, p.merges.get, p.width
    none = width - 1
    sym = [get(c, none) for c in word]
    n = count = len(sym)
    if none in sym:
        count += sum(len(c.encode()) - 1 for c, s in zip(word, sym) if s == none)
    heap = []
    left = sym[0]
    for i in range(1, n):
        right = sym[i]
        found = merges(left * width + right)
        if found:
            heap.append((found[0], i - 1, left, right, found[1]))
        left = right
    if not heap:
        return count
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while heap:
        _, i, a, b, to = heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        count -= 1
        sym[i], sym[j] = to, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = merges(to * width + sym[k])
            if found:
                heappush(heap, (found[0], i, to, sym[k], found[1]))
        h = before[i]
        if h >= 0:
            found = merges(sym[h] * width + to)
            if found:
                heappush(heap, (found[0], h, sym[h], to, found[1]))
    return count


class CountMemo(dict):
    def __init__(self, p: Pieces):
        super().__init__()
        self.pieces = p

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = count_word(word, self.pieces)
        if len(word) <= LONGEST_WORD:
            self[word] = value
        return value


@functools.cache
def worker_memo(path: str) -> CountMemo:
    """One memo for all tasks of a worker."""
    return CountMemo(load(path))


def count_text(text: str, memo: CountMemo) -> int:
    if not text:
        return 0
    return sum(sum(map(memo.__getitem__, words_of(stretch, memo.pieces))) for stretch in stretches(text))


def count_tokens(df: DataFrame, model: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text: (id, n_bytes, n_tokens, over_limit), one row per input row.

    Counts equal those of the library without begin or end ids. A null text is empty: no bytes, no tokens, not over
    the limit. Ids may be null or repeat; other columns are left out, whatever their names.
    """

    def run(batches):
        memo = worker_memo(model)
        for batch in batches:
            sizes, counts = [], []
            for raw in batch.column(1):
                raw = raw.as_py()
                sizes.append(len(raw))
                counts.append(count_text(raw.decode("utf-8", "replace"), memo))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), bytes_of(text_col).alias("text"))
    counted = map_texts(rows, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(MODEL))
