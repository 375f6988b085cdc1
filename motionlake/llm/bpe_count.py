"""Token counts by byte-pair merging with a heap over a linked list.

The vocabulary of a sentencepiece BPE model is read through the library; the
merging is done here and gives counts only. Text turns into symbols, one for
each character that the vocabulary has and one for each UTF-8 byte of any other
character. The lowest-ranked adjacent pair is merged until none is left; the
count is the number of symbols minus the number of merges.

No piece holds a word mark after another character, nor a line feed. So no merge
crosses the start of a word or a line, and the count of a text is the sum over
its words, which are counted once each per worker and remembered. The memory
for them is bounded; when it is full it is emptied.

Defined cases: null counts as empty; empty texts have no tokens; texts of any
length are taken whole; a null doc_id and repeated rows pass through as they are.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
REMEMBERED = 1_000_000


class PairMerger:
    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        usable = [
            i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in usable}
        self.words_apart = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank)
        self.known: dict[str, int] = {}
        self.split = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall

    def symbols_less_merges(self, word: str) -> int:
        rank = self.rank
        total = sum(1 if c in rank else len(c.encode()) for c in word)
        n = len(word)
        if n < 2:
            return total
        part = list(word)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = word[i : i + 2]
            r = rank.get(pair)
            if r is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or not part[i] or part[i] + part[j] != pair or len(part[i]) >= len(pair):
                continue
            part[i], part[j] = pair, ""
            total -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(pair + part[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, pair + part[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(part[h] + pair)
                if r is not None:
                    heapq.heappush(heap, (r, h, part[h] + pair))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.words_apart:
            return self.symbols_less_merges(text)
        known, total = self.known, 0
        for word, times in Counter(self.split(text)).items():
            n = known.get(word)
            if n is None:
                n = self.symbols_less_merges(word)
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n * times
        return total


@lru_cache(maxsize=4)
def merger(model_path: str) -> PairMerger:
    """One per worker and model."""
    return PairMerger(model_path)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row. model_path must exist on every executor."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model_path)
        for b in batches:
            texts = b.column(1)
            n = [m.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    with_bytes = rows.select(F.struct("id", F.octet_length("text").cast("long").alias("n_bytes")).alias("id"), "text")
    out = with_bytes.mapInArrow(counted, f"id struct<id:{id_type},n_bytes:bigint>, n_tokens bigint")
    return out.select(F.col("id.id").alias(id_col), F.col("id.n_bytes").alias("n_bytes"), "n_tokens")
