"""Token counts for a sentencepiece BPE model: heap-and-linked-list merging, no identifiers emitted."""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame

from speechloom.llm.common import Bounded, bound_batches, map_columns, texts

#: Distinct segments each Python worker keeps.
SEGMENTS_KEPT = 900_000

SPACE = "▁"


class PieceCounter:
    """Counts the tokens of whole texts.

    A text, with its spaces written as SPACE and one more in front, is cut where no piece of the vocabulary reaches
    across: before each run of SPACE, and around line feeds where no piece holds one. Each distinct segment is counted
    once: a count is the initial symbols (a character without a piece counts as its UTF-8 bytes) less the merges.
    """

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        assert not any(SPACE in p.lstrip(SPACE) for p in self.score), "a piece reaches over a word's start"
        breaks = "".join(c for c in "\n\r\t" if not any(c in p for p in self.score))
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+|[{breaks}]" if breaks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.known = Bounded(SEGMENTS_KEPT, lambda segments: map(self.count_segment, segments))

    def count_segment(self, segment: str) -> int:
        """Pops the best-scored adjacent pair (the leftmost of equals) until none is left."""
        score = self.score
        if segment in score and len(segment) == 1:
            return 1
        count = sum(1 if c in score else len(c.encode()) for c in segment)
        parts = list(segment)
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None:
                heap.append((-s, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            # A merged-away symbol is left empty, so stale pairs no longer match.
            parts[i], parts[j] = left + right, ""
            k = after[i] = after[j]
            count -= 1
            if k >= 0:
                before[k] = i
                s = score.get(parts[i] + parts[k])
                if s is not None:
                    heapq.heappush(heap, (-s, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0:
                s = score.get(parts[h] + parts[i])
                if s is not None:
                    heapq.heappush(heap, (-s, h, parts[h], parts[i]))
        return count

    def count_batch(self, batch: list[str]) -> list[int]:
        cut = [self.cut.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in batch]
        known = self.known.view(set().union(*cut))
        return [sum(map(known.__getitem__, c)) for c in cut]


_LOADED: dict[str, PieceCounter] = {}


def loaded(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether there are more than limit.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows are counted each for itself; an empty table gives an
    empty one; other columns of docs are left out.
    """
    bound_batches(docs.sparkSession)

    def make(batches):
        counter = loaded(model_file)
        for b in batches:
            n = counter.count_batch(b["text"])
            yield {"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in b["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_columns(texts(docs, "doc_id"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
