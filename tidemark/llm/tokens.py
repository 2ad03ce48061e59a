"""Token counts of whole texts under a unigram vocabulary.

Spaces become the mark of a word's beginning, one stands before the text, and each mark begins a pre-token, as in
Metaspace pre-tokenisation. Distinct pre-tokens are inserted in a trie; a node is a prefix and holds the best
unigram score of any segmentation of it and that segmentation's number of tokens, computed from its ancestors the first time
a pre-token passes through. So a prefix that many pre-tokens share is scored once. The node where a pre-token ends
stores its count, and a text's count is the sum over its pre-tokens. A trie serves one task and is
begun anew when it has ``TRIE_NODES`` nodes, which changes no count.

A character that no piece covers costs one token per UTF-8 byte. The vocabulary comes from a SentencePiece file whose path
is a parameter. Scores of a unigram file are used as they are; a BPE file holds ranks instead, which are read as
Zipf's law: p = 1 / (rank + 1), normalised. Equal scores go to fewer tokens. Defined results: null and empty texts have no
tokens; repeated rows stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
TRIE_NODES = 1_000_000


def vocabulary(path: str = MODEL) -> dict[str, float]:
    """Log probability of each piece of a SentencePiece file, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
    if all(s == int(s) for s in scores.values()):
        total = math.log(sum(1 / (1 - s) for s in scores.values()))
        return {p: -math.log(1 - s) - total for p, s in scores.items()}
    return scores


class Trie:
    """Forward scores of every prefix seen; counts of the pre-tokens that ended."""

    def __init__(self, scores: dict[str, float], most: int = TRIE_NODES):
        self.scores, self.most = scores, most
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.counts: dict[str, int] = {}
        self._begin()

    def _begin(self):
        self.children, self.best, self.tokens = [None], [0.0], [0]  # a node without children has no dictionary
        self.counts.clear()

    def count(self, word: str) -> int:
        known = self.counts.get(word)
        return self.insert(word) if known is None else known

    def insert(self, word: str) -> int:
        if len(self.best) > self.most:
            self._begin()
        path, node, scores, best, tokens = [0], 0, self.scores, self.best, self.tokens
        for end, ch in enumerate(word, 1):
            below = self.children[node]
            if below is None:
                below = self.children[node] = {}
            follow = below.get(ch)
            if follow is None:
                top = best[node] + self.unknown if ch not in scores else -math.inf
                n = tokens[node] + len(ch.encode("utf-8", "surrogatepass")) if ch not in scores else 0
                for begin in range(max(0, end - self.longest), end):
                    s = scores.get(word[begin:end])
                    if s is not None:
                        total, m = best[path[begin]] + s, tokens[path[begin]] + 1
                        if total > top or total == top and m < n:
                            top, n = total, m
                follow = below[ch] = len(best)
                self.children.append(None)
                best.append(top)
                tokens.append(n)
            node = follow
            path.append(node)
        self.counts[word] = tokens[node]
        return tokens[node]


def pretokens(text: str) -> list[str]:
    return [MARK + part for word in text.split(" ") for part in word.split(MARK)] if text else []


def token_counts(docs: DataFrame, scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row. The vocabulary is broadcast: its size is that of its file."""
    shared = docs.sparkSession.sparkContext.broadcast(scores if scores is not None else vocabulary())

    def run(batches):
        trie = Trie(shared.value)
        for batch in batches:
            pieces, tokens = [], []
            for text in batch.column("text"):
                words = pretokens(text.as_py() or "")
                pieces.append(len(words))
                tokens.append(sum(map(trie.count, words)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
