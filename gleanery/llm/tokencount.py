"""Token counts by the best unigram segmentation, computed over a trie.

A vocabulary of byte strings with ranks becomes a unigram model: a piece of rank r has the log-score
-log(r + RANK_SHIFT) (ranks order pieces by how early they were merged, hence by use). A pre-token's segmentation is the
one with the largest sum of scores, and, among equals, the fewest pieces; the number of its pieces is its token count.

Distinct pre-tokens are inserted in a trie. Each node holds the best score, and piece count, of the prefix that ends
there: the forward step looks back along the path over the pieces that end at the node. Pre-tokens that share a prefix share
its nodes, so a prefix is scored once; at its last node a pre-token stores its count.

Scale: one pass, no shuffle: each task keeps a trie over its own distinct pre-tokens. When the trie reaches its bound of
nodes it's begun anew, which costs time and changes no count. A pre-token has DEEPEST nodes at most: what lies beyond is scored along the
pre-token alone, with the scores in mind that a piece can reach back to.

Defined cases: null and empty texts have no tokens; single bytes outside the vocabulary count as pieces of the lowest
score; repeated rows count as often as they occur; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

RANK_SHIFT = 10.0
#: Bytes of a pre-token that have nodes.
DEEPEST = 512
#: A pre-token: a word with the one blank before it, another run of visible characters, or a run of white space.
PRE_TOKEN = r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+"


class Trie:
    """Prefix nodes with forward scores over a unigram vocabulary. A node's id indexes the lists below; node 0 is the root."""

    def __init__(self, scores: dict[bytes, float], most_nodes: int) -> None:
        self.scores, self.most = scores, most_nodes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 1.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, token: str) -> int:
        """Tokens in a pre-token, stored at its last node."""
        if len(self.best) > self.most:
            self.clear()
        s = token.encode()
        child, best, count, scores = self.child, self.best, self.count, self.scores
        node, path = 0, [0]
        for j, byte in enumerate(s[:DEEPEST], 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                top, fewest = best[path[j - 1]] + scores.get(s[j - 1 : j], self.unknown), count[path[j - 1]] + 1
                for i in range(max(0, j - self.longest), j - 1):
                    score = scores.get(s[i:j])
                    if score is not None:
                        before = path[i]
                        score += best[before]
                        if score > top or score == top and count[before] + 1 < fewest:
                            top, fewest = score, count[before] + 1
                node = child[key] = len(best)
                best.append(top)
                count.append(fewest)
            path.append(node)
        return count[node] if len(s) <= DEEPEST else self._beyond(s, path)

    def _beyond(self, s: bytes, path: list[int]) -> int:
        """Tokens in a pre-token that goes on below its last node."""
        near = deque(((self.best[n], self.count[n]) for n in path[-self.longest :]), maxlen=self.longest)
        for j in range(len(path), len(s) + 1):
            found = (near[-1][0] + self.scores.get(s[j - 1 : j], self.unknown), -near[-1][1] - 1)
            for back in range(2, len(near) + 1):
                score = self.scores.get(s[j - back : j])
                if score is not None:
                    found = max(found, (score + near[-back][0], -near[-back][1] - 1))
            near.append((found[0], -found[1]))
        return near[-1][1]

    def __call__(self, token: str) -> int:
        n = self.terminal.get(token)
        if n is None:
            n = self.insert(token)
            if len(token) <= 64:
                self.terminal[token] = n
        return n


def vocabulary(path: str) -> dict[bytes, float]:
    """Scores of the pieces in a file of ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): -log(int(b) + RANK_SHIFT) for a, b in map(bytes.split, f)}


_tries: dict[tuple[str, int], Trie] = {}


def count_tokens(docs: DataFrame, ranks: str | None = None, most_nodes: int = 600_000) -> DataFrame:
    """Per document: doc_id, n_pretokens, n_tokens, n_bytes."""
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    ranks = ranks or common.tokenizer_path("byte_bpe_50k.tiktoken")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _tries.get((ranks, most_nodes)) or _tries.setdefault((ranks, most_nodes), Trie(vocabulary(ranks), most_nodes))
        split = re.compile(PRE_TOKEN).findall
        for batch in batches:
            pre, tokens, size = [], [], []
            for text in batch.column(1).to_pylist():
                parts = split(text or "")
                known = trie.terminal
                try:
                    n = sum(map(known.__getitem__, parts))
                except KeyError:
                    n = sum(map(trie, parts))
                pre.append(len(parts))
                tokens.append(n)
                size.append(len((text or "").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens", "n_bytes"])

    return common.documents(docs).mapInArrow(rows, "doc_id long, n_pretokens long, n_tokens long, n_bytes long")


def op6_trie_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
