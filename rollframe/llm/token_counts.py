"""Word-piece lengths by a linear longest-match automaton.

A trie over the UTF-8 bytes of the vocabulary gets failure links; each node also knows how
many tokens its greedy match pops on failure, so counting needs no pieces and no second look
at a byte.  All distinct words of a slice advance through the automaton together.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollframe.session import ship_package
from rollframe.llm.sentencepiece import MODEL_PATH, in_slices, model_bytes

WORD_MARK = "▁".encode()


def vocabulary(path: str = MODEL_PATH) -> list[bytes]:
    """The pieces of a piece model file; a word starts with the mark."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model_bytes(path))
    return [p.piece.encode() for p in m.pieces if p.type in (1, 4)]


class LongestMatch:
    """The automaton.  Every single byte is a token too, so matching never fails: a character
    outside the vocabulary counts as its UTF-8 bytes."""

    def __init__(self, vocab: list[bytes]):
        children: list[dict[int, int]] = [{}]
        token = [False]
        for piece in [bytes([b]) for b in range(256)] + vocab:
            at = 0
            for b in piece:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    token.append(False)
                at = children[at][b]
            token[at] = True
        n = len(children)
        self.fail, self.popped = np.zeros(n, np.int32), np.zeros(n, np.int32)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in children[u].items():
                queue.append(v)
                if token[v]:
                    self.popped[v] = 1  # the whole string is a token; go on from the root
                    continue
                z, pops = int(self.fail[u]), int(self.popped[u])
                while b not in children[z]:
                    pops += int(self.popped[z])
                    z = int(self.fail[z])
                self.fail[v], self.popped[v] = children[z][b], pops
        # rows of next states for nodes with children; the others share row 0 of "none"
        inner = [u for u in range(n) if children[u]]
        self.row = np.zeros(n, np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.full((len(inner) + 1, 256), -1, np.int32)
        for r, u in enumerate(inner, 1):
            self.next[r, list(children[u])] = list(children[u].values())

    def counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of each word (a string array without nulls), each with the word mark before it."""
        words = pc.cast(words, pa.large_binary())
        size = np.asarray(pc.binary_length(words)).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        start = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words)]
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)

        def step(m: int, chars: np.ndarray) -> None:
            to = self.next[self.row[state[:m]], chars]
            todo = np.flatnonzero(to < 0)
            while len(todo):
                u = state[todo]
                count[todo] += self.popped[u]
                state[todo] = u = self.fail[u]
                to[todo] = found = self.next[self.row[u], chars[todo]]
                todo = todo[found < 0]
            state[:m] = to

        for b in WORD_MARK:
            step(len(words), np.full(len(words), b, np.uint8))
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), "left")  # words longer than j
        for j in range(longest):
            step(m := int(active[j]), raw[start[:m] + j])
        todo = np.flatnonzero(state)
        while len(todo):
            count[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] != 0]
        out = np.empty(len(words), np.int64)
        out[order] = count
        return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """(id, n_words, n_tokens) for every input row: words are split at ASCII white space, each is
    cut by greedy longest match from its left.

    Null and empty texts have 0 of both; repeated rows give repeated results; extra columns
    are not read.  The vocabulary is read by the driver (bounded) and broadcast.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept: dict[str, LongestMatch] = {}

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    def count(texts: pa.Array) -> pa.Array:
        if "m" not in kept:
            kept["m"] = LongestMatch(shared.value)
        n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in in_slices(texts):
            parts = pc.ascii_split_whitespace(pc.fill_null(x, ""))
            size = np.asarray(pc.list_value_length(parts)).astype(np.int64)
            doc = np.repeat(np.arange(len(x)), size)
            coded = parts.flatten().dictionary_encode()
            index = np.asarray(coded.indices)
            per = kept["m"].counts(coded.dictionary)
            real = np.asarray(pc.binary_length(coded.dictionary)) > 0
            n_words.append(np.bincount(doc, real[index], len(x)).astype(np.int64))
            n_tokens.append(np.bincount(doc, np.where(real, per, 0)[index], len(x)).astype(np.int64))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_tokens))],
                                          names=["n_words", "n_tokens"])

    return docs.select(F.col(id_col), count(F.col(text_col)).alias("__c")).select(id_col, "__c.n_words", "__c.n_tokens")
