"""Token counts by trie-shared dynamic programming.

A text is cut at white space; each pre-token gets the word mark in front and is segmented into vocabulary pieces so
that the sum of their scores is largest.  The distinct pre-tokens of a piece of a partition are walked in sorted order,
which is the order of a depth-first walk of their trie: the stack of forward scores of the path above stays, so a
shared prefix is scored once, and the count at a terminal node is stored for all occurrences of its pre-token.

Scores follow Zipf's law over the vocabulary's order: -log(rank + 2), as the public vocabulary orders its pieces by
frequency and has no probabilities.  A character outside the vocabulary costs one byte piece per UTF-8 byte.  Ties take
fewer tokens.  The vocabulary is read where the driver runs and sent out once; its size is the tokenizer's.

Results for odd input: null, empty and white-space texts have no tokens and score 0; repeated rows count each; texts
are read whole, and a text without any white space is one pre-token, segmented in time linear in its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import map_texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"
BYTE_SCORE = -12.0


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Score by piece; control, unknown and byte pieces are left out."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: -math.log(rank + 2) for rank, piece in enumerate(normal)}


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def segment(words: Iterable[str], scores: dict[str, float], longest: int) -> list[tuple[int, float]]:
    """(tokens, score) of each word of a sorted sequence; scores of a prefix shared with the word before are kept."""
    best, count, above, out = [0.0], [0], "", []
    get = scores.get
    for word in words:
        word = WORD_MARK + word
        keep = _shared(above, word)
        del best[keep + 1:], count[keep + 1:]
        for end in range(keep + 1, len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "replace"))
            top, tokens = best[end - 1] + n * BYTE_SCORE, count[end - 1] + n
            for start in range(max(0, end - longest), end):
                found = get(word[start:end])
                if found is not None:
                    value = best[start] + found
                    if value > top or value == top and count[start] + 1 < tokens:
                        top, tokens = value, count[start] + 1
            best.append(top)
            count.append(tokens)
        above = word
        out.append((count[-1], best[-1]))
    return out


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The columns of ``docs`` but the text, with n_pretokens, n_tokens and score."""
    scores = load_vocabulary(path)
    longest = max(map(len, scores), default=1)
    sent = docs.sparkSession.sparkContext.broadcast(scores)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("score", T.DoubleType())])

    def run(batch):
        words = [t.split() if t else [] for t in batch.column("text").to_pylist()]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.array([w for own in words for w in own], dtype=object)
        codes, names = pd.factorize(flat) if len(flat) else (np.zeros(0, dtype=np.int64), [])
        order = sorted(range(len(names)), key=names.__getitem__)
        found = segment((names[i] for i in order), sent.value, longest)
        tokens, score = np.zeros(len(names), dtype=np.int64), np.zeros(len(names))
        for i, (n, s) in zip(order, found, strict=True):
            tokens[i], score[i] = n, s
        row = np.repeat(np.arange(len(words)), lengths)
        total = np.zeros(len(words), dtype=np.int64)
        np.add.at(total, row, tokens[codes])
        whole = np.bincount(row, weights=score[codes], minlength=len(words)) if len(flat) else np.zeros(len(words))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(f.name) for f in kept], pa.array(lengths), pa.array(total), pa.array(whole)],
            names=schema.names)

    return map_texts(docs, run, schema).withColumn("score", F.round("score", 6))
