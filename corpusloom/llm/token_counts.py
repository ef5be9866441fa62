"""Operator 2: token counts with the whole-token shortcut.

The vocabulary is examined once, on the driver. A text is cut wherever no piece
has the two bytes on either side of the cut next to each other: a merge across
the cut would give such a piece, so none can happen and the text's count is the
sum over its pre-tokens. Every piece that encodes alone (behind a separator
that joins with nothing) as exactly one token is proven a whole token: equal
pre-tokens count one each, without merging. Only the rest is merged, each
distinct one once, and remembered in a bounded store.

Behaviour: null and empty texts have no tokens; special strings inside a text
are ordinary text; a literal marker (U+2581) is the same as a space, as in the
library; very long texts are counted whole, a text above ``GROUP_BYTES`` alone;
repeated rows are counted each; an empty table gives none; input columns named
``n_bytes`` or ``n_tokens`` are replaced. The store is emptied only between
groups of texts, so what a group needs is never dropped under it. Vocabularies
for which the proof fails are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.digests import utf8_len
from corpusloom.llm.piecemodels import MARK, joins, piece_bytes, settings
from corpusloom.llm.pretokens import Solved, groups, split
from corpusloom.llm.scratch import bounded
from corpusloom.llm.textcore import encode

#: Merged pre-tokens that a worker remembers.
CACHE = 400_000


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Proof(NamedTuple):
    """What was found of a vocabulary: a few MB at most."""

    #: Character that joins with nothing; None: counts may not be summed over pre-tokens.
    separator: str | None
    whole: frozenset[bytes]
    joined: np.ndarray


def prove(model_file: str) -> Proof:
    """Where texts may be cut, and the proven whole tokens (markers as spaces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = piece_bytes(sp)
    joined = joins(list(pieces.values()))
    lone = [c for c in "\n\x01\x02\t" if not joined[ord(c), :0x80].any() and not joined[ord(c), 0xC0:].any() and not joined[:, ord(c)].any()]
    # characters and white space must be kept as they are and one marker put in front
    shown = "".join(sp.encode("  a   b ", out_type=str)) == f"{MARK * 3}a{MARK * 3}b{MARK}"
    if not lone or not shown or not settings(model_file)[1]:
        return Proof(None, frozenset(), joined)
    forms = list(pieces.values())
    alone = sp.encode([lone[0] + p.decode() for p in forms], num_threads=1)
    bare = len(sp.encode(lone[0]))
    return Proof(lone[0], frozenset(p for p, ids in zip(forms, alone, strict=True) if len(ids) == bare + 1), joined)


class Counting:
    """Counts tokens in one worker."""

    def __init__(self, model_file: str, proof: Proof, cache: int = CACHE) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.proof = proof
        self.bare = len(self.sp.encode(proof.separator or ""))
        self.solved = Solved(self._merge, {p: np.array([1], np.int32) for p in proof.whole}, cache)

    def _merge(self, pretokens: list[bytes]) -> list[np.ndarray]:
        behind = self.sp.encode([self.proof.separator + p.decode("utf-8", "surrogatepass") for p in pretokens], num_threads=1)
        return list(np.array([[len(ids) - self.bare] for ids in behind], np.int32))

    def counts(self, texts: list[str]) -> list[int]:
        if self.proof.separator is None:
            return [len(ids) for ids in self.sp.encode(texts, num_threads=1)]
        raw, out = [encode(t) for t in texts], []
        for a, b in groups(raw):
            pretokens, begin = split(raw[a:b], self.proof.joined)
            counts, _ = self.solved.gather(self.solved.look_up(pretokens))
            total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            out += (total[begin[1:]] - total[begin[:-1]]).tolist()
        return out


def count_tokens(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens``; columns of these names are replaced."""
    spark = docs.sparkSession
    bounded(spark)
    proof = spark.sparkContext.broadcast(prove(tokenizer_path(model)))  # bounded by the vocabulary

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counting = Counting(tokenizer_path(model), proof.value)
        for batch in batches:
            yield pd.Series(counting.counts(batch.fillna("").tolist()), dtype="int64")

    counter = F.pandas_udf(run, "long")
    return docs.withColumns({"n_bytes": utf8_len(F.col(text)), "n_tokens": counter(F.col(text))})


def op2_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
