"""Operator 9: SentencePiece Unigram encoding and decoding.

Pieces stand in a double-array trie over their UTF-8 bytes. A text (spaces as
markers, one marker in front) is segmented so that the sum of its pieces' log
scores is largest; of equal sums the one found first, scanning starts from the
left, stays. A character that no piece covers costs ten less than the worst
piece and is written as byte pieces. Where no piece has two characters side by
side, none crosses from one to the other: segments between such places are
independent, so each distinct one is solved once and remembered in a bounded
store.

Decoding joins pieces, turns byte pieces into bytes (what is not UTF-8 becomes
U+FFFD), markers into spaces, and takes off the space put in front.

The vocabulary is a parameter: any SentencePiece model file. The scores of a
unigram model are log probabilities and are taken as they are. A merge model
has ranks in their place; tokenizers are not trained here, so its pieces get
the log probabilities of Zipf's law over those ranks (``zipf``).

Behaviour: null and empty texts have no tokens and decode to the empty text;
a literal marker (U+2581) is a space, so such texts don't round-trip; strings
of control pieces inside texts are ordinary text; very long texts are encoded
whole, one above ``GROUP_BYTES`` alone; repeated rows give a row each; a null
doc_id stays null; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.piecemodels import MARK, joins, piece_bytes, settings
from corpusloom.llm.pretokens import Solved, groups, split, take_slices
from corpusloom.llm.scratch import bounded
from corpusloom.llm.textcore import encode
from corpusloom.llm.token_counts import tokenizer_path

UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers, and the longest (in bytes) that are solved together.
CACHE, TOGETHER = 400_000, 96
#: Zipf's law: the piece of rank r (from 0) has a share of 1 / (r + ZIPF_SHIFT).
ZIPF_SHIFT = 2.7


class DoubleArray:
    """A static trie: from node ``s`` byte ``c`` leads to ``base[s] + c + 1`` if ``check`` there is ``s``; code 0 ends a key."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        rows = sorted(keys.items())
        size = 1024
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        free = 1
        todo = [(0, 0, len(rows), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            kids: list[tuple[int, int, int]] = []
            i = lo
            while i < hi:
                code = rows[i][0][depth] + 1 if len(rows[i][0]) > depth else 0
                j = i + 1
                while j < hi and (rows[j][0][depth] + 1 if len(rows[j][0]) > depth else 0) == code:
                    j += 1
                kids.append((code, i, j))
                i = j
            codes = np.array([k[0] for k in kids])
            at = max(1, free - int(codes[0]))
            while True:
                if at + 257 >= len(check):
                    grow = len(check)
                    base, check = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([check, np.full(grow, -1, np.int32)])
                if (check[at + codes] < 0).all():
                    break
                at += 1
            base[node] = at
            check[at + codes] = node
            while free < len(check) and check[free] >= 0:
                free += 1
            for code, a, b in kids:
                if code:
                    todo.append((at + code, a, b, depth + 1))
                else:
                    base[at] = -1 - rows[a][1]
        self.base, self.check = base, check


def zipf(ranks: np.ndarray) -> np.ndarray:
    """Log probabilities of Zipf's law, in single precision as model files have them."""
    share = 1 / (ranks + ZIPF_SHIFT)
    return np.log(share / share.sum()).astype(np.float32)


class Unigram:
    """A vocabulary with its trie; small enough to broadcast (a few MB)."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.vocab_size())
        pieces = piece_bytes(sp)
        plain = list(pieces)
        given = np.array([sp.get_score(i) for i in ids])
        self.score = given.astype(np.float64)
        if settings(model_file)[0] != 1:
            ranks = np.empty(len(plain))
            ranks[np.argsort(-given[plain], kind="stable")] = np.arange(len(plain))
            self.score[plain] = zipf(ranks)
        self.byte = [0] * 256
        bare: list[bytes] = []
        for i in ids:
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte[value] = i
                bare.append(bytes([value]))
            else:
                bare.append(b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode())
        #: Bytes of all pieces one after the other, and where each begins.
        self.bytes, self.begin = np.frombuffer(b"".join(bare), np.uint8), np.cumsum([0, *map(len, bare)])
        self.unknown = float(self.score[plain].min()) - UNKNOWN_PENALTY
        self.joined = joins(list(pieces.values()))
        self.trie = DoubleArray({p: i for i, p in pieces.items()})


class Coder:
    """Encodes and decodes in one worker."""

    def __init__(self, model: Unigram, cache: int = CACHE) -> None:
        self.m = model
        self.base, self.check, self.score = model.trie.base.tolist(), model.trie.check.tolist(), model.score.tolist()
        self.solved = Solved(self._solve, None, cache)

    def viterbi(self, raw: bytes) -> list[int]:
        """Piece ids of one segment, markers as spaces."""
        n, base, check, score, unknown = len(raw), self.base, self.check, self.score, self.m.unknown
        best, back, piece = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            first = raw[i]
            step = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, single = best[i], False
            s, j = 0, i
            while j < n:
                t = base[s] + raw[j] + 1
                if check[t] != s:
                    break
                s, j = t, j + 1
                end = base[s]
                if check[end] == s and base[end] < 0:
                    p = -1 - base[end]
                    value = here + score[p]
                    if best[j] is None or value > best[j]:
                        best[j], back[j], piece[j] = value, i, p
                    single = single or j - i == step
            if not single:
                j, value = i + step, here + unknown
                if best[j] is None or value > best[j]:
                    best[j], back[j], piece[j] = value, i, -1
            i += step
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.m.byte[b] for b in reversed(raw[back[n] : n]))
            n = back[n]
        return out[::-1]

    def viterbi_many(self, raws: list[bytes]) -> list[list[int]]:
        """The same for many short segments at once: all of them take each step through the trie together."""
        size = np.array([len(r) for r in raws])
        wide = int(size.max(initial=0))
        grid = np.zeros((len(raws), wide + 4), np.uint8)
        grid[np.arange(wide + 4)[None, :] < size[:, None]] = np.frombuffer(b"".join(raws), np.uint8)
        base, check, score = self.m.trie.base, self.m.trie.check, self.m.score
        best = np.full((len(raws), wide + 5), -np.inf)
        back, piece = np.zeros(best.shape, np.int32), np.full(best.shape, -1, np.int32)
        best[:, 0] = 0.0
        for i in range(wide):
            first = grid[:, i]
            begun = np.flatnonzero((size > i) & ((first & 0xC0) != 0x80))
            if not len(begun):
                continue
            step = np.array([1, 2, 3, 4])[(first >= 0xC0).astype(int) + (first >= 0xE0) + (first >= 0xF0)]
            single = np.zeros(len(raws), bool)
            live, s, j = begun, np.zeros(len(begun), np.int64), i
            while len(live):
                t = base[s] + grid[live, j].astype(np.int64) + 1
                ok = check[t] == s
                live, s, j = live[ok], t[ok], j + 1
                end = base[s]
                done = (check[end] == s) & (base[end] < 0)
                who, p = live[done], -1 - base[end[done]]
                value = best[who, i] + score[p]
                up = value > best[who, j]
                best[who[up], j], back[who[up], j], piece[who[up], j] = value[up], i, p[up]
                single[who] |= step[who] == j - i
                more = size[live] > j
                live, s = live[more], s[more]
            bare = begun[~single[begun]]
            to = i + step[bare]
            value = best[bare, i] + self.m.unknown
            up = value > best[bare, to]
            bare, to = bare[up], to[up]
            best[bare, to], back[bare, to], piece[bare, to] = value[up], i, -1
        out = []
        for raw, b, p in zip(raws, back.tolist(), piece.tolist(), strict=True):
            n, ids = len(raw), []
            while n:
                if p[n] >= 0:
                    ids.append(p[n])
                else:
                    ids.extend(self.m.byte[c] for c in reversed(raw[b[n] : n]))
                n = b[n]
            out.append(ids[::-1])
        return out

    def _solve(self, segments: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(segments)
        order = sorted(range(len(segments)), key=lambda k: len(segments[k]))
        short = [k for k in order if len(segments[k]) <= TOGETHER]
        for at in range(0, len(short), 4096):  # of about one length each
            group = short[at : at + 4096]
            for k, ids in zip(group, self.viterbi_many([segments[k] for k in group]), strict=True):
                out[k] = np.array(ids, np.int32)
        for k in order[len(short) :]:
            out[k] = np.array(self.viterbi(segments[k]), np.int32)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([encode(text)])[0].tolist()

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after the other, and where each text's begin (one more than texts)."""
        segments, begin = split(texts, self.m.joined)
        ids, at = self.solved.gather(self.solved.look_up(segments))
        return ids, at[begin]

    def decode_many(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """The bytes of each slice of ids, without the space put in front."""
        raw, at = take_slices(self.m.bytes, self.m.begin, ids)
        flat, ends = raw.tobytes(), at[begin].tolist()
        return [flat[a + (flat[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


class _Shared:
    """A broadcast with a number that workers can know it by."""

    def __init__(self, sent) -> None:
        self.sent, self.id = sent, uuid.uuid4().int

    @property
    def value(self) -> Unigram:
        return self.sent.value


def encode_texts(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, input_ids, ids_sha256, round_trip)``, a row per input row."""
    spark = docs.sparkSession
    bounded(spark)
    shared = _Shared(spark.sparkContext.broadcast(Unigram(model_file or tokenizer_path())))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)  # of this task: what it remembers must not stay in a worker that other operators use next
        for b in batches:
            raw = [encode(t) for t in b.column(1).to_pylist()]
            for first, last in groups(raw):
                texts = raw[first:last]
                ids, begin = coder.encode_many(texts)
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids, pa.int32()))
                little = ids.astype("<i4")
                sha = [hashlib.sha256(little[a:z]).hexdigest() for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                same = [x == y for x, y in zip(coder.decode_many(ids, begin), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[first:last], pa.array(np.diff(begin), pa.int64()), lists, pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "input_ids", "ids_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, input_ids array<int>, ids_sha256 string, round_trip boolean")


def decode_ids(rows: DataFrame, model_file: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, input_ids)``; null ids decode to the empty text."""
    spark = rows.sparkSession
    bounded(spark)
    shared = _Shared(spark.sparkContext.broadcast(Unigram(model_file or tokenizer_path())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("input_ids")).mapInArrow(run, "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "round_trip")
