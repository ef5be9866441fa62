"""Sentences, times, delivery, quotations and coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import rounded, upper_median
from corpusloom.functions.text import SPACE_RE2, numbered, seconds_of, sentences, timecode
from corpusloom.plans.catalogue import Catalogue, table

TRANSCRIPT = Catalogue()
#: Pairs of quotation and text whose subsequences are measured at once (they stay in cache).
PAIRS = 16_384
_SPLIT = r"""string_split(regexp_replace(text, '(\.\.[.!?])\s+|([.!?])["'')\]]*\s+(["''(\[]*[A-Z0-9])', '\1\2' || chr(1) || '\3', 'g'), chr(1))"""


_WORDS = rf"list_filter(regexp_split_to_array(x, '{SPACE_RE2}'), lambda w: w <> '')"
#: A piece in chunks that pass 240 characters: what is done, the open line, its length.
_CHUNKS = f"""list_transform([list_reduce(list_transform({_WORDS}, lambda w: {{'d': []::VARCHAR[], 'o': w, 'n': 0::BIGINT}}), lambda s, w: CASE WHEN s.n + length(w.o) + 1 > 240
    THEN {{'d': list_append(s.d, CASE WHEN s.o = '' THEN w.o ELSE s.o || ' ' || w.o END), 'o': '', 'n': 0::BIGINT}}
    ELSE {{'d': s.d, 'o': CASE WHEN s.o = '' THEN w.o ELSE s.o || ' ' || w.o END, 'n': s.n + length(w.o) + 1}} END, {{'d': []::VARCHAR[], 'o': '', 'n': 0::BIGINT}})], lambda s: CASE WHEN s.o = '' THEN s.d ELSE list_append(s.d, s.o) END)[1]"""


@TRANSCRIPT.query(
    "sentences",
    f"SELECT doc_id, CAST(i AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, flatten(list_transform(list_filter(list_transform({_SPLIT}, lambda x: trim(x)), lambda x: x <> ''), lambda x: CASE WHEN length(x) <= 320 THEN [x] ELSE {_CHUNKS} END)) AS s FROM documents))",
)
def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(sentences("text")).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).alias("pos"), "sentence")


def times(segments: DataFrame, key: str, pos: str, text: str, duration: float) -> DataFrame:
    """Start and end of each segment, by its share of all characters."""
    w = Window.partitionBy(key)
    before = w.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(text)
    total, run = F.sum(n).over(w), F.coalesce(F.sum(n).over(before), F.lit(0))
    return segments.withColumns({"start": rounded(run / F.greatest(total, F.lit(1)) * duration, 2), "end": rounded((run + n) / F.greatest(total, F.lit(1)) * duration, 2)})


@TRANSCRIPT.query(
    "sentence_times",
    "SELECT conv_id, turn, round_even(r / greatest(t, 1) * 600.0 * 100.0, 0) / 100.0 AS start, round_even((r + n) / greatest(t, 1) * 600.0 * 100.0, 0) / 100.0 AS \"end\" FROM (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id)::DOUBLE AS t, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS r FROM conversations)",
)
def q_times(spark: SparkSession, d: str) -> DataFrame:
    return times(table(spark, d, "conversations"), "conv_id", "turn", "text", 600.0).select("conv_id", "turn", "start", "end")


@TRANSCRIPT.query("timecodes", "SELECT event_id, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS code FROM (SELECT event_id, greatest(floor(value * 37), 0)::BIGINT AS s FROM events)")
def q_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", timecode(F.col("value") * 37).alias("code"))


@TRANSCRIPT.query(
    "delivery_stats",
    "WITH g AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), m AS (SELECT user_id, list_sort(list(t - p)) AS a, count(*) AS n, max(t - p) AS longest FROM g WHERE p IS NOT NULL GROUP BY 1) SELECT user_id, n AS gaps, a[len(a) // 2 + 1] AS median_gap, longest FROM m WHERE n >= 2",
)
def q_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between segments: their number, upper median and longest."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    gaps = e.withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap IS NOT NULL")
    return gaps.groupBy("user_id").agg(F.count("*").alias("gaps"), upper_median(F.collect_list("gap")).alias("median_gap"), F.max("gap").alias("longest")).where("gaps >= 2")


@TRANSCRIPT.query("coverage_audit", "SELECT d.doc_id, n_chars, coalesce(quality * 100 + toxic, n_chars) AS covered FROM documents d LEFT JOIN labels l USING (doc_id) WHERE n_chars > 120 AND coalesce(quality * 100 + toxic, n_chars) < 0.9 * n_chars")
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Long recordings whose transcript covers less than nine tenths."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("covered", F.coalesce(F.col("quality") * 100 + F.col("toxic"), "n_chars").cast("long"))
    return j.where("n_chars > 120 AND covered < 0.9 * n_chars").select("doc_id", "n_chars", "covered")


@TRANSCRIPT.query("residue_words", r"SELECT conv_id, sum(CASE WHEN regexp_matches(lower(trim(text)), '^(thank you|thanks|okay|ok)[.!]*$') THEN 0 ELSE len(regexp_extract_all(text, '\S+')) END)::BIGINT AS words FROM conversations GROUP BY 1")
def q_residue(spark: SparkSession, d: str) -> DataFrame:
    """Words of segments that are more than filler."""
    filler = F.lower(F.trim("text")).rlike(r"^(thank you|thanks|okay|ok)[.!]*$")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(filler, 0).otherwise(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)))).alias("words"))


@TRANSCRIPT.query("citation_prune", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS kept, count(*) AS n FROM events SEMI JOIN documents ON doc_id = event_id % 300 GROUP BY 1")
def q_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations that name an existing sentence."""
    known = table(spark, d, "documents").select(F.col("doc_id").alias("cited"))
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 300).alias("cited")).join(known, "cited", "left_semi")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("kept"), F.count("*").alias("n"))


@TRANSCRIPT.query("claim_evidence", "SELECT a.conv_id, a.turn, string_agg(CAST(b.turn AS VARCHAR), ',' ORDER BY b.turn) AS span, sum(length(b.text))::BIGINT AS chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'user' GROUP BY 1, 2")
def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each claim with the sentences around it, as a range join within the recording."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn")
    near = a.select("conv_id", "turn", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("t"))  # the range as an equi-join
    j = near.join(c.select("conv_id", F.col("turn").alias("t"), F.length("text").alias("n")), ["conv_id", "t"])
    return j.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list("t")).cast("array<string>"), ",").alias("span"), F.sum("n").alias("chars"))


def exact_quotes(quotes: DataFrame, docs: DataFrame, least: int = 12) -> DataFrame:
    """``(item_id, doc_id)``: whole quotations of ``least`` characters or more that stand in a text. One automaton over all quotations (a bounded list) reads every text once."""
    known = [(r["item_id"], r["text"]) for r in quotes.where(F.length("text") >= least).select("item_id", "text").collect()]

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for item, quote in known:
            machine.add_word(quote, [*machine.get(quote, []), item])
        if known:
            machine.make_automaton()
        for b in batches:
            rows = [(item, doc) for doc, text in zip(b["doc_id"], b["text"], strict=True) if text and known for item in {i for _, ids in machine.iter(text) for i in ids}]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id"])

    return docs.select("doc_id", "text").mapInPandas(run, f"item_id {quotes.schema['item_id'].dataType.simpleString()}, doc_id long")


@TRANSCRIPT.query("quote_exact", "SELECT b.item_id, count(*) AS n, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) >= 12 GROUP BY 1")
def q_quote(spark: SparkSession, d: str) -> DataFrame:
    """Whole quotations found verbatim."""
    return exact_quotes(table(spark, d, "benchmark"), table(spark, d, "documents")).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@TRANSCRIPT.query("numbered_transcript", "SELECT conv_id, string_agg('[S' || printf('%03d', turn) || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def q_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as numbered lines; one conversation fits a row."""
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", "text").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.array_join(numbered("t", lambda t: F.format_string("S%03d", t["turn"]), lambda t: t["text"]), "\n").alias("transcript"))


class _Quotes:
    """Quotations prepared once for comparison with many texts."""

    def __init__(self, quotes: list[tuple[int, str]]) -> None:
        self.quotes, self.matchers = quotes, {}
        self.size = np.array([len(q) for _, q in quotes], np.int64)
        owner = np.repeat(np.arange(len(quotes)), self.size)
        codes = _codes([q for _, q in quotes])
        self.held = np.bincount(owner * 64 + codes % 64, minlength=64 * len(quotes)).reshape(-1, 64).astype(np.int32)
        # places of each character in each quotation, 64 to a word
        self.letters, letter = np.unique(codes, return_inverse=True)
        self.width = len(self.letters) + 1  # the last one: in no quotation
        self.words = -(-self.size // 64)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.masks = np.zeros((max(self.words, default=0), len(quotes) * self.width), np.uint64)
        np.bitwise_or.at(self.masks, (place // 64, owner * self.width + letter), np.uint64(1) << (place % 64).astype(np.uint64))

    def letter_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.letters, codes)
        return np.where(self.letters[np.minimum(at, self.width - 2)] == codes, at, self.width - 1) if self.width > 1 else np.zeros(len(codes), np.int64)

    def in_order(self, j: np.ndarray, start: np.ndarray, n: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of quotation ``j`` and the ``n`` letters from ``start``, for many pairs at once (bits)."""
        out = np.zeros(len(j), np.int64)
        for words in np.unique(self.words[j]):
            own = np.flatnonzero(self.words[j] == words)
            own = own[np.argsort(-n[own], kind="stable")]
            for block in (own[k : k + PAIRS] for k in range(0, len(own), PAIRS)):
                rows = np.full((words, len(block)), ~np.uint64(0))
                begin, base, ends = start[block], j[block] * self.width, n[block][::-1]
                for i in range(n[block[0]]):
                    live = len(block) - int(np.searchsorted(ends, i, "right"))  # pairs whose text goes on
                    at, carry = base[:live] + letters[begin[:live] + i], None
                    for w in range(words):
                        row = rows[w, :live]
                        both = row & self.masks[w].take(at)
                        total = row + both
                        over = total < row
                        if carry is not None:
                            total += carry
                            over |= total < carry
                        row ^= both
                        row |= total
                        carry = over.astype(np.uint64)
                out[block] = 64 * words - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)
        return out

    def similar(self, texts: list[str], least: float) -> list[tuple[int, int, float]]:
        from difflib import SequenceMatcher

        if not self.quotes or not texts:
            return []
        texts_by_size = np.argsort([len(t) for t in texts], kind="stable")
        sorted_texts = [texts[k] for k in texts_by_size]
        n = np.array([len(t) for t in sorted_texts], np.int64)
        codes, begin = _codes(sorted_texts), np.cumsum(n) - n
        held = np.bincount(codes % 64 * len(n) + np.repeat(np.arange(len(n)), n), minlength=64 * len(n)).reshape(64, -1).astype(np.int32)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for j, size in enumerate(self.size):
            need = least * (size + n) - 1e-6  # twice the characters that must match
            able = np.flatnonzero(2 * np.minimum(size, n) >= need)
            if len(able):
                lo, hi = able[0], able[-1] + 1  # lengths near the quotation's, side by side
                common = np.zeros(hi - lo, np.int32)
                for c in np.flatnonzero(self.held[j]):
                    common += np.minimum(held[c, lo:hi], self.held[j, c])
                k = lo + np.flatnonzero(2 * common >= need[lo:hi])
                pairs.append((k, np.full(len(k), j)))
        if not pairs:
            return []
        k, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        good = 2 * self.in_order(j, begin[k], n[k], self.letter_of(codes)) >= least * (self.size[j] + n[k]) - 1e-6
        out: list[tuple[int, int, float]] = []
        for k, j in sorted(zip(texts_by_size[k[good]].tolist(), j[good].tolist(), strict=True)):
            if j not in self.matchers:
                self.matchers[j] = SequenceMatcher(None, "", self.quotes[j][1])
            self.matchers[j].set_seq1(texts[k])
            ratio = self.matchers[j].ratio()
            if ratio >= least:
                out.append((self.quotes[j][0], k, ratio))
        return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def similar_quotes(quotes: list[tuple[int, str]], texts: list[str], least: float) -> list[tuple[int, int, float]]:
    """``(item, place in texts, ratio)`` of all pairs whose Ratcliff-Obershelp ratio is at least ``least``.

    Matched characters are no more than the shorter length, than the characters
    in common, and than the longest common subsequence; only pairs that one of
    these excludes are not compared.
    """
    return _Quotes(quotes).similar(texts, least)


def fuzzy_quotes(quotes: DataFrame, docs: DataFrame, least: float = 0.75) -> DataFrame:
    """``(item_id, ratio, doc_id)``: best ratio of each whole quotation with any sentence, and the first document with one that reaches ``least``."""
    known = [(r["item_id"], r["text"]) for r in quotes.select("item_id", "text").where("text IS NOT NULL").collect()]  # a bounded list

    def run(batches):
        prepared = _Quotes(known)
        for b in batches:
            found = prepared.similar(b["sentence"].tolist(), least)
            doc = b["doc_id"].to_numpy()
            yield pd.DataFrame({"item_id": pd.Series([f[0] for f in found], dtype=items), "ratio": pd.Series([f[2] for f in found], dtype=float), "doc_id": pd.Series([doc[f[1]] for f in found], dtype="int64")})

    kind = quotes.schema["item_id"].dataType.simpleString()
    items = "object" if kind == "string" else "int64"
    each = docs.select("doc_id", F.explode(sentences("text")).alias("sentence")).groupBy("sentence").agg(F.min("doc_id").alias("doc_id"))
    each = each.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work
    pairs = each.mapInPandas(run, f"item_id {kind}, ratio double, doc_id long")
    return pairs.groupBy("item_id").agg(F.max("ratio").alias("ratio"), F.min("doc_id").alias("doc_id"))


@TRANSCRIPT.query("quote_fuzzy")
def q_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Ratcliff-Obershelp similarity of whole quotations with every sentence."""
    return fuzzy_quotes(table(spark, d, "benchmark"), table(spark, d, "documents"))


@TRANSCRIPT.query("timestamp_error", "WITH x AS (SELECT event_type, abs((event_id % 3600 // 60) * 60 + event_id % 60 - (event_id * 7) % 3600) AS e FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (e <= 30) AS near, list_sort(list(e))[count(*) // 2 + 1] AS median FROM x GROUP BY 1")
def q_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stated times against true ones: within half a minute, upper median of the error."""
    stamp = F.format_string("%d:%02d", F.floor(F.col("event_id") % 3600 / 60).cast("long"), F.col("event_id") % 60)
    x = table(spark, d, "events").select("event_type", F.abs(seconds_of(stamp) - (F.col("event_id") * 7) % 3600).alias("e"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("e") <= 30).alias("near"), upper_median(F.collect_list("e")).alias("median"))
