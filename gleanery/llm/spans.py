"""Substring dedup on sliding spans of sentences.

From every sentence a run is taken that goes on until it has ``MIN_SENTENCES``
sentences and ``MIN_WORDS`` words; it ends where the next run begins to
differ, so a passage that stands in two texts has equal runs wherever it
begins. Runs are hashed (128 bits, over their words with A-Z lowered) and
joined globally; the first occurrence, by document and place, stays and
sentences under any other are removed.

A sentence ends at a word that ends in . ! or ? (a closing quote or bracket
may follow), after a word that a hash chooses, one in eight, or with the text;
where this leaves a piece of over ``LONG`` words (one word over and over), it is
cut every ``STEP`` words. So a passage that begins or ends within a sentence, or
has no punctuation, is cut alike wherever it stands. A newline ends a sentence
as well, but no run ends there: a passage may be wrapped in one text and not in
the other. What stands between sentences belongs to the one before.

Edge cases: null or empty text has no sentences; texts without a long enough
run lose nothing; repeats within one text count; rows with one id are one
document, so rows that repeat a row lose nothing through each other; a null id
comes last; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import _bytes as B
from gleanery.llm._shared import NULL_ID, cut, cut_with, join_few, join_hot, maybe_in, row_keys

MIN_SENTENCES, MIN_WORDS, LONG, STEP = 2, 16, 24, 16
#: Words of the bitmap of hashes that occur more than once: 2 MB.
FILTER_WORDS = 2**18
_END, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_END[list(b".!?")] = True
_CLOSE[list(b"\"')]}")] = True
U = np.uint64


class Cut:
    """Sentences of a batch: word ranges [a, b) and, by text, first (one more entry than texts)."""

    def __init__(self, texts: pa.Array):
        self.data, self.at = B.buffer(texts)
        self.starts, ends, self.hashes, words = B.tokens(self.data, self.at, B.BY_SPACE)
        n = len(self.starts)
        if not n:
            self.a = self.b = np.zeros(0, np.int64)
            self.first = np.zeros(len(self.at), np.int64)
            return
        last = self.data[ends - 1]
        firm = _END[last] | (_CLOSE[last] & _END[self.data[np.maximum(ends - 2, 0)]] & (ends - self.starts > 1))
        firm |= (self.hashes & U(7)) == 0
        edges = words[1:]
        firm[edges[edges > 0] - 1] = True
        at = np.flatnonzero(firm)
        sizes = np.diff(at, prepend=-1)
        inside = np.arange(n) - np.repeat(at - sizes + 1, sizes)
        firm |= np.repeat(sizes > LONG, sizes) & (inside % STEP == STEP - 1)
        stop = firm.copy()
        lines = np.flatnonzero(self.data == 10)
        stop[:-1] |= np.searchsorted(lines, ends[:-1]) < np.searchsorted(lines, self.starts[1:])
        self.b = np.flatnonzero(stop) + 1
        self.a = np.concatenate([[0], self.b[:-1]])
        self.first = np.searchsorted(self.a, words)
        #: Where runs can end, and the sentence that ends there.
        self.ends = np.flatnonzero(firm) + 1
        self.last = np.searchsorted(self.b, self.ends)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run: first and last sentence, and two hashes of its words."""
        if not len(self.a):
            z = np.zeros(0, np.int64)
            return z, z, z, z
        i = np.arange(len(self.a))
        k = np.maximum(np.searchsorted(self.ends, self.a + MIN_WORDS), np.searchsorted(self.ends, self.a, "right") + MIN_SENTENCES - 1)
        j = np.append(self.last, len(self.a))[np.minimum(k, len(self.last))]
        i = i[j < np.repeat(self.first[1:], np.diff(self.first))]
        j = j[i]
        out = []
        power, inverse = B._power(len(self.hashes))
        for salt in (U(0), U(0xD6E8FEB86659FD93)):
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, U), np.cumsum(B.mix(self.hashes ^ salt) * power[: len(self.hashes)])])
                out.append(B.mix((total[self.b[j]] - total[self.a[i]]) * inverse[self.a[i]] + (self.b[j] - self.a[i]).astype(U)).view(np.int64))
        return i, j, *out

    def firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run: text, first and last sentence, hashes, and whether it is the first of its kind in its text."""
        i, j, h1, h2 = self.runs()
        doc = np.searchsorted(self.first, i, "right") - 1 if len(i) else i
        with np.errstate(over="ignore"):
            own = B.mix(h1.view(U) ^ B.mix(h2.view(U) + B.mix(doc.astype(U)))) if len(i) else i
        new = np.zeros(len(i), bool)
        new[np.unique(own, return_index=True)[1]] = True
        return doc, i, j, h1, h2, new


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text, one of each kind: a text's own repeats need no one else."""
    for whole in batches:
        for batch in B.pieces(whole, "text", B.CHUNK):
            c = Cut(batch.column("text"))
            doc, i, _, h1, h2, new = c.firsts()
            doc, i = doc[new], i[new]
            yield pa.RecordBatch.from_arrays([pa.array(B.ids(batch, "id")[doc]), pa.array(B.ids(batch, "row")[doc]), pa.array((i - c.first[doc]).astype(np.int32)), pa.array(h1[new]), pa.array(h2[new])], ["id", "row", "i", "h1", "h2"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in B.pieces(whole, "text", B.CHUNK):
            c = Cut(batch.column("text"))
            _, start, end, _, _, new = c.firsts()
            last_of = np.zeros(len(c.a) + 1, np.int64)
            last_of[start] = end
            drop = np.zeros(len(c.a) + 1, np.int32)
            np.add.at(drop, start[~new], 1)
            np.add.at(drop, end[~new] + 1, -1)
            starts = batch.column("starts")
            found = np.asarray(starts.flatten()).astype(np.int64) + np.repeat(c.first[:-1], np.asarray(starts.value_lengths().fill_null(0)))
            np.add.at(drop, found, 1)
            np.add.at(drop, last_of[found] + 1, -1)
            removed = np.cumsum(drop[:-1]) > 0
            raw = c.data.tobytes()
            n, gone, n_words, gone_words, texts = [], [], [], [], []
            for k in range(batch.num_rows):
                a, b, out = (x[c.first[k] : c.first[k + 1]] for x in (c.a, c.b, removed))
                lo, hi = int(c.at[k]), int(c.at[k + 1])
                begins = c.starts[a] if len(a) else a
                if out.any():
                    cuts = np.concatenate([[lo], begins[1:], [hi]])
                    texts.append(b"".join(raw[x:y] for x, y, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), out.tolist(), strict=True) if not z).decode())
                else:
                    texts.append(raw[lo:hi].decode())
                n.append(len(a))
                gone.append(int(out.sum()))
                n_words.append(int((b - a).sum()))
                gone_words.append(int((b - a)[out].sum()))
            values = [pa.array(x, pa.int64()) for x in (n, gone, n_words, gone_words)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *values, pa.array(texts, pa.string()), batch.column("first_ids")], ["id", "n_sentences", "n_removed", "n_words", "n_removed_words", "text", "first_ids"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row keys, starts (first sentences of runs that another text has first) and first_ids (who has them) of each such text."""
    rows = docs.select(*[c.alias(k.removeprefix("__gl_")) for k, c in row_keys(id_col, text_col).items()], F.col(text_col).alias("text"))
    runs = cut(rows.mapInArrow(_runs, "id long, row long, i int, h1 long, h2 long"), "runs")
    # most runs are unique: half of the hash tells, and only the others are brought together with their places;
    # partial aggregation leaves a row for each hash and task, however frequent a passage is
    often = runs.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1")
    runs, seen = cut_with(maybe_in(runs, often, ["h1"], FILTER_WORDS), "again", n=F.count(F.lit(1)))
    firsts = cut(runs.groupBy("h1", "h2").agg(F.min(F.struct("id", "i")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"), "firsts")
    again = join_hot(runs, firsts, ["h1", "h2"], seen["n"]).where((F.col("id") != F.col("first.id")) | (F.col("i") != F.col("first.i")))
    return again.groupBy(F.col("id").alias("__gl_id"), F.col("row").alias("__gl_row")).agg(F.sort_array(F.collect_set("i")).alias("starts"), F.sort_array(F.collect_set("first.id")).alias("first_ids"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_removed, n_words, n_removed_words, changed, first_ids (the documents that keep what was removed), text (what stays) of every row."""
    spans = cut(repeated_spans(docs, id_col, text_col), "spans")
    rows = docs.select(*[c.alias(k) for k, c in row_keys(id_col, text_col).items()], F.col(text_col).alias("text"))
    rows = join_few(rows, spans).select(F.col("__gl_id").alias("id"), "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"), F.coalesce("first_ids", F.array().cast("array<long>")).alias("first_ids"))
    out = rows.mapInArrow(_apply, "id long, n_sentences long, n_removed long, n_words long, n_removed_words long, text string, first_ids array<long>")
    shown = F.transform("first_ids", lambda x: F.when(x != NULL_ID, x))
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_sentences", "n_removed", "n_words", "n_removed_words", (F.col("n_removed") > 0).alias("changed"), shown.alias("first_ids"), "text")
