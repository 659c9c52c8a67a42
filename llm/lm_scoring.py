"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model with absolute discounting that backs off to discounted unigrams and these to an even share for the
unknown: P1(w) = (max(c(w) - d, 0) + d V / (V + 1)) / N; for a kept bigram P(w | h) = (c(h w) - d) / c(h) + b(h) P1(w), and else
P(w | h) = b(h) P1(w), where b(h) is the mass that h's kept bigrams leave.  As an automaton: the root and every training token
are states; a state has an arc for each bigram, and a failure arc to the root weighted b(h); the root has an arc for each token.  A
text is one traversal from left to right, from the state of the sentence end, that carries the state and adds the logarithms of
the arcs taken.

All counts are exact and cover all training documents.  Rows of equal doc_id and text are combined first.  Documents are dealt to
chunks of about `chunk_tokens`, in a table bucketed by chunk, so that texts move no more; a chunk asks for its
distinct words and bigrams only (the map-side combine of the counts) and is answered by the partitions that hold the totals: bigrams go
where their history's count goes, so that its failure weight is settled there and travels with the count; then the chunk
compiles the part of the automaton that its texts can reach.  The bigrams of a frequent history would meet in one task: they go by
their own hash instead, and what they take of the history's mass is summed up over the partitions.  Which histories count as frequent
is seen in a 64th of the documents; it decides where counts meet, not what they are.  No task holds the model; what moves is bounded by
the chunks' distinct n-grams.  What every task is given is the numbers of the training tokens and words, and a number for each frequent
history, of which there are `frequent` at most and 4 for each partition.

Tokens are words of lower-cased (A-Z) text and one end for each text, named by 64-bit hashes.

Defined results: null or empty text is one end; a document without id is in training; with nothing to train on, every token has the
same share; repeated rows count and are scored each, alike; a very long text is scored whole, in one chunk; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import U64, SpanHash, dealt, importable, materialize, mix, partitions, row_names, text_slices, word_spans
from llm.simhash_dedup import UPPER

END = mix(np.array([0x454E44], U64))[0]
_A, _B = mix(np.array([11, 12], U64)) | U64(1)


@dataclass(frozen=True)
class Parameters:
    discount: float = 0.5
    chunk_tokens: int = 1_000_000
    #: Most histories whose bigrams are dealt by themselves; below 2 ** 15.
    frequent: int = 16_384
    #: One document of so many is looked into for them.
    sampled: int = 64


@dataclass(frozen=True)
class Corpus:
    """What training texts have in all."""

    tokens: int
    words: int


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the tokens, each row's end after its words."""
    n = len(offsets) - 1
    buf = UPPER[buf]
    starts, ends, rows = word_spans(buf, offsets)
    words = SpanHash(buf)(starts, ends)
    at = np.arange(len(words)) + rows  # one end before for each earlier row
    out, row = np.full(len(words) + n, END, U64), np.empty(len(words) + n, np.int64)
    out[at] = words
    row[at] = rows
    row[np.cumsum(np.bincount(rows, minlength=n) + 1) - 1] = np.arange(n)
    return out, row


def pairs(number: np.ndarray, rows: np.ndarray, end: int, size: int) -> np.ndarray:
    """Each token after the one before it, as history * size + token; a row begins after an end."""
    before = np.concatenate([[end], number[:-1]])
    before[np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))] = end
    return before * size + number


def _by_bucket(names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, cuts) of sorted names."""
    bucket = ((names >> U64(40)) * U64(n) >> U64(24)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    return bucket[cuts[:-1]], cuts


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    """How often each row counts in training."""
    return np.where(batch.column("trained").to_numpy(zero_copy_only=False), batch.column("copies").to_numpy(zero_copy_only=False), 0)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of tokens, and of training tokens, of each batch."""
    for batch in batches:
        own, total, trained = _weights(batch), 0, 0
        for first, last, buf, offsets in text_slices(batch, "text"):
            _, _, rows = word_spans(buf, offsets)
            total += len(rows) + last - first
            trained += int(own[first:last][rows].sum() + own[first:last].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([trained], pa.int64())], names=["tokens", "trained"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and how often each stands in a slice; all of them under null."""
    for batch in batches:
        for _, _, buf, offsets in text_slices(batch, "text"):
            names, counts = np.unique(tokens(buf, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*names.view(np.int64).tolist(), None], pa.int64()), pa.array([*counts.tolist(), int(counts.sum())], pa.int64())], names=["name", "n"])


def frequent_words(docs: DataFrame, p: Parameters, n: int) -> np.ndarray:
    """Sorted names of the tokens that have more than a quarter of a partition's share in a sample of the documents."""
    some = docs.where(F.pmod(F.xxhash64("id", "tie"), F.lit(p.sampled)) == 0).select("text").mapInArrow(_word_counts, "name long, n long")
    top = some.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(p.frequent + 1).collect()  # null first: it has all
    if not top:
        return np.zeros(0, U64)
    return np.sort(np.array([r.name for r in top[1:] if r.n * 4 * n > top[0].n], np.int64).view(U64))


def _places(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word among the frequent ones, or -1."""
    at = np.minimum(np.searchsorted(hot, words), max(len(hot) - 1, 0))
    return np.where(hot[at] == words, at, -1).astype(np.int16) if len(hot) else np.full(len(words), -1, np.int16)


REQUEST = "bucket int, chunk long, names binary, counts binary, sizes binary, pairs binary, pair_counts binary, hot binary"


def _ask(n: int, hot: np.ndarray):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """What a chunk has: distinct words and the bigrams after each, with counts in training texts, packed for each partition."""
        parts = []
        for batch in table.to_batches():
            own = _weights(batch)
            for first, _, buf, offsets in text_slices(batch, "text"):
                hashes, rows = tokens(buf, offsets)
                parts.append((hashes, rows, own[first:][rows]))
        own = np.concatenate([x[2] for x in parts])
        words, number = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        counts = np.bincount(number, weights=own, minlength=len(words)).astype(np.int64)
        both = _numbered([x[:2] for x in parts], words, number)
        keys, of = np.unique(both, return_inverse=True)
        pair_counts = np.bincount(of, weights=own, minlength=len(keys)).astype(np.int64)
        history, token = np.divmod(keys, len(words))
        named, whose = mix(words[history] * _A + words[token] * _B), _places(hot, words)[history]
        rest = whose < 0
        sizes = np.bincount(history[rest], minlength=len(words)).astype(np.int32)
        bucket, cuts = _by_bucket(words, n)
        pair_cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[cuts]
        rows = [bucket, _blobs(words, cuts), _blobs(counts, cuts), _blobs(sizes, cuts), _blobs(named[rest], pair_cuts), _blobs(pair_counts[rest], pair_cuts), _blobs(whose[:0], cuts * 0)]
        own = _by_name(named[~rest])
        bucket, cuts = _by_bucket(named[~rest][own], n)
        none = _blobs(words[:0], cuts * 0)
        more = [bucket, none, none, none, *(_blobs(x[~rest][own], cuts) for x in (named, pair_counts, whose))]
        return pa.concat_tables([pa.table([pa.array(b.astype(np.int32)), pa.array([key[0].as_py()] * len(b), pa.int64()), *blobs], names=[c.split()[0] for c in REQUEST.split(", ")]) for b, *blobs in (rows, more)])

    return run


def _by_name(names: np.ndarray) -> np.ndarray:
    """The order in which a chunk asks for the bigrams of frequent histories, and is answered."""
    return np.argsort(names, kind="stable")


def _numbered(parts: list[tuple], words: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The pairs of a chunk's texts in order; parts: (hashes, rows) of slices, number: of all their tokens among the sorted words."""
    end, at, out = int(np.searchsorted(words, END)), 0, []
    for hashes, rows in parts:
        out.append(pairs(number[at : at + len(hashes)], rows, end, len(words)))
        at += len(hashes)
    return np.concatenate(out)


#: Counts come in the order of the names that were asked for: a chunk knows these, so names do not travel back.
ANSWER = "chunk long, bucket int, counts binary, takes binary, pair_counts binary"
TOTALS, TAKES = -1, -2  #: The chunks under which a partition sends the number of its training words, and what frequent histories' bigrams take.


def _answer(p: Parameters, n: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition's share of the names: totals and what a history's bigrams take, back to each chunk that asked for them."""
        asked = []
        for batch in batches:
            for bucket, chunk, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "names", "counts", "sizes", "pairs", "pair_counts", "hot"))):
                asked.append((bucket, chunk, *(np.frombuffer(x, t) for x, t in zip(blobs, (U64, np.int64, np.int32, U64, np.int64, np.int16)))))
        hot, asked = [x for x in asked if len(x[7])], [x for x in asked if not len(x[7])]
        if hot:
            totals, order, start, back = _totals(hot)
            whose = np.concatenate([x[7] for x in hot])[order[start]]
            yield _row(TAKES, 0, totals[:0], np.bincount(whose, weights=_taken(totals, p), minlength=frequent), totals[:0])
            at = 0
            for bucket, chunk, *_, own_pairs, _, _ in hot:
                yield _row(chunk, bucket + n, totals[:0], totals[:0].astype(float), back[at : at + len(own_pairs)])
                at += len(own_pairs)
        if not asked:
            return
        names, of = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
        of = of.astype(np.int32)
        total = np.bincount(of, weights=np.concatenate([x[3] for x in asked]), minlength=len(names)).astype(np.int64)
        history = np.repeat(of, np.concatenate([x[4] for x in asked]))
        totals, order, start, pair_total = _totals(asked)
        takes = np.bincount(history[order[start]], weights=_taken(totals, p), minlength=len(names))
        del history, order
        yield _row(TOTALS, 0, np.array([np.count_nonzero(total)]), takes[:0], totals[:0])
        at = pair_at = 0
        for bucket, chunk, own, _, _, own_pairs, _, _ in asked:
            mine = of[at : at + len(own)]
            yield _row(chunk, bucket, total[mine], takes[mine], pair_total[pair_at : pair_at + len(own_pairs)])
            at += len(own)
            pair_at += len(own_pairs)

    return run


def _totals(asked: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of requests: the totals of distinct bigrams, the order by name, where each begins in it, and the total of each that was asked for."""
    keys = np.concatenate([x[5] for x in asked])
    order = np.argsort(keys)
    keys = keys[order]
    start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])[: len(keys)]
    size = np.diff(np.append(start, len(keys)))
    del keys
    totals = np.add.reduceat(np.concatenate([x[6] for x in asked])[order], start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(totals, size)
    return totals, order, start, back


def _taken(totals: np.ndarray, p: Parameters) -> np.ndarray:
    return np.where(totals > 0, totals - p.discount, 0)


def _takes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("takes").to_pylist():
            takes = np.frombuffer(x, np.float64)
            at = np.flatnonzero(takes)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(takes[at])], names=["place", "take"])


def _row(chunk: int, bucket: int, *blobs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=[c.split()[0] for c in ANSWER.split(", ")])


class Automaton:
    """States and tokens are numbers of a chunk's vocabulary; a word that training texts do not have has no arcs and all its mass
    left, as the root."""

    def __init__(self, known: Corpus, count: np.ndarray, takes: np.ndarray, p: Parameters):
        d = p.discount
        share = d * known.words / (known.words + 1) if known.words else 1.0
        self.p, self.size, self.count = p, len(count), np.maximum(count, 1)
        self.base = (np.maximum(count - d, 0) + share) / max(known.tokens, 1)
        self.left = np.where(count > 0, np.maximum(1 - takes / self.count, 1e-12), 1.0)
        self.fail, self.unigram = np.log10(self.left), np.log10(self.base)

    def compile(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The log10 weight of each step, named state * size + token: that of the bigram's arc, or without one (count 0) those of the
        failure arc and of the root's."""
        state, token = np.divmod(keys, self.size)
        weights, arc = self.fail[state] + self.unigram[token], np.flatnonzero(count > 0)
        state, token = state[arc], token[arc]
        weights[arc] = np.log10((count[arc] - self.p.discount) / self.count[state] + self.left[state] * self.base[token])
        return weights

    @staticmethod
    def score(weights: np.ndarray, steps: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of log10 probabilities of n texts: the state after a token is that token, so the steps (places among the compiled ones) of
        all texts are known at once, and each text's weights are added from left to right."""
        return np.bincount(rows, weights=weights[steps], minlength=n)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(p: Parameters, known: Corpus, buckets: int, hot: np.ndarray, hot_takes: np.ndarray):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        fields = [*(c.split()[0] for c in SCHEMA.split(", ")), "copies"]
        rows_of = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "counts", "takes", "pair_counts"))), key=lambda r: r[0])
        own = [r for r in rows_of if r[0] < buckets]
        count, takes, seen = (np.frombuffer(b"".join(r[i] for r in own), t) for i, t in ((1, np.int64), (2, np.float64), (3, np.int64)))
        seen_hot = np.frombuffer(b"".join(r[3] for r in rows_of if r[0] >= buckets), np.int64)
        parts = [(batch.slice(first, last - first), *tokens(buf, offsets)) for batch in docs.to_batches() for first, last, buf, offsets in text_slices(batch, "text")]
        out = []
        if parts:
            vocabulary, number = np.unique(np.concatenate([x[1] for x in parts]), return_inverse=True)
            place = _places(hot, vocabulary)
            takes = np.where(place < 0, takes, hot_takes[place] if len(hot) else 0.0)
            machine = Automaton(known, count, takes, p)
            keys, steps = np.unique(_numbered([x[1:] for x in parts], vocabulary, number), return_inverse=True)
            history, token = np.divmod(keys, len(vocabulary))
            at = np.flatnonzero(place[history] >= 0)
            full = np.empty(len(keys), np.int64)
            full[place[history] < 0] = seen
            full[at[_by_name(mix(vocabulary[history[at]] * _A + vocabulary[token[at]] * _B))]] = seen_hot
            weights = machine.compile(keys, full)
            base = np.log10((count + 1) / (known.tokens + known.words + 1))
            at = 0
            for batch, hashes, rows in parts:
                own = slice(at, at + len(hashes))
                at += len(hashes)
                n, mine = batch.num_rows, number[own]
                score = machine.score(weights, steps[own], rows, n)
                sums = [np.bincount(rows, weights=w, minlength=n) for w in (count[mine] > 0, base[mine])]
                out.append(pa.table([batch.column("doc_id"), pc.invert(batch.column("trained")), pa.array(np.bincount(rows, minlength=n)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, known.tokens)), pa.array(sums[1]), pa.array(score, pa.float64()), batch.column("copies")], names=fields))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], names=fields)

    return run


def score_documents(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    importable(documents.sparkSession)
    n = partitions(documents.sparkSession)
    trained = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    docs = documents.select(*row_names(), F.col("doc_id").cast("long").alias("doc_id"), "text", trained.alias("trained"))
    size = docs.select("text", "trained", F.lit(1).cast("long").alias("copies")).mapInArrow(_lengths, "tokens long, trained long").agg(F.sum("tokens"), F.sum("trained")).first()
    chunks = 1 + (size[0] or 0) // p.chunk_tokens
    single = docs.groupBy("id", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("trained").alias("trained"), F.count("*").alias("copies"))
    rows = dealt(single.select(F.pmod(F.xxhash64("id", "tie"), F.lit(chunks)).alias("chunk"), "doc_id", "text", "trained", "copies"), "chunks", "chunk")
    hot = frequent_words(docs, p, n)
    asked = rows.groupBy("chunk").applyInArrow(_ask(n, hot), REQUEST)
    answers = materialize(asked.repartitionById(n, "bucket").mapInArrow(_answer(p, n, len(hot)), ANSWER), "answers")
    hot_takes = np.zeros(len(hot))
    for r in answers.where(F.col("chunk") == TAKES).select("takes").mapInArrow(_takes, "place int, take double").groupBy("place").agg(F.sum("take").alias("take")).collect() if len(hot) else []:
        hot_takes[r.place] = r.take
    words = sum(int(np.frombuffer(r.counts, np.int64)[0]) for r in answers.where(F.col("chunk") == TOTALS).select("counts").collect())
    done = rows.groupBy("chunk").cogroup(answers.where(F.col("chunk") >= 0).groupBy("chunk")).applyInArrow(_score(p, Corpus(size[1] or 0, words), n, hot, hot_takes), SCHEMA + ", copies long")
    return done.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy", "copies")
