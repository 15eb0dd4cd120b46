"""Scoring texts with a probabilistic suffix tree, and with a unigram base.

The tree's symbols are the words seen ``min_count`` times, one symbol for every
rarer word and the end of a text.  A context of up to ``depth`` symbols becomes a state if it
is frequent and its next-symbol distribution diverges from its suffix's; a
symbol is predicted by the longest suffix of what precedes it that is a state.
Rare words share their symbol's probability by their counts, and words never
seen together get the weight of the words seen once.

Documents are cut into chunks of a bounded number of words.  A chunk keeps its
documents as numbers of its own word list.  Word lists and grams are dealt over
buckets by hash, packed, and counted bucket by bucket; the texts are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbering, discard, stored, words

END, RARE = 0, 1

CHUNK_SCHEMA = ("chunk long, doc_ids array<bigint>, held array<boolean>, n_words array<int>, ids binary, "
                "vocab binary, train binary")


def _packed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as byte planes; where they are small or sorted, the high planes are near empty."""
    import zstandard
    planes = values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(packed: bytes, kind: str = "<u4") -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _joined(vocab: list[bytes]) -> bytes:
    """Words hold no white space, so a line end can part them."""
    import zstandard
    return zstandard.compress(b"\n".join(vocab), 1)


def _split(joined: bytes) -> list[bytes]:
    import zstandard
    return zstandard.decompress(joined).split()


def _dealt(bucket: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each bucket's members, ascending."""
    if not len(bucket):
        return {}
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, starts[1:])))


def _word_buckets(vocab: list[bytes], n_buckets: int) -> dict[int, np.ndarray]:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab))
    return _dealt((h % np.uint64(n_buckets)).astype(np.int64))


def _chunks(chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        done = 0
        known = Numbering()
        doc_ids, held, docs = [], [], []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal done, total
            n_words = np.array([len(d) for d in docs], np.int32)
            ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            order = np.argsort(-np.bincount(ids, minlength=len(known)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            ids = rank[ids]
            learns = np.repeat(~np.array(held, bool), n_words)
            vocab = list(known)
            lists = {
                "chunk": pa.array([first + done], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "held": pa.array([held], pa.list_(pa.bool_())), "n_words": pa.array([n_words], pa.list_(pa.int32())),
                "ids": pa.array([_packed(ids)], pa.binary()),
                "vocab": pa.array([_joined([vocab[i] for i in order])]),
                "train": pa.array([_packed(np.bincount(ids[learns], minlength=len(known)))])}
            done += 1
            known.clear(), doc_ids.clear(), held.clear(), docs.clear()
            total = 0
            return pa.RecordBatch.from_pydict(lists)

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for doc_id, text, is_held in zip(*(c.to_pylist() for c in part.columns)):
                    found = words(text)
                    docs.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                    doc_ids.append(doc_id), held.append(is_held)
                    total += len(found) + 1
                    if total >= chunk_words:
                        yield close()
        if docs:
            yield close()
    return run


def _stream(ids: np.ndarray, n_words: np.ndarray, of_word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the documents in a row, each followed by its end, after ``depth`` ends; and where the ends are."""
    stop = np.cumsum(n_words + 1)
    stream = np.full(depth + (int(stop[-1]) if len(stop) else 0), END, np.int64)
    word = np.ones(len(stream) - depth, bool)
    word[stop - 1] = False
    stream[depth:][word] = of_word[ids]
    return stream, word


def _numbered(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, in the order of the values, and each value's number."""
    order = np.argsort(c)
    new = np.concatenate([[True], c[order[1:]] != c[order[:-1]]])[:len(c)]
    number = np.empty(len(c), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


READY_SCHEMA = "chunk long, doc_ids array<bigint>, held array<boolean>, n_words array<int>, ids binary, symbols binary, counts binary"


WORDS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("more", pa.binary()), ("ranks", pa.binary()),
                   ("words", pa.int64()), ("known", pa.int64()), ("single", pa.int64()), ("frequent", pa.int64()),
                   ("symbols", pa.int64())])


def _word_parts(n_buckets: int):
    """A row per chunk and bucket: the chunk's words that fall there, and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            vocab, train = _split(row["vocab"].as_py()), _unpacked(row["train"].as_py())
            for bucket, part in _word_buckets(vocab, n_buckets).items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"].as_py()]), pa.array([bucket]), pa.array([_joined([vocab[i] for i in part])]),
                     pa.array([_packed(train[part])])], names=["chunk", "bucket", "vocab", "train"])
    return run


def _counted_words(min_count: int):
    """What the other chunks add to each chunk's counts of a bucket's words, the ranks (from 1) of
    the bucket's frequent words, and the bucket's sums in a row without a chunk."""
    def run(bucket: pa.Table) -> pa.Table:
        parts = [_split(v) for v in bucket["vocab"].to_pylist()]
        c = np.concatenate([_unpacked(t).astype(np.int64) for t in bucket["train"].to_pylist()])
        place = pa.array([w for part in parts for w in part], pa.binary()).dictionary_encode().indices.to_numpy()
        total = np.zeros(int(place.max()) + 1, np.int64)
        np.add.at(total, place, c)
        often = total >= min_count
        rank = np.where(often, np.cumsum(often), 0)
        cuts = np.cumsum([len(part) for part in parts])[:-1]
        answers = _batch(WORDS, len(parts), chunk=bucket["chunk"].combine_chunks(), bucket=bucket["bucket"].combine_chunks(),
                         more=pa.array([_packed(x, "<i8") for x in np.split(total[place] - c, cuts)]),
                         ranks=pa.array([_packed(x) for x in np.split(rank[place], cuts)]))
        sums = {"words": total.sum(), "known": (total > 0).sum(), "single": (total == 1).sum(),
                "frequent": total[often].sum(), "symbols": often.sum()}
        return pa.Table.from_batches([answers, _batch(WORDS, 1, bucket=bucket["bucket"].combine_chunks()[:1],
                                                      **{k: pa.array([int(v)]) for k, v in sums.items()})], WORDS)
    return run


def _ready(n_buckets: int):
    """Chunks with the symbol and the training count of each of their words in place of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            vocab, count = _split(row["vocab"].as_py()), _unpacked(row["train"].as_py()).astype(np.int64)
            symbol = np.full(len(vocab), RARE, np.int64)
            parts = _word_buckets(vocab, n_buckets)
            if row["told"].is_valid:
                for bucket, start, more, ranks in zip(*(f.to_pylist() for f in row["told"].values.flatten())):
                    part, rank = parts[bucket], _unpacked(ranks).astype(np.int64)
                    count[part] += _unpacked(more, "<i8")
                    symbol[part] = np.where(rank > 0, start + rank, RARE)
            names = ["chunk", "doc_ids", "held", "n_words", "ids"]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([row[c].as_py()], row[c].type) for c in names), pa.array([_packed(symbol)]),
                 pa.array([_packed(count, "<i8")])], names=[*names, "symbols", "counts"])
    return run


def _bucket(symbols: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each column of symbols."""
    h = np.zeros(symbols.shape[1], np.uint64)
    for row in symbols:
        h = (h ^ row.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(n_buckets)).astype(np.int64)


class Level:
    """A chunk's grams of one level: a context of ``d`` symbols and the symbol after it.

    Grams are dealt over buckets by hash.  Within a bucket they are in ascending
    order, so that counts sent for a bucket need not name their grams.
    """

    def __init__(self, d: int, depth: int, live: np.ndarray, context: np.ndarray, stream: np.ndarray,
                 learns: np.ndarray, n_buckets: int):
        width = int(stream.max(initial=0)) + 1
        self.first, self.number = _numbered(context * width + stream[depth + live])
        self.context_first, self.context = _numbered(context)
        first = live[self.first]
        self.keys = np.stack([stream[depth - d + j + first] for j in range(d + 1)])
        self.times = np.bincount(self.number, learns[live], len(self.first)).astype(np.int64)
        self.parts = _dealt(_bucket(self.keys, n_buckets))
        self.contexts = self.keys[:-1, self.number[self.context_first]]
        self.context_parts = _dealt(_bucket(self.contexts, n_buckets))

    def counts(self, answers: pa.ListScalar) -> np.ndarray:
        """Training counts over all chunks; an answer tells what the others add to a bucket's grams."""
        c = self.times.copy()
        if answers.is_valid:
            buckets, more = answers.values.flatten()
            for bucket, added in zip(buckets.to_pylist(), more.to_pylist()):
                c[self.parts[bucket]] += _unpacked(added, "<i8")
        return c


class Walk:
    """The positions of a chunk, taken level by level as far as there are answers.

    ``prob`` is the probability of each position after the longest state so far.
    A position stays in the walk while its context occurs ``min_count`` times in
    the training texts; a context is a gram of the level before, one position
    earlier, and reaches back over no end.
    """

    def __init__(self, row: dict, depth: int, min_count: int, weight: float, root: np.ndarray, n_buckets: int, levels: int):
        self.n_words = row["n_words"].values.to_numpy().astype(np.int64)
        self.symbol, self.known = _unpacked(row["symbols"].as_py()).astype(np.int64), _unpacked(row["counts"].as_py(), "<i8")
        self.ids = _unpacked(row["ids"].as_py())
        is_rare = self.symbol == RARE
        self.stream, self.word = _stream(self.ids, self.n_words, self.symbol, depth)
        self.learns = np.repeat(~row["held"].values.to_numpy(zero_copy_only=False), self.n_words + 1)
        n = len(self.stream) - depth
        self.prob, count = np.full(n, root[0]), np.full(n, root[1], np.int64)
        self.prob[self.word] = np.where(is_rare, root[2], (self.known + 0.5) / root[4])[self.ids]
        count[self.word] = np.where(is_rare, int(root[3]), self.known)[self.ids]
        # The context of one symbol: what comes before, an end at first.
        before = np.concatenate([[int(root[1])], count[:-1]])
        self.live = np.flatnonzero(before >= min_count)
        context, self.total = self.stream[depth - 1 + self.live], before[self.live]
        for d in range(1, levels + 2):
            level = self.level = Level(d, depth, self.live, context, self.stream, self.learns, n_buckets) if d <= depth else None
            if d > levels:
                break
            c = level.counts(row[f"level{d}"])[level.number]
            state = np.zeros(len(level.context_first), bool)
            if row[f"state{d}"].is_valid:
                for bucket, bits in zip(*(f.to_pylist() for f in row[f"state{d}"].values.flatten())):
                    part = level.context_parts[bucket]
                    state[part] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part))
            parent = self.prob[self.live]
            self.prob[self.live] = np.where(state[level.context], (c + weight * parent) / (self.total + weight), parent)
            gram, times = np.full(n, -1, np.int64), np.zeros(n, np.int64)
            gram[self.live], times[self.live] = level.number, c
            goes_on = (c >= min_count) & (self.stream[depth + self.live] != END)
            self.live = self.live[goes_on] + 1
            context, self.total = gram[self.live - 1], times[self.live - 1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


GRAMS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("c", pa.binary()), ("logs", pa.binary())])
COUNTED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("more", pa.binary()), ("keys", pa.binary()), ("logs", pa.binary())])


def _batch(schema: pa.Schema, size: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in schema], schema=schema)


def _grams(d: int, *settings):
    """A chunk's next level: a row per bucket with its grams and their counts, and a row per bucket with
    its contexts, their counts and the (negative) sums of their grams' log probabilities after the suffix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            walk = Walk(row, *settings, d - 1)
            level, chunk = walk.level, row["chunk"].as_py()
            for bucket, part in level.parts.items():
                yield _batch(GRAMS, 1, chunk=pa.array([chunk]), bucket=pa.array([bucket]),
                             keys=pa.array([_packed(level.keys[:, part].ravel())]), c=pa.array([_packed(level.times[part])]))
            logs = np.bincount(level.context, np.log(walk.prob[walk.live]) * walk.learns[walk.live], len(level.context_first))
            total = walk.total[level.context_first]
            for bucket, part in level.context_parts.items():
                yield _batch(GRAMS, 1, chunk=pa.array([chunk]), bucket=pa.array([bucket]),
                             keys=pa.array([_packed(level.contexts[:, part].ravel())]), c=pa.array([_packed(total[part], "<i8")]),
                             logs=pa.array([_packed(-logs[part], "<f8")]))
    return run


def _counted(d: int, n_buckets: int):
    """Of a bucket's grams: what the other chunks add to each chunk's counts, and the sums of c log c of
    their contexts, in a row per bucket of contexts."""
    def run(bucket: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpacked(k).reshape(d + 1, -1) for k in bucket["keys"].to_pylist()], axis=1)
        own = [_unpacked(c).astype(np.int64) for c in bucket["c"].to_pylist()]
        c = np.concatenate(own)
        order = np.lexsort(keys[::-1])
        differs = keys[:, order[1:]] != keys[:, order[:-1]]
        new = np.concatenate([[True], differs.any(axis=0)])
        starts = np.flatnonzero(new)
        total = np.add.reduceat(c[order], starts)
        more = np.empty(len(c), np.int64)
        more[order] = total[np.cumsum(new) - 1] - c[order]
        added = np.split(more, np.cumsum([len(x) for x in own])[:-1])
        told = [i for i, x in enumerate(added) if x.any()]
        answers = _batch(COUNTED, len(told), chunk=bucket["chunk"].combine_chunks().take(pa.array(told, pa.int64())),
                         bucket=bucket["bucket"].combine_chunks().take(pa.array(told, pa.int64())),
                         more=pa.array([_packed(added[i], "<i8") for i in told], pa.binary()))
        opens = np.concatenate([[True], differs[:-1].any(axis=0)])[starts]
        at = np.flatnonzero(opens)
        part = np.add.reduceat(total * np.log(np.maximum(total, 1)), at)
        contexts = keys[:-1, order[starts[at]]]
        sums = [_batch(COUNTED, 1, bucket=pa.array([b]), keys=pa.array([_packed(contexts[:, of].ravel())]),
                       logs=pa.array([_packed(part[of], "<f8")]))
                for b, of in _dealt(_bucket(contexts, n_buckets)).items()]
        return pa.Table.from_batches([answers, *sums], COUNTED)
    return run


def _states(d: int, min_divergence: float):
    """(chunk, bucket, bits): which of a bucket's contexts diverge, as a bit per context of each chunk.

    The divergence of a context of count t is (sum of c log c - sum of c log q) / t - log t over its
    grams, where q is a gram's probability after the suffix of its context.
    """
    def run(bucket: pa.Table) -> pa.Table:
        keys = [_unpacked(k).reshape(d, -1) for k in bucket["keys"].to_pylist()]
        chunks = bucket["chunk"].to_pylist()
        every = np.concatenate(keys, axis=1)
        sums = np.concatenate([_unpacked(x, "<f8") for x in bucket["logs"].to_pylist()])
        total = np.concatenate([np.zeros(k.shape[1], np.int64) if c is None else _unpacked(c, "<i8")
                                for c, k in zip(bucket["c"].to_pylist(), keys)])
        order = np.lexsort(every[::-1])
        new = np.concatenate([[True], (every[:, order[1:]] != every[:, order[:-1]]).any(axis=0)])
        starts = np.flatnonzero(new)
        t = np.maximum.reduceat(total[order], starts)
        is_state = np.add.reduceat(sums[order], starts) / t - np.log(t) >= min_divergence
        state = np.empty(len(order), bool)
        state[order] = is_state[np.cumsum(new) - 1]
        told = [(c, np.packbits(x).tobytes()) for c, x in zip(chunks, np.split(state, np.cumsum([k.shape[1] for k in keys])[:-1]))
                if c is not None and x.any()]
        return pa.table({"chunk": pa.array([c for c, _ in told], pa.int64()), "bucket": pa.array(
            [bucket["bucket"][0].as_py()] * len(told), pa.int64()), "bits": pa.array([b for _, b in told], pa.binary())})
    return run


def _next_level(chunks: DataFrame, d: int, min_divergence: float, *settings) -> DataFrame:
    """(chunk, level, state): the counts of each chunk's grams of the next level in the other chunks,
    and which of its contexts are states."""
    rows = stored(chunks.mapInArrow(_grams(d, *settings), "chunk long, bucket long, keys binary, c binary, logs binary"), "grams", release=True)
    counted = stored(rows.where("logs IS NULL").groupBy("bucket").applyInArrow(
        _counted(d, settings[-1]), "chunk long, bucket long, more binary, keys binary, logs binary"), "counted", release=True)
    states = (rows.where("logs IS NOT NULL")
              .unionByName(counted.where("chunk IS NULL").drop("more"), allowMissingColumns=True)
              .groupBy("bucket").applyInArrow(_states(d, min_divergence), "chunk long, bucket long, bits binary"))
    told = (counted.where("chunk IS NOT NULL").select("chunk", F.struct("bucket", "more").alias("answer"))
            .unionByName(states.select("chunk", F.struct("bucket", "bits").alias("state")), allowMissingColumns=True))
    level = stored(told.groupBy("chunk").agg(F.collect_list("answer").alias(f"level{d}"),
                                             F.collect_list("state").alias(f"state{d}")), "level", release=True)
    discard(rows, counted)
    return level


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                chunk_words: int = 1 << 20, depth: int = 3, min_count: int = 50,
                min_divergence: float = 0.01, weight: float = 8.0, bucket_grams: int = 1 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows that are not ``held_out`` (a null counts as held out).
    Tokens are the words, A-Z lower-cased, and one end.  ``base_score`` sums
    log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, from counts over all
    training tokens; ``score`` is the log10 probability of the whole text
    under the suffix tree, where as in the base all words that are not in the
    training texts are one word.

    Words and contexts that occur ``min_count`` times in the training texts are
    symbols and contexts of their own, so the tree grows with the input.  Each
    level's grams (context, next symbol), as the words, are dealt over buckets by hash, about
    ``bucket_grams`` tokens each, and counted there.  A chunk sends the distinct
    grams of a bucket as one packed row, so a frequent gram is one entry per
    chunk; what comes back is only what other chunks add to its counts, and
    which contexts are states.  Nothing of the tree is collected or broadcast.
    Tables of grams and words go once their answers are written.

    A very long text is one chunk by itself, never cut.

    Null and empty texts are the end alone.  Every row is scored once, repeated
    rows and null ids too; without training rows the base is 0 and the tree
    uniform.  An empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.coalesce(held_out, F.lit(True)).alias("held"))
    chunks = stored(rows.mapInArrow(_chunks(chunk_words), CHUNK_SCHEMA), "chunks")
    train_docs, n_tokens = chunks.agg(
        F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)),
        F.coalesce(F.sum(F.size("n_words") + F.aggregate("n_words", F.lit(0).cast("long"), lambda t, x: t + x)), F.lit(0))).first()
    n_buckets = max(1, math.ceil(n_tokens / bucket_grams))
    min_count = max(2, min_count)
    found = stored(chunks.mapInArrow(_word_parts(n_buckets), "chunk long, bucket long, vocab binary, train binary")
                   .groupBy("bucket").applyInArrow(_counted_words(min_count), (
                       "chunk long, bucket long, more binary, ranks binary, words long, known long, single long, "
                       "frequent long, symbols long")), "words", release=True)
    sums = found.where("chunk IS NULL")
    train_words, distinct, single, frequent, n_frequent = sums.agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "known", "single", "frequent", "symbols"))).first()
    n, v = train_words + train_docs, distinct + (train_docs > 0)
    # Symbols are numbered from 2 on, bucket by bucket; the window runs over one row per bucket.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("bucket", (F.coalesce(F.sum("symbols").over(before), F.lit(0)) + 1).alias("start"))
    told = (found.where("chunk IS NOT NULL").select("chunk", "bucket", "more", "ranks").join(starts, "bucket")
            .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "start", "more", "ranks")).alias("told")))
    rare, unseen = train_words - frequent, max(1, single)
    mass = n + 0.5 * (n_frequent + 2)
    root = np.array([(train_docs + 0.5) / mass, train_docs, (rare + 0.5) / mass, rare, mass])
    # A chunk of empty documents has no words, so nothing is told about it.
    joined = stored(chunks.join(told, "chunk", "left").mapInArrow(_ready(n_buckets), READY_SCHEMA), "ready", release=True)
    discard(chunks, found)
    settings = depth, min_count, weight, root, n_buckets
    for d in range(1, depth + 1):
        joined = joined.join(_next_level(joined, d, min_divergence, *settings), "chunk", "left")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = n + 0.5 * (v + 1)
        for row in _rows(batches):
            walk = Walk(row, *settings, depth)
            n_words, ids, count = walk.n_words, walk.ids, walk.known
            doc = np.repeat(np.arange(len(n_words)), n_words)
            base = (np.bincount(doc, np.log10((count + 0.5) / norm)[ids], len(n_words))
                    + math.log10((train_docs + 0.5) / norm))
            known_words = np.bincount(doc, (count > 0)[ids], len(n_words)).astype(np.int64)
            inside = np.where(walk.symbol == RARE, np.where(count > 0, count, unseen) / (rare + unseen), 1.0)
            logs = np.log10(walk.prob)
            logs[walk.word] += np.log10(inside)[ids]
            score = np.add.reduceat(logs, np.cumsum(n_words + 1) - n_words - 1)
            yield pa.RecordBatch.from_arrays([
                row["doc_ids"].values, row["held"].values, pa.array(n_words + 1),
                pa.array(known_words + (train_docs > 0)), pa.array(np.full(len(n_words), n, np.int64)),
                pa.array(base), pa.array(score)],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(scored, "id long, held_out boolean, n_tokens long, n_known long, "
                                     "train_tokens long, base_score double, score double")
