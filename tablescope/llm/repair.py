"""Token-id files: Re-Pair grammar compression per shard, random access by document.

A shard holds the ids of whole documents.  Frequent adjacent id pairs are
replaced by nonterminals, round after round; the shard stores the rules, how
many ids each rule expands to, and the remaining symbols.  No pair spans two
documents, so any document is decoded alone.

Shard payload, little-endian: ``b"RPR1"``, then as u32 the first nonterminal,
the numbers of rules, documents and symbols; then rules (u16 left and right),
expansion lengths (u32), for each document its end in symbols and in ids
(u32), and the symbols (u16).
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbering, stored

MAGIC = b"RPR1"
SYMBOLS = 1 << 16
SLOTS = 18


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[s:s+n]`` for each start and length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[np.arange(total, dtype=np.int64) + shift]


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, each distinct piece once.

    The tokenizer's normaliser and splitter never look across ASCII white
    space, so a text's ids are its words' ids in a row.  Nor do they look
    across the end of a run of letters that a mark follows, so words are cut
    there; and they lower-case, so ASCII texts are lower-cased first.  A text
    that may hold an added token is left as it is.  Pieces of letters alone are
    encoded many at a time: a piece's last token tells where it ends.
    """

    CUT = re.compile(rb"[.,;:!?%*#$&|](?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
    PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, max_words: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 3, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.added = {t.content[:2].encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.index = Numbering()  # piece as bytes -> number
        self.flat = np.zeros(0, np.uint16)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _one_by_one(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, plain: list[str]) -> list[np.ndarray]:
        """Ids of pieces of letters, and how many each has, in turn."""
        out = []
        for low in range(0, len(plain), 1000):
            part = plain[low:low + 1000]
            ids = np.array(self._one_by_one([" ".join(part)])[0], np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                each = self._one_by_one(part)
                ids = np.fromiter(itertools.chain.from_iterable(each), np.int64)
                ends = np.cumsum([len(e) for e in each])
            out += [ids, np.diff(ends, prepend=0)]
        return out

    @staticmethod
    def _newest(numbering: dict, known: int) -> list:
        """Keys numbered from ``known`` on, without a walk over those before."""
        return list(itertools.islice(reversed(numbering), len(numbering) - known))[::-1]

    def _learn(self, fresh: list[bytes]) -> None:
        is_plain = np.fromiter(map(bytes.isalpha, fresh), bool, len(fresh))  # ASCII letters alone
        other = np.flatnonzero(~is_plain)
        texts = [fresh[i].decode("utf-8", "surrogatepass") for i in other.tolist()]
        is_plain[other] = [self.PLAIN.fullmatch(t) is not None for t in texts]
        plain = list(map(bytes.decode, itertools.compress(fresh, is_plain.tolist())))
        found = self._encoded(plain)
        rest = self._one_by_one([t for t, p in zip(texts, is_plain[other].tolist()) if not p])
        counts = np.zeros(len(fresh), np.int64)
        counts[is_plain] = np.concatenate([np.zeros(0, np.int64), *found[1::2]])
        counts[~is_plain] = [len(ids) for ids in rest]
        flat = np.concatenate([*found[::2], np.fromiter(itertools.chain.from_iterable(rest), np.int64)]).astype(np.uint16)
        # The plain pieces' ids lie before those of the rest.
        start = np.zeros(len(fresh), np.int64)
        order = np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        start[order] = len(self.flat) + np.cumsum(counts[order]) - counts[order]
        self.start = np.concatenate([self.start, start])
        self.flat = np.concatenate([self.flat, flat])
        self.count = np.concatenate([self.count, counts])

    def _pieces(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "surrogatepass")
        lower = data.lower()
        if any(added in lower for added in self.added):
            return data.split()
        # Outside ASCII, lower-casing before the normaliser composes letters could change what they compose to.
        return self.CUT.sub(rb" \g<0>", lower if data.isascii() else data).split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if len(self.index) > self.max_words:
            self._clear()
        docs = []
        for text in texts:
            pieces = self._pieces(text)
            docs.append(np.fromiter(map(self.index.__getitem__, pieces), np.int32, len(pieces)))
        fresh = self._newest(self.index, len(self.count))
        if fresh:
            self._learn(fresh)
        ends = np.cumsum([len(d) for d in docs], dtype=np.int64)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint16), np.zeros(len(docs), np.int64)
        which = np.concatenate(docs)
        lengths = self.count[which]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return ragged(self.flat, self.start[which], lengths), np.diff(np.concatenate([[0], bounds[ends]]))


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which Spark uses for one task after another.

    It is kept beside the library it wraps, as functions sent by value have no
    module of their own to keep it in.  It is only a cache: its content does
    not change any result.
    """
    import tokenizers
    kept = tokenizers.__dict__.setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def compress(ids: np.ndarray, n_tokens: np.ndarray, base: int, min_count: int = 3, share: int = 4) -> bytes:
    """Re-Pair of one shard; ``base`` is the first id that is no token.

    Each round counts all adjacent pairs within documents and replaces the most
    frequent ones from left to right, as many as 1/``share`` of the 16-bit
    symbols that are left (64 at least), so that pairs of pairs still find
    symbols.  It ends only when no pair occurs ``min_count`` times or the
    symbols have run out.  A pair that is rare once stays rare, as what comes to
    lie side by side later holds a new symbol; so only the other positions,
    ``live``, are counted again.
    """
    seq = ids.astype(np.uint16)
    last = np.zeros(len(seq), bool)  # symbol ends its document
    token_ends = np.cumsum(n_tokens)
    last[token_ends[n_tokens > 0] - 1] = True
    left, right = np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    length = np.ones(SYMBOLS, np.uint32)
    live = np.ones(len(seq), bool)
    while (room := SYMBOLS - base - len(left)) > 0 and len(seq) > 1:
        code = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        place = np.flatnonzero(live[:-1] & ~last[:-1])
        code = code[place]
        ordered = np.sort(code)
        if not len(ordered):
            break
        cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.concatenate([cut, [len(ordered)]]))
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        best = often[np.argsort(-counts[often], kind="stable")[:min(room, max(64, room // share))]]
        chosen = ordered[cut[best]]
        slot = (chosen * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)
        _, first = np.unique(slot, return_index=True)  # of pairs that share a slot, the more frequent
        first.sort()
        chosen, slot = chosen[first], slot[first]
        held, symbol = np.zeros(1 << SLOTS, np.uint32), np.zeros(1 << SLOTS, np.uint16)
        held[slot] = chosen
        symbol[slot] = base + len(left) + np.arange(len(chosen))
        hashed = code * np.uint32(2654435761)
        at = hashed >> np.uint32(32 - SLOTS)
        found = (held[at] == code) & (symbol[at] > 0)
        hit, at = place[found], at[found]
        # Rare pairs that share a place of this table with a frequent one are just counted again.
        frequent = np.zeros(1 << 22, bool)
        frequent[(ordered[cut[often]] * np.uint32(2654435761)) >> np.uint32(10)] = True
        live = np.zeros(len(seq), bool)
        live[place] = frequent[hashed >> np.uint32(10)]
        new_run = np.concatenate([[True], np.diff(hit) > 1])
        run_start = hit[new_run][np.cumsum(new_run) - 1]
        other = (hit - run_start) % 2 == 0  # overlapping occurrences: every other one
        hit, at = hit[other], at[other]
        seq[hit] = symbol[at]
        live[hit] = live[np.maximum(hit - 1, 0)] = True
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, last, live = seq[keep], last[keep], live[keep]
        a, b = (chosen >> np.uint32(16)).astype(np.uint16), chosen.astype(np.uint16)
        length[base + len(left):base + len(left) + len(a)] = length[a] + length[b]
        left, right = np.concatenate([left, a]), np.concatenate([right, b])
    symbol_ends = np.zeros(len(n_tokens), np.uint32)
    symbol_ends[n_tokens > 0] = np.flatnonzero(last) + 1
    symbol_ends = np.maximum.accumulate(symbol_ends) if len(symbol_ends) else symbol_ends
    rules = np.stack([left, right], axis=1) if len(left) else np.zeros((0, 2), np.uint16)
    return b"".join([
        MAGIC, struct.pack("<4I", base, len(left), len(n_tokens), len(seq)),
        rules.astype("<u2").tobytes(), length[base:base + len(left)].astype("<u4").tobytes(),
        symbol_ends.astype("<u4").tobytes(), token_ends.astype("<u4").tobytes(),
        seq.astype("<u2").tobytes()])


class Shard:
    """Reads a shard's payload; any document or token range is decoded alone."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.base, rules, docs, symbols = struct.unpack_from("<4I", payload, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u2", 2 * rules).reshape(-1, 2)
        self.rule_length = take("<u4", rules).astype(np.int64)
        self.symbol_ends, self.token_ends = take("<u4", docs), take("<u4", docs)
        self.symbols = take("<u2", symbols)
        self.start = np.concatenate([np.arange(self.base), np.zeros(rules, np.int64)])
        self.length = np.concatenate([np.ones(self.base, np.int64), self.rule_length])
        parts, used = [np.arange(self.base, dtype=np.uint16)], self.base
        for i, (a, b) in enumerate(self.rules):  # a rule uses only symbols made before it
            self.start[self.base + i] = used
            parts.append(np.concatenate([self._flat(parts, a), self._flat(parts, b)]))
            used += len(parts[-1])
        self.flat = np.concatenate(parts)

    def _flat(self, parts: list[np.ndarray], symbol: int) -> np.ndarray:
        return parts[0][symbol:symbol + 1] if symbol < self.base else parts[symbol - self.base + 1]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.start[symbols], self.length[symbols])

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        low = int(self.symbol_ends[i - 1]) if i else 0
        return self.expand(self.symbols[low:int(self.symbol_ends[i])])

    def tokens(self, i: int, begin: int, end: int) -> np.ndarray:
        """Ids ``begin:end`` of document ``i``, expanding only the symbols that hold them."""
        low = int(self.symbol_ends[i - 1]) if i else 0
        symbols = self.symbols[low:int(self.symbol_ends[i])]
        ends = np.cumsum(self.length[symbols])
        a, b = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        skip = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[begin - skip:end - skip]


SHARD_SCHEMA = "part long, shard long, n_docs long, n_tokens long, doc_ids array<bigint>, payload binary"


def write_token_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                       end_id: int = 1, shard_tokens: int = 1 << 20, name: str = "tokens") -> DataFrame:
    """Token shards of all documents in ascending id order, written and read back.

    Rows are (part, shard, n_docs, n_tokens, doc_ids, payload); ordered by part
    and shard they hold the documents by id, null ids first, repeated ids by
    text.  Every document ends with ``end_id``; null and empty texts are that
    id alone.  A shard is closed once it has ``shard_tokens`` ids, a longer
    document is one shard.  An empty table gives no shard.  Other columns are
    not read.
    """
    from tokenizers import Tokenizer
    base = Tokenizer.from_file(tokenizer).get_vocab_size()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keys = ["id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, shard = TaskContext.get().partitionId(), 0
        encoder = worker_encoder(tokenizer)
        held_ids: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal shard
            n = np.array(sizes, np.int64)
            payload = compress(np.concatenate(held), n, base)
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([len(n)], pa.int64()),
                pa.array([int(n.sum())], pa.int64()), pa.array([held_ids], pa.list_(pa.int64())),
                pa.array([payload], pa.binary())], names=["part", "shard", "n_docs", "n_tokens", "doc_ids", "payload"])
            shard += 1
            held_ids.clear(), held.clear(), sizes.clear()
            return out

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                piece = batch.slice(low, 512)
                ids, counts = encoder.encode(piece.column(1).to_pylist())
                at = 0
                for doc_id, n in zip(piece.column(0).to_pylist(), counts.tolist()):
                    held_ids.append(doc_id)
                    held.append(np.append(ids[at:at + n], np.uint16(end_id)))
                    sizes.append(n + 1)
                    at += n
                    total += n + 1
                    if total >= shard_tokens:
                        yield close()
                        total = 0
        if sizes:
            yield close()

    return stored(ranged.mapInArrow(shards, SHARD_SCHEMA), name)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, start): ids before each shard, from sums by part and within parts."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_before"))
            .join(offsets, "part").select("part", "shard", (F.col("_before") + F.col("_offset")).alias("start")))


def read_token_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_symbols) per document, decoded from the shards.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian unsigned
    32-bit integers, ``start`` the number of ids of all documents before.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, payload, start in zip(batch.column(0), batch.column(1), batch.column(2)):
                shard = Shard(payload.as_py())
                tokens = shard.all_ids().astype("<u4")
                ends = shard.token_ends.astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    ids.values.cast(pa.int64()), pa.array(begins + start.as_py(), pa.int64()),
                    pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64()),
                    pa.array(np.diff(np.concatenate([[0], shard.symbol_ends.astype(np.int64)])), pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"])

    placed = shards.join(shard_starts(shards), ["part", "shard"]).select("doc_ids", "payload", "start")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")
