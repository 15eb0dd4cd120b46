"""Repair of conversation structure: the cheapest edits that give alternating turns.

A Viterbi search walks each conversation in order.  The cheapest edits into
every state hang in one tree of backpointers with reference counts; as soon as
all survivors share an ancestor, the edits up to it are settled and leave the
tree, so memory holds only what is still open.  Ties compare the whole open
suffixes.  Long conversations are cut into pieces that are searched from every
state they may be entered in, and a second search of the same kind picks one
path through the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# States after the rows so far: nothing kept, a system row, a user row, an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Stands for EMPTY before the first row of a conversation.
START = 4
# Costs of the edits, and the fault that a kept truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
NEXT = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INSERTS = [(s, s, 0, "") for s in range(4)] + [(s, NEXT[s], INSERT, "I") for s in range(4)] + [
    (s, ASSISTANT, 2 * INSERT, "II") for s in (EMPTY, SYSTEM)]
#: EXTRA[x][y]: what it costs at most to go on from y instead of x, whatever follows.
#: From x = EMPTY a system row may follow, which any other state must delete.
EXTRA = {EMPTY: {SYSTEM: 2 * INSERT, USER: INSERT + DELETE, ASSISTANT: DELETE},
         SYSTEM: {EMPTY: 0, USER: INSERT, ASSISTANT: 0},
         USER: {EMPTY: INSERT, SYSTEM: INSERT, ASSISTANT: INSERT},
         ASSISTANT: {EMPTY: 0, SYSTEM: 2 * INSERT, USER: INSERT}}


class Survivors:
    """Cheapest path into each state, as a tree of backpointers.

    A node is [parent, label, state, references]; references are children and
    survivors that end there.
    """

    def __init__(self, state: int):
        self.root = [None, "", state, 1]
        self.heads = {state: (0, self.root)}

    def open_labels(self, node: list) -> str:
        """Labels from the settled root down to ``node``."""
        labels = []
        while node is not self.root:
            labels.append(node[1])
            node = node[0]
        return "".join(reversed(labels))

    def advance(self, moves: list[tuple[int, int, int, str]]) -> None:
        """Moves (from, to, cost, label): the cheapest stays per state, ties to the ASCII-least labels."""
        best: dict[int, tuple[int, list, str]] = {}
        for source, target, cost, label in moves:
            if source not in self.heads:
                continue
            spent, node = self.heads[source]
            now = best.get(target)
            if now is None or spent + cost < now[0] or (
                    spent + cost == now[0] and self.open_labels(node) + label < self.open_labels(now[1]) + now[2]):
                best[target] = (spent + cost, node, label)
        old, self.heads = self.heads, {}
        for state, (cost, parent, label) in best.items():
            parent[3] += 1
            self.heads[state] = (cost, [parent, label, state, 1])
        for _, node in old.values():
            self._release(node)

    def prune(self) -> None:
        """Drops states from which no continuation can be cheapest."""
        for x in [x for x, (cost, _) in self.heads.items() if any(
                y != x and cost > c + EXTRA[x][y] for y, (c, _) in self.heads.items())]:
            self._release(self.heads.pop(x)[1])

    def _release(self, node: list) -> None:
        node[3] -= 1
        while node[3] == 0 and node is not self.root:
            node = node[0]
            node[3] -= 1

    def settled(self) -> list[tuple[str, int]]:
        """(label, state) of the nodes that all survivors share, which leave the tree."""
        if self.root[3] != 1:
            return []
        return self._leave(next(iter(self.heads.values()))[1], lambda: self.root[3] == 1)

    def rest(self, state: int) -> list[tuple[str, int]]:
        """(label, state) of the open nodes on the path into ``state``."""
        return self._leave(self.heads[state][1], lambda: True)

    def _leave(self, node: list, shared) -> list[tuple[str, int]]:
        path, out = [], []
        while node is not self.root:
            path.append(node)
            node = node[0]
        for node in reversed(path):
            if not shared():
                break
            out.append((node[1], node[2]))
            node[0], self.root = None, node
        return out


def row_moves(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    moves = [(s, s, DELETE, "D") for s in range(4)]
    if not must_go:
        fault = TRUNCATED if truncated else 0
        if initial == "s":
            moves.append((EMPTY, SYSTEM, fault, "K"))
        for s, target in NEXT.items():
            keeps = initial == ("u" if target == USER else "a")
            moves.append((s, target, fault, "K") if keeps else (s, target, fault + REROLE, "R"))
    return moves


#: The moves of a row by its initial, whether it must go and whether it is truncated.
MOVES = {(i, go, cut): row_moves(i, go, cut) for i in "sua " for go in (False, True) for cut in (False, True)}


def search_piece(rows: list[tuple[str, bool, bool]], entry: int) -> dict:
    """Cheapest edits of ``rows`` from one entry state into every state: the shared start and the open ends."""
    tree, common = Survivors(EMPTY if entry == START else entry), []
    if entry == START:
        tree.advance(INSERTS)
        tree.prune()
    for row in rows:
        tree.advance(MOVES[row])
        tree.advance(INSERTS)
        tree.prune()
        common += [label for label, _ in tree.settled()]
    return {"entry": entry, "common": "".join(common), "exits": [
        {"exit": s, "cost": cost, "tail": tree.open_labels(node)} for s, (cost, node) in sorted(tree.heads.items())]}


PIECE = pa.schema([
    ("conv", pa.int64()), ("ord", pa.int64()), ("rids", pa.list_(pa.int64())), ("initials", pa.string()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("low_turn", pa.int64()), ("high_turn", pa.int64()), ("turns", pa.int64()),
    ("paths", pa.list_(pa.struct([("entry", pa.int32()), ("common", pa.string()), ("exits", pa.list_(
        pa.struct([("exit", pa.int32()), ("cost", pa.int64()), ("tail", pa.string())])))])))])
PIECE_SQL = ("conv long, ord long, rids array<long>, initials string, blank long, duplicate long, truncated long, illegal long, "
             "low_turn long, high_turn long, turns long, "
             "paths array<struct<entry: int, common: string, exits: array<struct<exit: int, cost: long, tail: string>>>>")
CHOSEN = pa.schema([("conv", pa.int64()), ("ord", pa.int64()), ("rids", pa.list_(pa.int64())), ("initials", pa.string()),
                    ("state", pa.int32()), ("audit", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()),
                    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())])
CHOSEN_SQL = ("conv long, ord long, rids array<long>, initials string, state int, audit string, gaps long, blank long, "
              "duplicate long, truncated long, illegal long, cost long")


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["rids"]) + 10
        if size >= 100_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))


def _piece(conv: int | None, place: int, rows: list[dict], first_of_part: bool, first_of_conv: bool) -> dict:
    steps = [(r["initial"] if r["initial"] in ("s", "u", "a") else " ", r["blank"] or r["duplicate"], r["truncated"]) for r in rows]
    # A range may start amid a conversation: then its first piece may be entered in any state.
    entries = ([START] if first_of_conv else []) + ([*range(4)] if first_of_part or not first_of_conv else [])
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = "".join(s[0] for s in steps)
    return {"conv": conv, "ord": place, "rids": [r["rid"] for r in rows], "initials": initials,
            "blank": sum(r["blank"] for r in rows), "duplicate": sum(r["duplicate"] and not r["blank"] for r in rows),
            "truncated": sum(r["truncated"] and not r["blank"] and not r["duplicate"] for r in rows),
            "illegal": _illegal(initials), "low_turn": min(turns, default=None), "high_turn": max(turns, default=None),
            "turns": len(set(turns)), "paths": [search_piece(steps, e) for e in entries]}


def _pieces(piece_rows: int):
    """Sorted rows of a range to pieces of at most ``piece_rows`` rows of one conversation."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() << 33

        def pieces() -> Iterator[dict]:
            held: list[dict] = []
            conv, place, first_of_part, first_of_conv = None, 0, True, True
            for batch in batches:
                for row in batch.to_pylist():
                    if held and (row["conv"] != conv or len(held) == piece_rows):
                        yield _piece(conv, part + place, held, first_of_part, first_of_conv)
                        first_of_conv = row["conv"] != conv
                        first_of_part = False
                        held, place = [], place + 1
                    conv = row["conv"]
                    held.append(row)
            if held:
                yield _piece(conv, part + place, held, first_of_part, first_of_conv)

        yield from _batches(pieces(), PIECE)
    return cut


class _Conversation:
    """One conversation's pieces in order: one path is picked, settled pieces are let go."""

    def __init__(self, conv: int | None):
        self.conv, self.tree, self.state = conv, Survivors(EMPTY), EMPTY
        self.open: list[dict] = []
        self.first = True
        self.sums = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = None
        self.turns, self.last = 0, ""

    def add(self, piece: dict) -> Iterator[dict]:
        moves = [(EMPTY if p["entry"] == START else p["entry"], e["exit"], e["cost"], p["common"] + e["tail"])
                 for p in piece["paths"] if (p["entry"] == START) == self.first for e in p["exits"]]
        self.first = False
        for name in self.sums:
            self.sums[name] += piece[name]
        if self.last:
            self.sums["illegal"] += _illegal(self.last + piece["initials"][0])
        self.last = piece["initials"][-1]
        if piece["turns"]:
            self.turns += piece["turns"] - (self.high == piece["low_turn"])
            self.low, self.high = piece["low_turn"] if self.low is None else self.low, piece["high_turn"]
        self.open.append({k: piece[k] for k in ("conv", "ord", "rids", "initials")})
        self.tree.advance(moves)
        self.tree.prune()
        yield from self._settle(self.tree.settled())

    def _settle(self, found: list[tuple[str, int]]) -> Iterator[dict]:
        for label, state in found:
            yield self.open.pop(0) | {"state": self.state, "audit": label}
            self.state = state

    def close(self) -> Iterator[dict]:
        """The pieces still open, and one last row with the conversation's sums."""
        ends = [(cost, self.tree.open_labels(node), s) for s, (cost, node) in self.tree.heads.items() if s in (EMPTY, ASSISTANT)]
        cost, _, state = min(ends)
        yield from self._settle(self.tree.rest(state))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        yield {"conv": self.conv, "ord": None, "rids": [], "gaps": gaps, "cost": cost, **self.sums}


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        now: _Conversation | None = None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for piece in batch.slice(low, 256).to_pylist():
                    if now is None or piece["conv"] != now.conv:
                        if now is not None:
                            yield from now.close()
                        now = _Conversation(piece["conv"])
                    yield from now.add(piece)
        if now is not None:
            yield from now.close()

    yield from _batches(rows(), CHOSEN)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that each piece's edits leave: (conv, ord, seq, rid, edit, new_role)."""
    schema = pa.schema([("conv", pa.int64()), ("ord", pa.int64()), ("seq", pa.int64()), ("rid", pa.int64()),
                        ("edit", pa.string()), ("new_role", pa.string())])
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            out = []
            for piece in batch.slice(low, 256).to_pylist():
                state, at = piece["state"], 0
                for seq, edit in enumerate(piece["audit"]):
                    rid, role = None, None
                    if edit != "I":
                        rid, initial = piece["rids"][at], piece["initials"][at]
                        at += 1
                        if edit == "D":
                            continue
                    state = SYSTEM if edit == "K" and initial == "s" else NEXT[state]
                    if edit != "K":
                        role = ROLE[state]
                    out.append({"conv": piece["conv"], "ord": piece["ord"], "seq": seq, "rid": rid, "edit": edit, "new_role": role})
            yield pa.RecordBatch.from_pylist(out, schema)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's rows, streamed in their order."""
    convs, found = [], []
    conv, sha = None, None
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for c, role, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(),
                                     part.column(2).cast(pa.binary()).to_pylist()):
                if sha is None or c != conv:
                    if sha is not None:
                        convs.append(conv)
                        found.append(sha.hexdigest())
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(role + b":" + text)
        if len(convs) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(found, pa.string())], names=["conv", "sha"])
            convs, found = [], []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*convs, conv], pa.int64()), pa.array([*found, sha.hexdigest()], pa.string())],
                                         names=["conv", "sha"])


@dataclass
class Repaired:
    """``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256;
    ``rows``: conv, ord, seq, edit, role, text, in the order of ord and seq."""

    conversations: DataFrame
    rows: DataFrame


INK = r"[^\x20\x09-\x0D]"
CUT_OFF = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with one row in four damaged, by crc32 of ``conv:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 makes its role user.  Null roles, texts and parts of the key are one
    space; conv and turn stay null.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.col("kind")
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        space(role_col).alias("role"), space(text_col).alias("text"),
        (F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20).cast("int").alias("kind"))
    return rows.where(kind != 0).select(
        "conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _same_conv(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair_conversations(rows: DataFrame, conv_col: str = "conv", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", piece_rows: int = 20_000) -> Repaired:
    """Cheapest edits that give each conversation the role initials ``(s?(ua)+)?``.

    Rows go by turn, nulls first; equal turns by the first 64 characters of
    role, then of text, then by a digest of both, so repeated rows are
    adjacent.  A row's first fault counts: blank (white space only), duplicate
    (role and text seen earlier in the conversation), truncated (last other
    character not ``.!?``).  Edits are Keep (0), Rerole to user or assistant
    (3), Delete (4; blank and duplicate rows must go) and Insert of an empty
    user or assistant row (3); a truncated row that stays adds 3.  Of equally
    cheap edits the ASCII-least initials win.

    Null roles and texts are one space, an empty role has no initial and cannot
    be kept, rows with a null conversation are one
    conversation of their own, repeated rows are duplicates.  An empty table
    gives empty tables; other columns, whatever their names, are not read.
    Only flags, ids and at most 128 characters of a row are sorted; whole texts
    meet their edits by row id at the end.

    Rows are range-partitioned, so one conversation's rows may lie in many
    tasks; a piece holds at most ``piece_rows`` rows.  What a conversation
    leaves to one task is its audit and the hash of its text, each one value.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    whole = stored(rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                               space(role_col).alias("role"), space(text_col).alias("text"),
                               F.monotonically_increasing_id().alias("rid")), "conversations")
    narrow = whole.select(
        "conv", "turn", "rid", F.substring("role", 1, 1).alias("initial"), F.substring("role", 1, 64).alias("role_start"),
        F.substring("text", 1, 64).alias("text_start"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        (~F.col("text").rlike(INK)).alias("blank"), F.col("text").rlike(CUT_OFF).alias("truncated"))
    # Rows of one digest differ in turn and row id only, so these give the order among them.
    repeated = (narrow.groupBy("conv", "digest").agg(F.min(F.struct("turn", "rid")).alias("first"), F.count("*").alias("n"))
                .where("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first"))
    flagged = stored(narrow.join(repeated, _same_conv(F.col("conv"), F.col("c")) & (F.col("digest") == F.col("d")), "left")
                     .withColumn("duplicate", F.coalesce(F.struct("turn", "rid") > F.col("first"), F.lit(False)))
                     .drop("c", "d", "first"), "flagged")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role_start", "text_start", "digest", "rid"]
    pieces = (flagged.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv", "turn", "rid", "initial", "blank", "duplicate", "truncated")
              .mapInArrow(_pieces(piece_rows), PIECE_SQL))
    # Written, so that ranges and their numbers are fixed before pieces are put together.
    pieces = stored(pieces, "pieces")
    chosen = stored(pieces.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "ord")
                    .mapInArrow(_choose, CHOSEN_SQL), "chosen")
    edits = chosen.where(F.col("ord").isNotNull())
    left = edits.select("conv", "ord", "rids", "initials", "state", "audit").mapInArrow(
        _replay, "conv long, ord long, seq long, rid long, edit string, new_role string")
    own = whole.select(F.col("rid").alias("own"), "role", "text")
    result = stored(left.join(own, left["rid"] == F.col("own"), "left").select(
        "conv", "ord", "seq", "edit", F.coalesce("new_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text")), "repaired")
    hashes = (result.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "ord", "seq")
              .select("conv", "role", "text").mapInArrow(_hash, "c long, sha string"))
    audits = edits.groupBy(F.col("conv").alias("a")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    sums = chosen.where(F.col("ord").isNull()).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256(b"").hexdigest()
    found = (sums.join(audits, _same_conv(F.col("conv"), F.col("a")), "left").drop("a")
             .join(hashes, _same_conv(F.col("conv"), F.col("c")), "left")
             .withColumn("audit", F.coalesce("audit", F.lit("")))
             .withColumn("repaired_sha256", F.coalesce("sha", F.lit(empty))).drop("c", "sha"))
    return Repaired(found, result)


def with_lost_conversations(found: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``found`` with a row of zeros, an empty audit and the hash of nothing for every conversation without rows."""
    ids = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("id")).distinct()
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (ids.join(found, _same_conv(F.col("id"), F.col("conv")), "left").drop("conv").withColumnRenamed("id", "conv")
            .fillna(zero | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()},
                    [*zero, "audit", "repaired_sha256"]))
