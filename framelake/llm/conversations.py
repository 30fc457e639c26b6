"""Repair of conversations by the cheapest edits that give a wanted structure: an optional system turn, then user and assistant in turn.

Every turn is kept, given another role, or deleted, and turns without text may be inserted; the edits' letters, in order, are the audit. The
cheapest audit wins, the least by ASCII among equals. Finding it is a dynamic programme over what the repaired conversation ends in so far
(nothing, system, user, assistant). A step is a macro edit, a run of inserts and then one turn's edit; the macros' codes (D, ID, IID, IIK,
...) are prefix-free and numbered in ASCII order, so no audit string is held: in a layer, each end's best audit is its rank among the four, found from
the rank of the parent and the code's number, with a parent pointer from which the letters are read afterwards.

Conversations may be of any length. Rows are put into order by range, so that a long conversation lies in many partitions, and numbered; blocks of
at most 4,096 rows (2^bits) in a row are solved side by side for every end that the part before may have. What a block gives (16 costs, ranks and a byte of pointers a row and
pair) is then chained along each conversation in a stream that keeps four pointers a block; with each block's start and end known, the edits
are read in the blocks again. Only conversations that lie in several blocks then stream through one task each, batch by batch, for the
digest of their text, which by definition is a chain.

Rows: a null conv_id is a conversation of its own. Null roles and texts are one space, so such a text is blank. Rows are taken by turn (nulls first), then by
role and text; repeated rows are duplicates. A role counts by its first letter (s, u, a); an empty one has none. gaps beyond a long are given as the
greatest long. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import staged
from framelake.llm._words import lean

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow each end: its symbol is also the end that follows.
_ALLOWED = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
_INSERTED = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")
TAILS = ("", "I", "II")
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
FREE, GONE, CUT = range(3)
_NEVER = 1 << 40
_LONG = (1 << 63) - 1


def _after(end: int, inserts: int) -> int:
    for _ in range(inserts):
        end = _INSERTED[end]
    return end


def _table() -> np.ndarray:
    """[symbol, kind, new end, end * codes + code]: what the macro costs on such a turn, _NEVER if it doesn't lead there. Symbols: 0 for none of s, u, a."""
    out = np.full((4, 3, 4, 4 * len(CODES)), _NEVER, np.int64)
    for symbol in range(4):
        for kind in range(3):
            for end in range(4):
                for c, code in enumerate(CODES):
                    at, cost = _after(end, len(code) - 1), INSERT * (len(code) - 1)
                    if code[-1] == "D":
                        out[symbol, kind, at, end * len(CODES) + c] = cost + DELETE
                    elif kind != GONE:
                        cost += TRUNCATED * (kind == CUT)
                        if code[-1] == "R":
                            out[symbol, kind, _INSERTED[at], end * len(CODES) + c] = cost + REROLE
                        elif symbol in _ALLOWED[at]:
                            out[symbol, kind, symbol, end * len(CODES) + c] = cost
    return out


_COSTS = _table()
_ENDS, _NUMBERS = np.repeat(np.arange(4), len(CODES)), np.tile(np.arange(len(CODES)), 4)


def solve(symbol: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of turns (run i: first[i] to first[i + 1]): costs (run, start, end), ranks of the best audits among the ends of a
    start, and pointers (turn, start, end): 16 * parent + code."""
    n = len(first) - 1
    size = np.diff(first)
    cost = np.where(np.eye(4, dtype=bool), 0, _NEVER)[None].repeat(n, axis=0)
    rank = np.zeros((n, 4, 4), np.int64)
    back = np.zeros((len(symbol), 4, 4), np.uint8)
    order = np.argsort(-size, kind="stable")
    for t in range(int(size.max(initial=0))):
        on = order[: np.searchsorted(-size[order], -t)]  # runs longer than t
        turn = first[on] + t
        for a in range(0, len(on), 256):
            r, at = on[a : a + 256], turn[a : a + 256]
            own = cost[r][:, :, None, _ENDS] + _COSTS[symbol[at], kind[at]][:, None]
            key = (np.minimum(own, _NEVER) << 6) | (rank[r][:, :, None, _ENDS] << 4) | _NUMBERS
            pick = key.argmin(axis=3)
            best = np.take_along_axis(key, pick[..., None], 3)[..., 0]
            cost[r] = best >> 6
            back[at] = (_ENDS[pick] << 4) | _NUMBERS[pick]
            word = np.where(best >> 6 < _NEVER, best & 63, 64 + np.arange(4))
            rank[r] = (word[:, :, None, :] < word[:, :, :, None]).sum(axis=3)
    return cost, rank, back


def damage(conversations: DataFrame) -> DataFrame:
    """Faults by crc32 of conv_id:turn, modulo 20: 0 drops the row (no copies), 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it the user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(one("text"), STOPS, "")).otherwise(one("text"))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.when(hit == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def in_order(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text, copies), written in order of conversation and turn, with `at`, a number that grows along the order."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), one("role").alias("role"), one("text").alias("text"), copies.cast("int").alias("copies"))
    short = lambda c: F.substring(c, 1, 64)  # noqa: E731  the bounds of the ranges stay small; rows equal in these lie together
    ranged = rows.repartitionByRange("conv_id", "turn", short("role"), short("text")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return staged(ranged.withColumn("at", F.monotonically_increasing_id()))


_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_SOLVED = f"conv_id bigint, at bigint, back binary, cost array<bigint>, rank array<bigint>, {_COUNTS}, head int, last int, low bigint, high bigint, turns bigint"


def _runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with one conversation and block."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        start = _starts(t, bits)
        if len(start) > 1:
            yield t.slice(0, int(start[-1]))
        held = t.slice(int(start[-1])) if len(start) else None
    if held is not None and held.num_rows:
        yield held


def _values(t: pa.Table, name: str) -> np.ndarray:
    return t[name].fill_null(0).to_numpy()


def _starts(t: pa.Table, bits: int) -> np.ndarray:
    block, conv, null = _values(t, "at") >> bits, _values(t, "conv_id"), t["conv_id"].is_null().to_numpy()
    if not len(block):
        return np.zeros(0, np.int64)
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def _solve_runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches, bits):
        start = _starts(t, bits)
        n, copies = len(start), _values(t, "copies")
        run = np.repeat(np.arange(n), np.diff(np.append(start, t.num_rows)))
        row = np.repeat(np.arange(t.num_rows), copies)
        again = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
        blank, known, cut = (t[c].to_numpy()[row] for c in ("blank", "known", "cut"))
        twice = ~blank & (again | known)
        cut = cut & ~blank & ~twice
        symbol, owner = _values(t, "symbol")[row], run[row]
        first = np.searchsorted(owner, np.arange(n + 1))
        cost, rank, back = solve(symbol, np.where(blank | twice, GONE, np.where(cut, CUT, FREE)), first)
        good = np.zeros((4, 4), bool)
        good[SYSTEM, USER] = good[USER, ASSISTANT] = good[ASSISTANT, USER] = True
        bad = np.zeros(len(row), bool)
        bad[1:] = (owner[1:] == owner[:-1]) & ~good[symbol[:-1], symbol[1:]]
        count = lambda x: pa.array(np.bincount(owner[x], minlength=n))
        some = first[1:] > first[:-1]
        edge = lambda at: pa.array(np.where(some, symbol[np.clip(at, 0, max(len(symbol) - 1, 0))] if len(symbol) else 0, 0).astype(np.int32), mask=~some)
        dated = np.flatnonzero((copies > 0) & t["turn"].is_valid().to_numpy())
        turn, of = _values(t, "turn")[dated], run[dated]
        span = np.searchsorted(of, np.arange(n + 1))
        has = span[1:] > span[:-1]
        new = np.ones(len(dated), bool)
        new[1:] = (turn[1:] != turn[:-1]) | (of[1:] != of[:-1])
        rim = lambda at: pa.array(turn[np.clip(at, 0, max(len(turn) - 1, 0))] if len(turn) else np.zeros(n, np.int64), mask=~has)
        flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.array(x.ravel()))
        pointers = [back[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [t["conv_id"].take(pa.array(start)).combine_chunks(), pa.array(_values(t, "at")[start]), pa.array(pointers, pa.binary()), flat(cost), flat(rank),
             count(blank), count(twice), count(cut), count(bad), edge(first[:-1]), edge(first[1:] - 1), rim(span[:-1]), rim(span[1:] - 1), pa.array(np.bincount(of[new], minlength=n))],
            names=[x.split()[0] for x in _SOLVED.split(", ")],
        )


_CHAINED = f"at bigint, start int, end int, tail int, alone boolean, gaps bigint, {_COUNTS}, cost bigint"


class _Chain:
    """One conversation's blocks in order: the best way to each end so far, and what was counted."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.at, self.parents = conv_id, [], []
        self.best = [(0, 0), None, None, None]  # cost, rank
        self.counts, self.last, self.low, self.high, self.turns = [0, 0, 0, 0], None, None, None, 0

    def add(self, r: dict) -> None:
        found = []
        for end in range(4):
            ways = [(self.best[s][0] + r["cost"][4 * s + end], self.best[s][1], s) for s in range(4) if self.best[s] is not None and r["cost"][4 * s + end] < _NEVER]
            found.append(min(ways) if ways else None)
        word = [None if f is None else (f[1], r["rank"][4 * f[2] + end]) for end, f in enumerate(found)]
        ranks = sorted(w for w in word if w is not None)
        self.best = [None if f is None else (f[0], ranks.index(w)) for f, w in zip(found, word, strict=True)]
        self.at.append(r["at"])
        self.parents.append(bytes(0 if f is None else f[2] for f in found))
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += r[name]
        if r["head"] is not None:
            if self.last is not None:
                self.counts[3] += (self.last, r["head"]) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
            self.last = r["last"]
        if r["low"] is not None:
            self.turns += r["turns"] - (self.high == r["low"])
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]

    def rows(self) -> Iterator[tuple]:
        cost, _, tail, end = min((b[0] + INSERT * k, b[1], k, e) for e, b in enumerate(self.best) if b is not None for k in range(3) if _after(e, k) in (NOTHING, ASSISTANT))
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, _LONG)
        out = []
        for k in range(len(self.at) - 1, -1, -1):
            start, is_last = self.parents[k][end], k == len(self.at) - 1
            out.append((self.at[k], start, end, tail if is_last else 0, len(self.at) == 1, *((gaps, *self.counts, cost) if is_last else [None] * 6)))
            end = start
        return iter(out)


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in _CHAINED.split(", "))])
    chain, out = None, []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for b in batches:
        for r in b.to_pylist():
            if chain is None or chain.conv_id != r["conv_id"]:
                if chain is not None:
                    out.extend(chain.rows())
                chain = _Chain(r["conv_id"])
            chain.add(r)
        if len(out) > 4096:
            yield batch()
    if chain is not None:
        out.extend(chain.rows())
    if out:
        yield batch()


def solved(rows: DataFrame, bits: int = 12) -> DataFrame:
    """For the written rows of in_order: a row for each conversation in each block, at its first row, with its pointers, start and end; the last block of a
    conversation has its counts and cost."""
    known = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"))
    first = rows.filter("copies > 0").groupBy(known.alias("same")).agg(F.min("at").alias("at")).select("at", F.lit(False).alias("known"))
    symbol = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", SYSTEM, "u", USER, "a", ASSISTANT)]), F.substring("role", 1, 1)), F.lit(0))
    end = F.rtrim("text", F.lit(BLANKS))
    marks = rows.select("conv_id", "turn", "at", "copies", symbol.alias("symbol"), (F.length(end) == 0).alias("blank"), (~F.right(end, F.lit(1)).isin(*STOPS)).alias("cut"))
    marks = marks.join(first, "at", "left").withColumn("known", F.coalesce("known", F.lit(True)))
    blocks = marks.repartition(F.shiftright("at", bits)).sortWithinPartitions("at")
    parts = staged(blocks.select("conv_id", "turn", "at", "copies", "symbol", "blank", "cut", "known").mapInArrow(lean(lambda batches: _solve_runs(batches, bits)), _SOLVED))
    chained = parts.drop("back").repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(lean(_chain_blocks), _CHAINED)
    return staged(parts.select("conv_id", "at", "back").join(chained, "at"))


_EDITED = f"conv_id bigint, at bigint, done boolean, edits string, piece string, gaps bigint, {_COUNTS}, cost bigint"


def walk(back: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """(end before, code) of each turn, from the pointers of a block."""
    out, n = [], len(back) // 16
    for t in range(n - 1, -1, -1):
        b = back[16 * t + 4 * start + end]
        end = b >> 4
        out.append((end, b & 15))
    return out[::-1]


def _edit(end: int, code: str, role: str, text: str) -> list[tuple[str, str]]:
    """The turns (role, text) that a macro edit leaves of a turn."""
    turns = []
    for x in code:
        if x == "I":
            end = _INSERTED[end]
            turns.append((_ROLE[end], ""))
        elif x == "K":
            turns.append((role, text))
        elif x == "R":
            turns.append((_ROLE[_INSERTED[end]], text))
    return turns


def _edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict | None, str, list[tuple[str, str]]]]:
    """(conversation's row in this block, turn, letters, turns left of it); first of all once without a turn. Inserts at the very end go with the last turn."""
    head, steps, used = None, [], 0
    for b in batches:
        for r in b.to_pylist():
            if r["back"] is not None:
                head, steps, used = r, walk(r["back"], r["start"], r["end"]), 0
                alone = [] if steps else _edit(r["end"], TAILS[r["tail"]], "", "")
                yield head, None, "" if steps else TAILS[r["tail"]], alone
                continue
            edits, left = "", []
            for _ in range(r["copies"]):
                end, code = steps[used]
                used += 1
                edits += CODES[code]
                left += _edit(end, CODES[code], r["role"], r["text"])
            if r["copies"] and used == len(steps):
                edits += TAILS[head["tail"]]
                left += _edit(head["end"], TAILS[head["tail"]], "", "")
            yield head, r, edits, left


class _Digest:
    """SHA-256 of turns as role:text, joined by newlines."""

    def __init__(self):
        self.sha, self.empty, self.audit = hashlib.sha256(), True, []

    def add(self, edits: str, lines: str | None) -> None:
        self.audit.append(edits)
        if lines is not None:
            self.sha.update((b"" if self.empty else b"\n") + lines.encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self, r: dict) -> list:
        return [r["conv_id"], r["at"], True, "".join(self.audit), self.sha.hexdigest(), *[r[c] for c in _TOTALS]]


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_NAMES = [x.split()[0] for x in _EDITED.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 6]


def _batched(rows: Iterator[list], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, str))
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _lines(turns: list[tuple[str, str]]) -> str | None:
    return "\n".join(f"{role}:{text}" for role, text in turns) if turns else None


def _read_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation in one block comes as one row, its digest; else each turn with its letters and lines, and the totals with the first of the last block."""

    def rows() -> Iterator[list]:
        now, digest = None, None
        for head, turn, edits, left in _edits_of(batches):
            if turn is None and digest is not None:
                yield digest.row(now)
            if turn is None:
                now, digest = head, _Digest() if head["alone"] else None
            if digest is not None:
                digest.add(edits, _lines(left))
            elif turn is None and (edits or head["cost"] is not None):
                yield [head["conv_id"], head["at"], False, edits, _lines(left), *[head[c] for c in _TOTALS]]
            elif edits:
                yield [head["conv_id"], turn["at"], False, edits, _lines(left), *[None] * 6]
        if digest is not None:
            yield digest.row(now)

    yield from _batched(rows(), _NAMES, _TYPES)


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's pieces in order, to one row: only its audit and the state of its digest are held."""

    def rows() -> Iterator[list]:
        now, digest = None, None
        for b in batches:
            for r in b.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield digest.row(now)
                    now, digest = r, _Digest()
                if r["cost"] is not None:
                    now = r
                digest.add(r["edits"], r["piece"])
        if now is not None:
            yield digest.row(now)

    yield from _batched(rows(), _NAMES, _TYPES)


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ([head["conv_id"], (turn or head)["at"], k, role, text] for head, turn, _, left in _edits_of(batches) for k, (role, text) in enumerate(left))
    yield from _batched(rows, ["conv_id", "at", "part", "role", "text"], [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()])


def _with_edits(turns: DataFrame, bits: int) -> DataFrame:
    """By block, in order: a conversation's row with pointers, start and end, then its turns."""
    rows = in_order(turns)
    blocks = solved(rows, bits).withColumn("kind", F.lit(0)).unionByName(rows.select("conv_id", "at", "role", "text", "copies", F.lit(1).alias("kind")), allowMissingColumns=True)
    return blocks.repartition(F.shiftright("at", bits)).sortWithinPartitions("at", "kind")


def repaired_turns(turns: DataFrame, bits: int = 12) -> DataFrame:
    """conv_id, at, part, role, text of the repaired turns, in order of (at, part) in each conversation; no conversation is gathered in one task."""
    return _with_edits(turns, bits).mapInArrow(lean(_left), "conv_id bigint, at bigint, part int, role string, text string")


def repair(turns: DataFrame, bits: int = 12) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of turns (conv_id, turn, role, text, and
    copies, 1 if absent; a conversation without any copy has zeros)."""
    found = staged(_with_edits(turns, bits).mapInArrow(lean(_read_edits), _EDITED))
    long = found.filter("not done").repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(lean(_stream_digests), _EDITED)
    return found.filter("done").unionByName(long).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"), F.col("piece").alias("repaired_sha256"))
