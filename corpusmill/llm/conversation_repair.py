"""Cheapest repair of conversations to an optional system turn and pairs of user and assistant turns.

A row is kept, given another role or deleted, and turns without text are inserted anywhere. Of the cheapest repairs the one
whose letters (D delete, I insert, K keep, R role) come first in ASCII order is taken. A dynamic programme goes over the rows
with four states: nothing yet, after a system, a user, an assistant turn. Its steps are macro edits, a run of inserts and
what becomes of the row. Their codes, such as ``IK``, are prefix-free, so that sequences of macro edits order as their letters
do; each layer therefore keeps, instead of strings, the rank of each state's best sequence among the states and a pointer to
its parent, and a new rank follows from (rank of the parent, rank of the code). Letters are written once, from the end back.
A run of three inserts or more passes a state twice and is never cheapest.

Costs of a layer matter only relative to its least, so few different layers exist and a step is looked up. Rows are sorted
by range and cut into chunks of at most ``CHUNK`` rows. Where a conversation has several, a chunk is summed up by cost and
rank for each pair of states before and after it; sums of ``GROUP`` neighbours are joined, round by round, until one is left,
and the states chosen go back down. So no task holds a conversation, however long it is. The repaired rows are then read in
order, as a stream: the hash of a conversation's text is one chain by its nature, taken in constant memory.

Edge cases (tested): a null role or text is one space, a null turn stands first, and a null conversation is one; rows of one
turn stand in order of role and text; a role of another initial than s, u, a, or an empty one, can't be kept; rows that
repeat in role and text are deleted but for the first; texts of any length are read whole; a conversation without rows gives
zeros; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common
from corpusmill.llm.merkle import CRC, CRC_TABLE

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a chunk and sums joined at once, at most.
CHUNK = 4096
GROUP = 4096

#: States: nothing yet, after a system, a user, an assistant turn. What an inserted turn leads to, and where a repair may end.
_START, _S, _U, _A = range(4)
_NEXT = (_U, _U, _A, _U)
_ENDS = (_START, _A)
_ROLE = {_U: b"user", _A: b"assistant"}
_INITIAL = {"s": _S, "u": _U, "a": _A}
_CODES = sorted("I" * runs + letter for runs in range(3) for letter in "DKR")
#: A row that has to be deleted.
_GONE = "-"
_SPACE = " \t\n\x0b\f\r"

_CHUNKS = "conv long, place long, piece string, cost long"
_SUMS = "conv long, index long, n long, costs array<long>, ranks array<int>"
_TARGETS = "conv long, block long, start int, stop int, tail int"
_REPAIRED = "conv_id long, position long, turn long, role string, text string, edit string"
_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache
def _moves(symbol: str) -> list[list[tuple[int, int, int]]]:
    """(rank of the code, cost, state after) of all macro edits of a row, from each state.

    A symbol is the role's initial (x for any other), a capital if the row is truncated.
    """
    out = []
    for state in range(4):
        found, at = [], state
        for runs in range(3):
            cost, code = runs * INSERT, "I" * runs
            found.append((_CODES.index(code + "D"), cost + DELETE, at))
            if symbol != _GONE:
                cost += TRUNCATED if symbol.isupper() else 0
                own = _INITIAL.get(symbol.lower())
                if own is not None and (own == _NEXT[at] or (own == _S and at == _START)):
                    found.append((_CODES.index(code + "K"), cost + KEEP, own))
                found.append((_CODES.index(code + "R"), cost + REROLE, _NEXT[at]))
            at = _NEXT[at]
        out.append(found)
    return out


def _ranked(best: list) -> tuple:
    """Ranks of the states by (rank of the parent, rank of the code)."""
    order = sorted((b[1:3], q) for q, b in enumerate(best) if b)
    ranks = [-1] * 4
    for rank, (_, q) in enumerate(order):
        ranks[q] = rank
    return tuple(ranks)


@lru_cache(maxsize=1 << 16)
def _step(costs: tuple, ranks: tuple, symbol: str) -> tuple[int, tuple, tuple, tuple]:
    """The next layer: its least cost, costs above that (-1: out of reach), ranks, and (parent, code) of each state."""
    best = [None] * 4
    moves = _moves(symbol)
    for p in range(4):
        if costs[p] >= 0:
            for code, cost, q in moves[p]:
                found = (costs[p] + cost, ranks[p], code, p)
                if best[q] is None or found < best[q]:
                    best[q] = found
    least = min(b[0] for b in best if b)
    return least, tuple(b[0] - least if b else -1 for b in best), _ranked(best), tuple((b[3], b[2]) if b else None for b in best)


def _layers(symbols: str, start: int) -> tuple[list[tuple], list[int], tuple]:
    """Pointers of all layers, and costs and ranks of the last."""
    costs, ranks, total, pointers = tuple(0 if q == start else -1 for q in range(4)), tuple(0 if q == start else -1 for q in range(4)), 0, []
    for symbol in symbols:
        least, costs, ranks, pointer = _step(costs, ranks, symbol)
        total += least
        pointers.append(pointer)
    return pointers, [c + total if c >= 0 else -1 for c in costs], ranks


def _last(costs: list[int], ranks: list[int]) -> tuple[int, int]:
    """The state in which the cheapest repair leaves the last row, and the number of inserts after it."""
    found = []
    for q in range(4):
        at = q
        for runs in range(3):
            if costs[q] >= 0 and at in _ENDS:
                found.append((costs[q] + runs * INSERT, ranks[q], runs, q))
            at = _NEXT[at]
    _, _, runs, q = min(found)
    return q, runs


def _letters(pointers: list[tuple], stop: int, tail: int) -> str:
    """The edits that lead to a state, from the end back."""
    out, q = [], stop
    for pointer in reversed(pointers):
        q, code = pointer[q]
        out.append(_CODES[code])
    return "".join(reversed(out)) + "I" * tail


def cheapest(symbols: str) -> tuple[str, int]:
    """Letters and cost of the repair of a whole conversation."""
    pointers, costs, ranks = _layers(symbols, _START)
    stop, tail = _last(costs, ranks)
    return _letters(pointers, stop, tail), costs[stop] + tail * INSERT


def _joined(costs: list[int], ranks: list[int], more_costs: list[int], more_ranks: list[int]) -> tuple[list[int], list[int], list[int]]:
    """A layer carried over a sum (16 costs and ranks, by state before and after): costs, ranks and parents."""
    best = [None] * 4
    for p in range(4):
        for q in range(4):
            cost = more_costs[4 * p + q]
            if costs[p] >= 0 and cost >= 0:
                found = (costs[p] + cost, ranks[p], more_ranks[4 * p + q], p)
                if best[q] is None or found < best[q]:
                    best[q] = found
    return [b[0] if b else -1 for b in best], list(_ranked(best)), [b[3] if b else -1 for b in best]


def _sum_of(symbols: str) -> tuple[list[int], list[int]]:
    costs, ranks = [], []
    for start in range(4):
        _, c, r = _layers(symbols, start)
        costs += c
        ranks += r
    return costs, ranks


def _summed(it):
    for conv, index, n, symbols in common.column_batches(it, "conv", "index", "n", "symbols"):
        found = [_sum_of(s) for s in symbols.to_pylist()]
        yield pa.RecordBatch.from_arrays([conv, index, n, pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["conv", "index", "n", "costs", "ranks"])


def _group_sum(size: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("at").to_pylist()
        costs, ranks = [], []
        for start in range(4):
            c, r = [0 if q == start else -1 for q in range(4)], [0 if q == start else -1 for q in range(4)]
            for row in rows:
                c, r, _ = _joined(c, r, row["costs"], row["ranks"])
            costs += c
            ranks += r
        one = rows[0]
        columns = [pa.array([one["conv"]], pa.int64()), pa.array([one["block"]], pa.int64()), pa.array([-(-one["n"] // size)], pa.int64()), pa.array([costs], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.int32()))]
        return pa.table(columns, names=["conv", "index", "n", "costs", "ranks"])

    return run


def _group_targets(group: pa.Table, above: pa.Table) -> pa.Table:
    """The states before and after each sum of a group, given the group's own."""
    rows, above = group.sort_by("at").to_pylist(), above.to_pylist()[0]
    costs, ranks = [0 if q == above["start"] else -1 for q in range(4)], [0 if q == above["start"] else -1 for q in range(4)]
    parents = []
    for row in rows:
        costs, ranks, parent = _joined(costs, ranks, row["costs"], row["ranks"])
        parents.append(parent)
    out, stop = [], above["stop"]
    for i in range(len(rows) - 1, -1, -1):
        out.append((rows[i]["conv"], rows[i]["index"], parents[i][stop], stop, above["tail"] if i == len(rows) - 1 else 0))
        stop = parents[i][stop]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", "block", "start", "stop", "tail"])


def _whole(it):
    """Chunks that are whole conversations."""
    for conv, place, symbols in common.column_batches(it, "conv", "place", "symbols"):
        found = [cheapest(s) for s in symbols.to_pylist()]
        yield pa.RecordBatch.from_arrays([conv, place, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["conv", "place", "piece", "cost"])


def _parts(it):
    """Chunks of longer conversations, by the states before and after them."""
    for conv, place, symbols, start, stop, tail in common.column_batches(it, "conv", "place", "symbols", "start", "stop", "tail"):
        pieces, cost = [], []
        for s, a, b, t in zip(symbols.to_pylist(), start.to_pylist(), stop.to_pylist(), tail.to_pylist(), strict=True):
            pointers, costs, _ = _layers(s, a)
            pieces.append(_letters(pointers, b, t))
            cost.append(costs[b] + t * INSERT)
        yield pa.RecordBatch.from_arrays([conv, place, pa.array(pieces, pa.string()), pa.array(cost, pa.int64())], names=["conv", "place", "piece", "cost"])


def _pieces(chunks: DataFrame, group: int) -> DataFrame:
    """conv, place, piece, cost: the letters of each chunk of rows."""
    whole = chunks.filter("n = 1").mapInArrow(_whole, _CHUNKS)
    long = chunks.filter("n > 1")
    if long.isEmpty():
        return whole
    rounds = [common.durable(_numbered(long.mapInArrow(_summed, _SUMS), group))]
    while True:
        sums = common.durable(rounds[-1].groupBy("conv", "block").applyInArrow(_group_sum(group), _SUMS))
        if sums.agg(F.max("n")).first()[0] == 1:
            break
        rounds.append(_numbered(sums, group))
    last = F.udf(lambda c, r: _last(c[:4], r[:4]), "struct<stop: int, tail: int>")  # one row a long conversation
    targets = sums.withColumn("last", last("costs", "ranks")).select("conv", F.lit(0).cast("long").alias("block"), F.lit(_START).alias("start"), "last.stop", "last.tail")
    for sums in reversed(rounds):
        targets = common.durable(sums.groupBy("conv", "block").cogroup(targets.groupBy("conv", "block")).applyInArrow(_group_targets, _TARGETS))
    targets = targets.withColumnsRenamed({"conv": "its_conv", "block": "its_index"})
    met = long.join(targets, F.col("conv").eqNullSafe(F.col("its_conv")) & (F.col("index") == F.col("its_index")))
    return whole.unionByName(met.mapInArrow(_parts, _CHUNKS))


def _numbered(sums: DataFrame, group: int) -> DataFrame:
    return sums.withColumn("block", F.floor(F.col("index") / group).cast("long")).withColumn("at", (F.col("index") % group).cast("int"))


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _stream(rows: DataFrame, names: DataFrame, chunk: int, group: int) -> DataFrame:
    """What a task reads to write a conversation out, sorted: one record a conversation (kind 0), one before each chunk of
    rows (1), and the rows (2)."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c)
    placed = rows.select(F.col("`conv_id`").cast("long").alias("conv"), F.col("`turn`").cast("long").alias("turn"), space("role"), space("text"))
    keys = ["conv", "turn", "role", "text"]
    placed = common.durable(placed.repartitionByRange(common.partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    initial = F.substring("role", 1, 1)
    slim = placed.select(
        "conv", "place", _blank(F.col("text")).alias("is_blank"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (~F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1)).isin(".", "!", "?")).alias("is_truncated"), F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256).alias("digest"),
    )
    # a row is a duplicate unless it is the first of its role and text; places are unique, so nothing is hot in the join
    first = slim.filter("not is_blank").groupBy("conv", "digest").agg(F.min("place").alias("first_place")).select("first_place")
    marked = slim.drop("digest").join(first, F.col("place") == F.col("first_place"), "left")
    marked = marked.withColumn("is_duplicate", ~F.col("is_blank") & F.col("first_place").isNull()).withColumn("is_truncated", F.col("is_truncated") & ~F.col("is_blank") & ~F.col("is_duplicate"))
    symbol = F.when(F.col("is_blank") | F.col("is_duplicate"), F.lit(_GONE)).when(F.col("is_truncated"), F.upper("initial")).otherwise(F.col("initial"))
    block = F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / chunk)
    n = lambda c: F.count(F.when(F.col(f"is_{c}"), 1)).alias(c)
    chunks = (
        marked.groupBy("conv", F.shiftright("place", 33).alias("part"), block.alias("rows"))
        .agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", symbol.alias("symbol")))).alias("items"), n("blank"), n("duplicate"), n("truncated"))
        .withColumn("symbols", F.array_join("items.symbol", "")).drop("items", "part", "rows")
    )
    chunks = _chunk_numbers(common.durable(chunks))
    pieces = _pieces(chunks, group).withColumnsRenamed({"conv": "piece_conv", "place": "piece_place"})
    told = chunks.join(pieces, F.col("place") == F.col("piece_place"))
    none = lambda **columns: [F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]
    counts = ["blank", "duplicate", "truncated", "cost"]
    zero, body = [F.lit(0).cast("long").alias(c) for c in counts], {"turn": "long", "role": "string", "text": "string"}
    records = placed.select("conv", "place", F.lit(2).alias("kind"), *body, *none(piece="string"), *zero)
    records = records.unionByName(told.select("conv", "place", F.lit(1).alias("kind"), *none(**body), "piece", *counts))
    records = records.unionByName(names.select(F.col("`conv_id`").cast("long").alias("conv")).distinct().select("conv", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("kind"), *none(**body), *none(piece="string"), *zero))
    return records.repartition("conv").sortWithinPartitions("conv", "place", "kind")


def _chunk_numbers(chunks: DataFrame) -> DataFrame:
    """``chunks`` with index, the number of a chunk in its conversation, and n, the conversation's chunks.

    Most conversations are one chunk; those of more are numbered from range partitions, as there may be any number of chunks.
    """
    several = common.durable(chunks.groupBy("conv").count().filter("count > 1").select(F.col("conv").alias("several_conv")))
    same = F.col("conv").eqNullSafe(F.col("several_conv"))
    one = chunks.join(several, same, "left_anti").withColumn("index", F.lit(0).cast("long")).withColumn("n", F.lit(1).cast("long"))
    if several.isEmpty():
        return one
    long = common.numbered(chunks.join(several, same, "left_semi"), "conv", ["place"])
    return common.durable(one.unionByName(long))


class _Conversation:
    """One conversation while it is written out: what its rows become, and its figures."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.pieces, self.piece, self.at = conv, _START, [], "", 0
        self.counts, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns, self.position = 0, 0

    def chunk(self, piece: str, counts: list[int]) -> None:
        self.pieces.append(piece)
        self.piece, self.at = piece, 0
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]

    def _inserted(self) -> Iterator[tuple]:
        while self.at < len(self.piece) and self.piece[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield None, _ROLE[self.state], b"", "I"

    def row(self, turn: int | None, role: bytes, text: bytes) -> Iterator[tuple]:
        """(turn, role, text, edit) of what stands where the row stood."""
        initial = role.decode(errors="replace")[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.turns, self.high, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        yield from self._inserted()
        letter = self.piece[self.at]
        self.at += 1
        if letter == "K":
            self.state = _INITIAL[initial]
            yield turn, role, text, letter
        elif letter == "R":
            self.state = _NEXT[self.state]
            yield turn, _ROLE[self.state], text, letter

    def ended(self) -> Iterator[tuple]:
        yield from self._inserted()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_NAMES = ("conv", "kind", "turn", "role", "text", "piece", "blank", "duplicate", "truncated", "cost")


def _conversations(it) -> Iterator[tuple[_Conversation, Iterator[tuple], bool]]:
    """(conversation, what is to be written next, whether it ends) along the sorted records."""
    now = None
    for conv, kind, turn, role, text, piece, *counts in common.column_batches(it, *_NAMES):
        for v, k, t, r, x, p, *c in zip(conv.to_pylist(), kind.to_pylist(), turn.to_pylist(), common.raw(role), common.raw(text), piece.to_pylist(), *[c.to_pylist() for c in counts], strict=True):
            if now is None or now.conv != v:
                if now is not None:
                    yield now, now.ended(), True
                now = _Conversation(v)
            if k == 1:
                now.chunk(p, c)
            elif k == 2:
                yield now, now.row(t, r, x), False
    if now is not None:
        yield now, now.ended(), True


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (the last item: their bytes) in batches of bounded size."""
    held, size = [], 0
    for *row, weight in rows:
        held.append(row)
        size += weight + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _written(it):
    def rows():
        for conversation, turns, _ in _conversations(it):
            for turn, role, text, edit in turns:
                yield conversation.conv, conversation.position, turn, role, text, edit, len(text)
                conversation.position += 1

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
    for batch in _batches(rows(), kinds, ["conv_id", "position", "turn", "role", "text", "edit"]):
        yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_binary(c.type) else c for c in batch.columns], names=batch.schema.names)


def _audited(it):
    def rows():
        digest = sha256()
        for conversation, turns, ends in _conversations(it):
            for _, role, text, _ in turns:
                digest.update((b"\n" if conversation.position else b"") + role + b":")
                digest.update(text)
                conversation.position += 1
            if ends:
                blank, duplicate, truncated, cost = conversation.counts
                audit = "".join(conversation.pieces)
                yield conversation.conv, conversation.gaps(), blank, duplicate, truncated, conversation.illegal, cost, audit, digest.hexdigest(), len(audit)
                digest = sha256()

    yield from _batches(rows(), [pa.int64()] * 7 + [pa.string()] * 2, ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def repaired(rows: DataFrame, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """conv_id, position (from 0), turn (null: inserted), role, text and edit of the repaired conversations of ``rows``
    (conv_id, turn, role, text)."""
    return _stream(rows, rows, chunk, group).mapInArrow(_written, _REPAIRED)


def audited(rows: DataFrame, names: DataFrame, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """One row for each conv_id of ``names``: faults found in ``rows``, cost and letters of the repair, and the hash of what
    ``repaired`` gives, written ``role:text`` and joined by newlines."""
    return _stream(rows, names, chunk, group).mapInArrow(_audited, _AUDIT)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, by the crc32 of ``conv_id:turn``."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("kind"), F.explode(times).alias("time"))
    return rows.filter("kind != 0").drop("kind", "time")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.plain(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    return audited(damaged(conversations), conversations)


_SPACED = "coalesce({}, ' ')"
_BLANK = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
_ROWS = r"""r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS time FROM k WHERE kind <> 0)"""


def _op11_sql() -> str:
    """Layers of the programme with their letters spelt out, row by row: a state is its cheapest (cost, letters, text)."""
    add = lambda st, cost, letters, out: f"{{'c': {st}.c + {cost}, 'a': {st}.a || {letters}, 'o': {st}.o || {out}}}"
    put = lambda st, role: f"(CASE WHEN {st}.o = '' THEN '' ELSE chr(10) END || {role})"
    # inserts: from each state one turn on, then a second one
    one = {0: ("s2", "'user:'"), 1: ("s2", "'user:'"), 2: ("s3", "'assistant:'"), 3: ("s2", "'user:'")}
    runs = []
    for p in range(4):
        q, role = one[p]
        runs.append((p, f"s{p}"))
        first = add(f"s{p}", 3, "'I'", put(f"s{p}", role))
        runs.append((int(q[1]), first))
        q2, role2 = one[int(q[1])]
        runs.append((int(q2[1]), add(f"({first})", 3, "'I'", put(f"({first})", role2))))
    kept: dict[int, list[str]] = {q: [] for q in range(4)}
    body = "(role || ':' || text)"
    for q, st in runs:
        st = f"({st})"
        kept[q].append(add(st, 4, "'D'", "''"))
        to = int(one[q][0][1])
        letter = {2: "'u'", 3: "'a'"}[to]
        alive = "fault IN ('', 't')"
        kept[to].append(f"CASE WHEN {alive} AND role[1] = {letter} THEN " + add(st, "extra", "'K'", put(st, body)) + " END")
        if q == 0:
            kept[1].append(f"CASE WHEN {alive} AND role[1] = 's' THEN " + add(st, "extra", "'K'", put(st, body)) + " END")
        kept[to].append(f"CASE WHEN {alive} THEN " + add(st, "3 + extra", "'R'", put(st, f"({one[q][1]} || text)")) + " END")
    layer = ", ".join(f"list_sort(list_filter([{', '.join(kept[q])}], lambda x: x.c IS NOT NULL))[1] AS s{q}" for q in range(4))
    ends = [f"({st})" for q, st in runs if q in (0, 3)]
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"
    return rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
k AS (SELECT conv_id, turn, {_SPACED.format('role')} AS role, {_SPACED.format('text')} AS text,
  {CRC.format(text="(" + _SPACED.format('CAST(conv_id AS VARCHAR)') + " || ':' || " + _SPACED.format('CAST(turn AS VARCHAR)') + ")")} % 20 AS kind FROM conversations, crc),
{_ROWS},
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS i FROM r),
f AS (SELECT *, CASE WHEN {_BLANK} THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
g AS (SELECT *, CASE fault WHEN 't' THEN 3 ELSE 0 END AS extra FROM f),
x AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
  count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
l(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'o': ''}}, {none}, {none}, {none} FROM x
  UNION ALL SELECT l.conv_id, g.i, {layer} FROM l JOIN g ON l.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = l.i + 1),
e AS (SELECT x.*, list_sort(list_filter([{', '.join(ends)}], lambda x: x.c IS NOT NULL))[1] AS best FROM x JOIN l ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.n = l.i)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP11_SQL = _op11_sql()
