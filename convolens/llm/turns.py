"""Conversation structure repair: the cheapest edits, by an auction for shortest paths.

A conversation's rows and the states of its roles (nothing yet, after system, after user, after assistant) span a
lattice: keeping, re-roling or deleting a row steps to the next row, inserting one stays at it. Costs are integers.
Every node has a price, at first a lower bound of what is left to pay. A path grows from an origin: where its last
node's price is below the least of arc cost plus price of the arc's end, the price rises to that and the path
contracts, else it extends along that arc. It ends at a node whose price has settled, and its own nodes are then
settled too. Origins are taken from the last row to the first, so each path is short. Settled prices are the costs
of the cheapest way on; arcs whose price difference is their cost are tight, every cheapest sequence of edits is a path of
tight arcs, and the least one by letters follows the tight arc with the least letter. The letters decide the nodes, so
no two arcs of a node tie.

Rows are sorted over all conversations in ranges, which no large conversation can fill up: it goes on in the next
range, and in pieces of `rows` rows within one. A conversation inside a range is solved where it lies. Of the others
each piece becomes a matrix of prices from each state at its start to each at its end; prices go back over the pieces
of a conversation, entry states forward, a few numbers per piece, and each piece is traced alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from convolens.llm import common as C

#: What edits cost.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NONE = 1 << 40
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The initial that a kept row needs, and the next state.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEEDS = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: The cheapest way to end, from each state, with inserted rows.
END = (0, 2 * INSERT, INSERT, 0)
STATES = range(4)

#: A row as a letter: d must go; s, u, a by initial and x for any other; in capitals if truncated.
_FLOOR = {"d": DELETE, "x": RENAME, "X": DELETE, "S": TRUNCATED, "U": TRUNCATED, "A": TRUNCATED}


class Lattice:
    """Prices of all nodes (row, state) of a piece, where leaving it in a state costs `ends` of that state."""

    def __init__(self, rows: str, ends: tuple[int, ...]):
        self.rows, self.ends, self.n = rows, ends, len(rows)
        floor = [min(ends)] * 4
        self.price = floor[:]
        for letter in reversed(rows):
            floor = [f + _FLOOR.get(letter, 0) for f in floor]
            self.price[:0] = floor
        self.arcs = [self._arcs(v) for v in range(4 * self.n)]
        self.price[4 * self.n :] = ends
        settled = bytearray(4 * self.n) + b"\1" * 4
        for row in range(self.n - 1, -1, -1):
            for state in STATES:
                self._auction(4 * row + state, settled)

    def _arcs(self, v: int) -> list[tuple[str, int, int]]:
        """(letter, cost, end) of each arc of a node, by letter."""
        row, state = divmod(v, 4)
        letter, need = self.rows[row], NEEDS[state]
        extra = TRUNCATED if letter in "SUAX" else 0
        out = [("D", DELETE, v + 4), ("I", INSERT, v - state + need)]
        if letter != "d":
            keep = KEEPS[state].get(letter.lower())
            if keep is not None:
                out.append(("K", extra, v + 4 - state + keep))
            out.append(("R", RENAME + extra, v + 4 - state + need))
        return out

    def _auction(self, origin: int, settled: bytearray) -> None:
        price, arcs, path = self.price, self.arcs, [origin]
        while not settled[path[-1]]:
            v = path[-1]
            best, to = NONE, v
            for _, cost, end in arcs[v]:
                if cost + price[end] < best:
                    best, to = cost + price[end], end
            if best >= NONE:
                price[v], settled[v] = NONE, 1
                break
            if price[v] < best:
                price[v] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        else:
            for v in path:
                settled[v] = 1

    def trace(self, state: int) -> tuple[str, int]:
        """The letters of the least cheapest edits from a state on, and the state at the end."""
        v, letters = state, []
        while v < 4 * self.n:
            letter, _, v = next(a for a in self.arcs[v] if self.price[v] == a[1] + self.price[a[2]])
            letters.append(letter)
        return "".join(letters), v % 4


def finish(state: int) -> str:
    """Rows inserted at the end of a conversation."""
    return "I" * (END[state] // INSERT)


_SOLVED: dict[str, tuple[int, str]] = {}
C.held(_SOLVED.clear)


def cheapest(rows: str) -> tuple[int, str]:
    """Cost and letters of a whole conversation's edits. Conversations of one form are solved once per worker."""
    if rows not in _SOLVED:
        if len(_SOLVED) >= 1 << 15:
            _SOLVED.clear()
        lattice = Lattice(rows, END)
        letters, state = lattice.trace(0)
        _SOLVED[rows] = lattice.price[0] if rows else 0, letters + finish(state)
    return _SOLVED[rows]


def matrix(rows: str) -> list[int]:
    """The cheapest way through a piece from each state to each, NONE where there is none."""
    out = [NONE] * 16
    for end in STATES:
        # Only states from which the end can be reached, so that no price rises for ever.
        part = _Upto(rows, tuple(0 if s == end else NONE for s in STATES), end)
        for state in STATES:
            if end > 1 or state <= end:
                out[4 * state + end] = min(NONE, part.price[state])
    return out


class _Upto(Lattice):
    def __init__(self, rows: str, ends: tuple[int, ...], end: int):
        self.states = STATES if end > 1 else range(end + 1)
        super().__init__(rows, ends)

    def _arcs(self, v):
        return [a for a in super()._arcs(v) if a[2] % 4 in self.states] if v % 4 in self.states else []


def edited(letters: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that edits make of rows, from a state on."""
    out, i = [], 0
    for letter in letters:
        if letter == "I":
            state = NEEDS[state]
            out.append(f"{ROLES[state]}:")
            continue
        if letter == "K":
            state = KEEPS[state][roles[i][0]]
            out.append(f"{roles[i]}:{texts[i]}")
        elif letter == "R":
            state = NEEDS[state]
            out.append(f"{ROLES[state]}:{texts[i]}")
        i += 1
    return out


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, live: rows with one of twenty faults by the hash of conversation and turn; nulls are one space.

    0: gone (a row that is not `live`, so that its conversation is known), 1: no text, 2: no marks at sentences' ends,
    3: twice, 4: from the user; else as it was.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col)).cast("binary")) % 20
    out = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"), fault.alias("fault")
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return out.select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") != 0).alias("live"),
        F.explode(F.array_repeat(F.lit(0), times)),
    ).drop("col")


_ROW = "turn long, role string, text string, letter string, key string"
_COUNTS = "blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, first_turn long, last_turn long, first string, last string, n long"


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the letter of their own faults (b blank; else by initial, in capitals if truncated) and a key of role and text."""
    cut = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(cut == "", "b").when(F.right(cut, F.lit(1)).isin(".", "!", "?"), plain).otherwise(F.upper(plain))
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    return rows.select("conv", "turn", F.when(F.col("live"), F.col("role")).alias("role"), F.when(F.col("live"), F.col("text")).alias("text"), letter.alias("letter"), key.alias("key"), "live")


def _counts(rows: list[tuple], letters: str) -> dict:
    """What a piece adds to its conversation's counts; letters: as for Lattice, with b for blank."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {
        "blank": letters.count("b"), "duplicate": letters.count("d"), "truncated": sum(c in "SUAX" for c in letters),
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
        "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)),
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None, "n": len(rows),
    }


def _repeated(rows: list[tuple], seen: set) -> str:
    """The rows' letters with d for those whose role and text are in `seen` or came before."""
    out = []
    for _, _, _, letter, key in rows:
        if letter != "b" and key in seen:
            letter = "d"
        elif letter != "b":
            seen.add(key)
        out.append(letter)
    return "".join(out)


def _pieces(marked: DataFrame, size: int) -> DataFrame:
    """conv, part, seq, done, then counts, cost, audit and lines of whole conversations, or the rows of pieces."""
    conv_type = marked.schema["conv"].dataType
    row = f"array<struct<{_ROW.replace(' long', ': bigint').replace(' string', ': string')}>>"
    counts = _COUNTS.replace(" long", ": bigint").replace(" string", ": string")
    schema = StructType.fromDDL(
        f"conv {conv_type.simpleString()}, part int, seq int, done boolean, counts struct<{counts}>, cost long, audit string, lines array<string>, rows {row}"
    )
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[tuple] = []
        conv, seq, opened, first, any_row = None, 0, 0, True, False
        bytes_out = 0

        def piece(whole: bool) -> None:
            nonlocal held, seq, bytes_out
            record = {"conv": conv, "part": part, "seq": seq, "done": whole, "counts": None, "cost": None, "audit": None, "lines": None, "rows": None}
            if whole:
                letters = _repeated(held, set())
                cost, audit = cheapest(letters.replace("b", "d"))
                lines = edited(audit, 0, [r[1] for r in held], [r[2] for r in held])
                record |= {"counts": _counts(held, letters), "cost": cost, "audit": audit, "lines": lines}
            else:
                record["rows"] = [dict(zip(("turn", "role", "text", "letter", "key"), r)) for r in held]
            out.append(record)
            bytes_out += sum(len(r[2]) for r in held)
            held, seq = [], seq + 1

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out, bytes_out
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow_schema)
                out, bytes_out = [], 0

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for key, *values, live in zip(*columns):
                if not any_row or key != conv:
                    if any_row:
                        # The first conversation of a range may have begun in the one before.
                        piece(not first and not opened)
                        first = False
                    conv, opened, any_row = key, 0, True
                if live:
                    held.append(tuple(values))
                    if len(held) == size:
                        piece(False)
                        opened += 1
            if len(out) >= 1000 or bytes_out > 16 * C.PIECE:
                yield from flush()
        if any_row:
            piece(False)
        yield from flush()

    n = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.monotonically_increasing_id().alias("tie")
    sort = [F.col("conv"), F.col("turn"), F.col("role"), F.col("key"), F.col("tie")]
    ranged = marked.select("*", tie).repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    return ranged.select("conv", "turn", "role", "text", "letter", "key", "live").mapInArrow(run, schema)


def _by_conversation(df: DataFrame, descending: bool = False) -> DataFrame:
    """A conversation's pieces behind one another in one task, to be streamed."""
    order = [F.col(c).desc() if descending else F.col(c) for c in ("part", "seq")]
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(records: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for record in records:
        held.append(record)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, fn, ddl: str) -> DataFrame:
    """Rows of fn(iterator of rows as dicts)."""
    schema = StructType.fromDDL(ddl)
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        yield from _batched(fn(_rows_of(batches)), arrow_schema)

    return df.mapInArrow(run, schema)


def _judge(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        held = [tuple(x.values()) for x in r["rows"]]
        letters = _repeated(held, set(r["seen"] or ()))
        form = letters.replace("b", "d")
        yield {"conv": r["conv"], "part": r["part"], "seq": r["seq"], "counts": _counts(held, letters), "letters": form, "matrix": matrix(form)}


def _backward(rows: Iterator[dict]) -> Iterator[dict]:
    """What it costs to go on from each state at a piece's end."""
    conv, ends, begun = None, END, False
    for r in rows:
        if not begun or r["conv"] != conv:
            conv, ends, begun = r["conv"], END, True
        yield {"part": r["part"], "seq": r["seq"], "ends": list(ends)}
        ends = tuple(min(NONE, *(r["matrix"][4 * s + e] + ends[e] for e in STATES)) for s in STATES)


def _trace(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        lattice = Lattice(r["letters"], tuple(r["ends"]))
        ways = [lattice.trace(s) for s in STATES]
        yield {
            "conv": r["conv"], "part": r["part"], "seq": r["seq"], "cost": lattice.price[0],
            "audits": [w[0] for w in ways], "exits": [w[1] for w in ways],
        }


def _forward(rows: Iterator[dict]) -> Iterator[dict]:
    """In which state each piece begins, and what follows its last row."""
    before = None
    for r in rows:
        if before is not None and before[0] == r["conv"]:
            yield before[1] | {"tail": ""}
            state, cost = before[2], 0
        else:
            if before is not None:
                yield before[1] | {"tail": finish(before[2])}
            state, cost = 0, r["cost"]
        before = r["conv"], {"part": r["part"], "seq": r["seq"], "state": state, "cost": cost, "audit": r["audits"][state]}, r["exits"][state]
    if before is not None:
        yield before[1] | {"tail": finish(before[2])}


def _edit(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        audit = r["audit"] + r["tail"]
        lines = edited(audit, r["state"], [x["role"] for x in r["rows"]], [x["text"] for x in r["rows"]])
        yield {k: r[k] for k in ("conv", "part", "seq", "counts", "cost")} | {"done": False, "audit": audit, "lines": lines}


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """One row per conversation from its pieces in order; its text is hashed as it passes."""
    whole = None
    for r in rows:
        c = r["counts"]
        if whole is None or whole["conv"] != r["conv"]:
            if whole is not None:
                yield _closed(whole)
            whole = {"conv": r["conv"], "audit": [], "cost": 0, "hash": hashlib.sha256(), "lines": 0, "last": None, "last_turn": None, "least": None, "most": None}
            whole |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            whole[k] += c[k]
        whole["cost"] += r["cost"]
        if c["n"]:
            whole["illegal"] += whole["last"] is not None and whole["last"] + c["first"] not in ("su", "ua", "au")
            whole["last"] = c["last"]
        if c["turns"]:
            whole["turns"] -= whole["last_turn"] == c["first_turn"]
            whole["last_turn"], whole["most"] = c["last_turn"], c["most"]
            whole["least"] = c["least"] if whole["least"] is None else whole["least"]
        whole["audit"].append(r["audit"])
        for line in r["lines"]:
            whole["hash"].update(("\n" if whole["lines"] else "").encode() + line.encode())
            whole["lines"] += 1
    if whole is not None:
        yield _closed(whole)


def _closed(whole: dict) -> dict:
    gaps = whole["most"] - whole["least"] + 1 - whole["turns"] if whole["turns"] else 0
    return {k: whole[k] for k in ("conv", "blank", "duplicate", "truncated", "illegal", "cost")} | {
        "gaps": gaps, "audit": "".join(whole["audit"]), "repaired_sha256": whole["hash"].hexdigest()
    }


def solved(rows: DataFrame, size: int = 512) -> DataFrame:
    """Pieces of conversations with their edits: conv, part, seq (their order), done, counts, cost, audit, lines.

    `rows` holds conv, turn (a long), role, text and live, as `damaged` returns them; a row that is not live only names
    its conversation. A conversation's rows go by turn, null first, then role, then a hash of role and text; equal
    rows are interchangeable. Null roles and texts count as empty, conversations without a name as one. `done` pieces
    are whole conversations; the cost of others stands at their first piece.
    """
    C.positive("size", size)
    C.small_batches(rows)
    whole = rows.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "live")
    pieces = C.staged(_pieces(_marked(whole), size), "pieces")
    conv = pieces.schema["conv"].dataType.simpleString()
    open_ = pieces.filter("NOT done").select("conv", "part", "seq", "rows")
    # Roles and texts that stand in an earlier piece of the conversation; a piece names each of its own once.
    at = F.struct("part", "seq")
    keys = open_.select("conv", "part", "seq", F.explode("rows").alias("row")).filter("row.letter <> 'b'").select("conv", "part", "seq", F.col("row.key").alias("key")).distinct()
    first = keys.groupBy("conv", "key").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv").alias("first_conv"), F.col("key").alias("first_key"), "first")
    later = keys.join(first, F.col("conv").eqNullSafe(F.col("first_conv")) & (F.col("key") == F.col("first_key"))).filter(at > F.col("first"))
    seen = later.groupBy("part", "seq").agg(F.collect_list("key").alias("seen"))
    where = ["part", "seq"]
    counts = pieces.schema["counts"].dataType.simpleString()
    judged = C.staged(_mapped(open_.join(seen, where, "left"), _judge, f"conv {conv}, part int, seq int, counts {counts}, letters string, matrix array<bigint>"), "judged")
    ends = _mapped(_by_conversation(judged.select("conv", "part", "seq", "matrix"), descending=True), _backward, "part int, seq int, ends array<bigint>")
    traced = judged.join(ends, where).select("conv", "part", "seq", "letters", "ends")
    traced = C.staged(_mapped(traced, _trace, f"conv {conv}, part int, seq int, cost long, audits array<string>, exits array<int>"), "traced")
    ways = _mapped(_by_conversation(traced), _forward, "part int, seq int, state int, cost long, audit string, tail string")
    edits = open_.join(judged.select("part", "seq", "counts"), where).join(ways, where)
    edits = _mapped(edits, _edit, f"conv {conv}, part int, seq int, done boolean, counts {counts}, cost long, audit string, lines array<string>")
    return pieces.filter("done").drop("rows").unionByName(edits)


def repair(rows: DataFrame, size: int = 512) -> DataFrame:
    """Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; see `solved`.

    Of a row's faults the first counts: no text, role and text seen before, no mark at the end. `audit` has a letter
    per edit: K keeps, R re-roles, D deletes, I inserts. A conversation without live rows has zeros, an empty audit
    and the hash of nothing. No rows, no conversations.
    """
    pieces = solved(rows, size)
    c = F.col("counts")
    done = pieces.filter("done").select(
        "conv", F.coalesce(c.most - c.least + 1 - c.turns, F.lit(0)).alias("gaps"), *[c[k].alias(k) for k in ("blank", "duplicate", "truncated", "illegal")],
        "cost", "audit", F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("repaired_sha256"),
    )
    conv = pieces.schema["conv"].dataType.simpleString()
    several = _mapped(
        _by_conversation(pieces.filter("NOT done")), _joined,
        f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    )
    return done.unionByName(several)


def repaired(rows: DataFrame, size: int = 512) -> DataFrame:
    """The repaired conversations line by line: conv, part, seq, pos (in this order), line as `role:text`."""
    return solved(rows, size).select("conv", "part", "seq", F.posexplode("lines").alias("pos", "line"))
