"""Conversation repair by iterative-deepening A*: cheapest edits that make the roles alternate.

A search goes depth first through Delete, Insert, Keep, Rerole, in this order, under a bound on cost that grows by the least
amount any branch lacked. States that failed are remembered with the cost they need at least, and aren't entered with less. The
first accepting path is the cheapest one, and of equally cheap ones the first in ASCII order.

Rows are sorted by conversation and turn into ranges of equal size, so that a long conversation lies in several tasks, in pieces
of bounded size. Conversations that lie in one piece are settled there. For the others, each piece tells what it costs to go
through it from any of the four states of the pattern to any other; the costs still to come behind each piece follow from these
few numbers, and with them every piece is searched by itself, from each state that may lead into it. The same holds for the
segments of some rows that a piece is searched in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kerbside.llm.common import field, shuffle_width, stored

#: Rows and characters that a piece of a conversation holds at most, a longer text by itself.
PIECE_ROWS, PIECE_CHARS = 4096, 4_000_000
#: Rows that are searched together.
SEGMENT = 32
SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits; TRUNCATED is added to a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# States: 0 nothing yet, 1 after the system's row, 2 after the user's, 3 after the assistant's.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after a row in the expected role, that role, and what the end costs: the rows still to insert.
NEXT, EXPECTED, AT_END = (2, 2, 3, 2), ("user", "user", "assistant", "user"), (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}

PIECE = [
    ("key", T.StringType()), ("part", T.IntegerType()), ("seq", T.IntegerType()), ("settled", T.BooleanType()),
    ("low", T.LongType()), ("high", T.LongType()), ("turns", T.LongType()), ("roles", T.ArrayType(T.StringType())),
    ("texts", T.ArrayType(T.StringType())), ("marks", T.ArrayType(T.StringType())), ("first", T.StringType()), ("last", T.StringType()),
    ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()),
    ("cost", T.LongType()), ("audit", T.StringType()),
]


def options(row: str, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits before or of a row in ASCII order: initial, cost, rows it takes, the state after it."""
    yield "D", DELETE, 1, state
    yield "I", INSERT, 0, NEXT[state]
    if row != "x":
        more = TRUNCATED if row.isupper() else 0
        kept = KEPT.get((state, row.lower()))
        if kept is not None:
            yield "K", KEEP + more, 1, kept
        yield "R", REROLE + more, 1, NEXT[state]


def floor(row: str) -> int:
    """What a row costs in any state at least."""
    return DELETE if row == "x" or row.isupper() else REROLE if row == "o" else 0


@lru_cache(1 << 16)
def search(rows: str, state: int, ends: tuple[int, ...]) -> tuple[str, int]:
    """The first cheapest edits of a segment and the state after it; `ends`: what still follows, by state.

    A row is one letter: x for a blank or repeated one, else the initial of its role (o: neither s, u nor a), in upper case if the
    row is truncated.
    """
    n = len(rows)
    least = [min(ends)] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + floor(rows[i])
    needed: dict[tuple[int, int], int] = {}

    def visit(i: int, state: int, left: int) -> tuple[str, int] | int:
        """The edits from here and the last state, or by how much `left` falls short."""
        if i == n:
            return ("", state) if ends[state] <= left else ends[state] - left
        need = needed.get((i, state), least[i])
        if need > left:
            return need - left
        short = None
        for letter, cost, taken, after in options(rows[i], state):
            got = visit(i + taken, after, left - cost)
            if isinstance(got, tuple):
                return letter + got[0], got[1]
            short = got if short is None else min(short, got)
        needed[i, state] = left + short
        return short

    bound = least[0]
    while isinstance(found := visit(0, state, bound), int):
        bound += found
    return found


@lru_cache(1 << 16)
def passage(rows: str) -> tuple[tuple[int, ...], ...]:
    """What it costs to go through the rows from each state to each other; the last row taken is the end."""
    out = []
    for start in range(4):
        costs = [10 ** 15] * 4
        costs[start] = 0
        for row in rows:
            for _ in range(3):
                for s in range(4):
                    costs[NEXT[s]] = min(costs[NEXT[s]], costs[s] + INSERT)
            after = [10 ** 15] * 4
            for s in range(4):
                for letter, cost, _, t in options(row, s):
                    if letter != "I":
                        after[t] = min(after[t], costs[s] + cost)
            costs = after
        out.append(tuple(costs))
    return tuple(out)


def before(through: tuple[tuple[int, ...], ...], ends: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(c + e for c, e in zip(costs, ends)) for costs in through)


def segments(rows: str) -> list[str]:
    return [rows[i:i + SEGMENT] for i in range(0, len(rows), SEGMENT)]


def edits(rows: str, state: int, ends: tuple[int, ...]) -> tuple[str, int]:
    """The first cheapest edits of a piece, segment by segment, and the state after it."""
    parts, after = segments(rows), [ends]
    for part in reversed(parts[1:]):
        after.append(before(passage(part), after[-1]))
    audit = []
    for part, coming in zip(parts, reversed(after)):
        least = min(coming)
        got, state = search(part, state, tuple(c - least for c in coming))
        audit.append(got)
    return "".join(audit), state


def faults(roles: list[str], texts: list[str], seen: set[str] = frozenset()) -> tuple[str, list[int]]:
    """A letter for each row, and the numbers of blank, repeated and truncated rows; `seen`: marks of earlier pieces' rows."""
    letters, counts, earlier = [], [0, 0, 0], set()
    for role, text in zip(roles, texts):
        end = text.rstrip(SPACE)[-1:]
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not end:
            counts[0] += 1
            initial = "x"
        elif (role, text) in earlier or (seen and mark(role, text) in seen):
            counts[1] += 1
            initial = "x"
        elif end not in ".!?":
            counts[2] += 1
            initial = initial.upper()
        earlier.add((role, text))
        letters.append(initial)
    return "".join(letters), counts


def mark(role: str, text: str) -> str:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).hexdigest()


def repaired(audit: str, letters: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str], int]:
    """The rows that the edits give, and their cost."""
    out_roles, out_texts, i, cost = [], [], 0, 0
    for edit in audit:
        if edit == "I":
            out_roles.append(EXPECTED[state])
            out_texts.append("")
            state, cost = NEXT[state], cost + INSERT
            continue
        if edit == "D":
            cost += DELETE
        else:
            cost += (KEEP if edit == "K" else REROLE) + (TRUNCATED if letters[i].isupper() else 0)
            out_roles.append(roles[i] if edit == "K" else EXPECTED[state])
            out_texts.append(texts[i])
            state = KEPT[state, letters[i].lower()] if edit == "K" else NEXT[state]
        i += 1
    return out_roles, out_texts, cost


def closing(state: int) -> str:
    return "I" * (AT_END[state] // INSERT)


def _pieces(schema: T.StructType):
    """Pieces of conversations from rows in order. One that lies between two others in its task and in one piece is settled."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        key = conv_id = None
        seen_keys, seq, chars = 0, 0, 0
        turns, roles, texts = [], [], []

        def close(more: bool, last: bool) -> None:
            """End a piece: `more` of its conversation follows here, or it is the `last` of the task."""
            nonlocal seq, chars, turns, roles, texts
            known = [t for t in turns if t is not None]
            row = {"conv_id": conv_id, "key": key, "part": part, "seq": seq, "settled": not (more or last or seq or seen_keys == 1),
                   "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
                   "roles": roles, "texts": texts, "first": roles[0][:1] if roles else None, "last": roles[-1][:1] if roles else None,
                   "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))}
            if row["settled"]:
                letters, (row["blank"], row["duplicate"], row["truncated"]) = faults(roles, texts)
                audit, state = edits(letters, 0, AT_END)
                row["audit"] = audit + closing(state)
                row["roles"], row["texts"], row["cost"] = repaired(row["audit"], letters, roles, texts, 0)
            else:
                row["marks"] = sorted({mark(r, t) for r, t in zip(roles, texts)})
            out.append(row)
            seq, chars, turns, roles, texts = seq + 1, 0, [], [], []

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            for k, c, turn, role, text, gone in zip(*(batch.column(x).to_pylist() for x in ("key", "conv_id", "turn", "role", "text", "gone"))):
                if k != key:
                    if key is not None:
                        close(False, False)
                    key, conv_id, seq, seen_keys = k, c, 0, seen_keys + 1
                if gone:
                    continue
                if roles and (len(roles) >= PIECE_ROWS or chars + len(text) > PIECE_CHARS):
                    close(True, False)
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                chars += len(text)
            if len(out) > 500:
                yield batch_of(out)
                out = []
        if key is not None:
            close(False, True)
        yield batch_of(out)

    return run


def _read(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What it costs to go through each piece."""
    for batch in batches:
        rows = []
        for r in _read(batch):
            letters, _ = faults(r["roles"], r["texts"], set(r["seen"] or ()))
            costs = [tuple(0 if s == t else 10 ** 15 for t in range(4)) for s in range(4)]
            for part in segments(letters):
                step = passage(part)
                costs = [tuple(min(c[m] + step[m][t] for m in range(4)) for t in range(4)) for c in costs]
            rows.append((r["key"], r["part"], r["seq"], [x for c in costs for x in c]))
        yield pa.record_batch([pa.array(v, k) for v, k in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))],
                              names=["key", "part", "seq", "costs"])


def _coming(pieces: pa.Table) -> pa.Table:
    """For each piece of a conversation what still follows it, by state; the last one ends the conversation."""
    pieces = pieces.sort_by([("part", "ascending"), ("seq", "ascending")])
    ends, out = AT_END, []
    for flat in reversed(pieces.column("costs").to_pylist()):
        out.append(list(ends))
        ends = before(tuple(tuple(flat[4 * s:4 * s + 4]) for s in range(4)), ends)
    ended = [False] * (len(out) - 1) + [True]
    return pieces.drop_columns("costs").append_column("coming", pa.array(out[::-1], pa.list_(pa.int64()))).append_column("ends", pa.array(ended))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each piece from each state that may lead into it, and the states they lead to."""
    for batch in batches:
        rows = []
        for r in _read(batch):
            letters, _ = faults(r["roles"], r["texts"], set(r["seen"] or ()))
            got = [edits(letters, s, tuple(r["coming"])) for s in range(4)]
            rows.append((r["key"], r["part"], r["seq"], r["ends"], [a for a, _ in got], [s for _, s in got]))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()))
        yield pa.record_batch([pa.array(v, k) for v, k in zip(list(zip(*rows)) or [[]] * 6, kinds)],
                              names=["key", "part", "seq", "ends", "audits", "to"])


def _entries(pieces: pa.Table) -> pa.Table:
    """The state that leads into each piece of a conversation."""
    pieces = pieces.sort_by([("part", "ascending"), ("seq", "ascending")])
    state, out = 0, []
    for to in pieces.column("to").to_pylist():
        out.append(state)
        state = to[state]
    return pieces.drop_columns("to").append_column("state", pa.array(out, pa.int32()))


def _settle(schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _read(batch):
                letters, (r["blank"], r["duplicate"], r["truncated"]) = faults(r["roles"], r["texts"], set(r["seen"] or ()))
                audit, after = r["audits"][r["state"]], r["to"][r["state"]]
                r["audit"] = audit + (closing(after) if r["ends"] else "")
                r["roles"], r["texts"], r["cost"] = repaired(r["audit"], letters, r["roles"], r["texts"], r["state"])
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in arrow.names}], schema=arrow)

    return run


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) after the planted faults, and gone for a dropped row.

    By CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes it the
    user's. A dropped row stays as a mark of its conversation.
    """
    kind = rows.schema["conv_id"].dataType if "conv_id" in rows.columns else T.LongType()
    conv_id = F.col("`conv_id`") if "conv_id" in rows.columns else F.lit(None).cast(kind)
    plain = rows.select(conv_id.alias("conv_id"), field(rows, "turn", "bigint"), F.coalesce(field(rows, "role", "string"), F.lit(" ")).alias("role"),
                        F.coalesce(field(rows, "text", "string"), F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = plain.withColumn("fault", F.crc32(name.cast("binary")) % 20)
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def _key(conv_id: Column) -> Column:
    return F.concat(F.when(conv_id.isNull(), "-").otherwise("+"), F.coalesce(conv_id.cast("string"), F.lit("")))


def repair(rows: DataFrame) -> DataFrame:
    """Pieces of repaired conversations: conv_id, key, part, seq (a conversation's pieces in order), roles and texts of the repaired
    rows, audit and cost of the edits, and the faults found. `settled` marks a conversation of one piece.

    `rows` has conv_id, turn, role and text, and gone where a row only names its conversation. Rows go by turn (nulls first), then
    role and a hash of the text; equal rows stand together. A row whose role is empty or begins otherwise than s, u or a can't be
    kept as it is. Conversations without conv_id are one. An empty table gives no rows.
    """
    spark = rows.sparkSession
    n = shuffle_width(spark)
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(*f) for f in PIECE)])
    keyed = rows.withColumns({"key": _key(F.col("conv_id")), "hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    order = ("key", "turn", "role", "hash")
    ordered = keyed.repartitionByRange(n, *order, "tie").sortWithinPartitions(*order, "text", "tie")
    pieces = stored(ordered.select("key", "conv_id", "turn", "role", "text", "gone").mapInArrow(_pieces(schema), schema), "conversations")
    place, is_open = ["key", "part", "seq"], ~F.col("settled")
    split = pieces.where(is_open)
    at = F.struct("part", "seq")
    marks = split.select(*place, F.explode("marks").alias("mark"))
    first = marks.groupBy("key", "mark").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = marks.join(first, ["key", "mark"]).where(at > F.col("first")).groupBy(*place).agg(F.collect_list("mark").alias("seen"))
    work = stored(split.join(again, place, "left"), "conversation-pieces")
    read = work.select(*place, "roles", "texts", "seen")
    through = read.mapInArrow(_through, "key string, part int, seq int, costs array<bigint>")
    coming = through.groupBy("key").applyInArrow(_coming, "key string, part int, seq int, coming array<bigint>, ends boolean")
    ways = stored(read.join(coming, place).mapInArrow(
        _ways, "key string, part int, seq int, ends boolean, audits array<string>, to array<int>"), "conversation-ways")
    entries = ways.select(*place, "to").groupBy("key").applyInArrow(_entries, "key string, part int, seq int, state int")
    settled = work.join(ways, place).join(entries, place).mapInArrow(_settle(schema), schema)
    return pieces.where(~is_open).unionByName(settled)


DIGEST = [(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
    ("audit", T.StringType()), ("repaired_sha256", T.StringType())]


def _digest(schema: T.StructType):
    """One row for each conversation from its pieces, which come one after the other."""
    arrow = to_arrow_schema(schema)
    counted = ("blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, key, last, high, lines = None, [], None, None, None, 0

        def close() -> None:
            if now is not None:
                now["audit"], now["repaired_sha256"] = "".join(now.pop("parts")), now.pop("sha").hexdigest()
                low = now.pop("low")
                now["gaps"] = 0 if low is None else high - low + 1 - now.pop("turns")
                out.append({n: now[n] for n in arrow.names})

        for batch in batches:
            for r in _read(batch):
                if r["key"] != key:
                    close()
                    now = {"conv_id": r["conv_id"], "parts": [], "sha": hashlib.sha256(), "low": None, "turns": 0, **dict.fromkeys(counted, 0)}
                    key, last, high, lines = r["key"], None, None, 0
                for c in counted:
                    now[c] += r[c]
                if r["low"] is not None:
                    now["turns"] += r["turns"] - (r["low"] == high)
                    now["low"], high = r["low"] if now["low"] is None else now["low"], r["high"]
                if r["first"] is not None:
                    now["illegal"] += last is not None and last + r["first"] not in LEGAL
                    last = r["last"]
                now["parts"].append(r["audit"])
                for role, text in zip(r["roles"], r["texts"]):
                    now["sha"].update(("\n" * (lines > 0) + role + ":" + text).encode())
                    lines += 1
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        close()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return run


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the hash of the repaired rows of each conversation.

    Pieces of a conversation that has several are brought together in order and hashed as they come; a hash is one sequence.
    """
    schema = T.StructType([pieces.schema["conv_id"], *(T.StructField(*f) for f in DIGEST)])
    parts = pieces.drop("marks")
    one = parts.where("settled")
    more = parts.where(~F.col("settled")).repartition(shuffle_width(pieces.sparkSession), "key").sortWithinPartitions("key", "part", "seq")
    return one.mapInArrow(_digest(schema), schema).unionByName(more.mapInArrow(_digest(schema), schema))
