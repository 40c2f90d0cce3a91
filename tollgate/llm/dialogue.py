"""Conversation structure repair by a square-root checkpointed DP.

A conversation is repaired when its roles read: nothing, or an optional system
row and then user / assistant pairs.  Rows are kept, given another role, deleted
or inserted at a cost; the repair is the cheapest edit script, and of the
cheapest the one whose letters come first in ASCII.

The state is one of four (start, after system, after user, after assistant),
and the backward vector of a place holds the least cost from each state to the
end.  Vectors are stored only at checkpoints: at the ends of segments of
``SEGMENT`` rows, and within a segment every sqrt(rows).  The forward walk
recomputes the vectors between two checkpoints and takes the first letter among
the tight edits.

A conversation may hold any share of all rows, so nothing gathers one:

1. rows are range-sorted over all tasks and numbered; segments are packed to a
   byte a row;
2. a segment's costs from each state to each state are a 4 x 4 matrix; a stream
   over a conversation's matrices, last first, gives the vector at each end;
3. segments are walked apart, from every state they may be entered in;
4. a stream over the exits, first first, picks the walk that is taken."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

#: Rows of a segment: 2 to this power.
SEGMENT_BITS = 12
#: Text bytes of a sorted partition.
PART_BYTES = 32 << 20
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

#: Fixed costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: Where a new user or assistant row leads, and where kept roles lead.
NEW = (USER, USER, ASSISTANT, USER)
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL = {(0, 1), (1, 2), (2, 1)}


def role_code(role: Column) -> Column:
    """0, 1, 2 for a first letter s, u, a; 3 for any other or none."""
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def backward(codes: bytes, after: tuple) -> Iterator[tuple]:
    """Vectors before each row, last row first; ``after`` is the one behind."""
    yield after
    for code in reversed(codes):
        cls, fault = code & 3, code >> 2
        extra = TRUNCATED if fault == 1 else 0
        now = []
        for q in range(4):
            least = after[q] + DELETE
            if fault < 2:
                least = min(least, after[NEW[q]] + REROLE + extra)
                if (q, cls) in KEPT:
                    least = min(least, after[KEPT[q, cls]] + extra)
            now.append(least)
        u, a = min(now[USER], now[ASSISTANT] + INSERT), min(now[ASSISTANT], now[USER] + INSERT)
        after = (min(now[START], u + INSERT), min(now[SYSTEM], u + INSERT), u, a)
        yield after


#: The vector behind the last row: what is missing to a legal end is inserted.
END = (0, 2 * INSERT, INSERT, 0)


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state (rows) to each state (columns)."""
    ends = []
    for q in range(4):
        last = ()
        for last in backward(codes, tuple(0 if p == q else FAR for p in range(4))):
            pass
        ends.append(last)
    return [min(ends[q][p], FAR) for p in range(4) for q in range(4)]


def walk(codes: bytes, after: tuple, state: int, last: bool) -> tuple[str, str, int]:
    """The tight edits of a segment entered in ``state``: their letters, the
    roles they give (s/u/a as kept or set, - for deleted), and the exit state."""
    n = len(codes)
    step = isqrt(n) + 1
    at_ends = {}
    for k, v in enumerate(backward(codes, after)):
        if (n - k) % step == 0 or k == 0:
            at_ends[n - k] = v
    letters, roles = [], []

    def insert(now):
        """New rows while an insertion is tight and nothing smaller is."""
        nonlocal state
        letters.append("I")
        roles.append("ua"[NEW[state] == ASSISTANT])
        state = NEW[state]

    for lo in range(0, n, step):
        hi = min(lo + step, n)
        vectors = [*backward(codes[lo:hi], at_ends[hi])][::-1]
        for k in range(lo, hi):
            here, then = vectors[k - lo], vectors[k - lo + 1]
            cls, fault = codes[k] & 3, codes[k] >> 2
            extra = TRUNCATED if fault == 1 else 0
            while here[state] != then[state] + DELETE and here[state] == here[NEW[state]] + INSERT:
                insert(here)
            if here[state] == then[state] + DELETE:
                letters.append("D")
                roles.append("-")
                continue
            kept = KEPT.get((state, cls))
            if kept is not None and here[state] == then[kept] + extra:
                letters.append("K")
                roles.append("sua"[cls])
                state = kept
            else:
                letters.append("R")
                roles.append("ua"[NEW[state] == ASSISTANT])
                state = NEW[state]
    while last and END[state]:
        insert(END)
    return "".join(letters), "".join(roles), state


#: Short segments recur by the thousand; these hold a few MB at most.
_SHORT = 32


@lru_cache(1 << 14)
def _matrix_of_short(codes: bytes) -> list[int]:
    return matrix(codes)


@lru_cache(1 << 14)
def _walk_of_short(codes: bytes, after: tuple, state: int, last: bool) -> tuple[str, str, int]:
    return walk(codes, after, state, last)


def _streamed(df: DataFrame, schema: pa.Schema, start, fold, ascending: bool) -> DataFrame:
    """Rows of each conversation in order of ``start`` through ``fold(state,
    row) -> (state, out row)``, one row held at a time."""
    order = F.asc("start") if ascending else F.desc("start")
    ddl = ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)

    def run(batches):
        state, now, any_row = None, None, False
        for b in batches:
            out = []
            for row in b.to_pylist():
                if not any_row or row["conv_id"] != now:
                    state, now, any_row = start(), row["conv_id"], True
                state, made = fold(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, ddl)


_DDL = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>", pa.string(): "string"}


def _with_matrix(df: DataFrame) -> DataFrame:
    schema = pa.schema([("conv_id", pa.int64()), ("start", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            codes = b.column("codes").to_pylist()
            costs = [_matrix_of_short(c) if len(c) <= _SHORT else matrix(c) for c in codes]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("start"), b.column("codes"), pa.array(costs, schema.field("costs").type)], schema=schema)

    return df.select("conv_id", "start", "codes").mapInArrow(run, "conv_id long, start long, codes binary, costs array<long>")


def _ends(segments: DataFrame) -> DataFrame:
    """Each segment with the vector behind it, whether it is its conversation's
    last, the least cost from its start on, and its illegal neighbours."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("start", pa.int64()), ("codes", pa.binary()), ("after", pa.list_(pa.int64())),
        ("last", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64()),
    ])

    def fold(state, row):
        after, following = state
        codes, m = row["codes"], row["costs"]
        pairs = [c & 3 for c in codes] + ([] if following is None else [following])
        before = tuple(min(m[4 * p + q] + after[q] for q in range(4)) for p in range(4))
        made = {
            "conv_id": row["conv_id"], "start": row["start"], "codes": codes, "after": list(after), "last": following is None,
            "cost": before[START], "illegal": sum(p not in LEGAL for p in zip(pairs, pairs[1:])),
        }
        return (before, codes[0] & 3), made

    return _streamed(segments, schema, lambda: (END, None), fold, ascending=False)


def _walks(ends: DataFrame) -> DataFrame:
    """Each segment's walks by entry state: letters, roles and exits."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("start", pa.int64()), ("letters", pa.list_(pa.string())), ("roles", pa.list_(pa.string())),
        ("exits", pa.list_(pa.int64())),
    ])

    def run(batches):
        for b in batches:
            made = []
            for codes, after, last in zip(b.column("codes").to_pylist(), b.column("after").to_pylist(), b.column("last").to_pylist()):
                least = min(after)  # tight edits depend on differences alone
                one = _walk_of_short if len(codes) <= _SHORT else walk
                made.append([one(codes, tuple(v - least for v in after), q, last) for q in range(4)])
            columns = [pa.array([[w[k] for w in four] for four in made], schema.field(name).type) for k, name in enumerate(("letters", "roles", "exits"))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("start"), *columns], schema=schema)

    return ends.repartition("start").select("conv_id", "start", "codes", "after", "last").mapInArrow(
        run, "conv_id long, start long, letters array<string>, roles array<string>, exits array<long>"
    )


def _taken(walks: DataFrame) -> DataFrame:
    schema = pa.schema([("conv_id", pa.int64()), ("start", pa.int64()), ("letters", pa.string()), ("roles", pa.string())])

    def fold(state, row):
        return row["exits"][state], {"conv_id": row["conv_id"], "start": row["start"], "letters": row["letters"][state], "roles": row["roles"][state]}

    return _streamed(walks, schema, lambda: START, fold, ascending=True)


def in_order(turns: DataFrame) -> DataFrame:
    """(id, conv_id, turn, role, text), stored: rows in order of conversation,
    turn (nulls first), role and text, ``id`` growing along.  Spark range-sorts
    them, so a long conversation lies in many partitions; equal rows are told
    apart by a row number and spread as well."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("nth"),
    )
    rows = stored(rows)
    n_bytes = int(rows.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0])
    keys = ("conv_id", "turn", "role", "text", "nth")
    laid = rows.repartitionByRange(pieces(n_bytes, PART_BYTES), *keys).sortWithinPartitions(*keys)
    return stored(laid.select(F.monotonically_increasing_id().alias("id"), "conv_id", "turn", "role", "text"))


def faults(rows: DataFrame) -> DataFrame:
    """(id, conv_id, turn, code, fault): each row's first fault, ``blank``,
    ``duplicate`` (role and text seen earlier), ``truncated`` or null."""
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    marks = rows.select(
        "id", "conv_id", "turn", role_code(F.col("role")).alias("cls"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"),
        F.when(ends == "", "blank").when(~F.substring(ends, -1, 1).isin(".", "!", "?"), "truncated").alias("own"),
    )
    # The first of equal rows, found by pre-aggregated minima; it meets its row
    # by the unique id, so no key of equal rows is ever joined.
    first = marks.groupBy("conv_id", "same").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    seen = marks.join(first, "id", "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("own"))
    out = seen.select("id", "conv_id", "turn", "cls", fault.alias("fault"))
    worth = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    return out.select("id", "conv_id", "turn", (F.col("cls") + 4 * worth).cast("int").alias("code"), "fault")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations of (conv_id, turn, role, text) rows.

    Returns ``edits`` (conv_id, at, nth, edit, turn, role_before, role, text),
    one row per edit, in order of ``at, nth`` within a conversation: K, R, D or
    I; ``role`` is the role after it, null for a deleted row; ``text`` is empty
    for an inserted one.  And ``summary`` (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost).

    Null roles and texts count as one space, a null turn comes first and is no
    gap, rows without conv_id form one conversation.  Rows of one turn are
    ordered by role and text.  A role is read by its first letter; an empty one
    cannot be kept.  Further columns play no part.  An empty table gives empty
    results; gaps beyond a long are null."""
    rows = in_order(turns)
    marked = stored(faults(rows))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda x: x["code"])
    segments = (
        marked.groupBy("conv_id", F.shiftright("id", SEGMENT_BITS).alias("segment"))
        .agg(F.min("id").alias("start"), packed.alias("codes"))
        .select("conv_id", "start", F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("codes"))
    )
    ends = stored(_ends(_with_matrix(segments)))
    taken = _taken(_walks(ends))

    # A letter belongs to the row at ``start`` + the rows before it; an inserted
    # row comes before that row.
    letters = taken.select("conv_id", "start", "letters", "roles", F.explode(F.sequence(F.lit(1), F.length("letters"))).alias("nth")).where("nth > 0")
    spots = letters.select(
        "conv_id", "nth", F.substr("letters", F.col("nth"), F.lit(1)).alias("edit"), F.substr("roles", F.col("nth"), F.lit(1)).alias("given"),
        (F.col("start") + F.length(F.translate(F.substr("letters", F.lit(1), F.col("nth") - 1), "I", ""))).alias("at"),
    )
    new = F.when(F.col("given") == "u", "user").otherwise("assistant")
    inserted = spots.where("edit = 'I'").select(
        "conv_id", "at", "nth", "edit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role_before"), new.alias("role"), F.lit("").alias("text")
    )
    changed = spots.where("edit <> 'I'").join(rows.select(F.col("id").alias("at"), "turn", F.col("role").alias("role_before"), "text"), "at").select(
        "conv_id", "at", "nth", "edit", "turn", "role_before",
        F.when(F.col("edit") == "K", F.col("role_before")).when(F.col("edit") == "R", new).alias("role"), "text",
    )

    wide = F.col("turn").cast("decimal(38,0)")
    counts = marked.groupBy("conv_id").agg(
        F.coalesce(F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn"), F.lit(0)).try_cast("long").alias("gaps"),
        *(F.count_if(F.col("fault").eqNullSafe(k)).alias(k) for k in ("blank", "duplicate", "truncated")),
    )
    costs = ends.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.min_by("cost", "start").alias("cost"))
    joined = counts.join(costs.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return changed.unionByName(inserted), joined


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with planted faults, by crc32 of
    ``conv_id:turn`` (nulls: one space) modulo 20: 0 drops the row, 1 empties
    its text, 2 removes its ``. ! ?``, 3 repeats it, 4 sets its role to user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), way.alias("way")).where("way <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def scripts(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) from the rows of ``repair``: a stream
    over each conversation in order; texts are hashed as they pass, and only
    one letter an edit is held."""
    import hashlib

    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        now, audit, digest, some = None, None, None, False
        for b in batches:
            done = []
            for conv, edit, line in zip(b.column("conv_id").to_pylist(), b.column("edit").to_pylist(), b.column("line").to_pylist()):
                if audit is None or conv != now:
                    if audit is not None:
                        done.append((now, audit.decode(), digest.hexdigest()))
                    now, audit, digest, some = conv, bytearray(), hashlib.sha256(), False
                audit += edit.encode()
                if line is not None:
                    digest.update(b"\n" * some + line.encode())
                    some = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if audit is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((now, audit.decode(), digest.hexdigest()), schema)], schema=schema)

    lines = edits.select("conv_id", "at", "nth", "edit", F.when(F.col("role").isNotNull(), F.concat("role", F.lit(":"), "text")).alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "nth").mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The whole job for one table: damage, repair, one row per conversation."""
    edits, summary = repair(damaged(conversations))
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    none = conversations.select(F.col("conv_id").cast("long")).distinct()
    rows = none.unionByName(summary, allowMissingColumns=True).unionByName(scripts(edits), allowMissingColumns=True)
    whole = rows.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in columns))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns[:6]]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
