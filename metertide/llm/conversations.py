"""Conversation structure repair by rank-convergence parallel Viterbi.

Turns are kept (no cost), given another role (2), deleted (3) or inserted with an empty text (2), so that the
initials of the roles read ``(s?(ua)+)?``. Blank turns and repeated ones must go; a truncated turn
that stays costs 1. Among the cheapest ways that one counts whose edits, by their initials in order,
come first as text.

*States.* What was put out so far ends in nothing, ``s``, ``u`` or ``a``. From any of them only one role can
be inserted, and only one given, so an edit leads to one state. The cost to the end of the
conversation, by state, is a vector; a turn maps the vector behind it to the one before it. Vectors that
differ by a constant lead to the same choices, so they are kept less their least entry. Few of them
exist, and the steps between them are looked up.

*Chunks.* Turns are range-sorted by conversation and turn, and cut to stretches, so a conversation may lie in
many tasks. One that lies within a task is repaired there. Of the others, chunks of stretches
are worked on at once: each starts from a speculative vector behind its end, and passes with the vector
of the chunk that follows repeat until no chunk's vector differs by more than a constant. A pass ends within
a chunk as soon as the old and the new vector agree. The stitched vectors then tell, for each chunk and
each state it may begin in, the state it ends in; put together these give the states the chunks begin in,
and from there the least audit is traced in all of them at once.

Edges: a null role or text is one space. The initial of an empty role is empty. Turns come in the order
of ``turn``, nulls first, then of role and text; a null ``conv_id`` is a conversation of its own. Equal
rows are repeats of each other and are carried as one row with a count. The audit and the checksum of a
conversation are one value each, so these alone pass, as a stream, through one task a conversation.
Other columns of the input are ignored. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metertide.workspace import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What ends a sentence, and what words are not made of.
ENDS, BLANKS = ".!?", " \t\n\x0b\x0c\r"
#: Turns and bytes of text in a stretch, and stretches in a chunk, at most.
STRETCH_ROWS, STRETCH_BYTES, CHUNK_STRETCHES = 4096, 4 << 20, 256

NOTHING, S, U, A = range(4)
#: The state after a user, or where that cannot come an assistant, is put out.
ANSWER = (U, U, A, U)
ROLE = ("user", "user", "assistant", "user")
#: The state after a turn that is kept, by its role's initial and the state before.
KEPT = {"s": {NOTHING: S}, "u": {NOTHING: U, S: U, A: U}, "a": {U: A}}
INITIALS = "sua"
#: Codes of turns: the initial's place, 3 for any other; 4 more if truncated; or one that must go.
MUST_GO = 8
NEVER = 1 << 30

Vector = tuple[int, int, int, int]


def _with_inserts(costs: list[int]) -> list[int]:
    costs[U], costs[A] = min(costs[U], INSERT + costs[A]), min(costs[A], INSERT + costs[U])
    for state in (NOTHING, S):
        costs[state] = min(costs[state], INSERT + costs[U])
    return costs


#: Costs behind the last turn: what is put out must be nothing or end in an assistant.
END: Vector = tuple(_with_inserts([0, NEVER, NEVER, 0]))
SPECULATIVE: Vector = (0, 0, 0, 0)


def _edits(after: Vector, code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a turn, their costs to the end, and the states they lead to."""
    yield "D", DELETE + after[state], state
    if code == MUST_GO:
        return
    stays = TRUNCATED if code & 4 else 0
    initial = INITIALS[code & 3 : (code & 3) + 1]
    kept = KEPT.get(initial, {}).get(state)
    if kept is not None:
        yield "K", KEEP + stays + after[kept], kept
    yield "R", REROLE + stays + after[ANSWER[state]], ANSWER[state]


@cache
def _costs(after: Vector, code: int) -> Vector:
    return tuple(
        _with_inserts([min(cost for _, cost, _ in _edits(after, code, state)) for state in range(4)])
    )


@cache
def before(after: Vector, code: int) -> Vector:
    """The vector before a turn, less its least entry, from the one behind it."""
    costs = _costs(after, code)
    least = min(costs)
    return tuple(cost - least for cost in costs)


@cache
def least_edits(after: Vector, code: int, state: int) -> tuple[str, int]:
    """The least cheapest edits up to and with this turn, and the state they lead to."""
    costs, letters = _costs(after, code), ""
    while True:
        open_ = [(letter, to) for letter, cost, to in _edits(after, code, state) if cost == costs[state]]
        inserted = INSERT + costs[ANSWER[state]] == costs[state]
        letter, to = min([*open_, ("I", ANSWER[state])] if inserted else open_)
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def closing_edits(state: int) -> str:
    """Inserts behind the last turn."""
    return {NOTHING: "", S: "II", U: "I", A: ""}[state]


def vectors_of(codes: bytes, end: Vector) -> tuple[list[Vector], Vector]:
    """The vectors behind each turn, and the one before the first."""
    vectors = [end] * len(codes)
    for i in range(len(codes) - 1, -1, -1):
        vectors[i], end = end, before(end, codes[i])
    return vectors, end


def fixed_up(codes: bytes, used: Vector, end: Vector, start: Vector) -> Vector:
    """The vector before the first turn with ``end`` behind the last, if ``used`` gave ``start``."""
    for code in reversed(codes):
        if used == end:
            return start
        used, end = before(used, code), before(end, code)
    return end


def traced(codes: bytes, end: Vector, state: int) -> tuple[list[str], int]:
    """The edits at each turn and the state behind the last."""
    vectors, _ = vectors_of(codes, end)
    letters = []
    for code, after in zip(codes, vectors, strict=True):
        found, state = least_edits(after, code, state)
        letters.append(found)
    return letters, state


def cost_of(codes: bytes, letters: list[str]) -> int:
    edits = "".join(letters)
    stay = sum(1 for code, own in zip(codes, letters, strict=False) if code & 4 and own[-1] != "D")
    return (
        REROLE * edits.count("R") + DELETE * edits.count("D") + INSERT * edits.count("I") + stay * TRUNCATED
    )


def repaired(roles: list[str], texts: list[str], letters: list[str], state: int):
    """Roles and texts after the edits; ``letters`` may have one entry more, for closing inserts."""
    new_roles, new_texts = [], []
    for i, own in enumerate(letters):
        for letter in own:
            if letter == "D":
                continue
            if letter == "K":
                new_roles.append(roles[i])
                state = KEPT[roles[i][0]][state]
            else:
                new_roles.append(ROLE[state])
                state = ANSWER[state]
            new_texts.append("" if letter == "I" else texts[i])
    return new_roles, new_texts


@dataclass
class Stretch:
    """Consecutive turns of one conversation."""

    conv_id: int | None
    no: int
    codes: bytearray = field(default_factory=bytearray)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    size: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str, repeats: bool, copies: int) -> None:
        if self.roles and not legal(self.roles[-1], role):
            self.illegal += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        bare = text.rstrip(BLANKS)
        code = INITIALS.find(role[:1]) if role else 3
        code = 3 if code < 0 else code
        if not bare:
            code, self.blank = MUST_GO, self.blank + copies
        else:
            self.duplicate += copies - 1
            if repeats:
                code, self.duplicate = MUST_GO, self.duplicate + 1
            elif bare[-1] not in ENDS:
                code, self.truncated = code | 4, self.truncated + 1
        self.codes.append(code)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        if copies > 1 and not legal(role, role):
            self.illegal += copies - 1
        self.codes.extend(bytes([MUST_GO]) * (copies - 1))
        self.roles.extend([role] * (copies - 1))
        self.texts.extend([""] * (copies - 1))

    @property
    def full(self) -> bool:
        return len(self.codes) >= STRETCH_ROWS or self.size >= STRETCH_BYTES


def legal(role: str, following: str) -> bool:
    return role[:1] + following[:1] in ("su", "ua", "au")


COUNTS = ("blank", "duplicate", "truncated", "illegal")
STRETCHES = (
    "conv_id long, part int, no long, whole boolean, closes boolean, codes binary, roles array<string>, "
    "texts array<string>, first_turn long, last_turn long, turns long, blank long, duplicate long, "
    "truncated long, illegal long, first_role string, last_role string, cost long, audit string"
)


def _stretch_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
             "string": pa.string(), "array<string>": pa.list_(pa.string())}
    names = [part.split() for part in STRETCHES.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([row[name] for row in rows], kinds[kind]) for name, kind in names],
        [name for name, _ in names],
    )


def _row(part: int, own: Stretch, whole: bool, closes: bool) -> dict:
    codes, roles, texts, cost, audit = bytes(own.codes), own.roles, own.texts, None, None
    if whole:
        letters, state = traced(codes, END, NOTHING)
        letters.append(closing_edits(state))
        cost, audit = cost_of(codes, letters), "".join(letters)
        roles, texts = repaired(roles, texts, letters, NOTHING)
        codes = b""
    return {
        "conv_id": own.conv_id, "part": part, "no": own.no, "whole": whole, "closes": closes,
        "codes": codes, "roles": roles, "texts": texts, "first_turn": own.first_turn,
        "last_turn": own.last_turn, "turns": own.turns, **{c: getattr(own, c) for c in COUNTS},
        "first_role": own.roles[0][:1], "last_role": own.roles[-1][:1], "cost": cost, "audit": audit,
    }


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of a damage that depends on their conversation and turn alone, with ``copies``: of 20 kinds,
    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's."""
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), F.lit(" ")),
    )
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.filter(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _joined(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the other columns of ``right``; nulls equal nulls in the columns named."""
    others = right.select(
        *[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in right.columns]
    )
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return left.join(others, condition, how).drop(*[f"_{name}" for name in names])


def marked_turns(rows: DataFrame) -> DataFrame:
    """Distinct rows (``conv_id``, ``turn``, ``role``, ``text``) with their ``copies`` and whether role and text
    are those of an earlier turn (``repeats``).

    Only rows whose role and text occur again in their conversation are joined or grouped with their
    texts; all others pass as they are.
    """
    said = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text"))).alias("said")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", said)
    order = F.struct(F.col("turn").isNotNull(), "turn")
    places = materialize(
        rows.groupBy("conv_id", "said", "turn").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("total")
        ),
        "places-of-turns",
    )
    firsts = (
        places.groupBy("conv_id", "said")
        .agg(F.sum("rows").alias("times"), F.min(order).alias("first"))
        .filter("times > 1")
        .select("conv_id", "said", "first")
    )
    again = _joined(places, firsts, "conv_id", "said").select(
        "conv_id", "said", "turn", "rows", "total", (order != F.col("first")).alias("repeats")
    )
    again = materialize(again, "repeated-turns")
    single = (
        _joined(rows, again, "conv_id", "said", "turn", how="left")
        .filter("rows IS NULL OR rows = 1")
        .select(*rows.columns, F.coalesce("repeats", F.lit(False)).alias("repeats"))
    )
    several = again.filter("rows > 1")
    if several.isEmpty():
        return single
    merged = (
        _joined(rows, several, "conv_id", "said", "turn")
        .groupBy("conv_id", "turn", "said")
        .agg(*[F.any_value(c).alias(c) for c in ("role", "text", "total", "repeats")])
        .withColumnRenamed("total", "copies")
    )
    return single.unionByName(merged)


def stretches(rows: DataFrame) -> DataFrame:
    """The turns in order, cut to stretches. Conversations that lie within one stretch and have others
    of their task on either side are repaired already (``whole``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size, own, first, part = [], 0, None, True, 0
        for batch in batches:
            for part, conv, turn, role, text, repeats, copies in zip(
                *(batch.column(i).to_pylist() for i in range(7)), strict=True
            ):
                if own is not None and (conv != own.conv_id or own.full):
                    closes = conv != own.conv_id
                    ready.append(_row(part, own, closes and not first and own.no == 0, closes))
                    size += own.size
                    first = first and not closes
                    own = Stretch(conv, 0 if closes else own.no + 1)
                    if size > STRETCH_BYTES or len(ready) > STRETCH_ROWS:
                        yield _stretch_batch(ready)
                        ready, size = [], 0
                own = own or Stretch(conv, 0)
                # Very many copies of one row fill several stretches.
                while copies > STRETCH_ROWS:
                    own.add(turn, role, text, repeats, STRETCH_ROWS)
                    ready.append(_row(part, own, False, False))
                    own, copies, repeats = Stretch(conv, own.no + 1), copies - STRETCH_ROWS, True
                    if len(ready) > 64:
                        yield _stretch_batch(ready)
                        ready, size = [], 0
                own.add(turn, role, text, repeats, copies)
        if own is not None:
            ready.append(_row(part, own, False, True))
        if ready:
            yield _stretch_batch(ready)

    ordered = rows.orderBy(
        "conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64), "said"
    )
    return ordered.select(
        F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "repeats", "copies"
    ).mapInArrow(cut, STRETCHES)


KEY = ("conv_id", "part", "chunk")


def _map_rows(df: DataFrame, function, schema: str) -> DataFrame:
    """Each row, as a dict, to the dicts that ``function`` yields; rows are chunks, so they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                found = [x for row in batch.slice(i, 1).to_pylist() for x in function(row)]
                if found:
                    columns = {name: [x[name] for x in found] for name in names}
                    yield pa.RecordBatch.from_pydict(columns, schema=kinds)

    names = [part.split()[0] for part in schema.split(", ")]
    of = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
          "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    kinds = pa.schema([(p.split()[0], of[p.split()[1]]) for p in schema.split(", ")])
    return df.mapInArrow(run, schema)


def chunks(open_stretches: DataFrame) -> DataFrame:
    """Codes of up to ``CHUNK_STRETCHES`` stretches a row, and the place of the chunk that follows."""
    spark = open_stretches.sparkSession
    # As many as there are range partitions at most.
    parts = sorted(r[0] for r in open_stretches.select("part").distinct().collect())
    follow = spark.createDataFrame(
        [(a, b) for a, b in zip(parts, [*parts[1:], -1], strict=True)], "part int, next int"
    )
    rows = (
        open_stretches.groupBy(
            "conv_id", "part", F.floor(F.col("no") / CHUNK_STRETCHES).cast("long").alias("chunk")
        )
        .agg(
            F.sort_array(F.collect_list(F.struct("no", "codes"))).alias("pieces"),
            F.max("closes").alias("closes"),
        )
        .join(follow, "part")
    )
    return rows.select(
        *KEY,
        "pieces",
        F.when(F.col("closes"), F.col("next")).otherwise(F.col("part")).alias("next_part"),
        F.when(F.col("closes"), 0).otherwise(F.col("chunk") + 1).cast("long").alias("next_chunk"),
    )


def _codes(row: dict) -> bytes:
    return b"".join(piece["codes"] for piece in row["pieces"])


def converged(codes: DataFrame) -> tuple[DataFrame, int]:
    """Each chunk with the vector behind its end (``used``) and whether it is a conversation's last
    one (``final``), and how many fix-up passes it took."""
    schema = "conv_id long, part int, chunk long, used array<int>, start array<int>"

    def speculate(row):
        _, start = vectors_of(_codes(row), SPECULATIVE)
        yield {**{k: row[k] for k in KEY}, "used": SPECULATIVE, "start": start}

    def fix(row):
        used, end, start = (tuple(row[k]) for k in ("used", "end", "start"))
        yield {**{k: row[k] for k in KEY}, "used": end, "start": fixed_up(_codes(row), used, end, start)}

    vectors = materialize(_map_rows(codes, speculate, schema), "speculative-vectors")
    passes = 0
    while True:
        following = vectors.select(
            F.col("conv_id").alias("f_conv"), F.col("part").alias("f_part"),
            F.col("chunk").alias("f_chunk"), F.col("start").alias("f_start"),
        )
        known = (
            _joined(codes, vectors, *KEY)
            .join(
                following,
                F.col("conv_id").eqNullSafe(F.col("f_conv"))
                & (F.col("next_part") == F.col("f_part"))
                & (F.col("next_chunk") == F.col("f_chunk")),
                "left",
            )
            .select(
                *KEY, "pieces", "used", "start",
                F.coalesce("f_start", F.array(*map(F.lit, END))).alias("end"),
                F.col("f_part").isNull().alias("final"),
            )
        )
        if known.filter("used <> end").isEmpty():
            return known.select(*KEY, "pieces", "used", "final"), passes
        vectors = materialize(_map_rows(known, fix, schema), "vectors")
        passes += 1


def solved_stretches(codes: DataFrame) -> DataFrame:
    """Per open stretch the state it begins in, the vector behind it and whether it is the last."""
    known, _ = converged(codes)
    known = materialize(known, "chunk-vectors")

    def through(row):
        own = _codes(row)
        ends = [traced(own, tuple(row["used"]), state)[1] for state in range(4)]
        yield {**{k: row[k] for k in KEY}, "ends": ends}

    def stitch(row):
        state = NOTHING
        for part, chunk, ends in sorted((x["part"], x["chunk"], x["ends"]) for x in row["chain"]):
            yield {"conv_id": row["conv_id"], "part": part, "chunk": chunk, "state": state}
            state = ends[state]

    ends = _map_rows(known, through, "conv_id long, part int, chunk long, ends array<int>")
    # One entry per chunk, that is about a million turns, or per task that the conversation touches.
    chains = ends.groupBy("conv_id").agg(F.collect_list(F.struct("part", "chunk", "ends")).alias("chain"))
    states = _map_rows(chains, stitch, "conv_id long, part int, chunk long, state int")

    def split(row):
        end, behind = tuple(row["used"]), []
        for piece in reversed(row["pieces"]):
            behind.append(end)
            _, end = vectors_of(piece["codes"], end)
        state, last = row["state"], len(row["pieces"]) - 1
        for i, (piece, end) in enumerate(zip(row["pieces"], reversed(behind), strict=True)):
            yield {
                "conv_id": row["conv_id"], "part": row["part"], "no": piece["no"], "state": state,
                "end": end, "last": row["final"] and i == last,
            }
            state = traced(piece["codes"], end, state)[1]

    return _map_rows(
        _joined(known, states, *KEY),
        split,
        "conv_id long, part int, no long, state int, end array<int>, last boolean",
    )


def repair(rows: DataFrame) -> DataFrame:
    """Stretches of repaired turns in ``roles`` and ``texts``, ordered by ``conv_id``, ``part`` and ``no``, with
    their part of the ``audit``, its ``cost`` and the counts of faults.

    ``rows`` holds ``conv_id``, ``turn``, ``role``, ``text`` (none null but the first two) and ``copies``.
    """
    cut = materialize(stretches(marked_turns(rows)), "stretches")
    open_ = cut.filter("NOT whole")
    if open_.isEmpty():
        return cut.drop("codes")
    solved = solved_stretches(materialize(chunks(open_), "chunks"))
    solved = materialize(solved, "solved-stretches")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                letters, state = traced(row["codes"], tuple(row["end"]), row["state"])
                if row["last"]:
                    letters.append(closing_edits(state))
                row["cost"], row["audit"] = cost_of(row["codes"], letters), "".join(letters)
                row["roles"], row["texts"] = repaired(row["roles"], row["texts"], letters, row["state"])
                yield _stretch_batch([row])

    done = (
        _joined(open_, solved, "conv_id", "part", "no")
        .select(*cut.columns, "state", "end", "last")
        .mapInArrow(apply, STRETCHES)
    )
    return cut.filter("whole").unionByName(done).drop("codes")


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def conversation_reports(repaired_stretches: DataFrame) -> DataFrame:
    """One row per conversation from its stretches: gaps in its turns, faults, cost, audit and the
    checksum of its repaired turns, ``role:text`` each, joined by line ends."""
    text = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.when(
        F.col("first_turn").isNotNull(), F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")
    ).otherwise(F.lit(0))
    whole = repaired_stretches.filter("whole").select(
        "conv_id", gaps.cast("long").alias("gaps"), *COUNTS, "cost", "audit",
        F.sha2(text, 256).alias("repaired_sha256"),
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in REPORT.split(", ")]
        own = None

        def done():
            first, last = own.pop("first"), own.pop("last")
            own["gaps"] = 0 if first is None else last - first + 1 - own.pop("turns")
            own["audit"] = "".join(own["audit"])
            own["repaired_sha256"] = own.pop("hash").hexdigest()
            return pa.RecordBatch.from_pylist([{n: own[n] for n in names}], schema=kinds)

        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                if own is None or own["conv_id"] != row["conv_id"]:
                    if own is not None:
                        yield done()
                    own = {
                        "conv_id": row["conv_id"], "audit": [], "cost": 0, "hash": hashlib.sha256(),
                        "first": None, "last": None, "turns": 0, "role": None, "begun": False,
                        **dict.fromkeys(COUNTS, 0),
                    }
                elif not legal(own["role"], row["first_role"]):
                    own["illegal"] += 1
                own["role"] = row["last_role"]
                for name in (*COUNTS, "cost"):
                    own[name] += row[name]
                own["turns"] += row["turns"] - (row["turns"] > 0 and own["last"] == row["first_turn"])
                if row["turns"]:
                    own["first"] = row["first_turn"] if own["first"] is None else own["first"]
                    own["last"] = row["last_turn"]
                own["audit"].append(row["audit"])
                for role, said in zip(row["roles"], row["texts"], strict=True):
                    own["hash"].update(f"{chr(10) if own['begun'] else ''}{role}:{said}".encode())
                    own["begun"] = True
        if own is not None:
            yield done()

    of = {"long": pa.int64(), "string": pa.string()}
    kinds = pa.schema([(p.split()[0], of[p.split()[1]]) for p in REPORT.split(", ")])
    parted = (
        repaired_stretches.filter("NOT whole")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "no")
        .mapInArrow(add_up, REPORT)
    )
    return whole.unionByName(parted)


def repair_reports(conversations: DataFrame) -> DataFrame:
    """The report of every original ``conv_id`` after ``damaged`` and ``repair``; one without rows left has
    zeros, an empty audit and the checksum of the empty text."""
    reports = conversation_reports(repair(damaged(conversations)))
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return ids.join(reports, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"),
        *[
            F.coalesce(name, F.lit(empty.get(name, 0))).alias(name)
            for name in reports.columns
            if name != "conv_id"
        ],
    )
