"""Repair of conversation structure at the lowest cost.

A conversation's rows become symbols of role and fault.  A symbol is a min-plus
transfer matrix over the states of the grammar s?(ua)+ (nothing yet, after the
system turn, after a user turn, after an assistant turn); an entry is the lowest
cost from state to state with the audit, the letters of its edits, of which the
ASCII-least wins among equal costs.  Re-Pair replaces frequent pairs of symbols
by rules, over the distinct sequences of all conversations; a rule's matrix is
the product of its two parts' matrices, evaluated once, bottom-up, with audits as
ropes that share their parts, and used by every conversation that holds the rule.

Conversations are cut into blocks of rows by position in one global order, so a
conversation of any length is spread over tasks: blocks' matrices are multiplied
level by level, and the cheapest path is handed down again the same way."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_state

#: Rows of a block, as a power of two, and blocks (then groups of blocks) multiplied at once.
BLOCK_BITS, FAN_BITS = 8, 8
#: Re-Pair: rules added in a round, and rounds.
ROUND_RULES, ROUNDS = 48, 8
#: Characters of a text that decide on a range's bounds; the order itself takes whole texts.
BOUND_CHARS = 64

COST = {"K": 0, "R": 2, "D": 3, "I": 2}
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
#: Accepting states: nothing at all, or an assistant turn last.
ACCEPT = (START, ASSISTANT)
NO_MARK = "x"  # symbol of a row that has to go


# Ropes and matrices ----------------------------------------------------------

class Rope:
    """Text as a tree of shared parts, with a hash to skip equal parts."""

    __slots__ = ("text", "left", "right", "length", "hash")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.length, self.hash = len(text), 0
            for c in text:
                self.hash = (self.hash * RADIX + ord(c)) % PRIME
        else:
            self.length = left.length + right.length
            self.hash = (left.hash * _power(right.length) + right.hash) % PRIME

    def parts(self):
        stack = [self]
        while stack:
            r = stack.pop()
            if r.text is not None:
                yield r.text
            else:
                stack += (r.right, r.left)

    def __str__(self) -> str:
        return "".join(self.parts())


PRIME, RADIX = (1 << 61) - 1, 1_000_003


@lru_cache(maxsize=4096)
def _power(n: int) -> int:
    return pow(RADIX, n, PRIME)


def joined(a: Rope, b: Rope) -> Rope:
    return b if not a.length else a if not b.length else Rope(None, a, b)


def less(a: Rope, b: Rope) -> bool:
    """Whether a's text comes before b's; equal parts are passed by their hash."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q or (p.length == q.length and p.hash == q.hash):
            continue
        if p.text is not None and q.text is not None:
            n = min(p.length, q.length)
            if p.text[:n] != q.text[:n]:
                return p.text < q.text
            if p.length > n:
                x.append(Rope(p.text[n:]))
            if q.length > n:
                y.append(Rope(q.text[n:]))
        elif q.text is not None or (p.text is None and p.length >= q.length):
            x += (p.right, p.left)
            y.append(q)
        else:
            x.append(p)
            y += (q.right, q.left)
    return bool(y) and not x


#: (cost, audit) or None where no edits lead from one state to the other.
Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def then(a: Entry, b: Entry) -> Entry:
    return None if a is None or b is None else (a[0] + b[0], joined(a[1], b[1]))


def product(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for row in x:
        line = []
        for j in range(STATES):
            best = None
            for k in range(STATES):
                if row[k] is not None and y[k][j] is not None and \
                        (best is None or row[k][0] + y[k][j][0] <= best[0]):
                    best = better(best, then(row[k], y[k][j]))
            line.append(best)
        out.append(line)
    return out


def empty() -> Matrix:
    return [[None] * STATES for _ in range(STATES)]


def inserted(state: int) -> int:
    """The state after an inserted (or reroled) turn: its role follows from the state."""
    return ASSISTANT if state == USER else USER


def inserts() -> Matrix:
    """Any number of insertions; the fewest is always the cheapest."""
    out = empty()
    for i in range(STATES):
        at, n = i, 0
        while out[i][at] is None:
            out[i][at] = (n * COST["I"], Rope("I" * n))
            at, n = inserted(at), n + 1
    return out


INSERTS = inserts()


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions before a row, then the row's own edit.  Symbols: s, u, a and o
    (another role), upper case for a truncated row, x for one that has to go."""
    edit = empty()
    for i in range(STATES):
        edit[i][i] = (COST["D"], Rope("D"))
        if symbol == NO_MARK:
            continue
        extra = int(symbol.isupper())
        role = symbol.lower()
        target = {"s": SYSTEM if i == START else None, "u": USER if i != USER else None,
                  "a": ASSISTANT if i == USER else None, "o": None}[role]
        if target is not None:
            edit[i][target] = better(edit[i][target], (COST["K"] + extra, Rope("K")))
        edit[i][inserted(i)] = better(edit[i][inserted(i)], (COST["R"] + extra, Rope("R")))
    return product(INSERTS, edit)


class Grammar:
    """Rules of pairs; rule k has the symbol FIRST + k.  Matrices are evaluated
    when first asked for, parts before wholes, and kept."""

    FIRST = 0xE000

    def __init__(self, rules: list[str]):
        self.rules, self.known = rules, {}

    def matrix(self, symbol: str) -> Matrix:
        found = self.known.get(symbol)
        if found is None:
            k = ord(symbol) - self.FIRST
            found = symbol_matrix(symbol) if k < 0 else \
                product(self.matrix(self.rules[k][0]), self.matrix(self.rules[k][1]))
            self.known[symbol] = found
        return found

    def evaluate(self, sequence: str) -> Matrix:
        out = None
        for c in sequence:
            out = self.matrix(c) if out is None else product(out, self.matrix(c))
        return out


def written(m: Matrix) -> str:
    return ",".join("" if e is None else f"{e[0]}:{e[1]}" for row in m for e in row)


def read(text: str) -> Matrix:
    cells = [None if not c else (int(c.partition(":")[0]), Rope(c.partition(":")[2])) for c in text.split(",")]
    return [cells[i:i + STATES] for i in range(0, len(cells), STATES)]


def cheapest(parts: list[Matrix], start: int, ends: list[Entry]) -> tuple[int, list[int], int]:
    """The lowest cost through all parts from `start`, with what each end state
    still costs; the states passed (one more than parts)."""
    reach: list[Entry] = [(0, Rope("")) if s == start else None for s in range(STATES)]
    back = []
    for m in parts:
        new, came = [], []
        for j in range(STATES):
            best, source = None, 0
            for k in range(STATES):
                e = then(reach[k], m[k][j])
                if e is not None and better(best, e) is e:
                    best, source = e, k
            new.append(best)
            came.append(source)
        reach = new
        back.append(came)
    best, last = None, 0
    for j in range(STATES):
        e = then(reach[j], ends[j])
        if e is not None and better(best, e) is e:
            best, last = e, j
    states = [last]
    for came in reversed(back):
        states.append(came[states[-1]])
    return best[0], states[::-1], last


def tail_of(state: int) -> Entry:
    """The insertions that end a conversation from a state."""
    best = None
    for a in ACCEPT:
        best = better(best, INSERTS[state][a])
    return best


# Rows to symbols ------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def damage(rows: DataFrame) -> DataFrame:
    """Known faults, dealt by crc32 of `conv_id:turn`: rows dropped, emptied, cut
    of their end marks, repeated or given the user's role; nulls read as a space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    text, deal = F.coalesce("text", space), F.col("deal")
    dealt = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("deal")).where(deal != 0)
    return dealt.select(
        "conv_id", "turn", F.when(deal == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(deal == 1, "").when(deal == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(deal == 3, 2).otherwise(1))).alias("again")).drop("again")


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Equal rows folded to one with their number, each with its first fault, in
    one global order of (conversation, turn, role, text): `pos` rises with it."""
    space = F.lit(" ")
    rows = rows.select(_key("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    folded = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")) \
        .withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    folded = materialize(folded)
    # the first turn of a role and text, one row a conversation and text whatever its copies
    first = folded.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(end == "", "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate") \
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.left("role", F.lit(1))
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    faulty = folded.join(first, ["conv", "role", "digest"]).select(
        "conv", "turn", "role", "text", "copies", fault.alias("fault"), role.alias("initial"))
    return materialize(
        faulty.withColumn("bound", F.left("text", F.lit(BOUND_CHARS)))
        .repartitionByRange("conv", "turn", "role", "bound").sortWithinPartitions("conv", "turn", "role", "text")
        .drop("bound").withColumn("pos", F.monotonically_increasing_id()))


def fault_counts(rows: DataFrame) -> DataFrame:
    """Faults and missing turns per conversation; a row's further copies are duplicates."""
    n, more = F.col("copies"), F.col("copies") - 1
    is_a = {f: F.col("fault") == f for f in ("blank", "duplicate", "truncated")}
    per_turn = rows.groupBy("conv", "turn").agg(
        F.sum(F.when(is_a["blank"], n).otherwise(0)).alias("blank"),
        F.sum(F.when(is_a["duplicate"], n).when(is_a["blank"], 0).otherwise(more)).alias("duplicate"),
        F.sum(F.when(is_a["truncated"], 1).otherwise(0)).alias("truncated"))
    return per_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in is_a])


def blocks_of(rows: DataFrame, bits: int) -> DataFrame:
    """Runs of a conversation's rows of at most 2 ** `bits` positions, as symbols."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), NO_MARK) \
        .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    legal = ("su", "ua", "au")
    row = F.struct("pos", "copies", "initial", symbol.alias("symbol"))
    got = rows.groupBy("conv", F.shiftright("pos", bits).alias("b")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    n = F.size("rows")
    steps = F.zip_with(F.slice("rows", 1, n - 1), F.slice("rows", 2, n - 1),
                       lambda x, y: F.concat(x["initial"], y["initial"]).isin(*legal))
    return got.select(
        "conv", "b", "rows",
        F.array_join(F.transform("rows", lambda r: F.concat(
            r["symbol"], F.repeat(F.lit(NO_MARK), (r["copies"] - 1).cast("int")))), "").alias("symbols"),
        F.element_at("rows", 1)["initial"].alias("first"), F.element_at("rows", -1)["initial"].alias("last"),
        (F.size(F.filter(steps, lambda ok: ~ok)) + F.aggregate(
            "rows", F.lit(0).cast("bigint"), lambda s, r: s + r["copies"] - 1)).cast("bigint").alias("illegal"))


def re_pair(sequences: DataFrame, rounds: int, per_round: int) -> tuple[DataFrame, list[str]]:
    """(symbols, compressed) of the distinct sequences, and the rules.  A round
    counts all adjacent pairs and replaces the most frequent ones, each wherever
    it still stands, from the left.  How far it gets changes no result."""
    rules: list[str] = []
    now = materialize(sequences.select("symbols", F.col("symbols").alias("compressed")))
    for _ in range(rounds):
        pairs = now.where(F.length("compressed") > 1).select(F.explode(F.expr(
            "transform(sequence(1, length(compressed) - 1), i -> substring(compressed, i, 2))")).alias("pair"))
        top = pairs.groupBy("pair").count().where("count > 1").orderBy(F.desc("count"), "pair").limit(per_round)
        new = [r["pair"] for r in top.collect()]
        if not new:
            break
        out = F.col("compressed")
        for k, pair in enumerate(new, len(rules)):
            out = F.replace(out, F.lit(pair), F.lit(chr(Grammar.FIRST + k)))
        rules += new
        now = materialize(now.select("symbols", out.alias("compressed")))
    return now, rules


def _grammar(rules: list[str]) -> Grammar:
    """A worker's matrices, shared by all it evaluates with the same rules."""
    state = worker_state()
    if state.get("grammar_rules") != rules:
        state["grammar_rules"], state["grammar"] = rules, Grammar(rules)
    return state["grammar"]


def _evaluate(rules: list[str]):
    def run(batches):
        g = _grammar(rules)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("symbols"),
                 pa.array([written(g.evaluate(s)) for s in b.column("compressed").to_pylist()], pa.string())],
                ["symbols", "m"])
    return run


# Levels of blocks ------------------------------------------------------------

LINK = ("su", "ua", "au")


def _joined_ends(kids: list[dict]) -> int:
    return sum(k["illegal"] for k in kids) + sum(
        a["last"] + b["first"] not in LINK for a, b in zip(kids, kids[1:]))


def _by_rows(schema: pa.Schema, one):
    """Batches through a function of one row (as a dict) that gives one row."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(r) for r in b.to_pylist()], schema)
    return run


def _multiply(r: dict) -> dict:
    kids = r["kids"]
    m = read(kids[0]["m"])
    for k in kids[1:]:
        m = product(m, read(k["m"]))
    return {"conv": r["conv"], "b": r["b"], "m": written(m), "first": kids[0]["first"], "last": kids[-1]["last"],
            "illegal": _joined_ends(kids)}


def _steps(kids: list[dict], states: list[int]) -> list[dict]:
    return [{"b": k["b"], "start": s, "end": e} for k, s, e in zip(kids, states, states[1:])]


def _decide(r: dict) -> dict:
    kids = r["kids"]
    cost, states, last = cheapest([read(k["m"]) for k in kids], START, [tail_of(s) for s in range(STATES)])
    return {"conv": r["conv"], "cost": cost, "illegal": _joined_ends(kids), "tail": str(tail_of(last)[1]),
            "last": last, "steps": _steps(kids, states)}


def _hand_down(r: dict) -> dict:
    kids = r["kids"]
    ends = [(0, Rope("")) if s == r["end"] else None for s in range(STATES)]
    return {"conv": r["conv"], "steps": _steps(kids, cheapest([read(k["m"]) for k in kids], r["start"], ends)[1])}


STEP = pa.list_(pa.struct([("b", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
MULTIPLIED = pa.schema([("conv", pa.string()), ("b", pa.int64()), ("m", pa.string()), ("first", pa.string()),
                        ("last", pa.string()), ("illegal", pa.int64())])
DECIDED = pa.schema([("conv", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("tail", pa.string()),
                     ("last", pa.int64()), ("steps", STEP)])
HANDED = pa.schema([("conv", pa.string()), ("steps", STEP)])
STEP_DDL = "steps array<struct<b:bigint,start:bigint,end:bigint>>"
KID = ("b", "m", "first", "last", "illegal")


def _with_kids(level: DataFrame, *keys) -> DataFrame:
    return level.groupBy("conv", *keys).agg(F.sort_array(F.collect_list(F.struct(*KID))).alias("kids"))


def decide(blocks: DataFrame, fan_bits: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, cost, illegal, tail, last) and the state before and
    after each block.  Conversations of more than 2 ** `fan_bits` blocks go up
    level by level, so no task ever holds more blocks than that."""
    levels = [blocks.select("conv", *KID)]
    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > 1 << fan_bits:
        up = F.shiftright("b", fan_bits).alias("up")
        kids = _with_kids(levels[-1], up).withColumnRenamed("up", "b")
        levels.append(materialize(kids.mapInArrow(
            _by_rows(MULTIPLIED, _multiply),
            "conv string, b bigint, m string, first string, last string, illegal bigint")))
    decided = materialize(_with_kids(levels[-1]).mapInArrow(
        _by_rows(DECIDED, _decide),
        f"conv string, cost bigint, illegal bigint, tail string, last bigint, {STEP_DDL}"))

    def states(frame: DataFrame) -> DataFrame:
        return frame.select("conv", F.explode("steps").alias("s")).select("conv", "s.b", "s.start", "s.end")

    at = states(decided)
    for level in levels[-2::-1]:
        kids = _with_kids(level, F.shiftright("b", fan_bits).alias("up")).withColumnRenamed("up", "b")
        at = states(materialize(at.join(kids, ["conv", "b"]).mapInArrow(
            _by_rows(HANDED, _hand_down), f"conv string, {STEP_DDL}")))
    return decided.drop("steps"), at


# Edits to rows ---------------------------------------------------------------

TURN_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}


def edited(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The lines that a block's audit leaves: pos, sub (order at a position),
    role (null: the row's own) and whether the row's text stands there."""
    out, letters = [], iter(audit)
    for r in rows:
        sub = 0
        for copy in range(r["copies"]):
            for letter in letters:
                if letter == "D":
                    break
                own = letter == "K"
                state = TURN_AFTER[r["initial"]] if own else inserted(state)
                out.append({"pos": r["pos"], "sub": sub, "role": None if own else ROLE[state], "text": letter != "I"})
                sub += 1
                if letter != "I":
                    break
    return out


LINES = pa.schema([("conv", pa.string()), ("lines", pa.list_(pa.struct(
    [("pos", pa.int64()), ("sub", pa.int64()), ("role", pa.string()), ("text", pa.bool_())])))])
LINES_DDL = "conv string, lines array<struct<pos:bigint,sub:bigint,role:string,text:boolean>>"


def _lines(r: dict) -> dict:
    return {"conv": r["conv"], "lines": edited(r["rows"], r["audit"], r["start"])}


def _tail(r: dict) -> dict:
    out, state = [], r["last"]
    for i in range(len(r["tail"])):
        state = inserted(state)
        out.append({"pos": (1 << 63) - 1, "sub": i, "role": ROLE[state], "text": False})
    return {"conv": r["conv"], "lines": out}


def repair_conversations(rows: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS,
                         rounds: int = ROUNDS, round_rules: int = ROUND_RULES) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) -> two tables.  Conversations: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit.  Repaired rows: conv_id,
    pos and sub (their order), role, text.

    Rows of one turn stand in order of role and text, null turns first.  A null
    role or text reads as one space, which is no role of the grammar and blank;
    an empty role is none either.  Rows of a null conv_id are one conversation.
    Equal rows are counted, not carried; all but the first are duplicates.  An
    empty table gives no rows; other columns are not read."""
    kind = rows.schema["conv_id"].dataType
    t = ordered_rows(rows)
    blocks = materialize(blocks_of(t, block_bits))
    compressed, rules = re_pair(blocks.select("symbols").distinct(), rounds, round_rules)
    matrices = compressed.mapInArrow(_evaluate(rules), "symbols string, m string")
    blocks = materialize(blocks.join(matrices, "symbols").drop("symbols"))
    decided, states = decide(blocks, fan_bits)
    cell = F.element_at(F.split("m", ","), (F.col("start") * STATES + F.col("end") + 1).cast("int"))
    solved = materialize(blocks.join(states, ["conv", "b"]).select(
        "conv", "b", "rows", "start", F.element_at(F.split(cell, ":"), 2).alias("audit")))

    audits = solved.groupBy("conv").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("b", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 2147483647).cast(kind)).alias("conv_id")
    conversations = fault_counts(t).join(decided, "conv").join(audits, "conv").select(
        conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.concat("audit", "tail").alias("audit"))

    lines = solved.mapInArrow(_by_rows(LINES, _lines), LINES_DDL).unionByName(
        decided.where("tail <> ''").mapInArrow(_by_rows(LINES, _tail), LINES_DDL))
    lines = lines.select("conv", F.explode("lines").alias("l")).select("conv", "l.*").withColumnRenamed("text", "own")
    kept = t.select("pos", F.col("role").alias("row_role"), F.col("text").alias("row_text"))
    text = F.when(F.col("own"), F.col("row_text")).otherwise("")
    repaired = lines.join(kept, "pos", "left").select(
        conv_id, "pos", "sub", F.coalesce("role", "row_role").alias("role"), text.alias("text"))
    return conversations, repaired


def _digest(batches):
    """Streams sorted lines: one hash at work, no text kept."""
    conv, state, started = None, None, False
    out: list[tuple[str, str]] = []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())],
            ["conv", "repaired_sha256"])

    for b in batches:
        for c, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist(), strict=True):
            if not started or c != conv:
                if started:
                    out.append((conv, state.hexdigest()))
                conv, state, started = c, hashlib.sha256(line.encode()), True
            else:
                state.update(b"\n" + line.encode())
        if out:
            yield batch()
            out = []
    if started:
        out.append((conv, state.hexdigest()))
        yield batch()


def text_digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of each conversation's `role:text` lines.  SHA-256
    is one chain by its nature: a conversation's lines pass one task as a sorted
    stream, of which no more than a batch is in memory."""
    lines = repaired.select(_key("conv_id").alias("conv"), "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "pos", "sub").select("conv", "line") \
        .mapInArrow(_digest, "conv string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damages a table of conversations, repairs it, and gives a row for every
    conv_id of the table, those that lost all rows included (zeros, no edits)."""
    found, repaired = repair_conversations(damage(conversations))
    digests = text_digests(repaired)
    found = found.withColumn("conv", _key("conv_id")).drop("conv_id")
    every = conversations.select("conv_id").distinct().withColumn("conv", _key("conv_id"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, "conv", "left").join(digests, "conv", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
