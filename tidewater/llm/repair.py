"""Conversation structure repair: the cheapest edits that give every conversation a regular turn order.

Regular means that the initials of the roles read ``(s?(ua)+)?``.  A row is
kept (cost 0), given the role user or assistant (1) or deleted (2, the only
choice for blank and duplicate rows); an empty user or assistant row can be
inserted anywhere (5); a truncated row that stays costs 5 more.  Of the
cheapest edits, those whose initials (K, R, D, I) are least in ASCII order
are taken.  An edit's initial and the state before it say which role a
re-roled or inserted row gets, so the audit string is the whole answer.

Grammar-compressed dynamic programme.  A conversation is a string of symbols,
one per row (role class, truncated or not, or "must go").  Re-Pair replaces
the most frequent pair of neighbouring symbols of all conversations by a new
symbol, again and again; several pairs that share no symbol are replaced in
one round.  Every symbol has one 4 x 4 min-plus transfer matrix over the
states of the automaton of ``(s?(ua)+)?``, whose entries are a cost and an
audit rope (a pair of the ropes below it).  The matrix of a rule is the
product of its two halves, computed once, bottom-up, and shared by all
conversations; a conversation multiplies the few matrices that its string is
compressed to.  Ties compose: two equally dear audits of the same rows
between the same states are never prefixes of each other, because the longer
one would hold more inserts.

Scale.  Pair counts are aggregated per distinct string before they meet, and
the driver sees at most ``PER_ROUND`` pairs a round.  Rows are ordered by a
range partitioning of (conversation, turn, role, digest), so that the symbols
of a conversation of any size are spread over the tasks, in blocks of
``BLOCK``.  The edits are applied while a sorted partition streams by: memory
is bounded by one batch and the audit of one conversation (a character per
row, part of the result).  While blocks are multiplied, states that can no
longer win are dropped and the common beginning of the others' audits is set
down.

Defined results: a null role or text is one space, a null turn comes before
all others, a null conversation id is a conversation of its own; rows of one
turn are taken by role, then by the SHA-256 of their text; a role whose first
character is not s, u or a (an empty one too) cannot be kept; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewater.session import materialize

ROUNDS, PER_ROUND = 6, 16
BLOCK = 4096
SETTLE = 256            # compressed symbols after which the common beginning of the audits is set down
OUT_CHARS = 1 << 20
SPACE = " \t\n\x0b\x0c\r"
FIRST_RULE = 0xE000     # rules are private-use characters, terminals ASCII letters

#: the automaton of (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after ua
GO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = range(4), (0, 3)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: what it costs at most to go on from the second state as one could from the first
DETOUR = {(0, 3): DELETE, (0, 2): INSERT + DELETE, (0, 1): 2 * INSERT, (1, 0): 0, (1, 2): INSERT, (1, 3): 0,
          (2, 0): INSERT, (2, 1): INSERT, (2, 3): INSERT, (3, 0): 0, (3, 1): 2 * INSERT, (3, 2): INSERT}


# ----------------------------------------------------------- min-plus algebra
# A rope is a string or a pair of ropes; an entry is (cost, rope); a matrix maps (from, to) to an entry.
def flat(rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += (r[1], r[0])
    return "".join(out)


def _better(a, b):
    """The cheaper entry, at equal cost the one with the lesser audit."""
    if a is None or (b is not None and b[0] < a[0]):
        return b
    if b is None or a[0] < b[0]:
        return a
    return a if flat(a[1]) <= flat(b[1]) else b


def product(a: dict, b: dict) -> dict:
    """Min-plus product of two matrices, or of a vector (keys are states) and a matrix."""
    out: dict = {}
    for start, (cost, rope) in a.items():
        head, middle = start if isinstance(start, tuple) else (None, start)
        for (m, end), (more, tail) in b.items():
            if m == middle:
                key = end if head is None else (head, end)
                out[key] = _better(out.get(key), (cost + more, (rope, tail)))
    return out


def _inserts() -> dict:
    out = {(p, p): (0, "") for p in STATES}
    for p in STATES:
        state, cost, audit = p, 0, ""
        while True:
            state, cost, audit = GO[state, "a" if state == 2 else "u"], cost + INSERT, audit + "I"
            if (p, state) in out:
                break
            out[p, state] = (cost, audit)
    return out


INSERTS = _inserts()


def terminal(symbol: str) -> dict:
    """Matrix of one row, inserts before it included: s, u, a, o (capital if truncated), or x for one that must go."""
    edits = {(p, p): (DELETE, "D") for p in STATES}
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for (p, to), q in GO.items():
        if symbol != "x" and to == role:
            edits[p, q] = _better(edits.get((p, q)), (extra, "K"))
        elif symbol != "x" and to != "s":
            edits[p, q] = _better(edits.get((p, q)), (extra + REROLE, "R"))
    return product(INSERTS, edits)


class Grammar:
    """Rules in the order they were made, and a matrix for every symbol."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules  # (pair of symbols, symbol)
        self.matrix = {s: terminal(s) for s in "suaoSUAOx"}
        for pair, symbol in rules:
            self.matrix[symbol] = product(self.matrix[pair[0]], self.matrix[pair[1]])

    def compress(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            symbols = symbols.replace(pair, symbol)
        return symbols


def learn(strings: DataFrame, *, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Grammar:
    """Re-Pair over the distinct symbol strings (symbols, n)."""
    rules: list[tuple[str, str]] = []
    text = F.col("symbols")
    for _ in range(rounds):
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        last = F.greatest(F.size("c") - 1, F.lit(0))
        pairs = F.zip_with(F.slice("c", 1, last), F.slice("c", 2, last), lambda a, b: F.concat(a, b))
        top = (strings.select(chars.alias("c"), "n").select(F.explode(pairs).alias("pair"), "n")
               .groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "pair").limit(per_round).collect())
        used: set[str] = set()
        for pair in (r["pair"] for r in top):
            if used.isdisjoint(pair):
                used |= set(pair)
                rules.append((pair, chr(FIRST_RULE + len(rules))))
                text = F.replace(text, F.lit(pair), F.lit(rules[-1][1]))
        if not used:
            break
    return Grammar(rules)


class Fold:
    """Running product of a conversation's blocks, from the first state on."""

    def __init__(self):
        self.done: list[str] = []
        self.live: dict = {0: (0, "")}
        self.pending = 0

    def add(self, grammar: Grammar, symbols: str) -> None:
        for s in grammar.compress(symbols):
            self.live = product(self.live, grammar.matrix[s])
            self.pending += 1
            if self.pending == SETTLE:
                self._settle()

    def _settle(self) -> None:
        cost = {p: c for p, (c, _) in self.live.items()}
        flats = {p: (c, flat(r)) for p, (c, r) in self.live.items()
                 if all(cost[q] + DETOUR[p, q] >= c for q in cost if q != p)}
        texts = [t for _, t in flats.values()]
        least, most = min(texts), max(texts)
        n = next((i for i, (x, y) in enumerate(zip(least, most)) if x != y), min(map(len, texts)))
        self.done.append(least[:n])
        self.live = {p: (c, t[n:]) for p, (c, t) in flats.items()}
        self.pending = 0

    def best(self) -> tuple[int, str]:
        ends = product(self.live, INSERTS)
        cost, rope = _better(ends.get(0), ends.get(3))
        return cost, "".join(self.done) + flat(rope)


# ------------------------------------------------------------------- rows
def _typed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    text = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _messages(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn as one message with their number, and whether the same was said in an earlier turn."""
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    said = (rows.select("conv", "turn", "role", "digest", end.alias("end")).groupBy("conv", "turn", "role", "digest")
            .agg(F.count("*").alias("n"), F.first("end").alias("end")))
    said = materialize(said, "repair-messages")
    again = (said.groupBy("conv", "role", "digest").agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.count("turn").alias("dated"))
             .where("turns > 1").select(F.col("conv").alias("c2"), F.col("role").alias("r2"), F.col("digest").alias("d2"),
                                        F.when(F.col("turns") == F.col("dated"), F.col("first")).alias("first"), F.lit(True).alias("repeated")))
    same = F.col("conv").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("digest") == F.col("d2"))
    earlier = F.coalesce(F.col("repeated") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False))
    return said.join(again, same, "left").select("conv", "turn", "role", "digest", "n", "end", earlier.alias("earlier"))


_COUNTS = ["illegal", "blank", "duplicate", "truncated", "low", "high", "turns"]
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _blocks(messages: DataFrame) -> DataFrame:
    """Symbol strings of at most ``BLOCK`` rows: one row per conversation, in a larger one several, ordered by (part, block)."""
    schema = StructType([messages.schema["conv"], *[StructField(c, LongType()) for c in ("part", "block")],
                         *[StructField(c, StringType()) for c in ("symbols", "head", "tail")], *[StructField(c, LongType()) for c in _COUNTS]])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, kind = TaskContext.get().partitionId(), [], None
        block = chars = conv = None
        number = 0

        def close() -> None:
            rows.append((conv, part, number, "".join(chars), *block))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), [kind, pa.int64(), pa.int64()] + [pa.string()] * 3 + [pa.int64()] * 7)],
                                             schema.names)
            rows.clear()
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, turn, role, n, end, earlier in zip(*(x.to_pylist() for x in batch.columns)):
                for size in [min(BLOCK, n - i) for i in range(0, n, BLOCK)]:
                    if block is None or c != conv or sum(map(len, chars)) + size > BLOCK:
                        if block is not None:
                            close()
                            number += 1
                        # head and tail role, then _COUNTS
                        conv, chars, block = c, [], [role[:1], None, 0, 0, 0, 0, None, None, 0]
                    initial = role[:1]
                    if block[1] is not None:
                        block[2] += (block[1], initial) not in _LEGAL
                    block[2] += (size - 1) * ((initial, initial) not in _LEGAL)
                    block[1] = initial
                    kept = 0 if end == "" or earlier else 1
                    symbol = initial if initial in ("s", "u", "a") else "o"
                    cut = end not in (".", "!", "?")
                    chars.append((symbol.upper() if cut else symbol) * kept + "x" * (size - kept))
                    block[3 if end == "" else 4] += size - kept
                    block[5] += kept * cut
                    if turn is not None:
                        block[8] += turn != block[7]
                        block[6] = turn if block[6] is None else block[6]
                        block[7] = turn
                    earlier = True
                if len(rows) >= 4096:
                    yield flush()
        if block is not None:
            close()
            yield flush()

    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest")]
    return (messages.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "n", "end", "earlier")
            .mapInArrow(runs, schema))


def _total(blocks: list[tuple]) -> dict[str, int]:
    """Sums over a conversation's blocks, with what happens between two of them; none: zeros."""
    out = dict.fromkeys(_COUNTS, 0)
    out["low"] = out["high"] = tail = None
    for head, last, *counts in blocks:
        c = dict(zip(_COUNTS, counts))
        for k in ("illegal", "blank", "duplicate", "truncated", "turns"):
            out[k] += c[k]
        if tail is not None:
            out["illegal"] += (tail, head) not in _LEGAL
        if c["low"] is not None:
            out["turns"] -= c["low"] == out["high"]
            out["low"] = c["low"] if out["low"] is None else out["low"]
            out["high"] = c["high"]
        tail = last
    out["gaps"] = 0 if out["low"] is None else out["high"] - out["low"] + 1 - out["turns"]
    return out


class Editor:
    """Applies an audit to the rows of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _expected(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        """Rows that the audit puts in at this place."""
        while self.audit[self.at:self.at + 1] == "I":
            role = self._expected()
            self.at, self.state = self.at + 1, GO[self.state, role[0]]
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            role = self._expected() if edit == "R" else role
            self.state = GO[self.state, role[0]]
            yield role, text


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repair(rows: DataFrame, conversations: DataFrame | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Repaired conversations: (conv, position, role, text, and the columns of ``SUMMARY``).

    Each conversation is a run of adjacent rows of one partition: its rows in
    their new order (position 1, 2, ...; SUMMARY is null), then one row with
    a null position that holds the summary.  A conversation of
    ``conversations`` (its ids in a column named ``conv``) without rows has a
    summary of zeros and an empty audit.
    """
    typed = _typed(rows, conv, turn, role, text)
    blocks = materialize(_blocks(materialize(_messages(typed), "repair-marked")), "repair-blocks")
    grammar = rows.sparkSession.sparkContext.broadcast(learn(materialize(
        blocks.groupBy("symbols").agg(F.count("*").alias("n")), "repair-strings")).rules)
    ids = conversations.select(F.col(conv).alias("conv")) if conversations is not None else typed.select("conv")
    stream = (ids.distinct().withColumns({"part": F.lit(-1).cast("long"), "block": F.lit(0).cast("long")})
              .unionByName(blocks, allowMissingColumns=True).withColumn("kind", F.lit(0))
              .unionByName(typed.withColumn("kind", F.lit(1)), allowMissingColumns=True))
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "kind", "part", "block", "turn", "role", "digest")]
    stream = (stream.repartition("conv").sortWithinPartitions(*keys)
              .select("conv", "kind", "role", "text", "symbols", "head", "tail", *_COUNTS))
    out = StructType([StructField(conv, rows.schema[conv].dataType), StructField("position", LongType()), StructField("role", StringType()),
                      StructField("text", StringType()), *[StructField(c, LongType()) for c in SUMMARY[:-1]], StructField("audit", StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Grammar(grammar.value)
        answers: dict[str, tuple[int, str]] = {}
        made, chars, kind = [], 0, None

        def items() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield from zip(*(x.to_pylist() for x in batch.columns))

        def solved(parts: list[str]) -> tuple[int, str]:
            if len(parts) == 1 and parts[0] in answers:
                return answers[parts[0]]
            fold = Fold()
            for p in parts:
                fold.add(rules, p)
            if len(parts) == 1 and len(parts[0]) <= 64:
                if len(answers) > 100_000:
                    answers.clear()
                answers[parts[0]] = fold.best()
            return fold.best()

        def edited(run: Iterator[tuple]) -> Iterator[tuple]:
            """Rows of one conversation, then its summary."""
            strings, counts, editor, position = [], [], None, 0

            def begin() -> Editor:
                nonlocal cost, audit
                cost, audit = solved(strings)
                return Editor(audit)

            cost, audit = 0, ""
            for _, is_row, row_role, row_text, symbols, *rest in run:
                if not is_row:
                    if symbols is not None:
                        strings.append(symbols)
                        counts.append(rest)
                    continue
                editor = editor or begin()
                for r, t in editor.row(row_role, row_text):
                    position += 1
                    yield position, r, t, *[None] * 7
            for r, t in editor.inserted() if editor else ():
                position += 1
                yield position, r, t, *[None] * 7
            total = _total(counts) | {"cost": cost, "audit": audit}
            yield None, None, None, *[total[c] for c in SUMMARY]

        def flush() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], out.names)
            made.clear()
            return batch

        for c, run in groupby(items(), key=lambda r: r[0]):
            for row in edited(run):
                made.append((c, *row))
                chars += len(row[2] or "") + len(row[-1] or "")
                if len(made) >= 4096 or chars > OUT_CHARS:
                    yield flush()
                    chars = 0
        if made:
            yield flush()

    return stream.mapInArrow(task, out)


def summaries(repaired: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """(conv, SUMMARY, repaired_sha256) from what ``repair`` returns: the digest of the rows ``role:text`` joined by line breaks.

    A digest is taken row by row, so no conversation is held whole; it cannot
    be split, so one conversation is one task's.
    """
    out = StructType([repaired.schema[conv], *[repaired.schema[c] for c in SUMMARY], StructField("repaired_sha256", StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            ends, digests = [], []
            for k, (position, role, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                if position is None:
                    ends.append(k)
                    digests.append(digest.hexdigest())
                    digest = hashlib.sha256()
                else:
                    digest.update(f"{'' if position == 1 else chr(10)}{role}:{text}".encode())
            if ends:
                rows = batch.take(pa.array(ends))
                yield pa.RecordBatch.from_arrays([rows.column(0), *[rows.column(i) for i in range(4, 4 + len(SUMMARY))], pa.array(digests)], out.names)

    return repaired.mapInArrow(task, out)
