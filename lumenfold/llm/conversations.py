"""Repair of conversations: the cheapest edits that make roles alternate, by weighted finite-state composition.

Three machines are composed lazily, a row at a time: the acceptor of the rows as they are, an edit transducer (keep,
rerole, delete, insert), and an acceptor of the roles' grammar ``(s?(ua)+)?``.  States of the composition are pairs of
a row and one of the grammar's four states; weights are pairs (cost, label string), compared in this order and joined
by addition and concatenation.  Insertions read no row, but they cost and the grammar has four states, so a cheapest
path holds at most three in a row and the composition is relaxed in topological order: row by row, insertions last.

Two label strings of one cost that reach one state are never a prefix of each other, as the longer would have more
insertions and so cost more; therefore the smaller one stays the smaller whatever follows, and each state keeps one.

Rows are dealt by conversation and sorted by turn, and stream past four states.  Each state carries its labels and
the running digest of its repaired text, so texts are not kept: a task holds a digest of 16 bytes for each row of the
conversation at hand, to find repeated rows, and its labels.  In conversations of more than ``LONG`` rows, repeated
rows are found by a window over (conversation, role, text) beforehand, so that memory does not follow their length.
A digest is a chain over the whole conversation, so one task reads the rows of one conversation.

Defined cases: null roles and texts are one space; null conv_ids are one conversation; null turns come first; rows of
one turn are in order of role and text; a role counts by its first letter, and an empty one or another letter cannot
be kept; a conversation whose rows are all gone has no edits; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import parts_for, prepare, small, table

#: Grammar: state -> first letter of a role -> next state; states 0 and 3 accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = ("user", "assistant")
COST = {"keep": 0, "rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a conversation whose texts are remembered by a task.
LONG = 1_000_000


class Lattice:
    """The best paths to each state of the grammar after the rows so far: state -> (cost, labels, digest, begun)."""

    def __init__(self):
        self.labels: list[str] = []
        self.best = self.settled({0: (0, "", hashlib.sha256(), False, ())})

    @staticmethod
    def settled(found: dict) -> dict:
        """Insertions after ``found`` (state -> (cost, labels, digest, begun, texts to add)), and digests of what stays."""
        again = True
        while again:
            again = False
            for state, (cost, labels, sha, begun, more) in list(found.items()):
                for role in ROLES:
                    to = GRAMMAR[state].get(role[0])
                    if to is not None and ((cost + COST["insert"], labels + "I") < found[to][:2] if to in found else True):
                        found[to] = (cost + COST["insert"], labels + "I", sha, True, (*more, b"\n" * begun + role.encode() + b":"))
                        again = True
        out = {}
        for state, (cost, labels, sha, begun, more) in found.items():
            if more:
                sha = sha.copy()
                for text in more:
                    sha.update(text)
            out[state] = (cost, labels, sha, begun)
        return out

    def read(self, role: str, text: bytes, must_go: bool, truncated: bool) -> None:
        """Compose with one row."""
        found: dict = {}
        extra = COST["truncated"] * truncated
        for state, (cost, labels, sha, begun) in self.best.items():
            arcs = [(state, cost + COST["delete"], "D", None)]
            if not must_go:
                step = GRAMMAR[state]
                if role[:1] in step:
                    arcs.append((step[role[:1]], cost + COST["keep"] + extra, "K", role))
                arcs += [(step[r[0]], cost + COST["rerole"] + extra, "R", r) for r in ROLES if r[0] in step]
            for to, price, label, kept in arcs:
                if to not in found or (price, labels + label) < found[to][:2]:
                    more = () if kept is None else (b"\n" * begun + kept.encode() + b":" + text,)
                    found[to] = (price, labels + label, sha, begun or kept is not None, more)
        # from the best state any other's continuation is to be had for one insertion and one deletion
        best = self.settled(found)
        limit = min(w[0] for w in best.values()) + COST["insert"] + COST["delete"]
        self.best = {q: w for q, w in best.items() if w[0] <= limit}
        if len(next(iter(self.best.values()))[1]) > 4096:  # what all paths share is settled
            shared = commonprefix([w[1] for w in self.best.values()])
            self.labels.append(shared)
            self.best = {q: (c, s[len(shared) :], h, b) for q, (c, s, h, b) in self.best.items()}

    def result(self) -> tuple[int, str, str]:
        cost, labels, sha, _ = min((self.best[q] for q in FINAL if q in self.best), key=lambda w: w[:2])
        return cost, "".join(self.labels) + labels, sha.hexdigest()


class Report:
    """What is said about the conversation that streams past."""

    def __init__(self):
        self.lattice, self.seen, self.turns, self.least, self.last, self.before = Lattice(), set(), 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def read(self, turn: int | None, role: str, text: str, seen: bool | None) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before, data, words = role[:1], text.encode(), text.rstrip(SPACES)
        blank, cut = not words, bool(words) and words[-1] not in ".!?"
        if seen is None:
            key = hashlib.blake2b(b"%d:%b%b" % (len(role), role.encode(), data), digest_size=16).digest()
            seen = key in self.seen
            self.seen.add(key)
        repeated = seen and not blank
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + (cut and not repeated)
        self.lattice.read(role, data, blank or repeated, cut)

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        cost, labels, sha = self.lattice.result()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, labels, sha


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _by_conversation(rows: DataFrame, parts: int, *first: str) -> DataFrame:
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text")


def _known_repeats(rows: DataFrame, long: int) -> DataFrame:
    """``rows`` with ``seen``: whether role and text came earlier, for conversations of more than ``long`` rows; else null."""
    many = rows.groupBy(F.col("conv_id").alias("many")).count().where(F.col("count") > long).select("many")
    unknown = F.lit(None).cast("boolean")
    if many.isEmpty():
        return rows.withColumn("seen", unknown)
    marked = rows.join(small(many.withColumn("is_long", F.lit(True))), F.col("conv_id").eqNullSafe(F.col("many")), "left")
    rank = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first()))
    longer = marked.where("is_long").withColumn("seen", rank > 1)
    return marked.where("is_long is null").withColumn("seen", unknown).unionByName(longer).drop("many", "is_long")


def plain(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone): nulls as one space; a row that is ``gone`` only names its conversation."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))


def reports(rows: DataFrame, long: int = LONG) -> DataFrame:
    """One row for each conversation of ``plain`` rows: its faults and its cheapest edits (columns of ``REPORT``)."""
    prepare(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        current, report, ready = None, None, []
        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field("conv_id"), *((n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (f.split()[0] for f in REPORT.split(", ")))])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "seen")]
            for conv, turn, role, text, gone, seen in zip(*columns, strict=True):
                if report is None or conv != current:
                    if report is not None:
                        ready.append((current, *report.row()))
                    current, report = conv, Report()
                if not gone:
                    report.read(turn, role, text, seen)
            if len(ready) > 1000:
                yield _batch(ready, schema)
                ready = []
        if report is not None:
            yield _batch([*ready, (current, *report.row())], schema)

    return _by_conversation(_known_repeats(rows, long), parts_for(rows, 32 << 20)).mapInArrow(run, f"conv_id {kind.simpleString()}, {REPORT}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, at, edit, role, text) of ``plain`` rows, by their ``reports``."""
    prepare(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    edits = found.select("conv_id", none("long").alias("turn"), none("string").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("what"))
    both = rows.where(~F.col("gone")).select("conv_id", "turn", "role", "text", F.lit(1).alias("what")).unionByName(edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, state, at, conv = "", 0, 0, None
        for batch in batches:
            out, names = [], ("conv_id", "turn", "role", "text", "what")

            def insert():
                nonlocal edits, state, at
                n = len(edits) - len(edits.lstrip("I"))
                for _ in range(n):
                    role = ROLES[state == 2]
                    out.append((conv, at, "I", role, ""))
                    state, at = GRAMMAR[state][role[0]], at + 1
                edits = edits[n:]

            for conv, _, role, text, what in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if what == 0:
                    edits, state, at = text, 0, 0
                else:
                    edit, edits = edits[0], edits[1:]
                    if edit != "D":
                        role = ROLES[state == 2] if edit == "R" else role
                        out.append((conv, at, edit, role, text))
                        state, at = GRAMMAR[state][role[0]], at + 1
                insert()
            if out:
                schema = pa.schema([batch.schema.field("conv_id"), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
                yield _batch(out, schema)

    return _by_conversation(both, parts_for(rows, 32 << 20), "what").mapInArrow(run, f"conv_id {kind.simpleString()}, at long, edit string, role string, text string")


# --------------------------------------------------------------------------- query


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the faults that the query puts in, as ``plain`` rows."""
    rows = plain(rows)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    gone = kind == 0
    return rows.select("conv_id", "turn", F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"), twice.alias("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest edits of every conversation of ``conversations`` after damage."""
    return reports(damaged(table(spark, sf_dir, "conversations")))
