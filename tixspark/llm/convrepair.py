"""Conversation structure repair by a survivor-coalescence Viterbi.

A conversation's rows, ordered by turn (nulls first), then role and text, have to become a sequence of roles
with the initials ``(s?(ua)+)?``. Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank
rows and for rows whose role and text came earlier), Insert of an empty-text row 3 (written before a kept row or
at the end: an insertion before a deletion is worth the same after it, and that is less in ASCII). A row
left in that does not end in ``.``, ``!`` or ``?`` adds 3. Of the cheapest sequences the ASCII-least one is taken.

1. Equal rows of a conversation are one row with a number of copies. First occurrences come from
   an aggregation by conversation, role and MD5 of the text.
2. Rows are sorted and streamed. Four states (nothing yet, s, u, a) have a survivor each: its cost and
   the last node of its path in a tree of backpointers. Nodes count who refers to them; what
   no survivor reaches is let go, and so is a survivor that can't win any more. Where the root has one successor left, all survivors share it,
   and it is sent on. Survivors of equal cost are told apart by their whole unresolved paths.
3. A conversation of more than ``SEGMENT`` distinct rows is cut into stretches by a range shuffle. For each
   stretch and start state a first walk gives costs and the order of the survivors' paths, which is all that
   choosing among stretches needs; then every stretch is walked again between its two states.
   So a conversation with a third of all rows is many tasks' work, and no task holds more than
   the unresolved edits of a stretch.

Defined results: null roles and texts are one space; rows with a null conversation id are one
conversation; a role whose initial is none of s, u, a can't be kept, an empty role may stay
anywhere and counts for nothing; null turns come first, rows of one turn are ordered by role and text;
an empty table gives an empty result; columns besides conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import HOT_SHARE, small_side, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Distinct rows of a conversation that are walked in one piece.
SEGMENT = 4096
#: Rows sent on at once by a task, and characters of their texts.
FLUSH, FLUSH_CHARS = 4096, 1 << 22
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What may follow, and who is inserted next.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = ("user", "user", "assistant", "user")
#: States reached from each by 0, 1, 2 insertions (a third leads nowhere new).
INSERTED = tuple(tuple(s for k, s in enumerate((m, NEXT[m][ROLE[m][0]], 3)) if k < 2 or m < 2) for m in range(4))
#: What it costs at most to go on from one state (row) as another one (column) does, by insertions or by deleting a first s.
INSTEAD = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))
#: Insertions at the end that make a legal sequence.
CLOSE = (0, 2, 1, 0)


class Node:
    """A step of a path: inserted roles, then the edit of a row (or its forced deletions)."""

    __slots__ = ("parent", "letters", "refs", "data")

    def __init__(self, parent: Node | None, letters: str, data: tuple) -> None:
        self.parent, self.letters, self.refs, self.data = parent, letters, 0, data
        if parent is not None:
            parent.refs += 1


class Walk:
    """The survivors of a stretch from a start state. ``send`` takes the data of steps that are settled, in order."""

    def __init__(self, start: int, send=None) -> None:
        self.root = Node(None, "", ())
        self.root.refs = 1
        self.send = send
        self.best: dict[int, tuple[int, Node]] = {start: (0, self.root)}

    def path(self, node: Node) -> str:
        """The letters of the unresolved steps up to ``node``."""
        steps = []
        while node is not self.root:
            steps.append(node.letters)
            node = node.parent
        return "".join(reversed(steps))

    def less(self, x: tuple, y: tuple) -> bool:
        """Whether (cost, node, letters) comes before another of the same state."""
        if x[0] != y[0]:
            return x[0] < y[0]
        return self.path(x[1]) + x[2] < self.path(y[1]) + y[2]

    def step(self, initial: str, cut: bool, data: tuple) -> None:
        """A row that may be kept, reroled or deleted."""
        extra, found = TRUNCATED if cut else 0, {}
        for m, (cost, node) in self.best.items():
            options = [(cost + DELETE, node, "D", m, 0, m)]
            for k, s in enumerate(INSERTED[m]):
                at, put = cost + k * INSERT + extra, "I" * k
                if not initial or initial in NEXT[s]:
                    options.append((at + KEEP, node, put + "K", m, k, NEXT[s][initial] if initial else s))
                options.append((at + REROLE, node, put + "R", m, k, NEXT[s][ROLE[s][0]]))
            for o in options:
                if o[5] not in found or self.less(o, found[o[5]]):
                    found[o[5]] = o
        self.keep({s: (o[0], o[1], o[2], (o[3], o[4], o[2][-1], o[0] - self.best[o[3]][0], 1, data)) for s, o in found.items()})

    def forced(self, copies: int, data: tuple) -> None:
        """``copies`` rows that have to be deleted."""
        cost = DELETE * copies
        self.keep({s: (c + cost, node, "D", (s, 0, "D", cost, copies, data)) for s, (c, node) in self.best.items()})

    def keep(self, found: dict[int, tuple]) -> None:
        """Make (cost, node, letters, data) of each state the survivors."""
        # A survivor that another one beats even after taking its place can be on no cheapest path.
        best = {x: (f[0], Node(*f[1:])) for x, f in found.items() if all(g[0] + INSTEAD[y][x] >= f[0] for y, g in found.items())}
        for _, node in best.values():
            node.refs += 1
        for _, node in self.best.values():
            self.release(node)
        self.best = best
        if self.root.refs == 1 and all(n is not self.root for _, n in best.values()):
            self.settle(next(iter(best.values()))[1])

    def release(self, node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            node = node.parent

    def settle(self, node: Node) -> None:
        """Send on the steps that all survivors share; the root moves to the last of them."""
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            if self.root.refs > 1:
                return
            if self.send:
                self.send(node.data)
            node.parent, self.root = None, node
            if any(n is node for _, n in self.best.values()):
                return

    def ranks(self) -> dict[int, int]:
        """The place of each survivor's path in ASCII order."""
        order = sorted(self.best, key=lambda s: self.path(self.best[s][1]))
        return {s: i for i, s in enumerate(order)}

    def finish(self, end: int | None) -> int:
        """Send the rest of the path to ``end``, or of the best whole sequence; returns its state."""
        if end is None:
            end = min(self.best, key=lambda s: (self.best[s][0] + CLOSE[s] * INSERT, self.path(self.best[s][1]) + "I" * CLOSE[s]))
        rest, node = [], self.best[end][1]
        while node is not self.root:
            rest.append(node.data)
            node = node.parent
        for data in reversed(rest):
            self.send(data)
        return end


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the contract's damage; nulls in role and text are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and faults: blank; first (no row before has the role and text); cut (truncated)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("ck")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = rows.select(key, "*", F.md5("text").alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    rows = staged(rows)
    when = F.struct(F.col("turn").isNotNull().alias("t"), "turn")
    seen = rows.groupBy("ck", "role", "digest").agg(F.min(when).alias("least"), F.count("*").alias("many")).where("many > 1")
    seen = staged(seen)
    total = rows.count()
    hot = F.broadcast(seen.where(F.col("many") * HOT_SHARE > total).withColumnRenamed("least", "hot").drop("many"))
    cold = seen.where(F.col("many") * HOT_SHARE <= total).withColumnRenamed("digest", "key").drop("many")
    out = rows.join(hot, ["ck", "role", "digest"], "left")
    # Rows of a text that fills much of the table have their answer; for the second join each gets a key of its own.
    own = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(""))))
    out = out.withColumn("key", own).join(cold, ["ck", "role", "key"], "left")
    first = F.coalesce("hot", "least")
    return out.select("ck", "conv_id", "turn", "role", "text", "copies", "blank", "cut", (first.isNull() | first.eqNullSafe(when)).alias("first"))


def _stretches(rows: DataFrame, segment: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of conversations that are walked in one piece, rows of the others with the number seg of their stretch)."""
    long_ = staged(rows.groupBy("ck").agg(F.count("*").alias("many")).where(F.col("many") > segment))
    many = long_.agg(F.sum("many")).first()[0]
    if not many:
        return rows.withColumn("seg", F.lit(0)), None
    keys = small_side(long_.select("ck"))
    short = rows.join(keys, "ck", "left_anti").withColumn("seg", F.lit(0))
    most = 10 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["ck", F.col("turn").asc_nulls_first(), "role", "text"]
    cut = rows.join(keys, "ck").repartitionByRange(min(-(-many // segment), most), *order)
    return short, staged(cut.withColumn("seg", F.spark_partition_id()))


_ROW = ("ck", "conv_id", "seg", "turn", "role", "text", "copies", "blank", "cut", "first", "start", "end", "last")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("ck", "seg").sortWithinPartitions("ck", "seg", F.col("turn").asc_nulls_first(), "role", "text")


def _feed(walk: Walk, row: tuple) -> None:
    _, _, _, turn, role, text, copies, blank, cut, first, *_ = row
    if first and not blank:
        walk.step(role[:1], cut, (turn, role, text))
        copies -= 1
    if copies:
        walk.forced(copies, (turn, role, None))


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def summaries(rows: DataFrame) -> DataFrame:
    """ck, seg, start, end, cost, rank: the survivors of each stretch from each start state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walks, out = None, [], []
        for row in _rows(batches, _ROW[:10]):
            if row[0::2][:2] != now:
                out += close(now, walks)
                now, walks = row[0::2][:2], [Walk(s) for s in range(4)]
            for w in walks:
                _feed(w, row)
        out += close(now, walks)
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("ck", pa.string()), ("seg", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))

    def close(now: tuple | None, walks: list[Walk]) -> list[dict]:
        return [
            {"ck": now[0], "seg": now[1], "start": s, "end": e, "cost": w.best[e][0], "rank": r}
            for s, w in enumerate(walks) for e, r in w.ranks().items()
        ]

    return _in_order(rows).mapInArrow(run, "ck string, seg int, start int, end int, cost long, rank int")


def choose(group: pd.DataFrame) -> pd.DataFrame:
    """ck, seg, start, end, last of the stretches of one conversation on its best path, from their summaries."""
    best, back = {0: (0, 0)}, []  # state: (cost, place of its path)
    for seg, s in group.sort_values("seg").groupby("seg"):
        found: dict[int, tuple] = {}
        for r in s.itertuples():
            if r.start in best:
                new = (best[r.start][0] + r.cost, best[r.start][1], r.rank, r.start)
                found[r.end] = min(found.get(r.end, new), new)
        places = {e: i for i, e in enumerate(sorted(found, key=lambda e: found[e][1:3]))}
        best = {e: (f[0], places[e]) for e, f in found.items()}
        back.append((seg, {e: f[3] for e, f in found.items()}))
    end, out = min(best, key=lambda e: (best[e][0] + CLOSE[e] * INSERT, best[e][1])), []
    for seg, starts in reversed(back):
        out.append((group["ck"].iloc[0], seg, starts[end], end, not out))
        end = starts[end]
    return pd.DataFrame(out, columns=["ck", "seg", "start", "end", "last"])


def walk_rows(rows: DataFrame) -> DataFrame:
    """The edits of each stretch in order: ck, conv_id, seg, at, edit, copies, cost, was (role before), turn, role, text (of rows that stay)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now, walk, at = [], 0, None, None, 0

        def send(step: tuple) -> None:
            nonlocal size
            state, inserts, edit, cost, copies, (turn, was, text) = step
            for _ in range(inserts):
                state = add("I", 1, INSERT, None, None, ROLE[state], "", state)
            if edit == "D":
                add(edit, copies, cost, was, turn, None, None, state)
            else:
                add(edit, 1, cost - inserts * INSERT, was, turn, was if edit == "K" else ROLE[state], text, state)
                size += len(text)

        def add(edit, copies, cost, was, turn, role, text, state) -> int:
            nonlocal at
            out.append((now[0], now[1], now[2], at, edit, copies, cost, was, turn, role, text))
            at += 1
            return NEXT[state][role[0]] if edit == "I" else state

        def close(end: int | None, last: bool) -> None:
            state = walk.finish(end)
            for _ in range(CLOSE[state] if last else 0):
                state = add("I", 1, INSERT, None, None, ROLE[state], "", state)

        ends = None
        for row in _rows(batches, _ROW):
            if row[:3] != now:
                if walk:
                    close(*ends)
                now, at, ends = row[:3], 0, row[11:]
                walk = Walk(row[10], send)
            _feed(walk, row)
            if len(out) >= FLUSH or size >= FLUSH_CHARS:
                yield batch(out)
                out, size = [], 0
        if walk:
            close(*ends)
        yield batch(out)

    names = ["ck", "conv_id", "seg", "at", "edit", "copies", "cost", "was", "turn", "role", "text"]
    types = [pa.string(), to_arrow_type(rows.schema["conv_id"].dataType), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), to_arrow_type(rows.schema["turn"].dataType), pa.string(), pa.string()]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = f"ck string, conv_id {kinds['conv_id']}, seg int, at long, edit string, copies long, cost long, was string, turn {kinds['turn']}, role string, text string"
    return _in_order(rows).mapInArrow(run, schema)


def repair(faulty: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame | None]:
    """The edits (see ``walk_rows``) of the conversations walked in one piece, whose rows come out in order, and of the others, if any."""
    short, long_ = _stretches(faulty, segment)
    free = short.selectExpr("*", "0 as start", "cast(null as int) as end", "true as last")
    if long_ is None:
        return walk_rows(free), None
    path = staged(summaries(long_).groupBy("ck").applyInPandas(choose, "ck string, seg int, start int, end int, last boolean"))
    return walk_rows(free), staged(walk_rows(long_.join(small_side(path), ["ck", "seg"])))


def repaired_rows(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations: conv_id, seg and at (their order), turn, role, text, edit. Rows are taken as they are."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).cast("long").alias("copies"))
    short, long_ = repair(staged(faults(rows)), segment)
    edits = short if long_ is None else short.unionByName(long_)
    return edits.where("edit != 'D'").select("conv_id", "seg", "at", "turn", "role", "text", "edit")


def _fold(edits: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit, repaired_sha256 of edits that stand in order, a conversation's all together."""
    kind = edits.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for ck, conv, edit, copies, cost, was, role, text in _rows(batches, ("ck", "conv_id", "edit", "copies", "cost", "was", "role", "text")):
            if ck != now:
                if now is not None:
                    out.append((name, illegal, total, "".join(audit), sha.hexdigest()))
                    if len(out) >= FLUSH:
                        yield batch(out)
                        out = []
                now, name, before, illegal, total, audit, sha, kept = ck, conv, None, 0, 0, [], hashlib.sha256(), 0
            total += cost
            audit.append(edit * copies)
            if was is not None:
                illegal += (before is not None and before + was[:1] not in ("su", "ua", "au")) + copies - 1
                before = was[:1]
            if edit != "D":
                sha.update((("\n" if kept else "") + role + ":" + text).encode())
                kept += 1
        if now is not None:
            out.append((name, illegal, total, "".join(audit), sha.hexdigest()))
        yield batch(out)

    names = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return edits.mapInArrow(run, f"conv_id {kind.simpleString()}, illegal long, cost long, audit string, repaired_sha256 string")


def repair_digest(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = staged(faults(damage(conversations)))
    short, long_ = repair(rows, segment)
    # A digest goes through a conversation's text in order: edits of stretches are brought together, rows not held.
    told = _fold(short)
    if long_ is not None:
        told = told.unionByName(_fold(long_.repartition("ck").sortWithinPartitions("ck", "seg", "at")))
    copies = F.col("copies")
    here = [F.sum(F.when(F.col("blank"), copies).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(copies - F.col("first").cast("long"))).alias("duplicate"),
            F.sum((~F.col("blank") & F.col("first") & F.col("cut")).cast("long")).alias("truncated")]
    turns = rows.groupBy("conv_id", "turn").agg(*here)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    counted = turns.groupBy("conv_id").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    whole = conversations.select("conv_id").distinct().unionByName(counted, True).unionByName(told, True)
    zero = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return whole.groupBy("conv_id").agg(*zero, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
