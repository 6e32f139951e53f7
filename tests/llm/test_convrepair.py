import functools
import hashlib
import itertools
import random
import re
import zlib

from tixspark.llm import convrepair
from tixspark.llm.common import table

SCHEMA = "conv_id long, turn int, role string, text string"
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def every_sequence(rows):
    """The best (cost, letters) of all edit sequences with at most two insertions in a gap; rows are (initial, must go, cut)."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        cost, steps = 0, []
        for e, (initial, gone, cut) in zip(edits, rows):
            if gone and e != "D":
                break
            cost += 4 if e == "D" else 3 * (e == "R") + 3 * cut
            steps.append({"K": initial, "R": "*", "D": ""}[e])
        else:
            for gaps in itertools.product(range(3), repeat=len(rows) + 1):
                text = "".join("I" * g + e for g, e in zip(gaps, edits)) + "I" * gaps[-1]
                whole = (cost + 3 * sum(gaps), text)
                if best is not None and whole >= best:
                    continue
                roles = "".join("*" * g + s for g, s in zip(gaps, steps)) + "*" * gaps[-1]
                state = {0}
                for c in roles:
                    state = {t for s in state for k, t in MOVES[s].items() if k == c or c == "*" and k != "s"}
                if state & {0, 3}:
                    best = whole
    return best


def by_suffix(rows):
    """The same by whole strings from the end, for longer ones."""

    @functools.cache
    def best(i, s, inserts):
        out = [(0, "")] if i == len(rows) and s in (0, 3) else []
        if inserts < 2:
            for k, t in MOVES[s].items():
                if k != "s" and (b := best(i, t, inserts + 1)):
                    out.append((b[0] + 3, "I" + b[1]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            b = best(i + 1, s, 0)
            if b:
                out.append((b[0] + 4, "D" + b[1]))
            if not gone:
                if (initial == "" or initial in MOVES[s]) and (b := best(i + 1, MOVES[s].get(initial, s), 0)):
                    out.append((b[0] + 3 * cut, "K" + b[1]))
                for k, t in MOVES[s].items():
                    if k != "s" and (b := best(i + 1, t, 0)):
                        out.append((b[0] + 3 + 3 * cut, "R" + b[1]))
        return min(out, default=None)

    return best(0, 0, 0)


def plain(rows):
    """The contract, conversation by conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        mine = groups.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            mine += [row] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        kinds, seen = [], set()
        for _, role, text in mine:
            kinds.append("blank" if not SPACE.sub("", text) else "duplicate" if (role, text) in seen else "truncated" if SPACE.sub("", text)[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = by_suffix(tuple((r[:1], k in ("blank", "duplicate"), k == "truncated") for (_, r, _), k in zip(mine, kinds)))
        left, state, rest = [], 0, list(mine)
        for e in audit:
            role = "assistant" if state == 2 else "user"
            if e == "I":
                left.append((role, ""))
            else:
                _, was, text = rest.pop(0)
                if e == "D":
                    continue
                left.append((was if e == "K" else role, text))
            state = MOVES[state].get(left[-1][0][:1], state)
        assert not rest and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def got(frame, **more):
    out = convrepair.repair_digest(frame, **more)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def walked(rows):
    done = []
    walk = convrepair.Walk(0, done.append)
    for initial, gone, cut in rows:
        walk.forced(1, ()) if gone else walk.step(initial, cut, ())
    state = walk.finish(None)
    return sum(s[3] for s in done) + 3 * convrepair.CLOSE[state], "".join("I" * s[1] + s[2] * s[4] for s in done) + "I" * convrepair.CLOSE[state]


def test_walk_against_every_sequence():
    rng = random.Random(6)
    for n in (0, 1, 1, 2, 2, 2, *[3] * 25, *[4] * 12):
        rows = tuple((rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.25) for _ in range(n))
        want = every_sequence(rows)
        assert by_suffix(rows) == want
        assert walked(rows) == want


def test_walk_of_longer_ones():
    rng = random.Random(8)
    for _ in range(150):
        letters = rng.choice(["suat", "ua", "uuua", "tx", "aau", "ua "])
        rows = tuple((rng.choice(letters), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(5, 60)))
        assert walked(rows) == by_suffix(rows)


def test_settled_steps_leave_the_tree():
    """What all survivors share is sent on at once: a long clean conversation holds a handful of steps."""
    sent = []
    walk = convrepair.Walk(0, sent.append)
    most = 0
    for i in range(20_000):
        walk.step("ua"[i % 2], False, (i,))
        most = max(most, *(len(walk.path(n)) for _, n in walk.best.values()))
    assert most < 12 and len(sent) > 19_980 and [s[5][0] for s in sent] == list(range(len(sent)))


def test_conversations(spark):
    t = table(spark, "/root/testdata/sf0.001", "conversations")
    want = plain([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()])
    assert got(t) == want and len({r[7] for r in want}) > 10


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "well", " ", "", "ok.\n", "end .  ", None, "é.", "more words here."]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for _ in range(120)]
    rows += [(9, 5, "user", "same text.")] * 40 + [(9, None, "assistant", "x" * 50_000 + ".")] * 2 + [(10, 1, "user", "gone")]
    rows += [(11, i, "uaus"[i % 4] + "x", f"text {i // 3}.") for i in range(300)]
    return rows


def test_odd_rows_and_stretches(spark):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as ck", "'x' as seg", "'x' as copies", "'x' as cost", "'x' as first", "'x' as key", "'x' as last")
    want = plain(rows)
    assert got(frame) == want
    assert got(frame.repartition(3), segment=7) == want  # long conversations in stretches
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes."), (2, 0, "assistant", " ")]
    out = convrepair.repaired_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "seg", "at").collect()
    assert [(r.conv_id, r.role, r.text, r.edit) for r in out] == [
        (1, "user", "Hi.", "K"), (1, "assistant", "", "I"), (1, "user", "Are you there?", "K"), (1, "assistant", "Yes.", "K")
    ]
