"""Conversation repair against a search over all edits, spelt out in strings."""

import hashlib
import random
import re
import zlib

import pytest

from corpusmill.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, position int, edit string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """The figures of one conversation, by trying all edits row after row; states are told apart by what they end in."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", "")}

    def add(into, key, value):
        if key not in into or value < into[key]:
            into[key] = value

    def follow(end, initial):
        return {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[end].count(initial) == 1

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for end, (cost, letters, text) in list(out.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if follow(end, initial):
                        add(out, initial, (cost + 3, letters + "I", f"{text}\n{role}:"))
        return out

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for end, (cost, letters, done) in inserted(best).items():
            add(after, end, (cost + 4, letters + "D", done))
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                if role[:1] and follow(end, role[:1]):
                    add(after, role[:1], (cost + extra, letters + "K", f"{done}\n{role}:{text}"))
                for initial, to in (("u", "user"), ("a", "assistant")):
                    if follow(end, initial):
                        add(after, initial, (cost + 3 + extra, letters + "R", f"{done}\n{to}:{text}"))
        best = after
    cost, letters, text = min(v for k, v in inserted(best).items() if k in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, letters, hashlib.sha256(text[1:].encode()).hexdigest())


def conversations(n, seed):
    """Conversations of 0 to 12 rows with nulls, ties, repeats, blanks, odd roles and long texts."""
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "User", "ünder"])
            text = rng.choice([f"Text {rng.randint(0, 3)}.", "no end", "", " \n", None, "Ends? \t", "é!", " ", "a.b"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return rows


def by_conversation(rows, names):
    groups = {name: [] for name in names}
    for r in rows:
        groups[r[0]].append(r)
    return sorted([(name, *plain(group)) for name, group in groups.items()], key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("chunk", "group"), [(4096, 4096), (2, 2)])
def test_as_all_edits(spark, chunk, group):
    """Chunks of two rows and sums of two chunks go through several rounds, to the same end."""
    rows = conversations(150, 3)
    table = frame(spark, rows)
    found = sorted([tuple(r) for r in cr.audited(cr.damaged(table), table, chunk, group).select(*COLUMNS).collect()], key=repr)
    assert found == by_conversation(damaged(rows), {r[0] for r in rows})


def test_a_long_conversation_and_a_long_text(spark):
    """Thousands of rows of one conversation, in chunks of 100, and a text of a million characters."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"Text {t}.", f"cut {t}", "again.", ""])) for t in range(3000)]
    rows += [(2, 0, "user", "w " * 500_000 + "end"), (2, 1, "assistant", "x." + " " * 300_000)]
    table = frame(spark, rows)
    found = sorted([tuple(r) for r in cr.audited(table, table, 100, 4).select(*COLUMNS).collect()], key=repr)
    assert found == by_conversation(rows, {1, 2})


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More?"), (2, 0, "system", "Be."), (3, None, "assistant", "Yes.")]
    found = [(r.conv_id, r.position, r.turn, r.role, r.text, r.edit) for r in cr.repaired(frame(spark, rows)).orderBy("conv_id", "position").collect()]
    assert found == [(1, 0, 0, "user", "Hi.", "K"), (1, 1, 2, "assistant", "More?", "R"), (3, 0, None, "user", "", "I"), (3, 1, None, "assistant", "Yes.", "K")]


def test_no_rows(spark):
    table = frame(spark, [(1, 0, "user", "Hi.")])
    assert cr.audited(table.limit(0), table.limit(0)).collect() == [] and cr.repaired(table.limit(0)).collect() == []
    assert [tuple(r) for r in cr.audited(table.limit(0), table).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_codes_are_prefix_free():
    assert not [(a, b) for a in cr._CODES for b in cr._CODES if a != b and b.startswith(a)]
