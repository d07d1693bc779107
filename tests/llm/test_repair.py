"""Conversation repair against a search over all edits, and against a plain reading of the rules."""

import hashlib
import heapq
import random
import zlib

import pytest

from ticketlake.llm import queries, repair

WHITE = "\t\n\x0b\x0c\r "


def brute_edits(rows):
    """Cheapest edits of (initial, fault) rows, the least in ASCII of them: a search in the order of cost and letters."""
    allowed = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, letters
        new = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
        heapq.heappush(heap, (cost + 5, letters + "I", at, allowed[state, new]))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 2, letters + "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (state, initial) in allowed:
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, allowed[state, initial]))
                heapq.heappush(heap, (cost + more + 1, letters + "R", at + 1, allowed[state, new]))


def brute_damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        which = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if which == 1:
            text = ""
        if which == 2:
            text = "".join(c for c in text if c not in ".!?")
        if which == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(which, 1)):
            yield conv, turn, role, text


def brute_repair(rows, damage=True):
    groups = {r[0]: [] for r in rows}
    for conv, *rest in brute_damage(rows) if damage else rows:
        groups[conv].append(tuple(rest))
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults, seen = [], set()
        for _, role, text in turns:
            end = text.rstrip(WHITE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            faults.append(fault)
            seen.add((role, text))
        cost, letters = brute_edits([(t[1][:1], f) for t, f in zip(turns, faults, strict=True)])
        state, rest, left = 0, iter(turns), []
        for letter in letters:
            row = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            role = row[1] if letter == "K" else {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            left.append((letter, role, row[2] if row else ""))
        numbers = [t[0] for t in turns if t[0] is not None]
        pairs = zip(turns, turns[1:], strict=False)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
            cost,
            letters,
            left,
        )
    return out


def digest(left):
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in left).encode()).hexdigest()


def assert_same(results, turns, expected):
    got = {r.conv_id: tuple(r)[1:] for r in results.collect()}
    assert got == {conv: (*x[:7], digest(x[7])) for conv, x in expected.items()}
    texts = {conv: [] for conv in expected}
    for r in sorted(turns.collect(), key=lambda r: r.at):
        assert r.at == len(texts[r.conv_id])
        texts[r.conv_id].append((r.edit, r.role, r.text))
    assert texts == {conv: x[7] for conv, x in expected.items()}


SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["system", "user", "assistant", "tool", "", "User", "s", "ua", "ärger"]
TEXTS = ["Fine.", "Really?  \n", "no end", " ", "", "\x0b\t", "Again!", "ends. (yes", "é。"]


@pytest.mark.parametrize("longest", [1, 3, 12, 60])
def test_edits_against_a_search(longest):
    r = random.Random(longest)
    for _ in range(400):
        kinds = r.sample([(i, f) for i in ("s", "u", "a", "x") for f in ("", "blank", "duplicate", "truncated")], r.randint(1, 6))
        rows = [k for k in r.choices(kinds, k=r.randint(0, longest)) for _ in range(r.choice((1, 1, 2, 7)))]
        gone = {"blank", "duplicate"}
        symbols = bytes(ord("-") if f in gone else ord(i.upper() if f else i) for i, f in rows)
        assert repair.repair_audit(symbols) == brute_edits(rows)


def test_long_runs():
    """Runs over the blocks in which they are unrolled, and conversations with no run at all."""
    n = 3 * repair._BLOCK + 5
    assert repair.repair_audit(b"u" * n)[0] == n // 2 + 2  # every second one reroled, the odd one deleted
    for symbols in (b"ua" * n, b"s" + b"ua" * n, b"-" * n, b"u" * 9000 + b"a" * 9000, b"A" * 5000 + b"u" * 4097):
        cost, audit = repair.repair_audit(symbols)
        assert len(audit) - audit.count("I") == len(symbols)
        state = 0
        spent, rest = 0, iter(symbols)
        for letter in audit:
            options = {"I": (5, repair.NEXT[state])} if letter == "I" else {x: (c, s) for x, c, s in repair._choices(next(rest), state)}
            more, state = options[letter]
            spent += more
        assert state in (0, 3) and spent == cost
    assert repair.repair_audit(b"ua" * n) == (0, "KK" * n)
    assert repair.repair_audit(b"-" * n) == (2 * n, "D" * n)


def test_rows_of_all_kinds(stored):
    r = random.Random(5)
    rows = [
        (r.choice([None, 1, 2, 3, -4, *range(10, 60)]), r.choice([None, 0, 1, 2, 3, 9]), r.choice([None, *ROLES]), r.choice([None, *TEXTS]))
        for _ in range(700)
    ]
    rows += [(100, t, "user" if t % 2 else "assistant", f"Long {t}.\n" * 2000) for t in range(8)]
    docs = stored(rows, SCHEMA)
    damaged, times = repair.damaged(docs)
    assert_same(repair.repair(damaged, times_col=times), repair.repaired_turns(damaged, times_col=times), brute_repair(rows))


def test_one_conversation_over_many_tasks(stored, spark):
    """A conversation cut over all tasks, with repeated texts far apart."""
    r = random.Random(6)
    rows = [(7, i // 3, r.choice(ROLES[:4]), r.choice([f"Text {i % 900}.", f"text {i}", "Yes.", ""])) for i in range(6000)]
    rows += [(8, None, "user", "Same."), (9, 1, "user", "One."), (9, 2, "assistant", "Two.")]
    docs = stored(rows, SCHEMA)
    assert_same(repair.repair(docs), repair.repaired_turns(docs), brute_repair(rows, damage=False))


def test_no_rows(stored):
    assert repair.repair(stored([], SCHEMA)).collect() == []
    assert repair.repaired_turns(stored([], SCHEMA)).collect() == []


def test_query_against_the_rules(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.QUERIES["op11_repair"](spark, sf_dir)
    assert df.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    got = {r.conv_id: tuple(r)[1:] for r in df.collect()}
    assert got == {conv: (*x[:7], digest(x[7])) for conv, x in brute_repair(rows).items()}
