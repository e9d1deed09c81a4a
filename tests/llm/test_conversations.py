"""Conversation repair against a search over all edits, bounded memory, and odd rows."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest

from tidemark.llm import conversations

SPACES = " \t\n\v\f\r"
ROWS = "conv_id long, turn long, role string, text string, key string, conv int, digest string, repeated int, audit string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = text.strip(SPACES)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, audit, repaired rows): the least over all edits, from the end of the rows."""
    fault = faults(rows)
    role = {"u": "user", "a": "assistant"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def least(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            cost, edits = least(i, after[state], inserted + 1)
            ways.append((cost + 2, "I" + edits))
        if i < len(rows):
            cost, edits = least(i + 1, state, 0)
            ways.append((cost + 3, "D" + edits))
            if fault[i] not in ("blank", "duplicate"):
                more = fault[i] == "truncated"
                for to in {after[state], "s" if not state else after[state]}:
                    if rows[i][0][:1] == to:
                        cost, edits = least(i + 1, to, 0)
                        ways.append((cost + more, "K" + edits))
                cost, edits = least(i + 1, after[state], 0)
                ways.append((cost + 2 + more, "R" + edits))
        return min(ways, default=(10**9, ""))

    cost, audit = least(0, "", 0)
    left, out, state = iter(rows), [], ""
    for edit in audit:
        row = next(left) if edit != "I" else None
        if edit == "D":
            continue
        state = row[0][:1] if edit == "K" else after[state]
        out.append(row if edit == "K" else (role[state], row[1] if edit == "R" else ""))
    return cost, audit, out


def searched(rows):
    edits, out = [], []
    search = conversations.Repair(lambda edit, row: (edits.append(edit), out.append(row) if row else None))
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        search.step(role, text, fault)
    return (search.finished(), "".join(edits), out), search.most_held


def some_rows(rng, most):
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "No", "", " \t", f"t{rng.randrange(5)}!", f"x{rng.randrange(10**6)}.", f"x{rng.randrange(10**6)}."])) for _ in range(rng.randrange(most))]


def test_search_equals_all_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = some_rows(rng, 12)
        assert searched(rows)[0] == best(rows)
    for roles in itertools.product("sua", repeat=6):
        rows = [({"s": "system", "u": "user", "a": "assistant"}[r], f"t{k}.") for k, r in enumerate(roles)]
        assert searched(rows)[0] == best(rows)


def test_memory_is_bounded_by_what_is_unresolved():
    rng = random.Random(2)
    for odd in (0.0, 0.1, 0.5):
        rows = [(("user", "assistant")[k % 2] if rng.random() >= odd else "user", f"t{k}" + "." * (rng.random() > odd)) for k in range(20_000)]
        found, held = searched(rows)
        assert held < 200, odd
        assert len(found[1]) >= len(rows)
    assert searched([("user", "")] * 20_000)[1] < 20


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for conv in [*range(60), None]:
        n = rng.randrange(1, 12)
        for turn in range(n):
            role, text = rng.choice([("user", "Why?"), ("assistant", "So. "), ("user", "é"), ("system", "Be good."), (None, "x."), ("user", None), ("assistant", f"w{rng.randrange(99)}!")])
            if rng.random() < 0.1:
                continue
            out.append((conv, None if rng.random() < 0.1 else turn, ("user", "assistant")[turn % 2] if rng.random() < 0.7 else role, text, "k", 1, None, 2, "a"))
    out += [(7, 3, "user", "Again.", None, None, None, None, None)] * 3 + [(8, 0, "user", "long " * 100_000 + ".", None, None, None, None, None)]
    return out


def want(rows, hurt):
    of = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        own = of.setdefault(conv, [])
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in of.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        pairs = [r[1:] for r in own]
        found = faults(pairs)
        cost, audit, repaired = best(pairs)
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(pairs))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(map(str, out))


def test_operator_and_query_on_odd_rows(spark, rows, tmp_path):
    table = spark.createDataFrame(rows, ROWS).repartition(3)
    got = conversations.repaired(table).drop("most_held").collect()
    assert sorted(str(tuple(r)) for r in got) == want(rows, False)
    given = {}
    for r in conversations.edited(table).collect():
        given.setdefault(r.conv_id, []).append((r.place, r.edit, r.role, r.text))
    for r in conversations.repaired(table).collect():
        own = sorted(given[r.conv_id])
        assert "".join(x[1] for x in own) == r.audit and hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in own if x[1] != "D").encode()).hexdigest() == r.repaired_sha256
    table.write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert sorted(str(tuple(r)) for r in conversations.op13_repair(spark, f"file://{tmp_path}").collect()) == want(rows, True)
    assert conversations.repaired(table.limit(0)).count() == 0


def test_query_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in conversations.op13_repair(spark, folder).collect()) == want(given, True)
