import hashlib
import random
import zlib

from tests.llm.llm_helpers import rows_of

from compassframe.llm import conversation_repair as cr


def cheapest(rows):
    """Cost, edits and new roles by trying every state after every row with whole strings; rows of (initial, must_go, broken)."""
    def insert(states):
        for _ in range(4):
            for s, t, role in ((0, 2, "user"), (1, 2, "user"), (3, 2, "user"), (2, 3, "assistant")):
                if s in states:
                    cost, audit, roles = states[s]
                    way = (cost + 3, audit + "I", [*roles, role])
                    states[t] = min(states.get(t, way), way, key=lambda x: x[:2])
        return states

    states = insert({0: (0, "", [])})
    for initial, must_go, broken in rows:
        new = {}

        def offer(t, way, new=new):
            new[t] = min(new.get(t, way), way, key=lambda x: x[:2])

        for s, (cost, audit, roles) in states.items():
            offer(s, (cost + 4, audit + "D", [*roles, None]))
            if not must_go:
                e = 3 if broken else 0
                if (s, initial) in cr.NEXT:
                    offer(cr.NEXT[s, initial], (cost + e, audit + "K", [*roles, None]))
                offer(*((3, (cost + 3 + e, audit + "R", [*roles, "assistant"])) if s == 2 else (2, (cost + 3 + e, audit + "R", [*roles, "user"]))))
        states = insert(new)
    return min((states[s] for s in (0, 3) if s in states), key=lambda x: x[:2])


def run(rows):
    it, edits, most = cr.Repair(), [], 0
    for r in rows:
        edits += it.push(*r)
        most = max(most, depth(it))
    cost, rest = it.finish()
    edits += rest
    return cost, "".join(e for e, _ in edits), [role for _, role in edits], most


def depth(it):
    out = set()
    for _, _, node in it.live.values():
        while node is not it.root:
            out.add(id(node))
            node = node.above
    return len(out)


def test_edits_equal_all_ways():
    rng = random.Random(1)
    for n in range(1500):
        letters = rng.choice(["ua", "uas", "a", "u", "uuaa", "sx", "uasx", "s"])
        rows = [(rng.choice(letters), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n % 23)]
        if n % 7 == 0:
            rows = [(("ua"[k % 2]), rng.random() < 0.1, False) for k in range(n % 23)]
        assert run(rows)[:3] == cheapest(rows), rows


def test_survivors_meet_and_memory_stays_small():
    rng = random.Random(2)
    rows = [("ua"[k % 2], rng.random() < 0.2, rng.random() < 0.2) for k in range(3000)]
    cost, audit, roles, most = run(rows)
    assert (cost, audit, roles) == cheapest(rows)
    assert most < 200
    assert run([("u", True, False)] * 2000)[3] < 10


def test_long_undecided_ties():
    rows = [("a", False, False)] * 1501
    assert run(rows)[:3] == cheapest(rows)


def brute(table):
    """The contract's row for every conversation."""
    out, conversations = [], {}
    for conv, turn, role, text in table:
        conversations.setdefault(conv, []).append((turn, role, text))
    known = lambda x: " " if x is None else str(x)
    for conv, rows in conversations.items():
        kept = []
        for turn, role, text in rows:
            f, role, text = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20, known(role), known(text)
            if f == 0:
                continue
            text = "" if f == 1 else text.translate({46: None, 33: None, 63: None}) if f == 2 else text
            kept += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        cost, audit, roles = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)])
        rest, lines = iter(kept), []
        for edit, new in zip(audit, roles, strict=True):
            role, text = (new, "") if edit == "I" else next(rest)[1:]
            if edit != "D":
                lines.append(f"{role if edit == 'K' else new}:{text}")
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(spark, table, **extra):
    df = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS step", "'z' AS edit", "2 AS fault", "3 AS nth", "map('a', 1) AS new_role", "4 AS copy")
    return sorted((tuple(r) for r in rows_of(cr.digests(cr.repair(cr.damage(df.repartition(3)))))), key=str)


def test_equals_brute_force(spark):
    rng, table = random.Random(5), []
    for conv in range(120):
        for turn in range(rng.randrange(1, 14)):
            text = rng.choice(["One.", "Two!", "cut off", " \n", "", None, "Three? \t", "a. b", "é 数据。", "w " * 3000 + "."])
            table.append((conv, turn if rng.random() < 0.9 else rng.choice([None, turn - 1, turn + 5]), rng.choice(["user", "assistant", "system", None, "", "tool", "user"]), text))
    table += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (None, 2, "user", "z."), (500, None, None, None), (-7, 3, "user", "p.")]
    table += table[:40]
    assert digest(spark, table) == brute(table)


def test_all_rows_gone_and_empty_table(spark):
    gone = [(c, t, "user", "x.") for c in range(40) for t in range(30) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    nothing = hashlib.sha256(b"").hexdigest()
    assert digest(spark, gone) == sorted([(c, 0, 0, 0, 0, 0, 0, "", nothing) for c in {g[0] for g in gone}], key=str)
    assert digest(spark, []) == []


def test_edits_carry_texts_and_roles(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Again."), (1, 2, "assistant", "Again.")],
                               "conv_id bigint, turn bigint, role string, text string")
    got = [tuple(r) for r in rows_of(cr.repair(df))]
    assert got == [(1, 1, "R", None, 0, "assistant", "Hello.", "user"), (1, 2, "K", None, 1, "assistant", "Again.", "assistant"),
                   (1, 3, "D", "duplicate", 2, "assistant", "Again.", None)]
