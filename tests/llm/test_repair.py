"""Repair against a plain search over edits."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache

from siftline.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def slow_damage(rows: list) -> list:
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def slow_repair(rows: list) -> tuple:
    """Of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i: int, before: str, inserted: int) -> tuple:
        """(cost, audit, repaired) from row i on."""
        found = []
        if i == len(rows) and before in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if to := moves.get((before, role[0])):
                    cost, audit, out = best(i, to, inserted + 1)
                    found.append((cost + 2, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, out = best(i + 1, before, 0)
            found.append((cost + 3, "D" + audit, out))
            if faults[i] in ("", "truncated"):
                for edit, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if to := moves.get((before, new[:1])):
                        cost, audit, out = best(i + 1, to, 0)
                        found.append((cost + price + (faults[i] == "truncated"), edit + audit, ((new, text), *out)))
        return min(found, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest, out)


def talks(seed: int, n: int) -> list:
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", "usher", None, "Assistant", " user"]
    texts = ["Hi.", "Yes!", "So?", "cut off", "end. \n", "", " \t", None, "a\xa0", "日本。", "\x0b.\x0c", "One."]
    rows = []
    for conv in [None, *range(n)]:
        for k in range(rng.choice([0, 1, 2, 3, 4, 8, 14])):
            turn = rng.choice([k, k, k, k, None, k + 3, 2])
            rows.append((conv, turn, rng.choice(roles[: 10 if rng.random() < 0.6 else None]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(50)}."))
    return rows + rows[:5]


def test_operator_equals_the_plain_search(spark):
    rows = talks(2, 300)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int")
    plan, turns = repair.repair(repair.damaged(df))
    got, made = {r.conv_id: r for r in plan.collect()}, {}
    for r in turns.orderBy("nth").collect():
        made.setdefault(r.conv_id, []).append(r)
    digests = {r.conv_id: r for r in repair.turn_digests(turns).collect()}
    by: dict = {}
    for r in slow_damage(rows):
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, mine in by.items():
        *want, digest, out = slow_repair(mine)
        r = got[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == want, (conv, mine)
        mine = made.get(conv, [])
        assert [(m.role, m.text) for m in mine] == list(out) and "".join(m.edit for m in mine) == want[-1].replace("D", "")
        assert (digests[conv].sha256 if conv in digests else hashlib.sha256(b"").hexdigest()) == digest


def test_walk_shares_suffixes():
    """Every word's result is what it is alone, and each suffix is made once."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("uUaAsod") for _ in range(rng.randint(0, 9))) for _ in range(3000)}, key=lambda w: w[::-1])
    made = []
    plain = repair.before
    try:
        repair.before = lambda symbol, after: made.append(1) or plain(symbol, after)
        got = list(repair.walk(iter(words)))
    finally:
        repair.before = plain
    assert len(made) == len({w[k:] for w in words for k in range(len(w))})
    assert got == [next(repair.walk(iter([w]))) for w in words]


def test_edges(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    plan, turns = repair.repair(repair.damaged(none))
    assert plan.count() == turns.count() == repair.turn_digests(turns).count() == 0
    rows = [(1, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(3000)] + [(2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b.")]
    plan, turns = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    long, far = plan.orderBy("conv_id").collect()
    assert (long.cost, long.audit, far.audit, far.gaps) == (0, "K" * 3000, "KK", 0)
    assert turns.count() == 3002
