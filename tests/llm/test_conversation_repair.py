"""Conversation repair against a search over all edit sequences, and in pieces."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from uttermark.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?\Z")
GOOD = "Yes."


def faults(rows):
    """Kind of each row of an ordered conversation."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(cr.BLANKS)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return kinds


def every_result(rows, most=2):
    """(cost, audit, lines) of all edit sequences with at most ``most`` inserts in a place."""
    gap = [g for k in range(most + 1) for g in itertools.product(("user", "assistant"), repeat=k)]
    options = []
    for (_, role, text), kind in zip(rows, faults(rows)):
        own = [(4, "D", None)]
        if kind not in ("blank", "duplicate"):
            more = 3 if kind == "truncated" else 0
            own += [(more, "K", f"{role}:{text}"), (more + 3, "R", f"user:{text}"), (more + 3, "R", f"assistant:{text}")]
        options.append(own)
    places = [x for own in options for x in ([((3 * len(g), "I" * len(g), [f"{r}:" for r in g])) for g in gap], [(c, e, [] if t is None else [t]) for c, e, t in own])]
    for pick in itertools.product(*places, [((3 * len(g), "I" * len(g), [f"{r}:" for r in g])) for g in gap]):
        lines = [line for _, _, some in pick for line in some]
        if LEGAL.match("".join(line.split(":")[0][:1] or "?" for line in lines)):
            yield sum(c for c, _, _ in pick), "".join(e for _, e, _ in pick), lines


def best(rows):
    """The same by recursion, for longer conversations: (cost, audit, lines), least first."""
    kinds = faults(rows)
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def rest(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        to, role = ("a", "assistant") if state == "u" else ("u", "user")
        if inserts < 3:
            c, e, lines = rest(i, to, inserts + 1)
            found.append((c + 3, "I" + e, (f"{role}:", *lines)))
        if i < len(rows):
            _, own, text = rows[i]
            c, e, lines = rest(i + 1, state, 0)
            found.append((c + 4, "D" + e, lines))
            if kinds[i] in ("fine", "truncated"):
                more = 3 if kinds[i] == "truncated" else 0
                if (state, own[:1]) in follow:
                    c, e, lines = rest(i + 1, follow[state, own[:1]], 0)
                    found.append((c + more, "K" + e, (f"{own}:{text}", *lines)))
                c, e, lines = rest(i + 1, to, 0)
                found.append((c + more + 3, "R" + e, (f"{role}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return rest(0, "", 0)


def expected(rows):
    """Everything about one conversation of (turn, role, text), in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    kinds = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, lines = best(tuple(rows))
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def conversation(rng, n, turns=None):
    texts = [GOOD, "No!", "cut off", "", " \t\n", "ça va ?", "e"] + [f"{i}." for i in range(6)]
    roles = ["user", "assistant", "system", "tool", "", "assistant", "user"]
    return [(rng.choice([None, *range(turns or n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_recursion_equals_the_search_over_all_edits():
    rng = random.Random(3)
    for n in (0, 1, 2, 2):
        for _ in range(6 if n < 2 else 8):
            rows = [(i, r, t) for i, (_, r, t) in enumerate(conversation(rng, n))]
            cost, audit, lines = min(every_result(rows))
            assert (cost, audit) == best(tuple(rows))[:2]
            assert any(lines == list(best(tuple(rows))[2]) for c, a, lines in every_result(rows) if (c, a) == (cost, audit))


def check(spark, got, data):
    groups = {}
    for conv, *row in data:
        groups.setdefault(conv, []).append(tuple(row))
    assert len(got) == len(groups)
    for r in got:
        want = expected([(t, " " if role is None else role, " " if x is None else x) for t, role, x in groups[r.conv_id]])
        assert {k: r[k] for k in want} == want, r.conv_id


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_repair(spark, rows, coalesced):
    """Many short conversations, one of a third of all rows, a null id, null cells, repeated rows, an unread column."""
    rng = random.Random(7)
    data = [(c, *r) for c in range(60) for r in conversation(rng, rng.randint(1, 9))]
    data += [(1000, *r) for r in conversation(rng, 150, 60)] + [(1000, 5, "user", "again.")] * 40
    data += [(None, *r) for r in conversation(rng, 8)] + [(7, 3, None, None), (7, 3, None, "x"), (8, None, "user", "a" * 200_000)]
    df = rows([(*d, 1) for d in data], "conv_id long, turn long, role string, text string, DIGEST int")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        check(spark, cr.repair(df).collect(), data)
        ordered = cr._ordered(cr._digested(cr._plain(df)))
        assert len(cr._borders(ordered)) >= (0 if coalesced == "true" else 4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_walk_from_checkpoints_equals_plain_costs():
    rng = random.Random(1)
    programme = cr.Programme()
    for n in (1, 2, 3, 10, 400):
        roles, kinds = bytes(rng.randrange(4) for _ in range(n)), bytes(rng.randrange(4) for _ in range(n))
        costs = [cr.AT_END]
        for role, kind in zip(reversed(roles), reversed(kinds)):
            before, least = programme.before(costs[-1], role, kind)
            costs.append(tuple(c + least for c in before))
        paid, state = 0, cr.NOTHING
        for i, letters, at in programme.walk(roles, kinds, cr.AT_END, cr.NOTHING):
            assert at == state
            for letter in letters:
                paid += {"I": 3, "D": 4, "K": 0, "R": 3}[letter]
                state = cr._after(roles[i], letter, state)
            paid += 3 * (kinds[i] == cr.TRUNCATED and letters[-1] != "D")
        assert paid + 3 * len(cr.closing(state)) == costs[-1][cr.NOTHING]


def test_repaired_turns(rows):
    data = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", ""), (3, 0, "tool", "?")]
    got = cr.repaired_turns(rows(data, "conv_id long, turn long, role string, text string")).collect()
    shown = [(r.conv_id, r.role, r.text) for r in sorted(got, key=lambda r: (r.conv_id, r.at))]
    assert shown == [(1, "user", "Hi."), (1, "assistant", ""), (1, "user", "There?"), (1, "assistant", "Yes.")]


def test_damage(rows):
    data = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in (("assistant", "One. Two! Three?"), (None, None))]
    got = sorted(map(repr, cr.damage(rows(data, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, r, x in data:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        want += [f"Row(conv_id={c}, turn={t}, role={('user' if hit == 4 else r)!r}, text={x!r})"] * (0 if hit == 0 else 2 if hit == 3 else 1)
    assert got == sorted(want)


def test_empty_table_and_conversations_without_rows(rows):
    schema = "conv_id long, turn long, role string, text string"
    assert cr.repair(rows([], schema)).count() == 0 and cr.repaired_turns(rows([], schema)).count() == 0
    lost = cr.repair(rows([], schema), rows([(4,), (None,)], "conv_id long")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in lost} == {(i, 0, 0, 0, 0, 0, 0, "", empty) for i in (4, None)}
