"""Conversation repair against all repairs tried one by one."""

import hashlib
import itertools
import random

import pytest

from rosterloom.llm.repair import damaged, repair, repaired_reports, reports

WHITE = " \t\n\v\f\r"


def plain_faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else
                   "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def well_formed(initials):
    rest = initials.removeprefix("s")
    return initials == "" or rest != "" and rest == "ua" * (len(rest) // 2)


def plain_repair(turns):
    """(cost, audit, repaired lines): the least over every way with up to 2 insertions before each turn and at the end."""
    faults, best = plain_faults(turns), None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    inserts = [i for n in range(3) for i in itertools.product("ua", repeat=n)]
    for ops in itertools.product(*choices):
        for ins in itertools.product(inserts, repeat=len(turns) + 1):
            cost = sum(2 * len(i) for i in ins)
            if best and cost > best[0]:
                continue
            audit, lines, initials = "", [], ""
            for n in range(len(turns) + 1):
                for who in ins[n]:
                    audit, initials = audit + "I", initials + who
                    lines.append({"u": "user:", "a": "assistant:"}[who])
                if n < len(turns):
                    (role, text), op = turns[n], ops[n]
                    audit += op[0]
                    if op == "D":
                        cost += 3
                        continue
                    cost += (2 if op[0] == "R" else 0) + (faults[n] == "truncated")
                    role = {"Ru": "user", "Ra": "assistant"}.get(op, role)
                    initials += role[:1] or "?"
                    lines.append(f"{role}:{text}")
            if well_formed(initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def plain_report(turns):
    faults, (cost, audit, lines) = plain_faults(turns), plain_repair(turns)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
    return (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


ROLES = ("user", "assistant", "system", "tool", "")
TEXTS = ("Fine.", "fine", " ", "More?\n", "more", "", "Ends!  ")


def conversations(seed, n, longest):
    rng = random.Random(seed)
    return [[(rng.choice(ROLES[:3] if rng.random() < 0.7 else ROLES), rng.choice(TEXTS) if rng.random() < 0.5
              else f"Text {k}{rng.choice('.!,')}") for k in range(rng.randint(0, longest))] for _ in range(n)]


def frame(spark, convs):
    return spark.createDataFrame([(c, t, *turn) for c, turns in enumerate(convs) for t, turn in enumerate(turns)],
                                 "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("most", [1 << 18, 1, 2])
def test_cheapest_repair(spark, most):
    convs = [*conversations(3, 150, 3), [("system", "Only.")], [("system", "a."), ("system", "b.")],
             [("assistant", "x."), ("user", "y.")]]
    got = {r.conv_id: tuple(r)[2:] for r in reports(repair(frame(spark, convs), most)).collect()}
    want = {c: plain_report(turns) for c, turns in enumerate(convs) if turns}
    assert got == want


def test_a_giant_conversation_with_spilt_steps_is_repaired_like_one_in_memory(spark):
    turns = conversations(5, 60, 40)
    giant = [t for part in turns for t in part]
    rows = frame(spark, [giant, *turns])
    assert sorted(map(str, reports(repair(rows, 7)).collect())) == sorted(map(str, reports(repair(rows)).collect()))
    edits = repair(rows, 7).filter("conv_id = 0").orderBy("position").collect()
    assert [e.position for e in edits] == list(range(len(edits)))
    assert well_formed("".join(e.role[0] for e in edits if e.edit != "D"))


def test_repaired_turns_need_no_repair(spark):
    edits = repair(frame(spark, conversations(8, 80, 9))).filter("edit <> 'D'").collect()
    again = {}
    for e in sorted(edits, key=lambda e: (e.conv_id, e.position)):
        again[e.conv_id] = again.get(e.conv_id, "") + e.role[0]
    assert again and all(map(well_formed, again.values()))


def test_nulls_ties_repeated_rows_long_texts_and_odd_columns(spark):
    long = "many words " * 200_000
    rows = spark.createDataFrame(
        [(None, None, "user", "a.", 1, {"k": 1}), (None, 2, "assistant", None, 2, {}), (1, 5, None, "x.", 3, None),
         (1, 5, "user", "x.", 4, None), (1, 5, "user", "x.", 4, None), (1, 9, "assistant", long, 5, None)],
        "conv_id bigint, turn bigint, role string, text string, row int, `a.b` map<string,int>")
    got = {r.conv_id: r for r in reports(repair(rows)).collect()}
    assert (got[None].gaps, got[None].blank, got[None].audit) == (0, 1, "KDI")
    assert (got[1].gaps, got[1].duplicate, got[1].truncated, got[1].illegal) == (3, 1, 1, 2)
    assert got[1].audit == "DKDK" and got[1].cost == 7
    assert got[1].repaired_sha256 == hashlib.sha256(f"user:x.\nassistant:{long}".encode()).hexdigest()


def test_empty_tables_and_conversations_of_which_nothing_is_left(spark):
    rows = frame(spark, [])
    assert repair(rows).count() == 0 and repaired_reports(rows).count() == 0
    dropped = [(c, 0) for c in range(400)]
    rows = spark.createDataFrame([(c, t, "user", "a") for c, t in dropped],
                                 "conv_id bigint, turn bigint, role string, text string")
    left = {r.conv_id for r in damaged(rows).collect()}
    got = {r.conv_id: r for r in repaired_reports(rows).collect()}
    assert len(got) == 400 and 0 < len(left) < 400
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.cost, r.audit, r.repaired_sha256) == (0, "", empty) for c, r in got.items() if c not in left)
