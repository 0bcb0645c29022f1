import itertools
import random

import pytest

from cuebeam.llm import chat
from cuebeam.llm.chat import Costs


def least(roles, costs):
    """The least cost by trying everything: the roles of a legal chat and how each turn goes into it."""
    best = None
    for n in range(0, 2 * len(roles) + 2):
        for system in (False, True):
            legal = ([0] if system else []) + [1 + k % 2 for k in range(n)]
            if not any(r == 1 for r in legal):
                continue
            table = {(0, -1): 0}
            for j, m in enumerate(legal):
                new = {}
                for (i, last), c in table.items():
                    def put(key, cost):
                        if cost < new.get(key, 1 << 30):
                            new[key] = cost

                    put((i, j), c + costs.insert)
                    if i < len(roles):
                        own = 0 if roles[i] == m else costs.unknown if roles[i] == 3 else costs.relabel
                        total, k = c + own, i + 1
                        put((k, j), total)
                        while k < len(roles):
                            total += costs.merge_same if roles[k] in (m, 3) else costs.merge_other
                            k += 1
                            put((k, j), total)
                table = new
            done = [c for (i, _), c in table.items() if i == len(roles)]
            best = min([best, *done], key=lambda x: 1 << 30 if x is None else x) if done else best
    return best


@pytest.mark.parametrize("costs", [Costs(), Costs(3, 5, 1, 2, 2)])
def test_least_cost(costs):
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            m = chat.matrix(list(roles), costs)
            got = min(m[0][q] + chat.ends(costs)[q][0] for q in range(4))
            # at most one empty message goes before a turn; more never pays
            assert got == least(list(roles), costs), roles


@pytest.mark.parametrize("stretch", [4096, 3, 1])
def test_repair(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    rng = random.Random(3)
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "System", " human ", None, "tool", "user"]), rng.choice(["a", "b c", "", None, "x" * 50]), c))
    rows += [(100, None, "user", "n", 1), (100, 0, "assistant", "y", 1), (100, 0, "assistant", "y", 1), (None, 0, "user", "q", 1), (None, 1, "user", "r", 1), (101, 5, "assistant", "z", 0), (102, 0, "system", "s", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part long").repartition(3)
    got = sorted((r.asDict() for r in chat.repair(df).collect()), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["message"]))
    for conv, own in itertools.groupby(got, key=lambda r: r["conv_id"]):
        own = list(own)
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        names = [r["role"] for r in own]
        body = names[1:] if names[0] == "system" else names
        assert [r["message"] for r in own] == list(range(len(own)))
        assert body == ["user", "assistant"] * (len(body) // 2) + ["user"] * (len(body) % 2) and body
        assert sum(r["n_turns"] for r in own) == len(turns)
        assert sorted("".join(r["text"] for r in own).replace("\n", "")) == sorted("".join(t[3] or "" for t in turns))
        codes = {"user": 1, "assistant": 2, "system": 0, "human": 1}
        roles = [codes.get((t[2] or "").strip().lower(), 3) for t in turns]
        if len({t[1] for t in turns}) == len(turns) and len(roles) <= 7:
            m = chat.matrix(roles, Costs())
            assert min(m[0][q] + chat.ends(Costs())[q][0] for q in range(4)) == least(roles, Costs())
    by = {(r["conv_id"], r["message"]): r for r in got}
    assert by[100, 1]["text"] == "y\ny" and by[100, 1]["n_turns"] == 2
    assert by[102, 0]["role"] == "user" and (102, 1) not in by  # another role costs less than an empty message
    assert by[101, 0]["rendered"] == "<|user|>\nz\n<|end|>\n"
    assert chat.repair(df.limit(0)).count() == 0


def test_one_conversation_of_most_rows(spark, monkeypatch):
    """Rows without an id and a turn lie in many stretches, bounded in turns and bytes, and make one chat."""
    monkeypatch.setattr(chat, "STRETCH", 64)
    monkeypatch.setattr(chat, "STRETCH_BYTES", 500)
    rng = random.Random(5)
    rows = [(None, None if k % 3 else 7, rng.choice(["user", "assistant", "tool", None]), "x" * rng.randint(0, 40)) for k in range(3000)]
    rows += [(k, 0, "user", "y") for k in range(50)] + [(1, 1, "assistant", "z" * 2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    parts = chat.stretches(df).collect()
    assert all(len(p["turns"]) <= 64 and sum(len(t["text"]) for t in p["turns"][1:]) <= 500 for p in parts)
    assert sum(p["conv_id"] is None for p in parts) > 3000 // 64
    by_part = sorted((p for p in parts if p["conv_id"] is None), key=lambda p: p["part"])
    turns = [t for p in by_part for t in p["turns"]]
    order = [(t["turn"] is not None, t["code"]) for t in turns]
    assert order == sorted(order) and len(turns) == 3000
    got = sorted((r for r in chat.repair(df).collect() if r["conv_id"] is None), key=lambda r: r["message"])
    assert [r["message"] for r in got] == list(range(len(got)))
    assert sum(r["n_turns"] for r in got) == 3000
    assert sum(len(r["text"].replace("\n", "")) for r in got) == sum(len(r[3]) for r in rows[:3000])
    names = [r["role"] for r in got]
    body = names[1:] if names[0] == "system" else names
    assert body == ["user", "assistant"] * (len(body) // 2) + ["user"] * (len(body) % 2)
