"""Conversation repair against a search over all edits, and its tensor steps over pieces of any size."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tributary.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, key(r[2], r[3])))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra over (cost, edits), so that of equally cheap edits the least string comes first; roles are tried one by one against the pattern."""
    ok = re.compile("(s?(ua)+)?").fullmatch
    could = re.compile("|".join(["", "s", "s?(ua)*u", "s?(ua)+"])).fullmatch
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if i == len(rows) and ok(roles):
            return cost, audit, kept
        state = (i, roles[-1:])
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            if could(roles + role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + role[0], (*kept, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, kept))
            if found[i] in ("blank", "duplicate"):
                continue
            more = 3 * (found[i] == "truncated")
            _, _, role, text = rows[i]
            if could(roles + role[:1]) and role[:1]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*kept, (role, text))))
            for new in ("user", "assistant"):
                if could(roles + new[0]):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + new[0], (*kept, (new, text))))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        now = in_order(damage([r for r in rows if r[0] == conv]))
        found = faults(now)
        turns = [r[1] for r in now if r[1] is not None]
        roles = [r[2][:1] for r in now]
        cost, audit, kept = cheapest(now, found)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def invented(seed, convs=120, most=12):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "under", "User"]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t\n", None, "Ends. \n", "é…", "long " * 30, "dot . ", "\x1c"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            regular = rng.random() < 0.6
            role = ("user", "assistant")[t % 2] if regular else rng.choice(roles)
            rows.append((c if c else None, rng.choice([t, t, t, t * 2, None]), role, rng.choice(texts) if rng.random() < 0.4 else f"Turn {t} of {rng.randint(0, 3)}."))
    rows += rows[3:9] + [(-5, 10**15, "user", "x"), (-6, None, "assistant", None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    rows = invented(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = conversations.repair_report(conversations.damaged(df.withColumnRenamed("turn", "c").withColumnRenamed("text", "key"), turn="c", text="key")).collect()
    want = expected(rows)
    assert len(out) == len(want)
    for r in out:
        assert tuple(r)[1:] == want[r["conv"]], r


def test_pieces_of_few_rows():
    """Whole conversations from pieces of one to three rows: matrices, costs onward and traces, without Spark."""
    import numpy as np

    rng = random.Random(9)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 1, 2, 13, 14, 9, 5]) for _ in range(rng.randint(1, 14)))
        whole, state = trace([codes], [conversations.END], [True])[0]
        parts, i = [], 0
        while i < len(codes):
            n = rng.randint(1, 3)
            parts.append(codes[i : i + n])
            i += n
        onward, v = [], conversations.END
        for part in reversed(parts):
            onward.append(v)
            grid = np.frombuffer(part, np.uint8)[:, None]
            *_, m = conversations._backward(grid, np.where(np.eye(4, dtype=bool), 0, conversations.FAR)[None])
            v = (m[0] + v).min(axis=1)
        audit, s = b"", 0
        for k, (part, after) in enumerate(zip(parts, onward[::-1], strict=True)):
            letters, ends = zip(*[trace([part], [after], [k == len(parts) - 1], start)[0] for start in range(4)], strict=True)
            audit, s = audit + letters[s], ends[s]
        assert audit == whole


def trace(codes, after, last, start=0):
    import numpy as np

    out = [None] * len(codes)
    for who, grid in conversations._buckets(codes):
        costs = list(conversations._backward(grid, np.array([after[k] for k in who])))[::-1]
        found, to = conversations._edits(grid, costs, np.full(len(who), start), np.array([last[k] for k in who]))
        for k, x, e in zip(who, found, to.tolist(), strict=True):
            out[k] = (x, e)
    return out


def test_long_conversation_and_repaired_turns(spark):
    n = 30_000
    df = spark.range(n).selectExpr("1L AS conv", "id AS turn", "CASE WHEN id % 7 = 0 THEN 'system' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('Turn ', id, '.') AS text", "1 AS copies")
    same = spark.range(20_000).selectExpr("2L AS conv", "5L AS turn", "'user' AS role", "'Again.' AS text", "1 AS copies")
    both = df.unionByName(same)
    report = {r["conv"]: r for r in conversations.repair_report(both).collect()}
    turns = conversations.repaired_turns(both).collect()
    for conv, rows in ((1, n), (2, 20_000)):
        mine = sorted((r for r in turns if r["conv"] == conv), key=lambda r: r["place"])
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine))
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert report[conv]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest()
        assert sum(report[conv]["audit"].count(x) for x in "DKR") == rows
        assert report[conv]["audit"].replace("D", "") == "".join(r["edit"] for r in mine)
    assert report[2]["duplicate"] == 19_999 and report[2]["cost"] == 19_999 * 4 + 3
    assert report[2]["audit"] == "K" + "D" * 19_999 + "I"


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_report(conversations.damaged(df)).collect() == []
    assert conversations.repaired_turns(conversations.damaged(df)).collect() == []
