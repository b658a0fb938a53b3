"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

from geoaudit.llm import conversations as C

GRAMMAR = re.compile(r"(s?(ua)+)?")
NONBLANK = re.compile(r"[^\x20\x09-\x0D]")


def order(turn, role, text):
    return (turn is not None, turn or 0, role.encode(), text.encode())


def plain(rows):
    """Faults and the cheapest repair, by a best-first search over (rows done, roles so far is valid prefix)."""
    rows = sorted(rows, key=lambda r: order(*r))
    seen, kinds, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        found = NONBLANK.findall(text)
        fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            counts[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, best = [(0, "", 0, ())], None
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        roles = "".join(r[:1] for r, _ in out)
        if at == len(rows) and GRAMMAR.fullmatch(roles):
            best = min(best or (cost, audit, out), (cost, audit, out))
        ok = lambda role: re.fullmatch(r"s?(ua)*u?", roles + role[:1]) and role  # noqa: B023, E731
        for role in ("user", "assistant"):
            if ok(role) and len(audit) < 2 * len(rows) + 2:
                heapq.heappush(heap, (cost + 3, audit + "I", at, (*out, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, out))
            if kinds[at] not in ("blank", "duplicate"):
                more = 3 * (kinds[at] == "truncated")
                if ok(role):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    if ok(new):
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, (*out, (new, text))))
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, best[0], best[1], hashlib.sha256(text.encode()).hexdigest()), list(best[2])


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


SHAPE = "conv_id long, turn long, role string, text string"


def conversations(seed, n):
    random.seed(seed)
    out = []
    for conv in range(n):
        for turn in range(random.randrange(1, 6)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = random.choice(["Yes.", "No?", "Well", "", " \t", "So!  ", "…", None, "a b"])
            out.append((conv, random.choice([turn, turn, turn + 3, None]), role, text))
    return out


def test_repair_is_the_cheapest(spark):
    rows = conversations(5, 150)
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Oh."), (900, None, None, None)]
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = plain([r[1:] for r in hurt(rows) if r[0] == conv])[0]
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damaged(spark.createDataFrame(rows, SHAPE))).collect()}
    assert got == want


def test_edits_in_order(spark):
    rows = conversations(6, 40)
    found = C.repaired(spark.createDataFrame(rows, SHAPE)).orderBy("conv_id", "place").collect()
    for conv in {r[0] for r in rows}:
        have = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        outcome, messages = plain(have)
        mine = [r for r in found if r.conv_id == conv]
        assert [r.place for r in mine] == list(range(len(mine)))
        assert "".join(r.edit for r in mine) == outcome[6]
        assert [(r.role, r.text) for r in mine if r.edit != "D"] == messages


def naive(kinds):
    """The same pass with whole strings and one row at a time."""
    states = tuple(C._closed([(0, ""), None, None, None]))
    for k in kinds:
        states = C.advanced(states, k)
    return min(s for q, s in enumerate(states) if q in C._FINAL and s is not None)


def test_long_conversations_come_out_piece_by_piece():
    random.seed(8)
    for n in (15, 16, 17, 33, 400):
        c, edits, most = C.Conversation(), [], 0
        kinds = ""
        for i in range(n):
            role, text = random.choice(["user", "assistant", "system"]), random.choice(["Well.", "Well", ""])
            again = random.random() < 0.1
            kinds += "x" if not text or again else role[0] if text == "Well." else role[0].upper()
            edits += c.add(i, role, text, again)
            most = max(most, len(c.rows))
        edits += c.end()
        assert (c.cost, "".join(e for e, _, _ in edits)) == naive(kinds)
        assert not c.rows
    assert most < 200


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert C.repair(C.damaged(empty)).count() == 0
    # a conversation of which every row is dropped stays, with zeros
    conv = next(i for i in range(10000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for t in (0,)))
    row = C.repair(C.damaged(spark.createDataFrame([(conv, 0, "user", "x.")], SHAPE))).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # repeated rows, a very long text and further columns of clashing names
    long = "word " * 200_000 + "."
    rows = [(1, 7, "user", long), (1, 7, "user", long), (1, 8, "assistant", "ok.")]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS nth", "2 AS what", "3 AS audit", "4 AS copy")
    got = C.repair(df).first()
    assert tuple(got)[1:] == plain([r[1:] for r in rows])[0]
