"""Conversation repair against a plain walk over all edits, faults by hand, damage by zlib."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import conversation_repair as repair
from tidemark.llm.queries import QUERIES

WORDS = r"[^\x20\x09-\x0D]"


def plain(kinds, inserts=2):
    """The least (cost, audit) over every edit string with up to so many insertions at each place, judged by the grammar as a pattern."""
    best = None
    for n in itertools.product(range(inserts + 1), repeat=len(kinds) + 1):
        for edits in itertools.product("DKR", repeat=len(kinds)):
            if any(k == "d" and e != "D" for k, e in zip(kinds, edits)):
                continue
            audit = "".join("I" * n[i] + e for i, e in enumerate(edits)) + "I" * n[-1]
            cost = 3 * sum(n) + sum(4 if e == "D" else 3 * (e == "R") + 3 * k.isupper() for k, e in zip(kinds, edits))
            if best and (cost, audit) >= best:
                continue
            free = 0
            roles = ""
            for i, e in enumerate(edits):
                free += n[i]
                roles += "?" * n[i] + ("" if e == "D" else "?" if e == "R" else kinds[i].lower())
            roles += "?" * n[-1]
            # a free place may be user or assistant
            if any(re.fullmatch("(s?(ua)+)?", "".join(r if r != "?" else f for r, f in zip(roles, fill))) for fill in alternations(roles)):
                best = (cost, audit)
    return best


def alternations(roles):
    system = roles.startswith("s")
    yield "s" * system + ("ua" * len(roles))[: len(roles) - system]


def walked(kinds):
    """The same by states, for any length."""
    ways = {"": (0, "")}  # by last role
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(ways):
        for _ in range(3):
            more = dict(ways)
            for last, (cost, audit) in ways.items():
                new, way = follow[last], (cost + 3, audit + "I")
                more[new] = min(more.get(new, way), way)
            ways = more
        return ways

    for kind in kinds:
        after = {}
        for last, (cost, audit) in inserted(ways).items():
            steps = [(last, 4, "D")]
            if kind != "d":
                steps.append((follow[last], 3 + 3 * kind.isupper(), "R"))
                if kind.lower() == follow[last] or kind.lower() == "s" and last == "":
                    steps.append((kind.lower(), 3 * kind.isupper(), "K"))
            for new, price, edit in steps:
                way = (cost + price, audit + edit)
                after[new] = min(after.get(new, way), way)
        ways = after
    ways = inserted(ways)
    return min(ways[last] for last in ("", "a") if last in ways)


def by_search(kinds):
    chain = repair.Chain(repair.NOTHING)
    for at in range(0, len(kinds), repair.BLOCK):
        chain.add({state: repair.search(kinds[at : at + repair.BLOCK], state) for state in chain.ends})
    return chain.close()


def test_search_finds_the_least_of_all_edits():
    for n in (1, 2):
        for kinds in map("".join, itertools.product("sSuUaAxXd", repeat=n)):
            assert by_search(kinds) == plain(kinds) == walked(kinds), kinds
    for kinds in map("".join, itertools.product("suaAd", repeat=3)):
        assert by_search(kinds) == plain(kinds, 1) == walked(kinds), kinds


def test_search_agrees_on_long_rows():
    draw = random.Random(3)
    for n in (5, 9, 20, 64, 65, 200, 700):
        for _ in range(40 if n < 100 else 5):
            kinds = "".join(draw.choices("sSuUaAxXd", [1, 1, 8, 3, 8, 3, 1, 1, 3], k=n))
            assert by_search(kinds) == walked(kinds), kinds
    turns = list("ua" * 300)
    for i in draw.sample(range(600), 60):
        turns[i] = draw.choice("dUAua")
    assert by_search("".join(turns)) == walked("".join(turns))


def test_bounds_never_exceed_the_cost():
    draw = random.Random(4)
    for _ in range(500):
        kinds = "".join(draw.choices("sSuUaAxXd", k=draw.randint(1, 8)))
        assert repair.suffix_bounds(kinds)[0] <= walked(kinds)[0], kinds


def by_hand(rows):
    """Result of the query by conversation, from (conv_id, turn, role, text)."""
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        damaged += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for conv in {r[0] for r in rows}:
        here = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, kinds, blank, duplicate, truncated = set(), "", 0, 0, 0
        for _, role, text in here:
            if not re.search(WORDS, text):
                blank, kinds = blank + 1, kinds + "d"
            elif (role, text) in seen:
                duplicate, kinds = duplicate + 1, kinds + "d"
            else:
                cut = re.findall(WORDS, text)[-1] not in ".!?"
                truncated += cut
                kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
                kinds += kind.upper() if cut else kind
            seen.add((role, text))
        cost, audit = walked(kinds)
        repaired, at, last = [], iter(here), ""
        for edit in audit:
            row = next(at) if edit != "I" else (None, "", "")
            if edit == "D":
                continue
            last = row[1][0] if edit == "K" else {"u": "a"}.get(last, "u")
            role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[last]
            repaired.append(f"{role}:{row[2]}")
        turns = [t for t, _, _ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:]))
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def talk(draw, conv, turns):
    rows = []
    for turn in range(turns):
        role = "system" if turn == 0 and draw.random() < 0.3 else ("user", "assistant")[turn % 2]
        rows.append((conv, turn, role, draw.choice(["Yes.", "No!", "why", "Long words here? ", "\t", "", "Well done.\n", "x" * 3000 + "."]) + draw.choice(["", "", f"{turn}."])))
    return rows


@pytest.fixture(scope="module")
def conversations():
    draw = random.Random(5)
    rows = [r for conv in range(60) for r in talk(draw, conv, draw.randint(1, 9))]
    rows += talk(draw, 1000, 900)  # several partitions
    rows += [(2000, t, "user", "Same text.") for t in range(300)]  # one text in very many turns
    rows += [(2001, 7, "assistant", "Same row.")] * 400  # one row very often
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (2002, None, "user", "No turn."), (2002, None, "user", "No turn, too."), (2002, 3, None, "No role.")]
    rows += [(2003, 1, "user", None), (2004, 1, "", "Empty role."), (2005, 1, "tool", "x" * 200_000), (2006, 5, "user", "A."), (2006, 9, "user", "A.")]
    return rows


def test_query_equals_the_plain_walk(spark, conversations, tmp_path):
    rows = [(*r, "extra", 1) for r in conversations]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, position int")
    frame.repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[n] for n in names) for r in found}
    assert len(found) == len(got)
    expected = by_hand(conversations)
    assert got.keys() == expected.keys()
    assert {k: (got[k], v) for k, v in expected.items() if got[k] != v} == {}


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = QUERIES["op11_conversation_repair"](spark, folder).collect()
    assert {r.conv_id: tuple(r[n] for n in names) for r in found} == by_hand(rows)


def test_repaired_rows_are_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Are you there?"), (1, 2, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = repair.repaired_rows(frame, repair.find_repairs(frame)).orderBy("position").collect()
    assert [(r.role, r.text, r.edit) for r in out] == [("user", "Hi.", "K"), ("assistant", "", "I"), ("user", "Are you there?", "K"), ("assistant", "Yes.", "K")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect() == []
