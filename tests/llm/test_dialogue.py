"""Repairs against a search through all edit scripts."""
import hashlib
import re
import zlib

import numpy as np
import pytest

from skepsis.llm import dialogue as d

OK = re.compile(r"(s?(ua)+)?$")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, transcript) by trying everything, cheapest first by dynamic programming over (row, roles so far)."""
    paths = {"": (0, "", ())}               # role initials -> best; all strings that can still become legal
    for (_, _, role, text), fault in zip(rows, plain_faults(rows)):
        new = {}

        def offer(key, cost, audit, said):
            if re.fullmatch(r"s?(ua)*u?", key) and (key not in new or (cost, audit) < new[key][:2]):
                new[key] = (cost, audit, said)
        todo = list(paths.items())
        for ins in (0, 1, 2):
            for key, (cost, audit, said) in todo:
                offer(key, cost + 2, audit + "D", said)
                if fault not in ("blank", "duplicate"):
                    stay = 5 if fault == "truncated" else 0
                    if role[:1] in ("s", "u", "a"):
                        offer(key + role[0], cost + stay, audit + "K", (*said, f"{role}:{text}"))
                    for r in ("user", "assistant"):
                        offer(key + r[0], cost + stay + 1, audit + "R", (*said, f"{r}:{text}"))
            todo = [(key + r[0], (cost + 5, audit + "I", (*said, f"{r}:"))) for key, (cost, audit, said) in todo for r in ("user", "assistant")]
        paths = new
    ends = []
    for key, (cost, audit, said) in paths.items():
        for tail in ("", "u", "a", "ua"):
            if OK.match(key + tail):
                ends.append((cost + 5 * len(tail), audit + "I" * len(tail), said + tuple("user:" if t == "u" else "assistant:" for t in tail)))
    return min(ends, key=lambda e: e[:2])


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        held = plain_damage([r for r in rows if r[0] == conv])
        turns = [r[1] for r in held if r[1] is not None]
        f = plain_faults(held)
        ini = [r[2][:1] for r in held]
        cost, audit, said = plain_repair(held)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def conversations(seed, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(1, 9))):
            role = str(rng.choice(["user", "assistant", "system", "tool", "u", ""], p=[.4, .35, .15, .04, .03, .03]))
            text = str(rng.choice(["Yes.", "No", "What? ", "  \n", "Tell me more!", "é　", "a.b"]))
            rows.append((conv if conv else None, None if rng.random() < 0.08 else turn * int(rng.integers(1, 3)), None if rng.random() < 0.03 else role, None if rng.random() < 0.03 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_trying_everything(spark, seed):
    rows = conversations(seed)
    rows += rows[:9] + [(900, 1, "user", "Hm. " * 100_000), (900, 2, "assistant", "x" * 200_000 + ".")]
    rows += [(901, t, "user", f"Line {t}.") for t in range(40)] + [(902, 5, "assistant", "Same.")] * 30
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, fault int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in d.repaired(df).collect()}
    assert got == plain(rows)


def test_lost_conversations_and_empty_tables(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in d.repaired(df).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert d.repaired(df.filter("false")).count() == 0


def test_script_holds_the_repaired_conversation(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "There?"), (1, 2, "assistant", "  "), (1, 3, "assistant", "cut"), (1, 4, "assistant", "Done.")]
    got = d.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["edit"], r["fault"], r["new_role"]) for r in got] == [("D", None, None), ("K", None, "user"), ("D", "blank", None), ("D", "truncated", None), ("K", None, "assistant")]


def test_survivors_meet():
    """Ordinary conversations leave a few unresolved rows whatever their length; edits are those of the whole."""
    rng = np.random.default_rng(3)
    decoder, given, longest = d.Decoder(), 0, 0
    for i in range(20_000):
        bad = rng.random()
        given += len(list(decoder.read((1, i), "?" if bad < 0.02 else "ua"[i % 2], "truncated" if 0.02 < bad < 0.05 else "blank" if bad > 0.98 else None)))
        longest = max(longest, i + 1 - given)
    assert given + len(list(decoder.end())) == 20_001 and longest < 200
    assert d.transition.cache_info().currsize < 4000
