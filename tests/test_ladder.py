"""The budget ladder against a plain restatement that renders every rung, and its last resorts."""

import math
import random
import re

from tracefold.operators import ladder
from tracefold.operators.render import SECTIONS

PLACE = {s: i for i, (s, _) in enumerate(SECTIONS)}
SUB = {p: i for i, p in enumerate(("command", "named", "", "replaced", "attempted", "detail", "observed", "omitted"))}


def units(s):
    up = lambda xs, k: sum(math.ceil(len(x) / k) for x in xs)
    first = re.findall(r"(?:^|[ \n\r\t])([A-Za-z]+)", s)
    u = up(re.findall("  +", s), 2) + len(re.findall(r"[\n\r\t]", s)) + up(first, 3) + up(re.findall("[A-Za-z]+", s), 2) - up(first, 2) + up(re.findall("[0-9]+", s), 3)
    return u + 2 * len(re.findall(r"[^\x00-\x7f]", s)) + len(re.findall(r"[\x00-\x08\x0b\x0c\x0e-\x1f!-/:-@\[-`{-\x7f]", s))


def tokens(s):
    return units(s) + math.ceil(units(s) / 32)


def cut(s, n):
    return s if len(s) <= n else s[: n - 3] + "..."


def text_of(lines):
    out, seen = [], set()
    for section, n, part, line in sorted(lines, key=lambda x: (PLACE[x[0]], x[1], SUB[x[2]])):
        if section not in seen:
            out.append(section.lower() + ":")
            seen.add(section)
        out.append(line)
    return "\n".join(out)


def plain(lines, budget):
    """(rung, dropped, capsule) of one session's (section, part, n, text)."""
    fits = lambda t: tokens(t) <= budget and len(t) <= 9500
    table = {}
    for r, s, p, entries, cap, oldest in ladder.limits():
        table.setdefault(r, {})[s, p] = (entries, cap, oldest)
    caps = {}
    for rung in table.values():
        for k, (_, cap, _) in rung.items():
            caps.setdefault(k, set()).add(cap)

    def variant(s, p, text, cap):
        return min(((units(v), -c, v) for c in caps[s, p] if c >= cap for v in ["- " + cut(text, c)]), key=lambda x: x[:2])[2]

    for rung in sorted(table):
        shown = []
        for s, p, n, text in lines:
            entries, cap, oldest = table[rung][s, p]
            last = max(m for s2, p2, m, _ in lines if (s2, p2) == (s, p))
            if n <= entries and last - n >= oldest:
                shown.append((s, n, p, variant(s, p, text, cap)))
        if fits(text_of(shown)):
            return rung, 0, text_of(shown)
    gone = 0
    for section in ladder.DROPPED:
        for line in sorted((x for x in shown if x[0] == section), key=lambda x: (x[1], SUB[x[2]]), reverse=True):
            if fits(text_of(shown)):
                break
            shown.remove(line)
            gone += 1
    return rung, gone, text_of(shown)


def test_rungs_hard_stop_and_budget(spark):
    rng = random.Random(5)
    kinds = [(s, p) for s, p, _, _ in ladder.FULL]
    rows, by = [], {}
    for k in range(60):
        for s, p in rng.sample(kinds, rng.randrange(2, len(kinds))):
            for n in range(1, rng.randrange(2, 10)):
                word = lambda: "".join(rng.choice("abcdefXYZ_/.é9") for _ in range(rng.randrange(1, 12)))
                size = rng.choice([2, 8, 30]) if s not in ("WORKSPACE_STATE", "RECORD_DETAIL") else 2
                rows.append((f"s{k}", s, p, n, " ".join(word() for _ in range(size))))
                by.setdefault(f"s{k}", []).append(rows[-1][1:])
    df = spark.createDataFrame(rows, ladder.LINE)
    for budget in (740, 200):
        got = {r.session_id: r for r in ladder.render(df, budget).collect()}
        assert set(got) == set(by)
        seen = set()
        for s, lines in by.items():
            rung, gone, text = plain(lines, budget)
            r = got[s]
            assert (r.rung, r.dropped) == (rung, gone)
            assert r.tokens == tokens(r.capsule) <= budget
            assert r.trimmed == (tokens(text) > budget) and (r.trimmed or r.capsule == text)
            seen.add((rung == 0, rung == len(ladder.RUNGS), gone > 0))
        assert len(seen) > 2


def test_a_frame_that_is_too_long_is_cut_at_the_longest_that_fits(spark):
    rows = [("s", "WORKSPACE_STATE", "", 1, "word " * 400), ("s", "LATEST", "", 1, "x" * 100), ("t", "FIRST_MESSAGE", "", 1, " "), ("u", "LATEST", "", 1, "next")]
    got = {r.session_id: r for r in ladder.render(spark.createDataFrame(rows, ladder.LINE), 64).collect()}
    s = got["s"]
    assert s.trimmed and s.dropped == 0 and s.tokens <= 64 and tokens(s.capsule + " word") > 64
    assert (got["t"].rung, got["t"].capsule, got["t"].tokens) == (0, "", 0)
    assert (got["u"].rung, got["u"].capsule) == (0, "latest:\n- next")
