"""Structure repair, the prefix trie and the mixture of sources, against brute force and SQL."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import mixture, prefix, queries, repair, trie

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
NEW = ["op11_cost_to_go_repair", "op12_mixture_rates", "op13_preorder_trie"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(norm(x[i]) for i in at) for x in rel.fetchall()), key=repr)


def legal(roles: str) -> bool:
    rest = roles[1:] if roles.startswith("s") else roles
    return roles == "" or (len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def every_repair(letters: str):
    """Cost, edits and roles of all edits with two insertions at most at a place, by plain enumeration."""
    places = [["", "u", "a", "ua", "au"]] * (len(letters) + 1)
    kinds = [["D"] if c == "x" else ["D", "K", "u", "a"] for c in letters]
    for ins in itertools.product(*places):
        for acts in itertools.product(*kinds):
            roles, edits, cost = ins[0], "I" * len(ins[0]), 2 * len(ins[0])
            for c, act, more in zip(letters, acts, ins[1:], strict=True):
                if act == "D":
                    edits, cost = edits + "D", cost + 3
                else:
                    edits, cost = edits + ("K" if act == "K" else "R"), cost + 2 * (act != "K") + c.isupper()
                    roles += c.lower() if act == "K" else act
                roles, edits, cost = roles + more, edits + "I" * len(more), cost + 2 * len(more)
            if legal(roles):
                yield cost, edits, roles


def test_cheapest_edits_equal_enumeration():
    assert repair.cheapest("") == (0, "")
    for letters in [*map("".join, itertools.product("suaoxUA", repeat=2)), *"suaoxSUAO", "ssu", "uuu", "aua", "uau", "oUx", "sAu", "xsx"]:
        assert repair.cheapest(letters) == min(every_repair(letters))[:2], letters


def test_cheapest_edits_of_a_long_conversation():
    cost, audit = repair.cheapest("ua" * 50_000 + "s")
    assert cost == 3 and audit == "K" * 100_000 + "D"


def repaired_by_hand(rows):
    """conv_id -> all of the contract's figures, from the rows after damage, by Dijkstra over (place, state)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.sha256((r[3] or " ").encode()).hexdigest())):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind:
                text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
                own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        need, to = {0: "user", 1: "user", 2: "assistant", 3: "user"}, {0: 2, 1: 2, 2: 3, 3: 2}
        heap, done, best = [(0, "", 0, 0, ())], set(), None
        while heap:
            cost, edits, i, q, turns = heapq.heappop(heap)
            if (i, q) in done:
                continue
            done.add((i, q))
            if i == len(own) and q in (0, 3):
                best = (cost, edits, turns)
                break
            heapq.heappush(heap, (cost + 2, edits + "I", i, to[q], (*turns, f"{need[q]}:")))
            if i < len(own):
                heapq.heappush(heap, (cost + 3, edits + "D", i + 1, q, turns))
                _, role, text = own[i]
                fee = faults[i] == "truncated"
                if faults[i] in (None, "truncated"):
                    heapq.heappush(heap, (cost + 2 + fee, edits + "R", i + 1, to[q], (*turns, f"{need[q]}:{text}")))
                    if role[:1] == need[q][0] or (q == 0 and role[:1] == "s"):
                        heapq.heappush(heap, (cost + fee, edits + "K", i + 1, 1 if role[:1] == "s" else to[q], (*turns, f"{role}:{text}")))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), best[0], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())
    return out


def test_repair_of_odd_rows_equals_search(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Hi there.", "what", " \t\n", "", None, "Ende!", "x?\x0b ", "a.b ", "é…", "long " * 4000 + "."]
    rows = [(c, rng.choice([None, t, t + 1]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for c in [None, -3, *range(60)] for t in range(rng.randint(1, 9))]
    rows += rows[:25]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS + ", at long, dropped string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "repaired_sha256"]
    got = {r["conv_id"]: r for r in queries.op11_cost_to_go_repair(spark, str(tmp_path)).collect()}
    want = repaired_by_hand(rows)
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == want
    found = repair.faults(repair.damaged(df))
    turns = repair.rebuilt(found, repair.summaries(found)).collect()
    for conv in got:
        assert legal("".join(t["role"][0] for t in sorted((t for t in turns if t["conv_id"] == conv), key=lambda t: t["at"])))


def test_repair_without_damage_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b."), (2, 0, "user", "no answer.")], ROWS)
    found = repair.faults(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in repair.summaries(found).collect()} == {1: (0, "KK"), 2: (2, "KI")}
    none = repair.faults(repair.damaged(df.limit(0)))
    summary = repair.summaries(none)
    assert summary.count() == 0 and repair.rebuilt(none, summary).count() == 0


def nodes_by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        convs.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    convs = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        built[c] = ([] if c is None else convs.get(c - c % 100, [])[:h]) + own[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    low = lambda cs: min((c for c in cs if c is not None), default=None)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in cs if len(built[c]) == len(node)), key=lambda c: (c is not None, c)))
        out.append((low(cs), len(node), low(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, prefix.BLOCK])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(prefix, "BLOCK", block)  # several levels of blocks, or one
    monkeypatch.setattr(trie, "CHUNK", 7)
    rng = random.Random(11)
    rows = []
    for c in [None, *range(40), *range(95, 130), 200, 201, 305, 10**12 + 7]:
        same = rng.random() < 0.3
        for t in range(rng.randint(1, 7)):
            rows.append((c, None if t == 0 and c == 3 else t, "user" if same else rng.choice(["user", "assistant", None, ""]), "same" if same else rng.choice(["a", "b", None, "", "ä" * 9])))
    rows += [(5, 1, "user", "a")] * 3
    spark.createDataFrame([(*r, 1) for r in rows], ROWS + ", depth long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_preorder_trie(spark, str(tmp_path)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == nodes_by_hand(rows)


def test_trie_intervals(spark):
    convs = trie.conversations(spark.read.parquet(f"{SF}/conversations.parquet"))
    nodes = {bytes(r["node"]): r for r in trie.build(convs)[1].collect()}
    assert sorted(r["at"] for r in nodes.values()) == list(range(len(nodes)))
    for r in nodes.values():
        if r["parent"] is not None:
            p = nodes[bytes(r["parent"])]
            assert p["at"] < r["at"] <= r["end"] <= p["end"]
    none = trie.build(convs.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def test_running_sums_and_positions(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK", 4)
    df = spark.range(150).selectExpr("id * 7919 % 1009 as k", "id % 5 as v")
    rows = prefix.running(prefix.positions(df, F.col("k")), "at", "v").orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(150)) and [r["k"] for r in rows] == sorted(r["k"] for r in rows)
    assert [r["run_v"] for r in rows] == list(itertools.accumulate(r["v"] for r in rows))


def shares_by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, full = share * sum(sizes.values()), set()
    while True:
        left, by = goal - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else left * w[s] / by for s in names}
        over = {s for s in names if s not in full and t[s] > most * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets_equal_rounds(spark):
    rng = random.Random(3)
    for _ in range(3):
        sizes = {s: rng.choice([0, 1, 7, 100, 5000]) + rng.randint(0, 50) for s in [None, "", "Z", "a", "é", "\U0001f600", *[f"s{i}" for i in range(rng.randint(1, 20))]]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixture.targets(df).collect()}
        want = shares_by_hand(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix_takes_what_it_should(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "hot" if i % 3 == 0 else f"s{i % 7}", "clash") for i in range(3000)]
    rows += [(None, "null id one", None, ""), (None, "\t", None, ""), (7, None, "s1", ""), (7, "seven", "s1", ""), (7, "seven", "s1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixture.mix(docs).collect()
    assert len(out) == len(rows)
    taken, target = {}, {}
    for r in out:
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(3, 0.004 * target[s]) for s in target)
    assert sorted(map(tuple, mixture.mix(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, out), key=repr)
    emitted = mixture.emit(docs)
    assert emitted.columns == [*docs.columns, "__copy"]
    assert emitted.count() == sum(r["copies"] for r in out)


def test_mix_of_empty_tables_and_of_no_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mixture.mix(docs).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixture.mix(docs.limit(0)).count() == 0


def test_mix_runs_in_the_jvm_alone(spark):
    plan = queries.op12_mixture_rates(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
