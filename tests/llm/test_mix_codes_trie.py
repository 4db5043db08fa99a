"""Mixing, vector codes and the conversation trie against brute-force versions on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ledgerlane.llm import common, mixing, prefix_trie, vector_codes


@pytest.fixture(scope="module")
def ready(spark):
    return common.prepare(spark)


# mixing


def wanted_targets(sizes: dict) -> dict:
    """Targets by resharing the excess round by round, in exact fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        left = Fraction(3, 2) * sum(sizes.values()) - sum(full.values())
        among = sum(weight[s] for s in order if s not in full)
        shares = {s: left * weight[s] / among for s in order if s not in full}
        over = {s: Fraction(2 * sizes[s]) for s in shares if shares[s] > 2 * sizes[s]}
        if not over:
            return {**full, **shares}
        full |= over


def mixture(spark, rng, n=700):
    rows = []
    for i in range(n):
        source = rng.choice(["b", "b", "b", "a", "é", "", None, "tiny"]) if i else "tiny"
        words = rng.choice([0, 1, 3, 10, 40, 300])
        rows.append((i, " \t\x0b".join(["w\x00 x"] * words), source, "k", 1, 2.0, "u"))
    rows += [(5000, None, "a", "k", 1, 2.0, "u"), (None, "some words", None, "k", 1, 2.0, "u"), (5001, "w " * 2_000, "b", "k", 1, 2.0, "u")]
    rows += [(5002, "one two three", "b", "k", 1, 2.0, "u")] * 101
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, number string, n int, p double, u string").repartition(5)


def test_mix_keeps_targets_and_bounds(ready):
    rows, df = mixture(ready, random.Random(1))
    size = [len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows]
    per = defaultdict(int)
    for r, s in zip(rows, size):
        per[r[2]] += s
    targets = wanted_targets(per)
    got = mixing.mix(df).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, s) for r, s in zip(rows, size))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == per[r["source"]] and math.isclose(r["target"], targets[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        if r["size"]:
            assert abs(r["copies"] - r["target"] / r["source_size"]) < 1
        taken[r["source"]] += r["taken"]
    for s in per:
        assert abs(taken[s] - float(targets[s])) <= 150
    again = mixing.mix(df.repartition(2), block=mixing.BLOCK).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_by_deep_trees_and_of_nothing(ready):
    rows, df = mixture(ready, random.Random(2))
    got = mixing.mix(df, block=4).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 150 for r in got if r["source"] != "tiny") and len(got) == 6
    assert mixing.mix(df.limit(0)).count() == 0
    blank = mixing.mix(df.filter("doc_id = 5000")).first()
    assert (blank["size"], blank["target"], blank["taken"]) == (0, 0.0, 0)


def test_mix_is_unbiased(ready):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 300}") for i in range(6000)]
    got = mixing.mix(ready.createDataFrame(rows, "doc_id long, text string, source string"), block=5)
    by = got.selectExpr("size", "copies - target / source_size as d").groupBy("size").agg({"d": "avg"}).collect()
    assert all(abs(r["avg(d)"]) < 0.06 for r in by)  # heavy and light documents alike


# vector codes


def codes_by_brute_force(rows, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(r[1]) for r in kept) // 8)
    kept = [(i, v + [0] * (8 * width - len(v)), label) for i, v, label in kept]
    part = [[v[p * width:(p + 1) * width] for _, v, _ in kept] for p in range(8)]
    books = [[list(x) for x in part[p][:16]] for p in range(8)]
    for r in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for x in part[p]] for p in range(8)]
        for p in range(8 if r < rounds else 0):
            for k in range(len(books[p])):
                own = [x for x, (_, a) in zip(part[p], near[p]) if a == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(near[p][n][0] for p in range(8)) for n in range(len(kept))]
    total = defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        total[label] += e
    return sorted((repr(i), "".join(f"{near[p][n][1]:02x}" for p in range(8)), error[n], total[label], sha) for n, (i, _, label) in enumerate(kept))


VECTORS = "vec_id long, embedding array<float>, label int, codes string, far int, _label string, data string"


def codes(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "c", 1, "l", "d") for r in rows], VECTORS).repartition(3)
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.code_table(df, **settings).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_brute_force_with_ties(ready, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-2, -1, 0, 1, 2]) / 4096 for _ in range(16)], rng.choice([0, 0, 0, 1, None])) for i in range(300)]
    rows += [rows[3]] * 40 + [(700, None, 1), (701, [1.0] * 15 + [None], 1), (702, [float("nan")] * 16, 1), (703, [float("inf")] + [0.0] * 15, 0), (None, rows[5][1], 1)]
    assert codes(ready, rows) == codes_by_brute_force(rows)


def test_codes_of_odd_tables(ready):
    rng = random.Random(5)
    few = [(i, [rng.gauss(0, 1) for _ in range(10 - i % 2)], None) for i in range(5)]  # fewer rows than entries, shorter vectors
    assert codes(ready, few) == codes_by_brute_force([(i, [float(np.float32(x)) for x in v], lb) for i, v, lb in few])
    assert codes(ready, []) == [] and codes(ready, [(1, None, 1)]) == []


def test_active_entries_change_nothing():
    rng = np.random.default_rng(7)
    x = rng.integers(-4, 5, (400, 3)).astype(np.int32)
    book = rng.integers(-4, 5, (16, 3))
    held, far = vector_codes.scan(x, book)
    for share in (0.0, 0.2, 0.7, 1.0):
        moved = rng.random(16) < share
        new = book + moved[:, None] * rng.integers(-2, 3, (16, 3))
        for got, want in zip(vector_codes.rescan(x, new, moved, held, far), vector_codes.scan(x, new)):
            assert (got == want).all()


# conversation trie


def trie_by_brute_force(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [v[3:] for v in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members, kids, leaves, saved, out = defaultdict(list), defaultdict(list), {}, {}, {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
        ends = ",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p))))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(df, **settings):
    got = prefix_trie.prefix_trie(df, **settings).collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}
    assert len(found) == len(got)
    return found


TURNS = "conv_id long, turn long, role string, text string, path string, n int, key string, borrowed int, node string"


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "k", 2, "x") for r in rows], TURNS).repartition(4)


@pytest.mark.parametrize("run_nodes", [prefix_trie.RUN_NODES, 7, 1])
def test_trie_equals_brute_force(ready, run_nodes):
    rng = random.Random(11)
    said = [("user", "a"), ("user", "bé"), ("assistant", "a"), (None, ""), ("", None), ("user", "long " * 50)]
    rows = []
    for c in range(-7, 120):
        for t in range(rng.choice([1, 2, 5, 12, 30])):
            role, text = said[0] if c % 3 and t < 4 else rng.choice(said)
            rows.append((c, None if t == 3 and c % 7 == 0 else t, role, text))
    rows += [(c, t, "user", "the same") for c in range(1000, 1200) for t in range(3)]  # a group of copies
    rows += [(5, 0, "user", "tie"), (5, 0, "user", "tie"), (5, 0, "assistant", "tie"), (None, 0, "user", "nobody's"), (3001, 0, "user", "x")]
    assert trie(turns_table(ready, rows), run_nodes=run_nodes) == trie_by_brute_force(rows)


def test_trie_of_long_conversations_and_of_nothing(ready):
    rows = [(c, t, "user", f"turn {t // (1 + c % 2)}") for c in (10, 11, 20) for t in range(3000)]
    assert trie(turns_table(ready, rows), run_nodes=500) == trie_by_brute_force(rows)
    assert trie(turns_table(ready, [])) == {}


def test_findclose_over_many_blocks():
    rng = random.Random(3)
    for shape in ("wide", "deep", "mixed"):
        bits, open_, want, stack = [1], 1, {}, [0]
        while len(bits) < 5000:
            up = {"wide": open_ < 2, "deep": len(bits) < 2500, "mixed": rng.random() < 0.5}[shape] or open_ == 1
            if up:
                stack.append(len(bits))
            else:
                want[stack.pop()] = len(bits)
            bits.append(int(up))
            open_ += 1 if up else -1
        for _ in range(open_):
            want[stack.pop()] = len(bits)
            bits.append(0)
        text = prefix_trie.Parentheses(np.array(bits, np.uint8))
        assert text.findclose(text.opens).tolist() == [want[i] for i in text.opens.tolist()]
