"""The Merkle manifest and the trie of conversations against plain Python."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from marketjobs.llm import merkle, order, trie

RNG = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long"


def h(s: str) -> str:
    return sha256(s.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text) -> str:
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels_of(leaves: list[str]) -> list[list[str]]:
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        lo = i - i % 16
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 16])))
        i //= 16
    return out


def manifest_of(rows: list[tuple]) -> list[tuple]:
    sources: dict = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        own = [(r, leaf_of(r[0], r[3], r[2], r[4], r[1])) for r in sources[s]]
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, levels_of([x for _, x in own])))
    top = levels_of([t[-1][0] for _, t in trees])
    out = []
    for k, (own, levels) in enumerate(trees):
        for i, (r, leaf) in enumerate(own):
            path = siblings(levels, i) + siblings(top, k)
            digest = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                digest = leaf_of(r[0], r[3], r[2], r[4], "".join(c.lower() if c.isascii() else c for c in r[1]))
            for a, b in path:
                digest = h(a + digest + b)
            out.append((r[0], leaf, levels[-1][0], top[-1][0], h("".join(a + b for a, b in path)), digest, digest == top[-1][0]))
    return out


def made_rows(n: int, sources: list) -> list[tuple]:
    rows = [(i if RNG.random() > 0.05 else None, RNG.choice([None, "", "Ünï " * RNG.randrange(4) + "Text", "low"]), RNG.choice(["en", None]), RNG.choice(sources), RNG.choice([None, 5]), "x", 3) for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("n", "sources", "wide"), [(700, ["a"] * 40 + [None, "", "B", "ä", "𝄞"], 64), (40, [f"s{i}" for i in range(300)], 4), (300, ["one"], 16), (1, ["one"], 16), (0, ["one"], 16)])
def test_merkle(spark, monkeypatch, n, sources, wide):
    monkeypatch.setattr(merkle, "RANGE", wide)
    rows = made_rows(n, sources)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = merkle.manifest(docs)
    got = merkle.proofs(made)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda t: (t[0] is not None, t[0] or 0, *map(str, t[1:]))
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted(manifest_of(rows), key=key)
    assert made.root == (manifest_of(rows)[0][3] if n else None)
    # Every inner node is resolved once, in whichever round.
    assert made.nodes.groupBy("tree", "level", "idx").count().where("count > 1").isEmpty()


def test_forest_is_a_monoid():
    """Any split and order of the leaves, and of the fragments, gives the same nodes."""
    leaves = [(0, 300, 0, i, h(str(i)), i) for i in range(300)] + [(1, 1, 0, 0, h("lone"), 300)]

    def reduced(rows):
        forest = merkle.Forest(2)
        for tree, size, level, idx, digest, start in rows:
            forest.sizes[tree] = size
            forest.add(tree, level, idx, digest, start)
        return [r[:4] for r in forest.made], [(r[0], r[5], r[1], r[2], r[3], r[6]) for r in forest.rest()]

    whole, rest = reduced(leaves)
    assert not rest
    for _ in range(5):
        RNG.shuffle(leaves)
        parts = [reduced(leaves[i::4]) for i in range(4)]
        last, rest = reduced([x for _, waiting in parts for x in waiting])
        assert not rest and sorted(last + [x for done, _ in parts for x in done]) == sorted(whole)


def test_numbering_spreads_one_key(spark):
    rows = [(None if i % 3 else "b", i % 7, i) for i in range(500)]
    got, keys = order.numbered(spark.createDataFrame(rows, "k string, v long, w long").repartition(6), "k", ["v"], "test")
    found = got.orderBy("pos").collect()
    assert [r["pos"] for r in found] == list(range(500)) and [r["nr"] for r in found] == [*range(333), *range(167)]
    assert [(r["key_nr"], r["k"], r["size"]) for r in keys.orderBy("key_nr").collect()] == [(0, None, 333), (1, "b", 167)]
    assert all((a["k"] is not None, a["v"]) <= (b["k"] is not None, b["v"]) for a, b in zip(found, found[1:], strict=False))


def trie_of(rows: list[tuple]) -> list[tuple]:
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {}
    for c, ts in convs.items():
        # Ties of turns are in the order of their digests.
        own[c] = [(t[2], t[3]) for t in sorted(ts, key=lambda t: (*t[:2], sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))]
    members: dict = {}
    ends: dict = {}
    for c, ts in own.items():
        n = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(own.get(base, [])[:n] + ts[n:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ids = lambda p: ",".join(map(str, sorted(ends.get(p, []))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], h(ids(p))) for p, m in members.items())


def conversations(kind: str) -> list[tuple]:
    if kind == "long":  # one conversation holds most turns, and shares its head with neighbours and a copy of all
        long = [(5, i, "user" if i % 2 else "assistant", f"t{i} é") for i in range(60)]
        return long + [(6, i, r, t) for _, i, r, t in long] + [(10, i, r, t) for _, i, r, t in long[:33]] + [(c, 0, "user", "hi") for c in range(11, 20)]
    if kind == "copies":
        return [(c, i, "user", f"same {i}") for c in range(600) for i in range(3)] + [(c, 0, None, None) for c in range(-7, 0)]
    out = []
    for c in range(40):
        for i in range(RNG.randrange(1, 12)):
            out.append((RNG.choice([c, c, c, None]), RNG.choice([i, i, None]), RNG.choice(["user", None]), RNG.choice(["a", "b", "", None, "ß" * 5])))
    return out + out[:20]


@pytest.mark.parametrize("kind", ["mixed", "long", "copies", "none"])
@pytest.mark.parametrize("block", [4, 256])
def test_trie(spark, kind, block):
    rows = conversations(kind) if kind != "none" else []
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(3)
    got = trie.trie(*trie.rebuilt(*trie.turns(df)), block).drop("digest")
    assert sorted(tuple(r) for r in got.collect()) == trie_of(rows)
