"""Filter audit, Merkle manifest and line dedup against brute force, on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, tree int, `at` int, digest string, h1 int, quality int, _tree string"
CLASH = ("clash", 1, 2, "x", 3, 1, "t")


def document(r: random.Random) -> str:
    line = lambda: " ".join(r.choice(["alpha", "Beta", "gamma", "DELTA", "ré", "of", "the"]) + r.choice(["", "", "#"]) for _ in range(r.randint(1, 12)))
    return "\n".join(r.choice([line(), line(), "A line that many DOCUMENTS share ", "\ta line that many documents share", "short", "nineteen code pointé", "twenty code points é"]) for _ in range(r.randint(1, 9)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    texts = [document(r) for _ in range(40)]
    texts = [f"{t}\na passage of some neighbours" if 22 <= i < 26 else t for i, t in enumerate(texts)]
    long = " ".join(f"word{k % 4000}" for k in range(30_000)) + "\n" + "\n".join(f"line {k % 50} of a very long text" for k in range(3000))
    texts += [None, "", "", " \n\t\n", "x", "x", texts[3], texts[3], long, long + "!", None, "ABC", "a\n" * 300, "word " * 250]
    out = [(i, t, None if i % 7 == 0 else "en", [None, "a", "", "Zé", "a"][i % 5], None if i % 11 == 0 else len(t or ""), *CLASH) for i, t in enumerate(texts)]
    out += [(None, texts[3], "en", "a", 1, *CLASH), (None, "A line that many documents share", "en", "b", 1, *CLASH), (5, texts[5], "de", None, 2, *CLASH), (5, texts[6], "de", "a", 2, *CLASH)]
    return out + [out[4], out[4]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def age(i):
    return (i is not None, i or 0)


# audit


def failures(rows):
    """The filters that each row fails."""
    first = {}
    for i, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", (True, 1 << 70)), age(i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        flags = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), age(i) > first[t])
        out.append("".join(f for f, on in zip("ABCDE", flags) if on))
    return out


def test_audit_follows_every_order(spark, docs, rows):
    from plansheet.llm.audit import audit

    labels = [(k, k % 2, None if k % 6 == 0 else k % 3) for k in range(0, 50, 2)] + [(k, 1, 1) for k in (4, 9, 9)] + [(None, 1, 1), (2, 1, None), (999, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    got = audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    fails, want = failures(rows), []
    assert {f for x in fails for f in x} == set("ABCDE")
    for part in sorted({r[3] or "" for r in rows}):
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[3] or "") == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [i for i, x in own if f in x and not set(order[:k]) & set(x)]
                total[f] += len(here)
                steps.append((part, order, k + 1, sum(not set(order[: k + 1]) & set(x) for _, x in own), len(here), sum(f in x and bool(set(order[:k]) & set(x)) for _, x in own), sum(x == f for _, x in own), sum(i in good for i in here), sum(i in toxic for i in here), f))
        want += [(*s[:-1], total[s[-1]]) for s in steps]
    assert sorted(map(tuple, got)) == sorted(want)


def test_audit_of_nothing(spark, empty):
    from plansheet.llm.audit import audit

    assert audit(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


# manifest


def digest(*fields):
    return hashlib.sha256("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields).encode()).hexdigest()


def tree(nodes):
    """Each node's siblings (before, after) by level, and the root."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(spots):
            low = at // 3 * 3
            paths[i].append((nodes[low:at], nodes[at + 1 : low + 3]))
        nodes, spots = [hashlib.sha256("".join(nodes[k : k + 3]).encode()).hexdigest() for k in range(0, len(nodes), 3)], [at // 3 for at in spots]
    return paths, nodes[0] if nodes else None


def climbed(rows):
    """(doc_id, leaf, subroot, root, path) of each row."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((age(r[0]), digest(r[0], r[3], r[2], r[4], r[1])))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([leaf for _, leaf in sorted(by[s])]) for s in sources]
    above, root = tree([t[1] for t in trees])
    for s, (paths, sub), up in zip(sources, trees, above):
        for ((known, i), leaf), path in zip(sorted(by[s]), paths):
            yield i if known else None, leaf, sub, root, path + up


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_and_proofs(docs, rows, levels):
    from pyspark.sql import functions as F

    from plansheet.llm.manifest import folded, hexed, manifest, proof_digest

    got = manifest(docs, levels=levels).select("doc_id", *(hexed(F.col(c)) for c in ("leaf", "subroot", "root")), "proof", proof_digest(F.col("proof")).alias("all"), folded(hexed(F.col("leaf")), F.col("proof")).alias("folded")).collect()
    assert all(g.folded == g[3] for g in got)
    plain = lambda p: "".join(b.hex() for s in p for b in s)
    want = sorted((age(i), leaf, sub, root, "".join("".join(b + a) for b, a in path)) for i, leaf, sub, root, path in climbed(rows))
    assert sorted((age(g[0]), g[1], g[2], g[3], plain(g.proof)) for g in got) == want
    assert all(g.all == hashlib.sha256(plain(g.proof).encode()).hexdigest() for g in got)


def test_tampering_shows(spark, rows, tmp_path):
    from plansheet.llm.manifest import op12_merkle_manifest

    some = [r for r in rows if r[0] is not None]
    spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_merkle_manifest(spark, str(tmp_path)).collect()
    held = {}
    for i, leaf, _, root, _ in climbed(some):
        held[leaf] = (i, root)
    breaks = {digest(r[0], r[3], r[2], r[4], r[1]): "\n" in (r[1] or "") and zlib.crc32(str(r[0]).encode()) % 2 == 0 for r in some}
    assert len(got) == len(some) and any(breaks.values())
    assert all((g.doc_id, g.root) == held[g.leaf] and g.verified == (not breaks[g.leaf]) == (g.folded_root == g.root) for g in got)


def test_small_manifests(spark, empty, rows):
    from plansheet.llm.manifest import manifest

    assert manifest(empty).count() == 0
    one = manifest(spark.createDataFrame(rows[:1], SCHEMA)).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof == []
    two = manifest(spark.createDataFrame(rows[:2], SCHEMA)).collect()  # two sources of a leaf each
    assert all(r.leaf == r.subroot != r.root and len(r.proof) == 1 for r in two)


# lines


def keys_of(text, shortest=20):
    return [k if len(k := re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))) >= shortest else None for line in (text or "").split("\n")]


def without(rows, least=3):
    holders = {}
    for i, t, *_ in rows:
        for k in keys_of(t):
            holders.setdefault(k, set()).add(age(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [line for line, k in zip(lines, keys_of(t)) if not (k and len(holders[k]) >= least and age(i) < max(holders[k]))]
        out.append((age(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def cleaned(index, docs, **how):
    from plansheet.llm.lines import deduplicate

    return sorted((age(r.doc_id), r._n_lines, r._n_dropped, r.text or "" if r._kept is None else r._kept) for r in deduplicate(index, docs, **how).collect())


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])  # filters sent to all tasks, or not
def test_lines_go(docs, rows, most_bytes):
    from plansheet.llm.lines import build_index

    want = without(rows)
    assert sum(w[2] for w in want) > 40
    assert cleaned(build_index(docs), docs, most_bytes=most_bytes) == want


def test_lines_come_back(spark, docs, rows):
    """An index after inserts and deletions says the same as one built from what is left."""
    from plansheet.llm.lines import build_index, counted, delete, insert

    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    state = lambda x: [sorted(map(str, df.collect())) for df in (x.references, x.counts)]
    one, two, three = rows[:20], rows[20:45], rows[45:]
    index = insert(insert(build_index(frame(one)), frame(two)), frame(three))
    whole = build_index(docs)
    assert state(index) == state(whole) and cleaned(index, docs) == without(rows)
    assert state(insert(index, frame(two))) == state(whole)  # documents known already
    gone = {r[0] for r in two} | {None, 4}
    left = [r for r in rows if r[0] not in gone]
    index = delete(index, spark.createDataFrame([(i,) for i in gone] + [(777,)], "doc_id bigint"))
    assert state(index) == state(build_index(frame(left)))
    assert cleaned(index, frame(left)) == without(left)
    assert state(index)[1] == sorted(map(str, counted(index.references).collect()))
    filled = lambda x: sum(np.count_nonzero(np.frombuffer(r.slots, "<u2")) + len(r.stash) // 8 for r in x.filters.rows.collect())
    assert filled(index) == index.counts.where(f"n >= {index.least}").count() < filled(whole)
    index = insert(index, frame([r for r in rows if r[0] in gone]))
    assert state(index) == state(whole) and cleaned(index, docs) == without(rows)


def test_nothing_to_drop(empty):
    from plansheet.llm.lines import build_index, clean

    assert cleaned(build_index(empty), empty) == [] and clean(empty).columns == empty.columns


def test_clean_keeps_other_columns(docs, rows):
    from plansheet.llm.lines import clean

    got = clean(docs)
    assert got.columns == docs.columns
    assert sorted((age(r.doc_id), r.text or "") for r in got.collect()) == sorted((w[0], w[3]) for w in without(rows))


def test_cuckoo_filters_hold_and_forget():
    from plansheet.llm.lines import Cuckoo, Lookup, places

    r = np.random.default_rng(4)
    keys = r.integers(-(1 << 63), (1 << 63) - 1, (4 * 64 * 2, 2))  # two shards of 64 buckets, all but full
    keys = np.concatenate([keys, keys[:3]])  # and keys that meet in every place
    shard, mark, first, second = places(keys, 2, 64)
    own = [Cuckoo(64), Cuckoo(64)]
    for s, *at in zip(shard, mark.tolist(), first.tolist(), second.tolist()):
        own[s].insert(*at)
    assert any(c.stash for c in own)
    rows = lambda: [dict(zip(("shard", "slots", "stash"), (k, *c.written()))) for k, c in enumerate(own)]
    size = SimpleNamespace(shards=2, buckets=64)
    assert Lookup(size, rows()).maybe(keys).all()
    other = r.integers(-(1 << 63), (1 << 63) - 1, (20_000, 2))
    assert Lookup(size, rows()).maybe(other).mean() < 0.002
    for s, *at in list(zip(shard, mark.tolist(), first.tolist(), second.tolist()))[: len(keys) - 40]:
        own[s].delete(*at)
    assert Lookup(size, rows()).maybe(keys[-40:]).all()
    left = sum(np.count_nonzero(np.array(c.slots)) + len(c.stash) for c in own)
    assert left == 40
    again = Cuckoo(64, *own[0].written())
    assert again.written() == own[0].written()
