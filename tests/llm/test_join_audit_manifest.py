"""Jaccard join, filter audit and manifest against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile.llm import filter_audit, jaccard, manifest, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997} other{i}" for i in range(20_000))
TEXTS = ["", None, " ", "\t\n", "a b  c", "a b\tc", " a b c", "one two three four five six seven eight nine ten eleven",
         "one two three four five six seven eight nine ten eleven", LONG, LONG + " end", "é ß 漢字 🙂 x", "x" * 5000, "x" * 4999 + "y",
         "la la la la la la la la la la la la", "The the THE", "SHOUT $5 & more"] + ["hot copy of one text with some words in it"] * 20
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, sig string, rid string, at string, total string, "
          "mask string, part string, n string, digest string, node string, root string")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i if i != 5 else None, t, ["en", None, "fr", ""][i % 4], ["s1", None, ""][i % 3], [7, None][i % 5 == 0], *["clash"] * 10)
            for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:2] + rows[-3:], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Jaccard join ----------------------------------------------------------------

def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text, k=4):
    words = WORD.findall(lower(text))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def joined(rows):
    """(id, set size, least id reachable) of each row, by comparing all pairs of distinct sets."""
    members = defaultdict(list)
    for i, text in rows:
        members[shingle_set(text)].append(i)
    sets = [s for s in members if s]
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(a & b) >= 85 * len(a | b):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for s in sets:
        groups[find(s)] += members[s]
    least = {s: min((i for i in groups[find(s)] if i is not None), default=None) for s in sets}
    return Counter((i, len(s), least[s] if s else i) for s, ids in members.items() for i in ids)


def near_copies():
    """Texts around the threshold: bases of many lengths with some words changed, and copies of copies."""
    rng = np.random.default_rng(7)
    texts = []
    for length in (1, 3, 4, 5, 9, 10, 14, 20, 33, 60, 61, 150, 400):
        for _ in range(4):
            base = [f"w{k}" for k in rng.integers(0, 5000, length)]
            texts.append(" ".join(base))
            for changes in (1, 1, 2, 3, 5, 8):
                copy = list(base)
                for at in rng.integers(0, length, min(changes, length)):
                    copy[at] = f"n{rng.integers(0, 9)}"
                texts.append(" ".join(copy))
                texts.append(" ".join(copy + ["tail"] * (changes // 2)).upper())
    chain = [f"c{k}" for k in range(100)]
    for k in range(60):  # each step links to the next only
        texts.append(" ".join(chain))
        chain = chain[3:] + [f"d{k}-{j}" for j in range(3)]
    return texts


@pytest.mark.parametrize("how", [{}, {"owner_sigs": 200, "block_sigs": 50}, {"part": 3, "listed": 0}, {"part": 40}])
def test_jaccard_join(spark, awkward, small, how):
    made = spark.createDataFrame(list(enumerate(near_copies())), "doc_id long, text string").repartition(5)
    for df in (made, awkward) if how else (made, awkward, small):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert Counter(map(tuple, jaccard.JaccardJoin(df, **how).assign().collect())) == joined(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    enum = jaccard.PartEnum()
    met = 0
    for size in [*range(7, 40), 80, 200, 1000]:
        for _ in range(30):
            base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            gone = int(rng.integers(0, len(base) * 15 // 100 + 1))
            other = np.unique(np.concatenate([base[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, 3 + size // 20))).astype(np.uint64)]))
            if not jaccard.linked(base, other):
                continue
            of, sigs = enum.signatures([base, other])
            assert len(base) == len(other) == len(np.intersect1d(base, other)) or np.intersect1d(sigs[of == 0], sigs[of == 1]).size
            met += 1
    assert met > 300


def test_jaccard_hot_group(spark):
    """Near copies of one text that don't all link with each other, and strangers of one size."""
    rng = np.random.default_rng(2)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(300):
        copy = list(base)
        copy[int(rng.integers(0, 120))] = f"x{k}"
        copy[int(rng.integers(0, 120))] = f"y{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"s{rng.integers(0, 10**6)}" for _ in range(11)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = joined(list(enumerate(texts)))
    for how in ({"block_sigs": 500}, {"part": 30}):
        assert Counter(map(tuple, jaccard.JaccardJoin(df, **how).assign().collect())) == want


def test_common_counts_every_intersection(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(jaccard, "FEATURES", 7)
    some = [np.unique(rng.integers(0, 60, int(n)).astype(np.uint64)) for n in rng.integers(1, 40, 30)]
    want = [[len(np.intersect1d(x, y)) for y in some[11:]] for x in some[:11]]
    assert jaccard.common(some[:11], some[11:]).tolist() == want


# filter audit ----------------------------------------------------------------

def mask_of(text):
    words, text = WORD.findall(text or ""), text or ""
    return ((len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words))
            + 4 * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text)))


def audited(rows):
    """(id, part, mask) of each row, counted."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    found = Counter()
    for i, text, part in rows:
        first = least.get(text or "")
        found[(i, part or "", mask_of(text) + 16 * (first is not None and (i is None or i > first)))] += 1
    return found


def reported(flags, labels):
    marks = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [marks[i][0] or quality == 1, marks[i][1] or toxic == 1]
    out = set()
    for part in {p for _, p, _ in flags}:
        docs = [(m, *(marks[i] if i is not None else (False, False)), n) for (i, p, m), n in flags.items() if p == part]
        shapley = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                count = lambda f: sum(d[3] for d in docs if f(d))
                removed = count(lambda d: d[0] & bit and not d[0] & before)
                shapley[letter] += removed
                lines.append((part, "".join(order), step, count(lambda d: not d[0] & (bit | before)), removed,
                              count(lambda d: d[0] & bit and d[0] & before), count(lambda d: d[0] == bit),
                              count(lambda d: d[0] & bit and not d[0] & before and d[1]),
                              count(lambda d: d[0] & bit and not d[0] & before and d[2]), letter))
                before |= bit
        out |= {(*line[:-1], shapley[line[-1]]) for line in lines}
    return out


@pytest.mark.parametrize("how", [{}, {"window_bytes": 1, "range_bytes": 3000, "hot_claims": 4}, {"window_bytes": 1, "hot_claims": 1}])
def test_filter_audit(spark, awkward, small, how):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (4, None, 1), (9, 1, None), (17, 1, 1), (None, 1, 1)] * 2,
                                   "doc_id long, quality int, toxic int")
    for df in (awkward, small):
        rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        audit = filter_audit.FilterAudit(df, **how)
        want = audited(rows)
        assert {tuple(r)[:3]: r.n for r in audit.flags().select("doc_id", "part", "mask", "n").collect()} == want
        if df is awkward:
            assert set(map(tuple, audit.report(labels).collect())) == reported(want, [tuple(r) for r in labels.collect()])


def test_trie_holds_every_text():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice([97, 98, 0xC3], int(rng.integers(0, 9)))) for _ in range(500)] + [b"", b"a" * 3000, b"a" * 2999 + b"b"]
    trie, want = filter_audit.Trie(), {}
    for k, text in enumerate(texts):
        node = trie.terminal(text)
        node[2] = k if node[2] is None else min(node[2], k)
        want[text] = min(want.get(text, k), k)
    assert dict(trie.items()) == want
    todo = [trie.root]
    while todo:  # compressed: an inner node without a text has two children at least
        node = todo.pop()
        assert node is trie.root or node[2] is not None or len(node[1]) > 1
        todo += node[1].values()


# manifest --------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    """(root, siblings before and after each node level by level) of a list of digests."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // fanout * fanout
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1:run + fanout])))
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


def proved(rows, fanout):
    groups = defaultdict(list)
    for i, source, lang, n, text in rows:
        more = n + 1 if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        leaf, claim = (sha("".join(map(enc, (i, source, lang, k, text)))) for k in (n, more))
        groups[lang].append((i is not None, i or 0, leaf, claim, i))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(groups[k])], fanout) for k in keys}
    root, upper = tree([trees[k][0] for k in keys], fanout)
    out = Counter()
    for place, k in enumerate(keys):
        for (_, _, leaf, claim, i), path in zip(sorted(groups[k]), trees[k][1]):
            node = claim
            for before, after in path + upper[place]:
                node = sha(before + node + after)
            siblings = "".join(b + a for b, a in path + upper[place])
            out[(i, leaf, trees[k][0], root, sha(siblings), node, node == root)] += 1
    return out


@pytest.mark.parametrize("fanout,levels", [(2, 3), (2, 1), (3, 2)])
def test_manifest(awkward, fanout, levels):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    found = manifest.Manifest(awkward, columns, claimed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))},
                              fanout=fanout, levels=levels)
    got = Counter(tuple(r) for r in found.proofs().select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    want = proved([tuple(r) for r in awkward.select(*columns).collect()], fanout)
    assert got == want
    assert {k[3] for k in got} == {found.root()}


def test_manifest_of_one_row_and_of_one_group(spark):
    one = spark.createDataFrame([(3, "x", None, 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    row = manifest.Manifest(one, one.columns).proofs().first()
    assert (row.leaf, row.subroot, row.folded_root, row.verified) == (row.root,) * 3 + (True,) and row.proof_sha256 == sha("")
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                   F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text")).repartition(6)
    got = Counter(tuple(r)[:6] + (r.verified,) for r in manifest.Manifest(many, many.columns, claimed={"n_chars": F.when(
        F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 2).otherwise(1)}).proofs().collect())
    assert got == proved([tuple(r) for r in many.collect()], 2)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.JaccardJoin(empty).assign().count() == 0
    assert filter_audit.FilterAudit(empty).report(labels).count() == 0
    assert manifest.Manifest(empty, ("doc_id", "text")).proofs().count() == 0
    assert set(queries.QUERIES) >= {"op11_jaccard_join", "op12_filter_audit", "op13_manifest"}
