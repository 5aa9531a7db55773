"""Training-data operators against brute force on a small awkward table, and on
the driver's smallest documents."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile.llm import exact_dedup, langid, lm_score, mixing, packing, pii, quality, sharding, simhash, token_counts
from turnstile.llm.components import components
from turnstile.llm.vocab import load
from turnstile.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997} other{i}" for i in range(30_000))
TEXTS = ["", None, " ", "\t\n", "a b  c", "a b\tc", " a b c", "one two three four five six seven eight nine ten eleven",
         "one two three four five six seven eight nine ten eleven", LONG, "é ß 漢字 🙂 <|endoftext|> x",
         "mail me.x@site.org or +1 (668) 555-1911, card 4111 1111 1111 1111, host 10.0.0.255", "x" * 5000,
         "la la la la la la la la la la la la", "12345", "The the THE"] + ["hot copy of one text with some words in it"] * 20
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, keep_id string, slot string, score string, "
          "spans string, start string, id string, rid string, fp string, block string, size string")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i if i != 5 else None, t, ["en", None, "fr"][i % 3], ["s1", None][i % 7 == 0], 0, *["clash"] * 10) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:2], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


# exact dedup -----------------------------------------------------------------

@pytest.mark.parametrize("how", [{}, {"window_bytes": 1, "owner_bytes": 2000, "bucket_keys": 2}, {"key_bits": 3, "bucket_keys": 1, "window_bytes": 1},
                                 {"window_bytes": 1, "hot_claims": 2, "owner_bytes": 500, "task_bits": 1}])
def test_exact_dedup(awkward, small, how):
    for df in (awkward, small.select("doc_id", "text")):
        groups = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            groups[norm(r.text)].append(r.doc_id)
        least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
        got = exact_dedup.ExactDedup(df, **how).assign().collect()
        assert Counter((r.doc_id, by_sha[r.text_sha256]) for r in got) == Counter((i, t) for t, ids in groups.items() for i in ids)
        for r in got:
            t = by_sha[r.text_sha256]
            assert (r.keep_id, r.group_size) == (least[t], len(groups[t]))
        assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_whole_rows(awkward):
    kept = exact_dedup.ExactDedup(awkward, carry=True).kept()
    assert kept.columns == awkward.columns
    assert kept.count() == len({norm(r.text) for r in awkward.select("text").collect()})
    assert {r.keep_id for r in kept.collect()} == {"clash"}


def test_directory_doubles_and_chains():
    index = exact_dedup.Directory(0, capacity=2, key_bits=8)
    for key in range(256):
        index.chain(key).append(key)
    assert index.depth == 7
    assert sorted(k for _, _, e in index.buckets() for k in e) == list(range(256))
    assert all(len(e) <= 2 for _, _, e in index.buckets())
    assert all(k >> (8 - d) == prefix for prefix, d, e in index.buckets() for k in e)
    chained = exact_dedup.Directory(0, capacity=1, key_bits=2)
    for i in range(10):
        chained.chain(3).append(i)
    assert chained.chain(3) == list(range(10))


# token counts, packing -------------------------------------------------------

def test_token_counts(awkward, small):
    library = load(token_counts.VOCAB)
    for df in (awkward, small):
        got = Counter(map(tuple, token_counts.token_counts(df).collect()))
        want = Counter()
        for r in df.collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want[(r.doc_id, len((r.text or "").encode()), n, n > 1024)] += 1
        assert got == want


def test_pretokens_match_the_library_on_odd_texts():
    rng = np.random.default_rng(3)
    parts = ["a", "Bc", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "²", "٣", "漢", " ", "é", "<|endoftext|>", "<|startoftext|>", "Σ", "İ",
             "\x1c", "\x85", "!", "_", "🙂", "​", "\r\n", "\x00", "가"]
    count, ids = token_counts.Counter(), packing.PieceIds(packing.VOCAB)
    one, two = load(token_counts.VOCAB), load(packing.VOCAB)
    texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(800)]
    assert count.counts(texts) == [len(one.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [x.tolist() for x in ids.ids(texts)] == [two.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_tokens_are_proven():
    pieces = token_counts.PieceCounts(token_counts.VOCAB)
    library = load(token_counts.VOCAB)
    some = [p for p, n in pieces.items() if n == 1][::97]
    assert len(pieces) > 40_000 and all(len(library.encode(p, add_special_tokens=False).ids) == 1 for p in some)


def test_packing(awkward, small):
    library = load(packing.VOCAB)
    for df in (awkward.where("doc_id is not null").dropDuplicates(["doc_id"]), small):
        ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in df.collect()}
        docs, windows = defaultdict(list), defaultdict(list)
        for r in packing.pack(df, block_tokens=50_000).collect():
            part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
            docs[r.doc_id].append((r.start, r.length))
            windows[r.sequence_id].append((r.offset, r.length))
        assert sorted(windows) == list(range(len(windows)))
        for pieces, total in [(p, len(ids[d])) for d, p in docs.items()] + [(p, sum(n for _, n in p)) for p in windows.values()]:
            at = 0
            for start, n in sorted(pieces):
                assert start == at and n > 0
                at += n
            assert at == total
        assert len(docs) == len(ids)
        # every window is full: a power of two, at most the longest tier
        assert all((s := sum(n for _, n in p)) & (s - 1) == 0 and s <= 4096 for p in windows.values())


# quality ---------------------------------------------------------------------

def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_base_counts(awkward, small):
    for df in (awkward, small):
        want = Counter((r.doc_id, *base(r.text)) for r in df.collect())
        got = quality.quality(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_rejects_planted_outliers(spark):
    rng = np.random.default_rng(5)
    plain = [" ".join("w" * int(n) for n in rng.integers(2, 9, 120)) for _ in range(400)]
    junk = [" ".join("abc" + "***" for _ in range(3)) + " " + " ".join(f"x{rng.integers(1e9)}$$%%" for _ in range(90)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(plain + junk)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    # a plain text may fail the base rule on repeated words; the estimate rejects none
    assert all(got[i].kept != got[i].base_failed for i in range(400)) and sum(got[i].kept for i in range(400)) > 390
    assert not any(got[i].kept for i in range(400, 440))


def words_of(rng, n=120):
    return " ".join("".join(rng.choice(list("aeioustrn"), k)) for k in rng.integers(2, 9, n))


JUNK = " ".join(f"x{i}$$%%" for i in range(60))
LABELLED = "doc_id long, text string, lang string, source string"


def test_quality_rejects_copies_that_hold_a_third(spark):
    rng, clean, copies = np.random.default_rng(6), 300, 150
    df = spark.createDataFrame([(i, words_of(rng) if i < clean else JUNK, "en", "a") for i in range(clean + copies)], LABELLED)
    got = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    assert all(got[i] for i in range(clean)) and not any(got[i] for i in range(clean, clean + copies))


def test_quality_judges_rows_of_small_groups(spark):
    rng = np.random.default_rng(7)
    # under MIN_ROWS in all, then a leftover of a large language and one of a small language
    few = [(i, words_of(rng), "en", "a") for i in range(30)] + [(30, JUNK, "en", "a")]
    many = [(i, words_of(rng), "en", "a") for i in range(100)] + [(100, words_of(rng), "en", "b"), (101, JUNK, "en", "b"),
                                                                 (102, words_of(rng), None, "a"), (103, JUNK, None, "a")]
    for rows, junk in ((few, {30}), (many, {101, 103}), (few[:1], set())):
        got = quality.quality(spark.createDataFrame(rows, LABELLED)).collect()
        assert {r.doc_id for r in got if not r.kept} == junk and all(r.grp and r.distance is not None for r in got)


# sharding --------------------------------------------------------------------

def test_sharding(awkward, small):
    for df in (awkward, small.repartition(7)):
        rows = sharding.shard(df).collect()
        want = Counter((r.doc_id, 8 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[k]) for k in range(24)]
        assert max(counts) - min(counts) <= 1


def test_communication_matrix_has_its_margins_and_law(spark):
    parts = spark.createDataFrame([(i, n) for i, n in enumerate([40, 3, 0, 17, 29, 11, 60])], "part int, n long").where("n > 0")
    sizes, firsts = [54, 53, 53], []
    for seed in range(12):
        got = {r.part: r.counts for r in sharding.communication_matrix(parts, Workspace(spark, "t"), sizes, seed).collect()}
        assert {k: sum(v) for k, v in got.items()} == {0: 40, 1: 3, 3: 17, 4: 29, 5: 11, 6: 60}
        assert np.array(list(got.values())).sum(0).tolist() == sizes
        firsts.append(got[6][0])
    # mean 60 * 54 / 160 = 20.25, standard deviation 2.9
    assert abs(np.mean(firsts) - 20.25) < 4 * 2.9 / math.sqrt(12) and len(set(firsts)) > 3


# personal data ---------------------------------------------------------------

def luhn(digits):
    return sum(n - 9 if n > 9 else n for n in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m.group())]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(found)]


def test_pii_base(spark, awkward, small):
    odd = ["@a.b@c.d@e.f a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "é+12 345 678 901é 🙂 a@b.cc", "0001.2.3.4 1.02.3.0000255 99999999999.1.1.1",
           "4111-1111-1111-1111 4111 1111 1111 1112", "+1 (2) 3.4-5 6 7 8 9 0 1 2 3 4 5 6 +", "a@b.c" * 300, "9" * 3000, "a" * 3000, "x@" + "a." * 4000 + "b"]
    extra = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for df in (awkward, small, extra):
        want = Counter()
        for r in df.collect():
            spans = base_spans(r.text)
            want[(r.doc_id, *(sum(s.startswith(k[0] + ":") for s in spans) for k in BASE), hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
        got = pii.pii_report(df).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_pii_context_and_checksums(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 now", "IBAN GB83 WEST 1234 5698 7654 32 now", "ssn 123-45-6789.", "order 123-45-6789.", "see a@b.cc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "id:4:15", 3: "", 4: "email:4:10"}
    masked = {r.doc_id: r.redacted for r in pii.redact(df).collect()}
    assert masked[0] == "IBAN <iban> now" and masked[4] == "see <email>" and masked[3] == texts[3]


def test_pii_iban_ends_and_context_beyond_neighbours(spark):
    cases = [("IBAN ", "GB82WEST12345698765432", " BIC NWBKGB2L"), ("", "DE89 3704 0044 0532 0130 00", " BIC COBADEFFXXX"),
             ("", "DE89 3704 0044 0532 0130 00", " On Monday"), ("", "DE89 3704 0044 0532 0130 00", " I will"),
             ("", "DE89370400440532013000", " 2 times"), ("", "NO9386011117947", "")]
    texts = ["".join(c) for c in cases] + [
        "DE89370400440532013000 GB82WEST12345698765432", "XDE89370400440532013000 DE89370400440532013000x",
        "ssn 123-45-6789, 987-65-4321", "987-65-4321, 123-45-6789 (ssn)", "AB12 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ",".join(s for s in r.spans.split(",") if s[:2] in ("ib", "id")) for r in pii.pii_report(df).collect()}
    want = [f"iban:{len(a)}:{len(a) + len(b)}" for a, b, _ in cases] + [
        "iban:0:22,iban:23:45", "", "id:4:15,id:17:28", "id:0:11,id:13:24", ""]
    assert got == dict(enumerate(want))


# mixing ----------------------------------------------------------------------

def water(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    stopped, wanted = set(), share * sum(sizes.values())
    while True:
        rest = wanted - sum(cap * sizes[s] for s in stopped)
        free = sum(w[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and rest * w[s] / free > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in stopped else rest * w[s] / free for s in names}
        stopped |= over


def test_mixing(awkward, small):
    for df in (awkward, small):
        sizes, source = Counter(), {}
        for r in df.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        target = water(sizes)
        rows = mixing.Mix(df.withColumn("doc_id", F.col("doc_id"))).report().collect()
        again = mixing.Mix(df.repartition(5)).report().collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
        assert len(rows) == df.count()
        taken = Counter()
        by_size = {(v, round(target[k], 6)): k for k, v in sizes.items()}
        for r in rows:
            k = by_size[(r.source_size, round(r.target, 6))]
            assert 0 <= r.taken <= 2 * r["size"]
            taken[k] += r.taken
        for k in sizes:
            assert abs(taken[k] - target[k]) <= 0.5


def test_mixing_meets_the_targets_of_small_sources(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("w" * int(rng.integers(1, 12))), f"s{i % 97:02d}") for i in range(300)]
    rows += [(300 + i, " ".join(["v"] * int(n)), f"t{i}") for i, n in enumerate((1, 31, 32, 33, 64, 65, 1000))]
    sizes, source = Counter(), {}
    for i, text, name in rows:
        sizes[name] += len(text.split())
        source[i] = name
    target, taken = water(sizes), Counter()
    for r in mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).report().collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[k] - target[k]) <= 0.5 for k in sizes)


def test_mixing_in_many_buckets_does_not_follow_the_partitions(awkward, small):
    # sizes over the bucket, and more equal rows than a bucket has
    for df, n in ((small, 20), (awkward.unionByName(awkward.where("doc_id = 20")).unionByName(awkward.where("doc_id = 20")), 1)):
        one, two = (Counter(map(tuple, mixing.Mix(df.repartition(k), bucket_rows=n).report().collect())) for k in (3, 7))
        assert one == two and one.total() == df.count()


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 7, 16, 50, 1000):
        df = spark.range(n).select(F.col("id").alias("k"), F.lit(n).cast("long").alias("n"), F.lit(9).alias("key"))
        got = sorted(r.out for r in mixing.permutation(df, "k", "n", ["key"], "out").collect())
        assert got == list(range(n))


def test_mixed_rows_hold_the_words_taken(small):
    mix = mixing.Mix(small, carry=True)
    out = mix.mixed_rows("n_chars")
    assert out.columns == small.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == Counter({r.doc_id: r.taken for r in mix.report().collect() if r.taken})


# language --------------------------------------------------------------------

def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], 4)
    x, y = rng.integers(0, 256, (5, 9)), np.array([0, 1, 2, 1, 0])
    _, grad = net.loss(x, y)
    for name, w in net.w.items():
        at = (2, x[2, 3]) if name[0] == "x" else tuple(rng.integers(0, n) for n in w.shape)
        held = w[at]
        w[at] = held + 1e-5
        up = net.loss(x, y)[0]
        w[at] = held - 1e-5
        down = net.loss(x, y)[0]
        w[at] = held
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-7


def slow_probabilities(net, raw):
    """Mean label probabilities, one byte at a time in double precision."""
    total, n = np.zeros(len(net.labels)), net.hidden
    for at in range(0, len(raw), langid.WINDOW):
        part = raw[at:at + langid.WINDOW]
        states = {}
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h, states[d] = np.zeros(n), {}
            for t in order:
                g, u = net.w["x" + d][:, part[t]], net.w["u" + d] @ h
                z, r = (1 / (1 + np.exp(-(g[k * n:(k + 1) * n] + u[k * n:(k + 1) * n]))) for k in (0, 1))
                c = np.tanh(g[2 * n:] + r * u[2 * n:])
                h = states[d][t] = (1 - z) * c + z * h
        for t in range(len(part)):
            e = np.exp(net.w["of"] @ states["f"][t] + net.w["ob"] @ states["b"][t] + net.w["o"][:, 0])
            total += e / e.sum()
    return total / len(raw)


def test_labelling_agrees_with_a_slow_pass(small, awkward):
    net = langid.fit(small)
    some = [r.text.encode() for r in small.orderBy("doc_id").limit(12).collect()] + [t.encode() for t in TEXTS[4:9] + TEXTS[10:15]]
    fast = net.probabilities(some)
    for raw, row in zip(some, fast):
        assert np.allclose(row, slow_probabilities(net, raw[:]), atol=2e-4)
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(small).collect()}
    for r in small.orderBy("doc_id").limit(12).collect():
        p = slow_probabilities(net, r.text.encode())
        assert told[r.doc_id][0] == net.labels[int(p.argmax())] and abs(told[r.doc_id][1] - p.max()) < 1e-3


def test_training_rows_are_told_by_their_text(small):
    # only the fold looks at ids: other ids of the same fold train the same network
    moved = small.withColumn("doc_id", F.col("doc_id") + 1).where(~langid.held_out())
    same = small.where(~F.expr("crc32(cast(cast(doc_id + 1 AS string) AS binary)) % 5 = 0"))
    one, two = langid.fit(moved), langid.fit(same.withColumn("doc_id", F.col("doc_id") + 1))
    assert all((one.w[k] == two.w[k]).all() for k in one.w)


def test_language_held_out_accuracy(small):
    rows = langid.identify(small).join(small.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(awkward):
    rows = langid.identify(awkward, epochs=1).collect()
    assert len(rows) == awkward.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {0, 1, 2, 3, 14} <= und and 9 not in und


# near copies -----------------------------------------------------------------

def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("how", [{}, {"tile_rows": 8, "tile_max": 4}])
def test_simhash(awkward, small, how):
    for df in (awkward, small):
        rows = [(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()]
        fps = np.array([f for _, f in rows], np.uint64)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
        inf = 1 << 60
        label = np.array([inf if i is None else i for i, _ in rows])
        while True:
            new = np.array([label[near[k]].min() for k in range(len(rows))])
            if (new == label).all():
                break
            label = new
        want = Counter((i, f"{f:016x}", None if c == inf else int(c)) for (i, f), c in zip(rows, label))
        assert Counter(map(tuple, simhash.NearDedup(df, **how).assign().collect())) == want


def test_simhash_keeps_one_row_a_group(awkward):
    near = simhash.NearDedup(awkward, carry=True)
    kept = near.kept()
    assert kept.columns == awkward.columns
    assert kept.count() == near.groups.select("least").distinct().count()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.vertex: r.root for r in components(links, Workspace(spark, "t")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}


# language model --------------------------------------------------------------

def segmentations(text, pieces):
    if not text:
        return [[]]
    out = [[("bytes", text[0])] + rest for rest in segmentations(text[1:], pieces)]
    for k in range(1, len(text) + 1):
        if text[:k] in pieces.ids:
            out += [[text[:k]] + rest for rest in segmentations(text[k:], pieces)]
    return out


def test_lattice_sums_all_segmentations():
    pieces = lm_score.pieces_of(lm_score.VOCAB)
    lattice = lm_score.Lattice(pieces, pieces.start)
    for word in ("the", "zé", "aab", "x漢"):
        paths = segmentations("▁" + word, pieces)
        p = [math.prod(pieces.start[pieces.ids[s]] if isinstance(s, str) else
                       math.prod(pieces.start[pieces.bytes[b]] for b in s[1].encode()) for s in path) for path in paths]
        got = lattice.word(word.encode())
        assert abs(got - math.log(sum(p))) < 1e-9
        assert abs(lattice.words([word.encode()])[0] - got) < 1e-9
        used = np.zeros(len(pieces.start))
        for path, share in zip(paths, p):
            for s in path:
                for i in [pieces.ids[s]] if isinstance(s, str) else [pieces.bytes[b] for b in s[1].encode()]:
                    used[i] += 2 * share / sum(p)
        assert np.abs(lattice.expectations([word.encode()], [2]) - used).max() < 1e-9


def test_lm_scores(awkward, small):
    split = lambda t: (t or "").encode().lower().split()
    for df in (awkward, small):
        docs = [(r.doc_id, r.text) for r in df.collect()]
        out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
        count, ends = Counter(), 0
        for i, t in docs:
            if not out(i):
                count.update(split(t))
                ends += 1
        total, distinct = sum(count.values()) + ends, len(count) + (ends > 0)
        rows = lm_score.lm_scores(df, block_bytes=50_000, bucket_bytes=100_000).collect()
        want = Counter()
        for i, t in docs:
            words = split(t)
            score = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((ends + 1) / (total + distinct + 1))
            want[(i, out(i), len(words) + 1, sum(count[w] > 0 for w in words) + (ends > 0), total, round(score, 4))] += 1
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
        assert all(r.score < 0 for r in rows)


# empty tables ----------------------------------------------------------------

def test_empty_tables(empty):
    assert exact_dedup.ExactDedup(empty).assign().count() == 0
    assert exact_dedup.ExactDedup(empty, carry=True).kept().columns == empty.columns
    assert token_counts.token_counts(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert pii.pii_report(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert mixing.Mix(empty).report().count() == 0
    assert mixing.Mix(empty, carry=True).mixed_rows("n_chars").count() == 0
    assert langid.identify(empty).count() == 0
    assert simhash.NearDedup(empty).assign().count() == 0
    assert simhash.NearDedup(empty, carry=True).kept().count() == 0
    assert lm_score.lm_scores(empty).count() == 0
