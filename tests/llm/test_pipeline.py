"""The pipeline's stages, each against what it must keep of its own input."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from conftest import SF_SMALL
from test_operators import SCHEMA, TEXTS, WORD, norm, water
from turnstile.llm import langid, packing, simhash
from turnstile.llm.vocab import load


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i if i != 5 else None, t, ["en", None, "fr"][i % 3], "s1", 0, *["clash"] * 10) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:2], SCHEMA)


@pytest.mark.parametrize("table", ["small", "awkward", "empty"])
def test_stages(spark, awkward, table, tmp_path):
    docs = {"small": spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "awkward": awkward, "empty": awkward.limit(0)}[table]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(path := str(tmp_path / str(k)))
        out = spark.read.parquet(path)
        before = docs.collect()
        after = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        CHECKS[name](docs, before, after)
        docs = out


def rows_of(rows):
    return Counter(tuple(r) for r in rows)


def check_language(docs, before, after):
    """Rows with a letter, but for longer texts whose best language holds too few positions."""
    net = langid.fit(docs)
    low = langid.bar(docs, net) if net else 0.0
    assert low <= langid.MAJORITY

    def stays(text):
        if not text or not langid.has_letter(text):
            return False
        raw = text.encode()
        return net is None or len(raw) < langid.SURE_BYTES or net.probabilities([raw]).max() >= low - 1e-5

    assert rows_of(after) == rows_of(r for r in before if stays(r.text))


def check_exact(docs, before, after):
    """The row of least id of each normalised text (a null id last)."""
    groups = defaultdict(list)
    for r in before:
        groups[norm(r.text)].append((r.doc_id is None, r.doc_id or 0))
    assert Counter((norm(r.text), r.doc_id is None, r.doc_id or 0) for r in after) == Counter((t, *min(ids)) for t, ids in groups.items())
    assert not rows_of(after) - rows_of(before)


def check_near(docs, before, after):
    """The row of least id of each component of fingerprints, all pairs compared."""
    prints = [simhash.fingerprint(r.text) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    array = np.array(prints, np.uint64)
    for i in range(len(before)):
        for j in np.nonzero(np.bitwise_count(array[:i] ^ array[i]) <= simhash.RADIUS)[0].tolist():
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(before):
        key = (r.doc_id is None, r.doc_id or 0)
        least[find(i)] = min(least.get(find(i), key), key)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in after) == Counter(least.values())
    assert not rows_of(after) - rows_of(before)


def check_mixing(docs, before, after):
    """Each source's words meet its target, and a row takes each of its words once a turn at most."""
    sizes, taken, words, most = Counter(), Counter(), Counter(), defaultdict(Counter)
    for r in before:
        found = WORD.findall(r.text or "")
        sizes[r.source] += len(found)
        most[r.doc_id, r.source].update(found)
    for r in after:
        found = WORD.findall(r.text)
        taken[r.source] += len(found)
        words[r.doc_id, r.source, r.text] += 1
        assert found and r.n_chars == len(r.text)
        assert not Counter(found) - most[r.doc_id, r.source]
    target = water(sizes)
    assert all(abs(taken[k] - target[k]) <= 0.5 for k in sizes)


def check_packing(docs, before, after):
    """The pieces put every row's ids together again, and fill their sequences without a gap."""
    library = load(packing.VOCAB)
    ids = Counter()
    for r in before:
        ids[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, windows = Counter(), defaultdict(list)
    for r in after:
        got[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert got == ids and sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    single = {k for k, n in Counter(r.doc_id for r in before).items() if n == 1}
    text = {r.doc_id: r.text for r in before if r.doc_id in single}
    for r in after:
        if r.doc_id in text:
            whole = np.array(library.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
            assert zlib.crc32(whole[r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole)


CHECKS = {"language_id": check_language, "exact_dedup": check_exact, "simhash_near_dedup": check_near, "mixing": check_mixing,
          "packing": check_packing}


def test_language_stage_lets_go_what_is_in_no_language(spark):
    rng = np.random.default_rng(3)
    word = {"aa": "lorem ipsum dolor amet ", "bb": "zwischen schluss wird xqq "}
    rows = [(i, word[k] * int(rng.integers(3, 20)), k, "s", 0) for i in range(200) for k in [["aa", "bb"][i % 2]]]
    half = word["aa"] * 10 + word["bb"] * 10
    docs = spark.createDataFrame(rows + [(500, half[:-1], None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    net = langid.fit(docs)
    share = net.probabilities([half[:-1].encode()]).max()
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF_SMALL).collect()}
    assert kept >= set(range(200)) and (500 in kept) == (share >= langid.bar(docs, net))


def test_language_stage_without_languages(spark):
    texts = ["clean words", "\u6f22\u5b57", "12 34", "\u00bd \u00b2 \u2460", "", None]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF_SMALL).collect()} == {0, 1}


def test_signs_are_no_letters(spark):
    rows = [(i, f"plain words {i}", "en", "s", 0) for i in range(20)] + [(20, "\u00bd \u00b2 \u2460", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF_SMALL).collect()} == set(range(20))


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)
    found = rows.collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in found} <= docs and len({r.doc_id for r in found}) > 0.7 * len(docs)
    assert sorted({r.sequence_id for r in found}) == list(range(len({r.sequence_id for r in found})))


def test_the_language_bar_comes_from_every_held_out_text(spark):
    """More texts than any sample of them holds, most of them at the bar's place or below."""
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abcdefgh" if i % 2 else "stuvwxyz"), 90)) + ("!" * 30 if i % 7 else ""), "xy"[i % 2], "s", 1)
            for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    net = langid.fit(docs, epochs=1)
    held = [r.text for r in docs.where(langid.held_out()).collect()]
    scores = np.sort(net.probabilities([t.encode() for t in held]).max(1))
    want = min(langid.MAJORITY, scores[int((len(held) - 1) * langid.LOST)])
    assert len(held) > 2 * langid.PER_LANGUAGE and abs(langid.bar(docs, net) - want) < 1e-5
    # long ends count, and copies count once
    more = docs.unionByName(docs.where("doc_id % 3 = 0"))
    assert langid.bar(more, net) == langid.bar(docs, net)
