import hashlib
import random

import numpy as np
import pytest

from tablelens.llm import repeats as R


FIRST = -(10**20)  # rows without an id come before all others


def brute(rows, width=100):
    """(doc, text) -> removed runs, by a dictionary of all windows in order."""
    texts = sorted({(FIRST if i is None else i, (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for doc, raw in texts:
        gone = np.zeros(len(raw) + 2, bool)
        for start in range(len(raw) - width + 1):
            window = raw[start : start + width]
            if window in seen:
                gone[start + 1 : start + width + 1] = True
            seen.add(window)
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        out[doc, raw] = (raw, [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])])
    return out


def check(table, rows, **options):
    expected = brute(rows, options.get("width", 100))
    got = R.remove_repeats(table, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        raw, spans = expected[FIRST if r.doc_id is None else r.doc_id, (r.text or "").encode()]
        assert [tuple(s) for s in r.spans] == spans, r.doc_id
        left = bytearray(raw)
        for start, length in reversed(spans):
            del left[start : start + length]
        assert bytes(r.kept) == bytes(left) and r.n_bytes == len(raw) and r.n_removed == sum(n for _, n in spans)
    return got


def corpus(seed, count, alphabet="abcdefghij é日", passages=6):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.choice([60, 99, 100, 101, 130, 180, 260, 700])) for _ in range(passages)]
    rows = []
    for i in range(count):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(text(rng.choice([0, 1, 3, 40, 150, 400])))
            passage = rng.choice(shared)
            cut = rng.choice([0, 0, 1, 5, 50])
            passage = passage[cut : len(passage) - rng.choice([0, 0, 2, 30])]
            if rng.random() < 0.3 and passage:
                at = rng.randrange(len(passage))
                passage = passage[:at] + "#" + passage[at + 1 :]
            parts.append(passage)
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(frame, seed):
    rows = corpus(seed, 120)
    got = check(frame(rows, "doc_id long, text string"), rows)
    assert sum(r.n_removed for r in got) > 1000


def test_tiny_alphabets_and_periodic_texts(frame):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(100 + k, ("ab" * 500)[: 90 + k]) for k in range(40)] + [(200, "a" * 99), (201, "a" * 100), (202, "a" * 5000), (203, "a" * 101 + "b")]
    check(frame(rows, "doc_id long, text string"), rows, width=24, gram=8)
    check(frame(rows, "doc_id long, text string"), rows)


def test_hot_anchors_as_windows_give_the_same(frame, monkeypatch):
    rows = corpus(9, 150, passages=2)
    monkeypatch.setattr(R, "HOT_LEAST", 3)
    table = frame(rows, "doc_id long, text string")
    whole = table.selectExpr("doc_id", "0L AS tie", "text").coalesce(1)
    cells = whole.mapInArrow(R._count_cells(100, 24, 1 << 14), "cell long, n long")
    assert cells.where("n > 3").count() > 2
    check(table, rows)


def test_small_chunks_and_rounds_give_the_same(frame, monkeypatch):
    rows = corpus(11, 80)
    monkeypatch.setattr(R, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(R, "CHUNK", 5)
    monkeypatch.setattr(R, "SUFFIXES", 40)
    check(frame(rows, "doc_id long, text string"), rows)


def test_null_ids_shared_ids_repeated_rows_and_clashing_names(frame):
    a, b = "x" + "0123456789" * 12, "0123456789" * 14 + "tail"
    rows = [(None, a), (None, None), (3, b), (3, b), (4, ""), (-5, b + b), (2**62, a), (9, None)]
    table = frame([(*r, 1, 2, b"k") for r in rows], "doc_id long, text string, doc int, repeats int, kept binary")
    got = check(table, rows)
    assert table.columns[:4] + ["n_bytes", "n_removed", "spans", "kept"] == R.remove_repeats(table).columns
    assert {(r.doc, r.repeats) for r in got} == {(1, 2)}
    c = "".join(map(str, range(100, 150)))
    shared = frame([(1, c), (1, c + "!"), (1, "?" + c)], "doc_id long, text string")
    left = sorted(r.n_removed for r in R.remove_repeats(shared).collect())
    assert left == [0, 150, 150]  # one of them is the first, the others repeat it
    assert R.remove_repeats(table.limit(0)).count() == 0
    assert R.remove_repeats(table, with_text=False).columns == ["doc_id", "doc", "repeats", "n_bytes", "n_removed", "spans", "kept"]


def test_texts_longer_than_a_slice(frame, monkeypatch):
    rng = random.Random(4)
    big = "".join(rng.choice("abcdefgh") for _ in range(40_000))
    rows = [(1, big), (2, "zz" + big[5000:30_000] + "yy"), (3, big[:20_000] + "#" + big[20_000:]), (4, "q" * 30_000)]
    monkeypatch.setattr(R, "SLICE", 4096)
    R._tables.cache_clear()
    monkeypatch.setattr(R, "in_pieces", lambda column: __import__("tablelens.llm.common", fromlist=["x"]).in_pieces(column, 3000))
    check(frame(rows, "doc_id long, text string"), rows)


def test_merges_sort_and_mend_collisions(monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 6000).astype(np.uint8)
    at = rng.permutation(5000)[:3000]
    sizes = np.array([1, 7, 500, 2, 1490, 1000])
    for weak in (False, True):
        prefixes = R.Prefixes(raw)
        if weak:  # hashes that often agree although the bytes differ
            good = prefixes.of
            prefixes.of = lambda at, length: good(at, length) & np.uint64(3)
        order, equal = R.sort_suffixes(raw, prefixes, at, sizes, 40)
        start = 0
        for size in sizes:
            texts = [raw[at[k] : at[k] + 40].tobytes() for k in order[start : start + size]]
            assert sorted(order[start : start + size]) == list(range(start, start + size)) and texts == sorted(texts)
            assert equal[start : start + size].tolist() == [k > 0 and texts[k] == texts[k - 1] for k in range(size)]
            start += size


def compared(monkeypatch):
    """The numbers of pairs that later calls of common_extension compare."""
    pairs, plain = [], R.common_extension
    monkeypatch.setattr(R, "common_extension", lambda prefixes, one, other, width: pairs.append(len(one)) or plain(prefixes, one, other, width))
    return pairs


@pytest.mark.parametrize("suffixes", [10_000, R.SUFFIXES])
def test_windows_that_no_other_segment_has_are_not_sorted(monkeypatch, suffixes):
    rng = random.Random(6)
    text = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    anchor = text(24)
    contents = [text(40) + anchor + text(75) for _ in range(1500)]
    for k in range(0, 300, 10):  # windows 11 to 25 of one occur in another
        contents[k + 1] = contents[k + 1][:11] + contents[k][11:125] + contents[k + 1][125:]
    order = rng.sample(range(len(contents)), len(contents))
    pairs = compared(monkeypatch)
    monkeypatch.setattr(R, "SUFFIXES", suffixes)
    same = lambda value: np.full(len(contents), value)
    segment, step = R.later_windows(contents, same(9), np.array(order), same(0), same(40), same(40), 100)
    expected, seen = [], {}
    for k in np.argsort(order):
        for start in range(40):
            if seen.setdefault((start, contents[k][start : start + 100]), k) != k:
                expected.append((k, start))
    assert list(zip(segment, step)) == sorted(expected) and len(expected) >= 30 * 15
    assert sum(pairs) < 10_000  # of 60,000 windows about 900 occur twice


def test_equal_suffixes_are_merged_as_one(monkeypatch):
    rng = np.random.default_rng(12)
    raw = rng.integers(97, 123, 4000).astype(np.uint8)
    at, sizes = rng.choice(rng.permutation(3900)[:30], 9000), np.array([1, 4999, 4000])
    pairs = compared(monkeypatch)
    order, equal = R.sort_suffixes(raw, R.Prefixes(raw), at, sizes, 50)
    text = [raw[a : a + 50].tobytes() for a in at]
    starts = np.cumsum(sizes) - sizes
    expected = [k for a, n in zip(starts, sizes) for k in sorted(range(a, a + n), key=lambda k: text[k])]
    assert order.tolist() == expected
    assert equal.tolist() == [k not in starts and text[expected[k]] == text[expected[k - 1]] for k in range(len(at))]
    assert sum(pairs) < 2000


def test_small_blocks_give_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    raw, offsets = rng.integers(97, 101, 3000).astype(np.uint8), np.array([0, 0, 700, 730, 2000, 3000])
    whole, sums = R.segments(raw, offsets, 100, 24), R.Prefixes(raw).sums
    monkeypatch.setattr(R, "BLOCK", 128)
    parts = R.segments(raw, offsets, 100, 24)
    assert (R.Prefixes(raw).sums == sums).all() and all((parts[name] == whole[name]).all() for name in whole)
    assert whole["windows"].sum() == 601 + 1171 + 901


def test_common_extension_equals_counting():
    rng = np.random.default_rng(8)
    raw = rng.integers(97, 99, 500).astype(np.uint8)
    one, other = rng.integers(0, 450, 400), rng.integers(0, 450, 400)
    got = R.common_extension(R.Prefixes(raw), one, other, 50)
    for a, b, n in zip(one, other, got):
        same = raw[a : a + 50] == raw[b : b + 50]
        assert n == (50 if same.all() else same.argmin())


def test_given_documents_equal_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in documents.collect()]
    expected = brute(rows)
    got = R.digest(R.remove_repeats(documents, with_text=False))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    by_id = {r.doc_id: r for r in got.collect()}
    for (doc, raw), (_, spans) in expected.items():
        left = bytearray(raw)
        for start, length in reversed(spans):
            del left[start : start + length]
        r = by_id[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(n for _, n in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(bytes(left)).hexdigest()


def test_buckets_are_even():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 400_000).astype(np.uint8)
    part = R.segments(raw, np.array([0, len(raw)]), 100, 24)
    assert part["windows"].sum() == len(raw) - 99 and part["windows"].max() <= 77
    shares = np.bincount((part["anchor"] >> np.uint64(61)).astype(np.int64), minlength=8) / len(part["anchor"])
    assert abs(shares - 1 / 8).max() < 0.02
