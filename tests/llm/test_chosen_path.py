import random
from itertools import combinations

import pytest

from tablelens.llm import chosen_path as C


def sets(texts, width=5):
    out = {}
    for doc_id, text in texts:
        words = (text or "").lower().split()
        out[doc_id] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    return out


def brute(texts, threshold=0.8):
    shingles = sets(texts)
    root, links = {i: i for i in shingles}, dict.fromkeys(shingles, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(shingles, 2):
        x, y = shingles[a], shingles[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (find(i), links[i]) for i in shingles}


def corpus(seed, base=12, copies=14, hot=0):
    random.seed(seed)
    texts = []
    passage = " ".join(f"p{i}" for i in range(40))
    for group in range(base):
        words = [f"g{group}w{random.randrange(10**6)}" for _ in range(random.choice([3, 6, 60, 200]))]
        for copy in range(random.randrange(1, copies) + (hot if group == 0 else 0)):
            own = list(words)
            for _ in range(random.randrange(0, max(2, len(own) // 40))):
                own[random.randrange(len(own))] = f"e{random.randrange(10**6)}"
            texts.append(" ".join(own) + (" " + passage if random.random() < 0.4 else ""))
    texts += ["", None, "  ", "A b\tC", "a B c", "one"]
    return list(enumerate(texts))


def found(table, **options):
    return {r.doc_id: (r.class_id, r.links) for r in C.similarity_classes(table, **options).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_links_equal_brute_force(frame, seed):
    texts = corpus(seed)
    assert found(frame(texts, "doc_id long, text string")) == brute(texts)


def test_split_buckets_and_blocks_lose_no_link(frame, monkeypatch):
    monkeypatch.setattr(C, "SMALL", 8)
    monkeypatch.setattr(C, "BLOCK", 10)
    texts = corpus(3, hot=60)
    assert found(frame(texts, "doc_id long, text string")) == brute(texts)


@pytest.mark.parametrize("size, copies", [(8, 12), (256, 300)])
def test_no_large_group_of_near_copies_is_lost(frame, monkeypatch, size, copies):
    monkeypatch.setattr(C, "SMALL", size)
    groups = 2400 // copies if size == 256 else 300
    texts = [(g * copies + k, " ".join(f"g{g}w{i}" for i in range(100)) + f" e{k}") for g in range(groups) for k in range(copies)]
    assert found(frame(texts, "doc_id long, text string")) == {i: (i // copies * copies, copies - 1) for i, _ in texts}


def test_equal_buckets_are_split_each_on_its_own(frame, monkeypatch):
    monkeypatch.setattr(C, "SMALL", 8)
    # groups of pairs at about the threshold: few equal buckets, many levels
    texts = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(100)]
        texts += [" ".join(base + [f"e{g}x{k}y{i}" for i in range(10)]) for k in range(12)]
    texts = list(enumerate(texts))
    assert found(frame(texts, "doc_id long, text string")) == brute(texts)


def test_the_sample_filter_passes_unlucky_samples():
    common, a, b = range(22), range(100, 120), range(200, 213)  # an estimate of 0.45 for sets of 1000 and 820 elements
    rows = [(7, node, 2, size, [*common, *own], [7]) for node, size, own in ((1, 1000, a), (2, 820, b))]
    names = ["leaf", "node", "members", "size", "sample", "leaves"]
    batch = C.pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows])
    assert sum(out.num_rows for out in C._sketch_filter(0.8)(iter([batch]))) == 2


def test_recall_formula():
    assert C.runs_needed(0.9) <= C.runs_needed(0.99999) == 5


def test_copies_null_ids_and_clashing_names(frame):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long, 1), (3, long, 1), (3, long, 1), (9, long.replace("w40", "x"), 1), (None, "other text of five words here", 1), (1, None, 1), (2, "", 1)]
    table = frame(rows, "doc_id long, text string, links int")
    got = sorted(((r.doc_id, r.class_id, r.copy_of, r.links) for r in C.similarity_classes(table).collect()), key=repr)
    assert got == sorted([(5, 3, 3, 3), (3, 3, 3, 3), (3, 3, 3, 3), (9, 3, 9, 3), (None, None, None, 0), (1, 1, 1, 0), (2, 2, 1, 0)], key=repr)
    assert C.similarity_classes(table.limit(0)).count() == 0
