import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablelens.llm import spelling as S

UPPER = str.maketrans(S._UPPER, S._LOWER)


def neighbours(word, letters):
    for i in range(len(word) + 1):
        for x in letters:
            yield word[:i] + x + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            for x in letters:
                yield word[:i] + x + word[i + 1 :]


def brute_forms(counts, dominance=10):
    letters, forms, rows = sorted(set("".join(counts))), {}, {}
    for word, n in counts.items():
        near = {w for w in neighbours(word, letters) if w in counts and w != word}
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= dominance * n else None
        forms[word] = form
        rows[word] = [form, None, n, len(near), counts[form] if form else None]
    for word, row in rows.items():
        root = word
        while forms[root]:
            root = forms[root]
        row[1] = root
    return {word: tuple(row) for word, row in rows.items()}


def brute_counts(rows, noise=31, least_length=7, least_count=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("later", [False, True])
def test_bit_sets_find_all_pairs_of_a_group(later):
    rng = random.Random(5)
    for length in (1, 2, 3, 5):
        texts = list({"".join(rng.choice("abc") for _ in range(length + rng.randint(0, 1))) for _ in range(200)})
        groups = np.array([rng.randint(0, 2) for _ in texts])
        groups = np.unique(groups, return_inverse=True)[1]
        one, other = S.near_pairs(texts, groups, length, later)
        got = sorted(zip(one.tolist(), other.tolist()))
        expected = []
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                both_long = len(a) == len(b) == length + 1
                if i != j and groups[i] == groups[j] and not both_long and b in set(neighbours(a, "abc")) - {a}:
                    if not (later and len(a) != len(b) and max(a, b, key=len)[1:] == min(a, b, key=len)):
                        expected.append((i, j))
        assert got == sorted(expected)


@pytest.mark.parametrize("largest", [2, 5, 40, S.LARGEST_GROUP])
def test_forms_equal_brute_force_at_any_group_size(frame, largest):
    rng = random.Random(largest)
    counts = {}
    while len(counts) < 1500:
        base = "".join(rng.choice("ab") for _ in range(rng.randint(1, 11)))
        counts[base] = rng.choice([1, 2, 3, 25, 30, 400, 5000])
    counts |= {"x" * k: 10**k for k in range(7, 15)} | {"é" * k + "ÿ": 5 for k in range(1, 9)}
    table = frame(list(counts.items()), "word string, n long")
    assert found(S.group_spellings(table, largest=largest)) == brute_forms(counts)


def test_whole_tables_equal_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    counts = brute_counts(rows)
    got = S.group_spellings(S.word_counts(documents, noise=31))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(got) == brute_forms(counts) and len(counts) > 1000
    assert any(form for form, *_ in brute_forms(counts).values())


def test_runs_cases_and_nulls(frame):
    rows = [
        (1, "Abcdefgh abcdefgh ABCDEFGH"), (1, "Abcdefgh abcdefgh ABCDEFGH"), (None, "Éabcdefg éabcdefg abc÷defg1abcdefgh"),
        (2, None), (3, ""), (4, "short abcdefgh" * 3), (5, "a" * 30_000 + " " + "a" * 30_000 + " " + "a" * 29_999 + " " + "a" * 29_999),
        (31, "abcdefgi_abcdefgi\nabcdefgi"),
    ]
    table = frame([(*r, 7, "x") for r in rows], "doc_id long, text string, word int, n string")
    for noise in (None, 1, 31):
        assert {r.word: r.n for r in S.word_counts(table, noise=noise).collect()} == brute_counts(rows, noise)
    assert found(S.group_spellings(S.word_counts(table))) == brute_forms(brute_counts(rows, None))


def test_chains_blocks_and_empty_tables(frame, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 70)
    rng = random.Random(1)
    counts = {"".join(rng.choice("abcd") for _ in range(rng.randint(7, 8))): 3 for _ in range(3000)}
    table = frame(list(counts.items()) + [(None, 4)], "word string, n long")
    assert found(S.group_spellings(table)) == brute_forms(counts)
    chain = {"a" * k: 10**k for k in range(1, 18)}
    got = found(S.group_spellings(frame(list(chain.items()), "word string, n long")))
    assert {row[1] for row in got.values()} == {"a" * 17}
    assert S.group_spellings(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.group_spellings(table, dominance=1)
