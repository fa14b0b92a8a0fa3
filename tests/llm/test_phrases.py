import hashlib
import random

import numpy as np
import pytest

from tablelens.llm.phrases import as_text, fingerprint, fingerprint_with_edits, likeness, phrase_ends, signature


def phrases(text):
    known, at = set(), 0
    for end in range(1, len(text) + 1):
        if text[at:end] not in known:
            known.add(text[at:end])
            at = end
    return known


@pytest.mark.parametrize("text", ["", "a", "aaaaaaa", "abababab", "Straße 👍🏽 über ", "the cat the cat the hat" * 9])
def test_phrases_by_hand(text):
    ends = phrase_ends(text)
    found = {text[a:b] for a, b in zip([0, *ends[:-1]], ends)}
    assert found == phrases(text) and len(found) == len(ends)
    assert len(signature(text, 10_000)) == len(found)


def test_likeness_estimates_the_share_of_common_phrases():
    words = [str(i) for i in range(3000)]
    one, other = " ".join(words), " ".join(words[:2000] + words[2500:])
    a, b = phrases(one), phrases(other)
    exact = len(a & b) / len(a | b)
    assert likeness(signature(one, 10**6), signature(other, 10**6), 10**6) == pytest.approx(exact, abs=0.002)
    assert likeness(signature(one), signature(other)) == pytest.approx(exact, abs=0.15)
    assert likeness(signature(""), signature("")) == 1.0 and likeness(signature(""), signature("x")) == 0.0
    assert likeness(signature(one), signature(one)) == 1.0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edits_follow_the_order_of_ids(frame, parts):
    random.seed(parts)
    texts = ["", None, "short", "längerer Text " * 30, "x" * 500, "same", "same"] + ["w%d " % i * (i % 9) for i in range(40)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, "no id")]
    table = frame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint_with_edits(table, parts=parts).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == as_text(signature(text)) and row.edited_fingerprint == as_text(signature(edited))
        assert row.near_next == likeness(signature(text), signature(following))
        assert row.near_edited == likeness(signature(text), signature(edited))


def test_repeated_rows_one_row_and_none(frame):
    table = frame([(1, "a b c", "z"), (1, "a b c", "z")], "doc_id long, text string, fingerprint string")
    rows = fingerprint_with_edits(table, parts=2).collect()
    assert [r.near_next for r in rows] == [1.0, 1.0]
    assert fingerprint_with_edits(table.limit(1)).first().near_next == 1.0
    assert fingerprint_with_edits(table.limit(0)).count() == 0
    assert {r.fingerprint for r in fingerprint(table).collect()} == {as_text(signature("a b c"))}
