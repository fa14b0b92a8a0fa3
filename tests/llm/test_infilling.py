import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tablelens.llm.infilling import FILL_SQL, digest, fill_in_middle, restore

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
TEXTS = [
    "", None, "\n", "\n\n\n", "one line", "a\nb\nc\nd\n", "a\nb\nc", "é\n日本\n👍 x\n\r\n$1 \\2\n", "has <P> in it\nx\n", "<M\n>\n<S\n", "x\n" * 40,
    " \n\t\n", "last\n\n", "<P\nP>\n", "\x00\n\x00",
]


def brute(doc_id, text, seed=7, rate=100, spm_rate=50):
    text, name = text or "", "" if doc_id is None else str(doc_id)
    digits = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_equals_brute_force_and_restores(frame, rate, spm_rate):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS * 12)]
    made = fill_in_middle(frame(rows, "doc_id long, text string"), rate=rate, spm_rate=spm_rate)
    made = made.withColumn("back", restore(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=repr)
    assert got == sorted(((i, t, *brute(i, t, 7, rate, spm_rate)) for i, t in rows), key=repr)
    assert all(r.back == (r.text or "") for r in made.collect())


def test_digest_equals_sql_and_digests(frame):
    rows = [(i, t) for i, t in enumerate(TEXTS * 5)] + [(None, "a\nb\n"), (4, "other\ntext")]
    table = frame(rows, "doc_id long, text string")
    connection = duckdb.connect()
    connection.register("documents", table.toPandas())
    connection.execute("CREATE TABLE copy AS SELECT doc_id::BIGINT AS doc_id, text FROM documents")
    expected = connection.execute(FILL_SQL.replace("FROM documents", "FROM copy")).fetchall()
    got = digest(fill_in_middle(table))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_very_long_texts_of_many_lines(frame):
    rows = [(i, t) for i, t in enumerate(["ab\n" * 400_000, "x" * 3_000_000, "\n" * 1_000_000, "é\n" * 300_001 + "end"])]
    for r in fill_in_middle(frame(rows, "doc_id long, text string")).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)


def test_other_units(frame):
    made = fill_in_middle(frame([(i, "one two  three four") for i in range(9)], "doc_id long, text string"), unit="[^ ]*+ |[^ ]++").collect()
    assert {r.n for r in made} == {5} and all(
        r.output.replace("<P>", "").replace("<S>", "").replace("<M>", "") != "" and len(r.output) == 19 + 9 for r in made
    )


def test_clashing_names_repeats_and_empty_tables(frame):
    table = frame([(1, "a\nb\n", 5, "u", 1, 2)] * 3, "doc_id long, text string, N int, body string, name int, first int")
    made = fill_in_middle(table)
    assert made.columns == ["doc_id", "text", "body", "name", "first", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = {tuple(r) for r in made.collect()}
    assert len(rows) == 1 and next(iter(rows))[2:5] == ("u", 1, 2) and made.count() == 3
    assert fill_in_middle(table.limit(0)).count() == 0


def test_the_plan_has_no_python_and_no_exchange(frame):
    plan = digest(fill_in_middle(frame([(1, "a")], "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
