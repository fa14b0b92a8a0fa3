"""Fill-in-middle transformation by counted quantifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEED = 7
RATE = 100  # per cent of the texts that are cut
SPM_RATE = 50  # per cent of those whose suffix stands first
LINE = "[^\n]*+\n|[^\n]++"  # one unit; both parts are possessive, so a unit never gives characters back
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def _drawn(name: Column, seed: int, place: int) -> Column:
    """The ``place``-th 8-digit group (from 0) of the hex SHA-256 of ``seed:name``, as a number."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return F.conv(F.substring(digits, 8 * place + 1, 8), 16, 10).cast("long")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fill_in_middle(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    unit: str = LINE,
) -> DataFrame:
    """Cut every text at two places between its units and move the middle to the end.

    ``regexp_count`` gives the number of units ``n``. Two hashed numbers choose the places a <= b, and one match of the
    row's own pattern, ``(unit{a}+)(unit{b-a}+)(rest)``, captures prefix, middle and suffix; its replacement writes them in
    the order of the form: psm ``<P>prefix<S>suffix<M>middle``, spm ``<S>suffix<P>prefix<M>middle``. Possessive
    counts are matched by a loop without backtracking, so texts of any number of lines need constant stack. Only built-in
    functions are used and nothing is shuffled.

    A text is plain, and stays as it is, if it is empty, holds one of the three marks or is not drawn by ``rate``. ``unit``
    must match every text from end to end, as lines do.

    Returns all columns of ``df`` and ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (code points; null if plain) and
    ``output``; earlier columns with these names are replaced. A null text counts as empty, a row without an id
    draws as if its id were the empty text, repeated rows give equal results, an empty table gives no rows.
    """
    kept = [c for c in df.columns if c.lower() not in MADE]
    body, name, first, second = (unused(c, df.columns) for c in ("body", "name", "first", "second"))
    column = lambda c: F.col(f"`{c}`")
    rows = df.select(
        *[column(c) for c in kept],
        F.coalesce(column(text_column).cast("string"), F.lit("")).alias(body),
        F.coalesce(column(id_column).cast("string"), F.lit("")).alias(name),
    )
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(column(body), F.lit(mark))
    plain = (column(body) == "") | marked | (_drawn(column(name), seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_drawn(column(name), seed, 3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({"n": F.regexp_count(column(body), F.lit(unit)).cast("long"), "form": form})
    places = [_drawn(column(name), seed, k) % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.withColumns({first: F.least(*places), second: F.greatest(*places)})
    times = lambda count: F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(
        F.lit(r"\A"), times(column(first)), times(column(second) - column(first)), F.lit(r"([\s\S]*+)\z")
    )
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    moved = F.regexp_replace(column(body), pattern, order)
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", column(body)).otherwise(moved))
    at = lambda mark: F.instr(F.col("output"), F.lit(mark))
    after = F.when(F.col("form") == "psm", at(SUFFIX)).when(F.col("form") == "spm", at(MIDDLE))
    rows = rows.withColumns({
        "prefix_chars": (after - at(PREFIX) - len(PREFIX)).cast("long"),
        "middle_chars": F.when(F.col("form") != "plain", F.length("output") - at(MIDDLE) - len(MIDDLE) + 1).cast("long"),
    })
    return rows.select(*[column(c) for c in kept], *MADE)


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. Marks are found where they first occur: a cut text holds none."""
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``fill_in_middle`` rows with the SHA-256 of output and restored text in place of the texts."""
    return df.select(
        F.col(f"`{id_column}`").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


FILL_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents),
drawn AS (
  SELECT doc_id, body, units, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS x,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS y,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM base),
cut AS (
  SELECT doc_id, body, n, form, array_to_string(units[1:least(x, y)], '') AS prefix,
    array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(units[greatest(x, y) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM cut
"""
