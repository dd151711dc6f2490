"""Line dedup by winnowing: later repeats of a run of lines go.

A window is the shortest run of lines, forward from a line or back from it, that has
MIN_CHARS characters, or MAX_LINES lines if these are shorter. The smallest line hash of
a window is its fingerprint, so two equal windows have the same one: a run that repeats
and holds a window can't be missed. Positions of a fingerprint that occurs once are left
out. Where it occurs more than once, windows are compared by a hash of all their lines, and
every window met at an earlier position marks its lines. Forward and backward windows
together cover exactly the repeated runs, to their first and last lines, so nothing is
extended from pairs of positions. Doing that from the first position of a fingerprint
would lose runs (the fingerprint of a run `A g B` may be a line `g` that occurs first in
`X g Y`), and doing it from all of them would pair a common line with all its places.
Marked lines are deleted; the first occurrence of a run stays.

"Earlier" is by doc_id (null last), then by text hash, then by line. Rows that agree in
doc_id and text are one document and get the same result. Lines are compared without
outer spaces. Null and empty texts stay as they are. Of an empty table nothing is left.
Extra columns pass through; one called n_removed is replaced.
Runs on built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_CHARS = 200
MAX_LINES = 16

_LAST_ID = 9223372036854775807


def _windows(min_chars: int, max_lines: int) -> str:
    """SQL for all windows of a text: array of (s, m, f, k), being first line, number of
    lines, fingerprint and hash of all its lines. `t.h` and `t.n` are the hashes and
    lengths of the lines."""

    def reach(lengths: str) -> str:
        return f"""aggregate({lengths}, named_struct('c', 0, 'm', 0),
            (a, x) -> if(a.c >= {min_chars}, a, named_struct('c', a.c + x, 'm', a.m + 1)),
            a -> if(a.c >= {min_chars} or a.m = {max_lines}, a.m, 0))"""

    ahead = reach(f"slice(t.n, i + 1, {max_lines})")
    behind = reach(f"reverse(slice(t.n, greatest(i - {max_lines - 2}, 1), least(i + 1, {max_lines})))")
    return f"""transform(array(named_struct(
            'h', transform(split(text, '\\n'), x -> xxhash64(trim(x))),
            'n', transform(split(text, '\\n'), x -> length(trim(x))))),
        t -> transform(
            filter(
                concat(
                    transform(sequence(0, size(t.h) - 1), i -> named_struct('s', i, 'm', {ahead})),
                    transform(transform(sequence(0, size(t.h) - 1), i -> named_struct('s', i, 'm', {behind})),
                        w -> named_struct('s', w.s - w.m + 1, 'm', w.m))),
                w -> w.m > 0),
            w -> named_struct('s', w.s, 'm', w.m,
                'f', array_min(slice(t.h, w.s + 1, w.m)),
                'k', xxhash64(slice(t.h, w.s + 1, w.m)))))[0]"""


def _merged(df: DataFrame) -> DataFrame:
    """One side of a sort-merge join, whatever its size: it grows with the documents, and
    Spark splits the other side's heavy keys."""
    return df.hint("merge")


def repeated_windows(docs: DataFrame, min_chars: int = MIN_CHARS, max_lines: int = MAX_LINES) -> DataFrame:
    """(ord, th, spans): for each document with repeats the windows (s, m) that have an
    earlier occurrence. docs: ord, th, text."""
    windows = docs.select("ord", "th", F.explode(F.expr(_windows(min_chars, max_lines))).alias("w"))
    windows = stored(windows.select("ord", "th", "w.s", "w.m", "w.f", "w.k"), "windows")
    place = F.struct("ord", "th", "s")

    # positions of fingerprints: the windows of one line share it, so only places count
    twice = windows.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b")
    near = stored(windows.join(_merged(stored(twice.select("f"), "fingerprints")), "f", "left_semi"), "positions")

    first = near.groupBy("f", "k").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    later = near.join(_merged(stored(first.drop("last"), "firsts")), ["f", "k"]).where(place > F.col("first"))
    return later.groupBy("ord", "th").agg(F.collect_set(F.struct("s", "m")).alias("spans"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_lines: int = MAX_LINES) -> DataFrame:
    """The documents without the lines of later repeated runs, and `n_removed`, the
    number of lines that went."""
    kept = [c for c in docs.columns if c != "n_removed"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("ord"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"),
        row,
    )
    texts = keyed.where("row.text <> ''").select("ord", "th", F.col("row.text").alias("text"))
    spans = stored(repeated_windows(texts, min_chars, max_lines), "spans")
    out = keyed.join(_merged(spans), ["ord", "th"], "left")
    gone = F.expr("array_distinct(flatten(transform(spans, w -> sequence(w.s, w.s + w.m - 1))))")
    cut = F.expr(
        """transform(array(split(row.text, '\\n')), l -> array_join(
            transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\\n'))[0]"""
    )
    out = out.select("row", gone.alias("gone"))
    columns = [
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(cut).alias("text")
        if c == "text"
        else F.col(f"row.`{c}`").alias(c)
        for c in kept
    ]
    return out.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, the text that is left, number of lines before, number that went."""
    out = dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines")))
    return out.select("doc_id", "text", "n_lines", "n_removed")


#: The same in SQL, by comparing all windows as text, for documents with unique ids.
LINE_SQL = f"""
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''
), whole AS (
  SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS line FROM raw
), lines AS (
  SELECT doc_id, i, trim(line, ' ') AS line FROM whole
), reach AS (
  SELECT a.doc_id, a.i AS i, b.i AS j, a.i <= b.i AS ahead, sum(length(c.line)) AS chars
  FROM lines a
  JOIN lines b ON a.doc_id = b.doc_id AND abs(a.i - b.i) < {MAX_LINES}
  JOIN lines c ON a.doc_id = c.doc_id AND c.i BETWEEN least(a.i, b.i) AND greatest(a.i, b.i)
  GROUP BY ALL
), ends AS (
  SELECT doc_id, i AS s, min(j) AS e FROM reach
  WHERE ahead AND (chars >= {MIN_CHARS} OR j - i = {MAX_LINES - 1}) GROUP BY ALL
  UNION
  SELECT doc_id, max(j) AS s, i AS e FROM reach
  WHERE (NOT ahead OR i = j) AND (chars >= {MIN_CHARS} OR i - j = {MAX_LINES - 1}) GROUP BY doc_id, i
), windows AS (
  SELECT w.doc_id, w.s, w.e, string_agg(l.line, chr(10) ORDER BY l.i) AS run
  FROM ends w JOIN lines l ON l.doc_id = w.doc_id AND l.i BETWEEN w.s AND w.e GROUP BY ALL
), later AS (
  SELECT doc_id, s, e FROM windows
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS i FROM later
), left_over AS (
  SELECT w.doc_id, coalesce(string_agg(w.line, chr(10) ORDER BY w.i) FILTER (g.i IS NULL), '') AS text,
    count(g.i) AS n_removed
  FROM whole w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(o.text, d.text) AS text, len(string_split(d.text, chr(10))) AS n_lines,
  coalesce(o.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN left_over o ON o.doc_id = d.doc_id
"""
