"""Line dedup by prefix doubling over the line-id sequences of all documents.

Positions whose next 2^k lines are equal form an interval of the suffix array with a common prefix of
that length; they carry one rank. A round joins each position's rank with that of the position 2^k
lines on, which gives the ranks of runs twice as long. Positions that are alone in their interval leave,
so the tables shrink with every round. A run of any length is ranked by the ranks of its first and its last
2^k lines. Of runs with equal ranks every one but the first is a later copy, and its lines go.

Asked for are the lines of maximal repeated runs with enough words. Any such line is also in a repeated run
that has enough words and cannot lose an end without losing them or the line; it starts or ends with the
line, or is the shortest from its start. So the shortest runs from each line and up to each line do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import batches, merge, row_id, sha256, shown_id, texts, written
from tenderloom.llm.repeats import packed, unpacked

# Words that a repeated run of lines must have.
LEAST_WORDS = 10
WORD = r"[^\x20\x09-\x0D]+"


def line_ranks(docs: DataFrame) -> DataFrame:
    """``(did, th, i, rank, words)`` of each line; equal lines have equal ranks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        row_id().alias("did"), F.hash(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("i", "line")
    )
    words = F.regexp_count("line", F.lit(WORD)).cast("int")
    return lines.select("did", "th", "i", F.xxhash64("line").alias("rank"), words.alias("words"))


def repeated(ranks: DataFrame) -> DataFrame:
    """Positions in an interval of two or more, with ``first``, the smallest position of it."""
    sizes = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank")
    many = written(ranks.join(sizes, "rank", "left_semi"), "lines-many")
    position = F.struct("did", "th", "i")
    first = many.groupBy("rank").agg(F.min(position).alias("first"))
    return many.join(first, "rank").withColumn("later", F.col("first") < position)


def shortest_runs(docs: DataFrame, least_words: int) -> DataFrame:
    """``(did, th, i, stop)``: from each line on, and up to each line, the shortest run with enough words,
    where that has more than one line."""

    def run(frames: Iterator):
        for batch, data in batches(frames, "data"):
            rows, starts, stops = [], [], []
            for row, text in enumerate(data):
                total = np.cumsum([0, *(len(x.split()) for x in text.split(b"\n"))])
                ahead = np.searchsorted(total, total[:-1] + least_words)
                back = np.searchsorted(total, total[1:] - least_words, "right") - 1
                at = np.arange(len(total) - 1)
                found = np.concatenate([np.stack([at, ahead], 1), np.stack([back, at + 1], 1)])
                found = found[(found[:, 0] >= 0) & (found[:, 1] < len(total)) & (found[:, 1] > found[:, 0] + 1)]
                found = np.unique(found, axis=0)
                rows.append(np.full(len(found), row))
                starts.append(found[:, 0])
                stops.append(found[:, 1])
            if rows:
                row = pa.array(np.concatenate(rows))
                ends = [pa.array(np.concatenate(x), pa.int32()) for x in (starts, stops)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").take(row), batch.column("th").take(row), *ends], ["did", "th", "i", "stop"]
                )

    return texts(docs).mapInArrow(run, "did long, th int, i int, stop int")


def later_copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(did, th, start, stop)``: runs of lines with enough words that also stand earlier."""
    wanted = written(shortest_runs(docs, least_words), "lines-wanted")
    longest = wanted.agg(F.max(F.col("stop") - F.col("i"))).first()[0] or 1
    here = repeated(line_ranks(docs))
    found = here.where(F.col("later") & (F.col("words") >= least_words)).select(
        "did", "th", F.col("i").alias("start"), (F.col("i") + 1).alias("stop")
    )
    length = 1
    while 2 * length <= longest:
        here = here.select("did", "th", "i", "rank").distinct()
        on = here.select("did", "th", (F.col("i") - length).alias("i"), F.col("rank").alias("rank2"))
        ranks = written(
            here.join(on, ["did", "th", "i"]).select("did", "th", "i", F.xxhash64("rank", "rank2").alias("rank")),
            "lines-ranks",
        )
        length *= 2
        if ranks.limit(1).count() == 0:
            break
        here = repeated(ranks)
        ends = here.select("did", "th", "i", "rank").distinct()
        size = F.col("stop") - F.col("i")
        runs = wanted.where((size >= length) & (size < 2 * length)).join(ends, ["did", "th", "i"])
        last = ends.select("did", "th", (F.col("i") + length).alias("stop"), F.col("rank").alias("rank2"))
        runs = runs.join(last, ["did", "th", "stop"]).select(
            "did", "th", "i", "stop", F.xxhash64(size, "rank", "rank2").alias("rank")
        )
        found = found.unionByName(repeated(runs).where("later").select("did", "th", F.col("i").alias("start"), "stop"))
    return found


def _kept(data: bytes, runs: list[dict] | None) -> tuple[list[bytes], int, int]:
    lines = unpacked(data).split(b"\n")
    starts, stops = merge(
        np.array([r["start"] for r in runs or []], np.int64), np.array([r["stop"] for r in runs or []], np.int64)
    )
    edges = [0, *np.stack([starts, stops], 1).ravel().tolist(), len(lines)]
    kept = [x for a, b in zip(edges[::2], edges[1::2]) for x in lines[a:b]]
    return kept, len(lines), len(starts)


def _with_runs(docs: DataFrame, least_words: int) -> DataFrame:
    runs = later_copies(docs, least_words).groupBy("did", "th").agg(
        F.collect_set(F.struct("start", "stop")).alias("runs")
    )
    return packed(docs).join(runs, ["did", "th"], "left")


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: lines, lines removed, maximal removed runs, and the hash of what is kept.

    Removed is every line in a run of any length with at least ``least_words`` words in all that also
    stands at an earlier position, in an earlier document (by id) or further up in the same one. A
    null text is empty, which is one line without words; a null id stays null and is the earliest; rows
    repeated with id and text are one place, each returned; extra columns are ignored and an empty table
    gives an empty one. Equality of lines is taken from 64-bit hashes.
    """

    def run(frames):
        for batch, data, runs in batches(frames, "data", "runs"):
            out = []
            for text, gone in zip(data, runs):
                kept, lines, n_runs = _kept(text, gone)
                out.append((lines, lines - len(kept), n_runs, sha256(b"\n".join(kept))))
            columns = list(zip(*out)) if out else [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            arrays = [batch.column("did"), *[pa.array(c, t) for c, t in zip(columns, types)]]
            yield pa.RecordBatch.from_arrays(arrays, ["did", "n_lines", "n_removed", "n_runs", "kept_sha256"])

    rows = _with_runs(docs, least_words).select("did", "data", "runs").mapInArrow(
        run, "did long, n_lines long, n_removed long, n_runs long, kept_sha256 string"
    )
    return rows.select(shown_id().alias("doc_id"), "n_lines", "n_removed", "n_runs", "kept_sha256")


def shortened_documents(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with the lines of later copies taken out of ``text``, and ``n_chars``, where
    there is one, made to fit. Rows of which no word is left are gone; those without words stay."""

    def run(frames: Iterator):
        for batch, data, runs in batches(frames, "data", "runs"):
            kept = [b"\n".join(_kept(text, gone)[0]) for text, gone in zip(data, runs)]
            text = pa.array([k.decode() for k in kept], pa.string())
            left = pa.array([bool(k.split()) for k in kept], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("th"), text, left], ["did", "th", "text", "left"]
            )

    runs = later_copies(docs, least_words).groupBy("did", "th").agg(
        F.collect_set(F.struct("start", "stop")).alias("runs")
    )
    cut = (
        packed(docs).join(runs, ["did", "th"]).dropDuplicates(["did", "th"]).select("did", "th", "data", "runs")
        .mapInArrow(run, "did long, th int, text string, left boolean")
    )
    cut = cut.withColumnsRenamed({"did": "__did", "th": "__th", "text": "__text", "left": "__left"})
    old = F.coalesce(F.col("text"), F.lit(""))
    both = docs.join(cut, (row_id() == F.col("__did")) & (F.hash(old) == F.col("__th")), "left")
    changed = F.col("__text").isNotNull()
    new = {"text": F.when(changed, F.col("__text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.char_length("__text").cast(kind)).otherwise(F.col("n_chars"))
    return both.where(~changed | F.col("__left")).withColumns(new).select(*docs.columns)


def sql(least_words: int = LEAST_WORDS) -> str:
    """The same in DuckDB's SQL, over all pairs of equal lines: those that follow one another in both places
    are a repeated run that cannot be made longer."""
    return f"""
      WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
      lines AS (
        SELECT doc_id, i, parts[i] AS line, len(regexp_extract_all(parts[i], '[^\\x20\\x09-\\x0D]+')) AS w
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM texts)
      ),
      pairs AS (
        SELECT b.doc_id, b.i, b.w, a.doc_id AS earlier, b.i - a.i AS apart
        FROM lines a JOIN lines b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i)
      ),
      runs AS (
        SELECT doc_id, i, sum(w) OVER (PARTITION BY doc_id, earlier, apart, run) AS words FROM (
          SELECT *, i - row_number() OVER (PARTITION BY doc_id, earlier, apart ORDER BY i) AS run FROM pairs)
      ),
      gone AS (SELECT DISTINCT doc_id, i FROM runs WHERE words >= {least_words}),
      marked AS (
        SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM lines l LEFT JOIN gone g USING (doc_id, i)
      ),
      edged AS (
        SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked
      )
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        count(*) FILTER (begins) AS n_runs,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
      FROM edged GROUP BY doc_id"""
