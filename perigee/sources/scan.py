"""Scans of large text files by ranges: what a line means hangs on lines before it, also on those of the range before.

Spark's text source cuts a file into ranges and reads each in order.  A first pass reduces a
range to one small row: the lines at its borders, and for every state that a walk may enter it
in, the state it leaves it in.  These rows are put together by file, which tells each range the
state that it is entered in; a second pass walks all ranges at once.  A file of any size is read
by as many tasks as it has ranges, and the result is that of a walk over the whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions import catalog as C
from perigee.operators.rounds import materialised

_WHERE = ["path", "start"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, at, line): trimmed lines with a character; ``start`` names the range, ``at`` orders the lines of one."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.trim("value").alias("line"))
    return read.withColumn("at", F.monotonically_increasing_id()).where(F.length("line") > 0).select(*_WHERE, "at", "line")


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """The rows of each range, which come one after another."""
    now, held = None, {}
    for batch in batches:
        paths, starts = batch.column("path").to_pylist(), batch.column("start").to_pylist()
        cuts = [0, *[i for i in range(1, batch.num_rows) if (paths[i], starts[i]) != (paths[i - 1], starts[i - 1])], batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = (paths[a], starts[a])
            part = {c: batch.column(c).slice(a, b - a).to_pylist() for c in columns}
            if key == now:
                for c in columns:
                    held[c] += part[c]
            else:
                if now is not None:
                    yield now, held
                now, held = key, part
    if now is not None:
        yield now, held


def _in_order(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Lines joined with the row of their range; a join that shuffles keeps a range together, and the sort its order."""
    return rows.join(told, _WHERE).sortWithinPartitions(*_WHERE, "at")


# element sets ------------------------------------------------------------------


def _walk(ok: list[bool], waiting: int) -> tuple[list[int], int]:
    """Ends of blocks among lines, of which ``ok[i]`` says that i - 1 and i pair, and how many lines wait at the end.

    Up to two lines wait for a third; when it comes and the last two pair, the three are a block,
    else the first of them is let go.
    """
    found = []
    for i, pairs in enumerate(ok):
        if waiting < 2:
            waiting += 1
        elif pairs:
            found.append(i)
            waiting = 0
    return found, waiting


def tle_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, name, line1, line2) of three-line blocks in the files under ``path``, numbered by file from 0.

    What doesn't pair moves the window on by one line.  Empty files and garbage have no blocks.
    """
    rows = lines(spark, path)
    rows = rows.withColumns({
        "one": F.when(F.col("line").startswith("1 ") & (F.length(C.tle_norad("line")) > 0), C.tle_norad("line")),
        "two": F.when(F.col("line").startswith("2 "), F.regexp_replace(F.coalesce(F.try_element_at(F.split("line", r"\s+"), F.lit(2)), F.lit("")), r"\D", "")),
    })
    columns = ["line", "one", "two"]

    def pairs(one: str | None, two: str | None) -> bool:
        return bool(one) and bool(two) and two.startswith(one)

    def tests(one: list, two: list, before: str | None) -> list[bool]:
        return [pairs(a, b) for a, b in zip([before, *one], two, strict=False)]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), x in _runs(batches, columns):
            ok = tests(x["one"], x["two"], None)
            # entered with 0 or 1 line waiting; with two, the first line decides between the last two rows
            leaves = [_walk(ok, 0), _walk(ok, 1), _walk(ok[1:], 0), _walk(ok[1:], 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (file, start, [len(f) for f, _ in leaves], [w for _, w in leaves])]
                + [pa.array([v], pa.string()) for v in (x["two"][0], x["one"][-1])] + [pa.array([x["line"][-2:]], pa.list_(pa.string())), pa.array([x["one"][-2:]], pa.list_(pa.string()))],
                ["path", "start", "blocks", "waiting", "first_two", "last_one", "last_lines", "last_ones"],
            )

    def entered(group: pd.DataFrame) -> pd.DataFrame:
        out, waiting, block, before, kept = [], 0, 0, None, []
        for r in group.sort_values("start").itertuples():
            out.append((r.path, r.start, waiting, block, kept[-2:], before))
            which = waiting if waiting < 2 else (2 if pairs(before, r.first_two) else 3)
            block += int(r.blocks[which]) + (which == 2)
            waiting = int(r.waiting[which])
            before, kept = r.last_one, [*kept, *r.last_lines][-2:]
        return pd.DataFrame(out, columns=["path", "start", "waiting", "block", "carried", "before"])

    ranges = rows.select(*_WHERE, *columns).mapInArrow(summary, "path string, start long, blocks array<long>, waiting array<long>, first_two string, last_one string, last_lines array<string>, last_ones array<string>")
    told = materialised(ranges.groupBy("path").applyInPandas(entered, "path string, start long, waiting long, block long, carried array<string>, before string"))  # a row a range

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, _), x in _runs(batches, [*columns, "waiting", "block", "carried", "before"]):
            found, _ = _walk(tests(x["one"], x["two"], x["before"][0]), x["waiting"][0])
            text = [*x["carried"][0], *x["line"]]
            n = len(x["carried"][0])
            names = ["path", "block", "name", "line1", "line2"]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([x["block"][0] + i for i in range(len(found))], pa.int64()), *(pa.array([text[n + e - k] for e in found], pa.string()) for k in (2, 1, 0))], names)

    found = _in_order(rows, told).select(*_WHERE, *columns, "waiting", "block", "carried", "before").mapInArrow(walked, "path string, block long, name string, line1 string, line2 string")
    return found.withColumn("name", F.trim(F.regexp_replace("name", "^0 ", "")))


# ephemeris tables --------------------------------------------------------------


def marked_lines(spark: SparkSession, path: str, opens: str = "$$SOE", closes: str = "$$EOE") -> DataFrame:
    """(path, start, at, line) of lines between marks; a table that is open at the end of a range goes on in the next."""
    rows = lines(spark, path)
    step = F.when(F.col("line") == opens, 1).when(F.col("line") == closes, -1).otherwise(0)
    depth = rows.withColumn("step", step)
    each = depth.groupBy(*_WHERE).agg(F.sum("step").alias("delta"))

    def entered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        return pd.DataFrame({"path": group["path"], "start": group["start"], "inside": group["delta"].cumsum() - group["delta"]})

    told = materialised(each.groupBy("path").applyInPandas(entered, "path string, start long, inside long"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), x in _runs(batches, ["at", "line", "step", "inside"]):
            inside, keep = x["inside"][0], []
            for i, s in enumerate(x["step"]):
                inside += s
                if inside > 0 and s <= 0:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(keep), pa.string()), pa.array([start] * len(keep), pa.int64()), pa.array([x["at"][i] for i in keep], pa.int64()), pa.array([x["line"][i] for i in keep], pa.string())], ["path", "start", "at", "line"])

    return _in_order(depth, told).select(*_WHERE, "at", "line", "step", "inside").mapInArrow(walked, "path string, start long, at long, line string")


def horizons(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, at, ts, x, y, z, vx, vy, vz) of the tables in the files under ``path``, rounded to six digits; rows of fewer than eight columns are dropped."""
    from perigee.sources.elements import horizons_columns

    return horizons_columns(marked_lines(spark, path), [*_WHERE, "at"])
