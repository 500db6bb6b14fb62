"""Large files by byte range: the records of JSON documents, and numbered lines, without a task that holds a whole file.

A JSON document is cut at its closing braces by the splits that Spark's text reader makes. What a split means depends on
whether it begins inside a string, and how deep: the first scan counts, for both cases at once, quotes and brackets of each
split; running sums of these give every split its beginning; the second scan cuts records. Only the pieces of records that
cross a border between splits are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechloom.sources.shared import written

#: Splits whose beginnings are sent to every task (some 100 bytes each).
SPLITS = 1_000_000
#: Rows of a batch that become Python values at once, and characters that wait to be handed on: what a task holds stays as large
#: whatever the batch.
IN_ROWS, OUT_CHARS = 64, 4 << 20
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_MARKS = re.compile(r'["{}\[\],]')
_ESCAPED_OR_MARK = re.compile(r'\\.|["{}\[\],]', re.DOTALL)
_FILE, _START = "file string", "start long"


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start of the split): what lies before each closing brace, in order within a task. The last piece of a
    file may lack its brace; one too many there, below all brackets, does no harm."""
    return _placed(spark.read.option("lineSep", "}").text(path))


def _mapped(df: DataFrame, schema: str, make) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, IN_ROWS) for b in batches for at in range(0, b.num_rows, IN_ROWS))
        rows = (row for b in slices for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []
        size = 0
        for out in make(rows):
            held.append(out)
            size += sum(len(x) for x in out if isinstance(x, str))
            if len(held) >= 1024 or size > OUT_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def depths(piece: str) -> tuple[int, int, int]:
    """Of a piece: its quotes, and by how much brackets go deeper if it begins outside a string, or inside one."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    outside, inside = "".join(parts[::2]), "".join(parts[1::2])
    deeper = lambda s: s.count("{") + s.count("[") - s.count("}") - s.count("]")
    return len(parts) - 1, deeper(outside), deeper(inside)


def summaries(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(file, start, quotes, deeper0, deeper1, root) of each split; root: its first character that is no white space."""
    now, total, root = None, [0, 0, 0], ""
    for value, file, start in rows:
        if (file, start) != now:
            if now:
                yield *now, *total, root
            now, total, root = (file, start), [0, 0, 0], ""
        quotes, *deeper = depths(value + "}")
        if total[0] % 2:
            deeper.reverse()
        total = [total[0] + quotes, total[1] + deeper[0], total[2] + deeper[1]]
        root = root or value.lstrip("\ufeff \t\r\n")[:1] or "}"
    if now:
        yield *now, *total, root


def beginnings(pieces: DataFrame) -> DataFrame:
    """(file, start, inside, depth, root) of every split: whether a string is open where it begins, and how many brackets."""
    own = _mapped(pieces, f"{_FILE}, {_START}, quotes long, deeper0 long, deeper1 long, root string", summaries)
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    deeper = F.when(F.col("inside") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))
    rows = own.withColumn("inside", inside).withColumn("deeper", deeper)
    return rows.select("file", "start", "inside", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"), F.first("root").over(order).alias("root"), "deeper", "quotes")


def member_lists(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(file, start, piece, char, bracket) where a member of the root object begins or ends that is a list."""
    now = None
    for value, file, start, inside, depth, root in rows:
        if (file, start) != now:
            now, piece, open_, deep = (file, start), -1, inside == 1, depth
        text, piece = value + "}", piece + 1
        if root != "{" or deep - text.count("}") - text.count("]") > 2:
            quotes, *deeper = depths(text)
            deep, open_ = deep + deeper[open_], open_ ^ (quotes % 2 == 1)
            continue
        for m in (_ESCAPED_OR_MARK if "\\" in text else _MARKS).finditer(text):
            c = m[0]
            if c == '"':
                open_ = not open_
            elif open_ or c == "," or c[0] == "\\":
                continue
            elif c in "{[":
                deep += 1
                if deep == 2 and c == "[":
                    yield *now, piece, m.start(), c
            else:
                if deep == 2 and c == "]":
                    yield *now, piece, m.start(), c
                deep -= 1


def elements(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(file, start, at, text, whole): the elements of a document's list as far as they lie in each split, numbered from 0 by
    the commas before them in the split; whole, if they neither begin nor end at its border. base is the depth of the list's
    commas: 1 for a list at the root, 2 for a member (which begins at lo and ends at hi), 0 where the document is one element.
    """
    now, live = None, False
    for value, file, start, inside, depth, base, lo, hi in rows:
        if (file, start) != now:
            if live:
                yield *now, at, "".join(held), False
            now, piece, at, held, open_, deep = (file, start), -1, 0, [], inside == 1, depth
            live = lo["start"] < start <= hi["start"] if base == 2 else depth >= 1 or (base == 0 and start == 0)
        text, piece, last = value + "}", piece + 1, 0
        if deep - text.count("}") - text.count("]") > max(base, 1) if live else base == 2 and (start, piece) != (lo["start"], lo["piece"]):
            # No border here.
            quotes, *deeper = depths(text)
            deep, open_ = deep + deeper[open_], open_ ^ (quotes % 2 == 1)
            if live:
                held.append(text)
            continue
        for m in (_ESCAPED_OR_MARK if "\\" in text else _MARKS).finditer(text):
            c = m[0]
            if c == '"':
                open_ = not open_
            elif open_ or c[0] == "\\":
                continue
            elif c in "{[":
                deep += 1
                if not live and base and deep == base and (base == 1 or (start, piece, m.start()) == (lo["start"], lo["piece"], lo["char"])):
                    live, last = True, m.end()
            elif c in "}]":
                if live and deep == max(base, 1):
                    held.append(text[last : m.start() if base else m.end()])
                    yield *now, at, "".join(held), False
                    live, held = False, []
                deep -= 1
            elif live and base and deep == base:
                held.append(text[last : m.start()])
                yield *now, at, "".join(held), at > 0
                at, held, last = at + 1, [], m.end()
        if live:
            held.append(text[last:])
    if live:
        yield *now, at, "".join(held), False


def json_records(spark: SparkSession, path: str, members: bool = False) -> DataFrame:
    """(file, ordinal, number, record): the JSON texts of all records of all files below path: those of a list at the root;
    with members, of the first member of a root object that is a list; else the one object. ordinal counts in its file, number
    over all files in the order of their names (an empty list takes a number), both from 0. A file that ends inside a string
    or bracket is an error, as is one that holds neither list nor object; an empty one has no record.
    """
    pieces = _pieces(spark, path)
    begin = written(beginnings(pieces).where("root <> '}' OR depth <> 0"), "json-splits")
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("start"))) == 1
    # Beyond the last bracket a brace may have been put where the file has none.
    wrong = "root NOT IN ('[', '{') OR last AND ((inside + quotes) % 2 = 1 OR depth + deeper NOT IN (0, -1))"
    bad = begin.withColumn("last", last).where(wrong).select("file").distinct().limit(3).collect()
    if bad:
        raise ValueError(f"no JSON document: {', '.join(r.file for r in bad)}")
    if (splits := begin.count()) > SPLITS:
        raise ValueError(f"{splits} splits; raise spark.sql.files.maxPartitionBytes")
    # Every scan must cut files alike; if the cluster's size changed between them, this says so.
    sure = F.when(F.col("s").isNull() & (F.trim("value") != ""), F.raise_error(F.lit("files were split anew between two scans; run again"))).otherwise(F.col("value"))
    known = lambda sides: _with(pieces, sides).withColumn("value", sure).where("s IS NOT NULL")
    if members:
        rows = known(begin.select("file", "start", "inside", "depth", "root")).select("value", "file", "start", "inside", "depth", "root")
        marks = written(_mapped(rows, f"{_FILE}, {_START}, piece long, char long, bracket string", member_lists), "json-members")
        place = F.struct("start", "piece", "char")
        lo = marks.where("bracket = '['").groupBy("file").agg(F.min(place).alias("lo"))
        hi = marks.where("bracket = ']'").join(lo, "file").where(place > F.col("lo")).groupBy("file", "lo").agg(F.min(place).alias("hi"))
        begin = begin.join(hi, "file", "left")
    else:
        none = F.lit(None).cast("struct<start:bigint,piece:bigint,char:bigint>")
        begin = begin.withColumns({"lo": none, "hi": none})
    base = F.when(F.col("root") == "[", 1).when(F.col("lo").isNotNull(), 2).otherwise(0)
    rows = known(begin.select("file", "start", "inside", "depth", base.alias("base"), "lo", "hi")).select("value", "file", "start", "inside", "depth", "base", "lo", "hi")
    parts = written(_mapped(rows, f"{_FILE}, {_START}, at long, text string, whole boolean", elements), "json-parts")

    # How many commas lie before each split.
    per_split = parts.groupBy("file", "start").agg(F.max("at").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = _with(parts, offsets).select("file", (F.col("before") + F.col("at")).alias("ordinal"), "start", "text", "whole")
    crossing = placed.where("NOT whole").groupBy("file", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("record"))
    records = placed.where("whole").select("file", "ordinal", F.col("text").alias("record")).unionByName(crossing)
    records = records.withColumn("record", F.btrim("record", F.lit(" \t\r\n\ufeff"))).where("record <> ''")

    # Files are few beside records: their sizes give each its first number.
    sizes = per_split.groupBy("file").agg((F.sum("n") + 1).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(F.col("file").alias("f"), first.alias("first"))
    return records.join(F.broadcast(firsts), F.col("file") == F.col("f")).select("file", "ordinal", (F.col("first") + F.col("ordinal")).alias("number"), "record")


def _with(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """What is known of each split beside its rows, whose order stays as it is; s is null where nothing is known."""
    sides = sides.withColumnsRenamed({"file": "f", "start": "s"})
    return rows.join(F.broadcast(sides), (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")), "left")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line): the lines of all files below path with their numbers from 1; blank lines count, and are left
    out. Splits count their lines, running sums of the counts give each its first number, and a line's place in its split is
    the difference of two row ids; so nothing but one number a split is shuffled.
    """
    rows = _placed(spark.read.text(path)).withColumn("id", F.monotonically_increasing_id())
    counts = written(rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "line-splits")
    if (splits := counts.count()) > SPLITS:
        raise ValueError(f"{splits} splits; raise spark.sql.files.maxPartitionBytes")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = _with(rows, counts.select("file", "start", "n", "first_id", before.alias("before")))
    at = F.col("id") - F.col("first_id")
    # Both scans must cut files alike and deal them to the same tasks; if not, this says so.
    sure = F.when(at.isNull() | (at < 0) | (at >= F.col("n")), F.raise_error(F.lit("files were split anew between two scans; run again"))).otherwise(at)
    return placed.select("file", (F.col("before") + sure + 1).alias("number"), F.col("value").alias("line")).where(F.trim("line") != "")


def strict_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON lines; the first look at a line that is no JSON object ends the read with its file and number."""
    row = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = numbered_lines(spark, path).withColumn("row", row)
    where = F.concat(F.col("file"), F.lit(", line "), F.col("number").cast("string"), F.lit(": not JSON"))
    checked = F.when(F.col("row._bad").isNull(), F.col("row")).otherwise(F.raise_error(where))
    return rows.select("file", "number", checked.alias("row")).select("file", "number", "row.*").drop("_bad")
