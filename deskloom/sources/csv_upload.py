"""Uploaded ticket CSV files, read line by line so that one large file is many tasks.

A quoted cell may span lines, so whether a line starts a record, and which cell it begins in, depend
on the lines before it. Both are worked out inside a scan block for either state at its start, the
lines are staged with them, and a few numbers per block are then carried over the blocks of a file.

A record on one line is cut where it is. Of cells over several lines only a summary is merged first
(length, first and last character that is not blank); then no more text is put together than the
column can hold, so records and cells may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskloom import schema as S
from deskloom.functions.text import SPACES
from deskloom.session import pin

# Cells: quoted (doubled quotes inside, stray text behind), plain, or empty.
_CLOSED_CELL = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
_CLOSED_LINE = f"^{_CLOSED_CELL}(?:,{_CLOSED_CELL})*+$"
_CELLS = r',("(?:[^"]|"")*+(?:"[^,]*+)?|[^,]*+)'
_QUOTED = r'(?s)^"((?:[^"]|"")*+)(?:"(.*))?$'

#: A cell over several lines comes as it is up to this length, a longer one without the blanks at
#: its ends.
AS_IT_IS = 4096
#: Lines of a block; the few numbers of a file's blocks meet in one task.
BLOCK_LINES = 65_536

_BLOCK = ("file", "block")
_RECORD = ("file", "row_num")
_CELL = (*_RECORD, "column")


def upload_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as (file, block, pos, value): pos is the order inside a block.

    A block is a run of lines of one scan split, so that a file that cannot be split is many blocks.
    """
    line = F.monotonically_increasing_id()
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("start"),
            F.floor(line % (1 << 33) / BLOCK_LINES).alias("part"),
        ).alias("block"),
        line.alias("pos"),
        "value",
    )


def _cells(record: Column) -> Column:
    """The cells of a record, quotes resolved."""
    def resolve(cell: Column) -> Column:
        body = F.replace(F.regexp_extract(cell, _QUOTED, 1), F.lit('""'), F.lit('"'))
        stray = F.regexp_extract(cell, _QUOTED, 2)
        return F.when(cell.startswith('"'), F.concat(body, stray)).otherwise(cell)

    return F.transform(_raw_cells(record), resolve)


def _earlier(partition: tuple[str, ...], order: str):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _with_state(df: DataFrame, partition: tuple[str, ...], order: str) -> DataFrame:
    """Combine the maps ``if_closed``/``if_open`` of all earlier rows of a partition.

    A map with equal outcomes sets the state, one with opposite outcomes may flip it. So the state
    before a row is the last set one (``fixed``, NULL without any) or the one at the partition's
    start, flipped if ``odd``.
    """
    sets = F.col("if_closed") == F.col("if_open")
    flips = (F.col("if_closed") & ~F.col("if_open")).cast("int")
    df = df.withColumn("upto", F.sum(flips).over(_earlier(partition, order).rowsBetween(Window.unboundedPreceding, 0)))
    latest = F.last(F.when(sets, F.struct("if_closed", "upto")), ignorenulls=True).over(_earlier(partition, order))
    df = df.withColumns({"before": F.coalesce(F.col("upto") - flips, F.lit(0)), "latest": latest})
    odd_since = (F.col("before") - F.col("latest.upto")) % 2 == 1
    return df.withColumns(
        {"fixed": F.col("latest.if_closed") != odd_since, "odd": F.col("before") % 2 == 1}
    ).drop("upto", "before", "latest")


def _state(start: Column) -> Column:
    return F.coalesce(F.col("fixed"), start != F.col("odd"))


def _raw_cells(text: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(_CELLS), F.lit(1))


def _line_maps(lines: DataFrame) -> DataFrame:
    """Per line and state before it: the state behind it, and how many cells end inside it.

    Patterns run on lines with a quote only.
    """
    value = F.col("value")
    quoted, inner = F.contains(value, F.lit('"')), F.concat(F.lit('"'), value)
    commas = F.octet_length(value) - F.octet_length(F.replace(value, F.lit(","), F.lit("")))
    return lines.withColumns(
        {
            "if_closed": quoted & ~value.rlike(_CLOSED_LINE),
            "if_open": ~quoted | ~inner.rlike(_CLOSED_LINE),
            "ends_closed": F.when(quoted, F.size(_raw_cells(value)) - 1).otherwise(commas).cast("bigint"),
            "ends_open": F.when(quoted, F.size(_raw_cells(inner)) - 1).otherwise(0).cast("bigint"),
        }
    )


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their place for either state at their block's start, as structs ``closed``, ``open``.

    ``begun`` counts the records begun in the block up to the line, ``inside`` tells whether the
    line continues one, ``passed`` counts the cells that its record has ended before the line, since
    the block's start if the record is an earlier block's (``begun`` is 0).
    """
    upto = _earlier(_BLOCK, "pos").rowsBetween(Window.unboundedPreceding, 0)
    df = _with_state(_line_maps(lines), _BLOCK, "pos")
    for name, start in (("closed", False), ("open", True)):
        inside = _state(F.lit(start))
        begins = ~inside & (F.col("value") != "")
        ends = F.when(inside, F.col("ends_open")).otherwise(F.col("ends_closed"))
        before = F.coalesce(F.sum(ends).over(_earlier(_BLOCK, "pos")), F.lit(0))
        df = df.withColumns({"inside": inside, "begins": begins, "before": before})
        at_start = F.last(F.when(F.col("begins"), F.col("before")), ignorenulls=True).over(upto)
        place = F.struct(
            "inside",
            F.sum(F.col("begins").cast("bigint")).over(upto).alias("begun"),
            (F.col("before") - F.coalesce(at_start, F.lit(0))).alias("passed"),
            F.when(F.col("inside"), F.col("if_open")).otherwise(F.col("if_closed")).alias("leaves"),
            ends.alias("ends"),
        )
        df = df.withColumn(name, place).drop("inside", "begins", "before")
    return df.select(*_BLOCK, "pos", "value", "closed", "open")


def _blocks(placed: DataFrame) -> DataFrame:
    """Per block: the state at its start, the records begun and the cells ended earlier by the
    record that runs into it, and where the file's header has the upload columns."""

    def last(field: str, start: str) -> Column:
        return F.max_by(f"{start}.{field}", "pos")

    def passed(start: str) -> Column:
        return F.max_by(F.col(f"{start}.passed") + F.col(f"{start}.ends"), "pos")

    blocks = placed.groupBy(*_BLOCK).agg(
        last("leaves", "closed").alias("if_closed"),
        last("leaves", "open").alias("if_open"),
        F.struct(last("begun", "closed").alias("begun"), passed("closed").alias("passed")).alias("closed"),
        F.struct(last("begun", "open").alias("begun"), passed("open").alias("passed")).alias("opened"),
        F.min_by("value", F.when(F.col("value") != "", F.col("pos"))).alias("first"),
    )
    before = _earlier(("file",), "block")
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = _with_state(blocks, ("file",), "block").withColumn("open", _state(F.lit(False)))
    known = known.withColumn("own", F.when(F.col("open"), F.col("opened")).otherwise(F.col("closed")))
    summed = known.withColumn("upto", F.sum("own.passed").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.last(F.when(F.col("own.begun") > 0, F.col("upto") - F.col("own.passed")), ignorenulls=True).over(before)
    blocks = summed.select(
        *_BLOCK,
        F.col("open").alias("runs_in"),
        F.coalesce(F.sum("own.begun").over(before), F.lit(0)).alias("begun_before"),
        (F.col("upto") - F.col("own.passed") - F.coalesce(since, F.lit(0))).alias("passed_before"),
        F.first("first", ignorenulls=True).over(whole).alias("header"),
    )
    # Per block, so that rows need not look at the header again.
    named = blocks.withColumn("names", header_names(F.col("header"))).drop("header")
    return named.withColumn("slots", _slots(F.col("names"))).drop("names")


def _data_lines(lines: DataFrame) -> DataFrame:
    """Lines of data rows: file, row_num, block, pos, the pieces of cells they hold (``pieces``), the
    number of the first piece's cell from 0 (``passed``), whether that continues an earlier line's
    cell (``inside``) and whether the record goes on (``goes_on``).

    Row number 1 is the header. Blank lines between records do not count.
    """
    placed = pin(_placed(lines), "upload-lines")
    joined = placed.join(pin(_blocks(placed), "upload-blocks"), list(_BLOCK))
    own = F.when(F.col("runs_in"), F.col("open")).otherwise(F.col("closed"))
    known = joined.withColumn("own", own).where(F.col("own.inside") | (F.col("value") != ""))
    earlier = F.when(F.col("own.begun") == 0, F.col("passed_before")).otherwise(0)
    rows = known.withColumn("row_num", F.col("begun_before") + F.col("own.begun"))
    rows = rows.where((F.col("row_num") > 1) & F.col("slots").isNotNull())
    text = F.when(F.col("own.inside"), F.concat(F.lit('"'), F.col("value"))).otherwise(F.col("value"))
    pieces = F.when(F.contains(text, F.lit('"')), _cells(text)).otherwise(F.split("value", ",", -1))
    return rows.select(
        *_RECORD, "block", "pos", "slots",
        pieces.alias("pieces"),
        (F.col("own.passed") + earlier).alias("passed"),
        F.col("own.inside").alias("inside"),
        F.col("own.leaves").alias("goes_on"),
    )


def _piece(i: int) -> Column:
    """What a line holds of the i-th upload column, NULL if nothing."""
    at = F.get("slots", F.lit(i)) - 1 - F.col("passed")
    return F.when(at >= 0, F.get("pieces", at.cast("int")))


def _long_cells(lines: DataFrame) -> DataFrame:
    """file, row_num and the upload columns of records over several lines.

    Pieces are measured per block first, then per record over its blocks, so a record of any length
    is never one task's. Text is put together up to ``AS_IT_IS`` characters; of longer cells only
    what lies between the blanks at their ends, and no more than one character beyond the width.
    """
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("column"), F.lit(_width(c)).alias("width"), _piece(i).alias("piece"), F.get("slots", F.lit(i)).alias("slot"))
            for i, c in enumerate(S.UPLOAD_COLUMNS)
        ]
    )
    held = lines.select(*_RECORD, "block", "pos", "inside", "passed", F.explode(columns).alias("c")).where("c.piece is not null")
    continued = F.col("inside") & (F.col("c.slot") - 1 == F.col("passed"))
    text = F.concat(F.when(continued, F.lit("\n")).otherwise(F.lit("")), F.col("c.piece"))
    held = held.select(*_RECORD, F.col("c.column").alias("column"), F.col("c.width").alias("width"), "block", "pos", text.alias("text"))
    in_block = _earlier((*_CELL, "block"), "pos")
    held = held.withColumn("size", F.length("text").cast("bigint"))
    held = pin(held.withColumn("at", F.coalesce(F.sum("size").over(in_block), F.lit(0))), "cell-pieces")

    blanks = F.lit(SPACES)
    leading = F.col("size") - F.length(F.ltrim(F.col("text"), blanks))
    trailing = F.col("size") - F.length(F.rtrim(F.col("text"), blanks))
    some = leading < F.col("size")
    parts = held.groupBy(*_CELL, "width", "block").agg(
        F.sum("size").alias("size"),
        F.min(F.when(some, F.col("at") + leading)).alias("low"),
        F.max(F.when(some, F.col("at") + F.col("size") - trailing)).alias("high"),
    )
    blocks = _earlier(_CELL, "block")
    whole = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumn("begin", F.coalesce(F.sum("size").over(blocks), F.lit(0)))
    low = F.min(F.col("begin") + F.col("low")).over(whole)
    high = F.max(F.col("begin") + F.col("high")).over(whole)
    short = F.sum("size").over(whole) <= AS_IT_IS
    cut = F.least(high, low + F.col("width") + 1)
    parts = parts.select(
        *_CELL, "block", "begin",
        F.when(short, 0).otherwise(F.coalesce(low, F.lit(0))).alias("from"),
        F.when(short, AS_IT_IS).otherwise(F.coalesce(cut, F.lit(0))).alias("to"),
    )
    wanted = held.join(parts, [*_CELL, "block"]).withColumn("at", F.col("begin") + F.col("at"))
    first = F.greatest(F.col("from") - F.col("at"), F.lit(0))
    taken = F.least(F.col("size"), F.col("to") - F.col("at")) - first
    # A cell keeps a row even if it is blank.
    wanted = wanted.where((taken > 0) | (F.col("at") == 0)).select(
        *_RECORD, "column", "block", "pos", F.substring("text", (first + 1).cast("int"), F.greatest(taken, F.lit(0)).cast("int")).alias("text")
    )
    cells = wanted.groupBy(*_CELL).agg(F.array_sort(F.collect_list(F.struct("block", "pos", "text"))).alias("parts"))
    cells = cells.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    return cells.groupBy(*_RECORD).agg(
        *[F.max(F.when(F.col("column") == i, F.col("text"))).alias(c) for i, c in enumerate(S.UPLOAD_COLUMNS)]
    )


def _width(column: str) -> int:
    """The width an upload column is held to; a status is only compared with a few words."""
    stored = {"reported_concern": "concern", "assigned_to": "assigned_it"}
    return S.WIDTHS[stored.get(column, column)]


def header_names(header: Column) -> Column:
    """Column names of a header line; a byte-order mark is no part of the first one."""
    return _cells(F.ltrim(header, F.lit("\ufeff")))


def _missing(names: Column) -> Column:
    required = F.array(*[F.lit(c) for c in S.UPLOAD_REQUIRED])
    return F.filter(required, lambda c: ~F.array_contains(names, c))


def _slots(names: Column) -> Column:
    """Cell number of each upload column (NULL where it is absent; of equal names the last one
    counts), or NULL if a required column is missing."""

    def slot(c: Column) -> Column:
        back = F.array_position(F.reverse(names), c)
        return F.when(back > 0, F.size(names) - back.cast("int") + 1)

    slots = F.transform(F.array(*[F.lit(c) for c in S.UPLOAD_COLUMNS]), slot)
    return F.when(F.size(_missing(names)) == 0, slots)


def parse_uploads(lines: DataFrame) -> DataFrame:
    """Rows of accepted files as (file, row_num, upload columns, short).

    ``short`` rows end before one of the upload columns; cells beyond the header are ignored. Cells
    come as they are, but for those over several lines that are longer than ``AS_IT_IS``: they lose
    the blanks at their ends, and what is over the column's width by more than one character. A
    quote that never closes makes the rest of its file one cell.
    """
    held = _data_lines(lines)
    single = held.where(~F.col("inside") & ~F.col("goes_on"))
    several = pin(held.where(F.col("inside") | F.col("goes_on")), "upload-long-rows")
    short = F.exists("slots", lambda slot: slot > F.col("cells"))
    ends = several.groupBy(*_RECORD).agg(F.max(F.col("passed") + F.size("pieces")).alias("cells"), F.any_value("slots").alias("slots"))
    long = ends.join(_long_cells(several), list(_RECORD), "left")

    def rows(df: DataFrame, cell) -> DataFrame:
        cells = [cell(i, name).alias(name) for i, name in enumerate(S.UPLOAD_COLUMNS)]
        return df.select("file", F.col("row_num").cast("bigint").alias("row_num"), *cells, F.coalesce(short, F.lit(False)).alias("short"))

    on_one_line = rows(single.withColumn("cells", F.size("pieces")), lambda i, name: _piece(i))
    return on_one_line.unionByName(rows(long, lambda i, name: F.col(name)))


def refused_uploads(lines: DataFrame) -> DataFrame:
    """Files without the required columns, with the message that names them."""
    firsts = lines.where(F.col("value") != "").groupBy("file").agg(
        F.min(F.struct("block", "pos", "value")).alias("first")
    )
    missing = _missing(header_names(F.col("first.value")))
    return firsts.where(F.size(missing) > 0).select(
        "file",
        F.concat(F.lit("Missing required columns: "), F.array_join(missing, ", ")).alias("message"),
    )


def read_ticket_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all uploaded files below ``path``."""
    return parse_uploads(upload_lines(spark, path))
