"""The product CSV, read without interpreting anything, in parallel though quoted fields span lines.

Spark's text reader cuts a file at line feeds into many splits. Whether a line begins a record depends
on whether a quoted field is open, so two passes are made. The first tells of each split, for either
state in which it may begin, the state in which it ends and how many records begin in it. Composing
these in order, which is all that the driver does, gives each split its true state and the number of
its first row. The second pass joins the lines of each record; a record that crosses splits is put
together from its pieces by its number. Then each record is parsed by itself.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The file's header, and the field that each column fills.
HEADER = {
    "nazwa": "name",
    "nr_katalogowy": "sku",
    "producent": "manufacturer",
    "kategoria": "category",
    "opakowanie": "package",
    "cena": "price",
    "atrybuty_dodatkowe": "attributes",
}

#: A field, if any, and one whose closing quote is not on this line. A quote inside an unquoted field is a letter.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+'
_OPENS = re.compile(rf'(?:{_FIELD},)*+"{_INSIDE}\Z')
_STAYS = re.compile(_INSIDE)
_HEADER_LENGTH = 10_000


def ends_open(line: str, opened: bool) -> bool:
    """Whether a quoted field is open behind the line, if one is or is not before it."""
    at = 0
    if opened:
        closes = _STAYS.match(line).end()
        if closes == len(line):
            return True
        at = line.find(",", closes + 1) + 1
        if not at:
            return False
    return _OPENS.match(line, at) is not None


class _Lines:
    """What a batch's lines of one split do to either state, and which of them are blank."""

    def __init__(self, values: pa.Array):
        self.values = values
        quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
        self.opens, self.closes = np.zeros(len(values), bool), np.zeros(len(values), bool)
        for i in np.flatnonzero(quoted).tolist():
            line = values[i].as_py()
            self.opens[i], self.closes[i] = ends_open(line, False), not ends_open(line, True)
        size = pc.binary_length(values).to_numpy()
        ends = pc.ends_with(values, "\r").to_numpy(zero_copy_only=False)
        self.blank = (size == 0) | ((size == 1) & ends)

    def walk(self, opened: bool) -> tuple[np.ndarray, bool]:
        """Whether a field is open before each line, and behind the last."""
        before = np.zeros(len(self.values), bool)
        turns = (np.flatnonzero(self.opens), np.flatnonzero(self.closes))
        at = 0
        while at < len(before):
            ahead = turns[opened]
            k = np.searchsorted(ahead, at)
            until = int(ahead[k]) + 1 if k < len(ahead) else len(before)
            before[at:until] = opened
            if k < len(ahead):
                opened = not opened
            at = until
        return before, opened


def _splits(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    file, block = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
    names, code = file.dictionary.to_pylist(), file.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
        if hi > lo:
            yield (names[code[lo]], int(block[lo])), batch.column(0).slice(lo, hi - lo)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and either state: the state at its end, and the records that begin in it; and its first line."""
    told: dict[tuple[str, int], list] = {}
    for batch in batches:
        for split, values in _splits(batch):
            lines = _Lines(values)
            seen = told.setdefault(split, [[False, 0], [True, 0], None])
            for state in seen[:2]:
                before, state[0] = lines.walk(state[0])
                state[1] += int((~before & ~lines.blank).sum())
            if seen[2] is None and not lines.blank.all():
                seen[2] = values[int(np.flatnonzero(~lines.blank)[0])].as_py()[:_HEADER_LENGTH]
    rows = [(*split, a, m, b, n, first) for split, ((a, m), (b, n), first) in told.items()]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
    yield _batch(rows, kinds, ["file", "block", "from_closed", "begun", "from_open", "begun_open", "first"])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


#: Of a split: whether a field is open before it, the number of the first record that begins in it, and whether that is the file's header.
Start = tuple[bool, int, bool]


def _join(starts: dict[tuple[str, int], Start], crossing: bool):
    """header, row_number and text of records that lie in one split; or, if `crossing`, of the others' lines, with block and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, opened, lead, base = None, 0, False, False, 0
        held: list[tuple[int, str]] = []  # lines of a record that has begun in this split
        pieces: list[tuple] = []

        def headed(n: int) -> bool:
            return starts[split][2] and n == starts[split][1]

        for batch in batches:
            out, parts = [], []
            for here, values in _splits(batch):
                if here != split:
                    pieces += [(headed(number), number, split[1], at, line) for at, line in held]
                    split, base, held = here, 0, []
                    opened, number, _ = starts[split]
                    number, lead = number - 1, opened
                lines = _Lines(values)
                before, opened = lines.walk(opened)
                begins = ~before & ~lines.blank
                numbers = number + np.cumsum(begins)
                after = np.append(before[1:], opened)
                if not crossing:
                    alone = begins & ~after
                    heads = (numbers == starts[split][1]) & starts[split][2]
                    parts.append((pa.array(heads[alone]), pa.array(numbers[alone]), values.filter(pa.array(alone))))
                for i in np.flatnonzero(before | after).tolist():
                    line, n = values[i].as_py(), int(numbers[i])
                    if lead:
                        pieces.append((False, n, split[1], base + i, line))
                        lead = bool(after[i])
                        continue
                    held.append((base + i, line))
                    if not after[i]:
                        out.append((headed(n), n, "\n".join(line for _, line in held)))
                        held = []
                number, base = int(numbers[-1]), base + len(values)
            if crossing:
                yield _batch(pieces, _PIECE, _PIECE_NAMES)
            else:
                joined = _batch(out, [pa.bool_(), pa.int64(), pa.string()], _PIECE_NAMES[:2] + ["text"])
                yield from pa.Table.from_batches(
                    [pa.RecordBatch.from_arrays(list(x), names=joined.schema.names) for x in parts] + [joined], joined.schema
                ).to_batches()
            pieces = []
        if crossing:
            yield _batch([(headed(number), number, split[1], at, line) for at, line in held], _PIECE, _PIECE_NAMES)

    return run


_PIECE = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_PIECE_NAMES = ["header", "row_number", "block", "place", "text"]


def _checked(first: str, file: str) -> None:
    found = next(csv.reader([first.lstrip("\ufeff").rstrip("\r")]))
    if found != list(HEADER):
        raise ValueError(f"{file} has the header {found}, expected {list(HEADER)}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """row_number (from 1, over all files in the order of their names) and text of each record but the headers.

    Blank lines between records are none. Records end with a line feed, or a carriage return and one,
    which stays in the text; a field that is never closed takes all that follows in its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    told = lines.mapInArrow(
        _survey, "file string, block bigint, from_closed boolean, begun bigint, from_open boolean, begun_open bigint, first string"
    )
    starts: dict[tuple[str, int], Start] = {}
    file, opened, number, header, broken = None, False, 1, True, False
    for r in sorted(told.collect(), key=lambda r: (r["file"], r["block"])):  # a row for each split
        if r["file"] != file:  # the header takes the number of the last row so far
            file, opened, number, header, broken = r["file"], False, number - 1, True, broken or opened
        starts[file, r["block"]] = (opened, number, header)
        broken = broken or opened
        opened, begun = (r["from_open"], r["begun_open"]) if opened else (r["from_closed"], r["begun"])
        if header and begun:
            _checked(r["first"], file)
            header = False
        number += begun
    kinds = "header boolean, row_number bigint, text string"
    records = lines.mapInArrow(_join(starts, False), kinds)
    if broken or opened:  # only then are there records in pieces
        pieces = lines.mapInArrow(_join(starts, True), "header boolean, row_number bigint, block bigint, place bigint, text string")
        parts = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
        whole = pieces.groupBy("header", "row_number").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
        records = records.unionAll(whole)
    return records.filter(~F.col("header")).drop("header")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """row_number and the seven fields as strings, blanks as ''.

    Each file has a header. Fields that a record lacks are blank, and more than there are columns are ignored.
    """
    text = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    schema = ", ".join(f"{c} string" for c in HEADER)
    row = F.from_csv(text, F.lit(schema), {"multiLine": "true", "escape": '"', "mode": "PERMISSIVE"})
    parsed = read_records(spark, path).select("row_number", row.alias("row"))
    return parsed.select("row_number", *[F.coalesce(f"row.{c}", F.lit("")).alias(field) for c, field in HEADER.items()])
