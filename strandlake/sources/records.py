"""Loading raw records, with those that fail to parse set apart and their reasons."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import cut_lineage, spread

#: Records that are read together at first, and the bounds between which blocks grow and shrink with the failures seen.
BLOCK_ROWS, LEAST_ROWS, MOST_ROWS = 256, 16, 8_192
#: Characters from which a block is cut before it has that many records.
BLOCK_CHARS = 8_000_000

FIELDS = ["seq_id", "description", "seq_len", "residues"]
PARSED = ["record_no", *FIELDS, "reason"]
SCHEMA = "record_no long, seq_id string, description string, seq_len long, residues string, reason string"

# What sound records look like to the block parser.
QUOTED_RIGHT = r'\A(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*\z'
ENDS_IN_BREAK = r"[\r\n]\z"
SOUND_FASTA = r"\A>(?P<id>[^ \t\r\n]+)(?P<description>[^\n]*)\n(?P<residues>[A-Za-z*\-\r\n]*)\z"
SOUND_ID = r"\A[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\z"
SOUND_RESIDUES = r"\A[A-Za-z*\-]*\z"

_DIGITS = re.compile(r"[0-9]+", re.ASCII)
_RESIDUES = re.compile(r"[A-Za-z*-]*")
_BREAK = re.compile(r"[ \t\r\n]")

_PARSE = pa_csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False)
_CONVERT = pa_csv.ConvertOptions(column_types=dict.fromkeys(FIELDS, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False)

TYPES = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

Columns = tuple[pa.Array, pa.Array, pa.Array, pa.Array]


class Failed(Exception):
    """Some record of a block is not sound; which one is not known yet."""


def _mask(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(values, False).to_numpy(zero_copy_only=False).astype(bool)


def readable(texts: pa.Array) -> np.ndarray:
    """The numbers of the csv records that a reader may see. It is kept from nulls, quotes that stand wrong,
    records without quotes that have not three commas, and line ends after a record, which it takes for the
    record's end and the rules for residues."""
    ok = _mask(texts.is_valid()) & ~_mask(pc.match_substring_regex(texts, ENDS_IN_BREAK))
    quoted = _mask(pc.match_substring(texts, '"'))
    ok &= quoted | _mask(pc.equal(pc.count_substring(texts, ","), len(FIELDS) - 1))
    some = np.flatnonzero(ok & quoted)
    ok[some] = _mask(pc.match_substring_regex(texts.take(pa.array(some)), QUOTED_RIGHT))
    return np.flatnonzero(ok)


def read_csv_block(texts: pa.Array) -> pa.Table:
    """The fields of all records of a block; Failed unless the reader finds one row of four in each."""
    # The names come first, so that a byte order mark of the first record stays part of it.
    data = "\n".join([",".join(FIELDS), *texts.to_pylist()]).encode()
    try:
        table = pa_csv.read_csv(
            pa.py_buffer(data),
            read_options=pa_csv.ReadOptions(use_threads=False, block_size=len(data) + 1),
            parse_options=_PARSE,
            convert_options=_CONVERT,
        )
    except pa.ArrowInvalid:
        raise Failed from None
    if table.num_rows != len(texts):
        raise Failed
    return table


def _bisected(texts: pa.Array) -> Iterator[tuple[int, int, pa.Table]]:
    """(first, last + 1, fields) of the blocks that could be read. A block at which the reader stumbles is
    halved, again and again, until its bad records stand alone; they are left out. The block after it starts
    half as long, the one after a block that was read at once twice as long."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum()
    at, rows = 0, BLOCK_ROWS
    while at < len(texts):
        fits = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_CHARS, "right"))
        end = max(at + 1, min(at + rows, fits, len(texts)))
        todo = [(at, end)]
        rows = min(rows * 2, MOST_ROWS)
        while todo:
            low, high = todo.pop()
            try:
                yield low, high, read_csv_block(texts.slice(low, high - low))
            except Failed:
                if high - low > 1:
                    middle = (low + high) // 2
                    todo += [(middle, high), (low, middle)]
                    rows = max(LEAST_ROWS, (end - at) // 2)
        at = end


def parse_csv(texts: pa.Array) -> tuple[np.ndarray, Columns]:
    """The numbers of the records that are certainly sound, and their fields."""
    seen = readable(texts)
    took, tables = [], []
    for low, high, table in _bisected(texts.take(pa.array(seen))):
        took.append(seen[low:high])
        tables.append(table)
    if not tables:
        return np.zeros(0, np.int64), (pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.string()))
    at, table = np.concatenate(took), pa.concat_tables(tables)
    seq_id, description, seq_len, residues = (table.column(c).combine_chunks() for c in FIELDS)
    ok = _mask(pc.match_substring_regex(seq_len, r"\A[0-9]{1,9}\z"))
    numbers = pc.cast(pc.if_else(pa.array(ok), seq_len, "0"), pa.int64())
    ok &= _mask(pc.equal(numbers, pc.cast(pc.utf8_length(residues), pa.int64())))
    ok &= _mask(pc.match_substring_regex(seq_id, SOUND_ID)) & _mask(pc.match_substring_regex(residues, SOUND_RESIDUES))
    return at[ok], tuple(c.filter(pa.array(ok)) for c in (seq_id, description, numbers, residues))


def parse_fasta(texts: pa.Array) -> tuple[np.ndarray, Columns]:
    """The numbers of the records that are certainly sound, and their fields. The pass over the column tells
    by itself which records it does not take, so no block fails."""
    parts = pc.extract_regex(texts, SOUND_FASTA)
    ok = _mask(parts.is_valid())
    parts = parts.filter(pa.array(ok))
    description = pc.utf8_trim(pc.struct_field(parts, "description"), " \t\r")
    residues = pc.replace_substring_regex(pc.struct_field(parts, "residues"), r"[\r\n]+", "")
    return np.flatnonzero(ok), (pc.struct_field(parts, "id"), description, pc.cast(pc.utf8_length(residues), pa.int64()), residues)


def _split_csv(text: str) -> list[str] | None:
    """The fields of one record, None where a quote stands wrong."""
    fields, at = [], 0
    while True:
        if text.startswith('"', at):
            value, at = [], at + 1
            while True:
                end = text.find('"', at)
                if end < 0:
                    return None
                value.append(text[at:end])
                at = end + 1
                if not text.startswith('"', at):
                    break
                value.append('"')
                at += 1
            fields.append("".join(value))
            if at < len(text) and text[at] != ",":
                return None
        else:
            end = text.find(",", at)
            end = len(text) if end < 0 else end
            if '"' in text[at:end]:
                return None
            fields.append(text[at:end])
            at = end
        if at == len(text):
            return fields
        at += 1


def diagnose(fmt: str | None, text: str | None) -> tuple[str | None, str | None, int | None, str | None, str | None]:
    """(seq_id, description, seq_len, residues, reason) of one record by the letter of the rules."""

    def bad(reason: str) -> tuple:
        return None, None, None, None, reason

    if text is None or not text.strip():
        return bad("empty")
    if fmt == "csv":
        fields = _split_csv(text)
        if fields is None:
            return bad("bad_quoting")
        if len(fields) != 4:
            return bad("bad_columns")
        seq_id, description, seq_len, residues = fields
        if not seq_id or any(c.isspace() for c in seq_id):
            return bad("bad_id")
        if not _RESIDUES.fullmatch(residues):
            return bad("bad_residue")
        if not _DIGITS.fullmatch(seq_len) or (seq_len.lstrip("0") or "0") != str(len(residues)):
            return bad("bad_length")
        return seq_id, description, len(residues), residues, None
    if fmt == "fasta":
        if text[0] != ">":
            return bad("no_marker")
        header, mark, body = text.partition("\n")
        if not mark:
            return bad("no_sequence")
        seq_id = _BREAK.split(header[1:], maxsplit=1)[0]
        if not seq_id:
            return bad("bad_id")
        residues = body.replace("\r", "").replace("\n", "")
        if not _RESIDUES.fullmatch(residues):
            return bad("bad_residue")
        return seq_id, header[1 + len(seq_id) :].strip(" \t\r"), len(residues), residues, None
    return bad("unknown_format")


def _rows(fmt: str | None, numbers: pa.Array, texts: pa.Array) -> Iterator[list[pa.Array]]:
    """The columns of some records: those a bulk parser takes, all others by the strict rules."""
    parse = {"csv": parse_csv, "fasta": parse_fasta}.get(fmt)
    took, columns = parse(texts) if parse else (np.zeros(0, np.int64), None)
    rest = np.ones(len(texts), bool)
    rest[took] = False
    left = np.flatnonzero(rest)
    own = [diagnose(fmt, t) for t in texts.take(pa.array(left)).to_pylist()]
    parts = [pa.array(c, t) for c, t in zip(zip(*own, strict=True) if own else [[]] * 5, TYPES, strict=True)]
    if columns:
        parts = [pa.concat_arrays([x, y]) for x, y in zip([*columns, pa.nulls(len(took), pa.string())], parts, strict=True)]
    order = pa.array(np.argsort(np.concatenate([took, left])))
    yield [numbers, *(c.take(order) for c in parts)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for fmt in pc.unique(b.column(1)).to_pylist():
            own = b.filter(pc.equal(b.column(1), fmt) if fmt is not None else pc.is_null(b.column(1)))
            for columns in _rows(fmt, own.column(0), own.column(2).cast(pa.string())):
                yield pa.RecordBatch.from_arrays(columns, PARSED)


def parse_records(df: DataFrame, number: str, fmt: str, text: str) -> DataFrame:
    """Every record of `df` with its fields, or with the reason why it cannot be loaded: `number`, `seq_id`,
    `description`, `seq_len`, `residues`, `reason` (null for sound records, which alone have fields).

    Blocks of csv records go through a bulk reader; a block it cannot read is halved again and again, so that
    each bad record ends up alone, whereas all others keep the fast path. Values are then checked over whole
    columns, and fasta records are taken apart by one pattern over the column. What the fast path does not
    take is diagnosed strictly, record by record; a record that the strict rules do take is loaded.

    Reasons, of which the first that applies is given: `empty`; csv: `bad_quoting`, `bad_columns`, `bad_id`,
    `bad_residue`, `bad_length`; fasta: `no_marker`, `no_sequence`, `bad_id`, `bad_residue`; and
    `unknown_format` for any other or a null format. Null numbers are kept, repeated rows each on their own;
    an empty table has no rows. Other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(number).cast("long").alias("record_no"), F.col(fmt).alias("fmt"), F.col(text).alias("raw"))
    return spread(rows).mapInArrow(_parse, SCHEMA).withColumnRenamed("record_no", number)


def split_records(df: DataFrame, number: str, fmt: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(sound records, rejected records with reasons), parsed once and written to the checkpoint folder."""
    parsed = cut_lineage(parse_records(df, number, fmt, text))
    return parsed.where("reason IS NULL").drop("reason"), parsed.where("reason IS NOT NULL").select(number, "reason")
