"""Operator 9, media columns: Netpbm and BMP decoded to numpy arrays, resized, and written as NPY tiles.

``decode_image`` reads PBM, PGM and PPM (plain and raw, 8 bits a sample, scaled to 255 where the file's white is less) and uncompressed BMP (8, 24 and 32 bits a pixel);
``area_resize`` averages exact areas by an integral image that is evaluated at the cells' edges only, so it
takes little memory beside the image; ``npy_tiles`` cuts an array into tiles and writes each as an NPY file;
``difference_hash`` compares neighbours of a 9 x 8 reduction. ``media_tiles`` applies them to a binary column in Arrow
batches, with rows as the unit of work: no shuffle, and a lost task is simply run again.

The query stores a text's padded bytes as a PGM 64 samples wide, decodes it, writes its tiles as NPY (the stored form: the
tiles one after another), reads them back and computes the features from what it read.

Defined results: a null image gives a null format, no tiles and null hashes; bytes that aren't such an image give the format
``bad``, no tiles and null hashes; an image without pixels is ``bad`` too. In the query a null text counts as empty; equal texts give
equal rows; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.llm.common import CRC32_TABLE, crc32_sql, map_arrow, table

WIDTH = 64
TILE_ROWS = 4096
_NETPBM = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _NETPBM.match(data, at)
        if not m:
            raise ValueError("header")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if len(head) == 3 else 1
    planes = 3 if kind in (3, 6) else 1
    if not 0 < most < 256 or not width or not height:
        raise ValueError("header")
    if kind in (2, 3):
        flat = np.array(data[at:].split()[: width * height * planes], dtype=np.int64)
        if (flat < 0).any() or (flat > most).any():
            raise ValueError("sample")
        flat = flat.astype(np.uint8)
    elif kind == 1:
        flat = 1 - np.frombuffer(re.sub(rb"[^01]", b"", data[at:]), np.uint8) + 48
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1)
        flat = 1 - np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8, width * height * planes, at + 1)
    if most != 255:  # white is 255
        flat = ((np.minimum(flat, most).astype(np.uint16) * 510 + most) // (2 * most)).astype(np.uint8)
    return flat[: width * height * planes].reshape(height, width, planes) if planes == 3 else flat[: width * height].reshape(height, width)


def _bmp(data: bytes) -> np.ndarray:
    start, size = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    width, height = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if size < 40 or packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("header")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = int.from_bytes(data[46:50], "little") or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        return palette[rows]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode_image(data: bytes) -> np.ndarray:
    """uint8 array (height, width) or (height, width, 3); ValueError if ``data`` isn't such an image."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (IndexError, OverflowError) as e:
        raise ValueError("damaged") from e
    raise ValueError("format")


def image_format(data: bytes) -> str:
    return {"1": "pbm", "4": "pbm", "2": "pgm", "5": "pgm", "3": "ppm", "6": "ppm"}[chr(data[1])] if data[:1] == b"P" else "bmp"


def area_sums(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sums of the samples under each output cell, exact (int64): parts of a sample count in ``1 / (height * width)``.

    The integral image is evaluated at the cells' edges only, first along the rows and then along the columns; between two samples
    it is linear.
    """

    def along(x: np.ndarray, cells: int) -> np.ndarray:
        n = len(x)
        low, part = np.divmod(np.arange(cells + 1, dtype=np.int64) * n, cells)
        cuts = np.unique(np.r_[low, np.minimum(low + 1, n)])
        sums = np.add.reduceat(x, cuts[:-1], axis=0, dtype=np.int64)
        total = np.concatenate([np.zeros((1, *x.shape[1:]), np.int64), np.cumsum(sums, axis=0)])
        at, after = total[np.searchsorted(cuts, low)], total[np.searchsorted(cuts, np.minimum(low + 1, n))]
        return np.diff(at * cells + (after - at) * part.reshape(-1, *[1] * (x.ndim - 1)), axis=0)

    return np.swapaxes(along(np.swapaxes(along(image, height), 0, 1), width), 0, 1)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact area under each output cell (float64)."""
    return area_sums(image, height, width) / (image.shape[0] * image.shape[1])


def difference_hash(image: np.ndarray) -> str:
    """64 bits, hexadecimal: whether a cell of the 8 x 9 reduction is brighter than its right neighbour (in exact integers)."""
    grey = image if image.ndim == 2 else image.astype(np.int64) @ np.array([299, 587, 114])
    cells = area_sums(grey, 8, 9)
    return f"{int.from_bytes(np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes(), 'big'):016x}"


def npy_tiles(image: np.ndarray, rows: int = TILE_ROWS, columns: int | None = None) -> list[tuple[int, int, bytes]]:
    """(top, left, NPY file) of the tiles of ``image``, row by row."""
    columns = columns or image.shape[1]
    out = []
    for top in range(0, image.shape[0], rows):
        for left in range(0, image.shape[1], columns):
            np.save(file := io.BytesIO(), np.ascontiguousarray(image[top : top + rows, left : left + columns]), allow_pickle=False)
            out.append((top, left, file.getvalue()))
    return out


def read_npy(data: bytes) -> Iterator[np.ndarray]:
    """The arrays of NPY files that stand one after another."""
    file = io.BytesIO(data)
    while file.tell() < len(data):
        yield np.load(file, allow_pickle=False)


TILE_SCHEMA = "id long, format string, height long, width long, top long, left long, npy binary, tile_hash string, image_hash string"


def media_tiles(images: DataFrame, id_col: str, data_col: str, tile_rows: int = TILE_ROWS, tile_columns: int | None = None, height: int | None = None, width: int | None = None) -> DataFrame:
    """``TILE_SCHEMA`` rows: one for each tile; one without a tile for what can't be decoded. With ``height`` or ``width`` images are resized to it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in TILE_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            for id_, data in zip(batch.column(0), batch.column(1), strict=True):
                id_, data = id_.as_py(), data.as_py()
                try:
                    image = decode_image(data or b"")
                    if height or width:
                        image = np.rint(area_resize(image, height or image.shape[0], width or image.shape[1])).astype(np.uint8)
                    whole = difference_hash(image)
                    found = [(id_, image_format(data), *image.shape[:2], top, left, npy, difference_hash(next(read_npy(npy))), whole) for top, left, npy in npy_tiles(image, tile_rows, tile_columns)]
                except ValueError:
                    found = [(id_, None if data is None else "bad", *[None] * 7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return map_arrow(images.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("data")), run, TILE_SCHEMA)


STORED_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame) -> DataFrame:
    """``STORED_SCHEMA``: each text as a grey image 64 samples wide, stored as NPY tiles and read back."""

    def one(text: bytes) -> tuple:
        rows = max(1, -(-len(text) // WIDTH))
        image = decode_image(b"P5\n%d %d\n255\n" % (WIDTH, rows) + text.ljust(rows * WIDTH, b"\0"))
        media = b"".join(npy for _, _, npy in npy_tiles(image))
        back = np.concatenate(list(read_npy(media)))
        payload = back.tobytes()
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STORED_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            if batch.num_rows:
                found = zip(*[one(x.as_py()) for x in batch.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(found, types, strict=True)]], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")), run, STORED_SCHEMA)


def op9_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts as stored media."""
    return stored_texts(table(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH {CRC32_TABLE}, t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, length(h) // 2 AS n_bytes, greatest(1, (length(h) // 2 + {WIDTH - 1}) // {WIDTH}) AS n_rows,
    rpad(h, (greatest(1, (length(h) // 2 + {WIDTH - 1}) // {WIDTH}) * {2 * WIDTH})::INT, '0') AS payload FROM t
), tiles AS (
  SELECT doc_id, string_agg('934E554D50590100' || '7600' || hex(encode(rpad('{{''descr'': ''|u1'', ''fortran_order'': False, ''shape'': (' || least({TILE_ROWS}, n_rows - k * {TILE_ROWS}) || ', {WIDTH}), }}', 117, ' '))) || '0A'
    || substr(payload, k * {TILE_ROWS * 2 * WIDTH} + 1, {TILE_ROWS * 2 * WIDTH}), '' ORDER BY k) AS media
  FROM (SELECT *, unnest(range(0, (n_rows + {TILE_ROWS - 1}) // {TILE_ROWS})) AS k FROM p) GROUP BY doc_id, n_rows
), samples AS (
  SELECT doc_id, n_rows, i // {WIDTH} AS y, i % {WIDTH} AS x, v FROM (
    SELECT doc_id, n_rows, unnest(range(0, n_rows * {WIDTH})) AS i, unnest(list_transform(regexp_extract_all(payload, '..'), lambda s: ('0x' || s)::BIGINT)) AS v FROM p)
), bands AS (
  SELECT doc_id, c, n_rows, y, sum(v * (least({WIDTH} * (c + 1), 9 * x + 9) - greatest({WIDTH} * c, 9 * x))) AS v
  FROM samples, (SELECT unnest(range(0, 9)) AS c) WHERE {WIDTH} * (c + 1) > 9 * x AND {WIDTH} * c < 9 * x + 9 GROUP BY ALL
), cells AS (
  SELECT doc_id, r, c, sum(v * (least(n_rows * (r + 1), 8 * y + 8) - greatest(n_rows * r, 8 * y))) AS v
  FROM bands, (SELECT unnest(range(0, 8)) AS r) WHERE n_rows * (r + 1) > 8 * y AND n_rows * r < 8 * y + 8 GROUP BY ALL
), bytes AS (
  SELECT a.doc_id, a.r, sum(CASE WHEN a.v > b.v THEN 1 << (7 - a.c)::INT ELSE 0 END)::INT AS byte FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND a.r = b.r AND b.c = a.c + 1 GROUP BY ALL
), features AS (SELECT doc_id, string_agg(printf('%02x', byte), '' ORDER BY r) AS feature FROM bytes GROUP BY 1)
SELECT p.doc_id, n_bytes::BIGINT AS n_bytes, (n_rows * {WIDTH})::BIGINT AS payload_bytes, sha256(unhex(payload)) AS payload_sha256,
  {crc32_sql(f"right(payload, {2 * WIDTH})")} AS tail_crc32, (length(media) // 2)::BIGINT AS media_bytes, sha256(unhex(media)) AS media_sha256, feature
FROM p JOIN tiles USING (doc_id) JOIN features USING (doc_id), crc32_table
"""

QUERIES = {"op9_npy": op9_npy}
ORACLES = {"op9_npy": _ORACLE}
