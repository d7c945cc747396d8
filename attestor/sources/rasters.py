"""Rasters from files: PNG decoding on executors, flat caches read record by record, and checked dataset indexes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import kernels

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: A file that claims more bytes than this when inflated is refused.
MOST_BYTES = 1 << 30


def chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of a PNG's chunks up to its end; ValueError where it is cut or a checksum is wrong."""
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at = len(SIGNATURE)
    while True:
        if at + 12 > len(content):
            raise ValueError("cut short")
        (length,) = struct.unpack_from(">I", content, at)
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + length]
        if at + 12 + length > len(content) or zlib.crc32(kind + body) != struct.unpack_from(">I", content, at + 8 + length)[0]:
            raise ValueError("cut short or damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + length


def header(body: bytes) -> tuple[int, int, int, int]:
    """(height, width, bits, colour type) of an image's first chunk."""
    if len(body) != 13:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
    if colour not in SAMPLES or bits not in (1, 2, 4, 8, 16) or (bits < 8 and colour not in (0, 3)) or (bits == 16 and colour == 3) or not width * height:
        raise ValueError("unknown kind of image")
    if interlaced:
        raise ValueError("interlaced images are not read")
    return height, width, bits, colour


def unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undoes the five filters of rows (height, bytes), `step` bytes a pixel.

    A byte depends on those left, above and left above of it, so all rows go on together along diagonals, each by its own filter.
    """
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    h, n = raw.shape
    out = np.zeros((h + 1, n // step + 1, step), np.int16)  # a row and a column of zeros come first
    source = raw.reshape(h, -1, step).astype(np.int16)
    w = source.shape[1]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        kind = kinds[y][:, None]
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        add = np.select([kind == 0, kind == 1, kind == 2, kind == 3], [0, left, up, (left + up) >> 1], paeth)
        out[y + 1, x + 1] = (source[y, x] + add) & 255
    return out[1:, 1:].reshape(h, -1).astype(np.uint8)


def decode_png(content: bytes) -> np.ndarray:
    """Levels 0 to 255 as (height, width, samples): one (grey), two (with alpha), three (colours, palettes too) or four.

    Of 16 bits the higher 8 are kept; fewer than 8 are spread over the levels. ValueError for what is no whole PNG.
    """
    head, palette, data = None, None, []
    for kind, body in chunks(content):
        if kind == b"IHDR":
            head = header(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise ValueError("no header")
    h, w, bits, colour = head
    samples = SAMPLES[colour]
    row = (w * samples * bits + 7) // 8
    if (row + 1) * h > MOST_BYTES:
        raise ValueError("too large")
    inflate = zlib.decompressobj()
    try:
        flat = inflate.decompress(b"".join(data), (row + 1) * h)
    except zlib.error as e:
        raise ValueError("damaged") from e
    if len(flat) != (row + 1) * h:
        raise ValueError("cut short")
    rows = np.frombuffer(flat, np.uint8).reshape(h, row + 1)
    out = unfiltered(rows[:, 1:], rows[:, 0], max(1, samples * bits // 8))
    if bits == 16:
        out = out[:, ::2]
    if bits < 8:
        out = np.unpackbits(out, axis=1).reshape(h, -1, bits)[:, :w]
        out = out @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
        out = out if colour == 3 else out * 255 // ((1 << bits) - 1)
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("no such colour in the palette")
        return palette[out.reshape(h, w)]
    return out.reshape(h, w, samples).astype(np.uint8)


def encode_png(image: np.ndarray, filters: int | None = None, bits: int = 8) -> bytes:
    """A PNG of (height, width, samples) levels, or of 16 bits with the level in both bytes; one filter for all rows (0 to 4), or each row's own by turns."""
    h, w, samples = image.shape
    colour = {v: k for k, v in SAMPLES.items() if k != 3}[samples]
    raw = np.repeat(image, 2, axis=2) if bits == 16 else image
    step = raw.shape[2]
    flat = raw.reshape(h, -1).astype(np.int16)
    left, up = np.zeros_like(flat), np.zeros_like(flat)
    left[:, step:], up[1:] = flat[:, :-step], flat[:-1]
    corner = np.zeros_like(flat)
    corner[1:, step:] = flat[:-1, :-step]
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    kinds = np.arange(h) % 5 if filters is None else np.full(h, filters)
    rest = flat - np.choose(kinds[:, None], [np.zeros_like(flat), left, up, (left + up) >> 1, paeth])
    body = np.concatenate([kinds[:, None], rest & 255], axis=1).astype(np.uint8).tobytes()
    part = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def as_colours(image: np.ndarray) -> np.ndarray:
    """Three samples a pixel: grey ones three times, alpha left out."""
    return np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]


def as_grey(image: np.ndarray) -> np.ndarray:
    """One sample a pixel, (height, width): colours by their luminance, alpha left out."""
    return image[:, :, 0] if image.shape[2] < 3 else np.clip(np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


#: What can be read of an image: its levels, in rows, as bytes.
FORMS = {"rgb": as_colours, "grey": as_grey, "mask": lambda i: (as_grey(i) > 127).astype(np.uint8), "as stored": lambda i: i}


def decoded(files: DataFrame, key: str, content: str = "content", form: str = "rgb", resize: tuple[int, int] | None = None) -> DataFrame:
    """(key, height, width, channels, pixels, error) of PNG contents: `form` is 'rgb', 'grey', 'mask' (0 and 1, over 127) or 'as stored'.

    Soft masks are 'grey' levels over 255. With `resize` (height, width), masks by their nearest pixel, others by area. A null
    content or one that is no whole PNG gives nulls and the reason as `error`; nothing is dropped.
    """
    make = FORMS[form]

    def one(x: bytes | None) -> tuple:
        if x is None:
            return None, None, None, None, "no content"
        try:
            image = make(decode_png(x))
        except ValueError as e:
            return None, None, None, None, str(e)
        if resize:
            image = np.clip(np.rint(kernels.resize(image, *resize, "nearest" if form == "mask" else "area")), 0, 255).astype(np.uint8)
        h, w, *rest = image.shape
        return h, w, rest[0] if rest else 1, image.tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 16):
                part = b.slice(at, 16)
                columns = zip(*(one(x.as_py()) for x in part.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[key, "height", "width", "channels", "pixels", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"{key} {kind}, height int, width int, channels int, pixels binary, error string")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the PNG files below a path, of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][nN][gG]").load(path).select("path", "length", "content")


def images(spark: SparkSession, path: str, form: str = "rgb", resize: tuple[int, int] | None = None) -> DataFrame:
    """decoded() of the PNG files below a path, by `path`."""
    return decoded(files(spark, path), "path", form=form, resize=resize)


def sizes(contents: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, height, width) from the first bytes of PNG contents; nulls for what is none. In the JVM: no image is decoded."""
    head = F.substring(content, 1, 24)
    whole = (F.length(head) == 24) & (F.substring(head, 1, 8) == F.lit(SIGNATURE)) & (F.substring(head, 13, 4) == F.lit(b"IHDR"))
    number = lambda at: F.when(whole, F.conv(F.hex(F.substring(head, at, 4)), 16, 10).cast("int"))
    return contents.select(key, number(21).alias("height"), number(17).alias("width"))


def records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(index, record) of a flat file of records of `size` bytes. Each task seeks to its own part and reads no more; any length of file.

    The file must be a whole number of records, or the read fails.
    """
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(size)}
    kinds = "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable"
    rows = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", *kinds, conf=conf)
    return rows.map(lambda r: (r[0], bytes(r[1]))).toDF("index long, record binary")


def packed(spark: SparkSession, path: str, directory: DataFrame, height: int, width: int) -> DataFrame:
    """Rows of a flat byte cache [N, H, W] by the `index` in `directory`, whose columns stay, as `raster`; entries without a record are left out."""
    return directory.join(records(spark, path, height * width).withColumnRenamed("record", "raster"), "index")


def cache_findings(spark: SparkSession, path: str, directory: DataFrame, height: int, width: int, blank: bool = False) -> DataFrame:
    """(index, finding): what is wrong with a cache [N, H, W] and its directory (index, group_key, corruption, digest).

    A record's digest is the SHA-256 of its bytes; with `blank` it must be all zeros (a control arm). One aggregation by index
    and one by (group_key, corruption).
    """
    size = height * width
    have = records(spark, path, size).select("index", F.sha2("record", 256).alias("found"), (F.col("record") != F.lit(bytes(size))).alias("filled"))
    both = directory.withColumn("listed", F.lit(True)).join(have.withColumn("stored", F.lit(True)), "index", "full")
    several = directory.groupBy("group_key", "corruption").agg(F.count("*").alias("n"), F.min("index").alias("index")).where("n > 1")
    again = directory.groupBy("index").count().where("count > 1")
    rules = [("stored is null", "no record"), ("listed is null", "not listed"), ("digest <> found", "digest"), ("listed and coalesce(trim(group_key), '') = ''", "no group")]
    rules += [("filled", "not blank")] if blank else []
    found = both.select("index", F.explode(F.array(*(F.when(F.expr(rule), name) for rule, name in rules))).alias("finding")).where("finding is not null")
    return found.union(several.select("index", F.lit("repeated key"))).union(again.select("index", F.lit("repeated index")))


def cache_pair_findings(candidate: DataFrame, control: DataFrame) -> DataFrame:
    """(index, finding): rows of two directories, which must be the same but for the digests, that one of them lacks."""
    keys = [x for x in candidate.columns if x != "digest"]
    sides = candidate.select(*keys, F.lit(1).alias("side")).union(control.select(*keys, F.lit(2)))
    n = lambda side: F.count_if(F.col("side") == side)
    odd = sides.groupBy(*keys).agg(n(1).alias("a"), n(2).alias("b")).where("a <> b")
    return odd.select("index", F.when(F.col("a") > F.col("b"), "not in control").otherwise("not in candidate").alias("finding"))


INDEX = "schema_version string, row_count long, fit_count long, holdout_count long, rows array<struct<sample_id: string, group_key: string, role: string, split: string, source_split: string, fold: int, image_relative: string, mask_relative: string, rgb_sha256: string, mask_sha256: string>>"


def dataset_index(spark: SparkSession, path: str, sha256: str, schema_version: str, folds: dict[int, int]) -> DataFrame:
    """The rows of a dataset index, a JSON file pinned by its digest, once all that it declares holds; ValueError otherwise.

    folds: how many rows each fold must have; the last one is the holdout ('train_screen_holdout'), the others are for fitting
    ('train'). Only counts come to the driver.
    """
    file = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("sha256"))
    head = file.select("sha256", F.from_json(F.col("content").cast("string"), INDEX).alias("j")).select("sha256", "j.*")
    last = max(folds)
    rows = head.select(F.explode("rows").alias("r")).select("r.*")
    rule = "role = 'fit' and fold < {0} and split = 'train' or role = 'holdout' and fold = {0} and split = 'train_screen_holdout'".format(last)
    safe = "not ({0} rlike '^/|^[A-Za-z]:|\\\\\\\\|(^|/)[.][.](/|$)' or {0} = '')"
    checks = {
        "role and fold": rule, "source split": "source_split = 'train'", "group": "trim(group_key) <> ''",
        "path": f"{safe.format('image_relative')} and {safe.format('mask_relative')}", "digest": "rgb_sha256 rlike '^[0-9a-f]{64}$' and mask_sha256 rlike '^[0-9a-f]{64}$'",
    }
    bad = [F.count_if(~F.coalesce(F.expr(x), F.lit(False))).alias(name) for name, x in checks.items()]
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct("group_key").alias("groups"), *bad).first().asDict()
    by_fold = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().limit(len(folds) + 1).collect()}
    declared = head.select("sha256", "schema_version", "row_count", "fit_count", "holdout_count").first()
    total = sum(folds.values())
    faults = [name for name in checks if seen[name]]
    faults += ["file digest"] if declared.sha256 != sha256 else []
    faults += ["schema version"] if declared.schema_version != schema_version else []
    faults += ["counts"] if (declared.row_count, declared.fit_count, declared.holdout_count, seen["n"]) != (total, total - folds[last], folds[last], total) or by_fold != folds else []
    faults += ["repeated group"] if seen["groups"] != seen["n"] else []
    if faults:
        raise ValueError(f"dataset index: {', '.join(faults)}")
    return rows


def indexed_pairs(spark: SparkSession, rows: DataFrame, root: str, side: int = 384) -> DataFrame:
    """The images and masks that an index names below `root`, side x side, as `image` and `mask`, with a `finding`: null, or what is wrong.

    The digests are those of the pixels as stored: SHA-256 of 'HxWx3|' and the colours, of 'HxW|' and the mask's 0 and 1.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    content = files(spark, root).select(F.substr("path", F.lit(len(where) + 2)).alias("relative"), "content")
    named = rows.select("sample_id", F.explode(F.array(*(F.struct(F.lit(x).alias("what"), F.col(f"{x}_relative").alias("relative")) for x in ("image", "mask")))).alias("w"))
    read = named.select("sample_id", "w.*").join(content, "relative", "left").select(F.struct("sample_id", "what").alias("key"), "content")
    out = rows
    for what, form, shape in (("image", "rgb", "x3|"), ("mask", "mask", "|")):
        mine = read.where(F.col("key.what") == what)
        text = F.concat(F.col("height").cast("string"), F.lit("x"), F.col("width").cast("string"), F.lit(shape)).cast("binary")
        stored = decoded(mine, "key", form=form).select("key.sample_id", "error", F.sha2(F.concat(text, "pixels"), 256).alias(f"{what}_found"))
        small = decoded(mine, "key", form=form, resize=(side, side)).select("key.sample_id", F.col("pixels").alias(what))
        out = out.join(stored.withColumnRenamed("error", f"{what}_error"), "sample_id", "left").join(small, "sample_id", "left")
    finding = F.coalesce(*(F.when(F.col(f"{w}_error").isNotNull(), F.concat(F.lit(f"{w}: "), f"{w}_error")) for w in ("image", "mask")), F.when(F.expr("image_found <> rgb_sha256"), "image digest"), F.when(F.expr("mask_found <> mask_sha256"), "mask digest"))
    return out.withColumn("finding", finding).drop("image_found", "mask_found", "image_error", "mask_error")
