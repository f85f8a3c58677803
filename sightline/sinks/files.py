"""Manifests, label trees, journals and workbooks, written."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geometry import clipped
from sightline.sources.labels import IMAGE_TYPES, repeated_ids

# Columns of the log with their headers and widths, and the sheet's name.
COLUMNS = (
    ("ts", "Timestamp", 20), ("plate", "Plate", 16), ("display", "Formatted", 16), ("region", "Region", 8), ("confidence", "Confidence", 11),
    ("edits", "OCR fixes", 10), ("track_id", "Track", 8), ("frame", "Frame", 9), ("source", "Source", 28), ("crop_path", "Crop", 30),
)
SHEET = "plates"


def manifest_json(records: DataFrame) -> DataFrame:
    """``image_id`` and ``line``: each record as JSON with sorted keys; null fields, unknown regions and empty meta are left out."""
    box = F.transform("boxes", lambda b: F.struct(b["cx"].alias("cx"), b["cy"].alias("cy"), b["h"].alias("h"), F.nullif(b["region"], F.lit("XX")).alias("region"), b["text"].alias("text"), b["w"].alias("w")))
    meta = F.when(F.size("meta") > 0, F.map_from_entries(F.array_sort(F.map_entries("meta"))))
    record = F.struct(
        F.coalesce(box, F.array().cast("array<struct<cx: double, cy: double, h: double, region: string, text: string, w: double>>")).alias("boxes"), "file_name", F.col("split_group").alias("group"), "height", "image_id", meta.alias("meta"), "source", "width"
    )
    return records.select("image_id", F.to_json(record, {"ignoreNullFields": "true"}).alias("line"))


def write_manifest(records: DataFrame, path: str) -> int:
    """Write JSON lines to a folder that appears whole; an id that comes twice is an error.  Returns the number of records."""
    twice = repeated_ids(records).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate image_id {twice[0].image_id!r}")
    manifest_json(records).select("line").write.mode("overwrite").text(path)
    return records.count()


def label_body(boxes: Column, clip: bool = True) -> Column:
    """A record's boxes as label lines, six decimals, each ended by a newline; empty for none."""
    line = lambda b: F.format_string("0 %.6f %.6f %.6f %.6f\n", b["cx"], b["cy"], b["w"], b["h"])
    lines = F.transform(boxes, lambda b: line(clipped(b) if clip else b))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def label_tree(records: DataFrame) -> DataFrame:
    """split, name and body of every label file of records with a split."""
    return records.select("split", F.concat("image_id", F.lit(".txt")).alias("name"), label_body(F.col("boxes")).alias("body"))


def image_plan(records: DataFrame, files: DataFrame) -> DataFrame:
    """Where the image of every record goes: split, image_id, file (as found, null if missing) and name (its place in the split's folder).

    The image is the record's ``file_name``, or if that is null or empty, the file
    named by its id with an image type (the first in the order of IMAGE_TYPES).
    """
    have = files.select("file").where("file IS NOT NULL").distinct()
    named = F.coalesce("file_name", F.lit("")) != ""
    kind = F.lower(F.substring_index("file", ".", -1))
    rank = F.array_position(F.array(*map(F.lit, IMAGE_TYPES)), kind)
    stem = F.expr("substr(file, 1, length(file) - length(substring_index(file, '.', -1)) - 1)")
    by_id = have.where(rank > 0).select(stem.alias("image_id"), "file", rank.alias("rank")).groupBy("image_id").agg(F.min_by("file", F.struct("rank", "file")).alias("own"))
    rows = records.select("split", "image_id", F.when(named, F.col("file_name")).alias("want"))
    rows = rows.join(have.withColumnRenamed("file", "there"), F.col("want") == F.col("there"), "left").join(by_id, "image_id", "left")
    file = F.when(F.col("want").isNotNull(), F.col("there")).otherwise(F.col("own"))
    return rows.select("split", "image_id", file.alias("file"), F.concat("image_id", F.lit("."), F.substring_index(file, ".", -1)).alias("name"))


def _open(uri: str):
    """(file system, path) of an address; a bare path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def write_tree(records: DataFrame, root: str, names: tuple[str, ...] = ("license_plate",), image_root: str | None = None, images: DataFrame | None = None, link: bool = True, allow_missing: bool = False) -> DataFrame | None:
    """Write ``labels/<split>/<id>.txt`` and, with ``image_root``, ``images/<split>/<id>.<type>`` below ``root``, from the executors, and ``data.yaml`` beside them.

    ``root`` and ``image_root`` are folders that all executors share, by path
    or address; executors that don't see the driver's mark in ``root`` are an
    error.  ``images`` lists the files (file) below ``image_root``; if it isn't
    given they are looked up.  On a local file system images are linked, by
    relative paths, so that the tree can be moved, elsewhere or without
    ``link`` copied.  A missing image is an error before anything is written; with
    ``allow_missing`` its label is still written.  Files are written under
    another name and renamed, so a task that runs again leaves the same tree.
    Gives the missing ones (image_id), if images were asked for.
    """
    plan = None
    if image_root is not None:
        if images is None:
            from sightline.sources.labels import image_files

            images = image_files(records.sparkSession, image_root).select("file")
        plan = image_plan(records, images)
        missing = plan.where("file IS NULL").select("image_id")
        if not allow_missing:
            for r in missing.orderBy("image_id").limit(1).collect():
                raise FileNotFoundError(f"no image of {r.image_id!r} under {image_root}")
    fs, at = _open(root)
    mark = f"{at}/.{uuid.uuid4().hex}"
    for split in ("train", "val", "test"):
        for kind in ("labels", "images"):
            fs.create_dir(f"{at}/{kind}/{split}", recursive=True)
    fs.open_output_stream(mark).close()

    def shared():
        own, here = _open(root)
        if own.get_file_info(mark).type.name == "NotFound":
            raise OSError(f"{root} isn't shared by all executors")
        return own, here

    def put_labels(rows) -> None:
        own, here = shared()
        for r in rows:
            tmp = f"{here}/labels/{r.split}/.{r.name}.{uuid.uuid4().hex}"
            with own.open_output_stream(tmp) as f:
                f.write(r.body.encode())
            own.move(tmp, f"{here}/labels/{r.split}/{r.name}")

    def put_images(rows) -> None:
        own, here = shared()
        there, source = _open(image_root)
        for r in rows:
            tmp, end = f"{here}/images/{r.split}/.{r.name}.{uuid.uuid4().hex}", f"{here}/images/{r.split}/{r.name}"
            if link and own.type_name == there.type_name == "local":
                os.symlink(os.path.relpath(f"{source}/{r.file}", os.path.dirname(end)), tmp)
                os.replace(tmp, end)
            else:
                with there.open_input_stream(f"{source}/{r.file}") as a, own.open_output_stream(tmp) as b:
                    shutil.copyfileobj(a, b, 1 << 20)
                own.move(tmp, end)

    try:
        label_tree(records).foreachPartition(put_labels)
        if plan is not None:
            plan.where("file IS NOT NULL").foreachPartition(put_images)
    finally:
        fs.delete_file(mark)
    tmp = f"{at}/.data.yaml.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as f:
        f.write(data_yaml(root, names).encode())
    fs.move(tmp, f"{at}/data.yaml")
    return missing if plan is not None else None


def data_yaml(root: str, names: tuple[str, ...]) -> str:
    listed = "".join(f"  {i}: {n}\n" for i, n in enumerate(names))
    place = root if "://" in root else os.path.abspath(root)
    return f"path: {place}\ntrain: images/train\nval: images/val\ntest: images/test\n\nnames:\n{listed}"


def write_data_yaml(root: str, path: str, names: tuple[str, ...], keep_original: bool = False) -> None:
    """Write the dataset description; with ``keep_original`` the tree's own file is never overwritten."""
    if keep_original and os.path.abspath(path) == os.path.abspath(os.path.join(root, "data.yaml")):
        raise ValueError("this would overwrite the tree's own data.yaml")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(data_yaml(root, names))
    os.replace(path + ".tmp", path)


def missing_images(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose image isn't among ``files`` (file): by file_name, or if that is null by id with any image type."""
    have = files.select("file").distinct()
    by_name = records.where("file_name IS NOT NULL").join(have, records["file_name"] == have["file"], "left_anti").select("image_id")
    stems = have.select(F.regexp_replace("file", r"\.(?i:jpg|jpeg|png|bmp|webp)$", "").alias("image_id")).distinct()
    return by_name.unionByName(records.where("file_name IS NULL").join(stems, "image_id", "left_anti").select("image_id"))


def journal_lines(events: DataFrame) -> DataFrame:
    """``line``: each event as JSON with sorted keys."""
    fields = sorted((("timestamp" if c == "ts" else c), c) for c, _, _ in COLUMNS)
    cell = lambda n, c: (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if c == "ts" else F.col(c)).alias(n)
    return events.select(F.to_json(F.struct(*(cell(n, c) for n, c in fields)), {"ignoreNullFields": "false"}).alias("line"))


def append_journal(events: DataFrame, path: str) -> int:
    """Append events to a journal file, in order of time, plate and track; the lines are on the disk when this returns.  Gives their number.

    A journal is one sequence, so its lines stream through the driver, one
    partition at a time.  A torn last line of an interrupted run is ended first.
    """
    fs, at = _open(path)
    rows = events.orderBy("ts", "plate", "source", "track_id")
    info, n = fs.get_file_info(at), 0
    torn = False
    if info.is_file and info.size:
        with fs.open_input_file(at) as f:
            f.seek(info.size - 1)
            torn = f.read(1) != b"\n"
    with fs.open_append_stream(at) as f:
        if torn:
            f.write(b"\n")
        for r in journal_lines(rows).toLocalIterator():
            f.write(r.line.encode() + b"\n")
            n += 1
        f.flush()
    return n


def log_rows(events: DataFrame) -> DataFrame:
    """The ten columns of the log in their order; columns that events lack are null."""
    return events.select(*((F.col(c) if c in events.columns else F.lit(None)).alias(c) for c, _, _ in COLUMNS))


def _letter(i: int) -> str:
    return chr(ord("A") + i)


def write_workbook(path: str, rows: list[dict]) -> None:
    """Write the log's rows as a workbook: bold header, frozen and filtered, times and confidences formatted.

    The file is written beside its place and renamed; if it can't be replaced,
    nothing is lost.  ``rows`` is the finished log, a sheet's worth: at most
    1,048,575 rows.
    """
    if len(rows) > 1_048_575:
        raise ValueError("a sheet holds 1,048,575 rows; write the log as Parquet or JSON")
    epoch = dt.datetime(1899, 12, 30)

    def cell(i: int, r: int, name: str, v) -> str:
        at = f"{_letter(i)}{r}"
        if v is None:
            return ""
        if isinstance(v, dt.datetime):
            v = v.astimezone().replace(tzinfo=None) if v.tzinfo else v
            return f'<c r="{at}" s="2"><v>{(v - epoch) / dt.timedelta(days=1)!r}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"{" s=\"3\"" if name == "confidence" else ""}><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    head = "".join(f'<c r="{_letter(i)}1" s="1" t="inlineStr"><is><t>{h}</t></is></c>' for i, (_, h, _) in enumerate(COLUMNS))
    body = "".join(f'<row r="{n}">{"".join(cell(i, n, c, r.get(c)) for i, (c, _, _) in enumerate(COLUMNS))}</row>' for n, r in enumerate(rows, 2))
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, (_, _, w) in enumerate(COLUMNS, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{xml}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'{xml}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{xml}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{SHEET}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{xml}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{xml}<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts><fonts count="2"><font/><font><b/></font></fonts>'
        '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFDDDDDD"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="4"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center"/></xf><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="2" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'{xml}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols>'
        f'<sheetData><row r="1">{head}</row>{body}</sheetData><autoFilter ref="A1:{_letter(len(COLUMNS) - 1)}{len(rows) + 1}"/></worksheet>',
    }
    tmp = path + ".tmp"
    try:
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(name, text)
        os.replace(tmp, path)
    except OSError as e:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise OSError(f"cannot write {path}: {e}; the journal holds every event") from e


def recover(spark, journal: str, workbook: str) -> int:
    """Write the workbook anew from its journal; an empty or missing journal is an error."""
    from sightline.sources.journal import read_journal

    events = read_journal(spark, journal).orderBy("line")
    rows = [r.asDict() for r in log_rows(events).limit(1_048_576).collect()]
    if not rows:
        raise ValueError(f"nothing to recover: {journal} is empty or missing")
    write_workbook(workbook, rows)
    return len(rows)
