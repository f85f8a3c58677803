"""Detections against truth, readings against labels, and which stage lost a plate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geometry import IOU_THRESHOLD, SIZE_BUCKETS, corners, iou, size_bucket
from sightline.functions.text import CORRECT, CORRUPTED, MISSED, OCR_ERROR, REJECTED, classify, error_rate


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def _boxes(df: DataFrame, order: list[Column], fields: list[str], name: str) -> DataFrame:
    """An image's few boxes as one array, in order."""
    rows = df.where("image_id IS NOT NULL").select("image_id", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *fields).alias("b"))
    return rows.groupBy("image_id").agg(F.array_sort(F.collect_list("b")).alias(name))


def match_boxes(truth: DataFrame, detections: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """Each image's detections matched to its truth, one to one, by descending confidence.

    ``truth`` has image_id, box_index, x1, y1, x2, y2 and pixel_width;
    ``detections`` image_id, det_index, x1, y1, x2, y2 and confidence.  A
    detection takes the free true box of highest overlap, of at least
    ``threshold`` (ties: the later box); equal confidences go by det_index.

    Gives image_id, truth (array), matched (array of det_index, box_index,
    overlap), extra (det_index of those left over) and missed (box_index).
    Images on one side only count too; rows without image_id are left out; a
    null or NaN confidence comes last.  The fold runs in the JVM, over one
    image's boxes at a time.
    """
    conf = F.when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit(float("inf"))).otherwise(-F.col("confidence").cast("double"))
    t = _boxes(truth, [F.col("box_index")], ["box_index", "x1", "y1", "x2", "y2", "pixel_width"], "truth")
    d = _boxes(detections, [conf, F.col("det_index")], ["det_index", "x1", "y1", "x2", "y2", "confidence"], "found")
    both = t.join(d, "image_id", "full")
    kind_t, kind_d = t.schema["truth"].dataType.simpleString(), d.schema["found"].dataType.simpleString()
    both = both.select("image_id", F.coalesce("truth", F.array().cast(kind_t)).alias("truth"), F.coalesce("found", F.array().cast(kind_d)).alias("found"))
    start = F.array().cast("array<struct<det_index: int, box_index: int, overlap: double>>")

    def step(done: Column, det: Column) -> Column:
        free = F.filter("truth", lambda b: ~F.exists(done, lambda m: m["box_index"] == b["box_index"]))
        offers = F.transform(free, lambda b: F.struct(iou(det, b).alias("overlap"), b["box_index"].cast("int").alias("box_index")))
        best = F.array_max(F.filter(offers, lambda o: o["overlap"] >= threshold))
        entry = F.struct(det["det_index"].cast("int").alias("det_index"), best["box_index"].alias("box_index"), best["overlap"].alias("overlap"))
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(entry)))

    out = both.withColumn("matched", F.aggregate("found", start, step))
    extra = F.filter(F.transform("found", lambda x: x["det_index"].cast("int")), lambda i: ~F.exists("matched", lambda m: m["det_index"] == i))
    missed = F.filter(F.transform("truth", lambda x: x["box_index"].cast("int")), lambda i: ~F.exists("matched", lambda m: m["box_index"] == i))
    return out.select("image_id", "truth", "matched", extra.alias("extra"), missed.alias("missed"))


def image_counts(matches: DataFrame) -> DataFrame:
    """image_id, tp, fp, fn and errors of each image."""
    n = lambda c: F.size(c)
    return matches.select("image_id", n("matched").alias("tp"), n("extra").alias("fp"), n("missed").alias("fn"), (n("extra") + n("missed")).alias("errors"))


def rates(df: DataFrame) -> DataFrame:
    """Counts tp, fp, fn with precision, recall and f1, each 0 where it has no denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def _sums(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))


def overall(matches: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1."""
    return rates(_sums(image_counts(matches)))


def by_size(matches: DataFrame) -> DataFrame:
    """The same for each size bucket of true plates.

    Hits and misses count where their own plate belongs; an image's false
    alarms count where its widest plate belongs, and nowhere if it has none.
    """
    entry = lambda bucket, tp, fp, fn: F.struct(bucket.alias("bucket"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    hit = lambda b: F.exists("matched", lambda m: m["box_index"] == b["box_index"]).cast("int")
    own = F.transform("truth", lambda b: entry(size_bucket(b["pixel_width"]), hit(b), F.lit(0), 1 - hit(b)))
    widest = F.array_max(F.transform("truth", lambda b: b["pixel_width"]))
    alarms = F.when(F.size("truth") > 0, F.array(entry(size_bucket(widest), F.lit(0), F.size("extra"), F.lit(0)))).otherwise(F.array().cast("array<struct<bucket: string, tp: int, fp: int, fn: int>>"))
    rows = matches.select(F.explode(F.concat(own, alarms)).alias("e")).select("e.*")
    names = matches.sparkSession.createDataFrame([(n,) for n, _ in SIZE_BUCKETS], "bucket string")
    return rates(names.join(_sums(rows, "bucket"), "bucket", "left").fillna(0, ["tp", "fp", "fn"]))


def worst_images(matches: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` images of most errors, then by id."""
    return image_counts(matches).orderBy(F.desc("errors"), "image_id").limit(n)


def gallery(matches: DataFrame, n: int = 20) -> DataFrame:
    """The worst images as far as they have errors, with what to draw: truth, extra and missed."""
    top = worst_images(matches, n).where("errors > 0")
    return matches.join(F.broadcast(top.select("image_id", "errors")), "image_id").select("image_id", "errors", "truth", "extra", "missed")


def best_detections(truth: DataFrame, detections: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """The detection that covers each true box best (ties: the later one), if one reaches ``threshold``.

    A detection may serve several boxes.  Gives image_id, box_index, det_index,
    overlap and confidence, nulls where nothing covers a box.
    """
    t, d = truth.alias("t"), detections.alias("d")
    side = lambda a: {k: F.col(f"{a}.{k}") for k in ("x1", "y1", "x2", "y2")}
    pairs = t.join(d, F.col("t.image_id") == F.col("d.image_id")).select(F.col("t.image_id").alias("image_id"), "t.box_index", iou(side("t"), side("d")).alias("overlap"), "d.det_index", "d.confidence").where(F.col("overlap") >= threshold)
    best = pairs.groupBy("image_id", "box_index").agg(F.max(F.struct("overlap", "det_index", "confidence")).alias("b"))
    return truth.select("image_id", "box_index").join(best, ["image_id", "box_index"], "left").select("image_id", "box_index", "b.det_index", "b.overlap", "b.confidence")


def reading_report(df: DataFrame, reference: str, hypothesis: str, *by: str) -> DataFrame:
    """samples, distance, characters, error_rate, exact, accuracy and empty, over all pairs or for each value of ``by``.

    The error rate is edits over reference characters of the whole set.  A
    null hypothesis is an empty one; pairs without reference are left out;
    without rows the ungrouped report has zeros.
    """
    rows = df.where(F.col(reference).isNotNull()).select(*by, F.col(reference).alias("_r"), F.coalesce(F.col(hypothesis), F.lit("")).alias("_h"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("samples"), zero(F.sum(F.levenshtein("_r", "_h"))).alias("distance"), zero(F.sum(F.length("_r"))).alias("characters"),
        F.count_if(F.col("_r") == F.col("_h")).alias("exact"), F.count_if(F.col("_h") == "").alias("empty"),
    )
    return out.withColumn("error_rate", ratio(F.col("distance"), F.col("characters"))).withColumn("accuracy", ratio(F.col("exact"), F.col("samples")))


def worst_readings(df: DataFrame, reference: str, hypothesis: str, n: int = 10) -> DataFrame:
    """The ``n`` pairs of highest error rate above 0, then by text."""
    rows = df.where(F.col(reference).isNotNull()).select(F.col(reference).alias("reference"), F.coalesce(F.col(hypothesis), F.lit("")).alias("hypothesis"))
    return rows.withColumn("error_rate", error_rate(F.col("reference"), F.col("hypothesis"))).where("error_rate > 0").orderBy(F.desc("error_rate"), "reference", "hypothesis").limit(n)


def grammar_gain(df: DataFrame, reference: str, raw: str, corrected: str) -> DataFrame:
    """One row: error rate and accuracy of raw and corrected readings, their gains, and whether each improved."""
    a = reading_report(df, reference, raw).select(F.lit(1).alias("_one"), F.col("error_rate").alias("raw_error_rate"), F.col("accuracy").alias("raw_accuracy"))
    b = reading_report(df, reference, corrected).select(F.lit(1).alias("_one"), "error_rate", "accuracy")
    out = a.join(b, "_one").drop("_one")
    out = out.withColumn("error_rate_gain", F.col("raw_error_rate") - F.col("error_rate")).withColumn("accuracy_gain", F.col("accuracy") - F.col("raw_accuracy"))
    return out.withColumn("improved", F.col("error_rate_gain") > 0).withColumn("accuracy_improved", F.col("accuracy_gain") > 0)


def outcomes(df: DataFrame, truth: str = "truth", raw: str = "raw_text", final: str = "final_text", detected: str | None = None) -> DataFrame:
    """``df`` with ``outcome``; with ``detected``, a row where that is false was never found.  An empty raw reading was rejected."""
    final_text = F.when(F.coalesce(F.col(raw), F.lit("")) != "", F.col(final))
    what = classify(F.col(truth), F.col(raw), final_text)
    if detected:
        what = F.when(~F.coalesce(F.col(detected), F.lit(False)), MISSED).otherwise(what)
    return df.withColumn("outcome", what)


def outcome_report(df: DataFrame) -> DataFrame:
    """One row over ``outcome``: total, a count of each outcome, accuracy, and precision over what was reported."""
    n = {k: F.count_if(F.col("outcome") == k) for k in (CORRECT, MISSED, OCR_ERROR, REJECTED, CORRUPTED)}
    out = df.agg(F.count("*").alias("total"), *(c.alias(k) for k, c in n.items()))
    reported = F.col("total") - F.col(REJECTED) - F.col(MISSED)
    return out.withColumn("accuracy", ratio(F.col(CORRECT), F.col("total"))).withColumn("precision", ratio(F.col(CORRECT), reported))


def failures(df: DataFrame, outcome: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of one outcome, by crop_id."""
    return df.where(F.col("outcome") == outcome).orderBy("crop_id").limit(n)


def truth_boxes(records: DataFrame) -> DataFrame:
    """Manifest boxes as truth rows: image_id, box_index, corners, pixel_width, text."""
    rows = records.select("image_id", "width", F.posexplode("boxes").alias("box_index", "b"))
    return rows.select("image_id", "box_index", corners(F.col("b")).alias("c"), (F.col("b.w") * F.col("width")).alias("pixel_width"), F.col("b.text").alias("text")).select("image_id", "box_index", "c.*", "pixel_width", "text")


def crop_key(crop_id: Column) -> tuple[Column, Column]:
    """(image_id, box_index) of a crop id ``image_id#box_index``, cut at the last #; box_index is null if it isn't a number of at least 0."""
    tail = F.substring_index(crop_id, "#", -1)
    index = F.when(tail.rlike("^[0-9]+$"), tail.try_cast("int"))
    return F.substring(crop_id, F.lit(1), F.length(crop_id) - F.length(tail) - 1), index


def check_aligned(truth: DataFrame, predictions: DataFrame) -> None:
    """Raise unless both tables are of the same images (image_id), as a comparison of one with the other needs."""
    a, b = truth.select("image_id").where("image_id IS NOT NULL").distinct(), predictions.select("image_id").where("image_id IS NOT NULL").distinct()
    lone = {"truth": a.join(b, "image_id", "left_anti").count(), "predictions": b.join(a, "image_id", "left_anti").count()}
    if any(lone.values()):
        raise ValueError(f"images of one side only: {lone['truth']} of the truth, {lone['predictions']} of the predictions")


def labelled_crops(crops: DataFrame, labels: DataFrame) -> DataFrame:
    """Crops with their label: crop_id and text of ``labels``, trimmed, in upper case, blanks dropped."""
    text = F.upper(F.trim("text"))
    clean = labels.where("crop_id IS NOT NULL").select("crop_id", text.alias("text")).where("text <> ''")
    return crops.join(clean, "crop_id")


#: Why a label has no plate to be held against, in the order in which it is looked at.
NO_RECORD, NO_FILE, NO_BOX, NO_IMAGE = "no_record", "no_file_name", "no_such_box", "image_missing"


def labelled_plates(labels: DataFrame, records: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(plates, skipped): labels (crop_id, text) with the box that each names, and those that name none.

    A crop id is cut at its last #.  A label is skipped if its image isn't
    among the ``records`` (image_id, boxes, file_name), has no file name, has
    no box of that number, or, where ``files`` (file) are given, isn't there.
    ``plates`` has crop_id, truth, image_id, box_index, box (corners) and
    file_name; ``skipped`` has crop_id and reason.  An image with several
    records gives a row for each; null and blank texts are no labels.
    """
    image_id, index = crop_key(F.col("crop_id"))
    rows = labels.where("crop_id IS NOT NULL AND trim(text) <> ''").select("crop_id", F.upper(F.trim("text")).alias("truth"), image_id.alias("image_id"), index.alias("box_index"))
    known = records.where("image_id IS NOT NULL").select("image_id", "boxes", "file_name", F.lit(True).alias("known"))
    rows = rows.join(known, "image_id", "left")
    box = F.try_element_at("boxes", F.col("box_index") + 1)
    why = F.when(F.col("known").isNull(), NO_RECORD).when(F.coalesce("file_name", F.lit("")) == "", NO_FILE).when(F.col("box_index").isNull() | box.isNull(), NO_BOX)
    if files is not None:
        here = files.select(F.col("file").alias("file_name"), F.lit(True).alias("here")).distinct()
        rows = rows.join(here, "file_name", "left")
        why = why.when(F.col("here").isNull(), NO_IMAGE)
    rows = rows.withColumn("reason", why)
    plates = rows.where("reason IS NULL").select("crop_id", "truth", "image_id", "box_index", corners(box).alias("box"), "file_name")
    return plates, rows.where("reason IS NOT NULL").select("crop_id", "reason")


def end_to_end(plates: DataFrame, detections: DataFrame, texts: DataFrame, region: str | None = None, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """What became of every labelled plate: crop_id, truth, outcome, raw_text, final_text and detection_confidence.

    ``plates`` is what ``labelled_plates`` gives; ``detections`` has image_id,
    det_index, corners and confidence, ``texts`` (image_id, det_index, text)
    what the reader says of them.  The detection that covers a box best is
    read and held against the grammars; where none does the plate is missed,
    and has neither texts nor confidence.
    """
    from sightline.functions.grammar import parse_plates

    boxes = plates.select("image_id", "box_index", "box.*").distinct()
    best = best_detections(boxes, detections, threshold).where("det_index IS NOT NULL").select("image_id", "box_index", "det_index", F.col("confidence").alias("detection_confidence"))
    rows = plates.join(best, ["image_id", "box_index"], "left").join(texts.select("image_id", "det_index", F.col("text").alias("raw_text")), ["image_id", "det_index"], "left")
    rows = rows.withColumn("raw_text", F.when(F.col("det_index").isNotNull(), F.coalesce("raw_text", F.lit("")))).withColumn("found", F.col("det_index").isNotNull())
    rows = parse_plates(rows, "raw_text", "match", region=region).withColumn("final_text", F.col("match.text"))
    out = outcomes(rows, detected="found")
    return out.select("crop_id", "truth", "outcome", "raw_text", F.when(F.col("found"), F.coalesce("final_text", F.lit(""))).alias("final_text"), "detection_confidence")
